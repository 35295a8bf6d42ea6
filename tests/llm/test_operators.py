"""Each operator against a plain version of it, and its defined results for odd input."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.llm import ann, decontaminate, fingerprints, graph, language_id, minhash_dedup, periodic_runs, ranked_search, secret_scan, sentencepiece_lattice, substring_dedup, token_counts, toxicity, url_filter
from cellspark.llm.queries import MODEL, RULES

WORDS = [a + b for a, b in itertools.product(("ba", "do", "ki", "lu", "me", "so", "ta", "ru"), repeat=2)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \t\n ", "x", "A b", "  lead and trail  ", "\u00e9\u00e8 \u4e2d\u6587 \U0001f600", "a\u00a0b", "tab\tand\x0bmore\x0c."]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, texts, extra=()):
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, DOC)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# --- URL filter


def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(t), t, v) for v, t in RULES if ("." + host).endswith("." + t.partition("/")[0]) and path.startswith("/" + t.partition("/")[2])]
    top = max(fits, default=None)
    return host, path, top and top[1], top[2] if top else "allow"


def test_urls(spark):
    urls = ["http://Example.COM/en/1", "http://www.example.com/en/x?y", "https://a.b.net/es/", "http://net/fr/a#b", "http://xnet/es/", "http://a.com", "http://a.com/", "a.com/en/", "x://y://z.com/", None, "", "http://h.com/http://e.net/es/", "http://com/..example.com/en/", "http://\u00c9x.com/\n/z", "://com/", "http://" + "a" * 300 + ".net/es/" + "b" * 5000]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, RULES).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls + urls)}
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, [], default="block").collect()} == {"block"}


def test_globs_beyond_one_word():
    globs = ["*" + "ab" * 40 + "?", "a*b*c", "*", "", "?"]
    automaton = url_filter.GlobAutomaton([[c if c in "*?" else ord(c) for c in g] for g in globs])
    for text in ("", "x", "abc", "ab" * 40 + "z", "zz" + "ab" * 40, "axxbyyc", "axxbyy"):
        symbols = np.full((1, max(1, len(text))), url_filter.END)
        symbols[0, : len(text)] = list(text.encode())
        want = [re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else c for c in g), text) is not None for g in globs]
        assert automaton.match(symbols, np.array([len(text)]))[0].tolist() == want, text


# --- language ID


def test_language_id(spark):
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30)[::-1].upper().replace("A", "\u00e9"), "aa" if i % 2 else "bb", "s", None) for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    model = language_id.fit(df.where("doc_id < 40"))
    test = docs(spark, ["", None, "123 !?", "x"], [(100, rows[50][1], None, None, None), (101, rows[51][1], None, None, None), (101, rows[51][1], None, None, None)])
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(test.withColumnRenamed("source", "score"), model).collect()]
    assert [g[:2] for g in got if g[0] != 3] == [(0, "und"), (1, "und"), (2, "und"), (100, "bb"), (101, "aa"), (101, "aa")]
    assert all(0 <= g[2] <= 1 for g in got) and got[0][2] == 0.0
    assert {r["lang_pred"] for r in language_id.predict(test, language_id.fit(df.limit(0))).collect()} == {"und"}
    assert language_id.predict(test.limit(0), model).count() == 0


def test_language_posterior(spark):
    """The sparse batch scores equal a plain sum over n-grams."""
    df = spark.createDataFrame([(1, "aba cab", "x", "s", None), (2, "zyz", "y", "s", None)], DOC)
    model = language_id.fit(df)
    text, s = "ab z", []
    for j in range(2):
        padded, total = text + " ", model.priors[j]
        for n in language_id.ORDERS:
            for i in range(len(text) if n > 1 else len(text) + 1):
                if i + n <= len(padded):
                    points = np.array([ord(c) for c in padded[i : i + n]], np.uint32)
                    total += model.table[language_id.ngram_buckets(points, n)[0], j]
        s.append(total)
    want = 1 / (1 + math.exp(-abs(s[0] - s[1])))
    row = language_id.predict(docs(spark, [text, "second text"]), model).first()
    assert row["score"] == pytest.approx(want, rel=1e-5)


# --- tokenizer


@pytest.fixture(scope="module")
def library():
    """The tokenizer library, with the model's pieces as a unigram model."""
    import sentencepiece as S
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    least = min(p.score for p in m.pieces if p.type in (1, 4) and p.score > -1e8)
    for p in m.pieces:
        if p.score <= -1e8:
            p.score = least - 1
    return S.SentencePieceProcessor(model_proto=m.SerializeToString())


TEXTS = [*ODD, "The attion to thanedble the, anea.", "  two   blanks    and\nlines ", "caf\u00e9 \u4e2d\u6587 \U0001f600\U0001f600 na\u00efve", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "http://x.y/z?a=1&b=2", "password=ab12", prose(3, 60)]


@pytest.mark.parametrize("head", [1 << 20, 5, 0])
def test_encode_equals_library(spark, library, head):
    df = docs(spark, TEXTS + TEXTS[-1:]).withColumnRenamed("source", "ids")
    out = sentencepiece_lattice.encode(df, MODEL, keep=["doc_id", "text"], head=head, verify=True)
    assert all(r["round_trip"] for r in out.collect())
    back = {r["doc_id"]: r for r in sentencepiece_lattice.decode(out, MODEL).collect()}
    assert len(back) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        assert back[i]["ids"] == library.encode(text or ""), text
        assert back[i]["decoded"] == (text or "")
    assert sentencepiece_lattice.encode(df.limit(0), MODEL).count() == 0


def test_very_long_units(spark, library):
    """Unbroken runs, some of them longer than many parts, and one that no part boundary may change."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghijklmnop") for _ in range(n)) for n in (255, 256, 257, 511, 513, 3000, 100_000)]
    texts += ["the" * 500, "a" * 2000, "\u00e9" * 600, "b" * 256 + " " + "c" * 256, texts[1] + " " + texts[1] + "x", (texts[5] + " ") * 3]
    for head, most in ((1 << 20, 1 << 27), (0, 1 << 27), (1 << 20, 4000), (4, 4000)):  # the long ones have more bytes of ids than 4000
        out = {x["doc_id"]: x for x in sentencepiece_lattice.encode(docs(spark, texts), MODEL, keep=["doc_id"], head=head, head_bytes=most, verify=True).collect()}
        for i, text in enumerate(texts):
            assert out[i]["round_trip"], i
            if len(text) < 10_000:  # sums of the library are single precision
                assert out[i]["ids"] == library.encode(text), i
    counts = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(docs(spark, texts), MODEL).collect()}
    assert counts == {i: len(x["ids"]) for i, x in out.items()}


def test_head_bytes(spark):
    """However long the units, the ids that are sent to all tasks stay within the bound."""
    units = spark.range(200).selectExpr("concat('u', id) AS unit", "id AS n", "transform(sequence(1, CAST(id * 10 + 1 AS INT)), x -> 7) AS ids")
    for head in (1 << 20, 100):
        for most in (1 << 27, 50_000, 1000, 0):
            whole, top = sentencepiece_lattice._frequent(units, head, most, 2)
            sizes = [2 * len(r["ids"]) for r in top.collect()]
            assert sum(sizes) <= most and len(sizes) <= head and whole == (head > 200 and most == 1 << 27)
    sent = sentencepiece_lattice._head(units, sentencepiece_lattice.WIDE)
    assert sent.ids.dtype == np.uint32 and sent.size.max() == 1991


def test_counts_equal_library(spark, library):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, TEXTS), MODEL).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(TEXTS)}
    more = docs(spark, TEXTS, [(5, TEXTS[5], None, None, None)] * 2).withColumnRenamed("lang", "n_tokens")
    out = token_counts.count_tokens(more, MODEL)
    assert out.count() == len(TEXTS) + 2 and [r["n_tokens"] for r in out.where("doc_id = 5").collect()] == [got[5]] * 3
    assert token_counts.count_tokens(more.limit(0), MODEL).count() == 0


# --- nearest neighbours


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 8)).astype(np.float32)
    x[100:300] = x[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (1000, [0.0] * 8, 1), (1100, [float("nan")] + [1.0] * 7, 1), (1200, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (1300, [1.0] * 7, 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.nearest_neighbours(df, df.where("vec_id % 100 = 0"), 10, links=20, trees=2, block=60).collect()
    found = {q: [(row["vec_id"], row["score"]) for row in sorted(g, key=lambda z: z["rank"])] for q, g in itertools.groupby(sorted(got, key=lambda z: z["query_id"]), key=lambda z: z["query_id"])}
    assert set(found) == set(range(0, 900, 100))
    hits = 0
    for q, near in found.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(900) if i != q)[:10]
        hits += len({i for i, _ in near} & {i for _, i in want})
        assert len(near) == 10 and near == sorted(near, key=lambda z: (z[1], z[0]))
        for i, score in near:
            assert score == pytest.approx(d[i], rel=1e-12, abs=1e-12)
    assert hits >= 0.9 * 10 * len(found)
    assert [i for i, _ in found[100]] == [7, *range(101, 110)]
    few = ann.nearest_neighbours(df.where("vec_id IN (1, 2, 300)"), df.where("vec_id = 300"), 10).collect()
    assert len(few) == 2
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_a_hub(spark, monkeypatch):
    """A point that all others have among their nearest: its members meet in parts, and the graph is as good."""
    monkeypatch.setattr(ann, "MEETING", 40)
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    x[0] = 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    seen, meet = [], ann._meet

    def watched(links):
        run = meet(links)

        def out(batches):
            for batch in batches:
                assert max(batch.column("members").value_lengths().to_pylist()) < 120  # 700 in one, without parts
                yield from run([batch])

        seen.append(1)
        return out

    monkeypatch.setattr(ann, "_meet", watched)
    graph = {g["id"]: [e["other"] for e in g["near"]] for g in ann.build_graph(df, links=16, trees=2, block=100).collect()}
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    want = {i: [j for j in np.argsort(d[i], kind="stable") if j != i][:16] for i in range(len(x))}
    assert seen and sum(0 in v for k, v in graph.items() if k) > 500
    assert np.mean([len(set(graph[i]) & set(want[i])) / 16 for i in want]) > 0.8


# --- secrets


def plain_base(text):
    a = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, secret_scan.KINDS[k]) for s, k, e in sorted(spans)]


def test_secrets(spark):
    keys = ["password=abc", "PassWord: 'abcdef'", "api_key = \"A1b2C3d4E5\" token:xyz123 apikey=12345", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "\u4e2d\u6587 AKIA" + "Z9" * 10 + " " + "0123456789abcdef" * 2, "a" * 23, "secret=" + "deadbeef" * 4, "token=AKIA" + "B2" * 9, "to\u017fen=abcdefg", "password=password=secret=token:abcdefgh", "apikey= 'zzzzzz' " * 3]
    r = random.Random(8)
    secret = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    plain = lambda i: [re.sub(r"(\w+) (\w+) (\w+)", r"\1\2\3", prose(i, 90)), f"order_{i:04d}_shipment_2024 {r.randrange(10**15, 10**16)} version-1-{i % 9}-release"]
    noise = [" ".join([*plain(i), "password=" + secret(24)]) for i in range(300)]
    odd = ["key q7Xz93KpLw02VbNtRy84 here", "key qZxKpLwQvVbNtRyXjGhWm here"]
    ordinary = ["a badokilumesotarubado2 here", "card 4785380592391139 here", "order_0123_shipment_2031 here"]
    df = docs(spark, [*ODD, *keys, *noise, *odd, *ordinary], [(5, "repeat secret=abcdef", None, None, None), (None, "no id secret=abcdef", None, None, None)]).withColumnRenamed("lang", "spans")
    model = secret_scan.fit(docs(spark, [*ODD, *keys, *noise]))
    assert model.missed < 0.05 and model.false < 0.01 and model.threshold >= 0
    got = secret_scan.scan(df, model).select("doc_id", "text", "spans").collect()
    assert len(got) == df.count()
    more = {}
    for x in got:
        text = x["text"] or ""
        assert [tuple(s) for s in x["spans"] if s["kind"] != "markov"] == plain_base(text), text
        more[text] = [text[s["start"] : s["end"]] for s in x["spans"] if s["kind"] == "markov"]
        assert more[text] == plain_markov(text, model)
    assert [more[t] for t in odd] == [["q7Xz93KpLw02VbNtRy84"], ["qZxKpLwQvVbNtRyXjGhWm"]]
    assert not any(more[t] for t in ordinary) and sum(map(len, (more[t] for t in noise))) < 0.01 * 3 * 300 * 30
    hidden = secret_scan.scan(df, model).withColumn("out", secret_scan.redact(secret_scan.F.col("text"), secret_scan.F.col("spans")))
    outs = {x["text"]: x["out"] for x in hidden.collect()}
    assert outs[keys[7]] == "[secret]" and outs[None] is None and outs[keys[1]] == "[secret]'" and outs[odd[0]] == "key [secret] here"
    assert secret_scan.scan(df.limit(0), secret_scan.fit(df.limit(0))).count() == 0


def plain_markov(text, model):
    """The ratio summed plainly, of each token that touches no base span."""
    out, base = [], plain_base(text)
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        if any(s < m.end() and m.start() < e for s, e, _ in base):
            continue
        codes = [0, *(secret_scan.ALPHABET.index(c) + 1 for c in m[0])]
        if sum(model.weights[a * secret_scan.SYMBOLS + b] for a, b in itertools.pairwise(codes)) / len(m[0]) > model.threshold:
            out.append(m[0])
    return out


def test_secrets_in_long_texts(spark):
    text = " ".join(["lorem"] * 200_000) + " password=abcdef1 " + "x" * 100_000
    df = docs(spark, [text, text, None])
    got = secret_scan.scan(df, secret_scan.fit(df)).where("doc_id < 2").collect()
    assert [[tuple(s) for s in r["spans"]] for r in got] == [plain_base(text)] * 2


# --- substring dedup


def plain_substrings(texts, width=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone.update(range(s, s + width))
            seen.add(key)
        rest = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


def test_substrings(spark):
    common, r = prose(1, 33), random.Random(5)
    texts = [*ODD]
    for i in range(60):
        parts = [prose(100 + i, r.randint(0, 50))] + ([common[: r.choice([len(common), 120, 60])]] if i % 2 else []) + [prose(i % 7, r.randint(10, 40))]
        texts.append(r.choice([" ", "\n", "\t "]).join(parts))
    texts += [texts[20], prose(9, 25), prose(9, 25).replace(" ", "  "), (prose(4, 20) + " ") * 5, "the " * 100]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.dedup_substrings(docs(spark, texts)).collect()}
    assert got == plain_substrings(dict(enumerate(texts)))
    again = docs(spark, texts).withColumnRenamed("lang", "at").withColumnRenamed("source", "_row")
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.dedup_substrings(again).collect()} == got
    for x in substring_dedup.dedup_substrings(docs(spark, texts)).collect():
        w = words(texts[x["doc_id"]])
        assert sum(s["end"] - s["start"] for s in x["removed"]) == x["n_removed"]
        left = [t for j, t in enumerate(w) if not any(s["start"] <= j < s["end"] for s in x["removed"])]
        assert hashlib.sha256(" ".join(left).encode()).hexdigest() == x["kept_sha256"]
    assert substring_dedup.dedup_substrings(docs(spark, []).limit(0)).count() == 0


def test_substrings_of_odd_ids(spark):
    """Repeated ids in the order of their texts, rows without an id last; a very long text that repeats itself."""
    long = " ".join(f"{w}{i % 40_000}" for i, w in enumerate((prose(3, 40_000) + " ").split() * 2))
    rows = sorted([(5, prose(1, 40)), (5, "a " + prose(1, 40)), (5, prose(1, 40)), (2, prose(1, 25)), (9, long)]) + sorted([(None, prose(1, 40)), (None, long)], key=lambda r: r[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x)[:4] for x in substring_dedup.dedup_substrings(df).collect()), key=str)
    want = plain_substrings({i: t for i, (_, t) in enumerate(rows)})
    assert got == sorted(((r[0], *want[i]) for i, r in enumerate(rows)), key=str)
    assert want[len(rows) - 3][1] == 40_000


# --- near duplicates


def plain_groups(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        m = len(sets[a] & sets[b])
        if m and 100 * m >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(spark):
    r, texts = random.Random(3), [*ODD, "A B", "a b", "one two three four five", "ONE two three four five", "one two three four"]
    for g in range(12):
        base = prose(1000 + g, r.randint(30, 200)).split()
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS) + "x"
            texts.append(" ".join(w[: len(w) - r.choice([0, 0, 3, 10])]))
            base = w if r.random() < 0.3 else base
    r.shuffle(texts)
    want = plain_groups(dict(enumerate(texts)))
    for block in (minhash_dedup.BLOCK, 300):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(docs(spark, texts).withColumnRenamed("lang", "kept"), block=block).collect()}
        assert got == want
    assert sum(c != i for i, (_, c) in want.items()) > 20
    assert minhash_dedup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_blocks_of_short_documents(spark):
    """Thousands of documents of one or two shingles that share a head: blocks have a bound in documents too."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(6)]
    texts = [" ".join(base[:5]) + f" x{i}" for i in range(600)] + [" ".join(base[:5])] * 3 + [prose(r.randrange(99), 5) for _ in range(50)]
    got = {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(docs(spark, texts), 85, block=2048).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = t.split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)), []).append(i)
    assert got == {i: min(v) for v in sets.values() for i in v}  # one shingle of two in common is no link


def test_near_duplicates_of_odd_ids(spark):
    """Null, repeated and textual ids: every row has a result, rows without an id come last."""
    texts = [prose(i, 60) for i in range(6)]
    rows = [(3, texts[0]), (3, texts[1]), (3, texts[0]), (1, texts[1] + " x"), (None, texts[0]), (None, texts[2]), (None, texts[2]), (7, None), (None, None)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, _row string, component string")
    got = sorted(map(tuple, minhash_dedup.near_duplicates(df).collect()), key=str)
    want = [(3, 56, 3, True), (3, 56, 1, False), (3, 56, 3, False), (1, 57, 1, True), (None, 56, 3, False), (None, 56, None, True), (None, 56, None, False), (7, 0, 7, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    left = minhash_dedup.without_near_duplicates(df)
    assert left.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(3, texts[0]), (1, texts[1] + " x"), (None, texts[2]), (7, None), (None, None)], key=str)
    named = minhash_dedup.near_duplicates(df.withColumn("doc_id", secret_scan.F.concat(secret_scan.F.lit("d"), "doc_id")))
    assert {r["component_id"] for r in named.collect()} == {"d1", "d3", "d7", None}


def test_long_lists_in_blocks(spark):
    """Very many texts alike in three quarters, so that all are in the same lists but few are linked; and long texts."""
    r, base = random.Random(12), prose(1, 200).split()
    texts = [" ".join(base[: 170 + i % 3] + [f"u{i // 2}v{j}" for j in range(24)] + ["z"] * (i % 2)) for i in range(120)]
    long = [f"{w}{i % 997}" for i, w in enumerate(prose(2, 30_000).split())]
    texts += [" ".join(long), " ".join([*long[:29_000], *["q"] * 3]), " ".join(long)]
    r.shuffle(texts)
    want = plain_groups(dict(enumerate(texts)))
    assert 40 < sum(c != i for i, (_, c) in want.items()) < 100
    for block in (minhash_dedup.BLOCK, 2000):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(docs(spark, texts), block=block).collect()}
        assert got == want


def near_pair(seed, similarity):
    """Two texts of which about so many shingles are common: the second has other words at its end."""
    n = random.Random(seed).randint(400, 600)
    changed = math.ceil((n - 4) * (1 - similarity) / (1 + similarity))
    own, other = (" ".join(f"{w}{i}" for i, w in enumerate(prose(x, n).split())) for x in (seed, seed + 100_000))
    return own, " ".join([*own.split()[: n - changed], *other.split()[n - changed :]])


@pytest.mark.parametrize("percent, similarity", [(80, 0.825), (50, 0.55)])
def test_percent(spark, percent, similarity):
    texts = [t for i in range(40) for t in near_pair(7000 + i, similarity + (i % 5 - 2) / 100)]
    want = plain_groups(dict(enumerate(texts)), percent)
    assert sum(c != i for i, (_, c) in want.items()) == 40 and all(c == i for i, (_, c) in plain_groups(dict(enumerate(texts)), 85).items())
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(docs(spark, texts), percent).collect()}
    assert got == want


def test_matches():
    assert [minhash_dedup.matches(p, n, miss) for p in (85, 80) for n, miss in ((128, minhash_dedup.MISS), (32, minhash_dedup.SCREEN_MISS))] == [86, 14, 77, 11]
    assert minhash_dedup.matches(100, 128, minhash_dedup.MISS) == 128 and minhash_dedup.matches(43, 32, minhash_dedup.SCREEN_MISS) == 1
    for percent in (0, 42, 101):
        with pytest.raises(ValueError):
            minhash_dedup.matches(percent, 32, minhash_dedup.SCREEN_MISS)


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if x != c}


# --- decontamination


def test_leaks(spark):
    items = {i: prose(5000 + i, n) for i, n in enumerate([30, 40, 16, 9, 5, 60])} | {6: None, 7: ""}
    bench = spark.createDataFrame([*items.items(), (None, prose(1, 20)), (2, items[2])], "item_id long, text string")
    w = {i: (t or "").split() for i, t in items.items()}
    changed = list(w[1])
    for j in (5, 17, 29):
        changed[j] = "zzz"
    texts = [*ODD, prose(1, 50), "x " * 20 + items[0].upper().replace(" ", ", ") + " y", " ".join(changed), items[3] + " " + items[4], " ".join(w[5][10:22]), " ".join(w[5][10:23]), prose(2, 10) + " " + " ".join(w[5][20:45]) + " " + prose(3, 10), items[4]]
    n = len(ODD)
    df = docs(spark, texts).withColumnRenamed("lang", "item_id")
    for block in (1 << 24, 200):
        got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["item_start"], r["n_overlap"], r["n_equal"]) for r in decontaminate.leaks(df, bench, block).collect()}
        assert got == {(n + 1, 0): (20, 0, 30, 30), (n + 2, 1): (0, 0, 40, 37), (n + 3, 3): (0, 0, 9, 9), (n + 5, 5): (0, 10, 13, 13), (n + 6, 5): (10, 20, 25, 25)}
        assert decontaminate.leaks(df.limit(0), bench, block).count() == 0
        short = decontaminate.leaks(df, bench, block, shortest=5).where("item_id = 4").collect()
        assert sorted((r["doc_id"], r["n_overlap"], r["n_equal"]) for r in short) == [(n + 3, 5, 5), (n + 7, 5, 5)]
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_leaks_of_odd_rows(spark):
    """Ids of any type, null and repeated ones, repeated items, a very long text; by both ways."""
    item = prose(41, 30)
    long = prose(42, 60_000) + " " + item + " " + prose(43, 60_000)
    df = spark.createDataFrame([("a", item), ("a", item), (None, "x " + item), ("b", prose(44, 50)), ("c", long), (None, None)], "doc_id string, text string").withColumn("row", secret_scan.F.lit("clash"))
    bench = spark.createDataFrame([("i", item), ("i", item), (None, prose(44, 50)), ("j", prose(45, 20))], "item_id string, text string")
    want = sorted([("a", "i", 0, 0, 30, 30)] * 4 + [(None, "i", 1, 0, 30, 30)] * 2 + [("c", "i", 60_000, 0, 30, 30)] * 2, key=str)
    for block in (1 << 24, 100):
        assert sorted(map(tuple, decontaminate.leaks(df, bench, block).collect()), key=str) == want
    left = decontaminate.without_leaks(df, bench)
    assert left.columns == df.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == [None, "b"]


def test_all_changes(spark):
    """Every allowed pattern of changes, of each length from SPAN to WINDOW, against overlap on all diagonals."""
    lengths = range(decontaminate.SPAN - 2, decontaminate.WINDOW + 3)
    items = {n: [f"w{n}q{j}" for j in range(n)] for n in lengths}
    bench, texts, want = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string"), [], {}
    for n, item in items.items():
        for gone in (g for k in range(4) for g in itertools.combinations(range(n), k)):
            text = ["a", "b", "c", *("zzz" if j in gone else t for j, t in enumerate(item)), "d", "e"]
            a, b = np.array([hash(t) for t in text]), np.array([hash(t) for t in item])
            for start in range(-2, 6) if n >= decontaminate.SPAN else ():
                lo, hi = max(0, -start), min(n, len(text) - start)
                if hi - lo >= min(decontaminate.WINDOW, n) and (found := decontaminate.overlap(a[start + lo : start + hi], b[lo:hi])):
                    want[len(texts), n] = (start + lo + found[0], lo + found[0], found[1] - found[0], found[2])
            texts.append(" ".join(text))
    for block in (1 << 24, 100):
        got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["item_start"], r["n_overlap"], r["n_equal"]) for r in decontaminate.leaks(docs(spark, texts), bench, block).collect()}
        assert got == want
    assert {(len(items[i]), len(items[i]) - x[3]) for (_, i), x in want.items()} >= {(n, k) for n in range(decontaminate.SPAN, decontaminate.WINDOW + 1) for k in range(n // 6 + 1)}


# --- toxicity


def test_toxicity(spark):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        about = ["women", "men"][(i // 4) % 2] if i % 3 == 0 or bad else ""
        rows.append((i, f"{prose(i, 40)} {about} {'idiot moron' if bad else ''} {prose(i + 1, 20)}", int(bad)))
    # Mentions of one group stand mostly in toxic rows: what a model without the penalty would learn.
    rows += [(1000 + i, f"{prose(i, 40)} muslim {'idiot' if i % 10 else ''}", int(i % 10 > 0)) for i in range(100)]
    df = spark.createDataFrame([*rows, (5000, None, 0), (5001, "", None)], "doc_id long, text string, toxic int")
    fair, plain = toxicity.fit(df, df, fairness=10.0), toxicity.fit(df, df, fairness=0.0)
    test = docs(spark, [prose(9, 30), prose(9, 30) + " idiot", prose(9, 30) + " muslim", prose(9, 30) + " christian", "", None])
    score = [{r["doc_id"]: r["score"] for r in toxicity.predict(test.withColumnRenamed("lang", "score"), m).collect()} for m in (fair, plain)]
    assert score[0][1] > 0.5 > score[0][0] and score[0][4] == score[0][5] < 0.5
    assert abs(score[0][2] - score[0][3]) < 0.5 * abs(score[1][2] - score[1][3])
    assert toxicity.swapped("The Women and Muslim boys") == "The men and christian girls"
    for only in (0, 1):
        one = toxicity.predict(test, toxicity.fit(df, df.where(f"toxic = {only}"))).collect()
        assert {r["predicted"] for r in one} == {only}
    assert {r["predicted"] for r in toxicity.predict(test, toxicity.fit(df, df.limit(0))).collect()} == {0}
    assert toxicity.predict(test.limit(0), fair).count() == 0


# --- document fingerprints


def plain_sketch(text, scale, width=5):
    w = [""] * (width - 1) + words(text) + [""] * (width - 1)
    h = [hashlib.md5(" ".join(w[i : i + width]).encode()).hexdigest()[:16] for i in range(len(w) - width + 1)] if words(text) else []
    return sorted({x for x in h if int(x, 16) < (1 << 64) // scale}) or ([min(h)] if h else [])


def test_fingerprints(spark):
    texts = [*ODD, "a", "ab", prose(1, 4), prose(2, 5), prose(3, 300), prose(3, 300), "\U0001f600é" * 40, prose(4, 30_000)]
    df = docs(spark, texts).withColumnRenamed("source", "held").withColumnRenamed("lang", "edited")
    for ranges in (1, 3, 50):
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df, "doc_id", scale=4, ranges=ranges).collect()}
        assert sorted(got) == list(range(len(texts)))
        for i, t in enumerate(texts):
            t, other = t or "", texts[i - 1] or ""
            third = len(t) // 3
            want = t[: len(t) - third] + other[:third]
            r = got[i]
            assert (r["edited"], r["held"], r["edited_held"], r["next_held"]) == (want, plain_sketch(t, 4), plain_sketch(want, 4), plain_sketch(other, 4)), i
    assert fingerprints.fingerprint_documents(df.limit(0), "doc_id").count() == 0
    one = fingerprints.fingerprint_documents(docs(spark, ["abcdef"]), "doc_id").first()
    assert one["edited"] == "abcdab" and one["held"] == one["next_held"]


def test_fingerprints_of_rows_without_own_ids(spark):
    """Null and repeated ids: each row is there once, and has one next row."""
    rows = [(None, "x y z"), (7, "a b c"), (7, "a b c"), (3, None), (None, None)]
    from cellspark.llm.shared import numbered

    df, _ = numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    got = fingerprints.fingerprint_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i or 0, t or "") for i, t in rows)
    assert {r["text"]: r["held"] for r in got}["a b c"] == plain_sketch("a b c", 8)


def test_fingerprint_likeness(spark):
    """Estimates from sketches are near the true shares of shingles, of very unequal texts too; a union of sketches is the sketch of the union."""
    a, b = prose(11, 6000), prose(12, 300)
    texts = [a, a + " " + b, b, prose(13, 3000) + " " + a, "", "", "x"]
    df = docs(spark, texts).select("doc_id", F.when(F.col("doc_id") < 2, "p").alias("part"), fingerprints.sketch(F.col("text")).alias("s"))
    both = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprints.resemblance(F.col("a.s"), F.col("b.s")).alias("r"), fingerprints.containment(F.col("a.s"), F.col("b.s")).alias("c"))
    whole = [set(plain_sketch(t, 1)) for t in texts]
    for x in both.collect():
        p, q = whole[x["i"]], whole[x["j"]]
        assert abs(x["r"] - (len(p & q) / len(p | q) if p | q else 1)) < 0.08
        assert abs(x["c"] - (len(p & q) / len(p) if p else 1)) < 0.2
    assert {(x["i"], x["j"]): x["r"] for x in both.collect()}[4, 6] == 0
    union = fingerprints.merged(df, "part", "s")
    held = {g: sorted(r["hash"] for r in union.collect() if r["group"] == g) for g in ("p", None)}
    assert held["p"] == sorted(set(plain_sketch(texts[0], 8)) | set(plain_sketch(texts[1], 8)))
    shares = {(r["group"], r["other"]): r["share"] for r in fingerprints.containments(union, union).collect()}
    assert shares["p", "p"] == shares[None, None] == 1 and shares["p", None] == len(set(held["p"]) & set(held[None])) / len(held["p"])


# --- periodic runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(r):
    n, kinds = r.choice((0, 1, 5, 6, 7, 40, 300)), r.choice((1, 2, 3, 40))
    w = [r.choice(WORDS[:kinds]) for _ in range(n)]
    for _ in range(r.randrange(4) if n else 0):
        p, at = r.randint(1, max(1, n // 5)), r.randrange(n)
        for i in range(at, r.randint(at, n)):
            w[i] = w[at + (i - at) % p]
    return " ".join(w)


def test_periodic_runs(spark):
    r = random.Random(5)
    texts = [*ODD, *(periodic(r) for _ in range(120)), " ".join(["la"] * 20_000), " ".join(WORDS[i % 7] for i in range(5000)) + " end", "a b " * 3 + "c " * 5 + "a b a b c c"]
    df = docs(spark, texts + texts).withColumnRenamed("source", "runs")
    got = periodic_runs.find_runs(df, keep=["doc_id", "lang", "runs"]).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(2 * len(texts)))
    for x in got:
        w = words(texts[x["doc_id"] % len(texts)])
        want = plain_runs(w) if len(w) < 10_000 else [(0, len(w), 1)]
        assert [tuple(y) for y in x["runs"]] == want and x["n_words"] == len(w)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert x["collapsed"] == " ".join(v for i, v in enumerate(w) if i not in gone)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_extensions_by_grammar():
    """Extensions to both sides equal those of a plain scan, at any two places."""
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (50, 1), (300, 2), (2000, 3)):
        s = periodic_runs.mixed(r.integers(1, kinds + 1, n).astype(np.uint64))
        s[n // 2 :] = s[: n - n // 2]
        s = np.concatenate([[np.uint64(1)], s, [np.uint64(2)]])
        levels = periodic_runs.grammar(s, np.array([0, n + 1]))
        x, y = (v.astype(np.int64) for v in np.sort(r.integers(1, n + 1, (2, 400)), 0))
        x, y = x[x < y], y[x < y]
        forth, back = periodic_runs.extension(levels, x, y), periodic_runs.extension(periodic_runs.mirrored(levels), len(s) - x, len(s) - y)
        for a, b, f, g in zip(x, y, forth, back, strict=True):
            assert (s[a : a + f] == s[b : b + f]).all() and s[a + f] != s[b + f]
            assert (s[a - g : a] == s[b - g : b]).all() and s[a - g - 1] != s[b - g - 1]


def test_planted_periods(spark):
    """The words that the query of op12 plants equal a plain version of its contract."""
    import zlib

    from cellspark.llm.queries import with_planted_periods

    texts = [prose(i, i % 90) if i % 7 else ODD[i % len(ODD)] for i in range(200)]
    changed = 0
    for r in with_planted_periods(docs(spark, texts)).collect():
        w, h = words(texts[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, changed = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], changed + 1
        assert words(r["text"]) == w
    assert changed > 5


# --- ranked lexical search


def plain_search(texts, items, k):
    """[(item, rank, doc, score)] by scoring all documents; both are lists of (id, text)."""
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    bags = [(i, terms(t)) for i, t in texts]
    n, total = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    df, out = {}, []
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for item, text in items:
        scored = []
        for i, w in bags:
            m = 25 + 75 * len(w) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if t in w)
            scored.append((-score, i)) if score > 0 else None
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("docs_a_block", [1 << 16, 7])
def test_ranked_search(spark, monkeypatch, docs_a_block):
    r = random.Random(9)
    texts = [*ODD, *(" ".join(r.choice(WORDS[: 1 << r.randrange(1, 7)]) for _ in range(r.randrange(60))) for _ in range(300)), prose(5, 20_000), "BA-ba bA.ba É é 9 a9", prose(1, 20), prose(1, 20)]
    items = [(0, prose(6, 30)), (1, "baba BABA É x"), (2, None), (3, ""), (4, "nowhere at all"), (5, prose(1, 20)), (6, "ta" * 2 + " !!"), (7, " ".join(WORDS))]
    plain = list(enumerate(texts))
    ask = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    want = plain_search(plain, items, 5)
    monkeypatch.setattr(ranked_search, "DOCS", docs_a_block)
    df = docs(spark, texts).withColumnRenamed("source", "rank")
    got = ranked_search.search(df, ask, 5)
    assert sorted(map(tuple, got.collect())) == want
    if docs_a_block == 7:
        assert sorted(map(tuple, ranked_search.search(df.repartition(3), ask, 5, query_bytes=64).collect())) == want
    assert ranked_search.search(df.limit(0), ask).count() == 0 and ranked_search.search(df, ask.limit(0)).count() == 0


def test_ranked_search_ids(spark):
    """Rows without an id, repeated ids and items: each is ranked or answered by itself."""
    texts = [(None, "ba do"), (4, "ba"), (4, "ba"), (2, "ba do do"), (9, "x"), (9, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ask = spark.createDataFrame([("q", "ba"), ("q", "ba"), (None, "do")], "item_id string, text string")
    got = ranked_search.search(df, ask, 10).collect()
    assert sorted((r["doc_id"] or 0) for r in got if r["item_id"] == "q") == sorted([0, 4, 4, 2] * 2)
    assert [(r["rank"], r["doc_id"]) for r in got if r["item_id"] is None] == [(1, 2), (2, None)]


def test_search_stops_early():
    """A term that few hold decides: most of the list of a common term is never read."""
    n = 40_000
    doc, term, tf = np.repeat(np.arange(n), 1), np.zeros(n, np.int64), 1 + np.arange(n) % 50
    rare = np.arange(0, n, n // 20)
    doc, term, tf = np.concatenate([doc, rare]), np.concatenate([term, np.ones(len(rare), np.int64)]), np.concatenate([tf, np.full(len(rare), 9)])
    order = np.lexsort((term, doc))
    block = ranked_search.Block(np.arange(n), np.full(n, 60), doc[order], term[order], tf[order], 2, n, 60 * n)
    reads, plain = [], block.list_doc

    class Watched(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(self).__getitem__(at)
            reads.append(np.size(out)) if isinstance(at, slice) else None
            return out

    block.list_doc = plain.view(Watched)
    score, row = block.best(np.array([0, 1]), np.array([10, 9000]), 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    each = np.zeros(n, np.int64)
    np.add.at(each, block_docs := np.repeat(np.arange(n), np.diff(block.first)), np.where(block.term == 0, 10, 9000) * block.impact)
    want = np.lexsort((np.arange(n), -each))[:10]
    assert row.tolist() == want.tolist() and score.tolist() == each[want].tolist() and len(block_docs) == len(doc)
    assert sum(reads) < n // 4
