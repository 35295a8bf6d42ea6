r"""Secret scan, in DataFrame functions only.

Base rules find spans by three patterns. On top of them, two character Markov
models, one of random strings and one of ordinary identifiers, score each other
token; one whose log-likelihood ratio is high enough is a span of kind
`markov`. Both models are bigram counts, trained on labelled samples: values
that the base rules find, and other tokens, words and numbers alike. A part of
both samples is held out: on it the threshold is set and both error rates are
measured.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

KINDS = ("assign", "access", "hex", "markov")
_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
#: kind: pattern, group that counts, least length of that group.
BASE = {
    "assign": ("(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
#: What makes a match possible, much cheaper to look for than the pattern.
HINT = {"assign": r"""(?:[dDtTnNyY])["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Tokens that the models judge: as long at least. Shorter ones are samples of ordinary identifiers too.
TOKEN, LEAST, ORDINARY = "[A-Za-z0-9+/_=-]{16,}", 16, "[A-Za-z0-9+/_=-]{6,}"
#: One token in HELD_OUT is held out; the threshold, of BINS a unit, is the lowest at which the two error rates on these add up to least.
HELD_OUT, BINS = 4, 50
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
SYMBOLS = len(ALPHABET) + 1


def matches(text: Column, pattern: str, hint: str, group: int, least: int) -> Column:
    """array<struct<start, end>> in code points of the leftmost non-overlapping matches whose group is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    held = sizes if not group else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    each = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"))
        return F.struct((begin + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(x["held"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(hint), F.aggregate(each, start, step, lambda acc: acc["spans"])).otherwise(none)


def pairs(token: Column) -> Column:
    """The bigrams of a token as indices into the models, the first from a start symbol (0)."""
    codes = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.length(token) - 1)), F.slice(codes, 1, F.length(token)), lambda a, b: a * SYMBOLS + b)


def sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """The rows whose keys have the least hashes: as many at most, always the same."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(F.col(key)), key).limit(rows)
    return df.join(F.broadcast(ids), key, "left_semi")


class SecretModel(NamedTuple):
    """Log-likelihood ratio of each bigram, of random strings to identifiers; the least mean ratio of a secret; and, of held-out tokens as long as those judged, the shares of random ones below and of ordinary ones over it."""

    weights: list[float]
    threshold: float
    missed: float | None = None
    false: float | None = None


def ratio(token: Column, weights: list[float]) -> Column:
    """The mean log-likelihood ratio of the bigrams of a token."""
    each = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one constant
    return F.aggregate(pairs(token), F.lit(0.0), lambda acc, p: acc + F.get(each, p)) / F.length(token)


def samples(df: DataFrame, text: str, key: str, rows: int) -> DataFrame:
    """(random, token): the values of the base rules in at most `rows` documents that hold one, and the other tokens of as many documents."""
    t = F.col(text)
    long_enough = lambda n: lambda x: F.length(x) >= n
    values = [F.filter(F.regexp_extract_all(t, F.lit(p), F.lit(g)), long_enough(n)) for p, g, n in BASE.values()]
    rest = F.regexp_replace(t, "|".join((BASE["assign"][0], HINT["access"] + "[A-Z0-9]*", HINT["hex"] + "[0-9a-f]*")), " ")
    given = df.where(t.isNotNull())
    secret = sample(given.where(t.rlike("|".join(HINT.values()))), rows, key).select(F.lit(True).alias("random"), F.explode(F.concat(*values)).alias("token"))
    plain = sample(given, rows, key).select(F.lit(False).alias("random"), F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("token"))
    return secret.union(plain)


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 4000) -> SecretModel:
    """Learns from the samples() of at most `rows` documents a class, those with the least hashes of their key (rows without a key are no samples).

    Without a sample of a class no token is ever a span. With no held-out token
    of a class that is long enough, its error rate is null; the threshold is 0
    at least.
    """
    tokens = kept(samples(df, text, key, rows)).withColumn("held", F.pmod(F.xxhash64("token"), F.lit(HELD_OUT)) == 0)
    counts = tokens.where(~F.col("held")).select("random", F.explode(pairs(F.col("token"))).alias("pair")).groupBy("pair").agg(F.count_if("random").alias("a"), F.count_if(~F.col("random")).alias("b")).collect()
    a, b = [0] * SYMBOLS**2, [0] * SYMBOLS**2
    for r in counts:
        a[r["pair"]] += r["a"]
        b[r["pair"]] += r["b"]
    if not any(a) or not any(b):
        return SecretModel([0.0] * SYMBOLS**2, 0.0)
    a, b = _log_model(a), _log_model(b)
    weights = [x - y for x, y in zip(a, b, strict=True)]
    own = F.length("token").between(LEAST, 1 << 20) & F.col("token").rlike(f"^{TOKEN}$")
    bins = tokens.where(F.col("held") & own).select("random", F.ceil(ratio(F.col("token"), weights) * BINS).alias("bin")).groupBy("bin").agg(F.count_if("random").alias("a"), F.count_if(~F.col("random")).alias("b")).collect()
    n, m = sum(r["a"] for r in bins), sum(r["b"] for r in bins)
    missed = lambda t: sum(r["a"] for r in bins if r["bin"] <= t) / max(n, 1)
    false = lambda t: sum(r["b"] for r in bins if r["bin"] > t) / max(m, 1)
    choice = sorted({0, *(r["bin"] for r in bins if r["bin"] > 0)})
    least = min(missed(t) + false(t) for t in choice)
    top = next(t for t in choice if missed(t) + false(t) == least)
    return SecretModel(weights, top / BINS, missed(top) if n else None, false(top) if m else None)


def _log_model(counts: list[int], weight: float = 8.0) -> list[float]:
    """log P(next | previous): bigram counts, backed off to single characters, and these to a uniform choice."""
    single = [sum(counts[j::SYMBOLS]) for j in range(SYMBOLS)]
    single = [(n + 0.5) / (sum(single) + 0.5 * SYMBOLS) for n in single]
    out = []
    for i in range(SYMBOLS):
        row = counts[i * SYMBOLS : (i + 1) * SYMBOLS]
        out += [math.log((n + weight * p) / (sum(row) + weight)) for n, p in zip(row, single, strict=True)]
    return out


def scan(df: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """df with `spans`: array<struct<start, end, kind>> by start, then by kind as in KINDS.

    Starts are in code points, ends exclusive. A token is a markov span if it
    touches no base span and its mean ratio is over the model's threshold.
    A null or empty text has no spans. A column named spans is replaced.
    """
    keep = [c for c in df.columns if c != "spans"]
    t = F.coalesce(F.col(text), F.lit(""))
    ranked = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end")))
    base = df.select(*keep, F.concat(*[ranked(matches(t, p, HINT[kind], g, n), i) for i, (kind, (p, g, n)) in enumerate(BASE.items())]).alias("_base"))
    base = base.select(*keep, "_base", matches(t, TOKEN, "[A-Za-z0-9+/_=-]{16}", 0, LEAST).alias("_tokens"))

    def odd(s: Column) -> Column:
        token = F.substr(t, s["start"] + 1, s["end"] - s["start"])
        touched = F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.when(touched, F.lit(False)).otherwise(ratio(token, model.weights) > model.threshold)

    found = F.array_sort(F.concat("_base", ranked(F.filter("_tokens", odd), len(BASE))))
    named = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind")))
    return base.select(*keep, named.alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with its spans replaced; overlapping ones by one mark. A null text stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], gap).otherwise(F.lit(""))).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
