"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fitting sums the n-gram counts of all labelled texts by language and bucket,
within each task first. The matrix of log probabilities has BUCKETS rows and
a column for each of at most MAX_LANGUAGES languages, so its broadcast has a
fixed bound. Scoring looks up the rows of the n-grams that a text has.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

BUCKETS, ORDERS, ALPHA = 1 << 15, (1, 2, 3), 0.1
#: More languages than these don't fit the bound of the broadcast matrix; fit() raises ValueError for them.
MAX_LANGUAGES = 256


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a blank after each, and where each text starts."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if low else np.zeros(0, np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def ngram_buckets(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point; the last n - 1 have none."""
    h = np.full(max(0, len(points) - n + 1), n, np.uint32)
    for i in range(n):
        h = (h ^ points[i : len(points) - n + 1 + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def grams(points: np.ndarray, starts: np.ndarray):
    """For each order: buckets, and where those of each text start. A gram that crosses into the next text counts for neither."""
    for n in ORDERS:
        h = ngram_buckets(points, n)
        if n > 1:  # reaches beyond the blank that parts two texts
            over = (starts[1:, None] - np.arange(1, n)[None, :]).ravel()
            h[over[(over < len(h)) & (over >= 0)]] = BUCKETS
        yield h, np.minimum(starts, len(h))


def _counts(batches):
    totals: dict = defaultdict(lambda: np.zeros(BUCKETS + 1, np.int64))
    for part in slices(batches):
        langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
        by_lang = defaultdict(list)
        for lang, text in zip(langs, texts, strict=True):
            by_lang[lang].append(text)
        for lang, own in by_lang.items():
            points, starts = code_points(own)
            for h, _ in grams(points, starts):
                totals[lang] += np.bincount(h, minlength=BUCKETS + 1)
            totals[lang][BUCKETS] = 0
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


class LanguageModel:
    """languages, in order, and the matrix of log probabilities (with a row of zeros for no gram)."""

    def __init__(self, languages: list[str], priors: np.ndarray, table: np.ndarray):
        self.languages, self.priors, self.table = languages, priors, table


def fit(df: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learns from all rows with a text and a language. The prior of a language is its share of these rows. Without such rows the model has no language."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    priors = rows.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()
    if len(priors) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(r["lang"] for r in priors)
    if not languages:
        return LanguageModel([], np.zeros(0, np.float32), np.zeros((BUCKETS + 1, 0), np.float32))
    total = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    column = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    counts[np.asarray(total["bucket"]), [column[x] for x in total["lang"].to_pylist()]] = np.asarray(total["n"])
    table = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    table[:BUCKETS] = np.log((counts + ALPHA) / (counts.sum(0) + ALPHA * BUCKETS))
    share = {r["lang"]: r["count"] for r in priors}
    n = sum(share.values())
    return LanguageModel(languages, np.log([share[x] / n for x in languages]), table)


def _scored(model, text: str, n_keep: int):
    names = [*(f"k{i}" for i in range(n_keep)), "lang_pred", "score"]

    def run(batches):
        m = model.value
        for part in slices(batches, text):
            points, starts = code_points(part.column(text).to_pylist())
            score = np.repeat(m.priors[None, :].astype(float), part.num_rows, 0)
            for h, at in grams(points, starts):
                for j in range(len(m.languages)):
                    sums = np.concatenate([[0], np.cumsum(m.table[h, j], dtype=float)])
                    score[:, j] += sums[at[1:]] - sums[at[:-1]]
            best = score.argmax(1)
            p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
            letters = part.column("has_letter").to_numpy(zero_copy_only=False)
            found = pa.array(np.where(letters, np.array(m.languages, object)[best], "und"), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), found, pa.array(np.where(letters, p, 0.0))], names)

    return run


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with lang_pred and score, the posterior probability of that language.

    A text that is null, empty or has no letter gets `und` and 0.0, as does
    every text where the model has no language. Of equally likely languages the
    first by name is taken. Columns by these two names are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if not model.languages:
        return df.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    has_letter: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    columns = [F.col(c).alias(k) for c, k in names.items()]
    if text not in names:
        columns.append(F.col(text).alias("text"))
    schema = ", ".join([*(f"{k} {df.schema[c].dataType.simpleString()}" for c, k in names.items()), "lang_pred string", "score double"])
    found = df.select(*columns, has_letter.alias("has_letter")).mapInArrow(_scored(sent, names.get(text, "text"), len(keep)), schema)
    return found.select(*[F.col(k).alias(c) for c, k in names.items()], "lang_pred", "score")
