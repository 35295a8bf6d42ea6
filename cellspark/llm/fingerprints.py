"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A text's shingles are its runs of WIDTH consecutive words, its ends padded with
WIDTH - 1 empty words, so that short texts have shingles too. Each is hashed
(the first 64 bits of MD5, 16 hexadecimal digits); the sketch holds every hash
below a fixed share of all values, one in `scale`, and at least the least one.
The share doesn't depend on the text, so sketches of any two texts, however
unequal in length, hold the same part of what the texts share: their common
hashes estimate containment as well as resemblance, and a union of sketches is
the sketch of the union.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SALTS

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shingle; one hash in SCALE is retained.
WIDTH, SCALE = 5, 8
#: Ranges of rows for each shuffle partition, when rows are put in order.
RANGES = 4


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashes(text: Column, width: int = WIDTH) -> Column:
    """array<string>: the hash of each shingle in order; empty for a text that is null or without a word."""
    ends = F.array_repeat(F.lit(""), width - 1)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def shingles(padded: Column) -> Column:
        one = lambda x, i: F.substr(F.md5(F.concat_ws(" ", x, *(F.get(padded, i + k) for k in range(1, width))).cast("binary")), F.lit(1), F.lit(16))
        return F.when(F.size(padded) > 2 * (width - 1), F.transform(F.slice(padded, 1, F.size(padded) - (width - 1)), one)).otherwise(F.array().cast("array<string>"))

    return bound(F.concat(ends, words, ends), shingles)


def limit(scale: int) -> str:
    """The hash that retained ones are below."""
    return f"{(1 << 64) // scale:016x}" if scale > 1 else "g"


def sketch(text: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """The retained hashes of a text, each once, in order; empty for a text that is null or without a word."""
    least = lambda h: F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)
    return bound(hashes(text, width), lambda h: bound(F.filter(h, lambda x: x < limit(scale)), lambda few: F.when(F.size(few) > 0, F.array_sort(F.array_distinct(few))).otherwise(least(h))))


def fingerprint(held: Column) -> Column:
    """A sketch as a string."""
    return F.array_join(held, "")


def resemblance(a: Column, b: Column) -> Column:
    """Estimate, from two sketches, of |A and B| / |A or B|: 0 to 1, and 1 where both are empty."""
    both = lambda x: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(x / (F.size(a) + F.size(b) - x))
    return bound(F.size(F.array_intersect(a, b)), both)


def containment(a: Column, b: Column) -> Column:
    """Estimate, from two sketches, of the share of A that is in B: 0 to 1, and 1 where A is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(df: DataFrame, group: str, held: str) -> DataFrame:
    """(group, hash): the sketch of all texts of each group, one row a hash.

    A group may hold most rows: its hashes are dealt out by hash, after each
    task has made its own distinct. A null group is a group; empty sketches add nothing.
    """
    rows = df.select(F.col(group).alias("group"), F.explode(held).alias("hash"))
    return rows.dropDuplicates(["group", "hash"])


def containments(a: DataFrame, b: DataFrame) -> DataFrame:
    """(group, other, share): what share of each merged sketch of a stands in each of b that it shares a hash with.

    A hash that very many groups hold is dealt out to SALTS tasks.
    """
    size = a.groupBy("group").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("group"), F.lit(SALTS)).cast("int")
    many = b.select(F.col("group").alias("other"), "hash").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = a.withColumn("_salt", salt).join(many, ["hash", "_salt"]).groupBy("group", "other").agg(F.count("*").alias("common"))
    return met.join(size, met["group"].eqNullSafe(size["group"])).select(met["group"], "other", (F.col("common") / F.col("n")).alias("share"))


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most value, by halving."""
    if not cuts:
        return F.lit(0)
    each = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded to one constant
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    fits = lambda at, step: F.coalesce(F.get(each, at + step - 1) <= value, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(fits(at, step), step).otherwise(F.lit(0)))


def followed(df: DataFrame, row: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """df with next_c for each of the columns c: that of the row that comes next in descending order of `row`; after the last comes the first.

    `row` is a long, different for each row (see numbered in shared.py). The rows
    are dealt into ranges of about equal numbers, RANGES for each shuffle
    partition unless told; each range is ordered on its own, with a copy of the
    row that follows it. So df is shuffled once, and only the ends of the
    ranges, one number each, reach the driver.
    """
    spark, names = df.sparkSession, {"_range", "_copy", "_tail"} & set(df.columns)
    if names:
        raise ValueError(f"columns of these names: {sorted(names)}")
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(row, [k / ranges for k in range(1, ranges)] or [0.5], max(10_000, 4 * ranges)).alias("cuts")).first()["cuts"] or []
    own = _range_of(F.col(row), sorted(set(cuts)))
    tops = sorted(map(tuple, df.select(own.alias("range"), row).groupBy("range").agg(F.max(row)).collect()))
    copies = [(tops[k - 1][1], tops[k][0]) for k in range(len(tops))]
    copies = spark.createDataFrame(copies, f"`{row}` long, _copy int")
    place = lambda r, tail: F.struct(r.alias("_range"), F.lit(tail).alias("_tail"))
    both = df.join(F.broadcast(copies), row, "left")
    dealt = F.when(F.col("_copy").isNull(), F.array(place(own, 0))).otherwise(F.array(place(own, 0), place(F.col("_copy"), 1)))
    dealt = both.select(*df.columns, F.explode(dealt).alias("_place")).select(*df.columns, "_place.*")
    order = Window.partitionBy("_range").orderBy("_tail", F.desc(row))
    found = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return found.where("_tail = 0").drop("_range", "_tail")


def edited(text: Column, other: Column) -> Column:
    """The text whose last third, floor(length / 3) code points, gives place to the first as many (or all) of the other."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(other, F.lit(1), third))


def fingerprint_documents(df: DataFrame, key: str = "_row", text: str = "text", scale: int = SCALE, ranges: int | None = None) -> DataFrame:
    """df with, for each text (null counts as empty): held, its sketch; edited, the text edited by the next one; edited_held, the sketch of that; next_held, the sketch of the next text.

    The next text is that of the next smaller `key`, a long different for each
    row; after the least comes the greatest, so a single row is its own next.
    Texts without a word have an empty sketch, which resembles none but another
    empty one. Equal texts have equal sketches; a copy's likeness is 1. Very
    long texts are handled whole. An empty table gives no rows; columns of df
    named as the new ones are replaced.
    """
    fresh = ("held", "next_held", "edited", "edited_held", f"next_{text}", "_text", "next__text")
    keep = [c for c in df.columns if c not in fresh]
    whole = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("held", sketch(F.col("_text"), scale))
    both = followed(whole, key, ["_text", "held"], ranges).withColumn("edited", edited(F.col("_text"), F.col("next__text")))
    return both.withColumn("edited_held", sketch(F.col("edited"), scale)).select(*keep, "held", "next_held", "edited", "edited_held")
