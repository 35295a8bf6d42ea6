"""URL filter: glob rules as one bit-parallel Shift-And automaton.

Each rule `host/path` becomes the glob `*.host|path*` over the canonical URL
`.host|path`, where `|` is a symbol that occurs once and in no URL. The globs
of all rules lie side by side in one row of 64-bit words; a step of the
automaton reads one byte of each URL of the batch and moves the states of all
globs at once, so that the time doesn't depend on the number of rules but by
their total length over 64.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import utf8

#: Symbols beyond the 256 bytes: between host and path, and after the end.
BAR, END = 256, 257
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class GlobAutomaton:
    """Globs of bytes, BAR, `*` (any run, also none) and `?` (one symbol), each matched against the whole string."""

    def __init__(self, globs: list[list[int | str]]):
        symbols, stay, starts, ends = [], [], [], []
        for glob in globs:
            starts.append(len(symbols))
            symbols.append(None)  # the state before the first symbol
            stay.append(False)
            for s in glob:
                if s == "*":
                    stay[-1] = True
                else:
                    symbols.append(s)
                    stay.append(False)
            ends.append(len(symbols) - 1)
        self.words = (len(symbols) + 63) // 64
        self.starts, self.stay = self._mask(starts), self._mask([i for i, x in enumerate(stay) if x])
        self.reads = np.stack([self._mask([i for i, s in enumerate(symbols) if s == c or s == "?"]) for c in range(END + 1)])
        self.reads[END] = 0
        self.ends = np.array(ends)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which globs match: bool by string and glob. symbols: a row by string, filled up with END."""
        state = np.repeat(self.starts[None, :], len(symbols), 0)
        final = np.where((lengths == 0)[:, None], state, np.uint64(0))
        for i in range(symbols.shape[1]):
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.reads[symbols[:, i]]) | (state & self.stay)
            done = lengths == i + 1
            final[done] = state[done]
        word, bit = self.ends // 64, (self.ends % 64).astype(np.uint64)
        return (final[:, word] >> bit[None, :]) & np.uint64(1) > 0


def rule_glob(rule: str) -> list[int | str]:
    host, _, path = rule.partition("/")
    return ["*", ord("."), *host.encode(), BAR, *f"/{path}".encode(), "*"]


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict of each URL.

    rules: (verdict, `host/path`). The longest fitting rule decides, of equally
    long ones a `block`; without a fitting rule the verdict is `default` and
    rule is null. A null URL, an empty one or one without `://` has an empty
    host and path and so fits no rule. Columns of df by the names host, path,
    rule or verdict are replaced; all rows stay, repeated ones too.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), rules[i][0] != "block", i))
    rules = [rules[i] for i in order]
    globs = [rule_glob(text) for _, text in rules]

    @F.pandas_udf("int")
    def first_rule(host: pd.Series, path: pd.Series) -> pd.Series:
        import pyarrow as pa

        automaton, out = GlobAutomaton(globs), np.full(len(host), -1)
        parts = [utf8(pa.array(x, pa.string())) for x in (host, path)]
        sizes = [np.diff(offsets) for _, offsets in parts]
        lengths = sizes[0] + sizes[1] + 2
        by_length = np.argsort(lengths, kind="stable")
        for rows in np.array_split(by_length, max(1, int(lengths.sum()) >> 18)):  # alike lengths, so little is filled up
            if not len(rows):
                continue
            n = lengths[rows]
            symbols = np.full((len(rows), int(n.max())), END, np.int64)
            at = np.arange(symbols.shape[1])[None, :]
            a, b = sizes[0][rows][:, None], sizes[1][rows][:, None]
            symbols[:, 0] = ord(".")
            symbols[at == a + 1] = BAR
            for mask, (data, offsets), shift in (((at >= 1) & (at <= a), parts[0], 1), ((at >= a + 2) & (at < a + 2 + b), parts[1], a + 2)):
                source = offsets[rows][:, None] + at - shift
                symbols[mask] = data[source[mask]]
            hit = automaton.match(symbols, n)
            out[rows] = np.where(hit.any(1), hit.argmax(1), -1) if hit.shape[1] else -1
        return pd.Series(out)

    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    found = df.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("_rule", first_rule("host", "path"))
    named = F.lit(None).cast("string"), F.lit(default)
    for i, (verdict, text) in enumerate(rules):
        named = F.when(F.col("_rule") == i, text).otherwise(named[0]), F.when(F.col("_rule") == i, verdict).otherwise(named[1])
    return found.select(*keep, "host", "path", named[0].alias("rule"), named[1].alias("verdict"))
