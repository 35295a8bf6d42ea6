"""Space-group symbols in the spelling that the dimensions use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that are rewritten. Fixed values.
REWRITES = {
    "P2_1/b": "P 1 1 21/b",
    "P2_1/n": "P 1 21/n 1",
    "P2_1/m": "P 1 21/m 1",
    "Pa3": "Pa-3",
    "Fd3m": "Fd-3m",
    "P2_1/a": "P 1 21/a 1",
    "P2_1/c": "P 1 21/c 1",
    "P2_1": "P 1 21 1",
    "Fm3m": "Fm-3m",
    "Pn3": "Pn-3",
    "Pn3m": "Pn-3m",
    "B2_1": "B 2 21 2",
    "Pn3n": "P n -3 n",
    "Pm3m": "P m -3 m",
    "Pb-3": "P a -3",
    "Cc2b": "Cc2a",
    "C2ca": "C2cb",
    "Ccma": "Ccmb",
    "Bbam": "Bbcm",
    "B2ab": "B2cb",
    "Ab2a": "Ac2a",
    "Ia3": "Ia-3",
    "Ia3d": "Ia-3d",
    "Icm2": "Ibm2",
    "I2ma": "I2mb",
    "I2am": "I2cm",
    "Pm3n": "P m -3 n",
    "Pm3": "P m -3",
    "Pb3": "P b -3",
    "Fm3": "F m -3",
    "Fd3": "F d -3",
    "Fd3c": "F d -3 c",
    "Im3m": "I m -3 m",
    "Im3": "I m -3",
    "Fm3c": "F m -3 c",
}


def normalise_symbol(symbol: Column) -> Column:
    """What stands between quotes, if any do, in the standard spelling."""
    bare = F.when(symbol.contains("'"), F.regexp_extract(symbol, "'([^']*)", 1)).otherwise(symbol)
    table = F.create_map(*[F.lit(x) for pair in REWRITES.items() for x in pair])
    return F.coalesce(F.element_at(table, bare), bare)
