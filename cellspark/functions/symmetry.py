"""Space-group numbers, lattices and systems as small dimensions built from number ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space groups by lattice, from the International Tables: numbers of the centred ones; all others are primitive. Fixed values.
CENTRED = {
    "mC": (5, 8, 9, 12, 15),
    "oC": (20, 21, 35, 36, 37, 38, 39, 40, 41, 63, 64, 65, 66, 67, 68),
    "oF": (22, 42, 43, 69, 70),
    "oI": (23, 24, 44, 45, 46, 71, 72, 73, 74),
    "tI": (79, 80, 82, 87, 88, 97, 98, 107, 108, 109, 110, 119, 120, 121, 122, 139, 140, 141, 142),
    "hR": (146, 148, 155, 160, 161, 166, 167),
    "cF": (196, 202, 203, 209, 210, 216, 219, 225, 226, 227, 228),
    "cI": (197, 199, 204, 206, 211, 214, 217, 220, 229, 230),
}
#: (last number, letter, crystal family, crystal system). Fixed values.
RANGES = ((2, "a", "triclinic", "triclinic"), (15, "m", "monoclinic", "monoclinic"), (74, "o", "orthorhombic", "orthorhombic"), (142, "t", "tetragonal", "tetragonal"), (167, "h", "hexagonal", "trigonal"), (194, "h", "hexagonal", "hexagonal"), (230, "c", "cubic", "cubic"))
#: Lattices that go with a reported crystal system. Fixed values.
COMPATIBLE = {
    "cubic": ("cF", "cI", "cP"),
    "monoclinic": ("mC", "mP"),
    "orthorhombic": ("oC", "oF", "oI", "oP"),
    "tetragonal": ("tI", "tP"),
    "triclinic": ("aP",),
    "hexagonal": ("hR", "hP"),
    "trigonal": ("hR", "hP"),
    "rhombohedral": ("hR", "hP"),
}
SYSTEM_OF = {"a": "triclinic", "m": "monoclinic", "o": "orthorhombic", "t": "tetragonal", "hP": "hexagonal", "hR": "rhombohedral", "c": "cubic"}


def space_groups(spark: SparkSession) -> DataFrame:
    """(sg, lattice, family, crystal_system, lattice_system): 230 rows."""
    centred = {n: lattice for lattice, numbers in CENTRED.items() for n in numbers}
    rows = []
    for sg in range(1, 231):
        _, letter, family, system = next(r for r in RANGES if sg <= r[0])
        lattice = centred.get(sg, f"{letter}P")
        rows.append((sg, lattice, family, system, SYSTEM_OF.get(lattice, SYSTEM_OF.get(letter, family))))
    return spark.createDataFrame(rows, "sg int, lattice string, family string, crystal_system string, lattice_system string")


def with_symmetry(df: DataFrame, sg: str = "sg") -> DataFrame:
    """df with the lattice and systems of its space-group number; null for a number that isn't one."""
    return df.join(F.broadcast(space_groups(df.sparkSession).withColumnRenamed("sg", sg)), sg, "left")


def system_matches_lattice(system: Column, lattice: Column) -> Column:
    out = F.lit(False)
    for name, lattices in COMPATIBLE.items():
        out = F.when(system == name, lattice.isin(*lattices)).otherwise(out)
    return out
