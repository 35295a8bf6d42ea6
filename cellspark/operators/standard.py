"""Entries in their standard setting: cell, symbol, change of axes and all that follows from them.

A change of axes is nine numbers, row by row: each row gives a new axis, and a
new index of a reflection, from the old ones. Changes that a system allows are
small fixed tables, chosen by a tag; triclinic cells come from the reduction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspark.functions import cell, extinction
from cellspark.operators import reduction

#: Signed changes of axes, by the order of the old axes. Fixed values.
AXES = {
    "abc": (1, 0, 0, 0, 1, 0, 0, 0, 1),
    "acb": (1, 0, 0, 0, 0, 1, 0, -1, 0),
    "bac": (0, 1, 0, -1, 0, 0, 0, 0, 1),
    "bca": (0, 1, 0, 0, 0, 1, 1, 0, 0),
    "cab": (0, 0, 1, -1, 0, 0, 0, -1, 0),
    "cba": (0, 0, -1, 0, 1, 0, 1, 0, 0),
}
#: Rhombohedral axes from hexagonal ones.
HEXAGONAL = tuple(v / 3 for v in (2, 1, 1, -1, 1, 1, -1, -2, 1))
#: Swaps a and c; turns an acute beta into an obtuse one. As columns, like cell.MONOCLINIC.
SWAP, TURN = cell.SWAP, (-1, 0, 0, 0, -1, 0, 0, 0, 1)
#: What one symbol stays, though its planes change names.
UNCHANGED = ("I b c a",)
NEW = ("na", "nb", "nc", "nalpha", "nbeta", "ngamma")


def _nine(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _transposed(m) -> tuple:
    return tuple(m[3 * j + i] for i in range(3) for j in range(3))


def orthorhombic_axes(tag: Column) -> Column:
    out = F.lit(None).cast("array<double>")
    for name, m in AXES.items():
        out = F.when(tag == name, _nine(m)).otherwise(out)
    return out


def orthorhombic_symbol(symbol: Column, tag: Column) -> Column:
    """The symbol on the new axes: elements in their order, and planes and faces named by where the old axes went."""
    parts = F.split(symbol, " ")
    out = symbol
    for name in cell.ORDERS:
        to = "".join("abc"[name.index(x)] for x in "abc")
        moved = [F.translate(F.get(parts, F.lit(1 + "abc".index(x))), "abc", to) for x in name]
        out = F.when((tag == name) & ~symbol.isin(*UNCHANGED), F.concat_ws(" ", F.translate(F.get(parts, F.lit(0)), "ABC", to.upper()), *moved)).otherwise(out)
    return F.when(F.size(parts) == 4, out)


def monoclinic_axes(kind: Column, a: Column, c: Column, beta: Column) -> Column:
    """The change to the I or P n setting, a and c in order, beta obtuse."""
    out = F.lit(None).cast("array<double>")
    for name, m in cell.MONOCLINIC.items():
        x, _, z, be = cell.monoclinic_by(m, a, F.lit(1.0), c, beta)
        swapped, acute = x > z, F.cos(be) > 0
        swap, turn = cell.times(m, SWAP), cell.times(m, TURN)
        both = cell.times(swap, TURN)
        # the swap makes a new axis of the old one's opposite, and so an acute angle of an obtuse one
        picked = F.when(~swapped, F.when(acute, _nine(_transposed(turn))).otherwise(_nine(_transposed(m)))).otherwise(F.when(acute, _nine(_transposed(swap))).otherwise(_nine(_transposed(both))))
        out = F.when(kind == name, picked).otherwise(out)
    return out


def standardise_entries(df: DataFrame, key: str) -> DataFrame:
    """df with the standard setting of each entry: na ... ngamma, new_symbol, axes, new_volume, reciprocal, new_xnn, extinction_group, extinction_code, split.

    df: a ... gamma (angstrom, radians), lattice_system and symbol (with
    blanks). Orthorhombic axes are ordered by the symbol's centring, monoclinic
    cells brought to their I or P n setting, rhombohedral ones in hexagonal axes
    to their own, triclinic ones reduced; others stay. Null where the cell, the
    symbol's setting or the system isn't known, or the cell isn't physical.
    `key` is different for each row.
    """
    a, b, c, al, be, ga = cell.columns()
    system, symbol = F.col("lattice_system"), F.col("symbol")
    keep = [x for x in df.columns if x not in (*NEW, "new_symbol", "axes", "new_volume", "reciprocal", "new_xnn", "extinction_group", "extinction_code", "split")]
    reduced = reduction.reduce_triclinic(df.where(system == "triclinic"), key)
    reduced = reduced.select(F.col(key).alias("_key"), F.array(*cell.NAMES).alias("_cell"), F.col("axes").cast("array<double>").alias("_axes"))
    rows = df.select(*keep, cell.orthorhombic_order(F.substr(symbol, F.lit(1), F.lit(1)), a, b, c).alias("_tag"), cell.monoclinic_kind(symbol).alias("_kind"))
    rows = rows.join(reduced, rows[key] == reduced["_key"], "left").drop("_key")
    right = F.lit(0.0) + cell.RIGHT
    *mono, mono_symbol = cell.standard_monoclinic(symbol, a, b, c, be)
    hexagonal = (al == cell.RIGHT) & (be == cell.RIGHT) & (ga != cell.RIGHT)
    length, angle = cell.hex_to_rhomb(a, c)
    same = F.array(a, b, c, al, be, ga)
    whole = (
        F.when(system == "orthorhombic", F.array(*cell.permuted(F.col("_tag"), [a, b, c]), right, right, right))
        .when(system == "monoclinic", F.array(mono[0], mono[1], mono[2], right, mono[3], right))
        .when((system == "rhombohedral") & hexagonal, F.array(length, length, length, angle, angle, angle))
        .when(system == "triclinic", F.col("_cell"))
        .when(system.isin("cubic", "tetragonal", "hexagonal", "rhombohedral"), same)
    )
    axes = (
        F.when(system == "orthorhombic", orthorhombic_axes(F.col("_tag")))
        .when(system == "monoclinic", monoclinic_axes(F.col("_kind"), a, c, be))
        .when((system == "rhombohedral") & hexagonal, _nine(HEXAGONAL))
        .when(system == "triclinic", F.col("_axes"))
        .when(system.isin("cubic", "tetragonal", "hexagonal", "rhombohedral"), _nine(AXES["abc"]))
    )
    new_symbol = F.when(system == "orthorhombic", orthorhombic_symbol(symbol, F.col("_tag"))).when(system == "monoclinic", mono_symbol).otherwise(symbol)
    rows = rows.select(*keep, whole.alias("_whole"), axes.alias("axes"), new_symbol.alias("new_symbol"))
    rows = rows.select(*keep, "axes", "new_symbol", *[F.get("_whole", F.lit(i)).alias(n) for i, n in enumerate(NEW)])
    new = [F.col(n) for n in NEW]
    back = cell.reciprocal(*new)
    centred = F.substr("new_symbol", F.lit(1), F.lit(1)).isin("A", "B", "C")
    direct = system.isin("tetragonal", "hexagonal")
    lengths = [F.when(direct, d).otherwise(r) for d, r in zip(new[:3], back[:3], strict=True)]
    rows = rows.select("*", cell.volume(*new).alias("new_volume"), F.array(*back).alias("reciprocal"), F.array(*cell.xnn(new)).alias("new_xnn"), F.when(new[0].isNotNull(), cell.split_label(system, F.coalesce(centred, F.lit(False)), *lengths)).cast("int").alias("split"))
    return extinction.with_extinction_group(rows, "new_symbol")


#: The first of them all with one index up to four: what reindex_ok compares.
CHECKED = sorted(((h, k, m) for h in range(-4, 5) for k in range(5) for m in range(5) if (h, k, m) != (0, 0, 0)), key=lambda v: (sum(x * x for x in v), v))[:60]


def reindex_ok(old: list[Column], new: list[Column], axes: Column) -> Column:
    """Whether the 60 first reflections have the same q2 before the change of axes and after it; null where either cell is."""
    given = F.struct(F.array(*cell.xnn(old)).alias("x"), F.array(*cell.xnn(new)).alias("y"), axes.alias("axes"))
    hkl = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in CHECKED])
    terms = lambda v: F.array(v[0] * v[0], v[1] * v[1], v[2] * v[2], v[1] * v[2], v[0] * v[2], v[0] * v[1])
    q2 = lambda v, z: F.aggregate(F.zip_with(terms(v), z, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    moved = lambda v, m: [sum((F.get(m, F.lit(3 * i + j)) * v[j] for j in range(3)), F.lit(0.0)) for i in range(3)]

    def all_same(g: Column) -> Column:  # g is made once a row, not once a reflection
        def same(r: Column) -> Column:
            v = [F.get(r, F.lit(i)) for i in range(3)]
            return cell.close(q2(v, g["x"]), q2(moved(v, g["axes"]), g["y"]))

        return F.forall(hkl, same)

    return F.when(old[0].isNotNull() & new[0].isNotNull() & axes.isNotNull(), F.get(F.transform(F.array(given), all_same), F.lit(0)))
