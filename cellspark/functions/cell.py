"""Unit cells as column expressions: lengths in angstrom, angles in radians. Non-physical geometry is null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS, ANGLES = ("a", "b", "c"), ("alpha", "beta", "gamma")
NAMES = LENGTHS + ANGLES
RIGHT, THIRD = math.pi / 2, 2 * math.pi / 3

#: Columns of a lattice system's free parameters, of the six of a cell.
FREE = {"cubic": [0], "tetragonal": [0, 2], "hexagonal": [0, 2], "rhombohedral": [0, 3], "orthorhombic": [0, 1, 2], "monoclinic": [0, 1, 2, 4], "triclinic": [0, 1, 2, 3, 4, 5]}
#: Where each of the six comes from in a partial cell: an index, or a fixed angle.
FULL = {
    "cubic": [0, 0, 0, RIGHT, RIGHT, RIGHT],
    "tetragonal": [0, 0, 1, RIGHT, RIGHT, RIGHT],
    "hexagonal": [0, 0, 1, RIGHT, RIGHT, THIRD],
    "rhombohedral": [0, 0, 0, 1, 1, 1],
    "orthorhombic": [0, 1, 2, RIGHT, RIGHT, RIGHT],
    "monoclinic": [0, 1, 2, RIGHT, 3, RIGHT],
    "triclinic": [0, 1, 2, 3, 4, 5],
}
SYSTEMS = tuple(FREE)


def columns(cell: str | None = None) -> list[Column]:
    return [F.col(n if cell is None else f"{cell}.{n}") for n in NAMES]


def by_system(system: Column, of) -> Column:
    """of(name) of the row's lattice system; null for another."""
    out = F.lit(None)
    for name in SYSTEMS:
        out = F.when(system == name, of(name)).otherwise(out)
    return out


def volume(a, b, c, al, be, ga) -> Column:
    root = 1 - F.pow(F.cos(al), 2) - F.pow(F.cos(be), 2) - F.pow(F.cos(ga), 2) + 2 * F.cos(al) * F.cos(be) * F.cos(ga)
    return F.when(root > 0, a * b * c * F.sqrt(root))


def close(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(x - y) <= atol + rtol * F.abs(y)


def reciprocal(a, b, c, al, be, ga) -> list[Column]:
    """Lengths and angles of the reciprocal cell."""
    v = volume(a, b, c, al, be, ga)
    out = [b * c * F.sin(al) / v, a * c * F.sin(be) / v, a * b * F.sin(ga) / v]
    for x, y, z in ((al, be, ga), (be, al, ga), (ga, al, be)):
        cosine = (F.cos(y) * F.cos(z) - F.cos(x)) / (F.sin(y) * F.sin(z))
        out.append(F.when(v.isNotNull() & (F.abs(cosine) <= 1), F.acos(cosine)))
    return out


def xnn(cell: list[Column]) -> list[Column]:
    """Coefficients of q2 = x0 h2 + x1 k2 + x2 l2 + x3 kl + x4 hl + x5 hk. Cross terms of right reciprocal angles are exactly 0."""
    a, b, c, *angles = reciprocal(*cell)
    cross = [2 * b * c, 2 * a * c, 2 * a * b]
    al, be, ga = (t == RIGHT for t in cell[3:])
    right = [al & (be | ga), be & (al | ga), ga & (al | be)]
    return [a * a, b * b, c * c] + [F.when(r & a.isNotNull(), 0.0).otherwise(x * F.cos(t)) for r, x, t in zip(right, cross, angles, strict=True)]


def cell_of_xnn(x: list[Column]) -> list[Column]:
    """The direct cell of six coefficients."""
    fine = (x[0] > 0) & (x[1] > 0) & (x[2] > 0)
    a, b, c = (F.when(fine, F.sqrt(v)) for v in x[:3])
    angles = []
    for v, p, q in ((x[3], b, c), (x[4], a, c), (x[5], a, b)):
        cosine = v / (2 * p * q)
        angles.append(F.when(F.abs(cosine) < 1, F.acos(cosine)))
    return reciprocal(a, b, c, *angles)


def volume_of_xnn(values: Column, system: str) -> Column:
    """The volume of the direct cell of an array of a system's free coefficients; null where they make no cell."""
    x = [F.get(values, F.lit(i)) for i in range(len(FREE[system]))]
    zero = F.lit(0.0)
    whole = {
        "cubic": [x[0]] * 3 + [zero] * 3,
        "tetragonal": [x[0], x[0], x[-1], zero, zero, zero],
        "hexagonal": [x[0], x[0], x[-1], zero, zero, x[0]],
        "rhombohedral": [x[0]] * 3 + [x[-1]] * 3,
        "orthorhombic": [*x, zero, zero, zero][:6],
        "monoclinic": [*x[:3], zero, x[-1], zero],
        "triclinic": x,
    }[system]
    a, b, c, d, e, f = whole
    square = a * b * c + d * e * f / 4 - (a * d * d + b * e * e + c * f * f) / 4
    return F.when(square > 0, 1 / F.sqrt(square))


def partial(system: Column, values: list[Column]) -> Column:
    return by_system(system, lambda s: F.array(*[values[i] for i in FREE[s]]))


def full(system: Column, values: Column) -> Column:
    """All six parameters of a partial cell. The fixed 120 degrees of hexagonal cells are gamma."""
    return by_system(system, lambda s: F.array(*[F.get(values, F.lit(p)) if isinstance(p, int) else F.lit(p) for p in FULL[s]]))


def hkl_terms(h: Column, k: Column, l: Column, system: Column) -> Column:  # noqa: E741
    """What multiplies the free coefficients of each system."""
    terms = {
        "cubic": [h * h + k * k + l * l],
        "tetragonal": [h * h + k * k, l * l],
        "hexagonal": [h * h + h * k + k * k, l * l],
        "rhombohedral": [h * h + k * k + l * l, h * k + h * l + k * l],
        "orthorhombic": [h * h, k * k, l * l],
        "monoclinic": [h * h, k * k, l * l, h * l],
        "triclinic": [h * h, k * k, l * l, k * l, h * l, h * k],
    }
    return by_system(system, lambda s: F.array(*terms[s]))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def q2_direct(h, k, l, cell: list[Column]) -> Column:  # noqa: E741
    """q2 = 1/d2 of a reflection, from the direct cell."""
    x = xnn(cell)
    return x[0] * h * h + x[1] * k * k + x[2] * l * l + x[3] * k * l + x[4] * h * l + x[5] * h * k


def matches_lattice(lattice: Column, a, b, c, al, be, ga) -> Column:
    """Exact equality tests of angles (in degrees, so that they stay exact) and lengths."""
    square = (al == 90) & (be == 90) & (ga == 90)
    hexagonal = (a == b) & (b != c) & (al == 90) & (be == 90) & (ga == 120)
    test = F.lit(False)
    for names, rule in (
        (("cF", "cI", "cP"), square & (a == b) & (b == c)),
        (("tI", "tP"), square & ((a == b) | (a == c) | (b == c))),
        (("oC", "oF", "oI", "oP"), square),
        (("hR",), ((a == b) & (b == c) & (al == be) & (be == ga)) | hexagonal),
        (("hP",), hexagonal),
        (("mC", "mP"), (al == 90) & (ga == 90) & (be != 90)),
        (("aP",), F.lit(True)),
    ):
        test = F.when(lattice.isin(*names), rule).otherwise(test)
    return test


def hex_to_rhomb(a: Column, c: Column) -> tuple[Column, Column]:
    """(length, angle) of the rhombohedral cell of a hexagonal setting."""
    ratio = c / a
    return F.sqrt(3 * a * a + c * c) / 3, 2 * F.asin(3 / (2 * F.sqrt(3 + ratio * ratio)))


def hkl_hex_to_rhomb(h: Column, k: Column, l: Column) -> list[Column]:  # noqa: E741
    return [F.round((2 * h + k + l) / 3).cast("int"), F.round((-h + k + l) / 3).cast("int"), F.round((-h - 2 * k + l) / 3).cast("int")]


def split_label(system: Column, centred: Column, a: Column, b: Column, c: Column) -> Column:
    """Axis-order class from the direct lengths a, c (tetragonal, hexagonal) or the reciprocal ones (others).

    Tetragonal and hexagonal: 0 for a < c, else 1. Monoclinic: the order of
    a*, b*, c*, 0 to 5. Orthorhombic: 0 unless centred on a face, else the
    place of c*. All others 0.
    """
    mono = F.when(a >= b, F.when(b >= c, 0).when(a >= c, 1).otherwise(2)).otherwise(F.when(b <= c, 3).when(a >= c, 4).otherwise(5))
    ortho = F.when(~centred, 0).when(a <= c, F.when(b <= c, 0).otherwise(1)).otherwise(2)
    return F.when(system.isin("tetragonal", "hexagonal"), F.when(a < c, 0).otherwise(1)).when(system == "monoclinic", mono).when(system == "orthorhombic", ortho).otherwise(0)


#: Letters of the axes that come first, second and third.
ORDERS = ("abc", "acb", "bac", "bca", "cab", "cba")


def orthorhombic_order(centring: Column, a: Column, b: Column, c: Column) -> Column:
    """The axes in standard order: by length (P, I, F), or with the centred face on ab and the shorter first."""
    s = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (v, n) in enumerate(((a, "a"), (b, "b"), (c, "c")))]))
    sorted_ = F.array_join(F.transform(s, lambda x: x["n"]), "")
    return (
        F.when(centring.isin("P", "I", "F"), sorted_)
        .when(centring == "C", F.when(a <= b, "abc").otherwise("bac"))
        .when(centring == "B", F.when(a <= c, "acb").otherwise("cab"))
        .when(centring == "A", F.when(c <= b, "cba").otherwise("bca"))
    )


def permuted(order: Column, values: list[Column]) -> list[Column]:
    """The values (of a, b, c) in the order of the tag."""
    def pick(i: int) -> Column:
        axis = F.substring(order, i, 1)
        return F.when(axis == "a", values[0]).when(axis == "b", values[1]).when(axis == "c", values[2])

    return [pick(i) for i in (1, 2, 3)]


#: 3x3 matrices (rows) that bring monoclinic settings to I or P n. Fixed values.
MONOCLINIC = {
    "same": (1, 0, 0, 0, 1, 0, 0, 0, 1),
    "A": (-1, 0, 1, 0, 1, 0, -1, 0, 0),
    "C": (0, 0, -1, 0, 1, 0, 1, 0, -1),
    "Ic": (0, 0, 1, 0, 1, 0, -1, 0, 0),
    "Pa": (1, 0, 1, 0, 1, 0, 0, 0, 1),
    "Pc": (1, 0, -1, 0, 1, 0, 1, 0, 0),
}
#: The five choices of a and c of a monoclinic cell, each also with a and c swapped. Fixed values.
SETTINGS = ((1, 0, 0, 0, 1, 0, 0, 0, 1), (-1, 0, 1, 0, 1, 0, -1, 0, 0), (0, 0, -1, 0, 1, 0, 1, 0, -1), (1, 0, 0, 0, 1, 0, -1, 0, 1), (1, 0, 0, 0, 1, 0, 1, 0, 1))
SWAP = (0, 0, 1, 0, 1, 0, -1, 0, 0)


def times(m, n) -> tuple:
    return tuple(sum(m[3 * i + k] * n[3 * k + j] for k in range(3)) for i in range(3) for j in range(3))


def monoclinic_by(m, a: Column, b: Column, c: Column, beta: Column) -> list[Column]:
    """(a, b, c, beta) after the axes change by the matrix, which mixes a and c only."""
    dot_ = a * c * F.cos(beta)
    first = [m[0], m[6]]
    third = [m[2], m[8]]
    norm = lambda v: F.sqrt(v[0] * v[0] * a * a + v[1] * v[1] * c * c + 2 * v[0] * v[1] * dot_)
    x, z = norm(first), norm(third)
    inner = first[0] * third[0] * a * a + first[1] * third[1] * c * c + (first[0] * third[1] + first[1] * third[0]) * dot_
    return [x, abs(m[4]) * b, z, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner / (x * z))))]


def monoclinic_kind(symbol: Column) -> Column:
    """Which of MONOCLINIC applies; null for settings that none brings to I or P n."""
    return (
        F.when(symbol.rlike("^(P 1 (2|m|2/m|21|21/m|n|2/n|21/n) 1|I 1 (2|m|a|2/m|2/a) 1)$"), "same")
        .when(symbol.rlike("^A 1 (2|m|a|2/m|2/a) 1$"), "A")
        .when(symbol.rlike("^C 1 (2|m|c|2/m|2/c) 1$"), "C")
        .when(symbol.rlike("^I 1 (2/c|c) 1$"), "Ic")
        .when(symbol.rlike("^P 1 (a|2/a|21/a) 1$"), "Pa")
        .when(symbol.rlike("^P 1 (c|2/c|21/c) 1$"), "Pc")
    )


def monoclinic_symbol(symbol: Column, kind: Column) -> Column:
    return (
        F.when(kind == "same", symbol)
        .when(kind == "A", F.translate(symbol, "A", "I"))
        .when(kind == "C", F.translate(symbol, "Cc", "Ia"))
        .when(kind == "Ic", F.translate(symbol, "c", "a"))
        .when(kind == "Pa", F.translate(symbol, "a", "n"))
        .when(kind == "Pc", F.translate(symbol, "c", "n"))
    )


def standard_monoclinic(symbol: Column, a, b, c, beta, space: str = "direct") -> list[Column]:
    """(a, b, c, beta, symbol) in the I or P n setting, a and c in order and beta obtuse (in reciprocal space: reversed and acute)."""
    kind = monoclinic_kind(symbol)
    moved = {name: monoclinic_by(m, a, b, c, beta) for name, m in MONOCLINIC.items()}
    pick = lambda i: F.coalesce(*[F.when(kind == name, values[i]) for name, values in moved.items()])
    return [*order_monoclinic(*[pick(i) for i in range(4)], space), monoclinic_symbol(symbol, kind)]


def order_monoclinic(a, b, c, beta, space: str = "direct") -> list[Column]:
    low, high = F.least(a, c), F.greatest(a, c)
    acute, obtuse = F.least(beta, math.pi - beta), F.greatest(beta, math.pi - beta)
    return [low, b, high, obtuse] if space == "direct" else [high, b, low, acute]


def monoclinic_settings(a, b, c, beta) -> Column:
    """array of the ten equivalent settings: struct<setting, a, b, c, beta>."""
    out = []
    for m in SETTINGS:
        for p in (MONOCLINIC["same"], SWAP):
            values = monoclinic_by(times(p, m), a, b, c, beta)
            out.append(F.struct(F.lit(len(out)).alias("setting"), *[v.alias(n) for v, n in zip(values, ("a", "b", "c", "beta"), strict=True)]))
    return F.array(*out)


def reorder(system: Column, lattice: Column, values: Column, space: str = "direct") -> Column:
    """Partial cells in quick standard order: orthorhombic by length (oC: a and b only), monoclinic a, c and beta."""
    at = lambda i: F.get(values, F.lit(i))
    up = space == "direct"
    pair = F.sort_array(F.slice(values, 1, 2), asc=up)
    ortho = F.when(lattice == "oC", F.concat(pair, F.slice(values, 3, 1))).otherwise(F.sort_array(values, asc=up))
    return F.when(system == "orthorhombic", ortho).when(system == "monoclinic", F.array(*order_monoclinic(at(0), at(1), at(2), at(3), space))).otherwise(values)
