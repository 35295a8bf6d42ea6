"""Chemical formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element symbols. Fixed values.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
)


def _moiety(m: Column) -> Column:
    """struct<times, body> of one moiety: `body`, `(body)n`, `2(body)`, `2(body)n`, `(body)2n`, `n(body)`, `n2(body)`, `2n(body)`, likewise with x, y, z."""
    front = F.regexp_extract(m, r"^\s*(?:[nxyz])?([0-9.]*)[nxyz]?\(", 1)
    back = F.regexp_extract(m, r"\)([0-9.]*)n?\s*$", 1)
    inner = F.regexp_extract(m, r"\(([^)]*)\)", 1)
    times = F.when(front != "", front.cast("double")).when(back != "", back.cast("double")).otherwise(F.lit(1.0))
    grouped = m.rlike(r"\(")
    return F.struct(F.when(grouped, times).otherwise(F.lit(1.0)).alias("times"), F.when(grouped, inner).otherwise(m).alias("body"))


def once(value: Column, use) -> Column:
    """use(value), with value made once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_formula(formula: Column) -> Column:
    """map<string, double> from element to count, by element.

    Moieties are split at commas and summed. A part with + or - is a charge and
    is skipped; D counts as H; unknown elements are dropped; of an element that
    a moiety has twice the last counts.
    """
    pair = "struct<element:string,n:double>"
    symbols = F.array(*map(F.lit, ELEMENTS.split()))

    def atom(m: Column, t: Column) -> Column:
        return F.struct(
            F.regexp_replace(F.regexp_extract(t, "^([^0-9]*)", 1), "^D$", "H").alias("element"),
            (m["times"] * F.when(t.rlike("[0-9]"), F.regexp_extract(t, "^[^0-9]*([0-9.]+)", 1).cast("double")).otherwise(F.lit(1.0))).alias("n"),
        )

    def last(known: Column) -> Column:
        return F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda q: q["element"] == p["element"]))

    def parts(moiety: Column) -> Column:
        each = lambda m: F.transform(F.filter(F.split(m["body"], " "), lambda t: (t != "") & ~t.rlike("[+-]")), lambda t: atom(m, t))
        known = F.filter(once(once(F.trim(moiety), _moiety), each), lambda p: F.array_contains(symbols, p["element"]))
        return once(known, last)

    def summed(everything: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(everything, lambda p: p["element"])))
        return F.map_from_entries(F.transform(names, lambda e: F.struct(e, F.aggregate(F.filter(everything, lambda p: p["element"] == e), F.lit(0.0), lambda s, p: s + p["n"]))))

    return once(F.flatten(F.transform(F.split(formula, ","), parts)).cast(f"array<{pair}>"), summed)


def n_atoms(composition: Column) -> Column:
    return F.aggregate(F.map_values(composition), F.lit(0.0), lambda s, n: s + n)


def composition_keys(composition: Column) -> tuple[Column, Column]:
    """(key, strict key): rounded counts without zeros, halved while all are even, as `El n` parts; strict without H and elements up to 5 % of the rest."""
    rounded = F.filter(F.transform(F.array_sort(F.map_entries(composition)), lambda p: F.struct(p["key"].alias("e"), F.bround(p["value"]).cast("long").alias("n"))), lambda p: p["n"] > 0)

    def halved(counts: Column) -> Column:
        # The largest power of two that divides all is the least of those that divide one: halving while every count is even.
        lowest = F.array_min(F.transform(counts, lambda p: p["n"].bitwiseAND(-p["n"])))
        return once(F.least(lowest, F.lit(1 << 40)), lambda d: F.transform(counts, lambda p: F.struct(p["e"].alias("e"), (p["n"] / d).cast("long").alias("n"))))

    def keys(counts: Column) -> Column:
        rest = F.filter(counts, lambda p: p["e"] != "H")
        text = lambda p: F.concat(p["e"], p["n"].cast("string"))
        total = F.aggregate(rest, F.lit(0).cast("long"), lambda s, p: s + p["n"])
        strict = once(total, lambda t: F.filter(rest, lambda p: p["n"] / t > 0.05))
        return F.struct(F.array_join(F.transform(counts, text), " ").alias("key"), F.array_join(F.transform(strict, lambda p: F.concat(text(p), F.lit(" "))), "").alias("strict"))

    both = once(once(rounded, halved), keys)
    return both["key"], both["strict"]
