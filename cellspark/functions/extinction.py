"""Extinction groups of space groups, by rule: which reflections a symbol's centring, screw axes and glide planes forbid.

A symbol, with or without blanks, is cut into its centring and its symmetry
elements by the grammar of its crystal family. What they forbid on a small grid
of reflections, as bits, tells the group: that one of the family and centring
which forbids the same.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extinction groups in the order of their numbers, orthorhombic ones apart (see orthorhombic()). Fixed values.
MONOCLINIC = "P 1 - 1|P 1 21 1|P 1 a 1|P 1 21/a 1|P 1 c 1|P 1 21/c 1|P 1 n 1|P 1 21/n 1|C 1 - 1|C 1 c 1|A 1 - 1|A 1 n 1|I 1 - 1|I 1 a 1"
TETRAGONAL = "P - - -|P - 21 -|P 42 - -|P 42 21 -|P 41 - -|P 41 21 -|P - - c|P - 21 c|P - b -|P - b c|P - c -|P - c c|P - n -|P - n c|P n - -|P 42/n - -|P n - c|P n b -|P n b c|P n c -|P n c c|P n n -|P n n c|I - - -|I 41 - -|I - - d|I - c -|I - c d|I 41/a - -|I a - d|I a c d"
HEXAGONAL = "P - - -|P 31 - -|P - - c|P - c -|R (obv) - -|R (obv) - c|R (rev) - -|R (rev) - c|R - - -|R - - c|P 63 - -|P 62 - -|P 61 - -|P - c c"
CUBIC = "P - - -|P 21 - -|P 42 - -|P 41 - -|P - - n|P a - -|P n - -|P n - n|I - - -|I 41 - -|I - - d|I a - -|I a - d|F - - -|F 41 - -|F - - c|F d - -|F d - c"
FIRST = {"monoclinic": 15, "orthorhombic": 43, "tetragonal": 154, "hexagonal": 185, "cubic": 199, "triclinic": 217}
#: Planes across each axis that an orthorhombic lattice tells apart, and the screw axis that it may have. Fixed values.
PLANES = {"P": ("-bcn", "-acn", "-abn"), "C": ("-c", "-c", ("-", "(ab)")), "B": ("-b", ("-", "(ac)"), "-b"), "A": (("-", "(bc)"), "-a", "-a"), "I": (("-", "(bc)"), ("-", "(ac)"), ("-", "(ab)")), "F": ("-d", "-d", "-d")}
SCREW = {"C": "- - 21", "B": "- 21 -", "A": "21 - -"}
#: How planes of an I lattice are named where there are several. Fixed values.
SEVERAL = {"- (ac) (ab)": "- c b", "(bc) - (ab)": "c - a", "(bc) (ac) -": "b a -", "(bc) (ac) (ab)": "b c a"}

_TWO, _PLANE = "21?(?:/[macn])?", "[mabcned]"
#: Body of a symbol, by family: one group for each element. Fixed values.
GRAMMAR = {
    "triclinic": ("P", r"(-?1)"),
    "monoclinic": ("PCAI", rf"(1?)({_TWO}|[macn])(\2)"),
    "orthorhombic": ("PCBAIF", rf"(21?|{_PLANE})" * 3),
    "tetragonal": ("PI", r"(-4|4[123]?(?:/[mna])?)(?:(21?|[mbcnd])(21?|[mbcnd]))?"),
    "hexagonal": ("P", r"(-[36]|3[12]?|6[1-5]?(?:/m)?)(?:([12mc])([12mc]))?"),
    "rhombohedral": ("R", r"(-?3)(?:([2mc])())?"),
    "cubic": ("PIF", r"(21?|-4|4[123]?|[mnad])(-?3)([2mncd]?)"),
}
#: Reflections on which groups are told apart.
GRID = np.array(list(itertools.product(range(-2, 5), range(-2, 5), range(7))))


class Symbol(NamedTuple):
    family: str
    centring: str
    elements: tuple[str, str, str]


class Group(NamedTuple):
    code: int
    name: str
    symbol: Symbol


def parse(symbol: str) -> Symbol | None:
    """The family, centring and three elements of a space group's symbol; None where it is none."""
    body = re.sub(r"\s", "", symbol or "")
    for family, (centrings, pattern) in GRAMMAR.items():
        if m := re.fullmatch(f"([{centrings}]){pattern}", body):
            e = [x or "-" for x in m.groups()[1:]] + ["-", "-"]
            if family == "cubic":
                e[1] = "-"
            return Symbol("hexagonal" if family == "rhombohedral" else family, m[1], tuple(e[:3]))
    return None


def _letter(element: str) -> str:
    """The plane of an element; of a pair in brackets the first."""
    plane = element.rpartition("/")[2].lstrip("(")[:1]
    return plane if plane and plane in "abcdne" else ""


def forbidden(symbol: Symbol, hkl: np.ndarray, rhombohedral: bool = False) -> np.ndarray:
    """Which reflections the symbol forbids. rhombohedral: hkl of an R lattice are those of its primitive axes."""
    v = np.asarray(hkl, int)
    h, k, l = v.T  # noqa: E741
    family, centring, e = symbol
    even = {"A": k + l, "B": h + l, "C": h + k, "I": h + k + l}
    bad = even[centring] % 2 != 0 if centring in even else np.zeros(len(v), bool)
    if centring == "F":
        bad = ((h + k) % 2 != 0) | ((k + l) % 2 != 0)
    if centring == "R" and not rhombohedral:
        bad = (-h + k + l) % 3 != 0

    def axis(n: int, along: list[int]):
        nonlocal bad
        for i in along:
            others = [v[:, j] for j in range(3) if j != i]
            bad = bad | ((others[0] == 0) & (others[1] == 0) & (v[:, i] % n != 0))

    def plane(letter: str, i: int, name: str = "abc"):
        nonlocal bad
        if not letter:
            return
        zone, (x, y) = v[:, i] == 0, [v[:, j] for j in range(3) if j != i]
        if letter in name:
            off = v[:, name.index(letter)] % 2 != 0
        else:
            off = {"n": (x + y) % 2 != 0, "e": (x % 2 != 0) | (y % 2 != 0), "d": ((x + y) % 4 != 0) | (x % 2 != 0)}[letter]
        bad = bad | (zone & off)

    screw = re.match(r"-?([2346][1-5]?)", e[0])
    turn = {"21": 2, "42": 2, "41": 4, "43": 4, "31": 3, "32": 3, "62": 3, "64": 3, "61": 6, "65": 6, "63": 2}.get(screw[1], 1) if screw and not e[0].startswith("-") else 1
    if family in ("monoclinic", "orthorhombic"):
        for i in range(3):
            if e[i].startswith("21"):
                axis(2, [i])
            plane(_letter(e[i]), i)
    elif family == "tetragonal":
        axis(turn, [2])
        if _letter(e[0]):
            plane("e" if _letter(e[0]) == "a" else _letter(e[0]), 2)
        if e[1].startswith("21"):
            axis(2, [0, 1])
        if _letter(e[1]):
            plane(_letter(e[1]), 0)
            plane({"b": "a"}.get(_letter(e[1]), _letter(e[1])), 1)
        diagonal = np.abs(h) == np.abs(k)
        off = {"c": l % 2 != 0, "n": l % 2 != 0, "d": (2 * h + l) % 4 != 0}.get(_letter(e[2]))
        bad = bad if off is None else bad | (diagonal & off)
    elif family == "hexagonal" and rhombohedral:
        third = np.select([h == k, k == l, h == l], [l, h, k], 0)
        bad = bad | ((third % 2 != 0) & ("c" in e[1:]))
    elif family == "hexagonal":
        axis(turn, [2])
        zones = ((h == -k) | (k == 0) | (h == 0), (h == k) | (h == -2 * k) | (k == -2 * h))
        if centring == "R":
            bad = bad | (zones[0] & (l % 2 != 0) & ("c" in e[1:]))
        else:
            for zone, x in zip(zones, e[1:], strict=True):
                bad = bad | (zone & (l % 2 != 0) & (x == "c"))
    elif family == "cubic":
        axis(turn, [0, 1, 2])
        if _letter(e[0]):
            for i in range(3):  # 0kl: k; h0l: l; hk0: h
                plane(_letter(e[0]), i, {0: "-a-", 1: "--a", 2: "a--"}[i])
        size = np.abs(v)
        off = {"c": 1, "n": 1, "d": 2}.get(_letter(e[2]), 0)
        for i in range(3):
            j, m = [x for x in range(3) if x != i]
            odd = v[:, i] % 2 != 0 if off == 1 else (2 * v[:, j] + v[:, i]) % 4 != 0
            bad = bad | ((size[:, j] == size[:, m]) & odd & (off > 0))
    return bad


def _orthorhombic() -> list[str]:
    names = []
    for centring, planes in PLANES.items():
        each = [" ".join(p) for p in itertools.product(*planes)]
        if centring == "P":
            each = [" ".join(s) for s in itertools.product(("-", "21"), repeat=3)] + each[1:]
        elif centring == "F":
            each = [p for p in each if p.count("d") != 1]
        elif centring in SCREW:
            each.insert(1, SCREW[centring])
        names += [f"{centring} {SEVERAL.get(p, p) if centring == 'I' else p}" for p in each]
    return names


@lru_cache(maxsize=1)
def all_groups() -> tuple[Group, ...]:
    """Every extinction group with its number."""
    out = []
    for family, names in (("monoclinic", MONOCLINIC.split("|")), ("orthorhombic", _orthorhombic()), ("tetragonal", TETRAGONAL.split("|")), ("hexagonal", HEXAGONAL.split("|")), ("cubic", CUBIC.split("|")), ("triclinic", ["P -"])):
        for i, name in enumerate(names):
            centring, *e = name.replace("(obv) ", "").replace("(rev) ", "").split()
            if centring == "R" and len(e) == 2:
                e = [e[0], e[1], "-"]
            out.append(Group(FIRST[family] + i, name, Symbol(family, centring, tuple([*e, "-", "-"][:3]))))
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def _bits(symbol: Symbol) -> bytes:
    return np.packbits(forbidden(symbol, GRID)).tobytes()


@lru_cache(maxsize=1 << 14)
def group_of(symbol: str) -> Group | None:
    """The extinction group of a space group's symbol; None where it is no symbol, or its family has no such group."""
    own = parse(symbol)
    if own is None:
        return None
    alike = [g for g in all_groups() if g.symbol[:2] == own[:2] and _bits(g.symbol) == _bits(own)]
    # of groups that forbid the same, that of the same kind of axis
    return min(alike, key=lambda g: (g.symbol.elements[0][:1] != own.elements[0][:1], g.code), default=None)


def symbols() -> list[str]:
    """Every symbol of the grammar, without blanks, that has a group."""
    twos = ["2", "21", *(f"{t}/{p}" for t in ("2", "21") for p in "macn"), *"macn"]
    fours, planes = ["-4", *(f"4{i}{p}" for i in ("", "1", "2", "3") for p in ("", "/m", "/n", "/a"))], ["2", "21", *"mbcnd"]
    sixes = ["3", "31", "32", "-3", "6", "-6", "6/m", "63/m", *(f"6{i}" for i in range(1, 6))]
    two = lambda heads, x: [[a, *b] for a in heads for b in [(), *itertools.product(x, repeat=2)]]
    bodies = {
        "P": [["1"], ["-1"], *two(sixes, "12mc")],
        "R": [[a, b] for a in ("3", "-3") for b in ("", *"2mc")],
        "PCAI": [[a, x, a] for a in ("", "1") for x in twos],
        "PCBAIF": [list(x) for x in itertools.product(["2", "21", *"mabcned"], repeat=3)],
        "PI": two(fours, planes),
        "PIF": [list(x) for x in itertools.product(["2", "21", "-4", "4", "41", "42", "43", *"mnad"], ["3", "-3"], ["", *"2mncd"])],
    }
    every = {c + "".join(b) for letters, each in bodies.items() for c in letters for b in each}
    return sorted(s for s in every if group_of(s))


def dimension(spark: SparkSession) -> DataFrame:
    """(symbol without blanks, extinction_group, extinction_code): a small table of some thousand rows, made by rule."""
    rows = [(s, g.name, g.code) for s in symbols() if (g := group_of(s))]
    return spark.createDataFrame(rows, "_symbol string, extinction_group string, extinction_code int")


def with_extinction_group(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """df with the extinction_group and extinction_code of its space group symbols, written with or without blanks; null for what is no symbol. Columns of these names are replaced."""
    given = df.drop("extinction_group", "extinction_code").withColumn("_symbol", compact(F.col(symbol)))
    return given.join(F.broadcast(dimension(df.sparkSession)), "_symbol", "left").drop("_symbol")


def compact(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"\s", "")


FAMILY = {"a": "triclinic", "m": "monoclinic", "o": "orthorhombic", "t": "tetragonal", "h": "hexagonal", "c": "cubic"}


def groups(lattice: str) -> list[Group]:
    """Extinction groups of a lattice, the one without further extinctions first; of groups that forbid the same the first."""
    family, centring = FAMILY[lattice[0]], "I" if lattice == "mC" else lattice[1]
    one = {}
    for g in all_groups():
        if g.symbol[:2] == (family, centring) and not g.name.startswith("R ("):
            one.setdefault(np.packbits(forbidden(g.symbol, GRID, lattice == "hR")).tobytes(), g)
    return list(one.values())


def allowed(group: Group, hkl: np.ndarray, lattice: str = "") -> np.ndarray:
    """Which of the reflections (rows of h, k, l) the group leaves."""
    return ~forbidden(group.symbol, hkl, lattice == "hR")
