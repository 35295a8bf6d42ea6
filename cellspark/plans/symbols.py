"""Extinction groups of symbols that are put together from their parts, entry by entry."""

from cellspark.functions import extinction
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

#: Parts of symbols: family, centrings, and what may stand in each place.
PARTS = [
    ("monoclinic", "PCAI", ("1",), ("2", "21", "m", "a", "c", "n", "2/m", "2/a", "2/c", "2/n", "21/m", "21/a", "21/c", "21/n"), ("1",)),
    ("orthorhombic", "PCBAIF", *((("2", "21", *"mabcned"),) * 3)),
    ("tetragonal", "PI", ("4", "-4", "41", "42", "43", "4/m", "4/n", "42/m", "42/n", "41/a"), ("2", "21", *"mbcn"), ("2", *"mbcnd")),
    ("hexagonal", "P", ("3", "31", "32", "-3", "6", "61", "62", "63", "64", "65", "-6", "6/m", "63/m"), tuple("12mc"), tuple("12mc")),
    ("cubic", "PIF", ("2", "21", *"mnad"), ("3", "-3"), ("",)),
    ("cubic", "PIF", ("4", "-4", "41", "42", "43", *"mnad"), ("3", "-3"), tuple("2mncd")),
]


def _symbols(array: str, first: int, div: str) -> tuple[int, str]:
    """(how many symbols PARTS makes, SQL of the parts of the symbol number n)."""
    at, out = 0, []
    for family, *places in PARTS:
        picks, step = [], 1
        for name, values in zip(("centring", "e1", "e2", "e3"), places, strict=True):
            index = f"CAST({first} + {div.format(f'(n - {at})', step)} % {len(values)} AS INT)"
            picks.append(f"{array.format(', '.join(map(repr, values)))}[{index}] AS {name}")
            step *= len(values)
        out.append(f"SELECT entry_id, '{family}' AS family, {', '.join(picks)} FROM m WHERE n >= {at} AND n < {at + step}")
        at += step
    return at, " UNION ALL ".join(out)


TOTAL, _IN_CHECK = _symbols("[{}]", 1, "({} // {})")
_, _IN_SPARK = _symbols("array({})", 0, "({} div {})")
#: Each entry gets one of all symbols; one in seven has blanks between its parts.
_COUNTED = f"m AS (SELECT entry_id, CAST((entry_id * 37) % {TOTAL} AS INT) AS n FROM v)"
_TEXT = "CASE WHEN entry_id % 7 = 0 THEN concat_ws(' ', centring, e1, e2, e3) ELSE concat(centring, e1, e2, e3) END"


def _plane(letter: str, i: int, names: str = "abc") -> str:
    """SQL: a reflection breaks the condition of a plane across axis i."""
    x, y = [v for j, v in enumerate("hkl") if j != i]
    simple = " ".join(f"WHEN '{c}' THEN {'hkl'[names.index(c)]} % 2 <> 0" for c in "abc" if c in names)
    return f"({'hkl'[i]} = 0 AND CASE {letter} {simple} WHEN 'n' THEN ({x} + {y}) % 2 <> 0 WHEN 'e' THEN {x} % 2 <> 0 OR {y} % 2 <> 0 WHEN 'd' THEN ({x} + {y}) % 4 <> 0 OR {x} % 2 <> 0 ELSE false END)"


def _axis(i: int, n: str) -> str:
    x, y = [v for j, v in enumerate("hkl") if j != i]
    return f"({x} = 0 AND {y} = 0 AND {'hkl'[i]} % ({n}) <> 0)"


def _diagonal(letter: str, a: str, b: str, c: str) -> str:
    return f"(abs({a}) = abs({b}) AND CASE {letter} WHEN 'c' THEN {c} % 2 <> 0 WHEN 'n' THEN {c} % 2 <> 0 WHEN 'd' THEN (2 * {a} + {c}) % 4 <> 0 ELSE false END)"


_TURN = "CASE WHEN starts_with(e1, '-') THEN 1 WHEN starts_with(e1, '21') OR starts_with(e1, '42') OR starts_with(e1, '63') THEN 2 WHEN starts_with(e1, '41') OR starts_with(e1, '43') THEN 4 WHEN e1 IN ('31', '32', '62', '64') THEN 3 WHEN e1 IN ('61', '65') THEN 6 ELSE 1 END"
_L = [f"regexp_extract(e{i}, '([abcdne])$', 1)" for i in (1, 2, 3)]
_ABSENT = f"""(CASE centring WHEN 'A' THEN (k + l) % 2 <> 0 WHEN 'B' THEN (h + l) % 2 <> 0 WHEN 'C' THEN (h + k) % 2 <> 0 WHEN 'I' THEN (h + k + l) % 2 <> 0 WHEN 'F' THEN (h + k) % 2 <> 0 OR (k + l) % 2 <> 0 ELSE false END OR CASE family
WHEN 'tetragonal' THEN {_axis(2, _TURN)} OR {_plane(f"replace({_L[0]}, 'a', 'e')", 2)} OR (starts_with(e2, '21') AND ({_axis(0, "2")} OR {_axis(1, "2")})) OR {_plane(_L[1], 0)} OR {_plane(f"replace({_L[1]}, 'b', 'a')", 1)} OR {_diagonal(_L[2], "h", "k", "l")}
WHEN 'hexagonal' THEN {_axis(2, _TURN)} OR (e2 = 'c' AND l % 2 <> 0 AND (h = -k OR k = 0 OR h = 0)) OR (e3 = 'c' AND l % 2 <> 0 AND (h = k OR h = -2 * k OR k = -2 * h))
WHEN 'cubic' THEN {" OR ".join(_axis(i, _TURN) for i in range(3))} OR {_plane(_L[0], 0, "-a-")} OR {_plane(_L[0], 1, "--a")} OR {_plane(_L[0], 2, "a--")} OR {_diagonal(_L[2], "h", "k", "l")} OR {_diagonal(_L[2], "h", "l", "k")} OR {_diagonal(_L[2], "k", "l", "h")}
ELSE {" OR ".join(f"(starts_with(e{i + 1}, '21') AND {_axis(i, '2')})" for i in range(3))} OR {" OR ".join(_plane(_L[i], i) for i in range(3))} END)"""


def _element(e: str) -> str:
    return f"'{e[1] if e.startswith('(') else e}'"


#: The groups and their elements: what the symbols are matched with, by what both forbid.
_GROUPS = ", ".join(f"({g.code}, '{g.name}', '{g.symbol.family}', '{g.symbol.centring}', {', '.join(map(_element, g.symbol.elements))})" for g in extinction.all_groups() if g.symbol.centring != "R" and g.symbol.family != "triclinic")


@query(f"""{WITH["entries"]}, {_COUNTED}, s AS MATERIALIZED ({_IN_CHECK}), hkl AS (SELECT h.x AS h, k.x AS k, l.x AS l FROM (SELECT unnest(range(-2, 5)) AS x) h, (SELECT unnest(range(-2, 5)) AS x) k, (SELECT unnest(range(0, 7)) AS x) l),
g(code, name, family, centring, e1, e2, e3) AS (VALUES {_GROUPS}), kinds AS (SELECT DISTINCT family, centring, e1, e2, e3 FROM s),
sb AS (SELECT family, centring, e1, e2, e3, string_agg(CASE WHEN {_ABSENT} THEN '1' ELSE '0' END, '' ORDER BY h, k, l) AS bits FROM kinds, hkl GROUP BY ALL),
gb AS (SELECT code, name, family, centring, e1, string_agg(CASE WHEN {_ABSENT} THEN '1' ELSE '0' END, '' ORDER BY h, k, l) AS bits FROM g, hkl GROUP BY code, name, family, centring, e1),
f AS (SELECT sb.*, gb.name, gb.code, row_number() OVER (PARTITION BY sb.family, sb.centring, sb.e1, sb.e2, sb.e3 ORDER BY left(gb.e1, 1) = left(sb.e1, 1) DESC, gb.code) AS r FROM sb JOIN gb ON gb.family = sb.family AND gb.centring = sb.centring AND gb.bits = sb.bits)
SELECT s.entry_id, {_TEXT.replace("centring, e1, e2, e3", "s.centring, s.e1, s.e2, s.e3").replace("entry_id %", "s.entry_id %")} AS symbol, f.name AS extinction_group, CAST(f.code AS INT) AS extinction_code FROM s LEFT JOIN f ON f.family = s.family AND f.centring = s.centring AND f.e1 = s.e1 AND f.e2 = s.e2 AND f.e3 = s.e3 AND f.r = 1""")
def j2_with_extinction_group(spark, sf_dir):
    """Symbols are texts here, cut by the grammar; SQL has their parts, and tells groups by the reflections that both forbid."""
    v = view(spark, sf_dir, "entries")
    named = spark.sql(f"WITH v AS (SELECT * FROM {{v}}), {_COUNTED}, s AS ({_IN_SPARK}) SELECT entry_id, {_TEXT} AS symbol FROM s", v=v)
    return extinction.with_extinction_group(named).select("entry_id", "symbol", "extinction_group", "extinction_code")
