"""One spelling for joins: types, pair order, predicates."""

from __future__ import annotations

import re
from itertools import combinations, product

from pyspark.sql import Column
from pyspark.sql import functions as F

# What spellings of a join type stand for, and what a type becomes when its sides change places.
TYPES = {
    "": "INNER", "INNER": "INNER", "CROSS": "CROSS",
    "LEFT": "LEFT OUTER", "LEFT OUTER": "LEFT OUTER", "LEFTOUTER": "LEFT OUTER",
    "RIGHT": "RIGHT OUTER", "RIGHT OUTER": "RIGHT OUTER", "RIGHTOUTER": "RIGHT OUTER",
    "OUTER": "FULL OUTER", "FULL": "FULL OUTER", "FULL OUTER": "FULL OUTER", "FULLOUTER": "FULL OUTER",
    "SEMI": "LEFT SEMI", "LEFT SEMI": "LEFT SEMI", "LEFTSEMI": "LEFT SEMI", "RIGHT SEMI": "RIGHT SEMI",
    "ANTI": "LEFT ANTI", "LEFT ANTI": "LEFT ANTI", "LEFTANTI": "LEFT ANTI", "RIGHT ANTI": "RIGHT ANTI",
}
MIRROR = {f"{a} {k}": f"{b} {k}" for a, b in (("LEFT", "RIGHT"), ("RIGHT", "LEFT")) for k in ("OUTER", "SEMI", "ANTI")}
COMPARED = {"=": "=", "<>": "<>", "IS NOT DISTINCT FROM": "IS NOT DISTINCT FROM", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
SPELLED = {"==": "=", "!=": "<>", "<=>": "IS NOT DISTINCT FROM"}
LEVEL = {"||": 1, "+": 2, "-": 2, "*": 3, "/": 3, "%": 3}
UNKNOWN = "<unknown>"
#: Readings of one conjunct that are followed; beyond them ambiguous columns count as unknown.
READINGS = 8


def join_type(raw: str | None) -> str:
    """The canonical name of a join type; unknown ones in upper case."""
    text = " ".join(re.sub(r"[_\s]+", " ", raw or "").upper().split())
    text = re.sub(r"\s*\bJOIN$", "", text)
    return TYPES.get(text, text)


def join_type_column(raw: Column) -> Column:
    text = F.trim(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"[_\s]+", " "))
    text = F.trim(F.regexp_replace(text, r"\bJOIN$", ""))
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.element_at(known, text), text)


def mirrored_column(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MIRROR.items() for x in pair))
    return F.coalesce(F.element_at(known, kind), kind)


# Expressions are tuples: ("col", *parts) ("at", table, column) ("lit", text) ("star", *parts) ("bin", op, a, b)
# ("and", *xs) ("or", *xs) ("not", x) ("func", name, *args) ("between", x, lo, hi) ("in", x, *items) ("like", op, x, y)
# ("null", x) ("cast", x, type) ("case", text, *xs) ("query", q)


def children(e: tuple) -> list[tuple]:
    return [x for x in e[1:] if isinstance(x, tuple)]


def columns_of(e: tuple) -> list[tuple]:
    """The columns of an expression, those inside subqueries left out."""
    if e[0] == "col":
        return [e]
    return [] if e[0] == "query" else [c for x in children(e) for c in columns_of(x)]


def conjuncts(e: tuple) -> list[tuple]:
    return [c for x in e[1:] for c in conjuncts(x)] if e[0] == "and" else [e]


def render(e: tuple, named: dict[tuple, tuple[str, str] | None], level: int = 0) -> str:
    """The canonical text of an expression; named has the (table, column) of its columns, None for unknown ones."""
    kind = e[0]
    r = lambda x, n=0: render(x, named, n)
    if kind == "col":
        at = named.get(e)
        return f"{at[0]}.{at[1]}" if at else f"{UNKNOWN}.{e[-1].lower()}"
    if kind == "lit":
        return e[1]
    if kind == "star":
        return "*"
    if kind in ("and", "or"):
        inner = (f" {kind.upper()} ").join(sorted({r(x) for x in e[1:]}))
        return f"({inner})" if kind == "or" and " OR " in inner or level else inner
    if kind == "bin":
        op = e[1]
        if op in COMPARED:
            a, b = r(e[2], 1), r(e[3], 1)
            return f"{a} {op} {b}" if a <= b else f"{b} {COMPARED[op]} {a}"
        own = LEVEL.get(op, 1)
        text = f"{r(e[2], own)} {op} {r(e[3], own + 1)}"
        return f"({text})" if level > own else text
    if kind == "not":
        return f"NOT {r(e[1], 9)}"
    if kind == "func":
        return f"{e[1].upper()}({', '.join(r(x) for x in e[2:])})"
    if kind == "between":
        return f"{r(e[1], 1)} BETWEEN {r(e[2], 1)} AND {r(e[3], 1)}"
    if kind == "in":
        return f"{r(e[1], 1)} IN ({', '.join(r(x) for x in e[2:])})"
    if kind == "like":
        return f"{r(e[2], 1)} {e[1]} {r(e[3], 1)}"
    if kind == "null":
        return f"{r(e[1], 1)} IS NULL"
    if kind == "cast":
        return f"CAST({r(e[1])} AS {e[2].upper()})"
    if kind == "case":
        return f"{e[1].upper()}({', '.join(r(x) for x in e[2:])})"
    return "(SELECT)"


def condition(e: tuple, named: dict) -> dict:
    """One conjunct: its predicate, and operator and operands where these are plain columns."""
    text = render(e, named)
    out = {"predicate": text, "operator": None, "left_column": None, "right_column": None}
    if e[0] == "bin" and e[1] in COMPARED:
        sides = [render(x, named) if x[0] == "col" else None for x in e[2:4]]
        if all(sides):
            swap = sides[0] > sides[1]
            out |= {"operator": COMPARED[e[1]] if swap else e[1], "left_column": min(sides), "right_column": max(sides)}
    return out


def group(exprs: list[tuple], resolve) -> tuple[dict[tuple[str, str], list[dict]], set[tuple[str, str]]]:
    """Conjuncts by the pair of tables that they join, and the pairs that are only one reading of several.

    resolve(column) lists the (table, column) that it may be. A conjunct of fewer than two tables is a filter; one of
    more than two goes to every pair. A pair that some conjunct joins for certain isn't ambiguous."""
    found: dict[tuple[str, str], list[dict]] = {}
    certain, doubtful = set(), set()
    for e in exprs:
        cols = list(dict.fromkeys(columns_of(e)))
        may = [resolve(c) or [None] for c in cols]
        total = 1
        for m in may:
            total *= len(m)
        if total > READINGS:
            may = [m if len(m) == 1 else [None] for m in may]
        readings = list(product(*may))
        for reading in readings:
            named = dict(zip(cols, reading, strict=True))
            tables = sorted({at[0] for at in reading if at})
            for pair in combinations(tables, 2):
                one = condition(e, named)
                if one not in found.setdefault(pair, []):
                    found[pair].append(one)
                (doubtful if len(readings) > 1 else certain).add(pair)
    return found, doubtful - certain


def make_join(left: str, right: str, kind: str, conditions: list[dict], line: int, language: str, implicit: bool = False, ambiguous: bool = False) -> dict:
    """A join in canonical order: tables by key, the type mirrored with them, conditions sorted and distinct."""
    if left > right:
        left, right, kind = right, left, MIRROR.get(kind, kind)
    unique = {c["predicate"]: c for c in conditions}
    ordered = [unique[k] for k in sorted(unique)]
    return {"left_table": left, "right_table": right, "join_type": kind, "condition": " AND ".join(c["predicate"] for c in ordered), "conditions": ordered, "line": line, "language": language, "implicit": implicit, "ambiguous": ambiguous}
