"""Files that are equal but for one numbered name, such as code generated by tenant or by day, are analysed once."""

from __future__ import annotations

import re

from edgeloom.operators.sqljoins import Findings

#: A whole word of small letters and a number.
NAME = re.compile(r"(?<![\w$])[a-z]+[0-9]+(?![\w$])")
#: Python in which a name may be put together from pieces: by +, formats, escapes or literals side by side.
PIECED = re.compile(r"""[+{\\#]|["']\s*["']""")
#: Shorter texts may be taken for prose by their length.
SHORT = 64
#: Longer errors are cut, maybe inside a name.
MOST_ERROR = 300


def masked(text: str, python: bool) -> tuple[str, str, str] | None:
    """(text with 0 as the number of its one numbered name, that name, the name with 0); None if it has no such name
    or more, or if its letters stand before a digit anywhere else.

    Findings follow from the masked text: names are compared with each other, and nothing but this name has its
    letters before a digit, so any two texts that are built from names are equal, or in an order, if and only if their
    masked ones are: they differ before the digits, after them, or where one has a digit and the other has none.
    """
    found = NAME.findall(text)
    if not found or found.count(found[0]) != len(found) or not text.isascii() or (python and PIECED.search(text)):
        return None
    name = found[0]
    letters = name.rstrip("0123456789")
    if len(re.findall(f"(?i){letters}[0-9]", text)) != len(found):
        return None
    out = text.replace(name, f"{letters}0")
    return (out, name, f"{letters}0") if len(out) >= SHORT else None


def same_for_all(found: Findings, zero: str) -> bool:
    """Whether renaming the findings of a masked text gives those of the text: no part of the name is cut or capital."""
    if any(len(e) >= MOST_ERROR or zero in e.lower() for e in found.errors):
        return False
    texts = [v for j in found.joins for v in (j["left_table"], j["right_table"], j["join_type"], j["condition"])]
    texts += [v for j in found.joins for c in j["conditions"] for v in c.values() if v]
    return not any(zero.upper() in t for t in [*texts, *found.tables, *(x for pair in found.columns for x in pair)])


def renamed(found: Findings, zero: str, name: str) -> Findings:
    """The findings of a masked text with the name that was masked."""
    own = lambda t: t.replace(zero, name)
    joins = []
    for j in found.joins:
        conditions = [{k: v and own(v) for k, v in c.items()} for c in j["conditions"]]
        joins.append({**j, "left_table": own(j["left_table"]), "right_table": own(j["right_table"]), "condition": own(j["condition"]), "conditions": conditions})
    return Findings(joins, {own(t) for t in found.tables}, {(own(t), own(c)) for t, c in found.columns}, list(found.errors))
