"""Names of tables: parsing, defaults, rewrites, filters, and tables behind paths.

Every rule exists as a plain function, for the extractors, and where it runs over rows as a Column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTES = "`\"[]'"
PART = re.compile(r"""`[^`]*`|"[^"]*"|\[[^\]]*\]|[^.`"\[]+""")


def parts_of(text: str) -> list[str]:
    """The parts of a dotted name, dots inside quotes or brackets kept, quotes removed, in lower case."""
    found = [p.strip().strip(QUOTES).strip().lower() for p in PART.findall(text.strip().rstrip("; \t\r\n"))]
    return [p for p in found if p]


def table_key(text: str | Sequence[str], schema: str | None = None, catalog: str | None = None) -> str:
    """The dotted lower-case key of a table; four and more parts fold into the catalog.

    A default schema or catalog fills in what the name lacks. Raises ValueError for an empty name."""
    parts = parts_of(text) if isinstance(text, str) else [p.lower() for p in text]
    if not parts:
        raise ValueError("empty table name")
    if len(parts) == 1 and schema:
        parts = [schema.lower(), *parts]
    if len(parts) <= 2 and catalog:
        parts = [catalog.lower(), *parts]
    return ".".join(parts)


def split_key(key: str) -> tuple[str | None, str | None, str]:
    """(catalog, schema, name) of a key."""
    parts = key.split(".")
    return ".".join(parts[:-2]) or None, parts[-2] if len(parts) > 1 else None, parts[-1]


def path_table(path: str) -> str | None:
    """The table that a data path stands for: its last two segments without scheme, k=v and * segments and extension."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "", path.strip())
    kept = [s for s in bare.split("/") if s and "=" not in s and "*" not in s]
    kept = [re.sub(r"\.[A-Za-z0-9]+$", "", s).lower() for s in kept][-2:]
    return ".".join(s for s in kept if s) or None


def path_table_column(path: Column) -> Column:
    """path_table over rows; null where nothing is left."""
    bare = F.regexp_replace(F.trim(path), r"^[A-Za-z][A-Za-z0-9+.\-]*:/+", "")
    kept = F.filter(F.split(bare, "/"), lambda s: (s != "") & ~s.contains("=") & ~s.contains("*"))
    named = F.transform(kept, lambda s: F.lower(F.regexp_replace(s, r"\.[A-Za-z0-9]+$", "")))
    last = F.when(F.size(named) > 2, F.slice(named, -2, 2)).otherwise(named)
    text = F.array_join(F.filter(last, lambda s: s != ""), ".")
    return F.when(text != "", text)


def rewritten(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Rewrite rules in order, each a case-insensitive pattern and its replacement."""
    for pattern, to in rules:
        name = F.regexp_replace(name, f"(?i){pattern}", to)
    return F.lower(name)


def accepted(name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether any include pattern (all, if there is none) and no exclude pattern is found in the name."""
    out = F.lit(True)
    if include:
        out = name.rlike("|".join(f"(?i:{p})" for p in include))
    for p in exclude:
        out = out & ~name.rlike(f"(?i){p}")
    return out


def name_parts(text: Column) -> tuple[Column, Column, Column]:
    """(catalog, schema, name) of unquoted dotted names over rows; null where a part is missing."""
    clean = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"[;\s]+$", "")), r"[`\"\[\]']", ""))
    parts = F.split(clean, r"\.")
    n = F.size(parts)
    catalog = F.when(n > 2, F.array_join(F.slice(parts, 1, n - 2), "."))
    return catalog, F.when(n > 1, F.get(parts, n - 2)), F.get(parts, n - 1)


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob; * crosses slashes, and a leading **/ also matches nothing."""
    head = "(?:.*/)?" if glob.startswith("**/") else ""
    body, i, out = glob[3:] if head else glob, 0, ""
    while i < len(body):
        c = body[i]
        if c == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out += f"[{'^' + inner[1:] if inner.startswith('!') else inner}]"
            i = end
        else:
            out += re.escape(c) if c != "/" else "/"
        i += 1
    return f"^{head}{out}$"


def scrubbed(url: Column) -> Column:
    """A remote's url without the user and secret before its host."""
    return F.regexp_replace(url, r"^([^/]*?://)[^/]*@", "$1")


# Patterns of text that may hold a join, and of text that looks like SQL.
SQL_HINT = r"(?i)\b(join|from)\b"
SQL_LOOK = r"(?is)\b(select|insert|update|delete|merge|create|with)\b.*?\bfrom\b|\bjoin\b"


def looks_like_sql(text: Column) -> Column:
    return (F.length(text) >= 12) & text.rlike(SQL_LOOK)


def without_hash_comments(text: Column) -> Column:
    """Whole-line # comments blanked, the lines kept."""
    return F.regexp_replace(text, r"(?m)^([ \t]*)#[^\n]*$", "$1")
