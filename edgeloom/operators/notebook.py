"""Notebooks as one module: code cells in order, SQL cells and lines apart."""

from __future__ import annotations

import ast
import json
import re

# Magics of cells and of lines that are SQL.
CELL_MAGICS = ("sql", "sparksql", "spark_sql", "bigquery", "athena", "trino")
#: Stands between the cells of a notebook in one text.
BETWEEN = "\x1e"
LINE_MAGICS = ("sql", "sparksql", "spark_sql")
SQL_CELL = re.compile(rf"^\s*%%\s*(?:{'|'.join(CELL_MAGICS)})\b[^\n]*\n?", re.I)
SQL_LINE = re.compile(rf"^\s*%\s*(?:{'|'.join(LINE_MAGICS)})\b(.*)$", re.I)


def cells(text: str) -> list[str]:
    """The sources of a notebook's code cells; raises ValueError for what is no notebook."""
    book = json.loads(text)
    if not isinstance(book, dict):
        raise ValueError("not a notebook")
    found = []
    for cell in book.get("cells") or []:
        if isinstance(cell, dict) and cell.get("cell_type") == "code":
            source = cell.get("source") or ""
            found.append("".join(source) if isinstance(source, list) else str(source))
    return found


def stitched(sources: list[str]) -> tuple[str, list[tuple[str, int]], list[str]]:
    """(python, [(sql, line)], errors): the Python of all cells, with magics blanked so that lines stay, and the SQL. A
    cell that is no Python is blanked as well; unless it is another language's, by its magic, that is an error."""
    python, queries, errors, line = [], [], [], 1
    for cell in sources:
        n = cell.count("\n") + 1
        if m := SQL_CELL.match(cell):
            queries.append((cell[m.end() :], line + 1))
            python.append("\n" * (n - 1))
        else:
            kept = []
            for k, row in enumerate(cell.split("\n")):
                if m := SQL_LINE.match(row):
                    queries.append((m[1], line + k))
                kept.append("" if re.match(r"\s*[%!]", row) else row)
            try:
                ast.parse("\n".join(kept))
            except (SyntaxError, ValueError, RecursionError) as error:
                if not re.match(r"\s*%%", cell):
                    errors.append(f"{type(error).__name__}: line {line}: {error}"[:300])
                kept = [""] * n
            python.append("\n".join(kept))
        line += n
    return "\n".join(python), queries, errors
