"""Code files to findings, a row for each file, on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from edgeloom.functions.naming import table_key
from edgeloom.operators.frames import FrameAnalysis, looks_like_sql
from edgeloom.operators.notebook import BETWEEN, cells, stitched
from edgeloom.operators.numbered import masked, renamed, same_for_all
from edgeloom.operators.sqljoins import Analysis, Findings

# Fields by their Arrow types; Spark's are said by these.
CONDITION = {"predicate": pa.string(), "operator": pa.string(), "left_column": pa.string(), "right_column": pa.string()}
JOIN = {"left_table": pa.string(), "right_table": pa.string(), "join_type": pa.string(), "condition": pa.string(), "conditions": pa.list_(pa.struct(CONDITION.items())), "line": pa.int32(), "language": pa.string(), "implicit": pa.bool_(), "ambiguous": pa.bool_()}
COLUMN = {"table_key": pa.string(), "name": pa.string()}
PARTS = ("joins", "tables", "columns", "errors")


def namer(settings: dict):
    """A function from names as they are written to table keys; None for tables that the settings leave out."""
    schema, catalog = settings.get("default_schema"), settings.get("default_catalog")
    rules = [(re.compile(p, re.I), to) for p, to in settings.get("rewrites", [])]
    include = [re.compile(p, re.I) for p in settings.get("include", [])]
    exclude = [re.compile(p, re.I) for p in settings.get("exclude", [])]

    def name(text: str) -> str | None:
        key = table_key(text, schema, catalog)
        for pattern, to in rules:
            key = pattern.sub(to, key)
        if rules:
            key = table_key(key, schema, catalog)
        if include and not any(p.search(key) for p in include) or any(p.search(key) for p in exclude):
            return None
        return key

    return name


def analyse(text: str, language: str, settings: dict | None = None, columns: bool = True) -> Findings:
    """The findings of one file, without the columns of its SQL unless they are asked for; whatever goes wrong is an
    error in them. Files without settings that differ in the number of one name only share an analysis."""
    try:
        code = cells(text) if language == "notebook" else [text]
    except Exception as error:  # no notebook
        return failed(error)
    one = None if settings or any(BETWEEN in c for c in code) else masked(BETWEEN.join(code), language in ("python", "notebook"))
    if one is not None:
        found = shared(one[0], one[2], language, columns)
        if found is not None:
            return renamed(found, one[2], one[1])
    return analysed(code, language, settings or {}, columns)


def failed(error: Exception) -> Findings:
    return Findings(errors=[f"{type(error).__name__}: {error}"[:300]])


@lru_cache(maxsize=4096)
def shared(text: str, zero: str, language: str, columns: bool) -> Findings | None:
    """The findings of a masked text, if they tell those of the texts behind it."""
    found = analysed(text.split(BETWEEN), language, {}, columns)
    return found if same_for_all(found, zero) else None


def analysed(code: list[str], language: str, settings: dict, columns: bool) -> Findings:
    """The findings of the code cells of a notebook, or of the one text of another file."""
    name, text = namer(settings), code[0] if code else ""
    try:
        if language == "python":
            return FrameAnalysis(name, columns=columns).run(text)
        if language == "notebook":
            python, queries, wrong = stitched(code)
            frames = FrameAnalysis(name, language="notebook", columns=columns)
            found = frames.run(python)
            found.errors += wrong
            for sql, line in queries:
                more = Analysis(name, language="notebook", columns=columns).run(sql, line)
                found.joins += more.joins
                found.tables |= more.tables
                found.columns |= more.columns
                found.errors += more.errors
            return found
        if language == "text" and not looks_like_sql(text):
            return Findings()
        return Analysis(name, language=language, columns=columns).run(text)
    except Exception as error:  # a file must not end a scan
        return failed(error)


def lists(found: list[list], values: pa.Array) -> pa.Array:
    """The values of all lists of found, one after the other, as lists of their lengths."""
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, found), initial=0)), pa.int32()), values)


def structs(rows: list[dict], fields: Mapping[str, pa.DataType]) -> pa.Array:
    """Rows as structs, made field by field."""
    made = []
    for name, kind in fields.items():
        own = [r[name] for r in rows]
        made.append(lists(own, structs([c for x in own for c in x], CONDITION)) if name == "conditions" else pa.array(own, kind))
    return pa.StructArray.from_arrays(made, fields=[pa.field(n, k) for n, k in fields.items()])


def extract(files: DataFrame, settings: dict | None = None, text: str = "text", language: str = "language", parts: Sequence[str] = PARTS, fields: Sequence[str] = tuple(JOIN)) -> DataFrame:
    """files with what each says: joins, tables, columns and errors, or those of them that parts names; fields are those
    of a join that are returned. Other columns are kept, the text is not.

    Files are parsed where they lie: there is no shuffle, nothing goes to the driver, and one bad file costs a message.
    A null text or language finds nothing."""
    kept = [c for c in files.columns if c != text]
    settings, wanted = settings or {}, {n: JOIN[n] for n in fields}

    def said(part: str, rows: list[Findings]) -> pa.Array:
        if part == "joins":
            found = [f.joins for f in rows]
            return lists(found, structs([j for x in found for j in x], wanted))
        if part == "columns":
            pairs = [sorted(f.columns) for f in rows]
            return lists(pairs, structs([{"table_key": t, "name": c} for x in pairs for t, c in x], COLUMN))
        texts = [sorted(f.tables) if part == "tables" else f.errors for f in rows]
        return lists(texts, pa.array([t for x in texts for t in x], pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(text).to_pylist(), batch.column(language).to_pylist(), strict=True)
            rows = [analyse(t, lang, settings, "columns" in parts) if isinstance(t, str) and isinstance(lang, str) else Findings() for t, lang in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(said(p, rows) for p in parts)], names=[*kept, *parts])

    kinds = {"joins": pa.list_(pa.struct(wanted.items())), "tables": pa.list_(pa.string()), "columns": pa.list_(pa.struct(COLUMN.items())), "errors": pa.list_(pa.string())}
    schema = StructType([*files.select(*kept).schema, *(StructField(p, from_arrow_type(kinds[p])) for p in parts)])
    return files.mapInArrow(run, schema)


def occurrences(findings: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each join found."""
    return findings.select(*keep, F.inline("joins")) if "language" not in keep else findings.select(*[c for c in keep if c != "language"], F.inline("joins"))
