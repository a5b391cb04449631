"""Code files as a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.naming import glob_regex
from edgeloom.sources.config import LANGUAGES, Source
from edgeloom.sources.git import below, repository


def folder_regexes(source: Source) -> list[str]:
    """Patterns of excluded folders: a glob that fits a folder, or all in it, excludes all below it."""
    return [glob_regex(g.removesuffix("/**")) for g in source.exclude]


def accepts(rel: Column, full: Column, source: Source) -> Column:
    """Whether a source's globs and file patterns let a file in; a pattern may fit the relative or the full path."""
    fits = lambda pattern: rel.rlike(pattern) | full.rlike(pattern)
    any_of = lambda patterns: fits("|".join(patterns)) if patterns else F.lit(False)
    excluded = [glob_regex(g) for g in source.exclude] + [f"{r.removesuffix('$')}/.*$" for r in folder_regexes(source)]
    out = any_of([glob_regex(g) for g in source.include]) & ~any_of(excluded)
    if source.include_files:
        out = out & any_of([f"(?i:{p})" for p in source.include_files])
    return out & ~any_of([f"(?i:{p})" for p in source.exclude_files])


def language_of(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark if they are valid, else Latin-1."""
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    return F.coalesce(utf8, F.decode(content, "ISO-8859-1"))


def code_files(spark: SparkSession, source: Source) -> DataFrame:
    """(source, path, rel_path, language, text, digest, size_bytes, root, branch, commit_sha, remote) of a source.

    Endings and sizes are filtered before contents are read, files over the size limit and binary ones are left out,
    and a path under two roots counts once. The listing and the reads are Spark's, so roots may be in any store. In a
    local root, a file belongs to the innermost repository around it, and symbolic links are left out unless the source
    follows them; for that the driver walks the folders that aren't excluded."""
    endings = sorted({e for e in LANGUAGES if any(g.endswith(e) or not g.rpartition(".")[2].isalnum() for g in source.include)})
    found: DataFrame | None = None
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for root in source.roots:
        at = jvm.org.apache.hadoop.fs.Path(root)
        if not endings or not at.getFileSystem(conf).exists(at):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{','.join(endings)}}}").load(root)
        full = F.regexp_replace("path", "^file:/+", "/")
        git, inner, links = dict.fromkeys(("root", "branch", "commit_sha", "remote")), [], []
        if "://" not in root:
            excluded = [re.compile(r) for r in folder_regexes(source)]
            git = repository(root)
            inner, links = below(root, lambda folder, root=root: any(r.search(folder[len(root.rstrip("/")) + 1 :]) or r.search(folder) for r in excluded))  # noqa: B023
        inside = lambda top: full.startswith(f"{top.rstrip('/')}/")  # noqa: E731, B023
        rest = lambda top: F.when(inside(top), F.substring(full, len(top.rstrip("/")) + 2, 1 << 20)).otherwise(F.regexp_extract(full, r"([^/]+)$", 1))  # noqa: E731, B023
        files = files.where(F.col("length") <= source.max_file_bytes).where(accepts(rest(root), full, source))
        for link in () if source.follow_symlinks else links:
            files = files.where(~((full == link) | inside(link)))
        rel, of = rest(git["root"] or root), {k: F.lit(v).cast("string") for k, v in git.items()}
        for one in sorted(inner, key=lambda r: len(r["root"])):  # the innermost has the last word
            rel = F.when(inside(one["root"]), rest(one["root"])).otherwise(rel)
            of = {k: F.when(inside(one["root"]), F.lit(one[k]).cast("string")).otherwise(v) for k, v in of.items()}
        one = files.select(F.lit(source.name).alias("source"), full.alias("path"), rel.alias("rel_path"), F.col("length").alias("size_bytes"), "content", *(v.alias(k) for k, v in of.items()))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "source string, path string, rel_path string, language string, text string, digest string, size_bytes long, root string, branch string, commit_sha string, remote string")
    found = found.where(F.instr(F.substring(F.col("content"), 1, 1024).cast("string"), "\0") == 0)
    if len(source.roots) > 1:
        found = found.dropDuplicates(["source", "path"])
    return found.select("source", "path", "rel_path", language_of(F.col("path")).alias("language"), decoded(F.col("content")).alias("text"), F.sha2("content", 256).alias("digest"), "size_bytes", "root", "branch", "commit_sha", "remote")

