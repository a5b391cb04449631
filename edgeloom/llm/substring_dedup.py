"""Repeated passages, by hashes of all runs of words; rare parts of a text are told by the least hash in each run."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.llm._common import free_name, stored, strings

#: Words of the shorter runs, of whose hashes the least in a run of min_words tells whether it can be anywhere else.
SHORT = 5
#: Characters that are cut into words at once, and of the texts that are taken together.
BLOCK, CHUNK = 1 << 16, 1 << 19
#: Rank of rows without a doc_id: after all others.
LAST = (1 << 63) - 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _GOLDEN
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point a number, one for all cases where lower case is one character, and 0 for a blank; and whether
    it is a blank (0), a letter or digit (2) or else (1)."""
    lower, kind = np.arange(1, 0x110001, dtype=np.uint64), np.ones(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            kind[i] = 2
        elif c.isspace():
            kind[i] = 0
        if len(low := c.lower()) == 1:
            lower[i] = ord(low) + 1
    return np.where(kind > 0, _mixed(_mixed(lower)), np.uint64(0)), kind


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd number and of its inverse, modulo 2^64."""
    base = 0xD1342543DE82EF95
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))


class Words:
    """The words of texts that follow each other. begins, ends: of all words, in characters, each with the blanks behind
    it and a text's first one with those before it; text: which text has it; counted: which words have a letter or digit;
    hashes: of the counted ones, case aside."""

    def __init__(self, texts: list[str]):
        number, kind = _characters()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.cumsum(sizes) - sizes
        begins, counted, hashes = [], [], []
        whole = "".join(texts)
        at, edges = 0, firsts[sizes > 0]
        while at < len(whole):  # a block ends before a blank, so no word is torn
            end = at + BLOCK
            while end < len(whole) and not whole[end].isspace():
                end += 1
            code = np.frombuffer(whole[at:end].encode("utf-32-le", "surrogatepass"), "<u4")
            of = kind[code]
            opens = of > 0
            before = opens[:-1].copy()
            inside = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, at + len(code))]
            before[inside - at - 1] = False
            opens[1:] &= ~before
            start = np.flatnonzero(opens)
            if len(start):
                up, down = _powers(1 << max(17, len(code).bit_length()))
                value = number[code]
                value *= up[: len(code)]
                known = np.maximum.reduceat(of, start) == 2
                start_known = start[known]
                hashes.append(_mixed(np.add.reduceat(value, start)[known] * down[start_known]))
                counted.append(known)
                begins.append(start + at)
            at = end
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.begins, self.counted, self.hashes = join(begins, np.int64), join(counted, bool), join(hashes, np.uint64)
        self.firsts = firsts
        cuts = np.append(np.searchsorted(self.begins, firsts), len(self.begins))
        self.text = np.repeat(np.arange(len(texts)), np.diff(cuts))
        self.ends = np.append(self.begins[1:], len(whole))[: len(self.begins)]
        some = np.flatnonzero(np.diff(cuts))
        self.ends[cuts[some + 1] - 1] = firsts[some] + sizes[some]
        self.begins[cuts[some]] = firsts[some]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, least, text) of each run of n counted words in one text, in order; least: the least hash of the runs of
        SHORT words in it. where() has the words that they begin with."""
        text, short = self.text[self.counted], min(SHORT, n)
        last = max(0, len(text) - n + 1)
        if not last:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.zeros(len(text) - short + 1, np.uint64)
        for k in range(n):
            if k == short:
                least = out[:last].copy()
                for i in range(1, n - short + 1):
                    np.minimum(least, out[i : i + last], out=least)
                out = out[:last]
            out = _mixed(out ^ self.hashes[k : k + len(out)])
        least = least if n > short else out
        self.inside = np.flatnonzero(text[:last] == text[n - 1 :])
        return out[self.inside].view(np.int64), least[self.inside].view(np.int64), text[self.inside]


def taken_together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of about CHUNK characters, a longer one alone."""
    lo = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield lo, k
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _owned(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Values told apart by the text that has them, one to one inside a text."""
    return values.view(np.uint64) ^ _mixed(text.astype(np.uint64) + np.uint64(1))


def _given(lists: pa.Array, lo: int, hi: int) -> np.ndarray:
    """What a column of lists has for rows lo to hi, told apart by row."""
    part = lists.slice(lo, hi - lo)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _owned(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(hi - lo), sizes))


def _digests(batches: Iterable[pa.RecordBatch], min_words: int, only: bool) -> Iterator[pa.RecordBatch]:
    """(a, doc, part): the least hashes in each document's runs or, with only, the hashes of its runs that have one of
    the fourth column's; one that follows itself is given once."""
    for batch in batches:
        docs, parts, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), strings(batch.column(2))
        for lo, hi in taken_together(texts):
            found, least, of = Words(texts[lo:hi]).runs(min_words)
            if only:
                asked = np.isin(_owned(least, of), _given(batch.column(3), lo, hi))
                found, of = found[asked], of[asked]
            else:
                found = least
            new = np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1]))[: len(found)]
            found, of = found[new], of[new]
            for i in range(0, len(found), 1 << 17):
                row = lo + of[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 17)]), pa.array(docs[row]), pa.array(parts[row])], names=["a", "doc", "part"])


def removed_spans(texts: list[str], elsewhere: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the spans that are repeats: the words of all runs of min_words that occur before, in an
    earlier document (elsewhere, as _given has them) or in this one without overlap. Words without a letter or digit
    neither end a run nor count."""
    words = Words(texts)
    runs, _, of = words.runs(min_words)
    own = _owned(runs, of)
    known = np.isin(own, elsewhere) if len(elsewhere) else np.zeros(len(runs), bool)
    ordered = np.sort(own)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        maybe = np.flatnonzero(np.isin(own, again))
        _, first, which = np.unique(own[maybe], return_index=True, return_inverse=True)
        known[maybe] |= maybe - maybe[first][which] >= min_words
    if not known.any():
        return (np.zeros(0, np.int64),) * 3
    at = words.inside[known]  # counted words that begin a repeated run
    step = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + min_words, -1)
    cut = np.cumsum(step[:-1]) > 0
    text = words.text[words.counted]
    joint = cut[1:] & cut[:-1] & (text[1:] == text[:-1])
    first, last = np.flatnonzero(cut & ~np.append(False, joint)), np.flatnonzero(cut & ~np.append(joint, False))
    begins, ends = words.begins[words.counted][first], words.ends[words.counted][last]
    return text[first], begins - words.firsts[text[first]], ends - words.firsts[text[first]]


def remove_repeats(docs: DataFrame, min_words: int = 10, text: str = "text", doc_id: str = "doc_id", spans: str = "removed") -> DataFrame:
    """docs without the passages that an earlier document has already, in an added column the removed spans.

    Documents are ranked by doc_id. Of every run of min_words words the occurrence in the smallest doc_id is kept, and
    there the first; the words of all others are cut out of the text with the blanks behind them, wherever a passage
    begins and ends. Words stand between blanks, are compared in lower case (character by character), and those
    without a letter or digit neither count nor end a run. spans holds the (begin, end) characters of the original that
    were cut, in order. Shorter repeats stay.

    A null text stays null and an empty one empty; documents that lose everything stay as rows with an empty text.
    Rows without a doc_id come after all others and rows that share a doc_id count as one document, so among
    themselves they keep what they have in common. Other columns are kept; one that is named like `spans` is replaced.
    An empty table gives an empty result.

    Equal runs have equal least hashes of shorter runs, about one for three words; those of one document only are
    dropped first, aggregated map-side. Just the runs that have one of the others are hashed and aggregated to the
    smallest doc_id. What is left is joined back by shuffle, where AQE splits the rows of a very common run. `part`
    keeps what is gathered for rows without a doc_id apart, by their texts.
    """
    rank, part = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), F.when(F.col(doc_id).isNull(), F.hash(text)).otherwise(0)
    slim = docs.select(rank.alias("doc"), part.alias("part"), F.col(text).alias("text"))
    schema = "a long, doc long, part int"
    least = slim.mapInArrow(lambda batches: _digests(batches, min_words, False), schema)
    ends = lambda hashed: hashed.groupBy("a").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    gathered = lambda rows, name: rows.groupBy(F.col("doc").alias("of"), F.col("part").alias("of_part")).agg(F.collect_list("a").alias(name))
    common = gathered(least.join(stored(ends(least).select("a"), "shared-least"), "a"), "least")
    asked = slim.join(common, (F.col("doc") == F.col("of")) & (F.col("part") == F.col("of_part"))).select("doc", "part", "text", "least")
    hashed = stored(asked.mapInArrow(lambda batches: _digests(batches, min_words, True), schema), "runs")
    hits = gathered(hashed.join(stored(ends(hashed).select("a", "first"), "shared-runs"), "a").where("doc > first"), "units")
    key, own, other, other_part, found = (free_name(docs.columns, n) for n in ("__doc", "__part", "__doch", "__parth", "__units"))
    rest = [c for c in docs.columns if c != spans]
    hits = hits.withColumnsRenamed({"of": other, "of_part": other_part, "units": found})
    joined = docs.select(*rest).withColumn(key, rank).withColumn(own, part).join(hits, (F.col(key) == F.col(other)) & (F.col(own) == F.col(other_part)), "left")
    schema = docs.select(*rest).schema.add(spans, T.ArrayType(T.StructType().add("begin", T.IntegerType()).add("end", T.IntegerType())))
    at = rest.index(text)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            texts = strings(batch.column(at))
            for lo, hi in taken_together(texts):
                of, begin, end = removed_spans(texts[lo:hi], _given(batch.column(batch.num_columns - 1), lo, hi), min_words)
                edges = np.searchsorted(of, np.arange(hi - lo + 1))
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                if len(of):
                    kept = columns[at].to_pylist()
                    for k in np.unique(of).tolist():
                        t, a, b = kept[k], edges[k], edges[k + 1]
                        kept[k] = "".join([t[i:j] for i, j in zip([0, *end[a:b].tolist()], [*begin[a:b].tolist(), len(t)], strict=True)])
                    columns[at] = pa.array(kept, columns[at].type)
                cuts = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(span))
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), cuts)], names=[*rest, spans])

    return joined.select(*rest, found).mapInArrow(cut, schema)
