"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm._common import free_name, strings

#: Lengths of the n-grams; inside a word, or with the blank before or behind it.
GRAMS = (3, 5)
#: Positions of the filter (a power of two) and hashes by which an n-gram finds its own.
SLOTS, HASHES = 1 << 20, 3
#: Characters of text that are looked at at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Languages that are learned unless told otherwise; a column with more values is refused, as the filters' size follows
#: their number (128 MB for 1024), and none is left out in silence.
MOST_LANGUAGES = 1024


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of all n-grams of a text's words, in pieces; lower case, and all but letters are blanks.

    A long text is looked at CHUNK characters at a time, each with the few characters before it, so that no n-gram
    is missed or counted twice.
    """
    longest = max(GRAMS)
    for lo in range(0, max(len(text), 1), CHUNK):
        begin = max(0, lo - longest)
        low = text[begin : lo + CHUNK + longest].lower()
        code = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        letter = _letters()[code]
        code = np.where(letter, code, 32)
        if not lo:
            code, letter = np.append(32, code), np.append(False, letter)
        if lo + CHUNK >= len(text):
            code, letter = np.append(code, 32), np.append(letter, False)
        sums = np.append(0, np.cumsum(letter))
        for n in GRAMS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            inner = sums[n - 1 : n - 1 + m] - sums[1 : 1 + m] == n - 2
            first = 0 if not lo else len(text[begin:lo].lower())  # n-grams that begin before were in the last piece
            stop = m if lo + CHUNK >= len(text) else first + len(text[lo : lo + CHUNK].lower()) + (not lo)
            at = np.flatnonzero(inner[first:stop]) + first
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ code[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield h


def _positions(h: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((h * np.uint64(2 * k + 1)) >> np.uint64(20 + 8 * k)).astype(np.int64) & (SLOTS - 1)


class Filters:
    """One Bloom filter for each language, sliced: a position holds a bit of every language's filter, so that one
    look-up per hash answers for all of them."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.words = max(1, -(-len(languages) // 64))
        self.bits = np.zeros((SLOTS, self.words), np.uint64)

    def add(self, language: int, hashes: np.ndarray) -> None:
        for at in _positions(hashes):
            self.bits[at, language // 64] |= np.uint64(1 << language % 64)

    def fill(self) -> None:
        """Chance that an n-gram that is in none seems to be in each language's filter."""
        share = np.array([np.mean(self.bits[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.languages))])
        self.false_rate = share**HASHES

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """For each language how many of a text's n-grams its filter holds, and how many n-grams there are."""
        total, count = np.zeros(64 * self.words, np.int64), 0
        for h in gram_hashes(text):
            found = None
            for at in _positions(h):
                found = self.bits[at] if found is None else found & self.bits[at]
            count += len(h)
            for w in range(self.words):
                column = found[:, w]
                if len(self.languages) <= 12:
                    seen = np.bincount(column.view(np.int64), minlength=1 << len(self.languages))
                    for i in range(len(self.languages)):
                        total[i] += seen.reshape(-1, 2, 1 << i)[:, 1].sum()
                else:
                    bits = np.unpackbits(np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    total[64 * w : 64 * w + 64] += bits.sum(axis=0, dtype=np.int64)
        return total[: len(self.languages)], count

    def decide(self, text: str) -> tuple[str, float]:
        """(language, score): the language whose filter holds most n-grams, beyond what it would by chance, and that
        share of them; `und` without n-grams or languages. Where no filter holds more than by chance, it is the language
        with most hits, the first of equal ones, with score 0."""
        hits, n = self.hits(text)
        if not n or not len(hits):
            return UNKNOWN, 0.0
        share = (hits / n - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(share.argmax())
        if share[best] <= 0:
            return self.languages[int(hits.argmax())], 0.0
        return self.languages[best], float(min(1.0, share[best]))


def learn(docs: DataFrame, sample: int = 2000, least: int = 3, share: float = 0.004, versus: float = 0.2, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_languages: int = MOST_LANGUAGES) -> Filters:
    """Filters from about `sample` labelled documents of each language (all of a rarer one), drawn by a hash of doc_id.

    An n-gram is put into a language's filter if at least `least` of its sampled documents have it, a `share` of them
    at least, and if the share is no less than `versus` times that of the language that has it most: what is common in
    one language and stray in another, as in a quotation or a wrong label, marks the first alone. sample is the
    documented bound of what is learned from; only the n-grams that are put into filters are gathered. More languages
    than most_languages are an error.

    Rows with a null text or language teach nothing; without any labelled row there are no languages, and every text
    is `und`. Rows that repeat a doc_id are drawn together.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"{lang} has over {most_languages} values, so it names no languages")
    counts = {r["lang"]: r["n"] for r in found}
    languages = sorted(counts)
    filters = Filters(languages)
    if not languages:
        return filters
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    chance: Column = F.lit(1.0)
    for name in (x for x in languages if counts[x] > sample):
        chance = F.when(F.col(lang) == name, sample / counts[name]).otherwise(chance)
    number = F.create_map(*(x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))))

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # each n-gram once for a document, added up by batch
            found: dict[int, list[np.ndarray]] = {}
            held = 0
            rows = list(zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True))
            for k, (language, t) in enumerate(rows):
                found.setdefault(language, []).append(np.unique(np.concatenate([*gram_hashes(t), np.zeros(0, np.uint64)])))
                held += len(found[language][-1])
                if held > 1 << 21 or k == len(rows) - 1:
                    for key, h in found.items():
                        h, n = np.unique(np.concatenate(h), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["l", "h", "n"])
                    found, held = {}, 0

    drawn = labelled.where(draw < chance).select(number[F.col(lang)].alias("l"), F.col(text).alias("text"))
    texts = {r["l"]: r["n"] for r in drawn.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not texts:
        filters.fill()
        return filters
    found = drawn.mapInArrow(grams, "l int, h long, n long").groupBy("l", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    drawn_of = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))
    rated = found.withColumn("rate", F.col("n") / drawn_of[F.col("l")])
    top = F.max("rate").over(Window.partitionBy("h"))  # a row for each language at most
    table = rated.withColumn("top", top).where((F.col("rate") >= share) & (F.col("rate") >= versus * F.col("top"))).select("l", "h").toArrow()
    l, h = table["l"].to_numpy(), table["h"].to_numpy()
    for i in range(len(languages)):
        filters.add(i, h[l == i].view(np.uint64))
    filters.fill()
    return filters


def predict(docs: DataFrame, filters: Filters, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of every document, with its language and score (0 to 1).

    Only the text is looked at, the whole of it. A null text and one without letters are `und` with score 0. The
    filters have one size, whatever the corpus, and are broadcast.
    """
    spark = docs.sparkSession
    shared: Broadcast = spark.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            found = [f.decide(t) for t in strings(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, *names])

    slim = docs.select(*keep, F.col(text).alias(free_name(keep, "__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return slim.mapInArrow(run, f"{schema}{', ' if schema else ''}`{names[0]}` string, `{names[1]}` double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
