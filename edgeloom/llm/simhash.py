"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm._common import free_name, local_roots, raw_texts, starts_of, stored, whole_groups
from edgeloom.llm.components import connected_components

BITS, SEED, RADIUS = 64, 42, 2
#: A bucket of up to so many different fingerprints is compared pair by pair; a larger one by its bit flips.
MOST_PAIRED = 128


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, each hashed by XXH64; 0 for a text without words.

    A-Z count as a-z, words stand between ASCII blanks, a text of fewer words is one shingle, and a bit is set if it
    is set in over half of the hashes. Shingles are slices of the words joined by blanks; hashes are counted in
    blocks, so that a very long text takes no more memory than its words.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.append(0, ends[:-1] + 1)
    last = max(1, len(words) - shingle + 1)
    begins, ends = begins[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, set_bits = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, last, 1 << 14):
        block = b"".join([digest(joined[s:e], SEED) for s, e in zip(begins[i : i + (1 << 14)], ends[i : i + (1 << 14)], strict=True)])
        set_bits += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > last).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, raw, fp) of every document; fp is a long with the fingerprint's 64 bits, raw is xxhash64 of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in raw_texts(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "raw", "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, raw long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks of the bits that each table compares: for any `radius` bits, some mask has none of them.

    Bit i gets a non-zero vector of radius + 1 bits, all in turn; table v compares the bits whose vector has an odd
    inner product with v. The vectors of `radius` bits leave a v that is orthogonal to all of them, so the table of
    that v compares none of these bits, and a pair that differs in no others has equal keys there.
    """
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links inside buckets, from rows (t, key, fp) sorted by bucket."""
    for table in whole_groups(batches, ["t", "key"]):
        t, key, fp = (table[c].to_numpy() for c in ("t", "key", "fp"))
        at = starts_of(t, key)
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        a, b = [], []
        for step in range(1, int(np.diff(at).max())):  # each row against the one `step` rows on, all buckets at once
            i = np.flatnonzero(group[:-step] == group[step:])
            i = i[np.bitwise_count((fp[i] ^ fp[i + step]).view(np.uint64)) <= RADIUS]
            a.append(i)
            b.append(i + step)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        root = local_roots(len(fp), i, j, fp)
        tied = np.flatnonzero(root != fp)
        yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(root[tied])], names=["a", "b"])


def near_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over different fingerprints (column fp) that join all that are linked within RADIUS bits.

    Every fingerprint is hashed to one bucket in each of 2^(RADIUS+1) - 1 = 7 tables. Buckets of up to MOST_PAIRED
    members are compared inside a partition; of the links found there only a spanning forest is returned. In a larger
    bucket each member is filed under itself and its flips of one uncompared bit; two members share a file if and
    only if they are within 2 bits, and a file holds at most 65 members, so a hot bucket costs its size, not its
    square.
    """
    masks = covering_masks(RADIUS)
    tables = F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    keys = fps.select("fp", F.inline(tables))
    hot = stored(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_PAIRED).select("t", "key"), "hot-buckets")
    cold = keys.join(hot, ["t", "key"], "left_anti").select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    paired = cold.mapInArrow(_near_pairs, "a long, b long")
    free = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in masks))
    flips = F.element_at(free, F.col("t").cast("int") + 1)
    filed = keys.join(hot, ["t", "key"], "left_semi").select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("file")).distinct()
    files = filed.groupBy("file").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    flipped = files.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return paired.union(flipped.where("a <> b"))


def _fp_components(fps: DataFrame) -> DataFrame:
    """(fp, component) of the fingerprints that have a link to another; component is one of them."""
    return stored(connected_components(near_links(fps)), "fp-components").withColumnRenamed("node", "fp")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document: its fingerprint and the smallest doc_id it is linked to, at any remove.

    Documents link if their fingerprints differ in at most RADIUS bits; equal fingerprints, that of texts without
    words included, are collapsed before any comparison, so a group of copies costs one row. Null or empty texts have
    fingerprint 0. A null doc_id takes part but is never a component's id, unless all are null. Rows that repeat a
    doc_id stay as they are. An empty table gives an empty result; other columns are ignored.
    """
    fps = stored(fingerprints(docs, text, doc_id, shingle).select("doc_id", "fp"), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-groups")
    links = _fp_components(groups.select("fp"))
    heads = stored(links.join(groups, "fp").groupBy("component").agg(F.min("first").alias("head")), "fp-heads")
    labels = links.join(heads, "component").select(F.col("fp").alias("of"), "head")
    named = groups.join(labels, F.col("fp") == F.col("of"), "left").select(F.col("fp").alias("of"), F.coalesce("head", "first").alias("component_id"))
    return fps.join(stored(named, "fp-names"), F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """One document of each group of near-duplicates in the columns of docs: that with the smallest doc_id, of the rows
    that repeat it the one with the smallest xxhash64 of its text.

    Every group keeps a row, also where another group's row has the same doc_id. Rows with a null doc_id have no rank
    and are kept. Rows equal in doc_id and text are reduced to one.
    """
    fps = fingerprints(docs.where(F.col(doc_id).isNotNull()), text, doc_id, shingle)
    groups = stored(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "raw")).alias("first")), "fp-groups")
    links = _fp_components(groups.select("fp")).select(F.col("fp").alias("of"), "component")
    heads = groups.join(links, F.col("fp") == F.col("of"), "left").groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("head"))
    rank, raw, own = (free_name(docs.columns, n) for n in ("__rank", "__raw", "__own"))
    first = stored(heads.select(F.col("head.doc_id").alias(rank), F.col("head.raw").alias(raw)), "kept-texts")
    marked = docs.withColumn(own, F.xxhash64(text))
    kept = marked.join(first, (F.col(doc_id).cast("long") == F.col(rank)) & (F.col(own) == F.col(raw)), "left_semi")
    return kept.dropDuplicates([doc_id, own]).unionByName(marked.where(F.col(doc_id).isNull())).drop(own)


def hex_of(fp: str) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
