"""Token ids in files of Re-Pair grammars."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm._common import BROADCAST_ROWS, strings
from edgeloom.llm.bpe import default_path, default_pattern, vocabulary

#: Ids after which a shard is closed; a shard holds whole documents, so a longer document has a shard of its own.
SHARD_IDS = 1 << 20
#: Different pieces that a worker remembers.
MEMORY = 1_200_000
#: How often a pair must occur to get a rule, and symbols of a body between two entries of its index.
LEAST, STEP = 16, 256

#: Hashes of pairs are the top bits of a product with an odd number.
MIX = {32: np.uint32(0x9E3779B1), 64: np.uint64(0x9E3779B97F4A7C15)}

SCHEMA = "part int, shard int, n_ids long, doc_ids array<long>, sizes array<long>, first_rule long, levels array<int>, rules binary, lengths binary, width int, body binary, index binary"


def _indexed(pair: np.ndarray, chosen: np.ndarray, bits: int) -> np.ndarray:
    """Of each pair its place in chosen, -1 if it is not there."""
    width = min(20, max(8, len(chosen).bit_length() + 4))
    mask, table = (1 << width) - 1, np.full(1 << width, -1, np.int32)
    slots = lambda x: ((x * MIX[bits]) >> x.dtype.type(bits - width)).astype(np.int32)
    slot, left = slots(chosen), np.arange(len(chosen), dtype=np.int32)
    while len(left):  # whoever finds its slot taken goes on to the next
        free = left[table[slot[left]] < 0]
        table[slot[free]] = free
        left = left[table[slot[left]] != left]
        slot[left] = (slot[left] + 1) & mask
    slot = slots(pair)
    out = table[slot]
    other = np.flatnonzero((chosen[out] != pair) & (out >= 0))
    while len(other):
        slot[other] = (slot[other] + 1) & mask
        out[other] = found = table[slot[other]]
        other = other[(chosen[found] != pair[other]) & (found >= 0)]
    return out


def compress(ids: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(body, rules, levels): ids as symbols, the pair that each symbol from first_rule on stands for, rules by round.

    Re-Pair in rounds: pairs are counted, and where pairs that occur LEAST times overlap, the more frequent one goes
    first (of equal ones a fixed hash decides, of a run of one symbol every other pair is taken). Each pair that is
    left LEAST times then gets a nonterminal and is replaced. Rounds end when there is none. The most frequent pair of
    a round always gets its rule if it occurs so often without overlap, so what remains overlaps or is rare.

    Counts are exact: a pair without a new symbol is as frequent as before or rarer, so after the first round only
    pairs that have one, and those that were frequent and are left, are counted.
    """
    seq, rules, levels, symbols = ids.astype(np.uint32), [], [], first_rule
    open_ = np.ones(len(seq), bool)  # where a pair begins that may be frequent
    while len(seq) >= 2 * LEAST:
        small = symbols <= 1 << 16  # then a pair is one 32-bit number
        kind, bits = (np.uint32, 32) if small else (np.uint64, 64)
        half = kind(bits // 2)
        place = np.flatnonzero(open_[:-1]) if levels else np.arange(len(seq) - 1)
        pair = (seq[place].astype(kind) << half | seq[place + 1]) if levels else seq[:-1].astype(kind) << half | seq[1:]
        ordered = np.sort(pair)
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        counts = np.diff(np.append(at, len(ordered)))
        often = counts >= LEAST
        chosen, counts = ordered[at[often]], counts[often]
        if not len(chosen):
            break
        chosen = chosen[np.lexsort((chosen * MIX[bits], counts))]  # the most frequent last
        rank = _indexed(pair, chosen, bits)
        often = np.flatnonzero(rank >= 0)
        place, rank = place[often], rank[often]
        touch = np.diff(place) == 1
        before = np.where(touch, rank[:-1], np.int32(-1))  # of each but the first
        hit = np.ones(len(rank), bool)
        hit[1:] = rank[1:] >= before
        hit[:-1] &= rank[:-1] >= np.where(touch, rank[1:], np.int32(-1))
        run = np.flatnonzero(rank[1:] == before) + 1  # of one symbol: every other pair
        if len(run):
            n = np.arange(len(run))
            hit[run[(n - np.maximum.accumulate(np.where(np.append(True, np.diff(run) > 1), n, 0))) % 2 == 0]] = False
        hit = np.flatnonzero(hit)
        named = np.bincount(rank[hit], minlength=len(chosen)) >= LEAST
        if not named.any():
            break
        hit = hit[named[rank[hit]]]
        name = (np.cumsum(named) - 1 + symbols).astype(np.uint32)
        open_[:] = False
        open_[place] = True
        place, rank = place[hit], rank[hit]
        seq[place] = name[rank]
        open_[place] = True
        open_[np.maximum(place - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        seq, open_ = seq[keep], open_[keep]
        chosen = chosen[named]
        rules.append(np.stack([chosen >> half, chosen & kind((1 << bits // 2) - 1)], axis=1).astype(np.int64))
        levels.append(len(chosen))
        symbols += len(chosen)
    body = seq.astype(np.uint16) if symbols <= 1 << 16 else seq
    return body, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), levels


def expansion_lengths(rules: np.ndarray, levels: list[int], first_rule: int) -> np.ndarray:
    """Ids that each rule's symbol stands for."""
    out = np.ones(len(rules), np.int64)
    lo = 0
    for n in levels:
        of = lambda s: np.where(s < first_rule, 1, out[np.maximum(s - first_rule, 0)])
        out[lo : lo + n] = of(rules[lo : lo + n, 0]) + of(rules[lo : lo + n, 1])
        lo += n
    return out


def expand(seq: np.ndarray, rules: np.ndarray, levels: list[int], first_rule: int) -> np.ndarray:
    """The ids of a sequence of symbols: rounds are undone from the last to the first."""
    seq, top = seq.astype(np.int64), first_rule + len(rules)
    for n in reversed(levels):
        top -= n
        ours = seq >= top
        out = np.repeat(seq, 1 + ours)
        at = np.flatnonzero(ours) + np.arange(int(ours.sum()))
        pairs = rules[seq[ours] - first_rule]
        out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def expand_all(body: np.ndarray, rules: np.ndarray, levels: list[int], first_rule: int, lengths: np.ndarray) -> np.ndarray:
    """expand() of a whole body: the rules' ids are written out first, round by round, and then fetched once.

    A rule's ids occur LEAST times in the shard, so those of a round's rules together are a LEAST-th of it."""
    # where each symbol's ids are, and how many: a terminal is its own
    begins = np.append(np.arange(first_rule), first_rule + np.cumsum(lengths) - lengths)
    size = np.append(np.ones(first_rule, np.int64), lengths)
    flat = np.append(np.arange(first_rule, dtype=np.uint32), np.zeros(int(lengths.sum()), np.uint32))

    def fetched(symbols: np.ndarray) -> np.ndarray:
        n = size[symbols]
        ends = np.cumsum(n)
        at = np.repeat(begins[symbols] - ends + n, n)
        at += np.arange(len(at))
        return flat[at]

    lo = first_rule
    for n in levels:
        flat[begins[lo] : begins[lo] + int(size[lo : lo + n].sum())] = fetched(rules[lo - first_rule : lo - first_rule + n].ravel())
        lo += n
    return fetched(body)


def _sizes(body: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each symbol of a body stands for."""
    return np.where(body < first_rule, 1, lengths[np.maximum(body.astype(np.int64) - first_rule, 0)]) if len(lengths) else np.ones(len(body), np.int64)


def read_shard(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, rules, lengths) of a row of the store."""
    body = np.frombuffer(shard["body"], "<u2" if shard["width"] == 2 else "<u4")
    return body, np.frombuffer(shard["rules"], "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(shard["lengths"], "<u4").astype(np.int64)


def read_ids(shard: dict, begin: int, end: int) -> np.ndarray:
    """The ids begin..end of a shard; the index says near which symbols, and only those that cover them are expanded."""
    body, rules, lengths = read_shard(shard)
    index = np.frombuffer(shard["index"], "<u8").astype(np.int64)  # ids before each STEP-th symbol
    begin, end = max(0, begin), min(end, shard["n_ids"])
    if begin >= end:
        return np.zeros(0, np.int64)
    lo, hi = int(np.searchsorted(index, begin, "right")) - 1, int(np.searchsorted(index, end, "left"))
    before, near = int(index[lo]), body[lo * STEP : hi * STEP]
    ends = before + np.cumsum(_sizes(near, lengths, shard["first_rule"]))
    first, last = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end, "left")) + 1
    before = int(ends[first - 1]) if first else before
    return expand(near[first:last], rules, list(shard["levels"]), shard["first_rule"])[begin - before : end - before]


def read_document(shard: dict, k: int) -> np.ndarray:
    """The ids of a shard's k-th document, its end id included."""
    begin = sum(shard["sizes"][:k])
    return read_ids(shard, begin, begin + shard["sizes"][k])


def _shard_row(part: int, shard: int, doc_ids: list, ids: list[bytes], first_rule: int) -> pa.RecordBatch:
    whole = np.frombuffer(b"".join(ids), "<u4")
    body, rules, levels = compress(whole, first_rule)
    width = body.itemsize
    lengths = expansion_lengths(rules, levels, first_rule)
    ends = np.cumsum(_sizes(body, lengths, first_rule))
    index = np.append(0, ends)[: len(body) : STEP]
    one = {
        "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_ids": pa.array([len(whole)], pa.int64()),
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "sizes": pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())),
        "first_rule": pa.array([first_rule], pa.int64()), "levels": pa.array([levels], pa.list_(pa.int32())),
        "rules": pa.array([rules.astype("<u4").tobytes()], pa.binary()), "lengths": pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
        "width": pa.array([width], pa.int32()), "body": pa.array([body.astype(f"<u{width}").tobytes()], pa.binary()), "index": pa.array([index.astype("<u8").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(one.values()), names=list(one))


def write_store(docs: DataFrame, target: str, path: str | None = None, pattern: str | None = None, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the ids of all documents in ascending doc_id order to Parquet files at target.

    Texts are dealt by ranges of doc_id and of a hash of the text, and sorted inside a range; documents are encoded and
    end_id is appended to each. About SHARD_IDS ids of a range are a shard, with a grammar of its own; shards are
    compressed one at a time, so memory holds one. A row is a shard: its documents with their sizes, rules with
    expansion lengths, the body of symbols, and an index of it. Files are committed by Spark, so a task that is run
    again leaves nothing behind.

    Null texts are empty. Null doc_ids come first; rows that share a doc_id are ordered by a hash of their text.
    Other columns are ignored. An empty table makes an empty store.
    """
    path, pattern = path or default_path("byte_bpe_50k.json"), pattern or default_pattern()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part = vocabulary(path, pattern, MEMORY), TaskContext.get().partitionId()
        end, shard, doc_ids, ids, held = np.array([end_id], "<u4").tobytes(), 0, [], [], 0
        for batch in batches:
            for one, encoded in zip(batch.column(0).to_pylist(), v.encode_all(strings(batch.column(1))), strict=True):
                doc_ids.append(one)
                ids.append(encoded + end)
                held += len(ids[-1]) // 4
                if held >= SHARD_IDS:
                    yield _shard_row(part, shard, doc_ids, ids, v.size)
                    shard, doc_ids, ids, held = shard + 1, [], [], 0
        if ids:
            yield _shard_row(part, shard, doc_ids, ids, v.size)

    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.xxhash64("text").alias("key")
    dealt = slim.select("doc_id", "text", key).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(target)


def read_store(spark, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    start counts the ids of all documents before it. The totals of parts, a row each, are summed in one window and
    shards inside their part. Shards are expanded one at a time.
    """
    shards = spark.read.schema(SCHEMA).parquet(target)
    sizes = shards.select("part", "shard", "n_ids")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(F.col("part").alias("p"), earlier(Window.orderBy("part")).alias("part_start"))
    starts = sizes.select(F.col("part").alias("p"), F.col("shard").alias("s"), earlier(Window.partitionBy("part").orderBy("shard")).alias("shard_start"))
    starts = starts.join(parts, "p").select("p", "s", (F.col("part_start") + F.col("shard_start")).alias("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                body, rules, lengths = read_shard(row)
                ids = expand_all(body, rules, row["levels"], row["first_rule"], lengths).astype("<u4", copy=False).tobytes()
                n = np.array(row["sizes"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                fixed = lambda x: pa.array(np.full(len(n), x, np.int32))
                yield pa.RecordBatch.from_arrays([fixed(row["part"]), fixed(row["shard"]), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = shards.mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    if sizes.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    joined = read.join(starts, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return joined.select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
