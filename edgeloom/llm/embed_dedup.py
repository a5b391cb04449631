"""Near-duplicate embeddings by random-hyperplane signs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm._common import local_roots, starts_of, stored, whole_groups
from edgeloom.llm.components import connected_components

#: Members of a block that are compared with each other at once; a larger bucket is cut into parts of this size.
PART = 1024
#: Buckets up to this size are compared row by shifted row, larger ones as a matrix.
SMALL = 24


def tables_for(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables): enough bits that chance companions in a bucket are rare among n vectors, and enough tables that
    a pair at the threshold itself meets in one of them with the wanted probability (closer pairs with a higher one)."""
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2))) + 3))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-meet))


def _valid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, vec): a digest and the doubles of each vector that can have a cosine, else nulls."""
    for batch in batches:
        keys, vecs = [], []
        for v in batch.column(1).to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, np.float64) + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                keys.append(None)
                vecs.append(None)
            else:
                vecs.append(raw := x.tobytes())
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signer(bits: int, tables: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            signs = np.empty((len(raw), tables), np.int32)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((size // 8, bits * tables))
                at = np.flatnonzero(sizes == size)
                bit = (_unit([raw[i] for i in at]) @ planes[size] > 0).reshape(len(at), tables, bits)
                signs[at] = bit @ (1 << np.arange(bits, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "vec")), pa.array([s.tobytes() for s in signs], pa.binary())], names=["id", "n", "vec", "sign"])

    return run


def _explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, bucket): one row for each vector and table; vectors of different lengths never share a bucket."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            if part.num_rows:
                signs = np.frombuffer(b"".join(part.column("sign").to_pylist()), np.int32).reshape(part.num_rows, -1)
                dims = np.array(part.column("dim").to_pylist(), np.int64)
                bucket = (dims[:, None] << 32) + signs
                tables = signs.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int16), part.num_rows)), pa.array(bucket.ravel())], names=["id", "t", "bucket"])


def _verify(cosine: float):
    """(id, links, root) from blocks sorted by (t, bucket, p, q): of each vector with a link, how many vectors it links
    to for the first time in this table, and the smallest id in its part of the block's graph.

    A block (p, q) holds the parts p and q of a bucket and compares across them; (p, p) compares inside a part. A pair
    is counted in the first table whose bucket has both, so no table counts it again; pairs are never returned.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["t", "bucket", "p", "q"]):
            t, bucket, p, q, part, ids, n = (table[c].to_numpy() for c in ("t", "bucket", "p", "q", "part", "id", "n"))
            at = starts_of(t, bucket, p, q)
            size, raw = np.diff(at), table["vec"].to_pylist()
            signs = np.frombuffer(b"".join(table["sign"].to_pylist()), np.int32).reshape(len(ids), -1)
            links, a, b = np.zeros(len(ids), np.int64), [], []

            def count(i: np.ndarray, j: np.ndarray) -> None:
                a.append(i)
                b.append(j)
                for lo in range(0, len(i), 1 << 15):
                    x, y = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                    new = (signs[x] == signs[y]).argmax(axis=1) == t[x]
                    np.add.at(links, x[new], n[y[new]])
                    np.add.at(links, y[new], n[x[new]])

            for length in {len(raw[k]) for k in at[:-1]}:  # a bucket's vectors have one length
                few = np.flatnonzero((size <= SMALL) & (np.array([len(raw[k]) for k in at[:-1]]) == length))
                if len(few):
                    own = np.concatenate([np.arange(at[k], at[k + 1]) for k in few])
                    x, group = _unit([raw[k] for k in own]), np.repeat(few, size[few])
                    for step in range(1, int(size[few].max())):  # each row against the one `step` rows on, all buckets at once
                        k = np.flatnonzero(group[:-step] == group[step:])
                        k = k[np.einsum("ij,ij->i", x[k], x[k + step]) >= cosine]
                        i, j = own[k], own[k + step]
                        across = (p[i] == q[i]) | (part[i] != part[j])
                        count(i[across], j[across])
            for k in np.flatnonzero(size > SMALL):
                own = np.arange(at[k], at[k + 1])
                x, inside = _unit([raw[m] for m in own]), p[own[0]] == q[own[0]]
                left = right = np.arange(len(own))
                if not inside:
                    left, right = np.flatnonzero(part[own] == p[own[0]]), np.flatnonzero(part[own] != p[own[0]])
                for lo in range(0, len(left), 128):
                    rows = left[lo : lo + 128]
                    near = np.einsum("ik,jk->ij", x[rows], x[right], optimize=True) >= cosine
                    if inside:
                        near &= right[None, :] > rows[:, None]
                    i, j = np.nonzero(near)
                    count(own[rows[i]], own[right[j]])
            i, j = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
            root = local_roots(len(ids), i, j, ids)
            out = np.flatnonzero((links > 0) | (root != ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(links[out]), pa.array(root[out])], names=["id", "links", "root"])

    return run


def embedding_groups(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, seed: int = 11, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; two vectors link if their cosine in double precision is
    at least `cosine`.

    Equal vectors are collapsed first. Each different vector is hashed by the signs of `bits` random projections in
    each of `tables` tables (see tables_for: a pair at the threshold is met with probability `recall`, closer ones
    more surely); buckets of one member are dropped before the vectors are fetched. A bucket over PART members is cut
    into parts, and each pair of parts is compared in a task of its own. Cosines of what shares a bucket are verified;
    links are counted, not listed, and a spanning forest of them goes to connected_components.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are components of their
    own. Vectors of different lengths never link. A row without vec_id is counted by its neighbours; its own
    component_id is that of its links and its kept is false; where no row of a component has a vec_id, component_id is
    null. Rows that repeat a vec_id are separate vectors: the graph's nodes are the different vectors, numbered once
    they are written, and ids come in only when components are named. An empty table gives an empty result; other
    columns are ignored.
    """
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    rows = stored(slim.mapInArrow(_valid, "vec_id long, key binary, vec binary"), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = tables_for(classes.count(), cosine, recall)
    signed = stored(classes.select("id", "n", "vec").mapInArrow(_signer(bits, tables, seed), "id long, n long, vec binary, sign binary"), "signs")
    hashed = signed.select("id", "sign", F.length("vec").alias("dim")).mapInArrow(_explode, "id long, t short, bucket long")
    shared = stored(hashed.groupBy("t", "bucket").agg(F.count("*").alias("m")).where("m > 1"), "shared-buckets")
    cut = hashed.join(shared, ["t", "bucket"]).withColumn("parts", F.ceil(F.col("m") / PART).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = cut.select("id", "t", "bucket", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    full = blocks.join(signed, "id").repartition("t", "bucket", "p", "q").sortWithinPartitions("t", "bucket", "p", "q")
    found = stored(full.select("t", "bucket", "p", "q", "part", "id", "n", "vec", "sign").mapInArrow(_verify(cosine), "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = stored(connected_components(found.where("id <> root").select("id", "root").distinct(), "id", "root"), "vector-components")
    heads = classes.join(parts, F.col("id") == F.col("node")).groupBy("component").agg(F.min("first").alias("head"))
    labels = parts.join(heads, "component").select("node", "head")
    named = classes.select("key", "id", "n", "first").join(counts, "id", "left").join(labels, F.col("id") == F.col("node"), "left")
    head = F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("head"))
    named = stored(named.select(F.col("key").alias("of"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), head.alias("component_id")), "vector-names")
    out = rows.select("vec_id", "key").join(named, F.col("key") == F.col("of"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
