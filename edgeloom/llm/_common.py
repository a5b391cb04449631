"""What the operators share: the shared scratch folder, and walking sorted Arrow batches group by group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tables up to so many rows of a few longs are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one in local mode
    (tests); on a cluster, whose machines don't share such a folder, that is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not named and not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="edgeloom-"))
    return jsc.getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/edgeloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage is cut, and a lost executor loses nothing.

    A later join on the table plans its own exchanges, so AQE can split the skewed partitions of both sides.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/edgeloom/" in path.toString():
                path.getFileSystem(conf).delete(path, True)


def free_name(columns: Iterable[str], name: str) -> str:
    """name, with underscores behind it until no column is called so in any spelling."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def strings(column: pa.Array) -> list[str]:
    """The texts of a string column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as no bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in arrays that are sorted together; ends with their length."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by keys; at most one group is carried over."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        if not table.num_rows:
            continue
        cut = int(starts_of(*(table[k].to_numpy() for k in keys))[-2])
        if cut:
            yield table.slice(0, cut)
        carry = table.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry


def local_roots(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges (a, b): the smallest rank in each node's connected component."""
    label = rank.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if np.array_equal(before, label):
            break
    return label
