"""The graph's tables as Parquet, replaced source by source in one step."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Store:
    """A folder with a Parquet dataset for each table and a small file, `current`, that says which version of each source
    readers see. Only that file is replaced, by a rename, so a scan that fails half-way changes nothing for them. A
    version stays until its source is replaced once more, for those that still read it. One scan at a time may write;
    versions of scans that failed are left behind."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _hadoop(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def has(self, path: str) -> bool:
        at, files = self._hadoop(path)
        return files.exists(at)

    def current(self) -> dict:
        """versions and previous: a version for each source; schemas: one for each table."""
        if not self.has(self.at("current")):
            return {"versions": {}, "previous": {}, "schemas": {}}
        at, files = self._hadoop(self.at("current"))
        stream = files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder(self, name: str, source: str, version: str) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)
        return f"{self.at(name)}/version={version}/source={escaped}"

    def rows(self, name: str, schema: StructType, versions: dict[str, str]) -> DataFrame:
        """A table's rows of some sources, each in the version named for it."""
        paths = [p for source, version in versions.items() if self.has(p := self.folder(name, source, version))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.at(name)).parquet(*paths).select(*schema.names)

    def knows(self, name: str) -> bool:
        return name in self.current()["schemas"]

    def read(self, name: str) -> DataFrame:
        now = self.current()
        if name not in now["schemas"]:
            raise FileNotFoundError(f"{self.at(name)}: run a scan first")
        return self.rows(name, StructType.fromJson(now["schemas"][name]), now["versions"])

    def replacing(self, sources: Sequence[str]) -> Replacement:
        return Replacement(self, sources)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.at(name))

    def last_scan(self) -> dict | None:
        """The latest scan's row; None before the first."""
        if not self.has(self.at("scans")):
            return None
        return self.spark.read.parquet(self.at("scans")).orderBy("started_at", ascending=False).first().asDict()


class Replacement:
    """New rows of some sources, in all tables; readers see none of them before publish() and all of them after."""

    def __init__(self, store: Store, sources: Sequence[str]):
        self.store, self.sources, self.version, self.schemas = store, list(sources), uuid.uuid4().hex, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table's new rows and returns them as written; a source may have none."""
        df.write.partitionBy("source").parquet(f"{self.store.at(name)}/version={self.version}")
        self.schemas[name] = df.schema
        return self.store.rows(name, df.schema, dict.fromkeys(self.sources, self.version))

    def publish(self) -> None:
        store, now = self.store, self.store.current()
        gone = {s: now["previous"][s] for s in self.sources if s in now["previous"]}
        now["previous"] |= {s: now["versions"][s] for s in self.sources if s in now["versions"]}
        now["versions"] |= dict.fromkeys(self.sources, self.version)
        now["schemas"] |= {name: schema.jsonValue() for name, schema in self.schemas.items()}
        fresh, files = store._hadoop(f"{store.at('current')}.{self.version}")
        stream = files.create(fresh)
        stream.write(json.dumps(now).encode())
        stream.close()
        fs = store.spark._jvm.org.apache.hadoop.fs
        overwrite = store.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        overwrite[0] = fs.Options.Rename.OVERWRITE
        context = fs.FileContext.getFileContext(files.getUri(), store.spark._jsparkSession.sessionState().newHadoopConf())
        context.rename(files.makeQualified(fresh), files.makeQualified(store._hadoop(store.at("current"))[0]), overwrite)
        for source, version in gone.items():
            for name in now["schemas"]:
                old, files = store._hadoop(store.folder(name, source, version))
                files.delete(old, True)


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


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
