"""A table of rows by key in shared storage, changed by the rows that change.

A change writes its own rows, dealt to buckets by a hash of the key, and then a commit: a small file that names, for each
bucket, the versions that hold its rows. Whoever reads takes the last commit, so a change is seen whole or not at all, and a
job that dies in between leaves nothing but files that no commit names. Of several versions of a key the last one counts; a
bucket with MOST versions is written anew with the change that finds it so, the others are left alone.

Of two writers that start from one commit, the second one's commit fails (`Conflict`), and its change is to be made again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, MOST = 32, 6
DELETED, VERSION, BUCKET = "_deleted", "_version", "_bucket"


class Conflict(RuntimeError):
    """Another writer committed first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], buckets: int = BUCKETS, most: int = MOST) -> None:
        """schema: the rows' own, key included. The number of buckets stays what it was when the table was begun."""
        self.spark, self.path, self.key, self.most = spark, path.rstrip("/"), key, most
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self.manifest().get("buckets_in_all", buckets)

    def manifest(self, version: int | None = None) -> dict:
        """The commit of a version, or the last one: version, and each bucket's versions."""
        last = self.versions()[-1:] if version is None else [version]
        if not last:
            return {"version": 0, "buckets": {}}
        stream = self._fs.open(self._path(self._commit(last[0])))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/commits")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")) if self._fs.exists(at) else []

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of the same key, all columns at once. A key must be once among them. The version that this made."""
        return self._change(rows.select(*self.schema.fieldNames()).withColumn(DELETED, F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        rows = keys.select(*self.key).distinct()
        return self._change(rows.select(*[F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(True).alias(DELETED)))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, as of a version or the last one."""
        return self._rows(self.manifest(version)["buckets"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only the buckets that these lie in are read."""
        own = keys.select(*self.key).distinct()
        return self.beside(own).join(own, self.key, "left_semi")

    def beside(self, keys: DataFrame) -> DataFrame:
        """All rows of the buckets that some keys lie in, for those who join them by key anyway. An empty table asks for no keys."""
        held = self.manifest()["buckets"]
        # A row for each bucket at most.
        wanted = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()} if held else set()
        return self._rows({b: v for b, v in held.items() if b in wanted})

    def bytes_of(self, version: int) -> int:
        """Bytes of data that a version's change wrote."""
        return self._fs.getContentSummary(self._path(self._data(self.manifest(version)["data"]))).getLength()

    def vacuum(self) -> list[str]:
        """Delete data that the last commit doesn't name and commits before it; older versions can't be read any more.

        Data of a version that isn't committed yet stays, for its writer may be at work.
        """
        last = self.manifest()
        named = {v.split("/")[0] for vs in last["buckets"].values() for v in vs}
        there = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/data"))]
        gone = [v for v in there if v not in named and int(v.split("-")[0]) <= last["version"]]
        for v in gone:
            self._fs.delete(self._path(self._data(v)), True)
        for v in self.versions()[:-1]:
            self._fs.delete(self._path(self._commit(v)), False)
        return gone

    def _change(self, rows: DataFrame) -> int:
        before = self.manifest()
        version = before["version"] + 1
        rows = rows.withColumn(BUCKET, self._bucket()).withColumn(VERSION, F.lit(version).cast("long"))
        # A name of its own, so that two writers of one version don't meet.
        name = f"{version}-{uuid.uuid4().hex[:12]}"
        at = self._data(name)
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(at)
        touched = self._written(at)
        held = {b: list(vs) for b, vs in before["buckets"].items()}
        full = [b for b in touched if len(held.get(b, [])) + 1 >= self.most]
        for b in touched:
            held.setdefault(b, []).append(name)
        if full:
            anew, inner = f"{at}/anew", self._rows({b: held[b] for b in full})
            inner.withColumn(DELETED, F.lit(False)).withColumn(VERSION, F.lit(version).cast("long")).withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(anew)
            whole = self._written(anew)
            for b in full:
                held[b] = [f"{name}/anew"] if b in whole else []
        self._commit_as(version, {"version": version, "data": name, "buckets_in_all": self.buckets, "buckets": {b: vs for b, vs in held.items() if vs}})
        return version

    def _rows(self, buckets: dict[str, list]) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType()), T.StructField(VERSION, T.LongType())])
        read = lambda own: self.spark.read.schema(stored).parquet(*[f"{self._data(v)}/{BUCKET}={b}" for b, vs in own.items() for v in vs])
        single, several = ({b: vs for b, vs in buckets.items() if (len(vs) > 1) == many} for many in (False, True))
        parts = []
        if single:
            parts.append(read(single))
        if several:
            newest = Window.partitionBy(*self.key).orderBy(F.desc(VERSION))
            parts.append(read(several).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank"))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.where(~F.col(DELETED)).select(*self.schema.fieldNames())

    def _written(self, at: str) -> list[str]:
        return [f.getPath().getName().split("=")[1] for f in self._fs.listStatus(self._path(at)) if f.isDirectory() and f.getPath().getName().startswith(f"{BUCKET}=")]

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _data(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def _commit(self, version: int) -> str:
        return f"{self.path}/commits/{version:012d}.json"

    def _commit_as(self, version: int, content: dict) -> None:
        """Written aside, then renamed to a name that must be free."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        aside = self._path(f"{self.path}/commits/.{version:012d}.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path(self._commit(version)), none)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise
