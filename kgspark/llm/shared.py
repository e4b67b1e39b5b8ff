"""Helpers that every operator of this subpackage uses: shared storage, table reading, Arrow access."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of an Arrow batch sent to Python; texts may be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 256
#: Bytes of a string column that are turned to Python objects at once.
SLICE_BYTES = 1 << 21


def prepare(spark: SparkSession) -> None:
    """Session settings for Arrow exchange of long texts, and the package on the workers' path."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is made only where it is unset and one machine runs everything."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again.

    A lost executor costs a re-read, not a recomputation. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once all that is made from them has been written itself."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def sliced(rows: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose strings have at most `most` bytes, or which are single rows; no bytes are copied."""
    for b in rows:
        _, off, _ = b.column(column).buffers()
        if off is None or b.num_rows < 2:
            yield b
            continue
        wide = pa.types.is_large_string(b.schema.field(column).type) or pa.types.is_large_binary(b.schema.field(column).type)
        ends = np.frombuffer(off, np.int64 if wide else np.int32)[b.column(column).offset :][: b.num_rows + 1].astype(np.int64)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
            yield b.slice(a, z - a)
            a = z
    pa.default_memory_pool().release_unused()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df, whatever it has, doesn't have: the wanted ones, with as many underscores as it takes."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, text_col: str, build) -> DataFrame:
    """The rows of docs, all columns as they are, for which the task's function says so: build() -> (texts -> mask)."""
    names = docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, at = build(), names.index(text_col)
        for b in sliced(rows, at):
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(np.asarray(keep(texts), bool)))

    return docs.mapInArrow(run, docs.schema)


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without copying, and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read once on the driver and shipped with the tasks: workers need no such file."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer_path(name: str) -> str:
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Pack dictionaries to record batches of at most `size` rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
