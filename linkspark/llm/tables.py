"""Shared helpers: reading tables, writing intermediate tables, walking over text in Arrow batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text that a worker handles at once; a longer document is handled alone.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and its Python workers, in place of Spark's 64 MB; a longer row is a batch alone.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _SPARK_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folders of intermediate tables.
_STORED = re.compile("/linkspark-llm-[^/]+/table$")
#: Spark's own switch for releasing shuffle files at the end of a query.
_RELEASE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Texts travel in small batches, unless the session has a size of its own: each batch is held several times over."""
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is not None and now.rstrip("b") == str(_SPARK_BATCH):
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors reach: under ``spark.checkpoint.dir``, or local in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="linkspark-llm-")
    return f"{base.rstrip('/')}/linkspark-llm-{uuid4().hex}"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside release their shuffle files when they end."""
    kept = spark.conf.get(_RELEASE_SETTING, None)
    spark.conf.set(_RELEASE_SETTING, "true")
    try:
        yield
    finally:
        if kept is None:
            spark.conf.unset(_RELEASE_SETTING)
        else:
            spark.conf.set(_RELEASE_SETTING, kept)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back: work is done once and survives lost executors.

    The shuffle files of the write are released when it ends; nothing needs them once the table is there.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/table"
    with releasing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`stored` returned and that no later query reads; other tables are left alone.

    Else all intermediate tables of a run stay on disk together until its session ends.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if _STORED.search(path):
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def collected(df: DataFrame) -> list[Row]:
    """The rows of a table of bounded size; the shuffle files that it took are released, as those of :func:`stored`."""
    with releasing(df.sparkSession):
        # a query of its own: the setting counts when a query is made
        return df.select("*").collect()


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows with about ``most`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end, data[ends[at] : ends[end]], ends[at : end + 1] - ends[at]
        at = end


def per_text(
    docs: DataFrame, keep: list[str], schema: str, fn: Callable[[list], Iterable[tuple]], text: str = "text"
) -> DataFrame:
    """Columns ``keep`` and the columns of ``schema``, which ``fn`` returns as a tuple for each text (or None)."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    added = to_arrow_schema(StructType.fromDDL(schema))
    out = StructType([*kept.schema[: len(keep)], *StructType.fromDDL(schema)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = zip(*fn(batch.column(len(keep)).to_pylist()), strict=True)
                arrays = [batch.column(i) for i in range(len(keep))]
                arrays += [pa.array(list(c), f.type) for c, f in zip(rows, added, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added.names])

    return kept.mapInArrow(run, out)


def plain_names(docs: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """``docs`` with all but the ``wanted`` columns renamed by position, so that they clash with no name of an operator."""
    return docs.toDF(*[c if c in wanted else f"_c{i}" for i, c in enumerate(docs.columns)])


def held_out(doc_id="doc_id"):
    """Rows set aside for testing: the checksum of the id's text leaves no remainder by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
