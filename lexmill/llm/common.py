"""What several training-data operators share: reading tables, the shared folder, spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexmill.functions.arrays import let, starts_of  # noqa: F401

#: ASCII white space, the only separators of words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one
    set here where the session has none (local runs and tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read back: it is computed
    once, its lineage ends here, and lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, columns: list[str]) -> str:
    """`name`, with underscores after it while a caller's column has that name."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def renamed(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str], list[str]]:
    """`docs` with columns c0, c1, ..., those names, and the names of the wanted columns:
    whatever columns a caller has, none clashes with one that an operator adds."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, [names[docs.columns.index(w)] for w in wanted]


def slices(batch: pa.RecordBatch, column: int, rows: int = 1000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and, unless it is one row, about `size` bytes of a
    column: very long texts don't meet in one worker's memory."""
    import pyarrow.compute as pc  # in workers only: the driver needs none of it

    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and (total + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)
