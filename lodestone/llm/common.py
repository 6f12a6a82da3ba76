"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and blanks every other ASCII byte that is not a letter or a digit.
WORD_TABLE = bytes(
    b if b >= 128 else (b + 32 if 65 <= b <= 90 else (b if b in _ALNUM else 32)) for b in range(256)
)
#: Lower-cases A-Z only.
LOWER_TABLE = bytes.maketrans(*_LOWER)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z."""
    return text.translate(WORD_TABLE).split()


def plain_words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text after lower-casing A-Z."""
    return text.translate(LOWER_TABLE).split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty; no decoding takes place."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: Rows that go to Python at a time. Spark's default of ten thousand whole texts and their words is too much for a worker.
BATCH_ROWS = 1_000


def modest_batches(spark: SparkSession) -> None:
    """Send at most ``BATCH_ROWS`` rows to Python at a time, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def map_columns(
    df: DataFrame,
    carry: Sequence[Column],
    inputs: Sequence[Column],
    make: Callable[[], Callable[..., list[pa.Array]]],
    schema: T.StructType,
) -> DataFrame:
    """Add the columns of ``schema`` to ``carry``, computed batch by batch from ``inputs``.

    ``make`` runs once in each task and gives the function from input columns to
    output columns. Columns travel under positional names, so those of ``df`` cannot
    clash with those of ``schema``.
    """
    modest_batches(df.sparkSession)
    narrow = df.select(*[c.alias(f"c{i}") for i, c in enumerate(carry)], *[c.alias(f"i{i}") for i, c in enumerate(inputs)])
    n = len(carry)
    out = T.StructType(narrow.schema.fields[:n] + schema.fields)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + fn(*batch.columns[n:]), names=names)

    return narrow.mapInArrow(run, out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, but only if Spark runs on one machine.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        current = context._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table that ``written`` made for ``df``, which must not be read any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
