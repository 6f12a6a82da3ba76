"""Queries meet all chunks: batches of chunks against the whole set, or a grid of tiles where the set is large.

What becomes of a pair is up to a reducer, which takes batches of chunks and gives the rows that it keeps: a
task, or a cell of the grid, sends on what one reducer keeps, whatever the number of chunks it has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Query sets of more bytes are dealt to a grid instead of sent to every task.
MAX_BROADCAST_BYTES = 64 << 20
#: Bytes of queries, and of chunks, that meet in a cell of the grid.
TILE_BYTES = 32 << 20
#: The same where a cell's pairs are all sent on.
PAIR_TILE_BYTES = 1 << 20


#: Numbers in a matrix of queries and chunks at a time; a reducer holds a dozen such matrices or more.
CELLS = 1 << 20
#: Bytes of chunks that go to a worker at a time, and Spark's own choice, which is replaced by it.
BATCH_BYTES, SPARK_BATCH_BYTES = 8 << 20, "67108864b"


class Reducer(Protocol):
    #: Whether rows are given up after every batch, as they are the result and not a choice from it.
    streams: bool
    #: Chunks that it takes at a time, so that what it works out for all its queries stays small.
    at_once: int

    def add(self, chunks: pa.Table) -> None: ...

    def rows(self) -> pa.Table: ...


def width(column: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory, from its sizes alone."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(column, F.lit(16).cast("long"), lambda n, x: n + width(x, inner)), F.lit(16).cast("long"))
        return F.greatest(F.size(column), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, [width(column[f.name], f.dataType) for f in kind.fields], F.lit(8).cast("long"))
    if isinstance(kind, T.MapType):
        return width(F.map_values(column), T.ArrayType(kind.valueType)) + width(F.map_keys(column), T.ArrayType(kind.keyType))
    return F.lit(8).cast("long")


def sizes(rows: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    return reduce(Column.__add__, [width(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields], F.lit(16).cast("long"))


def _total(rows: DataFrame) -> tuple[int, int]:
    total = rows.agg(F.sum(sizes(rows)), F.count("*")).first()
    return total[0] or 0, total[1]


def _parts(table: pa.Table, reducer: Reducer) -> Iterator[pa.Table]:
    most = getattr(reducer, "at_once", 0) or max(1, table.num_rows)
    for i in range(0, table.num_rows, most):
        yield table.slice(i, most).combine_chunks()


def at_once(queries: int) -> int:
    """How many chunks meet so many queries, or vectors of queries, at a time."""
    return max(16, CELLS // max(1, queries))


def modest_batches(spark: SparkSession) -> None:
    """Send at most ``BATCH_BYTES`` to Python at a time, unless the session asks for other batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARK_BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def reduced(chunks: DataFrame, queries: DataFrame, make: Callable[[pa.Table], Reducer], schema: str, *, limit: int = MAX_BROADCAST_BYTES, tile: int = TILE_BYTES) -> DataFrame:
    """Rows that reducers of all queries and parts of the chunks keep.

    The first column of both tables is their key, which must not be null. Queries of at most ``limit`` bytes are sent to every task; of more,
    tiles of queries and tiles of chunks meet in the cells of a grid, so a query is shuffled once for each tile of chunks and the other way round.
    """
    modest_batches(chunks.sparkSession)
    total, n = _total(queries)
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    typed = lambda rows: rows.select(kind.names).cast(kind) if rows.num_columns else kind.empty_table()
    if total <= limit:
        sent = chunks.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reducer = make(sent.value)
            for batch in batches:
                for part in _parts(pa.Table.from_batches([batch]), reducer):
                    reducer.add(part)
                    if getattr(reducer, "streams", False):
                        yield from typed(reducer.rows()).to_batches()
            yield from typed(reducer.rows()).to_batches()

        return chunks.mapInArrow(run, schema)
    across = max(1, min(n, -(-total // tile)))
    down = max(1, -(-_total(chunks)[0] // tile))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda df, n: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")
    asked = queries.withColumn("_t", part(queries, across)).withColumn("_c", every(down))
    met = chunks.withColumn("_c", part(chunks, down)).withColumn("_t", every(across))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        reducer = make(left.drop_columns(["_t", "_c"]))
        for some in _parts(right.drop_columns(["_t", "_c"]), reducer) if left.num_rows else ():
            reducer.add(some)
        return typed(reducer.rows())

    return asked.groupBy("_t", "_c").cogroup(met.groupBy("_t", "_c")).applyInArrow(cell, schema)
