"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

Fingerprints of 64 bits link at ``DISTANCE`` (4) or fewer differing bits. Cut into three segments,
two linked fingerprints differ by at most one bit in some segment; each segment is therefore indexed
under its variants with one bit wiped out, and fingerprints that share a variant are verified.

Equal fingerprints are one node throughout. Before the variants are built, fingerprints with an equal
segment are tied to the most frequent one among them if it is near enough, and components of those links
are found; this takes care of large groups in linear work. Variants shared by one component only are
then dropped, and of the others only fingerprints outside the bucket's largest component look for partners
of other components. No link between components is lost.

Defined cases: a text without words has fingerprint 0 and is linked like any other; so does a null text;
component ids are the smallest non-null doc_id reachable (null if there is none); repeated rows are equal
fingerprints; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, checkpoint, map_columns, plain_words_of, table, written
from lodestone.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Lowest bit and number of bits of each segment; DISTANCE < 2 * segments, so one differs by a bit at most.
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    words = plain_words_of(data)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    ones, step = np.zeros(64, np.int64), 1 << 15
    for low in range(0, len(stops), step):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[low : low + step], stops[low : low + step])])  # noqa: B905
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big")


def fingerprints(df: DataFrame, carry: list[Column], text: str) -> DataFrame:
    """The columns ``carry`` (as c0, c1, ...) with ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(x) for x in as_bytes(texts)], np.uint64).view(np.int64))]

    return map_columns(df, carry, [F.col(text)], make, T.StructType([T.StructField("fp", T.LongType(), False)]))


def _segment(i: int) -> Column:
    low, bits = SEGMENTS[i]
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _key(number: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(number << 22).cast("long"))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def linked(nodes: DataFrame) -> DataFrame:
    """Rows (fp, component) of the fingerprints that have a link; ``nodes`` holds fp and copies.

    ``component`` is the least fingerprint, as a signed number, of those reachable.
    """
    exact = nodes.select("fp", "copies", F.explode(F.array(*[_key(i, _segment(i)) for i in range(len(SEGMENTS))])).alias("key"))
    hubs = exact.groupBy("key").agg(F.max(F.struct("copies", "fp")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", F.col("h.fp").alias("hub"))
    first = components(exact.join(hubs, "key").where((F.col("fp") != F.col("hub")) & _near("fp", "hub")).select("fp", "hub"), "fp", "hub")
    first = checkpoint(first.withColumnsRenamed({"node": "fp", "component": "label"}))
    sizes = first.groupBy("label").agg(F.count("*").alias("size"))
    tied = nodes.select("fp").join(first.join(sizes, "label"), "fp", "left")
    # small rows, but each has dozens of variants: spread them over all tasks
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = checkpoint(tied.select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("size", F.lit(1)).alias("size")).repartition(spread, "fp"))
    wiped = [
        _key(32 * i + bit, _segment(i).bitwiseAND(F.lit(~(1 << bit)).cast("long")))
        for i, (_, bits) in enumerate(SEGMENTS)
        for bit in range(bits)
    ]
    variants = tied.select("fp", "label", "size", F.explode(F.array(*wiped)).alias("key"))
    held = variants.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("fp"), F.max("fp").alias("fp2"), F.min("label").alias("label"), F.max("label").alias("label2"), F.max(F.struct("size", "label")).alias("most")
    )
    held = checkpoint(held.where("label != label2 and (n > 2 or bit_count(fp ^ fp2) <= " + str(DISTANCE) + ")"))
    # a bucket of two is a pair already; larger ones are joined
    pairs = held.where("n = 2").select("label", "label2")
    mixed = held.where("n > 2").select("key", F.col("most.label").alias("most"))
    rows = variants.select("key", "fp", "label")
    apart = rows.join(mixed, "key").where("label != most").select("key", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    links = rows.join(apart, "key").where((F.col("label") != F.col("label2")) & _near("fp", "fp2")).select("label", "label2")
    links = links.unionByName(pairs).distinct()
    second = components(links, "label", "label2")
    both = first.join(second, F.col("label") == F.col("node"), "left").select("fp", F.coalesce("component", "label").alias("component"))
    alone = second.join(first, F.col("node") == F.col("fp"), "left_anti").select(F.col("node").alias("fp"), "component")
    return both.unionByName(alone)


def grouped(prints: DataFrame, least: Column) -> DataFrame:
    """Rows (fp, first, copies): each fingerprint with the least value of ``least`` over its component's rows, and its own rows."""
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(least).alias("own"), F.count("*").alias("copies")))
    links = checkpoint(linked(nodes))
    of = nodes.join(links, "fp").select("fp", "component", "own")
    firsts = of.groupBy("component").agg(F.min("own").alias("first"))
    joined = links.join(firsts, "component").select("fp", "first")
    joined = joined.withColumn("known", F.lit(True))
    own = F.when(F.col("known"), F.col("first")).otherwise(F.col("own"))
    return nodes.join(joined, "fp", "left").select("fp", own.alias("first"), "copies")


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``df``: ``key``, ``fp`` (signed long) and ``component``, the smallest key reachable."""
    prints = written(fingerprints(df, [F.col(key)], text), "fingerprints")
    return _named(prints, checkpoint(grouped(prints, F.col("c0")))).select(F.col("c0").alias(key), "fp", F.col("first").alias("component"))


#: A fingerprint of more than one in ``SHARE`` rows is dealt to ``SALTS`` tasks; there are fewer than ``SHARE`` such.
SHARE, SALTS = 1_000, 64


def _named(prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row of ``prints`` with what ``groups`` has of its fingerprint; frequent fingerprints do not meet in one task."""
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hot = groups.where(F.col("copies") * SHARE > total).select("fp", F.lit(SALTS).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    salted = groups.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    rows = prints.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("c0"), salts).cast("int"))
    return rows.join(salted.select("fp", "salt", "first"), ["fp", "salt"])


def one_of_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` without those that have a near-duplicate of smaller key (null keys last).

    Of rows that share key and text one stays.
    """
    content = F.xxhash64(F.col(text))
    prints = written(fingerprints(df, [F.col(key), content], text), "fingerprints")
    order = F.struct(F.col("c0").isNull().alias("none"), F.col("c0").alias("id"), F.col("c1").alias("content"))
    firsts = grouped(prints, order).select("first").distinct()
    keep = prints.groupBy("c0", "c1").agg(F.count("*").alias("times")).select(order.alias("first"), "times").join(firsts, "first")
    keep = checkpoint(keep.select(F.col("first.none").alias("none"), F.coalesce("first.id", F.lit(0)).alias("id"), F.col("first.content").alias("content"), "times"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).isNull().alias("none"), F.coalesce(F.col(key), F.lit(0)).alias("id"), content.alias("content"))
    kept = rows.join(keep, ["none", "id", "content"])
    if not keep.where("times > 1").isEmpty():
        kept = kept.dropDuplicates(["none", "id", "content"])
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def brute_force(ids: list[int | None], prints: list[int]) -> list[int | None]:
    """The component id of each row, by comparing all pairs; for tests."""
    parent = list(range(len(ids)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= DISTANCE:
                parent[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, id_ in enumerate(ids):
        if id_ is not None:
            least[top(i)] = min(id_, least.get(top(i), id_))
    return [least.get(top(i)) for i in range(len(ids))]
