"""Insert-ignore that reads only the stored files that may hold a key of the batch.

The table is a folder of runs, one for each append: ``rows/run=<name>/part=<n>``, where the part is
a hash of the key.  Beside it lie the runs' Bloom sketches, ``sketches/run=<name>``: per part,
blocks of 32,768 bits, ``HASHES`` of them set for a key and at least 32 there for each.  Sketches are
merged by OR, so tasks make them of any share of the rows.

A batch is hashed once and meets the blocks of its own parts and keys.  Files of a (run, part) none of
whose sketches holds a key are not opened.  A probe reads four to eight bytes for every stored key
instead of the key itself.  A key that is not stored passes a run's sketch about once in
170,000 times, and costs reading a part that was not needed; no stored key is missed.

Runs grow in number with the appends; ``compact`` makes a table with one run of them.  The driver gets
names only: of the runs, and of the (run, part) pairs to read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from matchspark.operators.ingest import insert_ignore

#: Folders of a run.  A table keeps the number that it was first written with.
PARTS = 64
HASHES = 8
BLOCK_BITS = 1 << 15
BLOCK_KEYS = BLOCK_BITS // 32
_WORDS = BLOCK_BITS // 64

SKETCH = "part int, blocks long, block long, words array<bigint>, run string"


def part_of(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def block_of(key: list[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit("block")), blocks)


def bits_of(key: list[str]) -> list[Column]:
    """The bits of a key within its block."""
    return [F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(HASHES)]


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)))


def sketch(rows: DataFrame, key: list[str], parts: int = PARTS, blocks: int | None = None) -> DataFrame:
    """(part, blocks, block, words): the sketch of rows, with ``blocks`` blocks a part.

    Sketches of equal ``parts`` and ``blocks`` are merged by ``merge``.  The default leaves every key 32
    bits: keys of a table are unique, so its parts and blocks are even.
    """
    if blocks is None:
        each, blocks = rows.count() / parts, 1
        while blocks * BLOCK_KEYS < each:
            blocks *= 2
    bits = rows.select(
        part_of(key, parts).alias("part"),
        block_of(key, F.lit(blocks)).alias("block"),
        F.explode(F.array(*bits_of(key))).alias("bit"),
    )
    # The OR of single words is compiled code and mostly done before the shuffle.
    word = F.shiftright("bit", 6).alias("word")
    words = bits.groupBy("part", "block", word).agg(F.bit_or(_mask(F.col("bit"))).alias("bits"))
    return _gathered(words, F.lit(blocks).cast("long").alias("blocks"))


def merge(sketches: DataFrame) -> DataFrame:
    """One sketch of several of the same shape."""
    words = sketches.select("part", "blocks", "block", F.posexplode("words").alias("word", "bits"))
    words = words.groupBy("part", "blocks", "block", "word").agg(F.bit_or("bits").alias("bits"))
    return _gathered(words, F.col("blocks"))


def _gathered(words: DataFrame, blocks: Column) -> DataFrame:
    """The words of each block as one array, zero where no bit is set."""
    rows = words.select("part", blocks, "block", F.struct("word", "bits").alias("entry"))
    set_words = rows.groupBy("part", "blocks", "block").agg(
        F.map_from_entries(F.collect_list("entry")).alias("entries")
    )
    every = F.sequence(F.lit(0), F.lit(_WORDS - 1))
    return set_words.select(
        "part",
        "blocks",
        "block",
        F.transform(every, lambda w: F.coalesce(F.element_at("entries", w), F.lit(0).cast("bigint"))).alias("words"),
    )


def append(rows: DataFrame, key: list[str], path: str, run: str, parts: int = PARTS) -> None:
    """Store ``rows`` as the run ``run`` with its sketch; the same run written again replaces it.

    The sketch is taken back first and written last.  A run without one is read whole, so that a
    job that ends in between costs time and no rows.
    """
    spark = rows.sparkSession
    folder, beside = f"{path}/rows/run={run}", f"{path}/sketches/run={run}"
    shape = T._parse_datatype_string(SKETCH)
    spark.createDataFrame([], shape).drop("run").write.mode("overwrite").parquet(beside)
    placed = rows.withColumn("part", part_of(key, parts))
    placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
    written = spark.read.schema(placed.schema).parquet(folder)
    sketch(written, key, parts).write.mode("overwrite").parquet(beside)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the table, with ``part`` and ``run``; none if it does not exist yet."""
    shape = T.StructType([*schema.fields, *T._parse_datatype_string("part int, run string").fields])
    return _read(spark, f"{path}/rows", shape)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parts_to_read(batch: DataFrame, key: list[str], path: str, parts: int = PARTS) -> tuple[list[str], list[str]]:
    """The runs that have sketches, and the "run/part" names of these that may hold a key of ``batch``."""
    sketches = _read(batch.sparkSession, f"{path}/sketches", T._parse_datatype_string(SKETCH))
    shapes = sketches.select("run", "blocks").distinct().collect()
    sizes = sorted({r["blocks"] for r in shapes})
    if not sizes:
        return [], []
    asked = batch.select(*key).distinct().select(
        part_of(key, parts).alias("part"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("blocks"), block_of(key, F.lit(n)).alias("block")) for n in sizes])).alias("at"),
        F.array(*bits_of(key)).alias("bits"),
    )
    asked = asked.select("part", "at.*", "bits")

    def is_set(bit: Column) -> Column:
        word = F.element_at("words", F.shiftright(bit, 6) + 1)
        return word.bitwiseAND(_mask(bit)) != 0

    held = reduce(and_, [is_set(F.col("bits")[i]) for i in range(HASHES)])
    met = sketches.join(asked, ["part", "blocks", "block"]).filter(held)
    names = met.select(F.concat_ws("/", "run", "part").alias("name")).distinct()
    return sorted({r["run"] for r in shapes}), sorted(r["name"] for r in names.collect())


def may_hold(batch: DataFrame, key: list[str], path: str, schema: T.StructType, parts: int = PARTS) -> DataFrame:
    """The stored rows in the files that may hold a key of ``batch``."""
    sketched, names = parts_to_read(batch, key, path, parts)
    # Both conditions are on folder names, so other folders are not opened.
    chosen = ~F.col("run").isin(sketched) | F.concat_ws("/", "run", "part").isin(names)
    return stored(batch.sparkSession, path, schema).filter(chosen).drop("part", "run")


def insert_pruned(
    batch: DataFrame,
    path: str,
    key: list[str],
    order: list[str],
    schema: T.StructType,
    seq: list[str] | None = None,
    optional: str | None = None,
    parts: int = PARTS,
) -> DataFrame:
    """``ingest.insert_ignore`` of the batch into the table at ``path``, with the same outcomes.

    ``schema`` is that of the stored rows.  The batch is read several times, so it should be a
    stored table.  Append the accepted rows with ``append`` under a run name of their own.
    """
    return insert_ignore(may_hold(batch, key, path, schema, parts), batch, key, order, seq, optional)


def compact(spark: SparkSession, path: str, key: list[str], schema: T.StructType, new_path: str, run: str, parts: int = PARTS) -> None:
    """A new table of the same rows as one run."""
    append(stored(spark, path, schema).drop("part", "run"), key, new_path, run, parts)
