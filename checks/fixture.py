"""The matching tables derived from the driver's parquet tables.

The SQL twin of every view is in ``views_sql``; ``FIXTURES.md`` states the mapping.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators.ingest import first_per_key
from matchspark.operators.matching import derive_matches
from matchspark.plans.materialize import materialize, new_folder, scratch
from matchspark.sources.tables import conform, load_tables, write_tables

NOW = "2024-02-10 00:00:00"
#: What the fixture reads of an order line and its order.
LINE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
    "o_custkey",
]


def padded(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.lpad(key.cast("string"), 10, "0")


def ident(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix + "_"), padded(key))


def timestamp_ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def spread(df: DataFrame, by: str) -> DataFrame:
    """A task per core for an input read in fewer splits than cores; no change at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if df.rdd.getNumPartitions() < cores else df


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def suppliers(self) -> int:
        return self.raw("supplier").count()

    names = (
        "users",
        "refresh_tokens",
        "candidates",
        "recruiters",
        "positions",
        "embeddings",
        "recommendations",
        "reactions",
        "matches",
    )

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.names}

    @property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            ident("usr", key).alias("id"),
            F.when(key % 3 == 0, "apple").otherwise("google").alias("provider"),
            F.concat(F.lit("p-"), key.cast("string")).alias("provider_user_id"),
            F.when(
                key % 7 != 0, F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com"))
            ).alias("email"),
            F.col("c_name").alias("full_name"),
        )

    @property
    def candidates(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.raw("customer")
            .filter(key % 10 != 9)
            .select(
                ident("can", key).alias("id"),
                ident("usr", key).alias("user_id"),
                F.col("c_mktsegment").alias("about"),
            )
        )

    @property
    def recruiters(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            ident("rec", key).alias("id"),
            ident("usr", F.when(key % 10 == 1, key - 1).otherwise(key)).alias("user_id"),
        )

    @property
    def positions(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            ident("pos", key).alias("id"),
            ident("rec", key % self.suppliers).alias("recruiter_id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("description"),
            F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("company"),
        )

    @property
    def line_orders(self) -> DataFrame:
        return (
            spread(self.raw("lineitem"), "l_orderkey")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .filter(F.col("o_custkey") % 10 != 9)
        )

    @property
    def recommendation_batch(self) -> DataFrame:
        """One row per order line, so a pair may occur many times."""
        return self.line_orders.select(
            self.pair_id().alias("id"),
            ident("pos", "l_partkey").alias("position_id"),
            ident("can", "o_custkey").alias("candidate_id"),
            F.round(F.abs("l_discount") * 10, 1).cast("decimal(3,2)").alias("score"),
            self.line_key().alias("seq"),
        )

    @staticmethod
    def pair_id() -> Column:
        return F.concat(F.lit("rcm_"), padded("l_partkey"), padded("o_custkey"))

    @staticmethod
    def line_key() -> Column:
        """A text unique per order line."""
        return F.concat_ws(
            "-",
            padded("l_orderkey"),
            F.col("l_linenumber").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_extendedprice").cast("decimal(12,2)").cast("string"),
        )

    @property
    def recommendations(self) -> DataFrame:
        return (
            self.line_orders.groupBy("l_partkey", "o_custkey")
            .agg(F.max(F.abs("l_discount")).alias("d"))
            .select(
                self.pair_id().alias("id"),
                ident("pos", "l_partkey").alias("position_id"),
                ident("can", "o_custkey").alias("candidate_id"),
                F.round(F.col("d") * 10, 1).cast("decimal(3,2)").alias("score"),
            )
        )

    @property
    def reaction_sides(self) -> DataFrame:
        """Order lines once per side that reacted: 0 the candidate, 1 the recruiter."""
        sides = F.array_compact(
            F.array(
                F.when(F.col("l_quantity") > 20, F.lit(0)),
                F.when(F.col("l_quantity") <= 35, F.lit(1)),
            )
        )
        flag = F.col("l_returnflag")
        candidate = F.when(flag == "A", "positive").when(flag == "R", "negative")
        recruiter = F.when(F.col("l_linestatus") == "O", "positive").otherwise("negative")
        return self.line_orders.withColumn("side", F.explode(sides)).withColumn(
            "reaction_type",
            F.when(F.col("side") == 0, candidate.otherwise("neutral")).otherwise(recruiter),
        )

    def as_reactions(self, sides: DataFrame) -> DataFrame:
        candidate = F.col("side") == 0
        return sides.select(
            self.pair_id().alias("recommendation_id"),
            F.when(candidate, "candidate").otherwise("recruiter").alias("reactor_type"),
            F.when(candidate, ident("can", "o_custkey"))
            .otherwise(ident("rec", F.col("l_partkey") % self.suppliers))
            .alias("reactor_id"),
            "reaction_type",
            F.col("l_shipdate").alias("created_at"),
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            "l_extendedprice",
            self.line_key().alias("seq"),
        )

    @property
    def reaction_log(self) -> DataFrame:
        return self.as_reactions(self.reaction_sides)

    @property
    def reactions(self) -> DataFrame:
        """The first of each key, found on the numeric keys before the ids are written out."""
        order = ["l_shipdate", *REACTION_ORDER[1:]]
        firsts = first_per_key(self.reaction_sides, ["l_partkey", "o_custkey", "side"], order)
        return self.as_reactions(firsts).select(
            "recommendation_id", "reactor_type", "reactor_id", "reaction_type", "created_at"
        )

    @property
    def embeddings(self) -> DataFrame:
        vec, last = F.col("vec_id"), F.col("vec_id") % 10
        even = vec % 2 == 0
        status = (
            F.when(last.isin(3, 8), "failed").when(last.isin(6, 7), "pending").otherwise("done")
        )
        return (
            self.raw("embeddings")
            .withColumn("status", status)
            .select(
                F.when(even, ident("can", F.floor(vec / 2)))
                .otherwise(ident("pos", F.floor((vec - 1) / 2)))
                .alias("object_id"),
                F.when(even, "candidate").otherwise("position").alias("object_type"),
                F.when(F.col("status") == "done", F.col("embedding")).alias("embedding"),
                "status",
            )
        )

    @property
    def refresh_tokens(self) -> DataFrame:
        key = F.col("event_id")
        return (
            self.raw("events")
            .filter(F.col("event_type") == "signup")
            .select(
                ident("rtk", key).alias("jti"),
                ident("usr", "user_id").alias("user_id"),
                (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
                F.when(key % 97 != 0, key % 10 == 0).alias("revoked"),
            )
        )

    @property
    def matches(self) -> DataFrame:
        return derive_matches(self.reactions, self.recommendations, self.positions)

    @property
    def sign_ins(self) -> DataFrame:
        user = F.col("user_id")
        text = user.cast("string")
        return (
            self.raw("events")
            .filter(F.col("event_type") == "click")
            .select(
                F.col("event_id").alias("seq"),
                F.when(user % 3 == 0, "apple").otherwise("google").alias("provider"),
                F.when(user % 11 == 0, F.concat(F.lit("x-"), text))
                .otherwise(F.concat(F.lit("p-"), text))
                .alias("provider_user_id"),
            )
        )


class OnceFixture(Fixture):
    """Order lines joined and written once, for queries that read them several times.

    With ``tables`` the recommendations and reactions made of them are written once as well.
    """

    def __init__(self, fx: Fixture, tables: bool = False):
        super().__init__(fx.spark, fx.sf_dir)
        self.once = tables

    @cached_property
    def line_orders(self) -> DataFrame:
        return materialize(super().line_orders.select(*LINE_COLUMNS), "line-orders")

    @cached_property
    def recommendations(self) -> DataFrame:
        made = super().recommendations
        return materialize(made, "recommendations") if self.once else made

    @cached_property
    def reactions(self) -> DataFrame:
        made = super().reactions
        return materialize(made, "reactions") if self.once else made


@contextmanager
def written_pair(fx: Fixture) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Recommendations and reactions, both written for the block; their order lines only while they are made."""
    once = OnceFixture(fx)
    with ExitStack() as kept:
        with scratch(fx.line_orders.select(*LINE_COLUMNS), "line-orders") as once.line_orders:
            pair = tuple(kept.enter_context(scratch(getattr(once, name), name)) for name in ("recommendations", "reactions"))
        yield pair


class LoadedFixture(Fixture):
    """The matching tables as stored tables, written once instead of derived per query."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        super().__init__(spark, sf_dir)
        self.loaded = load_tables(spark, root, views=False)

    def _table(name: str):
        def stored(self) -> DataFrame:
            return self.loaded[name].select(*getattr(super(LoadedFixture, self), name).columns)

        return property(stored)

    users = _table("users")
    refresh_tokens = _table("refresh_tokens")
    candidates = _table("candidates")
    recruiters = _table("recruiters")
    positions = _table("positions")
    embeddings = _table("embeddings")
    recommendations = _table("recommendations")
    reactions = _table("reactions")
    matches = _table("matches")


def store_tables(spark: SparkSession, sf_dir: str) -> str:
    """Write the nine tables of a fixture; their folder.  The matches come from the tables written first."""
    root = new_folder(spark, "tables")
    fx = OnceFixture(Fixture(spark, sf_dir))
    made = {name: conform(name, getattr(fx, name)) for name in fx.names if name != "matches"}
    write_tables(made, root)
    kept = load_tables(spark, root, ["reactions", "recommendations", "positions"], views=False)
    write_tables({"matches": conform("matches", derive_matches(**kept))}, root)
    return root


REACTION_ORDER = [
    "created_at",
    "l_orderkey",
    "l_linenumber",
    "l_suppkey",
    "l_extendedprice",
    "reaction_type",
]
