"""Bulk inserts as DataFrame jobs.

Every insert takes the stored table and a batch and returns the batch with an
``outcome`` column; ``accepted`` rows are then appended by the caller.  A batch
carries ``seq`` columns that are unique per row and give its order.

Rows are classified by joining on ``seq``, never by grouping whole rows by the
conflict key: one key may hold any share of a batch, and only its winner travels.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions.ids import derived_id
from matchspark.functions.roles import REFRESH_SECONDS
from matchspark.plans.materialize import materialize

ACCEPTED = "accepted"
EXISTS = "already_exists"


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; every map task passes on one row per key at most."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def accepted_rows(
    target: DataFrame,
    batch: DataFrame,
    key: list[str],
    order: list[str],
    optional: str | None = None,
) -> DataFrame:
    """Batch rows that an insert-ignore stores: first per key, key not stored yet.

    ``optional`` names a key column that may be NULL; such a row conflicts with
    nothing, so it is grouped by its own order columns.
    """
    group = key
    if optional:
        batch = batch.withColumn("_alone", F.when(F.col(optional).isNull(), F.struct(*order)))
        group = [*key, "_alone"]
    firsts = first_per_key(batch, group, order).drop("_alone")
    return firsts.join(target.select(*key), key, "left_anti")


def insert_ignore(
    target: DataFrame,
    batch: DataFrame,
    key: list[str],
    order: list[str],
    seq: list[str] | None = None,
    optional: str | None = None,
) -> DataFrame:
    """The batch with ``outcome``: accepted, or already_exists (stored or earlier in the batch).

    ``seq`` identifies a batch row (default: the order columns).
    """
    seq = seq or order
    narrow = batch.select(*dict.fromkeys(key + order + seq))
    kept = accepted_rows(target, narrow, key, order, optional)
    kept = kept.select(*[F.col(c).alias(f"_{c}") for c in seq], F.lit(ACCEPTED).alias("outcome"))
    same = reduce(and_, [batch[c].eqNullSafe(kept[f"_{c}"]) for c in seq])
    joined = batch.join(kept, same, "left").drop(*[f"_{c}" for c in seq])
    return joined.withColumn("outcome", F.coalesce("outcome", F.lit(EXISTS)))


def accepted(outcome: DataFrame) -> DataFrame:
    return outcome.filter(F.col("outcome") == ACCEPTED).drop("outcome")


REACTION_KEY = ["recommendation_id", "reactor_type", "reactor_id"]


def ingest_reactions(
    reactions: DataFrame, batch: DataFrame, order: list[str], seq: list[str] | None = None
) -> DataFrame:
    """First write wins; a stored reaction never changes."""
    return insert_ignore(reactions, batch, REACTION_KEY, order, seq)


def ingest_recommendations(
    recommendations: DataFrame, batch: DataFrame, order: list[str], seq: list[str] | None = None
) -> DataFrame:
    """Unique per (position, candidate); the score must be supplied."""
    if "score" not in batch.columns:
        raise ValueError("recommendations need a score")
    return insert_ignore(recommendations, batch, ["position_id", "candidate_id"], order, seq)


def ingest_candidates(
    candidates: DataFrame, batch: DataFrame, order: list[str], seq: list[str] | None = None
) -> DataFrame:
    """One candidate per user.  Queue the accepted rows with ``vectors.enqueue_embeddings``."""
    return insert_ignore(candidates, batch, ["user_id"], order, seq)


def ingest_recruiters(recruiters: DataFrame, batch: DataFrame) -> DataFrame:
    """No key but the id: every row is stored."""
    return recruiters.unionByName(batch.select(*recruiters.columns))


def ingest_positions(
    positions: DataFrame, batch: DataFrame, order: list[str], seq: list[str] | None = None
) -> DataFrame:
    """Unique (title, description, company); a NULL company conflicts with nothing."""
    return insert_ignore(positions, batch, ["title", "description", "company"], order, seq, "company")


def ingest_refresh_tokens(sessions: DataFrame, at: str, seed: str = "") -> DataFrame:
    """New sessions: (jti, user_id, expires_at, revoked) for (seq, user_id, ``at``).

    The id is derived from (seed, seq), so a repeated run gives the same sessions.
    """
    return sessions.select(
        derived_id("rtk", F.col(at), F.col("seq").cast("string"), seed=seed).alias("jti"),
        "user_id",
        (F.col(at) + F.expr(f"INTERVAL {REFRESH_SECONDS} SECONDS")).alias("expires_at"),
        F.lit(False).alias("revoked"),
    )


PROVIDER_KEY = ["provider", "provider_user_id"]
#: Rounds that accept first rows only; few chains are left then, and they are decided whole.
PLAIN_ROUNDS = 3


def ingest_users(users: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Two unique keys, with the result of inserting the rows one by one in ``seq`` order.

    Outcomes: accepted, duplicate_provider_key, duplicate_user_name (the provider
    key is reported where both hold).  A row refused for one key must not block
    others on its second key, so rows are decided in rounds: what shares a key with
    a stored row is refused, a row that is the first open one under both its keys is
    accepted.  A row with one earlier open row under its keys is accepted exactly if that one
    is not, so what is left after ``PLAIN_ROUNDS`` rounds is decided by whole chains of such
    rows (``_forced``): a chain of n rows takes one round of about log2 n steps.  Only rows
    that wait for two others need another round.  Without conflicts one round does.
    """
    columns = [seq, *PROVIDER_KEY, "user_name"]
    stored = users.select(F.lit(None).cast(batch.schema[seq].dataType).alias(seq), *columns[1:])
    open_rows, taken = batch.select(*columns), stored
    holders = [stored]
    while True:
        state = materialize(_decide(open_rows, taken, seq, len(holders) > PLAIN_ROUNDS), "users")
        taken = state.filter("won").select(*columns)
        holders.append(taken)
        open_rows = state.filter("not won").select(*columns)
        if open_rows.isEmpty():
            break
    held = reduce(DataFrame.unionByName, holders).select(
        *PROVIDER_KEY, F.col(seq).alias("_holder"), F.lit(True).alias("_held")
    )
    earlier = F.col("_held") & (F.col("_holder").isNull() | (F.col("_holder") < F.col(seq)))
    outcome = (
        F.when(F.col("_holder") == F.col(seq), ACCEPTED)
        .when(earlier, "duplicate_provider_key")
        .otherwise("duplicate_user_name")
    )
    return (
        batch.join(held, PROVIDER_KEY, "left")
        .withColumn("outcome", outcome)
        .select(*batch.columns, "outcome")
    )


def ingest_users_bulk(users: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Two unique keys in two passes, whatever the rows: first per provider key, then per name.

    Outcomes as in ``ingest_users``.  Unlike there, a row that wins its provider key and
    loses its name still refuses the later rows of that provider key.
    """
    narrow = batch.select(seq, *PROVIDER_KEY, "user_name")
    by_provider = accepted_rows(users, narrow, PROVIDER_KEY, [seq])
    winners = accepted_rows(users, by_provider, ["user_name"], [seq], "user_name")
    decided = by_provider.select(F.col(seq).alias("_seq")).join(
        winners.select(F.col(seq).alias("_seq"), F.lit(True).alias("_won")), "_seq", "left"
    )
    outcome = (
        F.when(F.col("_won"), ACCEPTED)
        .when(F.col("_seq").isNotNull(), "duplicate_user_name")
        .otherwise("duplicate_provider_key")
    )
    return batch.join(decided, batch[seq] == F.col("_seq"), "left").select(
        *[batch[c] for c in batch.columns], outcome.alias("outcome")
    )


def _decide(open_rows: DataFrame, taken: DataFrame, seq: str, chains: bool) -> DataFrame:
    """The rows that conflict with no ``taken`` row, with ``won`` where accepted now.

    Without ``chains`` only rows that wait for no other are accepted.
    """
    names = taken.filter(F.col("user_name").isNotNull()).select("user_name")
    free = open_rows.join(taken.select(*PROVIDER_KEY), PROVIDER_KEY, "left_anti").join(
        names, "user_name", "left_anti"
    )
    left = materialize(free.select(*open_rows.columns), "users")
    named = left.filter(F.col("user_name").isNotNull())
    nameless = left.filter(F.col("user_name").isNull()).select(seq)
    if chains and not left.isEmpty():
        by_name = _first_two(named, ["user_name"], seq).withColumnRenamed("up", "_name_up")
        by_name = by_name.unionByName(nameless, allowMissingColumns=True)
        # All others wait for several rows.
        front = materialize(_first_two(left, PROVIDER_KEY, seq).join(by_name, seq), "users")
        alone = front.filter("up is null and _name_up is null").select(seq)
        single = front.filter("(up is null) <> (_name_up is null) or up = _name_up").select(
            seq, F.coalesce("up", "_name_up").alias("up")
        )
        winners = alone.unionByName(_forced(alone, single, seq))
    else:
        # First rows are found by counting on the map side, and joined by seq.
        by_provider = left.groupBy(*PROVIDER_KEY).agg(F.min(seq).alias(seq)).select(seq)
        by_name = named.groupBy("user_name").agg(F.min(seq).alias(seq)).select(seq)
        winners = by_provider.join(by_name.unionByName(nameless), seq, "left_semi")
    return left.join(winners.withColumn("won", F.lit(True)), seq, "left").withColumn(
        "won", F.coalesce("won", F.lit(False))
    )


def _first_two(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """(seq, up): the first row of each key, with ``up`` NULL, and the second, which waits for it.

    A map task passes on two rows of a key at most, however hot it is.
    """
    place = Window.partitionBy(*key).orderBy(seq)
    two = rows.select(seq, *key).withColumn("_rn", F.row_number().over(place)).filter("_rn <= 2")
    ends = two.groupBy(*key).agg(F.array_sort(F.collect_list(seq)).alias("_two"))
    return ends.select(F.posexplode("_two").alias("_i", seq), F.col("_two")[0].alias("_first")).select(
        seq, F.when(F.col("_i") == 1, F.col("_first")).alias("up")
    )


def _forced(first: DataFrame, single: DataFrame, seq: str) -> DataFrame:
    """The rows of ``single`` (seq, up) that are accepted because ``first`` are; each is accepted if ``up`` is not.

    Pointers are doubled: a row that points to another such row takes over that one's pointer
    and the parity of the way, until it points to a row outside ``single``.  Ways that end
    elsewhere than in ``first`` stay undecided.
    """
    moving, ended = single.withColumn("odd", F.lit(True)), []
    while True:
        # A way onto a row whose own way has ended ends with it.
        known = reduce(DataFrame.unionByName, [moving, *ended])
        ups = known.select(F.col(seq).alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        step = moving.join(ups, "up", "left").select(
            seq,
            F.coalesce("_up", "up").alias("up"),
            F.when(F.col("_up").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("_odd")).alias("odd"),
            F.col("_up").isNull().alias("_ended"),
        )
        step = materialize(step, "users")
        ended.append(step.filter("_ended").drop("_ended"))
        moving = step.filter("not _ended").drop("_ended")
        if moving.isEmpty():
            break
    ways = reduce(DataFrame.unionByName, ended).filter("not odd")
    return ways.join(first.select(F.col(seq).alias("up")), "up", "left_semi").select(seq)


def apply_updates(
    target: DataFrame,
    changes: DataFrame,
    key: str | list[str],
    columns: list[str],
    now: Column,
    changed: str | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """A new snapshot with the changed rows updated and stamped.

    ``changed`` names an array column of ``changes`` with the columns a change sets, NULL
    being a value like others; without it a NULL keeps the stored value.  Several changes of
    a row apply one after the other by ``order``; without it a repeated key is an error.
    Any changed row is stamped, also one set to the values it had.
    """
    keys = [key] if isinstance(key, str) else list(key)
    place = F.struct(*order) if order else F.struct(F.lit(0))

    def last(c: str) -> Column:
        is_set = F.array_contains(changed, c) if changed else F.col(c).isNotNull()
        return F.max_by(F.struct(F.col(c).alias("value")), F.when(is_set, place)).alias(f"_new_{c}")

    renamed = changes.groupBy(*keys).agg(*map(last, columns), F.count("*").alias("_changes"))
    changed_row = F.col("_changes").isNotNull()
    if not order:
        one = F.when(F.col("_changes") > 1, F.raise_error(F.lit("a key has several changes and no order")))
        renamed = renamed.withColumn("_changes", F.coalesce(one.cast("bigint"), F.col("_changes")))
    joined = target.join(renamed, keys, "left")
    out = []
    for c in target.columns:
        if c in columns:
            new = F.col(f"_new_{c}")
            out.append(F.when(changed_row & new.isNotNull(), new["value"]).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(changed_row, now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
