"""Ingestion, updates, deletion and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixture import (
    REACTION_ORDER,
    Fixture,
    OnceFixture,
    ident,
    padded,
    store_tables,
    timestamp_ntz,
)
from checks.query import query
from checks.views_sql import k
from matchspark.functions.ids import assign_ids
from matchspark.operators import adjudicate, ingest, integrity, matching, sketches, snapshots
from matchspark.operators.matching import derive_matches
from matchspark.operators.vectors import enqueue_embeddings
from matchspark.plans.materialize import materialize, new_folder
from matchspark.sources import requests
from matchspark.sources.document_source import register_sources
from matchspark.sources.tables import load_tables

_TABLE_COUNTS = " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows from v_{t}"
    for t in [
        "users",
        "refresh_tokens",
        "candidates",
        "recruiters",
        "positions",
        "embeddings",
        "recommendations",
        "reactions",
        "matches",
    ]
)


@query("load_tables", _TABLE_COUNTS)
def load_tables_query(fx: Fixture) -> DataFrame:
    """Write the nine tables, load them through the typed registry, count them by SQL."""
    loaded = load_tables(fx.spark, store_tables(fx.spark, fx.sf_dir))
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in loaded.items()
    ]
    return integrity.union_all(parts)


# -- insert-ignore ---------------------------------------------------------------

_SPLIT_DATE = "1997-06-01"


_REACTION_OUTCOMES = f"""
    select b.recommendation_id, b.reactor_type, b.reactor_id, b.reaction_type, b.created_at,
           b.seq,
           case when b.rn = 1 and t.recommendation_id is null then 'accepted'
                else 'already_exists' end as outcome
    from (select *, row_number() over (
                 partition by recommendation_id, reactor_type, reactor_id
                 order by created_at, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
                          reaction_type) as rn
          from v_reaction_log where created_at >= timestamp '{_SPLIT_DATE}') b
    left join (select distinct recommendation_id, reactor_type, reactor_id from v_reaction_log
               where created_at < timestamp '{_SPLIT_DATE}') t
      on t.recommendation_id = b.recommendation_id and t.reactor_type = b.reactor_type
     and t.reactor_id = b.reactor_id"""


@query("ingest_reactions", _REACTION_OUTCOMES)
def ingest_reactions(fx: Fixture) -> DataFrame:
    log = OnceFixture(fx).reaction_log
    cut = timestamp_ntz(_SPLIT_DATE)
    stored = ingest.first_per_key(
        log.filter(F.col("created_at") < cut), ingest.REACTION_KEY, REACTION_ORDER
    )
    batch = log.filter(F.col("created_at") >= cut)
    return ingest.ingest_reactions(
        stored, batch, REACTION_ORDER, ["seq", "reactor_type"]
    ).select(*ingest.REACTION_KEY, "reaction_type", "created_at", "seq", "outcome")


@query("ingest_reactions_pruned", _REACTION_OUTCOMES)
def ingest_reactions_pruned(fx: Fixture) -> DataFrame:
    """The stored reactions as one run for each year, of which the batch opens what may hold its keys."""
    log = OnceFixture(fx).reaction_log
    cut = timestamp_ntz(_SPLIT_DATE)
    columns = [*ingest.REACTION_KEY, "reaction_type", "created_at"]
    earlier = log.filter(F.col("created_at") < cut)
    first = ingest.first_per_key(earlier, ingest.REACTION_KEY, REACTION_ORDER).select(*columns)
    first = materialize(first, "stored")
    path = new_folder(fx.spark, "reactions")
    year = F.greatest(F.least(F.year("created_at"), F.lit(1997)), F.lit(1995))
    for run in (1995, 1996, 1997):
        sketches.append(first.filter(year == run), ingest.REACTION_KEY, path, f"y{run}", parts=8)
    batch = materialize(log.filter(F.col("created_at") >= cut), "batch")
    out = sketches.insert_pruned(
        batch, path, ingest.REACTION_KEY, REACTION_ORDER, first.schema, ["seq", "reactor_type"], parts=8
    )
    return out.select(*columns, "seq", "outcome")


@query(
    "ingest_recommendations",
    """
    select b.position_id, b.candidate_id, b.score, b.seq,
           case when b.rn = 1 and t.id is null then 'accepted' else 'already_exists' end
               as outcome
    from (select *, row_number() over (partition by position_id, candidate_id order by seq) as rn
          from v_recommendation_batch) b
    left join (select id, position_id, candidate_id from v_recommendations
               where score > 0.8) t
      on t.position_id = b.position_id and t.candidate_id = b.candidate_id""",
)
def ingest_recommendations(fx: Fixture) -> DataFrame:
    fx = OnceFixture(fx)
    stored = fx.recommendations.filter("score > 0.8")
    return ingest.ingest_recommendations(stored, fx.recommendation_batch, ["seq"]).select(
        "position_id", "candidate_id", "score", "seq", "outcome"
    )


def _profile_batch(fx: Fixture) -> DataFrame:
    return fx.raw("orders").select(
        ident("can", F.col("o_orderkey") + 100_000_000).alias("id"),
        ident("usr", "o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("about"),
        F.col("o_orderkey").alias("seq"),
    )


_PROFILE_VIEWS = {
    "v_profile_batch": f"""
        select 'can_' || {k('o_orderkey + 100000000')} as id, 'usr_' || {k('o_custkey')} as user_id,
               o_orderpriority as about, o_orderkey as seq from orders""",
    "v_profiles": "select * from v_candidates where substr(id, 14, 1) in ('0', '3', '6')",
    "v_profile_outcome": """
        select b.id, b.user_id, b.about, b.seq,
               case when b.rn = 1 and t.id is null then 'accepted' else 'already_exists' end
                   as outcome
        from (select *, row_number() over (partition by user_id order by seq) as rn
              from v_profile_batch) b
        left join v_profiles t on t.user_id = b.user_id""",
}


def _profiles(fx: Fixture) -> DataFrame:
    return fx.candidates.filter(F.substring("id", 14, 1).isin("0", "3", "6"))


@query("ingest_candidates", "select * from v_profile_outcome", _PROFILE_VIEWS)
def ingest_candidates(fx: Fixture) -> DataFrame:
    return ingest.ingest_candidates(_profiles(fx), _profile_batch(fx), ["seq"])


@query(
    "enqueue_embeddings",
    """
    select object_id, object_type, status from v_embeddings
    union all
    select n.object_id, n.object_type, 'pending'
    from (select id as object_id, 'candidate' as object_type from v_profile_outcome
          where outcome = 'accepted'
          union select id, 'candidate' from v_candidates
          union select id, 'position' from v_positions) n
    left join v_embeddings e on e.object_id = n.object_id and e.object_type = n.object_type
    where e.object_id is null""",
    _PROFILE_VIEWS,
)
def enqueue(fx: Fixture) -> DataFrame:
    new = ingest.accepted(
        ingest.ingest_candidates(_profiles(fx), _profile_batch(fx), ["seq"])
    )
    now = timestamp_ntz("2024-02-10")
    queue = fx.embeddings.withColumn("created_at", now).withColumn("updated_at", now)
    candidates = fx.candidates.select("id").unionByName(new.select("id"))
    pending = enqueue_embeddings(queue, candidates, fx.positions, now)
    return queue.unionByName(pending).select("object_id", "object_type", "status")


@query(
    "ingest_recruiters",
    f"""
    select id, user_id from v_recruiters
    union all
    select 'rec_' || {k('c_custkey + 100000000')}, 'usr_' || {k('c_custkey')} from customer
    where c_acctbal > 5000""",
)
def ingest_recruiters(fx: Fixture) -> DataFrame:
    batch = (
        fx.raw("customer")
        .filter("c_acctbal > 5000")
        .select(
            ident("rec", F.col("c_custkey") + 100_000_000).alias("id"),
            ident("usr", "c_custkey").alias("user_id"),
        )
    )
    return ingest.ingest_recruiters(fx.recruiters, batch)


@query(
    "ingest_positions",
    """
    select b.title, b.description, b.company, b.seq,
           case when b.company is null then 'accepted'
                when b.rn = 1 and t.title is null then 'accepted'
                else 'already_exists' end as outcome
    from (select p_name as title, p_type as description,
                 case when p_size % 5 <> 0 then p_brand end as company, p_partkey as seq,
                 row_number() over (
                     partition by p_name, p_type, case when p_size % 5 <> 0 then p_brand end
                     order by p_partkey) as rn
          from part) b
    left join (select distinct title, description, company from v_positions
               where substr(id, 14, 1) in ('0', '4')) t
      on t.title = b.title and t.description = b.description and t.company = b.company""",
)
def ingest_positions(fx: Fixture) -> DataFrame:
    stored = fx.positions.filter(F.substring("id", 14, 1).isin("0", "4"))
    batch = fx.positions.select(
        "title", "description", "company", F.substring("id", 5, 10).cast("bigint").alias("seq")
    )
    return ingest.ingest_positions(stored, batch, ["seq"])


# The batch repeats provider keys and user names; greedy insertion is unrolled for
# the oracle into rounds, and a row not decided in them shows up as a difference.
_USER_VIEWS = {
    "v_new_users": """
        select c_custkey as seq, case when c_custkey % 2 = 0 then 'apple' else 'google' end
                   as provider,
               'q-' || (c_custkey // 3) as provider_user_id,
               case when c_custkey % 7 = 0 then null else 'name' || (c_custkey * 5 % 997) end
                   as user_name
        from customer""",
    "v_old_users": """
        select 'google' as provider, 'q-' || (c_custkey // 2) as provider_user_id,
               'name' || (c_custkey + 400) as user_name
        from customer where c_custkey % 20 = 0 or c_custkey % 20 = 7""",
}


def _user_rounds(rounds: int) -> dict[str, str]:
    views = {
        "v_taken0": "select provider, provider_user_id, user_name from v_old_users",
        "v_open0": "select * from v_new_users",
    }
    for i in range(rounds):
        views[f"v_state{i}"] = f"""
            select o.*, t.provider is not null as p_hit, n.user_name is not null as n_hit
            from v_open{i} o
            left join (select distinct provider, provider_user_id from v_taken{i}) t
              on t.provider = o.provider and t.provider_user_id = o.provider_user_id
            left join (select distinct user_name from v_taken{i}) n
              on n.user_name = o.user_name"""
        views[f"v_left{i}"] = f"""
            select *, min(seq) over (partition by provider, provider_user_id) as p_first,
                   case when user_name is null then seq
                        else min(seq) over (partition by user_name) end as n_first
            from v_state{i} where not p_hit and not n_hit"""
        views[f"v_taken{i + 1}"] = f"""
            select provider, provider_user_id, user_name from v_left{i}
            where seq = p_first and seq = n_first"""
        views[f"v_open{i + 1}"] = f"""
            select seq, provider, provider_user_id, user_name from v_left{i}
            where not (seq = p_first and seq = n_first)"""
    views["v_accepted"] = " union all ".join(
        f"""
        select seq, provider, provider_user_id from v_left{i}
        where seq = p_first and seq = n_first"""
        for i in range(rounds)
    )
    views["v_user_outcome"] = """
        select b.seq, b.provider, b.provider_user_id, b.user_name,
               case when a.seq = b.seq then 'accepted'
                    when o.provider is not null or a.seq < b.seq then 'duplicate_provider_key'
                    else 'duplicate_user_name' end as outcome
        from v_new_users b
        left join v_accepted a on a.provider = b.provider
             and a.provider_user_id = b.provider_user_id
        left join (select distinct provider, provider_user_id from v_old_users) o
          on o.provider = b.provider and o.provider_user_id = b.provider_user_id"""
    return views


@query("ingest_users", "select * from v_user_outcome", {**_USER_VIEWS, **_user_rounds(6)})
def ingest_users(fx: Fixture) -> DataFrame:
    return ingest.ingest_users(*_stored_and_new_users(fx))


@query(
    "ingest_users_bulk",
    """
    select b.seq, b.provider, b.provider_user_id, b.user_name,
           case when s.seq is null then 'duplicate_provider_key'
                when w.seq is null then 'duplicate_user_name' else 'accepted' end as outcome
    from v_new_users b left join v_survivors s on s.seq = b.seq
    left join v_winners w on w.seq = b.seq""",
    {
        **_USER_VIEWS,
        "v_survivors": """
            select n.* from v_new_users n left join
                (select distinct provider, provider_user_id from v_old_users) o
              on o.provider = n.provider and o.provider_user_id = n.provider_user_id
            where o.provider is null
            qualify row_number() over
                (partition by n.provider, n.provider_user_id order by n.seq) = 1""",
        "v_winners": """
            select seq from v_survivors where user_name is null
            union all
            select min(seq) from v_survivors
            where user_name not in (select user_name from v_old_users) group by user_name""",
    },
)
def ingest_users_bulk(fx: Fixture) -> DataFrame:
    return ingest.ingest_users_bulk(*_stored_and_new_users(fx))


def _stored_and_new_users(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    batch = fx.raw("customer").select(
        key.alias("seq"),
        F.when(key % 2 == 0, "apple").otherwise("google").alias("provider"),
        F.concat(F.lit("q-"), F.floor(key / 3).cast("string")).alias("provider_user_id"),
        F.when(
            key % 7 != 0, F.concat(F.lit("name"), (key * 5 % 997).cast("string"))
        ).alias("user_name"),
    )
    stored = (
        fx.raw("customer")
        .filter((key % 20 == 0) | (key % 20 == 7))
        .select(
            F.lit("google").alias("provider"),
            F.concat(F.lit("q-"), F.floor(key / 2).cast("string")).alias("provider_user_id"),
            F.concat(F.lit("name"), (key + 400).cast("string")).alias("user_name"),
        )
    )
    return stored, batch


def ulid_sql(prefix: str, millis: str, text: str) -> str:
    """The id derived from ``text`` (seed and key joined by a bar)."""
    letters = "'0123456789abcdefghjkmnpqrstvwxyz'"

    def letter(number: str, shift: int) -> str:
        return f"substr({letters}, cast((({number}) >> {shift}) & 31 as integer) + 1, 1)"

    parts = [letter(millis, 5 * i) for i in reversed(range(10))]
    for start in range(1, 21, 5):
        group = f"cast('0x' || substr(sha256({text}), {start}, 5) as bigint)"
        parts += [letter(group, 5 * i) for i in reversed(range(4))]
    return f"'{prefix}_' || " + " || ".join(parts)


@query(
    "ingest_refresh_tokens",
    f"""select {ulid_sql('rtk', '((epoch_us(ts) + 500) // 1000)', "'s|' || event_id")} as jti,
               'usr_' || {k('user_id')} as user_id, ts + interval 30 day as expires_at,
               false as revoked
        from events where event_type = 'signup'""",
)
def ingest_refresh_tokens(fx: Fixture) -> DataFrame:
    sessions = (
        fx.raw("events")
        .filter("event_type = 'signup'")
        .select(F.col("event_id").alias("seq"), ident("usr", "user_id").alias("user_id"), "ts")
    )
    return ingest.ingest_refresh_tokens(sessions, "ts", seed="s")


@query(
    "assign_ulids",
    "select o_orderkey, "
    + ulid_sql("rcm", "((epoch_us(o_orderdate) + 500) // 1000)", "'x|' || o_orderkey")
    + " as id from orders",
)
def assign_ulids(fx: Fixture) -> DataFrame:
    orders = fx.raw("orders").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return assign_ids(orders, "rcm", F.col("o_orderdate"), ["o_orderkey"], seed="x").select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "id"
    )


@query(
    "apply_updates",
    f"""
    select 'usr_' || {k('c_custkey')} as id,
           case when c_acctbal < 0 and c_custkey % 4 <> 0 then 'renamed ' || c_custkey
                else c_name end as full_name,
           c_mktsegment as email,
           case when c_acctbal < 0 then timestamp '2024-02-10' else timestamp '2024-01-01' end
               as updated_at
    from customer""",
)
def apply_updates(fx: Fixture) -> DataFrame:
    customer = fx.raw("customer")
    target = customer.select(
        ident("usr", "c_custkey").alias("id"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("email"),
        timestamp_ntz("2024-01-01").alias("updated_at"),
    )
    changes = customer.filter("c_acctbal < 0").select(
        ident("usr", "c_custkey").alias("id"),
        F.when(
            F.col("c_custkey") % 4 != 0,
            F.concat(F.lit("renamed "), F.col("c_custkey").cast("string")),
        ).alias("full_name"),
    )
    return ingest.apply_updates(
        target, changes, "id", ["full_name"], timestamp_ntz("2024-02-10")
    )


@query(
    "change_folders",
    f"""
    select 'usr_' || {k('c_custkey')} as id,
           case when c_custkey >= n * 0.9 and c_custkey % 4 <> 0 then 'renamed ' || c_custkey
                else c_name end as full_name,
           case when c_custkey >= n * 0.9 then timestamp '2024-02-10'
                else timestamp '2024-01-01' end as updated_at
    from customer, (select max(c_custkey) as n from customer)
    where not (c_custkey < n * 0.1 and c_acctbal < 0)""",
)
def change_folders(fx: Fixture) -> DataFrame:
    """Users in folders by key: the last tenth renamed, some of the first tenth deleted."""
    customer = fx.raw("customer")
    last = customer.agg(F.max("c_custkey")).first()[0]
    user, number = ident("usr", "c_custkey").alias("id"), F.col("c_custkey")
    rows = customer.select(
        user, F.col("c_name").alias("full_name"), timestamp_ntz("2024-01-01").alias("updated_at")
    )
    path = new_folder(fx.spark, "users")
    snapshots.create(rows, ["id"], path, 8)
    renamed = F.when(number % 4 != 0, F.concat(F.lit("renamed "), number.cast("string")))
    changes = customer.filter(number >= last * 0.9).select(user, renamed.alias("full_name"))
    snapshots.update(
        fx.spark, path, ["id"], rows.schema, changes, ["full_name"], timestamp_ntz("2024-02-10")
    )
    gone = customer.filter((number < last * 0.1) & (F.col("c_acctbal") < 0)).select(user)
    snapshots.delete(fx.spark, path, ["id"], rows.schema, gone)
    return snapshots.snapshot(fx.spark, path, rows.schema)


# -- deletion and audits -----------------------------------------------------------

_GONE = {
    "v_x_users": "select id from v_users where full_name like '%3'",
    "v_x_candidates": "select id from v_candidates where user_id in (select id from v_x_users)",
    "v_x_recruiters": "select id from v_recruiters where user_id in (select id from v_x_users)",
    "v_x_positions": "select id from v_positions "
    "where recruiter_id in (select id from v_x_recruiters)",
    "v_x_recommendations": "select id from v_recommendations "
    "where position_id in (select id from v_x_positions) "
    "or candidate_id in (select id from v_x_candidates)",
}
_BY_ID = "id in (select id from v_x_{0})"
_BY_PAIR = "position_id in (select id from v_x_positions) or candidate_id in (select id from v_x_candidates)"
#: Key columns of each table, and what makes a row go.
_DELETED_ROWS = {
    "users": (["id"], _BY_ID),
    "refresh_tokens": (["jti"], "user_id in (select id from v_x_users)"),
    "candidates": (["id"], _BY_ID),
    "recruiters": (["id"], _BY_ID),
    "positions": (["id"], _BY_ID),
    "recommendations": (["id"], _BY_ID),
    "matches": (["candidate_id", "position_id"], _BY_PAIR),
    "reactions": (
        ingest.REACTION_KEY,
        "recommendation_id in (select id from v_x_recommendations)",
    ),
}


@query(
    "cascade_delete",
    " union all ".join(
        f"select '{t}' as table_name, concat_ws('|', {', '.join(key)}) as row_key, "
        f"coalesce({gone.format(t)}, false) as removed from v_{t}"
        for t, (key, gone) in _DELETED_ROWS.items()
    ),
    _GONE,
)
def cascade_delete(fx: Fixture) -> DataFrame:
    gone = fx.users.filter("full_name like '%3'").select("id")
    flagged = integrity.cascade_delete(OnceFixture(fx, tables=True).tables(), {"users": gone})
    return integrity.union_all(
        [
            df.select(
                F.lit(name).alias("table_name"),
                F.concat_ws("|", *_DELETED_ROWS[name][0]).alias("row_key"),
                "removed",
            )
            for name, df in flagged.items()
        ]
    )


_OWNER_KEY = "case when s_suppkey % 10 = 1 then s_suppkey - 1 else s_suppkey end"


def _orphans(child: str, column: str, parent: str, where: str = "true") -> str:
    return f"""
        select '{child}' as child, '{column}' as "column", '{parent}' as parent,
               count(distinct c.{column}) as missing_keys, count(c.{column}) as orphan_rows
        from v_{child} c left join v_{parent} p on p.id = c.{column}
        where p.id is null and {where}"""


@query(
    "audit_foreign_keys",
    " union all ".join(
        [
            _orphans("refresh_tokens", "user_id", "users"),
            _orphans("candidates", "user_id", "users"),
            _orphans("recruiters", "user_id", "users"),
            _orphans("positions", "recruiter_id", "recruiters"),
            _orphans("recommendations", "position_id", "positions"),
            _orphans("recommendations", "candidate_id", "candidates"),
            _orphans("matches", "position_id", "positions"),
            _orphans("matches", "candidate_id", "candidates"),
            _orphans("reactions", "recommendation_id", "recommendations"),
            _orphans("embeddings", "object_id", "candidates", "object_type = 'candidate'"),
            _orphans("embeddings", "object_id", "positions", "object_type = 'position'"),
        ]
    ),
    # Some references are broken on purpose: parents with a 7 as last digit are missing.
    {
        "v_recruiters": f"""
            select 'rec_' || {k('s_suppkey')} as id,
                   'usr_' || {k(_OWNER_KEY)}
                       as user_id
            from supplier where s_suppkey % 10 <> 7""",
    },
)
def audit_foreign_keys(fx: Fixture) -> DataFrame:
    tables = OnceFixture(fx, tables=True).tables()
    tables["recruiters"] = tables["recruiters"].filter("id not like '%7'")
    return integrity.audit_foreign_keys(tables)


def _surplus(table: str, *key: str) -> str:
    columns = ", ".join(key)
    given = " and ".join(f"{c} is not null" for c in key)
    return f"""
        select '{table}' as "table", '{columns}' as key, count(*) as duplicate_keys,
               cast(coalesce(sum(n - 1), 0) as bigint) as surplus_rows
        from (select count(*) as n from v_{table} where {given} group by {columns}
              having count(*) > 1)"""


@query(
    "audit_unique",
    " union all ".join(
        [
            _surplus("users", "id"),
            _surplus("users", "provider", "provider_user_id"),
            _surplus("refresh_tokens", "jti"),
            _surplus("candidates", "id"),
            _surplus("candidates", "user_id"),
            _surplus("recruiters", "id"),
            _surplus("positions", "id"),
            _surplus("positions", "title", "description", "company"),
            _surplus("embeddings", "object_id", "object_type"),
            _surplus("recommendations", "id"),
            _surplus("recommendations", "position_id", "candidate_id"),
            _surplus("reactions", "recommendation_id", "reactor_type", "reactor_id"),
            _surplus("matches", "candidate_id", "position_id"),
        ]
    ),
    # The raw batches stand in for the two large tables, so that duplicates exist.
    {
        "v_recommendations": "select * from v_recommendation_batch",
        "v_reactions": "select * from v_reaction_log",
        "v_matches": """
            select r.candidate_id, r.position_id
            from (select distinct id, candidate_id, position_id from v_recommendation_batch) r
            join v_positions p on p.id = r.position_id
            join v_first_reactions c on c.recommendation_id = r.id
                 and c.reactor_type = 'candidate' and c.reactor_id = r.candidate_id
                 and c.reaction_type = 'positive'
            join v_first_reactions e on e.recommendation_id = r.id
                 and e.reactor_type = 'recruiter' and e.reactor_id = p.recruiter_id
                 and e.reaction_type = 'positive'""",
        "v_first_reactions": """
            select * from (select *, row_number() over (
                      partition by recommendation_id, reactor_type, reactor_id
                      order by created_at, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
                               reaction_type) as rn
                  from v_reaction_log) where rn = 1""",
    },
)
def audit_unique(fx: Fixture) -> DataFrame:
    fx = OnceFixture(fx)
    tables = fx.tables()
    tables["recommendations"] = fx.recommendation_batch
    tables["reactions"] = fx.reaction_log
    return integrity.audit_unique(tables)


_DIRTY = {
    "v_d_users": """
        select case when c_custkey % 13 = 0 then 'other' else 'apple' end as provider,
               case when c_custkey % 17 <> 0 then 'p-' || c_custkey end as provider_user_id,
               case when c_custkey % 19 = 0 then repeat('x', 256) else c_name end as full_name
        from customer""",
    "v_d_recommendations": """
        select cast(l_quantity / 40 as decimal(3,2)) as score from lineitem""",
    "v_d_reactions": """
        select case when l_linenumber = 1 then 'maybe' when l_linenumber = 2 then null
                    else 'neutral' end as reaction_type
        from lineitem""",
    "v_d_embeddings": "select vec_id, len(embedding) as size from embeddings",
}


@query(
    "audit_domains",
    """
    select * from (
    select 'users' as "table", 'provider' as "column", 'domain' as rule, count(*) as "rows"
    from v_d_users where provider = 'other'
    union all select 'users', 'provider_user_id', 'not_null', count(*) from v_d_users
    where provider_user_id is null
    union all select 'users', 'full_name', 'length', count(*) from v_d_users
    where length(full_name) > 255
    union all select 'recommendations', 'score', 'range', count(*) from v_d_recommendations
    where score > 1
    union all select 'reactions', 'reaction_type', 'domain', count(*) from v_d_reactions
    where reaction_type = 'maybe'
    union all select 'reactions', 'reaction_type', 'not_null', count(*) from v_d_reactions
    where reaction_type is null
    union all select 'embeddings', 'embedding', 'dimension', count(*) from v_d_embeddings
    where size - vec_id % 3 <> 64
    ) where "rows" > 0""",
    _DIRTY,
)
def audit_domains(fx: Fixture) -> DataFrame:
    key, line = F.col("c_custkey"), F.col("l_linenumber")
    tables = {
        "users": fx.raw("customer").select(
            F.when(key % 13 == 0, "other").otherwise("apple").alias("provider"),
            F.when(key % 17 != 0, F.concat(F.lit("p-"), key.cast("string"))).alias(
                "provider_user_id"
            ),
            F.when(key % 19 == 0, F.repeat(F.lit("x"), 256))
            .otherwise(F.col("c_name"))
            .alias("full_name"),
        ),
        "recommendations": fx.raw("lineitem").select(
            (F.col("l_quantity") / 40).cast("decimal(3,2)").alias("score")
        ),
        "reactions": fx.raw("lineitem").select(
            F.when(line == 1, "maybe").when(line != 2, "neutral").alias("reaction_type")
        ),
        "embeddings": fx.raw("embeddings").select(
            F.slice("embedding", 1, (64 - F.col("vec_id") % 3).cast("int")).alias("embedding")
        ),
    }
    return integrity.audit_domains(tables, dimension=64)


# -- reaction requests ---------------------------------------------------------------

_REQUEST_VIEWS = {
    "v_reaction_requests": f"""
        select {k('l_orderkey')} || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey
                   || '-' || cast(l_extendedprice as decimal(12,2)) as seq,
               case when l_orderkey % 31 = 0 then null
                    when l_orderkey % 19 = 0 then 'can_x'
                    else 'can_' || {k('o_custkey')} end as candidate_id,
               case when l_orderkey % 29 = 0 then ''
                    when l_orderkey % 23 = 0 then 'rcm_x'
                    else 'rcm_' || {k('l_partkey')} || {k('o_custkey')} end as recommendation_id,
               case when l_orderkey % 17 = 0 then 'bad_json'
                    when l_orderkey % 13 = 0 then 'unknown_field'
                    when l_orderkey % 11 = 0 then 'trailing'
                    when l_orderkey % 7 = 0 then 'maybe'
                    else case l_returnflag when 'A' then 'positive' when 'R' then 'negative'
                              else 'neutral' end end as kind,
               l_shipdate as created_at, l_linestatus
        from v_lo""",
    "v_stored_reactions": """
        select * from v_reactions where reactor_type = 'candidate'
        and created_at < timestamp '1996-01-01'""",
    "v_judged": """
        select q.seq, q.candidate_id, q.recommendation_id, q.kind, q.created_at,
               case when q.candidate_id is null then 'no_candidate_role'
                    when q.recommendation_id = '' then 'id_required'
                    when r.id is null then 'recommendation_not_found'
                    when r.candidate_id <> q.candidate_id then 'not_own_recommendation'
                    when q.kind in ('bad_json', 'unknown_field', 'trailing') then 'invalid_body'
                    when q.kind = 'maybe' then 'invalid_reaction_type' end as reason
        from v_reaction_requests q left join v_recommendations r on r.id = q.recommendation_id""",
    "v_decided": """
        select j.seq, j.candidate_id, j.recommendation_id, j.kind,
               case when j.reason is null and (j.rn > 1 or s.recommendation_id is not null)
                    then 'already_exists' else j.reason end as reason
        from (select *, row_number() over (
                     partition by reason, recommendation_id, candidate_id
                     order by created_at, seq) as rn
              from v_judged) j
        left join v_stored_reactions s on s.recommendation_id = j.recommendation_id
             and s.reactor_id = j.candidate_id""",
}


def _bodies(kind) -> F.Column:
    good = F.concat(F.lit(' {"reaction_type" : "'), kind, F.lit('"}'))
    return (
        F.when(kind == "bad_json", '{"reaction_type": positive}')
        .when(kind == "unknown_field", '{"reaction_type": "positive", "note": "x"}')
        .when(kind == "trailing", '{"reaction_type": "positive"} {}')
        .otherwise(good)
    )


def _reaction_requests(fx: Fixture) -> DataFrame:
    order, flag = F.col("l_orderkey"), F.col("l_returnflag")
    kind = (
        F.when(order % 17 == 0, "bad_json")
        .when(order % 13 == 0, "unknown_field")
        .when(order % 11 == 0, "trailing")
        .when(order % 7 == 0, "maybe")
        .when(flag == "A", "positive")
        .when(flag == "R", "negative")
        .otherwise("neutral")
    )
    return fx.line_orders.select(
        fx.line_key().alias("seq"),
        F.when(order % 31 == 0, None)
        .when(order % 19 == 0, "can_x")
        .otherwise(ident("can", "o_custkey"))
        .alias("candidate_id"),
        F.when(order % 29 == 0, "")
        .when(order % 23 == 0, "rcm_x")
        .otherwise(F.concat(F.lit("rcm_"), padded("l_partkey"), padded("o_custkey")))
        .alias("recommendation_id"),
        _bodies(kind).alias("body"),
        F.col("l_shipdate").alias("created_at"),
    )


@query(
    "adjudicate_reactions",
    """
    select seq, candidate_id, recommendation_id, reason,
           case when reason is not null and reason in ('invalid_body') then null
                else kind end as reaction_type,
           cast(case reason when 'no_candidate_role' then 500 when 'id_required' then 400
                when 'recommendation_not_found' then 404 when 'not_own_recommendation' then 403
                when 'invalid_body' then 400 when 'invalid_reaction_type' then 400
                when 'already_exists' then 409 else 201 end as integer) as status
    from (select seq, candidate_id, recommendation_id, reason,
                 case when kind in ('bad_json', 'unknown_field', 'trailing') then null
                      else kind end as kind from v_decided)""",
    _REQUEST_VIEWS,
)
def adjudicate_reactions(fx: Fixture) -> DataFrame:
    fx = OnceFixture(fx)
    stored = fx.reactions.filter(
        (F.col("reactor_type") == "candidate")
        & (F.col("created_at") < timestamp_ntz("1996-01-01"))
    )
    return adjudicate.adjudicate_reactions(
        _reaction_requests(fx), fx.recommendations, stored, ["created_at", "seq"]
    ).select("seq", "candidate_id", "recommendation_id", "reason", "reaction_type", "status")


@query("derive_matches", "select * from v_matches")
def matches(fx: Fixture) -> DataFrame:
    return derive_matches(fx.reactions, fx.recommendations, fx.positions)


@query("match_changes", "select * from v_matches")
def match_changes(fx: Fixture) -> DataFrame:
    """The matches that the reactions of each of three spans of years add, all spans together."""
    fx = OnceFixture(fx, tables=True)
    reactions = fx.reactions
    table, year = new_folder(fx.spark, "reactions"), F.year("created_at")
    matching.write_by_recommendation(reactions.limit(0), table, 16)
    found = []
    for first, last in [(0, 1994), (1995, 1996), (1997, 9999)]:
        changed = reactions.filter(year.between(first, last))
        stored = matching.stored_for(changed, table, 16)
        found.append(materialize(matching.match_changes(changed, stored, fx.recommendations, fx.positions), "matches"))
        matching.write_by_recommendation(changed, table, 16)
    return integrity.union_all(found)


_INGEST_SQL = """
    select seq, candidate_id as good_candidate_id, recommendation_id as good_recommendation_id,
           case when error is null then kind end as reaction_type, error
    from (select seq,
                 case when kind in ('bad_json', 'unknown_field', 'trailing') then null
                      else coalesce(candidate_id, '') end as candidate_id,
                 case when kind in ('bad_json', 'unknown_field', 'trailing') then null
                      else recommendation_id end as recommendation_id,
                 kind,
                 case kind when 'trailing' then 'extra_data' when 'bad_json' then 'failed_decode'
                      when 'unknown_field' then 'failed_decode' end as error
          from v_reaction_requests)"""
_INGEST_FIELDS = ["seq", "candidate_id", "recommendation_id", "reaction_type"]


def _request_folder(fx: Fixture) -> str:
    """The requests as text lines."""
    made = _reaction_requests(fx)
    fields = F.concat(
        F.lit('"seq": "'),
        "seq",
        F.lit('", "candidate_id": '),
        F.coalesce(F.concat(F.lit('"'), "candidate_id", F.lit('"')), F.lit("null")),
        F.lit(', "recommendation_id": "'),
        "recommendation_id",
        F.lit('", '),
    )
    # The fields go in front of the body's own member.
    line = F.regexp_replace(F.trim("body"), r"\A\{", F.concat(F.lit("{"), fields))
    folder = new_folder(fx.spark, "requests")
    made.select(line.alias("value")).write.text(folder)
    return folder


def _ingested(decoded: DataFrame) -> DataFrame:
    # A refused line keeps its text, which holds the sequence here.
    seq = F.coalesce("seq", F.regexp_extract("line", '"seq": "([^"]*)"', 1))
    return decoded.select(
        seq.alias("seq"),
        F.col("candidate_id").alias("good_candidate_id"),
        F.col("recommendation_id").alias("good_recommendation_id"),
        "reaction_type",
        "error",
    )


@query("reaction_ingest", _INGEST_SQL, _REQUEST_VIEWS)
def reaction_ingest(fx: Fixture) -> DataFrame:
    """Write the requests as text lines, then read and decode them."""
    return _ingested(requests.read_requests(fx.spark, _request_folder(fx), _INGEST_FIELDS))


@query("request_source", _INGEST_SQL, _REQUEST_VIEWS)
def request_source(fx: Fixture) -> DataFrame:
    """The same lines through the data source, in splits of a million bytes."""
    register_sources(fx.spark)
    lines = fx.spark.read.format("request_lines").option("fields", ",".join(_INGEST_FIELDS))
    return _ingested(lines.option("split_bytes", 1_000_000).load(_request_folder(fx)))
