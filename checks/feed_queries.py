"""Lookups, feeds and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixture import Fixture, ident, padded, written_pair
from checks.query import query
from checks.views_sql import k
from matchspark.functions import requests as req
from matchspark.operators import feeds, lookups, page_index, paging
from matchspark.plans.materialize import new_folder

# Ids asked for: of every customer / part / order line, so that some are unknown.
_CANDIDATE_IDS = f"select 'can_' || {k('c_custkey')} as id from customer"
_USER_IDS = f"select 'usr_' || {k('c_custkey')} as user_id from customer"


def _left_lookup(ids: str, table: str, columns: list[str], key: str = "id") -> str:
    shown = ", ".join(f"t.{c}" for c in columns)
    return (
        f"select i.{key}, {shown}, t.{key} is not null as found "
        f"from ({ids}) i left join {table} t on t.{key} = i.{key}"
    )


@query("candidate_by_id", _left_lookup(_CANDIDATE_IDS, "v_candidates", ["about"]))
def candidate_by_id(fx: Fixture) -> DataFrame:
    ids = fx.raw("customer").select(ident("can", "c_custkey").alias("id"))
    return lookups.candidate_by_id(ids, fx.candidates)


_PAIR_IDS = f"select 'rcm_' || {k('l_partkey')} || {k('l_orderkey % 1000')} as id from lineitem"


@query(
    "recommendation_by_id",
    _left_lookup(_PAIR_IDS, "v_recommendations", ["candidate_id", "position_id"]),
)
def recommendation_by_id(fx: Fixture) -> DataFrame:
    ids = fx.raw("lineitem").select(
        F.concat(
            F.lit("rcm_"), padded("l_partkey"), padded(F.col("l_orderkey") % 1000)
        ).alias("id")
    )
    return lookups.recommendation_by_id(ids, fx.recommendations)


@query(
    "position_by_id",
    _left_lookup(
        f"select 'pos_' || {k('l_partkey + l_linenumber')} as id from lineitem",
        "v_positions",
        ["recruiter_id", "title", "description", "company"],
    ),
)
def position_by_id(fx: Fixture) -> DataFrame:
    ids = fx.raw("lineitem").select(
        ident("pos", F.col("l_partkey") + F.col("l_linenumber")).alias("id")
    )
    return lookups.position_by_id(ids, fx.positions)


@query(
    "candidate_by_user",
    f"select i.user_id, t.id as candidate_id, t.about, t.id is not null as found "
    f"from ({_USER_IDS}) i left join v_candidates t on t.user_id = i.user_id",
)
def candidate_by_user(fx: Fixture) -> DataFrame:
    users = fx.users.select(F.col("id").alias("user_id"))
    return lookups.candidate_by_user(users, fx.candidates)


@query(
    "recruiter_by_user",
    f"select i.user_id, t.recruiter_id, t.recruiter_id is not null as found "
    f"from ({_USER_IDS}) i left join (select user_id, min(id) as recruiter_id "
    f"from v_recruiters group by user_id) t on t.user_id = i.user_id",
)
def recruiter_by_user(fx: Fixture) -> DataFrame:
    users = fx.users.select(F.col("id").alias("user_id"))
    return lookups.recruiter_by_user(users, fx.recruiters)


@query(
    "embeddings_by_status",
    "select object_id, object_type, status from v_embeddings "
    "where object_type = 'position' and status = 'pending'",
)
def embeddings_by_status(fx: Fixture) -> DataFrame:
    return lookups.embeddings_by_status(fx.embeddings, "position", "pending").drop("embedding")


def paged_sql(rows: str, owner: str, key: str, columns: str, limit: str = "50") -> str:
    """The page of each owner in ``rows`` (a select giving owner, key and the rest)."""
    return f"""
        select {columns}, n > {limit} as has_next,
               case when n > {limit} then last else '' end as next_cursor
        from (select *, count(*) over (partition by {owner}) as n,
                     max(case when rn = {limit} then {key} end) over (partition by {owner}) as last
              from (select *, row_number() over (partition by {owner} order by {key}) as rn
                    from ({rows})) where rn <= {limit} + 1)
        where rn <= {limit}"""


_UNREACTED_POSITIONS = """
    select r.candidate_id, r.id as recommendation_id, p.id as position_id, p.title, p.company,
           p.description
    from v_recommendations r join v_positions p on p.id = r.position_id
    left join v_reactions x on x.recommendation_id = r.id and x.reactor_type = 'candidate'
         and x.reactor_id = r.candidate_id
    where x.recommendation_id is null"""
_POSITION_COLUMNS = "candidate_id, recommendation_id, position_id, title, company, description"


@query(
    "position_feed",
    paged_sql(_UNREACTED_POSITIONS, "candidate_id", "recommendation_id", _POSITION_COLUMNS),
)
def position_feed(fx: Fixture) -> DataFrame:
    return feeds.position_feed(fx.recommendations, fx.positions, fx.reactions)


_UNREACTED_CANDIDATES = """
    select p.recruiter_id, r.id as recommendation_id, c.id as candidate_id, u.full_name, c.about
    from v_recommendations r join v_positions p on p.id = r.position_id
    join v_candidates c on c.id = r.candidate_id
    join v_users u on u.id = c.user_id
    left join v_reactions x on x.recommendation_id = r.id and x.reactor_type = 'recruiter'
         and x.reactor_id = p.recruiter_id
    where x.recommendation_id is null"""
_CANDIDATE_COLUMNS = "recruiter_id, recommendation_id, candidate_id, full_name, about"


@query(
    "candidate_feed",
    paged_sql(_UNREACTED_CANDIDATES, "recruiter_id", "recommendation_id", _CANDIDATE_COLUMNS),
)
def candidate_feed(fx: Fixture) -> DataFrame:
    return feeds.candidate_feed(
        fx.recommendations, fx.positions, fx.candidates, fx.users, fx.reactions
    )


@query(
    "exclude_reacted",
    """select r.id as recommendation_id, r.candidate_id, r.position_id
       from v_recommendations r left join v_reactions x on x.recommendation_id = r.id
            and x.reactor_type = 'candidate' and x.reactor_id = r.candidate_id
       where x.recommendation_id is null""",
)
def exclude_reacted(fx: Fixture) -> DataFrame:
    rows = fx.recommendations.select(
        F.col("id").alias("recommendation_id"), "candidate_id", "position_id"
    )
    return feeds.exclude_reacted(rows, fx.reactions, "candidate", "candidate_id")


@query(
    "match_feed",
    paged_sql(
        """select m.candidate_id, m.position_id, p.title, p.description,
                  coalesce(p.company, '') as company, m.created_at as matched_at
           from v_matches m join v_positions p on p.id = m.position_id""",
        "candidate_id",
        "position_id",
        "candidate_id, position_id, title, description, company, matched_at",
    ),
)
def match_feed(fx: Fixture) -> DataFrame:
    return feeds.match_feed(fx.matches, fx.positions)


@query(
    "reaction_history",
    paged_sql(
        "select recommendation_id, reactor_type, reactor_id, reaction_type, "
        "created_at as reacted_at from v_reactions where reactor_type = 'candidate'",
        "reactor_id",
        "recommendation_id",
        "recommendation_id, reactor_type, reactor_id, reaction_type, reacted_at",
    ),
)
def reaction_history(fx: Fixture) -> DataFrame:
    return feeds.reaction_history(fx.reactions)


# Feed requests: each candidate's cursor lies somewhere in its own keys, is empty
# for some, and beyond the end for others.
_CURSOR_VIEWS = {
    "v_requests": f"""
        select 'can_' || {k('c_custkey')} as candidate_id,
               case when c_custkey % 4 = 0 then '' when c_custkey % 4 = 1 then 'rcm_z'
                    else 'rcm_' || {k('c_custkey % (select count(*) from part)')} || '' end
                   as cursor,
               case when c_custkey % 5 = 0 then '7' when c_custkey % 5 = 1 then ' 5 '
                    when c_custkey % 5 = 2 then '-1' when c_custkey % 5 = 3 then '101'
                    else '+20' end as limit_text
        from customer where c_custkey % 10 <> 9"""
}
_CLAMPED = (
    "case when c_custkey % 5 = 0 then 7 when c_custkey % 5 in (1, 2) then 50 "
    "when c_custkey % 5 = 3 then 100 else 20 end"
)


def _requests(fx: Fixture) -> DataFrame:
    key = F.col("c_custkey")
    parts = fx.raw("part").count()
    return (
        fx.raw("customer")
        .filter(key % 10 != 9)
        .select(
            ident("can", key).alias("candidate_id"),
            F.when(key % 4 == 0, "")
            .when(key % 4 == 1, "rcm_z")
            .otherwise(F.concat(F.lit("rcm_"), padded(key % parts)))
            .alias("cursor"),
            F.when(key % 5 == 0, "7")
            .when(key % 5 == 1, " 5 ")
            .when(key % 5 == 2, "-1")
            .when(key % 5 == 3, "101")
            .otherwise("+20")
            .alias("limit_text"),
        )
    )


@query(
    "keyset_filter",
    """select r.candidate_id, r.id as recommendation_id, q.cursor
       from v_recommendations r join v_requests q on q.candidate_id = r.candidate_id
       where q.cursor = '' or r.id > q.cursor""",
    _CURSOR_VIEWS,
)
def keyset_filter(fx: Fixture) -> DataFrame:
    rows = fx.recommendations.select("candidate_id", F.col("id").alias("recommendation_id"))
    requests = _requests(fx).select("candidate_id", "cursor")
    return paging.keyset_filter(rows, requests, "candidate_id", "recommendation_id")


@query(
    "page_top_n",
    paged_sql(
        """select r.candidate_id, r.id as recommendation_id,
                  case q.limit_text when '7' then 7 when '101' then 100 when '+20' then 20
                       else 50 end as size
           from v_recommendations r join v_requests q on q.candidate_id = r.candidate_id
           where q.cursor = '' or r.id > q.cursor""",
        "candidate_id",
        "recommendation_id",
        "candidate_id, recommendation_id",
        "size",
    ),
    _CURSOR_VIEWS,
)
def page_top_n(fx: Fixture) -> DataFrame:
    rows = fx.recommendations.select("candidate_id", F.col("id").alias("recommendation_id"))
    requests = _requests(fx).select(
        "candidate_id", "cursor", req.page_limit("limit_text").alias("limit")
    )
    found = paging.keyset_filter(rows, requests, "candidate_id", "recommendation_id")
    return paging.page_top_n(found, "candidate_id", "recommendation_id", "limit").drop(
        "cursor", "limit"
    )


_LIMIT_TEXTS = {
    "v_limit_texts": """
        select event_id, case event_id % 8 when 0 then null when 1 then '0' when 2 then '-3'
                   when 3 then user_id::varchar when 4 then ' 5 ' when 5 then 'abc'
                   when 6 then '99999999999999999999' else '+' || event_id end as limit_text
        from events"""
}


@query(
    "page_limit_clamp",
    """select event_id, limit_text,
              case when regexp_full_match(limit_text, '[+-]?[0-9]+')
                        and try_cast(ltrim(limit_text, '+') as bigint) > 0
                   then cast(least(try_cast(ltrim(limit_text, '+') as bigint), 100) as integer)
                   else 50 end as "limit"
       from v_limit_texts""",
    _LIMIT_TEXTS,
)
def page_limit_clamp(fx: Fixture) -> DataFrame:
    kind, event = F.col("event_id") % 8, F.col("event_id").cast("string")
    text = (
        F.when(kind == 1, "0")
        .when(kind == 2, "-3")
        .when(kind == 3, F.col("user_id").cast("string"))
        .when(kind == 4, " 5 ")
        .when(kind == 5, "abc")
        .when(kind == 6, "99999999999999999999")
        .when(kind == 7, F.concat(F.lit("+"), event))
    )
    texts = fx.raw("events").select("event_id", text.alias("limit_text"))
    return texts.withColumn("limit", req.page_limit("limit_text"))


# The dual feed's requests: every user with a role, half of them showing reacted
# items, some on a later page, some with a part exhausted or switched off.
_DUAL_VIEWS = {
    "v_first_recruiter": "select user_id, min(id) as recruiter_id from v_recruiters group by 1",
    "v_dual_requests": """
        select u.id as user_id, c.id as candidate_id, r.recruiter_id,
               cast(substr(u.id, 5) as bigint) % 3 = 0 as hide_reacted,
               case cast(substr(u.id, 5) as bigint) % 7 when 1 then 'done'
                    when 2 then 'rcm_0000000040' else '' end as pos_cursor,
               case cast(substr(u.id, 5) as bigint) % 6 when 5 then 'done' else '' end
                   as can_cursor,
               cast(substr(u.id, 5) as bigint) % 8 = 3 as skip_positions,
               cast(substr(u.id, 5) as bigint) % 9 = 4 as skip_candidates
        from v_users u left join v_candidates c on c.user_id = u.id
        left join v_first_recruiter r on r.user_id = u.id
        where c.id is not null or r.recruiter_id is not null""",
    "v_dual_positions": """
        select q.user_id, r.id as recommendation_id, p.id as position_id, p.title,
               coalesce(p.company, '') as company, p.description,
               row_number() over (partition by q.user_id order by r.id) as rn,
               count(*) over (partition by q.user_id) as n
        from v_dual_requests q join v_recommendations r on r.candidate_id = q.candidate_id
        join v_positions p on p.id = r.position_id
        left join v_reactions x on x.recommendation_id = r.id and x.reactor_type = 'candidate'
             and x.reactor_id = q.candidate_id
        where not q.skip_positions and q.pos_cursor <> 'done'
          and (q.pos_cursor = '' or r.id > q.pos_cursor)
          and (not q.hide_reacted or x.recommendation_id is null)""",
    "v_dual_candidates": """
        select q.user_id, r.id as recommendation_id, c.id as candidate_id, u.full_name, c.about,
               row_number() over (partition by q.user_id order by r.id) as rn,
               count(*) over (partition by q.user_id) as n
        from v_dual_requests q join v_positions p on p.recruiter_id = q.recruiter_id
        join v_recommendations r on r.position_id = p.id
        join v_candidates c on c.id = r.candidate_id join v_users u on u.id = c.user_id
        left join v_reactions x on x.recommendation_id = r.id and x.reactor_type = 'recruiter'
             and x.reactor_id = q.recruiter_id
        where not q.skip_candidates and q.can_cursor <> 'done'
          and (q.can_cursor = '' or r.id > q.can_cursor)
          and (not q.hide_reacted or x.recommendation_id is null)""",
    "v_dual_position_parts": """
        select user_id, least(max(n), 50) as n,
               case when max(n) > 50 then max(case when rn = 50 then recommendation_id end)
                    else 'done' end as next
        from v_dual_positions group by user_id""",
    "v_dual_candidate_parts": """
        select user_id, least(max(n), 50) as n,
               case when max(n) > 50 then max(case when rn = 50 then recommendation_id end)
                    else 'done' end as next
        from v_dual_candidates group by user_id""",
    "v_dual_pages": """
        select q.user_id, cast(50 as integer) as "limit", q.hide_reacted,
               coalesce(p.n, 0) + coalesce(c.n, 0) as count,
               coalesce(p.next, 'done') <> 'done' or coalesce(c.next, 'done') <> 'done'
                   as has_next,
               coalesce(p.next, 'done') as positions_next,
               coalesce(c.next, 'done') as candidates_next
        from v_dual_requests q left join v_dual_position_parts p on p.user_id = q.user_id
        left join v_dual_candidate_parts c on c.user_id = q.user_id""",
}


def dual_page(fx: Fixture) -> DataFrame:
    number = F.substring("user_id", 5, 10).cast("bigint")
    requests = (
        feeds.feed_owners(fx.users, fx.candidates, fx.recruiters)
        .withColumn("hide_reacted", number % 3 == 0)
        .withColumn(
            "pos_cursor",
            F.when(number % 7 == 1, "done").when(number % 7 == 2, "rcm_0000000040").otherwise(""),
        )
        .withColumn("can_cursor", F.when(number % 6 == 5, "done").otherwise(""))
        .withColumn("skip_positions", number % 8 == 3)
        .withColumn("skip_candidates", number % 9 == 4)
        .withColumn("limit", F.lit(50))
    )
    # Both are read before the pages are returned.
    with written_pair(fx) as (recommendations, reactions):
        return feeds.dual_feed_page(requests, recommendations, fx.positions, fx.candidates, fx.users, reactions)


@query("dual_feed_page", "select * from v_dual_pages", _DUAL_VIEWS)
def dual_feed_page(fx: Fixture) -> DataFrame:
    return dual_page(fx).drop("positions", "candidates")


@query(
    "paginate_all",
    """select candidate_id, recommendation_id, page,
              coalesce(max(case when rn % 50 = 0 then recommendation_id end) over (
                  partition by candidate_id order by page
                  range between 1 preceding and 1 preceding), '') as cursor
       from (select candidate_id, id as recommendation_id, rn, (rn + 49) // 50 as page
             from (select *, row_number() over (partition by candidate_id order by id) as rn
                   from v_recommendations))""",
)
def paginate_all(fx: Fixture) -> DataFrame:
    rows = fx.recommendations.select("candidate_id", F.col("id").alias("recommendation_id"))
    return paging.paginate_all(rows, "candidate_id", "recommendation_id")


@query(
    "page_index",
    """select candidate_id, recommendation_id, position_id, page,
              coalesce(max(case when rn % 50 = 0 then recommendation_id end) over (
                  partition by candidate_id order by page
                  range between 1 preceding and 1 preceding), '') as cursor
       from (select candidate_id, id as recommendation_id, position_id, rn, (rn + 49) // 50 as page
             from (select *, row_number() over (partition by candidate_id order by id) as rn
                   from v_recommendations))""",
)
def page_index_query(fx: Fixture) -> DataFrame:
    """Store all recommendations with their fences, then read every page of every candidate."""
    folder = new_folder(fx.spark, "pages")
    rows = fx.recommendations.select("candidate_id", F.col("id").alias("recommendation_id"), "position_id")
    page_index.build(rows, "candidate_id", "recommendation_id", folder)
    held = page_index.fences(fx.spark, folder).groupBy("candidate_id").agg(F.sum("rows").alias("rows"))
    asked = held.select("candidate_id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("rows") / 50))).alias("page"))
    return page_index.read_pages(fx.spark, folder, asked, "candidate_id", "recommendation_id")


@query(
    "page_counts",
    """select reactor_id, least(count(*), 50) as count, count(*) > 50 as has_next,
              case when count(*) > 50
                   then max(case when rn = 50 then recommendation_id end) else '' end
                  as next_cursor
       from (select *, row_number() over (partition by reactor_id order by recommendation_id)
                 as rn from v_reactions where reactor_type = 'candidate')
       group by reactor_id""",
)
def page_counts(fx: Fixture) -> DataFrame:
    return paging.page_counts(feeds.reaction_history(fx.reactions), "reactor_id")
