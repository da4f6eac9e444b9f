"""Sign-in facts, names, scopes, seed loading, documents and streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.feed_queries import _DUAL_VIEWS, dual_page
from checks.fixture import NOW, REACTION_ORDER, Fixture, ident, timestamp_ntz, written_pair
from checks.query import query
from matchspark.functions import names, requests, roles
from matchspark.functions.usernames import ADJECTIVES, NOUNS, ROUNDS, WIDTH, assign_user_names, user_name_at
from matchspark.operators import identity
from matchspark.operators.ingest import REACTION_KEY, first_per_key
from matchspark.operators.integrity import union_all
from matchspark.plans.materialize import delete_folder, freed, materialize, move_folder, new_folder, scratch
from matchspark.schemas import TABLES
from matchspark.sources import export
from matchspark.sources.document_source import last_documents, write_owner_documents
from matchspark.sources.seed import SeedStep, load_seed
from matchspark.streaming.keyed import STATE_SETTINGS, start_keyed
from matchspark.streaming.matches import stream_matches
from matchspark.streaming.pairs import all_matches, pair_events, start_pairs
from matchspark.streaming.reactions import create_table, store_reactions, stored_reactions

_ROLE_VIEWS = {
    "v_known": """
        select u.id as user_id, u.provider, u.provider_user_id, c.id as candidate_id,
               r.recruiter_id, r.n as recruiters
        from v_users u left join v_candidates c on c.user_id = u.id
        left join (select user_id, min(id) as recruiter_id, count(*) as n from v_recruiters
                   group by user_id) r on r.user_id = u.id""",
}


@query(
    "user_by_provider",
    """
    select s.seq, s.provider, s.provider_user_id, k.user_id, k.candidate_id, k.recruiter_id,
           case when k.user_id is null then 'not_found'
                when k.candidate_id is null and k.recruiter_id is null then 'no_role'
                else 'ok' end as outcome
    from v_sign_ins s left join v_known k
      on k.provider = s.provider and k.provider_user_id = s.provider_user_id""",
    _ROLE_VIEWS,
)
def user_by_provider(fx: Fixture) -> DataFrame:
    return identity.user_by_provider(fx.sign_ins, fx.users, fx.candidates, fx.recruiters)


@query(
    "user_roles",
    """
    select q.user_id, q.provider,
           case when coalesce(k.recruiters, 0) <= 1 then k.candidate_id end as candidate_id,
           case when coalesce(k.recruiters, 0) <= 1 then k.recruiter_id end as recruiter_id,
           case when k.recruiters > 1 then 'ambiguous' when k.user_id is null then 'not_found'
                when k.candidate_id is null and k.recruiter_id is null then 'no_role'
                else 'ok' end as outcome
    from (select id as user_id, case when id like '%7' then 'google' else provider end as provider
          from v_users) q
    left join v_known k on k.user_id = q.user_id and k.provider = q.provider""",
    _ROLE_VIEWS,
)
def user_roles(fx: Fixture) -> DataFrame:
    asked = fx.users.select(
        F.col("id").alias("user_id"),
        F.when(F.col("id").like("%7"), "google").otherwise(F.col("provider")).alias("provider"),
    )
    return identity.user_roles(asked, fx.users, fx.candidates, fx.recruiters)


_CLAIM_VIEWS = {
    "v_claims": """
        select p_partkey as k, case when p_partkey % 2 = 1 then 'google' else 'apple' end
                   as provider,
               case when p_partkey % 2 = 0
                    then case when p_partkey % 10 = 0 then 'bad' else 'ok' end
                    else case p_partkey % 12 when 1 then 'bad' when 3 then 'unverified'
                              when 5 then 'tags' when 7 then 'digits' when 9 then 'bad'
                              else 'ok' end end as kind,
               p_partkey % 8 as u, p_name
        from part""",
}


@query(
    "claims_to_users",
    """
    select k, provider,
           case when provider = 'google' and kind in ('ok', 'tags')
                  or provider = 'apple' and kind = 'ok' then 'p-' || k end as provider_user_id,
           case when provider = 'google' and kind in ('ok', 'tags') then 'g' || k || '@example.com'
                when provider = 'apple' and kind = 'ok' then '' end as email,
           case when provider = 'google' and kind in ('ok', 'tags')
                then 'O&#39;' || p_name
                when provider = 'apple' and kind = 'ok'
                then case u when 2 then p_name || ' B' when 6 then p_name || ' ' else '' end
                end as full_name,
           case kind when 'bad' then 'unreadable_claims' when 'unverified'
                then 'email_not_verified' when 'digits' then 'name_forbidden_chars' end as error
    from v_claims""",
    _CLAIM_VIEWS,
)
def claims_to_users(fx: Fixture) -> DataFrame:
    key = F.col("p_partkey")
    text = key.cast("string")

    def google(name, verified="true", sub=None):
        return F.concat(
            F.lit('{"sub": '),
            F.concat(F.lit('"p-'), text, F.lit('"')) if sub is None else sub,
            F.lit(', "email": "g'),
            text,
            F.lit(f'@example.com", "email_verified": {verified}, "name": "'),
            name,
            F.lit('", "locale": "en"}'),
        )

    name = F.concat(F.lit("O'"), "p_name")
    case = key % 12
    claims = (
        F.when(
            key % 2 == 0,
            F.concat(
                F.lit('{"sub": "p-'),
                text,
                F.when(key % 10 == 0, '", "email_verified": true}').otherwise(
                    '", "email_verified": "true"}'
                ),
            ),
        )
        .when(case == 1, "not json")
        .when(case == 3, google(name, "false"))
        .when(case == 5, google(F.concat(F.lit(" <b>"), name, F.lit("</b>"))))
        .when(case == 7, google(F.concat(F.lit("R2D2 "), name)))
        .when(case == 9, google(name, sub=text))
        .otherwise(google(name))
    )
    last = key % 8
    user = (
        F.when(last == 0, "")
        .when(
            last == 2,
            F.concat(
                F.lit('{"name": {"firstName": "'), "p_name", F.lit('", "lastName": "B"}}')
            ),
        )
        .when(last == 4, "oops")
        .when(last == 6, F.concat(F.lit('{"name": {"firstName": "'), "p_name", F.lit('"}}')))
    )
    made = fx.raw("part").select(
        key.alias("k"),
        F.when(key % 2 == 1, "google").otherwise("apple").alias("provider"),
        claims.alias("claims_json"),
        user.alias("user_json"),
    )
    return identity.claims_to_users(made)


@query(
    "signin_outcome",
    """
    select s.seq, s.provider, s.provider_user_id, k.user_id,
           case when k.user_id is null
                then case when s.seq = min(s.seq) over (
                              partition by s.provider, s.provider_user_id)
                          then 'create_user' else 'onboarding' end
                when k.candidate_id is null and k.recruiter_id is null then 'onboarding'
                else 'token_pair' end as outcome
    from v_sign_ins s left join v_known k
      on k.provider = s.provider and k.provider_user_id = s.provider_user_id""",
    _ROLE_VIEWS,
)
def signin_outcome(fx: Fixture) -> DataFrame:
    return identity.signin_outcome(fx.sign_ins, fx.users, fx.candidates, fx.recruiters)


@query(
    "session_state",
    f"""
    select e.jti, case when t.jti is null or t.expires_at <= timestamp '{NOW}' then 'invalid'
                       when t.revoked is null then 'error' when t.revoked then 'revoked'
                       else 'active' end as state
    from (select 'rtk_' || lpad(cast(event_id as varchar), 10, '0') as jti from events) e
    left join v_refresh_tokens t on t.jti = e.jti""",
)
def session_state(fx: Fixture) -> DataFrame:
    asked = fx.raw("events").select(ident("rtk", "event_id").alias("jti"))
    return identity.session_state(asked, fx.refresh_tokens, timestamp_ntz(NOW))


def _holders(fx: Fixture) -> DataFrame:
    known = identity.roles_of(
        fx.users.select(F.col("id").alias("user_id")), fx.candidates, fx.recruiters
    )
    none = F.col("candidate_id").isNull() & F.col("recruiter_id").isNull()
    return known.withColumn("onboarding", none)


@query(
    "role_scope",
    """
    select user_id, concat_ws(' ',
               case when candidate_id is not null then 'role:candidate' end,
               case when recruiter_id is not null then 'role:recruiter' end,
               case when candidate_id is null and recruiter_id is null
                    then 'role:onboarding' end) as scope
    from v_known""",
    _ROLE_VIEWS,
)
def role_scope(fx: Fixture) -> DataFrame:
    scope = roles.role_scope("candidate_id", "recruiter_id", "onboarding")
    return _holders(fx).select("user_id", scope.alias("scope"))


@query(
    "token_lifetime",
    """
    select user_id,
           cast(case when candidate_id is null and recruiter_id is null then 86400
                     else 1800 end as integer) as expires_in,
           cast(case when candidate_id is null and recruiter_id is null then 86400
                     else 600 end as integer) as expires_in_override,
           cast(2592000 as integer) as refresh_expires_in
    from v_known""",
    _ROLE_VIEWS,
)
def token_lifetime(fx: Fixture) -> DataFrame:
    return _holders(fx).select(
        "user_id",
        roles.access_lifetime("onboarding").alias("expires_in"),
        roles.access_lifetime("onboarding", 600).alias("expires_in_override"),
        roles.refresh_lifetime().alias("refresh_expires_in"),
    )


# -- row rules -------------------------------------------------------------------------

_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def clean_sql(texts: str, longest: int) -> str:
    """``texts`` gives source, id and raw."""
    return f"""
        select source, id,
               case when good and length(bare) <= {longest} then replace(bare, '''', '&#39;') end
                   as value,
               case when not good then 'forbidden_chars' when length(bare) > {longest}
                    then 'too_long' end as error
        from (select *, regexp_matches(bare, '\\A[a-zA-Z\\t\\n\\f\\r ''-]+\\z') as good
              from (select source, id, regexp_replace(regexp_replace(raw,
                        '\\A[{_SPACE}]+|[{_SPACE}]+\\z', '', 'g'), '<[^>]*>', '', 'g') as bare
                    from ({texts})))"""


_NAME_TEXTS = """
    select 'part' as source, p_partkey as id,
           case p_partkey % 7 when 0 then ' ' || p_name || ' ' when 1 then '<b>' || p_name || '</b>'
                when 2 then 'O''' || p_name when 3 then p_name || chr(160)
                when 4 then p_name || chr(8232) when 5 then p_name || chr(11) || p_name
                else repeat(p_name, 12) end as raw
    from part
    union all select 'customer', c_custkey, c_name from customer
    union all select 'conversations', conv_id * 1000 + turn, text from conversations
    union all select 'pages', page_id, html from pages"""


@query("clean_names", clean_sql(_NAME_TEXTS, 128))
def clean_names(fx: Fixture) -> DataFrame:
    kind, name = F.col("p_partkey") % 7, F.col("p_name")
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), name, F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("<b>"), name, F.lit("</b>")))
        .when(kind == 2, F.concat(F.lit("O'"), name))
        .when(kind == 3, F.concat(name, F.lit(" ")))
        .when(kind == 4, F.concat(name, F.lit(" ")))
        .when(kind == 5, F.concat(name, F.lit("\u000b"), name))
        .otherwise(F.repeat(name, 12))
    )
    parts = [
        fx.raw("part").select(
            F.lit("part").alias("source"), F.col("p_partkey").alias("id"), raw.alias("raw")
        ),
        fx.raw("customer").select(F.lit("customer"), "c_custkey", "c_name"),
        fx.raw("conversations").select(
            F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text"
        ),
        fx.raw("pages").select(F.lit("pages"), "page_id", "html"),
    ]
    texts = reduce(DataFrame.unionAll, parts)
    return names.clean_names(texts, "raw").drop("raw")


_ABOUT_TEXTS = """
    select 'documents' as source, doc_id as id, text as raw from documents
    union all select 'customer', c_custkey, c_mktsegment from customer
    union all select 'conversations', conv_id * 1000 + turn, text from conversations
    union all select 'part', p_partkey, repeat(p_name || ' <i>', 1 + p_size) from part"""


@query("clean_abouts", clean_sql(_ABOUT_TEXTS, 500))
def clean_abouts(fx: Fixture) -> DataFrame:
    repeated = F.expr("repeat(concat(p_name, ' <i>'), 1 + p_size)")
    parts = [
        fx.raw("documents").select(
            F.lit("documents").alias("source"),
            F.col("doc_id").alias("id"),
            F.col("text").alias("raw"),
        ),
        fx.raw("customer").select(F.lit("customer"), "c_custkey", "c_mktsegment"),
        fx.raw("conversations").select(
            F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text"
        ),
        fx.raw("part").select(F.lit("part"), "p_partkey", repeated),
    ]
    texts = reduce(DataFrame.unionAll, parts)
    return names.clean_abouts(texts, "raw").drop("raw")


def _name_views(positions: str, out: str, seed: str = "n", width: int = WIDTH) -> dict[str, str]:
    """Views ending in ``out`` (position, user_name) for a view with ``position``: one for each round."""
    side = 10 * 4**width
    views = {f"{out}_0": f"select position, position // {side} as a, position % {side} as b from {positions}"}
    for i in range(ROUNDS):
        shift = f"cast('0x' || substr(sha256('{seed}|{i}|' || b), 1, 12) as bigint) % {side}"
        views[f"{out}_{i + 1}"] = f"select position, b as a, (a + {shift}) % {side} as b from {out}_{i}"
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    pair = f"(number // {16**width})"
    views[out] = f"""
        select position, {words(ADJECTIVES)}[{pair} // 10 % 10 + 1] || '_' || {words(NOUNS)}[{pair} % 10 + 1]
               || printf('%0{width}x', number % {16**width}) as user_name
        from (select position, a * {side} + b as number from {out}_{ROUNDS})"""
    return views


@query(
    "assign_usernames",
    """select i.id, m.user_name
       from (select id, row_number() over (order by id) as rank from v_users) i
       join (select position, row_number() over (order by position) as rank from v_free) f using (rank)
       join v_name m using (position)""",
    {
        "v_taken_position": "select distinct 3 * cast(substr(id, 5) as bigint) as position from v_users where id like '%5'",
        "v_free": """
            select unnest(range(0, (select count(*) from v_users) + (select count(*) from v_taken_position))) as position
            except select position from v_taken_position""",
        **_name_views("v_free", "v_name"),
    },
)
def assign_usernames(fx: Fixture) -> DataFrame:
    """A tenth of the users' number of names is taken already, some within the positions that come next."""
    ids = fx.users.select("id")
    places = ids.filter("id like '%5'").select((3 * F.substring("id", 5, 20).cast("bigint")).alias("position"))
    taken = places.select(user_name_at(F.col("position"), "n").alias("user_name"))
    return assign_user_names(ids, "id", taken, seed="n")


_SWITCH_VIEWS = {
    "v_switches": """
        select event_id, case event_id % 7 when 0 then null when 1 then '' when 2 then 'google'
                   when 3 then 'apple' when 4 then 'true' when 5 then 'false' else event_type end
                   as raw
        from events""",
}


def _switches(fx: Fixture) -> DataFrame:
    kind = F.col("event_id") % 7
    raw = (
        F.when(kind == 1, "")
        .when(kind == 2, "google")
        .when(kind == 3, "apple")
        .when(kind == 4, "true")
        .when(kind == 5, "false")
        .when(kind == 6, F.col("event_type"))
    )
    return fx.raw("events").select("event_id", raw.alias("raw"))


@query(
    "normalise_provider",
    """select event_id, raw, case when coalesce(raw, '') = '' then 'google'
              when raw in ('google', 'apple') then raw end as provider from v_switches""",
    _SWITCH_VIEWS,
)
def normalise_provider(fx: Fixture) -> DataFrame:
    return _switches(fx).withColumn("provider", requests.normalise_provider("raw"))


@query(
    "exclude_flag",
    """select event_id, raw, coalesce(raw, '') <> 'false' as exclude_reacted,
              coalesce(raw, '') = 'true' as switched_off from v_switches""",
    _SWITCH_VIEWS,
)
def exclude_flag(fx: Fixture) -> DataFrame:
    return (
        _switches(fx)
        .withColumn("exclude_reacted", requests.exclude_reacted("raw"))
        .withColumn("switched_off", requests.part_switched_off("raw"))
    )


@query(
    "validate_reaction",
    """select seq, reactor, reaction, coalesce(reactor in ('candidate', 'recruiter'), false)
                  and coalesce(reaction in ('positive', 'negative', 'neutral'), false) as valid
       from (select event_id as seq,
                    case event_id % 4 when 0 then 'candidate' when 1 then 'recruiter'
                         when 2 then 'Candidate' end as reactor,
                    case event_id % 5 when 0 then 'positive' when 1 then 'negative'
                         when 2 then 'neutral' when 3 then event_type end as reaction
             from events)""",
)
def validate_reaction(fx: Fixture) -> DataFrame:
    key = F.col("event_id")
    reactor = (
        F.when(key % 4 == 0, "candidate").when(key % 4 == 1, "recruiter").when(
            key % 4 == 2, "Candidate"
        )
    )
    reaction = (
        F.when(key % 5 == 0, "positive")
        .when(key % 5 == 1, "negative")
        .when(key % 5 == 2, "neutral")
        .when(key % 5 == 3, F.col("event_type"))
    )
    rows = fx.raw("events").select(
        key.alias("seq"), reactor.alias("reactor"), reaction.alias("reaction")
    )
    return rows.withColumn(
        "valid",
        requests.valid_reactor_type("reactor") & requests.valid_reaction_type("reaction"),
    )


# -- seed ------------------------------------------------------------------------------

# Suppliers own the parts; the first positions step runs before the odd suppliers
# are recruiters, the second one repeats all parts.
_SEED_VIEWS = {
    "v_seed_parts": """
        select p_partkey, p_name as title, p_type as description,
               case when p_size % 5 <> 0 then p_brand end as company, o, o % 4 = 0 as early,
               'u' || o || '@example.com' as email
        from (select *, p_partkey % (select count(*) from supplier) as o from part)
        where (o % 4 = 0 or o % 2 = 1) and o % 7 <> 0""",
    # A key goes to the first row of the first step that has it; no key, no conflict.
    "v_seed_positions": """
        select email, title, description, company
        from (select *, row_number() over (partition by title, description, company
                                           order by early desc, p_partkey) as rn
              from v_seed_parts where company is not null) where rn = 1
        union all select email, title, description, company from v_seed_parts
        where company is null and early
        union all select email, title, description, company from v_seed_parts
        where company is null""",
    "v_seed_candidates": """
        select 'u' || c_custkey || '@example.com' as email, c_mktsegment as about from customer
        where c_custkey % 2 = 0 and c_custkey % 7 <> 0""",
}


@query(
    "seed_insert_select",
    """
    select 'users' as table_name,
           case when c_custkey % 7 <> 0 then 'u' || c_custkey || '@example.com' end as email,
           'p-' || c_custkey as first_text, c_name as second_text, c_name as third_text
    from customer
    union all select 'candidates', email, about, null, null from v_seed_candidates
    union all select 'recruiters', 'u' || s_suppkey || '@example.com', null, null, null
    from supplier where (s_suppkey % 4 = 0 or s_suppkey % 2 = 1) and s_suppkey % 7 <> 0
    union all select 'positions', email, title, description, company from v_seed_positions
    union all select 'embeddings', email, 'candidate', 'pending', about from v_seed_candidates
    union all select 'embeddings', email, 'position', 'pending', title from v_seed_positions""",
    _SEED_VIEWS,
)
def seed_insert_select(fx: Fixture) -> DataFrame:
    customer, supplier = fx.raw("customer"), fx.raw("supplier")
    key = F.col("c_custkey")

    def email(k):
        return F.when(
            k % 7 != 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))
        )

    users = customer.select(
        "c_custkey",
        F.lit("google").alias("provider"),
        F.concat(F.lit("p-"), key.cast("string")).alias("provider_user_id"),
        email(key).alias("email"),
        F.col("c_name").alias("full_name"),
        F.col("c_name").alias("user_name"),
    )
    people = customer.select(email(key).alias("email"), F.col("c_mktsegment").alias("about"))
    owners = supplier.select("s_suppkey", email(F.col("s_suppkey")).alias("email"))
    jobs = fx.raw("part").select(
        email(F.col("p_partkey") % fx.suppliers).alias("email"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("description"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("company"),
        # Keeps two parts with equal texts apart.
        F.col("p_partkey").alias("row"),
    )
    steps = [
        SeedStep("users", users.filter(key % 2 == 0).drop("c_custkey")),
        SeedStep("candidates", people),
        SeedStep("recruiters", owners.filter("s_suppkey % 4 = 0").select("email")),
        SeedStep("positions", jobs, ["row"]),
        SeedStep("users", users.drop("c_custkey")),
        SeedStep("recruiters", owners.filter("s_suppkey % 2 = 1").select("email")),
        SeedStep("positions", jobs, ["row"]),
    ]
    empty = _empty_tables(fx)
    loaded = load_seed(empty, steps, timestamp_ntz("2024-01-01"))
    emails = loaded["users"].select(F.col("id").alias("user_id"), "email")
    people = loaded["candidates"].join(emails, "user_id")
    owners = loaded["recruiters"].join(emails, "user_id")
    owned = loaded["positions"].join(
        owners.select(F.col("id").alias("recruiter_id"), "email"), "recruiter_id"
    )
    queued = people.select("id", "email", F.col("about").alias("label")).unionByName(
        owned.select("id", "email", F.col("title").alias("label"))
    )
    queued = loaded["embeddings"].join(queued.withColumnRenamed("id", "object_id"), "object_id")

    def rows(name: str, df: DataFrame, *texts: str) -> DataFrame:
        places = ["first_text", "second_text", "third_text"]
        filled = [F.col(c) for c in texts] + [F.lit(None).cast("string")] * (3 - len(texts))
        return df.select(
            F.lit(name).alias("table_name"), "email", *[c.alias(n) for c, n in zip(filled, places)]
        )

    return union_all(
        [
            rows("users", loaded["users"], "provider_user_id", "full_name", "user_name"),
            rows("candidates", people, "about"),
            rows("recruiters", owners),
            rows("positions", owned, "title", "description", "company"),
            rows("embeddings", queued, "object_type", "status", "label"),
        ]
    )


def _empty_tables(fx: Fixture) -> dict[str, DataFrame]:
    return {
        name: fx.spark.createDataFrame(
            [], T.StructType([T.StructField(f.name, f.dataType, True) for f in t.columns.fields])
        )
        for name, t in TABLES.items()
    }


# -- documents -------------------------------------------------------------------------

_DOCUMENT_VIEWS = {
    **_DUAL_VIEWS,
    "v_position_items": """
        select user_id, cast(to_json(list({
                   '_links': {
                       'reaction': {'href': '/v1/me/recommendations/' || recommendation_id
                                            || '/reaction'},
                       'self': {'href': '/v1/me/recommendations/' || recommendation_id}},
                   'company': company, 'description': description, 'position_id': position_id,
                   'recommendation_id': recommendation_id, 'title': title}
                   order by recommendation_id)) as varchar) as items
        from v_dual_positions where rn <= 50 group by user_id""",
    "v_candidate_items": """
        select user_id, cast(to_json(list({
                   '_links': {
                       'reaction': {'href': '/v1/me/recommendations/' || recommendation_id
                                            || '/reaction'},
                       'self': {'href': '/v1/me/recommendations/' || recommendation_id}},
                   'about': about, 'candidate_id': candidate_id, 'full_name': full_name,
                   'recommendation_id': recommendation_id}
                   order by recommendation_id)) as varchar) as items
        from v_dual_candidates where rn <= 50 group by user_id""",
}


_EXPORT_SQL = """
    select d.user_id,
           '{' || case when p.items is null and c.items is null then ''
                       else '"_embedded":{' || concat_ws(',', '"candidates":' || c.items,
                            '"positions":' || p.items) || '},' end
           || '"_links":{' || case when d.has_next
                then '"next":{"href":"/v1/me/recommendations?pos_cursor=' || d.positions_next
                     || '&can_cursor=' || d.candidates_next || '&limit=50&exclude_reacted='
                     || d.hide_reacted || '"},' else '' end
           || '"reactions":{"href":"/v1/me/reactions"},'
           || '"self":{"href":"/v1/me/recommendations?exclude_reacted=' || d.hide_reacted
           || '"}},"page":{"limit":50,"count":' || d.count || ',"has_next":' || d.has_next
           || '},"status":"success"}' as document
    from v_dual_pages d left join v_position_items p on p.user_id = d.user_id
    left join v_candidate_items c on c.user_id = d.user_id"""


@query("feed_export", _EXPORT_SQL, _DOCUMENT_VIEWS)
def feed_export(fx: Fixture) -> DataFrame:
    """Write the documents as text lines and read them back with their owner."""
    documents = export.feed_documents(dual_page(fx))
    folder = new_folder(fx.spark, "documents")
    with freed(fx.spark):
        documents.write.option("compression", "gzip").json(folder)
    return fx.spark.read.schema("user_id string, document string").json(folder)


@query("document_source", _EXPORT_SQL, _DOCUMENT_VIEWS)
def document_source(fx: Fixture) -> DataFrame:
    """The same documents through the sink that publishes a run as a whole."""
    folder = new_folder(fx.spark, "documents")
    write_owner_documents(export.feed_documents(dual_page(fx)), "user_id", folder, file_owners=1000, compressed=True)
    return last_documents(fx.spark, folder).withColumnRenamed("owner", "user_id")


# -- streams ---------------------------------------------------------------------------


def _by_year(fx: Fixture, folder: str | None = None) -> tuple[DataFrame, list[int]]:
    """The reaction log written once in folders by year, of which a year reads its own, and its years.

    Its ``seq`` stays away, as the streams order rows by the columns it is made of.
    """
    folder, log = folder or new_folder(fx.spark, "log"), fx.reaction_log.drop("seq")
    year = F.year("created_at")
    with freed(fx.spark):
        log.withColumn("year", year).write.option("compression", "zstd").partitionBy("year").parquet(folder)
        stored = fx.spark.read.schema(T.StructType([*log.schema.fields, T.StructField("year", T.IntegerType())])).parquet(folder)
        return stored, [r[0] for r in stored.select("year").distinct().orderBy(1).collect()]


def stored_by_stream(fx: Fixture) -> str:
    """Feed the reaction log year by year through the stream; the table's folder."""
    spark = fx.spark
    source, table = new_folder(spark, "stream-in"), new_folder(spark, "reactions")
    checkpoint, folder = new_folder(spark, "stream-state"), new_folder(spark, "log")
    by_year, years = _by_year(fx, folder)
    log = by_year.drop("year")
    create_table(spark, table)
    order = ["created_at", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
             "reaction_type"]
    with freed(spark):
        for year in [y for y in years if y is not None]:
            move_folder(spark, f"{folder}/year={year}", f"{source}/year={year}")
            stream = spark.readStream.schema(log.schema).parquet(f"{source}/*")
            run = store_reactions(stream, table, checkpoint, order)
            run.trigger(availableNow=True).start().awaitTermination()
            # The batch is committed, so its input is read no more.
            delete_folder(spark, f"{source}/year={year}")
    return table


@query("stream_reactions", "select * from v_reactions")
def stream_reactions(fx: Fixture) -> DataFrame:
    return stored_reactions(fx.spark, stored_by_stream(fx)).drop("batch")


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Settings of streams with state; such a stream keeps the partition count of its first start."""
    settings = {**STATE_SETTINGS, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    kept = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@query("stream_reactions_keyed", "select * from v_reactions")
def stream_reactions_keyed(fx: Fixture) -> DataFrame:
    """What was stored before 1995, and what a keyed stream accepts of the log from then on, year by year."""
    spark, folder = fx.spark, new_folder(fx.spark, "log")
    by_year, years = _by_year(fx, folder)
    log = by_year.drop("year")
    source, table, checkpoint = (new_folder(spark, name) for name in ("stream-in", "reactions", "stream-state"))
    columns = ["recommendation_id", "reactor_type", "reactor_id", "reaction_type", "created_at"]
    before = by_year.filter("year < 1995").drop("year")
    stored = materialize(first_per_key(before, REACTION_KEY, REACTION_ORDER).select(*columns), "stored")
    with state_settings(spark):
        for year in [y for y in years if y is not None and y >= 1995]:
            move_folder(spark, f"{folder}/year={year}", f"{source}/year={year}")
            stream = spark.readStream.schema(log.schema).parquet(f"{source}/*")
            start_keyed(stream, stored, table, checkpoint, REACTION_ORDER, availableNow=True).awaitTermination()
            # The batch is committed, so its input is read no more.
            delete_folder(spark, f"{source}/year={year}")
    return stored.unionByName(spark.read.schema(log.schema).parquet(table).select(*columns))


@query(
    "stream_matches",
    """select candidate_id, position_id, greatest(c_at, r_at) as created_at
       from v_pairs
       where abs(epoch(r_at) - epoch(c_at)) <= 400 * 86400""",
)
def stream_matches_query(fx: Fixture) -> DataFrame:
    table = stored_by_stream(fx)
    out, checkpoint = new_folder(fx.spark, "matches"), new_folder(fx.spark, "stream-state")
    stored = stored_reactions(fx.spark, table)
    stream = (
        fx.spark.readStream.schema(stored.drop("batch").schema)
        .option("maxFilesPerTrigger", 64)
        .parquet(f"{table}/batch=*")
    )
    # Every batch of the stream reads them.
    recommendations, positions = (materialize(df, "owned") for df in (fx.recommendations, fx.positions))
    # The table is written year by year, so no row is 400 days behind; older state is dropped.
    found = stream_matches(stream, recommendations, positions, "400 days", "400 DAYS")
    run = found.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    # Rows of 400 days are too many for the executors' heaps, where Spark keeps state by default.
    with state_settings(fx.spark), freed(fx.spark):
        run.option("path", out).trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.schema(found.schema).parquet(out)


@query("stream_pairs", "select * from v_matches")
def stream_pairs(fx: Fixture) -> DataFrame:
    """Pairs within thirty days as they come, in two spans of years, and sides that missed each other; all matches."""
    spark = fx.spark
    source, out, checkpoint = (new_folder(spark, name) for name in ("stream-in", "pairs", "stream-state"))
    # Every batch of the stream reads recommendations and positions.
    with written_pair(fx) as (recommendations, reactions), scratch(fx.positions, "owned") as positions, state_settings(spark):
        year = F.year("created_at")
        # A reaction of no recommendation, years later, ends the waiting of all others.
        last = reactions.limit(1).withColumns(
            {"recommendation_id": F.lit("none"), "reaction_type": F.lit("positive"), "created_at": F.col("created_at") + F.expr("interval 99 years")}
        )
        parts = [reactions.filter(year < 1996), reactions.filter(year >= 1996).unionByName(last)]
        for number, rows in enumerate(parts):
            rows.write.option("compression", "zstd").parquet(f"{source}/part={number}")
            stream = spark.readStream.schema(reactions.schema).parquet(f"{source}/*")
            events = pair_events(stream, recommendations, positions, "1 day", 30)
            start_pairs(events, out, checkpoint, availableNow=True).awaitTermination()
            # The part is committed, so its input is read no more.
            delete_folder(spark, f"{source}/part={number}")
    return all_matches(spark, out)
