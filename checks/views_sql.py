"""SQL twins of the fixture views, for the oracle."""

from __future__ import annotations

import re


def k(expr: str) -> str:
    return f"lpad(cast({expr} as varchar), 10, '0')"


_PAIR = f"'rcm_' || {k('l_partkey')} || {k('o_custkey')}"
_LINE_KEY = (
    f"{k('l_orderkey')} || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey"
    " || '-' || cast(l_extendedprice as decimal(12,2))"
)

VIEWS: dict[str, str] = {
    "v_users": f"""
        select 'usr_' || {k('c_custkey')} as id,
               case when c_custkey % 3 = 0 then 'apple' else 'google' end as provider,
               'p-' || c_custkey as provider_user_id,
               case when c_custkey % 7 <> 0 then 'u' || c_custkey || '@example.com' end as email,
               c_name as full_name
        from customer""",
    "v_candidates": f"""
        select 'can_' || {k('c_custkey')} as id, 'usr_' || {k('c_custkey')} as user_id,
               c_mktsegment as about
        from customer where c_custkey % 10 <> 9""",
    "v_recruiters": f"""
        select 'rec_' || {k('s_suppkey')} as id,
               'usr_' || {k('case when s_suppkey % 10 = 1 then s_suppkey - 1 else s_suppkey end')}
                   as user_id
        from supplier""",
    "v_positions": f"""
        select 'pos_' || {k('p_partkey')} as id,
               'rec_' || {k('p_partkey % (select count(*) from supplier)')} as recruiter_id,
               p_name as title, p_type as description,
               case when p_size % 5 <> 0 then p_brand end as company
        from part""",
    "v_lo": """
        select * from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 10 <> 9""",
    "v_recommendation_batch": f"""
        select {_PAIR} as id, 'pos_' || {k('l_partkey')} as position_id,
               'can_' || {k('o_custkey')} as candidate_id,
               cast(round(abs(l_discount) * 10, 1) as decimal(3,2)) as score,
               {_LINE_KEY} as seq
        from v_lo""",
    "v_recommendations": f"""
        select {_PAIR} as id, 'pos_' || {k('l_partkey')} as position_id,
               'can_' || {k('o_custkey')} as candidate_id,
               cast(round(max(abs(l_discount)) * 10, 1) as decimal(3,2)) as score
        from v_lo group by l_partkey, o_custkey""",
    "v_reaction_log": f"""
        select {_PAIR} as recommendation_id, 'candidate' as reactor_type,
               'can_' || {k('o_custkey')} as reactor_id,
               case l_returnflag when 'A' then 'positive' when 'R' then 'negative'
                    else 'neutral' end as reaction_type,
               l_shipdate as created_at, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
               {_LINE_KEY} as seq
        from v_lo where l_quantity > 20
        union all
        select {_PAIR}, 'recruiter',
               'rec_' || {k('l_partkey % (select count(*) from supplier)')},
               case l_linestatus when 'O' then 'positive' else 'negative' end,
               l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, {_LINE_KEY}
        from v_lo where l_quantity <= 35""",
    "v_reactions": """
        select recommendation_id, reactor_type, reactor_id, reaction_type, created_at
        from (select *, row_number() over (
                  partition by recommendation_id, reactor_type, reactor_id
                  order by created_at, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
                           reaction_type) as rn
              from v_reaction_log) where rn = 1""",
    "v_embeddings": f"""
        select case when vec_id % 2 = 0 then 'can_' || {k('vec_id // 2')}
                    else 'pos_' || {k('(vec_id - 1) // 2')} end as object_id,
               case when vec_id % 2 = 0 then 'candidate' else 'position' end as object_type,
               case when vec_id % 10 in (3, 8, 6, 7) then null else embedding end as embedding,
               case when vec_id % 10 in (3, 8) then 'failed'
                    when vec_id % 10 in (6, 7) then 'pending' else 'done' end as status
        from embeddings""",
    "v_refresh_tokens": f"""
        select 'rtk_' || {k('event_id')} as jti, 'usr_' || {k('user_id')} as user_id,
               ts + interval 30 day as expires_at,
               case when event_id % 97 <> 0 then event_id % 10 = 0 end as revoked
        from events where event_type = 'signup'""",
    # Step by step, so that every join has a whole reaction key on one side.
    "v_owned": """
        select r.id, r.candidate_id, r.position_id, p.recruiter_id
        from v_recommendations r join v_positions p on p.id = r.position_id""",
    "v_liked": """
        select o.*, c.created_at as c_at from v_owned o join v_reactions c
        on c.recommendation_id = o.id and c.reactor_id = o.candidate_id
        where c.reactor_type = 'candidate' and c.reaction_type = 'positive'""",
    "v_pairs": """
        select l.candidate_id, l.position_id, l.c_at, e.created_at as r_at
        from v_liked l join v_reactions e
        on e.recommendation_id = l.id and e.reactor_id = l.recruiter_id
        where e.reactor_type = 'recruiter' and e.reaction_type = 'positive'""",
    "v_matches": """
        select candidate_id, position_id, greatest(c_at, r_at) as created_at from v_pairs""",
    "v_sign_ins": """
        select event_id as seq,
               case when user_id % 3 = 0 then 'apple' else 'google' end as provider,
               case when user_id % 11 = 0 then 'x-' else 'p-' end || user_id as provider_user_id
        from events where event_type = 'click'""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it uses, directly or through other views."""
    views = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in views and name not in ordered:
                visit(views[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    # Large and often read twice, or steps of a join.
    once = {"v_reactions", "v_recommendations", "v_owned", "v_liked", "v_pairs"}
    parts = [f"{n} as {'materialized ' if n in once else ''}({views[n]})" for n in ordered]
    return "with " + ",\n".join(parts) + "\n" + sql
