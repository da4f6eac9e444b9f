"""Embeddings and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixture import Fixture, OnceFixture, timestamp_ntz
from checks.query import query
from checks.write_queries import ulid_sql
from matchspark.operators import cells, ingest, matching, vectors

DIMENSION = 64


def nearest_sql(k: int) -> str:
    return f"""
        select left_id, right_id, score, rank from (
            select left_id, right_id, score,
                   cast(row_number() over (partition by left_id order by score desc, right_id)
                        as integer) as rank
            from (select c.object_id as left_id, p.object_id as right_id,
                         round(list_inner_product(cast(c.embedding as double[]),
                                                  cast(p.embedding as double[])), 6) as score
                  from v_embeddings c, v_embeddings p
                  where c.object_type = 'candidate' and c.status = 'done'
                    and p.object_type = 'position' and p.status = 'done'))
        where rank <= {k}"""


@query("inner_product_topk", nearest_sql(10))
def inner_product_topk(fx: Fixture) -> DataFrame:
    return vectors.inner_product_topk(fx.embeddings, 10, dimension=DIMENSION)


@query(
    "recommend",
    """
    select n.left_id as candidate_id, n.right_id as position_id,
           cast(round(cast(greatest(0.0, least(1.0, n.score)) as decimal(7,6)), 2)
                as decimal(3,2)) as score
    from v_nearest n left join v_recommendations r
      on r.candidate_id = n.left_id and r.position_id = n.right_id
    where r.id is null""",
    {"v_nearest": nearest_sql(50)},
)
def recommend(fx: Fixture) -> DataFrame:
    nearest = vectors.inner_product_topk(fx.embeddings, 50, dimension=DIMENSION)
    return matching.recommend(nearest, fx.recommendations)


@query(
    "recommend_new",
    f"""
    select {ulid_sql('rcm', '1707523200000', "'s|' || position_id || '|' || candidate_id")} as id,
           candidate_id, position_id, score
    from (select n.left_id as candidate_id, n.right_id as position_id,
                 cast(round(cast(greatest(0.0, least(1.0, n.score)) as decimal(7,6)), 2)
                      as decimal(3,2)) as score,
                 row_number() over (partition by n.left_id order by n.score desc, n.right_id) as rn
          from v_all n left join v_recommendations r
            on r.candidate_id = n.left_id and r.position_id = n.right_id
          where r.id is null)
    where rn <= 10""",
    {"v_all": nearest_sql(1_000_000_000)},
)
def recommend_new(fx: Fixture) -> DataFrame:
    """Pairs recommended before are passed over before the ten nearest are taken."""
    fx = OnceFixture(fx, tables=True)
    return matching.recommend_new(
        fx.embeddings, fx.recommendations, 10, timestamp_ntz("2024-02-10"), seed="s", dimension=DIMENSION
    )


@query(
    "approx_topk_quality",
    """
    select count(*) as candidates, true as scores_exact, true as ranks_gapless,
           true as recall_reached
    from v_embeddings where object_type = 'candidate' and status = 'done'""",
)
def approx_topk_quality(fx: Fixture) -> DataFrame:
    """Twelve tables with probing, held against the exact search: recall of 0.9 over all candidates."""
    exact = vectors.inner_product_topk(fx.embeddings, 10, dimension=DIMENSION)
    near = vectors.inner_product_topk_approx(
        fx.embeddings, 10, dimension=DIMENSION, tables=12, probe=True
    )
    pairs = near.select("left_id", "right_id", F.col("score").alias("near_score"))
    per_left = near.groupBy("left_id").agg(F.max("rank").alias("last"), F.count("*").alias("n"))
    found = (
        exact.join(pairs, ["left_id", "right_id"], "left")
        .groupBy("left_id")
        .agg(
            F.count("*").alias("wanted"),
            F.count("near_score").alias("hits"),
            F.bool_and(F.coalesce(F.col("near_score") == F.col("score"), F.lit(True))).alias("same"),
        )
        .join(per_left, "left_id", "left")
    )
    return found.agg(
        F.count("*").alias("candidates"),
        F.bool_and("same").alias("scores_exact"),
        F.bool_and(F.coalesce(F.col("last") == F.col("n"), F.lit(False))).alias("ranks_gapless"),
        (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("recall_reached"),
    )


@query("inner_product_topk_approx")
def inner_product_topk_approx(fx: Fixture) -> DataFrame:
    """The setting that ``approx_topk_quality`` holds against the exact search."""
    return vectors.inner_product_topk_approx(
        fx.embeddings, 10, dimension=DIMENSION, tables=12, probe=True
    )


@query(
    "unusable_vectors",
    """
    select object_id, object_type, case when embedding is null then 'no_vector' else 'wrong_length' end as reason
    from (select object_id, object_type, status,
                 case when vec_id % 4 = 0 then null when vec_id % 4 = 1 then embedding[1:63] else embedding end as embedding
          from (select *, cast(substr(object_id, 5) as bigint) as vec_id from v_embeddings))
    where status = 'done' and (embedding is null or len(embedding) <> 64)""",
)
def unusable_vectors(fx: Fixture) -> DataFrame:
    """A quarter of the vectors gone and a quarter cut short."""
    place = F.substring("object_id", 5, 20).cast("bigint") % 4
    cut = F.when(place == 1, F.slice("embedding", 1, 63)).when(place != 0, F.col("embedding"))
    return vectors.unusable_vectors(fx.embeddings.withColumn("embedding", cut), DIMENSION)


def held_against_exact(fx: Fixture, near: DataFrame) -> DataFrame:
    """Per candidate: its exact top ten, how many of them ``near`` has, and whether its scores are the same."""
    exact = vectors.inner_product_topk(fx.embeddings, 10, dimension=DIMENSION)
    pairs = near.select("left_id", "right_id", F.col("score").alias("near_score"))
    return (
        exact.join(pairs, ["left_id", "right_id"], "left")
        .groupBy("left_id")
        .agg(
            F.count("*").alias("wanted"),
            F.count("near_score").alias("hits"),
            F.bool_and(F.coalesce(F.col("near_score") == F.col("score"), F.lit(True))).alias("same"),
        )
    )


@query(
    "cells_topk_quality",
    """
    select object_id as left_id, cast(10 as bigint) as wanted, true as scores_exact, true as all_recall_reached,
           true as a_fifth_compared
    from v_embeddings where object_type = 'candidate' and status = 'done'""",
)
def cells_topk_quality(fx: Fixture) -> DataFrame:
    """The search over learnt cells beside the exact one: recall of 0.9 over all candidates, at most a fifth of all pairs scored."""
    near = cells.inner_product_topk_cells(fx.embeddings, 10, dimension=DIMENSION)
    found = held_against_exact(fx, near)
    rights = vectors.done_vectors(fx.embeddings, "position", "right_id", DIMENSION)
    recall = found.agg((F.sum("hits") >= 0.9 * F.sum("wanted")).alias("reached")).scalar()
    fifth = rights.agg((F.count("*") >= 5 * 30).alias("fifth")).scalar()
    return found.select(
        "left_id", "wanted", F.col("same").alias("scores_exact"), recall.alias("all_recall_reached"), fifth.alias("a_fifth_compared")
    )


@query("inner_product_topk_cells")
def inner_product_topk_cells(fx: Fixture) -> DataFrame:
    """The setting that ``cells_topk_quality`` holds against the exact search."""
    return cells.inner_product_topk_cells(fx.embeddings, 10, dimension=DIMENSION)


@query(
    "embed_pending",
    """
    select q.object_id, q.object_type,
           case when p.id is null then 'failed' else 'done' end as status,
           case when p.id is not null then cast(64 as integer) end as dimension,
           case when p.id is not null then cast(1.0 as double) end as norm
    from (select object_id, object_type from v_embeddings where status = 'pending'
          union all
          select n.id, n.kind from v_profiles n left join v_embeddings e
            on e.object_id = n.id and e.object_type = n.kind where e.object_id is null) q
    left join v_profiles p on p.id = q.object_id and p.kind = q.object_type""",
    {
        "v_profiles": """
            select id, 'candidate' as kind from v_candidates
            union all select id, 'position' from v_positions""",
    },
)
def embed_pending(fx: Fixture) -> DataFrame:
    """Every profile without a vector is queued, then embedded; the hash is not known to SQL."""
    _, made = _queue_and_made(fx)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2)
    return made.select(
        "object_id",
        "object_type",
        "status",
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"),
        F.round(F.sqrt(squares), 3).alias("norm"),
    )


def _queue_and_made(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    now = timestamp_ntz("2024-02-10")
    queue = fx.embeddings.withColumn("created_at", now).withColumn("updated_at", now)
    pending = vectors.enqueue_embeddings(queue, fx.candidates, fx.positions, now)
    texts = vectors.profile_texts(fx.candidates, fx.positions)
    queue = queue.unionByName(pending)
    return queue, vectors.embed_pending(queue, texts, now, DIMENSION)


@query(
    "merge_embeddings",
    """
    select q.object_id, q.object_type,
           case when q.status <> 'pending' then q.status
                when p.id is null then 'failed' else 'done' end as status,
           case when q.status <> 'pending' then q.dimension
                when p.id is not null then cast(64 as integer) end as dimension,
           case when q.status = 'pending' then timestamp '2024-02-11'
                else timestamp '2024-02-10' end as updated_at
    from (select object_id, object_type, status, cast(len(embedding) as integer) as dimension
          from v_embeddings
          union all
          select n.id, n.kind, 'pending', null from v_profiles n left join v_embeddings e
            on e.object_id = n.id and e.object_type = n.kind where e.object_id is null) q
    left join v_profiles p on p.id = q.object_id and p.kind = q.object_type""",
    {
        "v_profiles": """
            select id, 'candidate' as kind from v_candidates
            union all select id, 'position' from v_positions""",
    },
)
def merge_embeddings(fx: Fixture) -> DataFrame:
    """The new vectors and failures in the stored snapshot, by its key of two columns."""
    queue, made = _queue_and_made(fx)
    changed = made.withColumn("changed", F.array(F.lit("embedding"), F.lit("status")))
    merged = ingest.apply_updates(
        queue, changed, vectors.OBJECT_KEY, ["embedding", "status"], timestamp_ntz("2024-02-11"), "changed"
    )
    return merged.select(
        "object_id",
        "object_type",
        "status",
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"),
        "updated_at",
    )
