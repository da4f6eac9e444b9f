import random

import pytest
from llm_frames import words
from pyspark.sql import functions as F

import corpus_pipeline
from matchspark.llm import decontam, queries


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(3)
    item, passage, base = words(rng, 30, 10**6), words(rng, 60, 10**6), words(rng, 200, 10**6)
    rows, labels = [], []
    for i in range(200):
        rows.append([i, "\n".join(words(rng, 40, 10**6) for _ in range(3)), "en", f"s{i % 4}", 0])
        labels.append((i, 1, 0))
    for i in (1, 2, 3):  # copies and a near copy
        rows[i][1] = base
    near = base.split()
    near[100] = "changed"
    rows[3][1] = " ".join(near[:100]) + "\n" + " ".join(near[100:])
    for i in (10, 11, 12):
        rows[i][1] += "\n" + passage
    rows[20][1] += " " + item
    for i in range(30, 60):
        rows[i][1] += " you idiot moron and pathetic loser"
        labels[i] = (i, 1, 1)
    rows += [[200, None, None, None, None], [201, "", "en", "s1", 0]]
    folder = str(tmp_path / "in")
    write(spark, folder, [tuple(r) for r in rows], labels, [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = str(tmp_path / name)
        out.write.parquet(path)
        if name != "mixing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert set(range(202)) - set(seen["toxicity"]) == set(range(30, 60))
    assert [passage in seen["line_dedup"][i] for i in (10, 11, 12)] == [True, False, False]
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    assert seen["line_dedup"][200] is None
    assert 20 in seen["near_dedup"] and 20 not in seen["decontamination"]
    assert len(seen["near_dedup"]) - len(seen["decontamination"]) == 1
    assert set(seen["mixing"]) <= set(seen["decontamination"])
    run = corpus_pipeline.run(spark, folder)
    assert run.count() == docs.count()
    assert [r["position"] for r in run.select("position").collect()] == sorted(r["position"] for r in run.select("position").collect())


def test_stages_on_empty_documents(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    if name == "op13_centroid_clusters":
        assert sorted(r["vec_id"] for r in rows) == [r[0] for r in duck.execute("select vec_id from embeddings order by 1").fetchall()]
    elif name not in ("pipeline", "op6_chat_format", "op8_exact_topk"):
        assert sorted(r["doc_id"] for r in rows) == list(range(200))
    if name in queries.ORACLE:
        cursor = duck.execute(queries.ORACLE[name])
        columns = [d[0] for d in cursor.description]
        order = [columns.index(c) for c in df.columns]
        plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
        theirs = sorted((plain([r[i] for i in order]) for r in cursor.fetchall()), key=str)
        assert sorted((plain(r) for r in rows), key=str) == theirs


def test_native_plan(spark, sf_dir):
    plan = queries.op10_curriculum_mix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_verbatim_matches_on_the_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontam.verbatim_matches(docs, bench).select(F.explode("matches").alias("m")).select("m.*")
    assert found.count() > 0 and found.agg(F.min("n_words")).first()[0] >= 1


def test_near_duplicates_from_four_fifths_on(spark, tmp_path):
    """Texts of 196 shingles: four changed words leave 0.815 of them in common, five 0.774."""
    rng = random.Random(8)
    rows = []
    for i, changes in ((0, 4), (2, 5)):
        one = words(rng, 200, 10**6).split()
        two = [f"new{at}" if at in range(20, 20 + 30 * changes, 30) else w for at, w in enumerate(one)]
        rows += [(i, " ".join(one), "en", "s", 0), (i + 1, " ".join(two), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2, 3]
