"""Pages read through fences equal the pages of all rows, from few folders."""

import random
import shutil

import pytest

from matchspark.operators import page_index, paging


def rows_of(spark):
    """One owner holds a third of the rows."""
    rng = random.Random(3)
    made = [("hot" if i % 3 == 0 else f"o{rng.randrange(40)}", f"k{i * 7919 % 6000:05d}", i) for i in range(6000)]
    return spark.createDataFrame(made, "who string, id string, n int")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "index")
    rows = rows_of(spark).unionByName(spark.createDataFrame([(None, "k", 1), ("hot", None, 2)], "who string, id string, n int"))
    page_index.build(rows, "who", "id", path, 12)
    return path


@pytest.mark.parametrize("limit", [1, 7, 50, 100])
def test_all_pages_equal_paginate_all(spark, index, limit):
    want = paging.paginate_all(rows_of(spark), "who", "id", limit)
    got = page_index.read_pages(spark, index, want.select("who", "page"), "who", "id", limit)
    assert set(got.columns) == {"who", "id", "n", "page", "cursor"}
    columns = ["who", "id", "page", "cursor"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_single_pages_open_their_folders_only(spark, index, tmp_path):
    found = page_index.fences(spark, index)
    assert found.select("slice").distinct().count() == 12
    want = {}
    for r in paging.paginate_all(rows_of(spark), "who", "id", 50).collect():
        want.setdefault((r.who, r.page), []).append((r.id, r.cursor))
    for i, (who, page) in enumerate([("hot", 1), ("hot", 17), ("o3", 2)]):
        asked = spark.createDataFrame([(who, page), (who, page)], "who string, page int")
        which = {r["slice"] for r in page_index.slices_of(asked, found, "who", 50).collect()}
        assert 1 <= len(which) <= 2
        # A file of another folder ends the query if it is opened.
        path = tmp_path / str(i)
        shutil.copytree(index, path, ignore=shutil.ignore_patterns("*.crc"))
        for file in path.glob("rows/slice=*/*.parquet"):
            if int(file.parent.name.split("=")[1]) not in which:
                file.write_bytes(b"not to be read")
        got = page_index.read_pages(spark, str(path), asked, "who", "id")
        assert sorted((r.id, r.cursor) for r in got.collect()) == sorted(want[who, page])


def test_pages_that_are_not_there(spark, index):
    asked = spark.createDataFrame([("hot", 0), ("hot", -1), ("hot", 9999), ("nobody", 1), (None, 1), ("hot", None)], "who string, page int")
    assert page_index.read_pages(spark, index, asked, "who", "id").count() == 0


def test_blocks_of_ranks(spark, index, monkeypatch):
    monkeypatch.setattr(page_index, "BLOCK", 64)
    test_all_pages_equal_paginate_all(spark, index, 7)
    test_all_pages_equal_paginate_all(spark, index, 100)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "index")
    page_index.build(rows_of(spark).limit(0), "who", "id", path)
    asked = spark.createDataFrame([("hot", 1)], "who string, page int")
    assert page_index.read_pages(spark, path, asked, "who", "id").count() == 0
