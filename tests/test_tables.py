"""Queries against their SQL, and stages on small literals."""

import glob
import math
import os

import duckdb
import pytest

from stagekit.base import FunctionEstimator, FunctionStage
from stagekit.operators import access, columns, metrics, profile, recommend, text
from stagekit.plans.registry import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda x: ("nan" if math.isnan(x) else repr(round(x, 9) + 0.0)) if isinstance(x, float) else repr(x)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = all_queries()[name](spark, SF)
    found = con.execute(all_oracles()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), names)


def test_stages_save_and_load(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    FunctionStage(columns.select_columns, cols=["y"]).write().overwrite().save(str(tmp_path / "s"))
    assert FunctionStage.load(str(tmp_path / "s")).transform(d).columns == ["y"]
    assert FunctionEstimator(profile.clean_missing, cols=["x"]).fit(d).transform(d).count() == 2


def test_missing_column(spark):
    with pytest.raises(ValueError):
        columns.select_columns(spark.range(1), ["nope"])


def test_indexer_levels(spark):
    d = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    fitted = profile.value_indexer(d, "v", "i")
    assert {(r.v, r.i) for r in fitted(d).collect()} == {("a", 0), ("b", 1), (None, 2)}
    assert {(r.v, r.i) for r in fitted(spark.createDataFrame([("z",)], "v string")).collect()} == {("z", 3)}


def test_pages_join_to_the_text():
    t = "word " * 50 + "x" * 100
    pages = text.split_pages(t, 20, 30)
    assert "".join(pages) == t and max(map(len, pages)) <= 30


def test_trie_takes_the_longest_and_skips_the_rest():
    assert text.Trie({"a": "1", "ab": "2"}).replace("abc a-b") == "2 1-b"


def test_ranking_metrics_cases(spark):
    row = lambda p, l: recommend.ranking_metrics(spark.createDataFrame([(p, l)], "prediction array<int>, label array<int>"), 10, 6).first()
    same = row([1, 2, 3], [1, 2, 3])
    assert (same["map"], same["ndcgAt"], same["mrr"], same["fcp"]) == (1.0, 1.0, 1.0, 1.0)
    apart = row([1, 2, 3], [4, 5, 6])
    assert (apart["map"], apart["mrr"], apart["fcp"], apart["diversityAtK"], apart["maxDiversity"]) == (0.0, 0.0, 0.0, 0.5, 1.0)
    assert row([3, 2, 1], [1, 2, 3])["fcp"] == pytest.approx(1 / 3)
    assert row([1, 2, 3, 4, 5, 6], [1, 2, 3])["recallAtK"] == 0.5


def test_access_scores(spark):
    u = spark.createDataFrame([("t", "a", [1.0, 2.0], 0), ("t", "b", [1.0, 0.0], 1)], "tenant string, user string, vec array<double>, component int")
    r = spark.createDataFrame([("t", "x", [3.0, 1.0], 0)], "tenant string, res string, vec array<double>, component int")
    h = spark.createDataFrame([("t", "a", "seen")], "tenant string, user string, res string")
    d = spark.createDataFrame([("t", "a", "x"), ("t", "b", "x"), ("t", "c", "x"), ("t", "a", "seen")], "tenant string, user string, res string")
    got = {(x.user, x.res): x.anomaly_score for x in access.score_access(d, u, r, h).collect()}
    assert got == {("a", "x"): 5.0, ("b", "x"): float("inf"), ("c", "x"): None, ("a", "seen"): 0.0}


def test_single_class_metrics(spark):
    d = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    assert metrics.binary_statistics(d).first()["accuracy"] == 1.0
