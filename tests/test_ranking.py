"""Exact ranks and tiers: properties against pandas, with groups forced to split."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsift.operators import tiers as T
from keepsift.operators.ordering import evenly_spaced_sample
from keepsift.operators.ranking import running, top_rows

PROPERTY = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "image_id string, folder string, total double, v bigint"
ROWS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 12), st.integers(-5, 9)), min_size=1, max_size=80)


def frame(rows):
    return pd.DataFrame([(f"{i * 7919 % 65536:04x}{i:04x}", f, t * 8.0, v) for i, (f, t, v) in enumerate(rows)], columns=["image_id", "folder", "total", "v"])


@PROPERTY
@given(ROWS)
def test_running_split_equals_pandas(spark, rows):
    pdf = frame(rows)
    got = running(
        spark.createDataFrame(pdf, SCHEMA), [F.desc("total"), F.col("image_id")], ["folder"],
        sums={"s": F.col("v")}, maxima={"m": F.col("v")}, split_rows=3, parts=5,
    ).toPandas().sort_values("image_id")
    g = pdf.sort_values(["total", "image_id"], ascending=[False, True]).groupby("folder")
    pdf["row_no"], pdf["s"], pdf["m"] = g.cumcount() + 1, g["v"].cumsum(), g["v"].cummax()
    want = pdf.sort_values("image_id")
    for c in ("row_no", "s", "m"):
        assert list(got[c]) == list(want[c]), c


@PROPERTY
@given(ROWS, st.integers(0, 30))
def test_top_rows_equal_sorting(spark, rows, k):
    pdf = frame(rows)
    got = {r.image_id for r in top_rows(spark.createDataFrame(pdf, SCHEMA), F.lit(k), by=["folder"]).collect()}
    ordered = pdf.sort_values(["total", "image_id"], ascending=[False, True])
    assert got == set(ordered.groupby("folder").head(k)["image_id"])


def test_cut_inside_many_equal_scores_and_prefixes(spark, monkeypatch):
    from keepsift.operators import ranking

    # Ids that share their prefix, and more equal scores than one task may sort.
    monkeypatch.setattr(ranking, "SPLIT_ROWS", 50)
    df = spark.range(600).select(F.format_string("same%05d", (F.col("id") * 7) % 600).alias("image_id"), F.lit(5.0).alias("total"))
    got = sorted(r.image_id for r in top_rows(df, F.lit(333)).collect())
    assert got == [f"same{i:05d}" for i in range(333)]


@PROPERTY
@given(ROWS)
def test_tiers_partition_the_pool(spark, rows):
    pdf = frame(rows)
    got = T.assign_tiers(spark.createDataFrame(pdf, SCHEMA)).toPandas()
    n = len(pdf)
    s, a = max(1, math.ceil(n * 0.1)), math.ceil(n * 0.3)
    order = pdf.sort_values(["total", "image_id"], ascending=[False, True]).reset_index(drop=True)
    want = {
        r.image_id: "rejected" if r.total < 30 else "S" if i < s else "A" if i < s + a else "B" if i < s + 2 * a else "rejected"
        for i, r in order.iterrows()
    }
    assert dict(zip(got.image_id, got.tier)) == want


def score_rows(spark, totals, exceeds=()):
    rows = [(str(i), float(t), i in exceeds) for i, t in enumerate(totals)]
    return spark.createDataFrame(rows, "image_id string, total double, exceeds_face_limit boolean")


@pytest.mark.parametrize(
    "totals, exceeds, expected",
    [
        ([50 + 10 * i for i in range(10)], (), {"9": "S"}),
        ([85, 20], (), {"1": "rejected"}),
        ([90], (), {"0": "S"}),
        ([90, 25], (1,), {"0": "S", "1": "rejected"}),
    ],
)
def test_tier_cases(spark, totals, exceeds, expected):
    got = {r.image_id: r.tier for r in T.assign_tiers(score_rows(spark, totals, exceeds)).collect()}
    assert {k: got[k] for k in expected} == expected


def test_tiers_of_nothing(spark):
    assert T.assign_tiers(score_rows(spark, [1.0]).limit(0)).count() == 0


@pytest.mark.parametrize("strategy, keepers", [("stop", 4), ("fillWithB", 7), ("fillWithRejected", 8)])
def test_fill_shortfall(spark, strategy, keepers):
    rows = T.assign_tiers(score_rows(spark, [90, 80, 70, 60, 50, 45, 40, 35, 10, 5]))
    filled = T.fill_shortfall(rows, 8, strategy)
    assert T.keepers(filled).count() == keepers


def test_fill_shortfall_without_keepers(spark):
    rows = T.assign_tiers(score_rows(spark, [10, 5, 3]))
    assert sorted(r.image_id for r in T.keepers(T.fill_shortfall(rows, 2, "fillWithRejected")).collect()) == ["0", "1"]


@pytest.mark.parametrize("n, expected", [(100, [0, 24, 49, 74, 99]), (5, [0, 1, 2, 3, 4]), (3, [0, 1, 2]), (1, [0])])
def test_sample_places(spark, n, expected):
    df = spark.range(n).select(F.format_string("%05d", "id").alias("name"), "id")
    assert sorted(r.id for r in evenly_spaced_sample(df, [F.col("name")], parts=3).collect()) == expected


def test_override_of_unknown_or_undone(spark):
    rows = spark.createDataFrame([("a", "B"), ("b", "S"), ("c", "A")], "image_id string, tier string")
    log = spark.createDataFrame(
        [("a", "S", 1, False), ("a", "A", 2, True), ("zz", "S", 3, False), ("b", "gold", 4, False)],
        "image_id string, tier string, seq int, undone boolean",
    )
    assert {r.image_id: r.tier for r in T.apply_overrides(rows, log).collect()} == {"a": "S", "b": "S", "c": "A"}
