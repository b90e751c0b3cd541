"""Grouped passes, lookups, folds, encodings, metrics, blends on hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.functions import aggregates as agg
from creditloom.functions import scalar as sc
from creditloom.operators import blending as bl
from creditloom.operators import folds as fo
from creditloom.operators import grouped as g
from creditloom.operators import lookup as lk
from creditloom.operators import metrics as m
from creditloom.operators import profiling as pr


def test_subset_without_rows_is_null(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "b", 3.0)], "k int, s string, v double")
    here = F.col("s") == "a"
    out = df.groupBy("k").agg(
        agg.subset(here, agg.total("v", here)).alias("t"), agg.subset(here, agg.rows(here)).alias("n"),
        agg.mean("v", here).alias("m"), agg.total("v").alias("all"),
    )
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (2.0, 1, 2.0, 2.0), 2: (None, None, None, 3.0)}


def test_statistics_of_empty_and_single_groups(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 4.0)], "k int, v double")
    got = {
        r["k"]: tuple(r)[1:]
        for r in df.groupBy("k").agg(*agg.stats("v", "v", "TOTAL MEAN STD MAX")).collect()
    }
    assert got == {1: (0.0, None, None, None), 2: (4.0, 4.0, None, 4.0)}


def test_scalar_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (6.0, 3.0, 70.0)], "a double, b double, c double")
    got = df.select(
        sc.ratio("a", "b").alias("r"), sc.per("a", F.lit(-1.0)).alias("z"),
        sc.clipped("c", 0, 50).alias("c"), sc.as_number(F.lit("x1")).alias("n"),
    ).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None), (2.0, None, 50.0, None)]


def test_distinct_counts_null_as_value(spark):
    rows = [(1, "x", 1), (1, None, 1), (1, "x", 2), (2, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, n int")
    got = {r["k"]: (r["a"], r["b"]) for r in g.distinct_counts(df, "k", {"a": "s", "b": "n"}).collect()}
    assert got == {1: (2, 2), 2: (1, 1)}


def test_one_pass_keeps_group_without_match(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "k int, v int")
    one = g.FeatureGroup(aggregates=[agg.rows().alias("n")], derived={"d": F.col("n") + 1})
    two = g.FeatureGroup(aggregates=[agg.top("v").alias("t")], distinct={"u": "v"})
    got = {r["k"]: (r["n"], r["d"], r["t"], r["u"]) for r in g.roll_up(df, "k", one, two).collect()}
    assert got == {1: (1, 2, 5, 1), 2: (1, 2, 7, 1)}


@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_broadcast_and_salted_agree(spark, small):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"c{i}") for i in range(200)], "id int, c string")
    table = spark.createDataFrame([("hot", 1.0), ("c0", 2.0), ("c3", 3.0)], "c string, v double")
    got = {r["id"]: r["v"] for r in lk.lookup_join(rows, table, ["c"], small).collect()}
    values = {"hot": 1.0, "c0": 2.0, "c3": 3.0}
    assert got == {i: values.get("hot" if i % 3 else f"c{i}") for i in range(200)}


def test_folds_keep_class_shares(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1000)], "SK_ID_CURR long, TARGET int")
    out = fo.stratified_folds(df)
    counts = {(r["TARGET"], r["fold"]): r["count"] for r in out.groupBy("TARGET", "fold").count().collect()}
    for label in (0, 1):
        sizes = [counts[label, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = {r["SK_ID_CURR"]: r["fold"] for r in fo.stratified_folds(df.repartition(7)).collect()}
    assert again == {r["SK_ID_CURR"]: r["fold"] for r in out.collect()}


def test_fold_encoding_by_subtraction(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 1), i % 3) for i in range(60)]
    rows += [(60, "only here", 1, 0)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, NAME_INCOME_TYPE string, TARGET int, fold int")
    got = {r["SK_ID_CURR"]: r["TE_NAME_INCOME_TYPE"] for r in fo.encode_folds(df).collect()}
    for key, category, _, fold in rows:
        outside = [r for r in rows if r[3] != fold]
        overall = sum(r[2] for r in outside) / len(outside)
        same = [r[2] for r in outside if category is not None and r[1] == category]
        want = (sum(same) + 10 * overall) / (len(same) + 10) if same else overall
        assert got[key] == pytest.approx(want)
    encodings = fo.fold_encodings(df, ["NAME_INCOME_TYPE"])
    whole = fo.encode_for_model(df, encodings, 1, ["NAME_INCOME_TYPE"])
    held = {r["SK_ID_CURR"]: r["TE_NAME_INCOME_TYPE"] for r in whole.where("fold = 1").collect()}
    assert all(held[k] == pytest.approx(got[k]) for k in held)


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def scores(n=300, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        out.append((i, y, *(round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2) for _ in range(4))))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        scores(), "SK_ID_CURR long, TARGET int, a double, b double, c double, d double"
    )


@pytest.mark.parametrize("window_scores", [10, 1_000_000])
def test_auc_counts_pairs(scored, window_scores):
    got = m.auc_exact(scored, "a", window_scores=window_scores).first()["auc"]
    assert got == pytest.approx(brute_auc([(r[2], r[1]) for r in scores()]), abs=1e-12)
    by = scored.withColumn("g", F.col("SK_ID_CURR") % 3)
    for r in m.auc_exact(by, "a", by=["g"], window_scores=window_scores).collect():
        want = brute_auc([(s[2], s[1]) for s in scores() if s[0] % 3 == r["g"]])
        assert r["auc"] == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "TARGET int, s double")
    assert m.auc_exact(df, "s").first()["auc"] is None


@pytest.mark.parametrize("window_scores", [10, 1_000_000])
def test_roc_points(scored, window_scores):
    rows = m.roc_points(scored, "a", window_scores=window_scores).collect()
    data = [(r[2], r[1]) for r in scores()]
    p = sum(y for _, y in data)
    for r in rows:
        hit = [y for s, y in data if s >= r["threshold"]]
        assert r["tpr"] == pytest.approx(sum(hit) / p)
        assert r["fpr"] == pytest.approx((len(hit) - sum(hit)) / (len(data) - p))


def test_threshold_table(scored):
    data = [(r[2], r[1]) for r in scores()]
    rows = m.threshold_table(scored, "a").collect()
    assert len(rows) == 18
    for r in rows:
        t = next(t for t in m.THRESHOLDS if round(t, 2) == r["threshold"])
        hit = [y for s, y in data if s >= t]
        assert r["true_positives"] == sum(hit)
        assert r["false_positives"] == len(hit) - sum(hit)
        assert r["decline_rate"] == pytest.approx(round(len(hit) / len(data), 4), abs=1e-4)
    assert {r["threshold"] for r in m.threshold_lookup(m.threshold_table(scored, "a")).collect()} == {
        0.1, 0.2, 0.3, 0.5,
    }


def test_grids_have_their_published_sizes():
    assert [len(w()) for w in (bl.weights_2, bl.weights_3, bl.weights_4)] == [41, 231, 286]


@pytest.mark.parametrize("names,grid", [("ab", bl.weights_2), ("abc", bl.weights_3), ("abcd", bl.weights_4)])
def test_best_blend_is_exact(scored, names, grid):
    data = scores(300)
    best, chosen = -1.0, None
    for w in grid():
        blend = []
        for row in data:
            s = w[0] * row[2]
            for weight, value in zip(w[1:], row[3:]):
                s = s + weight * value
            blend.append((s, row[1]))
        auc = brute_auc(blend)
        if auc > best + 1e-13:
            best, chosen = auc, w
    row = bl.best_blend(scored, list(names), grid()).first()
    assert row["auc"] == pytest.approx(best, abs=1e-12)
    assert tuple(row)[:-1] == pytest.approx(chosen)


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "x", 0.5), (2, None, None), (2, "x", 1.5)], "i int, s string, d double")
    got = {r["column"]: r.asDict() for r in pr.column_profile(df).collect()}
    assert (got["i"]["n_unique"], got["i"]["min"], got["i"]["max"]) == (2, 1.0, 2.0)
    assert (got["s"]["n_unique"], got["s"]["n_null"], got["s"]["mean"]) == (2, 1, None)
    assert got["d"]["mean"] == pytest.approx(1.0)


def test_missing_table_is_reported(spark):
    df = spark.createDataFrame([(1,)], "i int")
    out = pr.profile_all({"there": df, "gone": None})
    assert {(r["table"], r["column"]) for r in out.collect()} == {("there", "i"), ("gone", None)}
    text = pr.profile_markdown(out, g.count_values(df, "i"))
    assert "*File not found*" in text and "### there" in text and "- 1: 1 (100.0%)" in text


def test_rows_per_key(spark):
    df = spark.createDataFrame([(k,) for k in [1] + [2] * 2 + [3] * 3 + [4] * 6], "k int")
    r = g.rows_per_key(df, "k").first()
    assert (r["keys"], r["min"], r["max"], r["q50"], r["mean"]) == (4, 1, 6, 2.5, 3.0)
    assert r["std"] == pytest.approx(2.1602468994692865)


def _brute_auc(rows, weights):
    """(wins + ties / 2) over all pairs, blended from the left."""
    def blend(r):
        total = weights[0] * r[1]
        for w, v in zip(weights[1:], r[2:]):
            total = total + w * v
        return total

    pos, neg = ([blend(r) for r in rows if r[0] == y] for y in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("kind", ["near", "equal", "narrow", "outside"])
def test_best_of_nearly_equal_blends(spark, kind):
    """Models that are almost or wholly the same, scores in a narrow band or beyond 0..1."""
    rng = random.Random(kind)
    rows = []
    for i in range(250):
        y = rng.randint(0, 1)
        a = min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2)))
        if kind == "narrow":
            a = 0.08 + a / 100
        if kind == "outside":
            a = a * 3 - 1
        near = 0.0 if kind == "equal" else 1e-4 if kind == "near" else 1e-2
        rows.append((y, a, a + near * rng.gauss(0, 1), a + near * rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "TARGET int, a double, b double, c double").repartition(3)
    grid = bl.weights_3(0.05)
    aucs = [_brute_auc(rows, w) for w in grid]
    got = bl.best_blend(df, ["a", "b", "c"], grid).first()
    best = max(range(len(grid)), key=lambda i: (round(aucs[i], 12), -i))
    assert tuple(got)[:3] == grid[best] and got["auc"] == pytest.approx(aucs[best], abs=1e-12)
    every = {r["position"]: r["auc"] for r in bl.grid_auc(df, ["a", "b", "c"], grid).collect()}
    assert [every[i] for i in range(len(grid))] == pytest.approx(aucs, abs=1e-12)


def test_levels_never_fall_with_the_score():
    rng = np.random.default_rng(1)
    shape = np.sort(np.append(rng.random(bl.FIRST_LEVELS - 1), [0.0, 1.0]))
    shape[300:500] = shape[300]
    scores = np.sort(np.concatenate([rng.random(5000), np.linspace(0, 1, bl.FIRST_LEVELS + 1), [-3.0, 7.0]]))
    scores = np.sort(np.concatenate([scores, np.nextafter(scores, 9)]))
    for levels in (7, 1024, 100_000):
        level = bl._level(scores, shape, levels)
        assert (np.diff(level) >= 0).all() and level[0] == 0 and level[-1] == levels - 1


def test_missing_scores_are_an_error(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None)], "TARGET int, s double")
    for call in (m.auc_exact, m.roc_points, m.threshold_table):
        with pytest.raises(Exception, match="has no score"):
            call(df, "s").collect()
    with pytest.raises(Exception, match="has no score"):
        bl.best_blend(df.withColumn("t", F.lit(0.1)), ["s", "t"], bl.weights_2()).collect()


def test_estimated_profile(spark):
    rows = [(i, f"v{i % 700}", None if i % 3 else i / 7, None) for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, s string, d double, n string").repartition(4)
    exact = {r["column"]: r.asDict() for r in pr.column_profile(df).collect()}
    for r in pr.estimated_profile(df).collect():
        want = exact[r["column"]]
        assert abs(r["n_unique"] - want["n_unique"]) <= 4 * pr.SKETCH_ERROR * want["n_unique"]
        for name in ("dtype", "n_rows", "n_null", "min", "max"):
            assert r[name] == want[name]
        assert r["mean"] == pytest.approx(want["mean"])
    plan = pr.estimated_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1 and "Generate" in plan and "hashpartitioning" not in plan


def test_grid_ranking_spreads_its_scores(spark, monkeypatch):
    """Equal scores meet in as many tasks as rows times combinations need, with the same AUCs."""
    from creditloom.operators import blending

    rows = [(i, i * 7 % 3 == 0, (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, y boolean, a double, b double")
    df = df.withColumn("y", F.col("y").cast("int")).coalesce(1)
    grid = [(0.3, 0.7), (0.5, 0.5), (0.6, 0.4)]
    want = {r["position"]: r["auc"] for r in blending.grid_auc(df, ["a", "b"], grid, "y").collect()}
    seen, real = [], blending.auc_of_counts

    def counted(counts, *args):
        seen.append(counts.rdd.getNumPartitions())
        return real(counts, *args)

    monkeypatch.setattr(blending, "auc_of_counts", counted)
    monkeypatch.setattr(blending, "TASK_SCORES", 100)
    got = {r["position"]: r["auc"] for r in blending.grid_auc(df, ["a", "b"], grid, "y").collect()}
    assert seen == [12] and got == want
