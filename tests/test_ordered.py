"""Ranks, halves, last rows and gaps, on ordinary and on very large keys."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from creditloom.operators import ordered as o


def skewed(seed=1, hot=400, keys=20):
    """One key holds most rows; times repeat, some rows are copies, some have no time."""
    rng = random.Random(seed)
    rows = []
    for key in [1] * hot + [rng.randint(2, keys) for _ in range(150)]:
        time = None if rng.random() < 0.05 else rng.randint(-12, -1)
        rows.append((key, time, rng.randint(1, 3), rng.choice([0, 0, 5, 9])))
    rows += [(1, -3, 2, 5)] * 60
    return rows


def groups(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def brute_halves(rows):
    out = {}
    for key, group in groups(rows).items():
        if len(group) < 4:
            continue
        timed = sorted((r for r in group if r[1] is not None), key=lambda r: (r[1], r[2], r[3]))
        cut = len(group) // 2
        out[key] = (timed[:cut], timed[cut:])
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed(), "k long, t int, loan int, v int").repartition(5)


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_halves_match_brute_force(frame, hot_rows):
    halves = o.split_halves(frame, "k", "t", ["loan", "v"], hot_rows=hot_rows)
    mean = o.half_mean(F.col("v") > 0, o.OLDER), o.half_mean(F.col("v"), o.RECENT)
    got = o.compare_halves(
        halves, "k",
        [mean[0].alias("older"), o.half_max(F.col("v"), o.OLDER).alias("older_max")],
        [mean[1].alias("recent"), o.half_max(F.col("v"), o.RECENT).alias("recent_max")],
    )
    seen = {r["k"]: r for r in got.collect()}
    want = {k: h for k, h in brute_halves(skewed()).items() if h[0] and h[1]}
    assert seen.keys() == want.keys()
    for key, (older, recent) in want.items():
        assert seen[key]["older"] == pytest.approx(sum(r[3] > 0 for r in older) / len(older))
        assert seen[key]["recent"] == pytest.approx(sum(r[3] for r in recent) / len(recent))
        assert seen[key]["older_max"] == max(r[3] for r in older)
        assert seen[key]["recent_max"] == max(r[3] for r in recent)


def test_large_keys_are_found_and_ranked_the_same(frame):
    hot = o.hot_keys(frame, "k", 50)
    assert [r["k"] for r in hot.collect()] == [1]
    assert o.hot_keys(frame, "k", 10_000) is None
    plain = o.ranked(frame, "k", "t", ["loan", "v"])
    spread = o.ranked(frame, "k", "t", ["loan", "v"], hot_rows=50)

    def rows(df):
        return sorted(map(str, df.select("k", "t", "loan", "v", o.RANK, o.SIZE, o.COPIES).collect()))

    assert plain.count() == frame.where("k is not null").count()
    assert rows(plain) == rows(spread)


@pytest.mark.parametrize("hot_rows", [3, 50])
def test_halves_and_gaps_have_the_same_rows_for_large_keys(frame, hot_rows):
    def rows(df):
        return sorted(map(str, df.collect()))

    columns = ["k", "t", "loan", "v", o.OLDER, o.RECENT]
    plain = o.split_halves(frame, "k", "t", ["loan", "v"]).select(columns)
    spread = o.split_halves(frame, "k", "t", ["loan", "v"], hot_rows=hot_rows).select(columns)
    assert rows(plain) == rows(spread)
    times = frame.select("k", "t")
    assert rows(o.with_gaps(times, "k", "t")) == rows(
        o.with_gaps(times, "k", "t", hot_rows).select("k", "t", "gap")
    )


def test_odd_size_and_short_groups(spark):
    rows = [(1, t, 0, t) for t in range(-5, 0)] + [(2, t, 0, t) for t in (-3, -2, -1)]
    df = spark.createDataFrame(rows, "k long, t int, loan int, v int")
    got = {(r["k"], r["t"]): r[o.RECENT] for r in o.split_halves(df, "k", "t", ["loan", "v"]).collect()}
    assert got == {(1, -5): 0, (1, -4): 0, (1, -3): 1, (1, -2): 1, (1, -1): 1}


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_gaps_match_brute_force(frame, hot_rows):
    names = {"min": "low", "mean": "mean", "std": "std"}
    got = {r["k"]: r for r in o.gap_statistics(frame, "k", "t", names, hot_rows).collect()}
    for key, group in groups(skewed()).items():
        times = sorted(r[1] for r in group if r[1] is not None)
        gaps = [b - a for a, b in zip(times, times[1:])]
        if not gaps:
            assert key not in got
            continue
        assert got[key]["low"] == min(gaps)
        assert got[key]["mean"] == pytest.approx(statistics.fmean(gaps))
        if len(gaps) > 1:
            assert got[key]["std"] == pytest.approx(statistics.stdev(gaps))
        else:
            assert got[key]["std"] is None


def test_last_rows_put_missing_times_first(frame):
    got = {}
    for r in o.last_rows(frame, "k", "t", ["loan", "v"], 3).collect():
        got.setdefault(r["k"], []).append((r["rn"], r["t"], r["loan"], r["v"]))
    for key, group in groups(skewed()).items():
        order = sorted(group, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2], r[3]))[:3]
        assert [x[1:] for x in sorted(got[key])] == [r[1:] for r in order]


def test_last_rows_limit_before_the_shuffle(frame):
    latest = o.last_rows(frame, "k", "t", ["loan", "v"], 3)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:], "rows are limited below the exchange"


def test_prefix_totals(spark):
    rows = [(i % 3, (i * 37) % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, s int, n int")
    got = o.prefix_totals(df, ["g"], [F.col("s").asc(), F.col("n").asc()], {"upto": "n"}, 7)
    for g in range(3):
        run = 0
        seen = {(r["s"], r["n"]): r["upto"] for r in got.where(F.col("g") == g).collect()}
        for _, s, n in sorted(r for r in rows if r[0] == g):
            run += n
            assert seen[s, n] == run


def test_no_key_has_more_rows_than_told(frame, monkeypatch):
    """A bound above the limit leads to the exact count; below it no key is counted by itself."""
    most = frame.where("k is not null").groupBy("k").count().agg({"count": "max"}).first()[0]
    assert o.most_rows(frame, "k") >= most
    monkeypatch.setattr(o, "BUCKETS", 1)
    assert o.most_rows(frame, "k") == frame.where("k is not null").count()
    assert o.hot_keys(frame, "k", most + 1) is None
    assert [r["_rows"] for r in o.hot_keys(frame, "k", most).collect()] == [most]
