"""Feature sets on hand-made rows, and the shape of the wide table."""

import pytest
from pyspark.sql import functions as F

from creditloom.operators.ordered import hot_keys
from creditloom.plans import bureau, history
from creditloom.plans import hypotheses as hyp
from creditloom.plans.application import application_columns, application_features
from creditloom.plans.cross import cross_features
from creditloom.plans.feature_table import (
    PREFIXES, build_feature_tables, feature_columns, feature_table, numeric_feature_columns,
    supplements,
)
from creditloom.sources.schemas import APPLICANT, CREDIT, LABEL, TABLES
from creditloom.sources.tables import write_parquet


@pytest.fixture(scope="module")
def train_wide(inputs):
    return feature_table(inputs["application_train"], inputs.all()).cache()


def test_wide_table_has_all_columns_once(train_wide, inputs):
    made = [c for c in train_wide.columns if c.startswith(tuple(PREFIXES))]
    counts = {p: sum(c.startswith(p) for c in made) for p in PREFIXES}
    assert counts == {
        "APP_": 45, "BUR_": 52, "PREV_": 46, "INS_": 32, "POS_": 27, "CC_": 43, "H1_": 0,
        "H2_": 12, "H3_": 8, "H4_": 12, "H5_": 9, "H6_": 0, "CROSS_": 18,
    }
    assert len(set(train_wide.columns)) == len(train_wide.columns)
    assert train_wide.count() == inputs["application_train"].count()
    assert train_wide.select(APPLICANT).distinct().count() == train_wide.count()


def test_no_engineered_column_is_all_null(train_wide):
    made = [c for c in train_wide.columns if c.startswith(("APP_", "BUR_", "PREV_", "INS_", "CROSS_"))]
    row = train_wide.agg(*(F.count(c).alias(c) for c in made)).first().asDict()
    assert [c for c, n in row.items() if n == 0] == []


def test_train_and_test_have_equal_features(train_wide, inputs):
    test = feature_table(inputs["application_test"], inputs.all())
    assert LABEL in train_wide.columns and LABEL not in test.columns
    assert feature_columns(train_wide) == feature_columns(test)
    assert 100 <= len(numeric_feature_columns(test)) < 1000


def test_written_tables_equal_the_single_plan(spark, inputs, train_wide, tmp_path):
    for name in TABLES:
        write_parquet(inputs[name], f"{tmp_path}/data/{name}.parquet")
    train, test = build_feature_tables(spark, f"{tmp_path}/data", f"{tmp_path}/out")
    assert set(train.columns) == set(train_wide.columns)
    names = [APPLICANT, "BUR_COUNT", "INS_COUNT", "H3_MONTHS_SINCE_LAST_BB_DPD", "CROSS_THIN_FILE_SCORE"]
    assert sorted(train.select(names).collect(), key=str) == sorted(
        train_wide.select(names).collect(), key=str
    )
    assert test.count() == inputs["application_test"].count()


def test_fused_passes_equal_families_built_alone(inputs):
    fused = supplements(inputs.all())["bureau"]()
    alone = hyp.h5_credit_type(inputs["bureau"])
    names = [c for c in alone.columns if c != APPLICANT]
    left = fused.select(APPLICANT, *names).join(alone.select(APPLICANT), APPLICANT)
    assert sorted(left.collect(), key=str) == sorted(alone.select(APPLICANT, *names).collect(), key=str)


def test_placeholder_employment(spark, inputs):
    app = inputs["application_train"]
    out = application_features(app)
    raw = app.where("DAYS_EMPLOYED = 365243").first()[APPLICANT]
    row = out.where(F.col(APPLICANT) == raw).first()
    assert row["DAYS_EMPLOYED"] is None and row["APP_DAYS_EMPLOYED_ANOMALY"] == 1
    assert row["APP_EMPLOYMENT_YEARS"] == pytest.approx(365243 / -365.25)
    assert len(application_columns()) == 45


def test_orphan_balances_and_credits_without_balance(spark):
    credits = spark.createDataFrame(
        [(1, 10, "Active", "Mortgage", -30, 5.0)],
        "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, CREDIT_TYPE string,"
        " DAYS_CREDIT int, AMT_CREDIT_SUM double",
    )
    for c in ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_LIMIT",
              "AMT_CREDIT_MAX_OVERDUE"):
        credits = credits.withColumn(c, F.lit(None).cast("double"))
    for c in ("DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE", "CREDIT_DAY_OVERDUE"):
        credits = credits.withColumn(c, F.lit(0))
    credits = credits.withColumn("AMT_ANNUITY", F.lit("XNA"))
    balance = spark.createDataFrame(
        [(99, -1, "1"), (99, -2, "0")], "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string"
    )
    row = bureau.bureau_features(credits, balance).first()
    assert row["BUR_COUNT"] == 1 and row["BUR_ANNUITY_TOTAL"] == 0.0
    assert row["BUR_BB_DPD_MONTHS_TOTAL"] == 0 and row["BUR_BB_DPD_RATE_MEAN"] is None
    assert row["BUR_RECENT_1Y_ACTIVE"] == 1
    assert hyp.h3_balances(balance, credits).count() == 0
    assert hyp.h2_balances(balance, credits).count() == 0


def test_status_counts_of_one_credit(spark):
    balance = spark.createDataFrame(
        [(1, -1, "1"), (1, -2, "C"), (1, -8, "5"), (1, -9, "X"), (1, -10, None)],
        f"{CREDIT} long, MONTHS_BALANCE int, STATUS string",
    )
    row = bureau.balance_features(balance).first()
    assert (row["BB_MONTHS_COUNT"], row["BB_DPD_MONTHS"], row["BB_RECENT_6M_DPD"]) == (5, 2, 1)
    assert row["BB_DPD_RATE"] == pytest.approx(2 / 6)
    assert row["BB_RECENT_6M_DPD_RATE"] == pytest.approx(1 / 3)


def test_zero_divisors_give_null(spark):
    card = spark.createDataFrame([(-1.0, 5.0)], "AMT_CREDIT_LIMIT_ACTUAL double, AMT_BALANCE double")
    assert card.select(history.card_rows()["CC_UTILIZATION"]).first()[0] is None


def test_cross_features_depend_on_their_inputs(spark):
    df = spark.createDataFrame([(1, None, 2)], "SK_ID_CURR long, BUR_COUNT int, PREV_COUNT int")
    out = cross_features(df)
    assert set(out.columns) == {
        "SK_ID_CURR", "BUR_COUNT", "PREV_COUNT", "CROSS_NO_BUREAU_HISTORY",
        "CROSS_FIRST_TIME_APPLICANT", "CROSS_THIN_FILE_SCORE",
    }
    row = out.first()
    assert (row["CROSS_NO_BUREAU_HISTORY"], row["CROSS_FIRST_TIME_APPLICANT"]) == (1, 0)
    assert row["CROSS_THIN_FILE_SCORE"] == 1


@pytest.mark.parametrize("name", ["h2_pos", "h2_cards", "h2_instalments", "h6_gaps"])
def test_large_applicants_get_the_same_features(inputs, name):
    """The path for very large keys, forced by a low limit, changes no value."""
    table = {
        "h2_pos": "POS_CASH_balance", "h2_cards": "credit_card_balance",
        "h2_instalments": "installments_payments", "h6_gaps": "previous_application",
    }[name]
    build = getattr(hyp, name)

    def rounded(df):
        return sorted(
            tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.collect()
        )

    plain, spread = rounded(build(inputs[table])), rounded(build(inputs[table], hot_rows=12))
    assert hot_keys(inputs[table], APPLICANT, 12) is not None
    assert len(plain) > 20 and str(plain) == str(spread)


def test_large_applicants_balances(inputs):
    plain = hyp.h2_balances(inputs["bureau_balance"], inputs["bureau"])
    spread = hyp.h2_balances(inputs["bureau_balance"], inputs["bureau"], hot_rows=15)
    gap = "H2_BUR_BB_CLOSED_TRAJECTORY"
    both = plain.join(spread.select(APPLICANT, F.col(gap).alias("other")), APPLICANT)
    assert both.count() == plain.count() == spread.count()
    assert both.where(F.abs(F.col(gap) - F.col("other")) > 1e-9).count() == 0


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange")


def test_bucketed_tables_join_in_place_and_go_stale(spark, tmp_path):
    """No exchange above bucketed scans; a changed input leads to a new build, others stay."""
    from creditloom.operators.lookup import join_features
    from creditloom.sources import bucketed

    data, out, calls = f"{tmp_path}/data", f"{tmp_path}/out", []
    rows = spark.range(200).withColumnRenamed("id", APPLICANT)
    rows.write.parquet(data)

    def kept(name, mark):
        def build():
            calls.append(name)
            return spark.read.parquet(data).withColumn(name, F.col(APPLICANT) * 2)

        return bucketed.bucketed_cache(spark, name, build, out, mark, APPLICANT, 3)

    before = bucketed.fingerprint(spark, [data])
    assert before == bucketed.fingerprint(spark, [data])
    tables = [kept(n, before) for n in ("a", "b", "c")]
    joined = join_features(tables[0], [t.hint("merge") for t in tables[1:]], APPLICANT)
    assert _exchanges(joined) == 0 and joined.count() == 200
    assert joined.where("a = b and b = c").count() == 200
    assert [kept(n, before).count() for n in ("a", "b", "c")] == [200] * 3 and calls == ["a", "b", "c"]

    rows.limit(10).write.mode("append").parquet(data)
    after = bucketed.fingerprint(spark, [data])
    assert after != before
    assert kept("a", after).count() == 210 and calls == ["a", "b", "c", "a"]


def test_unfinished_bucketed_table_is_built_again(spark, tmp_path):
    from creditloom.sources import bucketed

    out = str(tmp_path)
    half = spark.range(5).withColumnRenamed("id", APPLICANT)
    bucketed.write_bucketed(half, f"{out}/t/mark-2/lost", APPLICANT, 2)  # no commit
    whole = bucketed.bucketed_cache(
        spark, "t", lambda: half.union(half), out, "mark", APPLICANT, 2
    )
    assert whole.count() == 10


def test_feature_tables_are_rebuilt_for_changed_inputs_only(spark, inputs, tmp_path, monkeypatch):
    from creditloom.plans import feature_table as ft
    from creditloom.sources import bucketed

    data, out, built = f"{tmp_path}/data", f"{tmp_path}/out", []
    for name, table in inputs.all().items():
        table.write.parquet(f"{data}/{name}.parquet")
    real = bucketed.write_bucketed
    monkeypatch.setattr(bucketed, "write_bucketed", lambda df, path, *a: (built.append(path.split("/out/")[1].split("/")[0]), real(df, path, *a)))
    first, _ = ft.build_feature_tables(spark, data, out, buckets=2)
    assert len(built) == 14
    again, _ = ft.build_feature_tables(spark, data, out, buckets=2)
    assert len(built) == 14 and again.count() == first.count()
    cards = spark.read.parquet(f"{data}/credit_card_balance.parquet")
    cards.limit(1).write.mode("append").parquet(f"{data}/credit_card_balance.parquet")
    ft.build_feature_tables(spark, data, out, buckets=2)
    assert sorted(built[14:]) == ["features_card", "features_card_halves", "test_final", "train_final"]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_parts_are_built_side_by_side(spark, inputs, tmp_path, monkeypatch):
    import threading
    import time

    from creditloom.plans import feature_table as ft

    for name, table in inputs.all().items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    lock, active, most = threading.Lock(), set(), []

    def built(spark, name, build, *_):
        with lock:
            active.add(name)
            most.append(len(active))
        time.sleep(0.3)
        frame = build()
        with lock:
            active.remove(name)
        return frame

    monkeypatch.setattr(ft, "bucketed_cache", built)
    train, test = ft.build_feature_tables(spark, str(tmp_path), f"{tmp_path}/out", buckets=2)
    assert len(most) == 14 and 2 <= max(most) <= ft.PARTS
    assert LABEL in train.columns and LABEL not in test.columns


SMALL = "/root/testdata/sf0.001"


def test_lines_are_joined_once(spark):
    """Shared inputs hold the same rows, and no reader joins the lines again."""
    from creditloom.queries.common import Inputs

    own, shared = Inputs(spark, SMALL), Inputs(spark, SMALL, shared=True)
    for name in ("installments_payments", "POS_CASH_balance", "credit_card_balance"):
        assert "Join" not in shared[name]._jdf.queryExecution().optimizedPlan().toString()
        assert shared[name].exceptAll(own[name]).count() == own[name].exceptAll(shared[name]).count() == 0


def test_only_rows_of_the_applicants_are_grouped(spark, inputs):
    from creditloom.plans.feature_table import of_applicants

    app = inputs["application_test"]
    tables = inputs.all()
    chosen = of_applicants(tables, app)
    for name in ("bureau", "installments_payments", "POS_CASH_balance"):
        assert 0 < chosen[name].count() == tables[name].where("SK_ID_CURR % 8 = 7").count()
        assert chosen[name].where("SK_ID_CURR % 8 <> 7").count() == 0
    assert chosen["bureau_balance"] is tables["bureau_balance"]
    assert of_applicants(tables, app, most=3) is tables


def _moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_dealt_out_by_applicant_once(spark, inputs):
    """Groupings and windows by applicant need no exchange; no line is lost or changed."""
    from conftest import SMALL

    from creditloom.queries.common import Inputs
    from creditloom.sources import mapped

    shared, name = Inputs(spark, SMALL, shared=True), "installments_payments"
    halves = hyp.h2_instalments(shared[name])
    for built in (history.instalment_features(shared[name]), halves, hyp.h1_instalments(shared[name])):
        assert _moves(built) == 0
    for table in (name, "POS_CASH_balance", "credit_card_balance"):
        assert shared[table].exceptAll(inputs[table]).count() == 0
        assert shared[table].count() == inputs[table].count()
    # an applicant with very many lines is not given to one task
    loose = mapped.mapped_table(spark, SMALL, name, mapped.written_detail(spark, SMALL, hot_rows=50))
    assert loose.exceptAll(inputs[name]).count() == 0 and loose.count() == inputs[name].count()
    assert _moves(hyp.h1_instalments(loose)) > 0


def test_left_out_lines_take_only_columns_that_need_them(spark, inputs):
    from conftest import SMALL

    from creditloom.queries.common import Inputs
    from creditloom.sources.mapped import NOT_EXPLORED

    slim = Inputs(spark, SMALL, shared=True, without=NOT_EXPLORED)
    lost = {"CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE", "NAME_CONTRACT_STATUS"}
    for table in ("installments_payments", "POS_CASH_balance", "credit_card_balance"):
        kept = [c for c in inputs[table].columns if table == "installments_payments" or c not in lost]
        assert slim[table].columns == kept
        assert slim[table].exceptAll(inputs[table].select(kept)).count() == 0


def test_balances_move_once_a_join_if_no_applicant_has_very_many(inputs):
    """Only large applicants' equal months are counted first, which takes a grouping of all cells."""
    plan = hyp.h2_balances(inputs["bureau_balance"], inputs["bureau"])._jdf.queryExecution()
    assert "partial_count" not in plan.executedPlan().toString()
    large = hyp.h2_balances(inputs["bureau_balance"], inputs["bureau"], hot_rows=15)._jdf.queryExecution()
    assert "partial_count" in large.executedPlan().toString()


def test_interactions_need_five_supplements_only(train_wide, inputs):
    from creditloom.plans.feature_table import CROSSED

    some = feature_table(inputs["application_train"], inputs.all(), CROSSED)
    names = [APPLICANT, *(c for c in train_wide.columns if c.startswith("CROSS_"))]
    assert [c for c in some.columns if c.startswith("CROSS_")] == names[1:]

    def rounded(df):
        shape = (F.round(c, 9).alias(c) if c != APPLICANT else F.col(c) for c in names)
        return sorted(map(str, df.select(*shape).collect()))

    assert rounded(some) == rounded(train_wide)
