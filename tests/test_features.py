import pytest

from pyspark.sql import functions as F

from caselens.operators import bootstrap as B
from caselens.operators import features as E
from caselens.plans import registry
from caselens.sources import contracts as M

NUMBERS = [k for k in E.ROLES if k not in ("error", "state", "year", "slots", "findings")]
SCHEMA = "id int, error boolean, state string, year int, slots array<double>, findings array<struct<element:int,finding:int,dollars:double>>, " + ", ".join(f"{k} double" for k in NUMBERS)
PLAIN = {"error": True, "state": "A", "year": 2000, "slots": [0.0, None, 5.0], "findings": [(365, 2, 10.0), (365, 4, 9.0)]} | dict.fromkeys(NUMBERS, 10.0) | {"medical": 20.0, "elders": 1.0, "disabled": 0.0, "cert_months": 12.0, "cert_since": 10.0, "year_month": 200003.0, "categorical": 2.0, "self_total": 0.0, "most": 20.0, "least": 9.5, "utility": 2.0, "gross": 4.0, "expedite": 3.0}


def run(spark, *changes, **more):
    rows = [(i, *[(PLAIN | ch)[k] for k in ("error", "state", "year", "slots", "findings", *NUMBERS)]) for i, ch in enumerate(changes)]
    tables = {
        "states": spark.createDataFrame([("A",), ("A",), ("B",)], "state string"),
        "broad": spark.createDataFrame([("A", 2000), ("A", 2000), ("Z", 2000)], "state string, year int"),
        "standard": spark.createDataFrame([("B", 2000)], "state string, year int"),
        "premiums": spark.createDataFrame([(2000, 45.5)], "calendar_year long, premium double"),
    }
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: r for r in E.build(df.withColumn("extra", F.lit(1)), ["id"], **tables, medical_element=365, impacts=[2, 3], **more).collect()}


def test_a_whole_row(spark):
    got = run(spark, {})[0]
    want = {
        "official_error": 1, "medical_error": 1, "signed_deviation": 0.0, "size": 10.0, "frail": 1, "elders_present": 1, "near_end": 1, "near_end_frail": 1, "period_inconsistent": 0, "broad": 1, "broad_frail": 1, "broad_children": 1, "state_unknown": 0, "categorical_broad": 1,
        "claims_medical": 1, "above_floor": 0, "documents": 0, "rebuilt_expense": 55.0, "premium": 45.5, "premium_distance": 9.5, "premium_only": 0, "just_above_premium": 1, "literal_premium_only": 0, "records": 1, "total_has_income": 0, "records_mismatch": 1, "actual_utilities": 1,
        "parts": 4, "parts_missing": 0, "per_member": 5.0, "at_max": 0, "at_min": 1, "of_most": 0.5, "net_share": 2.0, "net_share_undefined": 0, "expedited": 0,
    }
    assert {k: got[k] for k in want} == want
    assert len(got) >= 60


def test_nothing_known(spark):
    """Every role null: flags are 0 beside their missing flags, amounts null, nothing crashes."""
    got = run(spark, dict.fromkeys(PLAIN))[0]
    flags = {k: v for k, v in got.asDict().items() if k not in ("id", "state", "year")}
    assert all(v in (0, 1, None) for v in flags.values())
    assert all(v == 1 for k, v in flags.items() if k.endswith("_missing")) and got.state_unknown == 1 and got.net_share_undefined == 1
    assert not any(got[k] for k in ("official_error", "frail", "broad", "near_end", "premium_only", "at_min", "records_mismatch"))


def test_edges(spark):
    changes = [
        {"medical": 10.5}, {"medical": 15.5}, {"medical": 15.6}, {"medical": 60.5}, {"medical": 60.6}, {"medical": -3.0}, {"medical": 40.0}, {"medical": 40.0, "state": "B"},
        {"state": "Z"}, {"cert_since": 12.0}, {"cert_since": 9.0}, {"gross": 0.0}, {"net": -1.0}, {"most": 0.0}, {"certified": None, "unit": 0.0}, {"year_month": 200013.0}, {"findings": [(365, 4, 9.0), (365, 2, 0.0), (12, 2, 9.0)]},
    ]
    got = run(spark, *changes)
    assert [got[i].premium_only for i in range(5)] == [1, 1, 0, 0, 0] and [got[i].just_above_premium for i in range(5)] == [0, 0, 1, 1, 0]
    assert got[5].claims_medical == 0 and got[5].claims_medical_missing == 1
    assert got[6].documents == 1 and got[7].documents == 0
    assert got[8].state_unknown == 1 and got[8].broad == 0
    assert got[9].period_inconsistent == 1 and got[9].near_end == 0 and got[10].near_end == 0
    assert got[11].net_share is None and got[11].net_share_undefined == 1 and got[12].net_share == 0.0
    assert got[13].of_most is None and got[13].at_max == 0
    assert got[14].size == 0.0 and got[14].per_member == 50.0
    assert got[15].premium_missing == 1 and got[15].premium_distance is None
    assert got[16].official_error == 1 and got[16].medical_error == 0
    with pytest.raises(ValueError):
        E.prepared(spark.range(1), *[spark.range(1)] * 4)


def test_drift_inputs_are_checked(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "delta double, sd double")
    assert M.drift_inputs(frame((0.1, 0.0), (-2.0, 1.0)), "delta", "sd").count() == 2
    for bad in ([(0.1, 0.2)], [(0.1, -0.2), (1.0, 1.0)], [(float("nan"), 0.2), (1.0, 1.0)], [(float("inf"), 0.2), (1.0, 1.0)], [(None, 0.2), (1.0, 1.0)], [(0.1, float("inf")), (1.0, 1.0)]):
        with pytest.raises(M.ContractError):
            M.drift_inputs(frame(*bad), "delta", "sd")


def test_summary_of_draws(spark):
    df = spark.createDataFrame([("a", float(max(0, i - 10))) for i in range(101)], "k string, rate double")
    r = B.summary(df, ["k"], "rate").first()
    assert (r.low, r.high) == (0.0, pytest.approx(87.5)) and r.zero_share == pytest.approx(11 / 101) and r.se == pytest.approx(28.5, abs=1)


def plan(spark, df, threshold):
    """The physical plan as it stands without adaptive changes, and the longest method generated for it."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": threshold}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        made = df()._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(made)
        return made.toString(), max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("name", ["prj16c_whole_feature_build", "prj16d_feature_profile"])
def test_methods_are_short_enough_to_be_compiled(spark, name, threshold):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    text, longest = plan(spark, lambda: registry.queries()[name](spark, "/root/testdata/sf0.001"), threshold)
    assert longest <= 8000
    assert "Exchange hashpartitioning(calendar_year" not in text and "Exchange hashpartitioning(state" not in text.split("HashAggregate")[0]


def test_registries_repeat_and_miss(spark):
    """Copies of a registry's rows change nothing; years and places that are null or unknown to it match nothing."""
    frame = lambda *rows: spark.createDataFrame(list(rows), "state string, year int")
    places = [("A", None), (None, 2000), ("Z", 2000), ("B", 2000), ("B", 1999), ("C", 2000)]
    rows = spark.createDataFrame([(s, y, i, [1.0]) for i, (s, y) in enumerate(places)], "state string, year int, id int, slots array<double>")
    rows = rows.select("*", *[F.lit(None).cast("double").alias(k) for k in E.ROLES if k not in rows.columns])
    tables = {"states": frame(("A", 0), ("A", 0), ("B", 0)).select("state"), "broad": frame(("B", 2000), ("B", 2000), ("C", 2000), (None, 2000)), "standard": frame(("B", 1999), ("C", 2000), ("C", 2000), ("A", None))}
    got = sorted(E.prepared(rows, premiums=spark.createDataFrame([(2000, 45.5)], "calendar_year long, premium double"), **tables).select("id", "_known", "_broad", "_standard").collect())
    assert [tuple(r) for r in got] == [(0, True, False, False), (1, False, False, False), (2, False, False, False), (3, True, True, False), (4, True, False, True), (5, False, False, True)]
