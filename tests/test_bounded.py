"""Operators that gather brackets instead of groups, and queries that read the case view once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import windows as X
from caselens.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sketch", [10_000, 100_000_000])
def test_exact_percentiles_of_ties_and_missed_brackets(spark, sketch, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), [-1e12, 1e12]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").unionByName(spark.createDataFrame([(None,)], "x double"))
    monkeypatch.setattr(X, "SKETCH", 10_000)
    levels = [0.0, 0.05, 0.5, 0.62, 0.9, 1.0]
    wanted = {i: (F.col("x"), p) for i, p in enumerate(levels)}
    if sketch > 10_000:
        # Brackets of another column miss every rank.
        monkeypatch.setattr(X.F, "percentile_approx", lambda *a: F.array(F.lit(7.0), F.lit(7.5)))
    got = {r.level_no: r.value for r in X.exact_percentiles(df, wanted).collect()}
    assert [got[i] for i in range(len(levels))] == pytest.approx([np.quantile(x, p) for p in levels])


def test_profile_holds_no_value_table(spark):
    plan = registry.queries()["x05_level_profile"](spark, DATA)._jdf.queryExecution().toString()
    assert "percentile(" not in plan


@pytest.mark.parametrize("sample", [1_000_000, 50, 1])
def test_budget_ends_from_brackets(spark, sample, monkeypatch):
    rng = np.random.default_rng(5)
    n = 3000
    rows = [(int(g), f"k{i:05d}", float(s) if i % 50 else None, float(t), float(w)) for i, (g, s, t, w) in enumerate(zip(rng.integers(0, 3, n), rng.normal(size=n), rng.integers(0, 3, n), rng.integers(1, 9, n), strict=True))]
    df = spark.createDataFrame(rows, "g int, id string, s double, t double, w double").localCheckpoint()
    monkeypatch.setattr(X, "SAMPLE_ROWS", sample)
    shares = [0.05, 0.2, 1.0]
    cuts = X.budget_cuts(df, ["g"], {"fine": "s", "tied": "t"}, ["id"], "w", shares)
    for rule, col in (("fine", 2), ("tied", 3)):
        for share in shares:
            got = {r.id: r.m for r in df.join(cuts, "g").select("id", X.inside_cut("s" if col == 2 else "t", ["id"], "w", rule, share).alias("m")).collect()}
            for g in range(3):
                order = sorted([r for r in rows if r[0] == g], key=lambda r: (r[col] is None, -(r[col] or 0.0), r[1]))
                total, before = sum(r[4] for r in order), 0.0
                for r in order:
                    assert got[r[1]] == pytest.approx(min(1.0, max(0.0, (total * share - before) / r[4])))
                    before += r[4]


def test_budget_gathers_brackets_only(spark, monkeypatch):
    """The rows stored for a budget are the input's and the ends': no stored order of all rows."""
    stored = []
    keep = X.store
    monkeypatch.setattr(X, "store", lambda df, name: stored.append(name) or keep(df, name))
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("id"), F.rand(1).alias("s"), F.lit(1.0).alias("w"))
    X.budget_membership(df, ["g"], "s", ["id"], "w", 0.1).count()
    assert "ordered" not in stored and "ranges" not in stored


@pytest.fixture
def stored(monkeypatch):
    """Tables stored by a query's module, by name."""
    import importlib

    out = {}

    def watch(module: str):
        m = importlib.import_module(f"caselens.{module}")
        keep = m.store

        def note(df, name):
            out[name] = keep(df, name)
            return out[name]

        monkeypatch.setattr(m, "store", note)
        return out

    return watch


@pytest.mark.parametrize(("name", "module", "table"), [
    ("jn02_one_to_one", "plans.relations", "both"), ("x26b_drift_bootstrap", "plans.features", "panel"), ("ml02c_stratified_folds", "operators.folds", "strata"),
    ("ml01_boosted_classifier", "plans.models", "features"), ("ml08_permutation_importance", "plans.models", "dealt"),
])
def test_the_case_view_is_read_once(spark, stored, name, module, table):
    tables = stored(module)
    registry.queries()[name](spark, DATA)
    assert table in tables and len(tables[table].columns) <= 7


def test_isotonic_fit_reads_one_point_a_score(spark, stored):
    tables = stored("plans.models")
    registry.queries()["ml02_isotonic_by_fold"](spark, DATA)
    assert tables["points"].count() == tables["points"].select("fold", "score").distinct().count() <= 4 * 11


def test_code_sets_meet_as_sets(spark, stored):
    tables = stored("plans.relations")
    registry.queries()["set02_code_sets"](spark, DATA)
    assert tables["codes"].count() == tables["codes"].distinct().count()


def test_repeated_keys_in_parts_of_bounded_size(spark, monkeypatch):
    from caselens.plans import relations

    monkeypatch.setattr(relations, "PART_ROWS", 500)
    df = registry.queries()["set05_repeated_keys"](spark, DATA)
    lines = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert f", {lines}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_unique_keys_are_checked_beyond_their_hashes(spark, monkeypatch):
    from caselens.sources import contracts as M

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, s string")
    # All hashes collide: keys decide.
    monkeypatch.setattr(M.F, "xxhash64", lambda *k: F.lit(1))
    assert M.require_unique(df, ["k", "s"]) is df
    with pytest.raises(M.ContractError):
        M.require_unique(df, ["k"])
