"""Sources, filters, joins, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import attribution as A
from ..operators import windows as X
from ..operators.impute import hot_deck
from ..operators.rates import weighted_ratio
from ..sources import contracts, readers, writers
from ..sources.shared import store
from ..sources.cases import cases, table, threshold
from .registry import panel, query, with_tables

c = F.col
#: Lines that one part of a large grouping holds.
PART_ROWS = 500_000


@query("src01_core_universe", "SELECT grp, count(*) AS n, round(sum(err), 2) AS dollars, CAST(sum(len(list_distinct([300 + part % 8, 300 + supp % 8]))) AS BIGINT) AS elements FROM cases WHERE (line = 1 OR line % 2 = 0) AND weight > 0 AND base IS NOT NULL GROUP BY grp")
def src01(spark, d):
    rows = cases(spark, d).where(((c("line") == 1) | (c("line") % 2 == 0)) & (c("weight") > 0) & c("base").isNotNull())
    elements = F.array_distinct(F.array(300 + c("part") % 8, 300 + c("supp") % 8))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("err"), 2).alias("dollars"), F.sum(F.size(elements)).alias("elements"))


@query("src02_rate_lines", "SELECT n_name AS name, n_nationkey + CAST(0.25 AS DOUBLE) AS over, n_nationkey + CAST(0.5 AS DOUBLE) AS under, n_nationkey * 2 + CAST(0.75 AS DOUBLE) AS total FROM nation WHERE n_regionkey <> 2")
def src02(spark, d):
    k = c("n_nationkey")
    line = F.when(c("n_regionkey") == 2, F.concat(F.lit("Note: "), "n_name")).otherwise(F.format_string("  %s    %.2f   %.2f  %.2f", c("n_name"), k + 0.25, k + 0.5, k * 2 + 0.75))
    return readers.parse_rate_lines(table(spark, d, "nation").select(line.alias("line")))


@query("src03_rate_components", "SELECT r_name, count(*) AS n, round(sum(n_nationkey + CAST(0.25 AS DOUBLE)), 4) AS over FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def src03(spark, d):
    k = c("n_nationkey")
    lines = table(spark, d, "nation").select(F.format_string("%s    %.2f   %.2f  %.2f", c("n_name"), k + 0.25, k + 0.5, k + 0.75).alias("line"))
    parsed = readers.parse_rate_lines(lines)
    places = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return parsed.join(places, c("name") == c("n_name")).groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("over"), 4).alias("over"))


@query("src04_required_columns", "SELECT case_id, grp, period FROM cases")
def src04(spark, d):
    return contracts.require_columns(cases(spark, d), ["case_id", "grp", "period"]).select("case_id", "grp", "period")


@query("src05_pruned_scan", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority FROM orders")
def src05(spark, d):
    return readers.read_any(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderpriority"])


@query("src06_by_period", "SELECT CAST(2020 AS INTEGER) AS period, count(*) AS n, count(o_orderpriority) AS filled FROM orders UNION ALL SELECT 2021, count(*), 0 FROM customer")
def src06(spark, d):
    rows = readers.read_by_period(spark, {2020: f"{d}/orders.parquet", 2021: f"{d}/customer.parquet"}, ["o_orderkey", "o_orderpriority", "c_custkey"])
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("filled"))


@query("src08_registry_unpivot", "SELECT n_name, CAST(unnest([2017, 2018, 2019]) AS INTEGER) AS period, CAST(unnest([n_nationkey % 2, n_nationkey % 3, n_nationkey % 5]) AS BIGINT) AS value FROM nation")
def src08(spark, d):
    k = c("n_nationkey").cast("long")
    wide = table(spark, d, "nation").select("n_name", *[(k % m).alias(y) for y, m in (("2017", 2), ("2018", 3), ("2019", 5))])
    return readers.unpivot_registry(wide, "n_name", ["2017", "2018", "2019"])


@query("src09_checked_registry", "SELECT DISTINCT period, CAST(40 + period - 1995 AS DOUBLE) AS premium FROM cases")
def src09(spark, d):
    dim = cases(spark, d).select("period").distinct().withColumn("premium", (40 + c("period") - 1995).cast("double"))
    contracts.require_unique(dim, ["period"])
    return contracts.require_all(dim, positive=c("premium") > 0, known=c("period").isNotNull())


@query("src10_json_objects", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def src10(spark, d):
    return table(spark, d, "events").select(F.from_json("props", "k BIGINT", {"mode": "FAILFAST"}).alias("o")).groupBy(c("o.k").alias("k")).agg(F.count("*").alias("n"))


@query("src11_json_document", "SELECT count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events")
def src11(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("src16_aligned_flags", "SELECT grp, count(*) FILTER (WHERE len(list_intersect(list_filter([agency1, agency2], lambda x: x IS NOT NULL), [17, 19, 20])) > 0) AS strict, count(*) AS n FROM cases GROUP BY grp")
def src16(spark, d):
    strict = F.arrays_overlap(A.codes("agency1", "agency2"), F.array(*[F.lit(x) for x in S.CODE_SETS["strict"]]))
    return cases(spark, d).groupBy("grp").agg(F.count_if(strict).alias("strict"), F.count("*").alias("n"))


@query("src17_pruned_groups", "SELECT case_id, base FROM cases WHERE grp IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_7')")
def src17(spark, d):
    return cases(spark, d).where(c("grp").isin(*[f"NATION_{i}" for i in range(1, 8)])).select("case_id", "base")


@query("src18_last_row_wins", "SELECT part, supp, max(case_id) AS case_id FROM cases GROUP BY part, supp")
def src18(spark, d):
    return readers.last_row_wins(cases(spark, d).select("part", "supp", "case_id"), ["part", "supp"], c("case_id"))


@query("snk01_struct_of_arrays", "SELECT grp, orderkey // 64 AS chunk, list(CAST(weight AS BIGINT) ORDER BY case_id) AS w, list(status ORDER BY case_id) AS status, CAST(sum(CASE WHEN line = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM cases GROUP BY grp, chunk")
def snk01(spark, d):
    # A payload is a group's part of 64 keys in a row: arrays keep their size, and tables of any size have more of them.
    rows = cases(spark, d).withColumn("cell", F.struct("grp", F.expr("orderkey div 64").alias("chunk")))
    out = writers.struct_of_arrays(rows, "cell", ["case_id"], w=c("weight").cast("long"), status=c("status"), one=c("line") == 1)
    return out.select("cell.*", "w", "status", F.size(F.filter("one", lambda x: x)).cast("long").alias("ones"))


_SIG = "CAST(round(amount / pow(10, floor(log10(amount)) - 3)) AS BIGINT)"


@query(
    "snk02_sized_encoding",
    f"""SELECT chunk, CASE WHEN sum(length(fine) + 1) <= 400 THEN string_agg(fine, ',' ORDER BY case_id) WHEN sum(length(coarse) + 1) <= 400 THEN string_agg(coarse, ',' ORDER BY case_id) ELSE CAST(count(*) AS VARCHAR) END AS body
    FROM (SELECT case_id, orderkey // 8 AS chunk, {_SIG} || 'e' || CAST(floor(log10(amount)) - 3 AS INTEGER) AS fine, CAST(round(amount) AS BIGINT) || '' AS coarse FROM cases WHERE amount >= 0.01) GROUP BY chunk""",
)
def snk02(spark, d):
    """Four significant digits where a chunk's payload fits its bytes, else whole dollars, else a count."""
    e = F.floor(F.log10("amount")) - 3
    fine = F.concat(F.round(c("amount") / F.pow(F.lit(10.0), e)).cast("long").cast("string"), F.lit("e"), e.cast("int").cast("string"))
    rows = cases(spark, d).where("amount >= 0.01").select("case_id", F.expr("orderkey div 8").alias("chunk"), fine.alias("fine"), F.round("amount").cast("long").cast("string").alias("coarse"))
    # Sizes come first, so that only what is written is gathered.
    size = rows.groupBy("chunk").agg(F.sum(F.length("fine") + 1).alias("a"), F.sum(F.length("coarse") + 1).alias("b"), F.count("*").cast("string").alias("n"))
    part = rows.join(size.where("a <= 400 OR b <= 400"), "chunk").select("chunk", F.struct("case_id", F.when(c("a") <= 400, c("fine")).otherwise(c("coarse")).alias("v")).alias("r"))
    body = part.groupBy("chunk").agg(F.array_join(F.sort_array(F.collect_list("r"))["v"], ",").alias("body"))
    return size.join(body, "chunk", "left").select("chunk", F.coalesce("body", "n").alias("body"))


@query("snk03_sparse_patch", "SELECT case_id, CAST(CASE WHEN agency1 = 19 THEN 0 ELSE agency1 END AS INTEGER) AS agency1, agency1 = 19 AS patched FROM cases")
def snk03(spark, d):
    base = cases(spark, d).select("case_id", "agency1")
    changed = base.withColumn("agency1", F.when(c("agency1") == 19, 0).otherwise(c("agency1")))
    patch = writers.sparse_patch(base, changed, ["case_id"], "agency1")
    out = writers.apply_patch(base, patch, ["case_id"], "agency1")
    return out.join(patch.select("case_id", F.lit(True).alias("p")), "case_id", "left").select("case_id", "agency1", F.coalesce("p", F.lit(False)).alias("patched"))


@query("snk04_canonical_digest", "SELECT sha256(string_agg(grp || '=' || CAST(n AS VARCHAR), chr(10) ORDER BY grp || '=' || CAST(n AS VARCHAR))) AS sha256 FROM (SELECT grp, count(*) AS n FROM cases GROUP BY grp)")
def snk04(spark, d):
    return writers.canonical_digest(cases(spark, d).groupBy("grp").agg(F.count("*").alias("n")), ["grp"], "n")


@query("flt01_core_universe", "SELECT grp, count(*) AS n FROM cases WHERE (agency2 IS NULL OR agency2 = 1) AND base IS NOT NULL AND weight > 0 GROUP BY grp")
def flt01(spark, d):
    return cases(spark, d).where("(agency2 IS NULL OR agency2 = 1) AND base IS NOT NULL AND weight > 0").groupBy("grp").agg(F.count("*").alias("n"))


@query("flt02_reviewed", "SELECT grp, count(*) AS n FROM cases WHERE agency2 = 1 GROUP BY grp")
def flt02(spark, d):
    return cases(spark, d).where("agency2 = 1").groupBy("grp").agg(F.count("*").alias("n"))


@query("flt03_valid_mask", "SELECT period, count(*) FILTER (WHERE agency2 IS NOT NULL AND weight > 5) AS kept, count(*) FILTER (WHERE NOT (agency2 IS NOT NULL AND weight > 5)) AS dropped FROM cases GROUP BY period")
def flt03(spark, d):
    valid = c("agency2").isNotNull() & (c("weight") > 5)
    return cases(spark, d).groupBy("period").agg(F.count_if(valid).alias("kept"), F.count_if(~valid).alias("dropped"))


@query("flt04_deviation_universe", "SELECT grp, count(*) FILTER (WHERE status IN (2, 3) AND amount > 0) AS deviation, count(*) FILTER (WHERE err > 0) AS official FROM cases GROUP BY grp")
def flt04(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.count_if(c("status").isin(2, 3) & (c("amount") > 0)).alias("deviation"), F.count_if(c("err") > 0).alias("official"))


@query("flt05_replay_scope", "SELECT case_id FROM cases WHERE status = 1 AND base > 0 AND line BETWEEN 1 AND 3 AND agency1 IS NOT NULL")
def flt05(spark, d):
    return cases(spark, d).where("status = 1 AND base > 0 AND line BETWEEN 1 AND 3 AND agency1 IS NOT NULL").select("case_id")


@query("flt06_consistent", "SELECT case_id FROM cases WHERE abs(amount - base * 0.1) <= 5 * line")
def flt06(spark, d):
    return cases(spark, d).where(F.abs(c("amount") - c("base") * 0.1) <= 5 * c("line")).select("case_id")


@query("flt07_period_masks", "SELECT grp, count(*) FILTER (WHERE period IN (1995, 1996, 1997)) AS pre, count(*) FILTER (WHERE period IN (1999, 2000)) AS post FROM cases GROUP BY grp")
def flt07(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.count_if(c("period").isin(1995, 1996, 1997)).alias("pre"), F.count_if(c("period").isin(1999, 2000)).alias("post"))


@query("flt08_population", "SELECT region, count(*) AS n FROM cases WHERE line >= 3 AND discount > 0 GROUP BY region")
def flt08(spark, d):
    return cases(spark, d).where("line >= 3 AND discount > 0").groupBy("region").agg(F.count("*").alias("n"))


@query("flt09_probability_window", "SELECT grp, round(avg(CASE WHEN amount < 2000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS p FROM cases GROUP BY grp HAVING avg(CASE WHEN amount < 2000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) BETWEEN 0.1 AND 0.9")
def flt09(spark, d):
    p = F.avg((c("amount") < 2000).cast("double"))
    return cases(spark, d).groupBy("grp").agg(p.alias("p")).where(c("p").between(0.10, 0.90)).select("grp", F.round("p", 6).alias("p"))


@query("flt10_fixed_window", "SELECT grp, period FROM panel WHERE abs(rate - 10) <= 1.5")
def flt10(spark, d):
    return panel(spark, d).where(F.abs(c("rate") - 10) <= 1.5).select("grp", "period")


@query("flt11_level_gate", "SELECT a.grp, a.period FROM panel a JOIN panel b ON a.grp = b.grp AND b.period = 1995 WHERE a.rate / b.rate BETWEEN 0.7 AND 1.4")
def flt11(spark, d):
    p = panel(spark, d)
    return p.join(p.where("period = 1995").select("grp", c("rate").alias("start")), "grp").where((c("rate") / c("start")).between(0.7, 1.4)).select("grp", "period")


@query(
    "flt12_thin_cells",
    "SELECT p.grp, p.period, CASE WHEN p.n < 8 OR e.n_eff < 6 THEN a.rate ELSE round(p.rate, 6) END AS rate FROM panel p JOIN (SELECT grp, period, sum(weight) * sum(weight) / sum(weight * weight) AS n_eff FROM cases GROUP BY grp, period) e USING (grp, period) JOIN (SELECT period, round(sum(weight * err) * 100 / sum(weight * base), 6) AS rate FROM cases GROUP BY period) a ON a.period = p.period",
)
def flt12(spark, d):
    from ..operators.rates import effective_n

    rows = cases(spark, d)
    own = rows.groupBy("grp", "period").agg(F.count("*").alias("n"), effective_n("weight").alias("n_eff"), F.round(weighted_ratio("weight", "err", "base"), 6).alias("own"))
    whole = rows.groupBy("period").agg(F.round(weighted_ratio("weight", "err", "base"), 6).alias("all"))
    return own.join(whole, "period").select("grp", "period", F.when((c("n") < 8) | (c("n_eff") < 6), c("all")).otherwise(c("own")).alias("rate"))


@query("jn01_code_map", "SELECT coalesce(r_name, '?') AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def jn01(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"), "left")
    return j.groupBy(F.coalesce("r_name", F.lit("?")).alias("region")).agg(F.count("*").alias("n"))


@query("jn02_one_to_one", "SELECT case_id, base, score FROM cases")
def jn02(spark, d):
    rows = store(cases(spark, d).select("case_id", "base", "score"), "both")
    scores = contracts.require_unique(rows.select("case_id", "score"), ["case_id"])
    return rows.select("case_id", "base").join(scores, "case_id")


@query("jn03_composite_key", "SELECT a.grp, a.period, a.rate, b.n FROM panel a JOIN (SELECT grp, period, count(*) AS n FROM cases WHERE status = 2 GROUP BY grp, period) b USING (grp, period)")
def jn03(spark, d):
    over = cases(spark, d).where("status = 2").groupBy("grp", "period").agg(F.count("*").alias("n"))
    return panel(spark, d).select("grp", "period", "rate").join(over, ["grp", "period"])


@query("jn04_chained", "SELECT a.grp, round(a.x, 6) AS x, b.n, c.top FROM (SELECT grp, avg(rate) AS x FROM panel GROUP BY grp) a JOIN (SELECT grp, count(*) AS n FROM panel GROUP BY grp) b USING (grp) JOIN (SELECT grp, max(rate) AS top FROM panel GROUP BY grp) c USING (grp)")
def jn04(spark, d):
    p = panel(spark, d)
    a, b, t = (p.groupBy("grp").agg(x) for x in (F.round(F.avg("rate"), 6).alias("x"), F.count("*").alias("n"), F.max("rate").alias("top")))
    return a.join(b, "grp").join(t, "grp")


@query("jn05_asserted_left", "SELECT p.grp, p.period, p.rate * f.factor AS rate FROM panel p JOIN (SELECT grp, 1 + grp_no / 100.0 AS factor FROM panel GROUP BY grp, grp_no) f USING (grp)")
def jn05(spark, d):
    p = panel(spark, d)
    factors = p.select("grp", (1 + c("grp_no") / 100.0).alias("factor")).distinct()
    sure = F.coalesce("factor", F.raise_error(F.concat(F.lit("no factor for "), "grp")).cast("double"))
    return p.join(factors, "grp", "left").select("grp", "period", (c("rate") * sure).alias("rate"))


@query("jn06_left_default", "SELECT p.grp, p.period, coalesce(q.rate, -1) AS rate FROM panel p LEFT JOIN (SELECT grp, rate FROM panel WHERE period = 2001 AND grp_no % 2 = 0) q USING (grp)")
def jn06(spark, d):
    p = panel(spark, d)
    own = p.where("period = 2001 AND grp_no % 2 = 0").select("grp", "rate")
    return p.select("grp", "period").join(own, "grp", "left").select("grp", "period", F.coalesce("rate", F.lit(-1.0)).alias("rate"))


@query("jn08_coverage", "SELECT (SELECT count(*) FROM (SELECT n_name FROM nation EXCEPT SELECT grp FROM cases)) AS left_only, (SELECT count(*) FROM (SELECT grp FROM cases EXCEPT SELECT n_name FROM nation)) AS right_only")
def jn08(spark, d):
    found = contracts.differences(table(spark, d, "nation").select(c("n_name").alias("grp")), cases(spark, d), ["grp"])
    return found.agg(F.count_if(c("side") == "left").alias("left_only"), F.count_if(c("side") == "right").alias("right_only"))


@query("jn09_crosswalk", "SELECT case_id, CAST(o_custkey AS BIGINT) AS custkey FROM cases JOIN orders ON CAST(split_part(case_id, '-', 1) AS BIGINT) = o_orderkey")
def jn09(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", c("o_custkey").cast("long").alias("custkey"))
    return cases(spark, d).select("case_id", F.split_part("case_id", F.lit("-"), F.lit(1)).cast("long").alias("o_orderkey")).join(o, "o_orderkey").select("case_id", "custkey")


@query("jn10_semi", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jn10(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "left_semi").select(c("c_custkey").cast("long").alias("c_custkey"))


@query("jn11_anti", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn11(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select(c("c_custkey").cast("long").alias("c_custkey"))


@query("jn12_bucket_lookup", "SELECT case_id, CAST(CASE WHEN score < 0.02 THEN 0 WHEN score < 0.05 THEN 1 WHEN score < 0.07 THEN 2 ELSE 3 END AS INTEGER) AS bucket FROM cases")
def jn12(spark, d):
    return cases(spark, d).select("case_id", F.size(F.filter(F.array(*[F.lit(x) for x in (0.02, 0.05, 0.07)]), lambda x: x <= c("score"))).alias("bucket"))


@query("jn13_nearest_cut", "SELECT grp, period, arg_min(cut, abs(rate - cut) * 1000000 + cut) AS cut FROM panel, (VALUES (6), (8), (10)) t(cut) GROUP BY grp, period")
def jn13(spark, d):
    cuts = spark.createDataFrame([(6,), (8,), (10,)], "cut int")
    far = F.struct(F.abs(c("rate") - c("cut")), c("cut"))
    return panel(spark, d).crossJoin(F.broadcast(cuts)).groupBy("grp", "period").agg(F.min_by("cut", far).alias("cut"))


@query("jn14_constrained_nearest", "SELECT a.grp, a.period, min(b.rate) AS above FROM panel a LEFT JOIN panel b ON a.period = b.period AND b.rate > a.rate GROUP BY a.grp, a.period")
def jn14(spark, d):
    # The next larger rate of the period is the row after, in rate order: no pairs are formed.
    p = panel(spark, d)
    steps = p.select("period", "rate").distinct().withColumn("above", F.lead("rate").over(W.partitionBy("period").orderBy("rate")))
    return p.join(steps, ["period", "rate"]).select("grp", "period", "above")


@query("jn15_grid", "SELECT n_name AS grp, CAST(p AS INTEGER) AS period, count(case_id) AS n FROM nation CROSS JOIN range(1995, 2002) t(p) LEFT JOIN cases ON cases.grp = n_name AND cases.period = p GROUP BY 1, 2")
def jn15(spark, d):
    grid = table(spark, d, "nation").select(c("n_name").alias("grp"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("period"))
    counts = cases(spark, d).groupBy("grp", "period").agg(F.count("*").alias("n"))
    return grid.join(counts, ["grp", "period"], "left").select("grp", "period", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("jn16_cascade", "SELECT a.grp, a.period, coalesce(b.v, d.v, -1) AS v FROM panel a LEFT JOIN (SELECT grp, period, max(weight) AS v FROM cases WHERE status = 3 AND line = 5 GROUP BY grp, period) b USING (grp, period) LEFT JOIN (SELECT grp, max(weight) AS v FROM cases WHERE status = 3 AND line = 5 GROUP BY grp) d ON d.grp = a.grp")
def jn16(spark, d):
    pool = cases(spark, d).where("status = 3 AND line = 5")
    fine, coarse = pool.groupBy("grp", "period").agg(F.max("weight").alias("x")), pool.groupBy("grp").agg(F.max("weight").alias("y"))
    return panel(spark, d).join(fine, ["grp", "period"], "left").join(coarse, "grp", "left").select("grp", "period", F.coalesce("x", "y", F.lit(-1.0)).alias("v"))


@query("jn17_rank_pairs", "SELECT a.grp, a.rn, a.case_id AS one, b.case_id AS other FROM (SELECT grp, case_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY base, case_id) AS INTEGER) AS rn FROM cases WHERE line = 1) a JOIN (SELECT grp, case_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY base, case_id) AS INTEGER) AS rn FROM cases WHERE line = 2) b USING (grp, rn)")
def jn17(spark, d):
    rows = cases(spark, d).where(c("line").isin(1, 2)).select("grp", "line", "base", "case_id")
    placed = X.places(rows, ["grp", "line"], [F.asc("base"), F.asc("case_id")], "rn").withColumn("rn", c("rn").cast("int"))
    one, other = (placed.where(c("line") == i).select("grp", "rn", c("case_id").alias(n)) for i, n in ((1, "one"), (2, "other")))
    return one.join(other, ["grp", "rn"])


@query("jn18_keyed_grid", "SELECT grp, max(rate) FILTER (WHERE period = 1996) AS y1996, max(rate) FILTER (WHERE period = 2000) AS y2000 FROM panel GROUP BY grp")
def jn18(spark, d):
    return panel(spark, d).groupBy("grp").pivot("period", [1996, 2000]).agg(F.max("rate")).select("grp", c("`1996`").alias("y1996"), c("`2000`").alias("y2000"))


@query("jn19_lag_pairs", "SELECT a.grp, a.period, b.period - a.period AS lag, round(a.rate * b.rate, 6) AS product FROM panel a JOIN panel b ON a.grp = b.grp AND b.period - a.period BETWEEN 1 AND 2")
def jn19(spark, d):
    p = panel(spark, d)
    later = p.select("grp", c("period").alias("q"), c("rate").alias("r"))
    ahead = p.withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("q", c("period") + c("lag"))
    return ahead.join(later, ["grp", "q"]).select("grp", "period", "lag", F.round(c("rate") * c("r"), 6).alias("product"))


@query("jn20_lookup_equal", "SELECT case_id, t.most FROM cases JOIN (SELECT period, line, CAST(max(weight) AS DOUBLE) AS most FROM cases GROUP BY period, line) t ON cases.period = t.period AND cases.line = t.line AND cases.weight = t.most")
def jn20(spark, d):
    rows = cases(spark, d).select("case_id", "period", "line", "weight")
    most = rows.groupBy("period", "line").agg(F.max("weight").alias("most"))
    return rows.join(most, ["period", "line"], "left").where("weight = most").select("case_id", "most")


@query("jn21_parent_totals", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority, n, c_mktsegment FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def jn21(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(n, c("l_orderkey") == c("o_orderkey")).join(table(spark, d, "customer"), c("c_custkey") == c("o_custkey"))
    return o.select(c("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", "n", "c_mktsegment")


@query("jn22_two_keys", "SELECT a.part, a.supp, a.n, b.n AS m FROM (SELECT part, supp, count(*) AS n FROM cases WHERE status = 2 GROUP BY 1, 2) a JOIN (SELECT part, supp, count(*) AS n FROM cases WHERE status = 3 GROUP BY 1, 2) b USING (part, supp)")
def jn22(spark, d):
    side = lambda s, n: cases(spark, d).where(c("status") == s).groupBy("part", "supp").agg(F.count("*").alias(n))
    return side(2, "n").join(side(3, "m"), ["part", "supp"])


@query("set01_union", "SELECT period, count(*) AS n FROM (SELECT period FROM cases WHERE line = 1 UNION ALL SELECT period FROM cases WHERE line = 2) GROUP BY period")
def set01(spark, d):
    rows = cases(spark, d)
    return rows.where("line = 1").unionByName(rows.where("line = 2")).groupBy("period").agg(F.count("*").alias("n"))


@query("set02_code_sets", "SELECT agency1 FROM cases WHERE line = 1 INTERSECT SELECT agency2 FROM cases EXCEPT SELECT 7")
def set02(spark, d):
    # A set is made distinct before it meets the other: few codes, and all rows of a code would meet in one task.
    rows = store(cases(spark, d).select("line", "agency1", "agency2").distinct(), "codes")
    return rows.where("line = 1").select("agency1").distinct().intersect(rows.select("agency2").distinct()).exceptAll(spark.range(7, 8).select(c("id").cast("int")))


@query("set03_key_equality", "SELECT period, grp, side FROM (SELECT grp, period, 'left' AS side FROM panel WHERE n > 10 EXCEPT SELECT grp, period, 'left' FROM cases WHERE status = 2) UNION ALL (SELECT period, grp, 'right' FROM cases WHERE status = 2 EXCEPT SELECT period, grp, 'right' FROM panel WHERE n > 10)")
def set03(spark, d):
    return contracts.differences(panel(spark, d).where("n > 10"), cases(spark, d).where("status = 2"), ["grp", "period"])


@query("set05_repeated_keys", "SELECT orderkey, line, count(*) AS n FROM cases GROUP BY 1, 2 HAVING count(*) > 1")
def set05(spark, d):
    # Parts of bounded size: lines are dealt by order once, for the join and the groups.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // PART_ROWS))
    return cases(spark, d, parts).groupBy("orderkey", "line").agg(F.count("*").alias("n")).where("n > 1")


@query("srt01_by_key", "SELECT grp, period, rate FROM panel ORDER BY grp, period")
def srt01(spark, d):
    return panel(spark, d).select("grp", "period", "rate").orderBy("grp", "period")


@query("srt03_top", "SELECT grp, round(max(rate), 6) AS top FROM panel GROUP BY grp ORDER BY top DESC, grp LIMIT 8")
def srt03(spark, d):
    return panel(spark, d).groupBy("grp").agg(F.round(F.max("rate"), 6).alias("top")).orderBy(F.desc("top"), "grp").limit(8)


@query("srt04_exemplars", "SELECT grp, status, case_id, CAST(rn AS INTEGER) AS rank FROM (SELECT grp, status, case_id, row_number() OVER (PARTITION BY grp, status ORDER BY amount DESC, case_id) AS rn FROM cases) WHERE rn <= 3")
def srt04(spark, d):
    return X.first_per_group(cases(spark, d), ["grp", "status"], [F.desc("amount"), F.asc("case_id")], 3).select("grp", "status", "case_id", "rank")


@query("srt05_best_with_ties", "SELECT grp, min(period) AS period FROM (SELECT grp, period, rate, min(rate) OVER (PARTITION BY grp) AS best FROM panel) WHERE rate <= best + 1e-12 GROUP BY grp")
def srt05(spark, d):
    best = F.min("rate").over(W.partitionBy("grp"))
    return panel(spark, d).withColumn("best", best).where("rate <= best + 1e-12").groupBy("grp").agg(F.min("period").alias("period"))


_DONORS = """pool AS (SELECT grp || '|' || line AS cell, case_id AS donor, weight AS w, agency1 AS v, sum(weight) OVER (PARTITION BY grp, line ORDER BY case_id ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY grp, line) AS total FROM cases WHERE status = 1 AND period < 1998),
pool2 AS (SELECT CAST(line AS VARCHAR) AS cell, case_id AS donor, weight AS w, agency1 AS v, sum(weight) OVER (PARTITION BY line ORDER BY case_id ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY line) AS total FROM cases WHERE status = 1 AND period < 1998),
rec AS (SELECT case_id, grp || '|' || line AS cell, CAST(line AS VARCHAR) AS cell2, CAST('0x' || substr(sha256('deck|' || case_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM cases WHERE period = 2000),
fine AS (SELECT case_id, CAST(0 AS INTEGER) AS level, donor, v FROM rec JOIN pool USING (cell) WHERE u >= (upto - w) / total AND u < upto / total)"""


@query("ml13_hot_deck", with_tables(_DONORS, "SELECT case_id, level, donor, v AS imputed FROM fine UNION ALL SELECT case_id, CAST(1 AS INTEGER), donor, v FROM rec JOIN pool2 ON rec.cell2 = pool2.cell WHERE rec.cell NOT IN (SELECT cell FROM pool) AND u >= (upto - w) / total AND u < upto / total"))
def ml13(spark, d):
    rows = store(cases(spark, d).select("case_id", "grp", "line", "weight", "agency1", "status", "period"), "deck")
    donors = rows.where("status = 1 AND period < 1998").select("case_id", "grp", "line", "weight", "agency1")
    return hot_deck(rows.where("period = 2000").select("case_id", "grp", "line"), donors, "case_id", [["grp", "line"], ["line"]], "weight", "agency1", "deck")
