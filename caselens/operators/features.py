"""The feature build of a review: targets, household, cadence, eligibility, medical, deductions and position of the benefit.

Each group of features is a dict of named columns over the roles below, so a caller may take some groups or all.
Rules that hold throughout: negative codes are sentinels and read as missing; a comparison with a missing value is
0, and a flag beside it says that the value was missing; amounts stay null where they are missing; a ratio over
zero is null; registries (broad eligibility, standard deduction, premiums) are joined as tables.

Roles: ``paid right formula weight year state certified unit elders disabled earned unearned gross net kids expedite
cert_months cert_since categorical medical demo year_month slots self_total utility medical_part care_part
support_part shelter_part earned_part most least findings`` (array of element, finding, dollars) and ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.contracts import require_columns

c = F.col

#: The excess floor, the half-width of the band at the premium, the end of the band above it, the comparisons' slack.
FLOOR, AT_PREMIUM, ABOVE_PREMIUM, SLACK = 35.0, 5.0, 50.0, 1e-9
ROLES = ["error", "paid", "right", "formula", "weight", "year", "state", "certified", "unit", "elders", "disabled", "earned", "unearned", "gross", "net", "kids", "expedite", "cert_months", "cert_since", "categorical", "medical", "demo", "year_month", "slots", "self_total", "utility", "medical_part", "care_part", "support_part", "shelter_part", "earned_part", "most", "least", "findings"]
SENTINELS = ["elders", "disabled", "cert_months", "cert_since", "categorical", "medical", "demo", "year_month"]


def flag(condition: Column) -> Column:
    """1 where it holds, 0 where it does not or cannot be told."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def registry(states: DataFrame, broad: DataFrame, standard: DataFrame) -> DataFrame:
    """One row a place: whether it is known, and the years of either policy."""
    entry = lambda df, kind, year: df.select("state", F.lit(kind).alias("kind"), year.alias("year"))
    years = lambda kind: F.collect_set(F.when(c("kind") == kind, c("year"))).alias(f"_{kind}")
    rows = entry(broad, "broad", c("year")).union(entry(standard, "standard", c("year"))).union(entry(states, "known", F.lit(None)))
    return rows.groupBy("state").agg(F.bool_or(c("kind") == "known").alias("_known"), years("broad"), years("standard"))


def prepared(df: DataFrame, states: DataFrame, broad: DataFrame, standard: DataFrame, premiums: DataFrame) -> DataFrame:
    """Sentinels cleared and registries joined: ``states`` (state), ``broad`` and ``standard`` (state, year), ``premiums`` (calendar_year, premium)."""
    require_columns(df, ROLES)
    at = S.nonnegative(c("year_month"))
    calendar = F.when((at % 100).between(1, 12) & (at == F.floor(at)), F.floor(at / 100))
    # Slots are counted here: a lambda keeps this projection out of the joins' generated method, which would be too long to be compiled.
    slots = {"_records": F.coalesce(F.size(F.filter("slots", lambda v: v > 0)), F.lit(0)), "_no_records": c("slots").isNull() | F.forall("slots", lambda v: v.isNull())}
    clean = df.withColumns({k: S.nonnegative(c(k)) for k in SENTINELS} | slots | {"calendar_year": calendar}).drop("slots")
    # Registries have a row a place and year, or a year: they are sent to the rows, whose widest form is never shuffled for them.
    rows = clean.join(F.broadcast(registry(states, broad, standard)), "state", "left")
    rows = rows.join(F.broadcast(premiums.select("calendar_year", "premium")), "calendar_year", "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    return rows.withColumns({"_known": yes(c("_known")), "_broad": yes(F.array_contains("_broad", c("year"))) & yes(c("_known")), "_standard": yes(F.array_contains("_standard", c("year"))), "_elders": yes(c("elders") > 0), "_frail": yes(c("elders") > 0) | yes(c("disabled") > 0), "_earns": yes(c("earned") > 0), "_kids": yes(c("kids") > 0), "size": F.coalesce("certified", "unit")})


def targets(medical_element: int, impacts: list[int]) -> dict[str, Column]:
    hit = F.exists("findings", lambda f: F.coalesce((f["element"] == medical_element) & f["finding"].isin(*impacts) & (f["dollars"] > 0), F.lit(False)))
    return {"official_error": flag(c("error")), "medical_error": flag(c("error") & hit), "signed_deviation": c("paid") - c("right"), "formula_benefit": c("formula"), "formula_benefit_missing": S.missing(c("formula")), "w": c("weight")}


def household() -> dict[str, Column]:
    out = {"size": c("size"), "size_missing": S.missing(c("size")), "frail_missing": flag(c("elders").isNull() | c("disabled").isNull()), "elders_present": flag(c("_elders")), "frail": flag(c("_frail"))}
    for k in ("earned", "unearned", "gross"):
        out |= {k: c(k), f"{k}_missing": S.missing(c(k))}
    return out | {"has_earnings": flag(c("_earns")), "children": flag(c("_kids")), "children_missing": S.missing(c("kids")), "expedited": flag(c("expedite") < 3), "expedited_missing": S.missing(c("expedite"))}


def cadence() -> dict[str, Column]:
    """Months since certification within its length; near its end in the last two months."""
    gap = c("cert_months").isNull() | c("cert_since").isNull()
    fits = F.coalesce(c("cert_since") < c("cert_months"), F.lit(False))
    near = fits & (c("cert_since") >= c("cert_months") - 2)
    return {"months_since": c("cert_since"), "months_since_missing": S.missing(c("cert_since")), "period_months": c("cert_months"), "period_months_missing": S.missing(c("cert_months")), "period_inconsistent": flag(~gap & ~fits), "near_end": flag(near), "near_end_missing": flag(gap), "near_end_frail": flag(near & c("_frail"))}


def eligibility() -> dict[str, Column]:
    crossed = {f"broad_{k}": flag(c("_broad") & c(v)) for k, v in (("frail", "_frail"), ("earnings", "_earns"), ("children", "_kids"))}
    return {"broad": flag(c("_broad")), "state_unknown": flag(~c("_known")), **crossed, "categorical_broad": flag(c("categorical").isin(2, 3)), "categorical_missing": S.missing(c("categorical"))}


def medical() -> dict[str, Column]:
    """Claims, documents and the distance of the rebuilt expense (floor added back) from the year's premium."""
    claims, above = c("medical") > 0, c("medical") > FLOOR
    applies = c("_elders") & F.coalesce(claims, F.lit(False)) & c("premium").isNotNull()
    rebuilt = F.when(claims, c("medical") + FLOOR)
    away = rebuilt - c("premium")
    return {
        "claims_medical": flag(claims), "claims_medical_missing": S.missing(c("medical")), "above_floor": flag(above), "documents": flag(above & c("_frail") & ~c("_standard")),
        "premium_only": flag(applies & (F.abs(away) <= AT_PREMIUM + SLACK)), "just_above_premium": flag(applies & (away > AT_PREMIUM + SLACK) & (away <= ABOVE_PREMIUM + SLACK)),
        "premium_distance": F.when(applies, F.abs(away)), "premium_missing": S.missing(c("premium")), "premium": c("premium"), "rebuilt_expense": rebuilt, "premium_applies": flag(applies),
        "literal_premium_only": flag(applies & (F.abs(c("medical") - c("premium")) <= AT_PREMIUM + SLACK)), "demo": flag(c("demo") == 1),
    }


def records() -> dict[str, Column]:
    """Positive person slots against the household's total, and the utility choice."""
    n = c("_records")
    return {"records_missing": flag(c("_no_records")), "records": n, "total_has_income": flag(c("self_total") > 0), "records_mismatch": flag((n > 0) != F.coalesce(c("self_total") > 0, F.lit(False))), "actual_utilities": flag(c("utility") == 2), "actual_utilities_missing": S.missing(c("utility"))}


def deductions() -> dict[str, Column]:
    four = [c(f"{k}_part") for k in ("medical", "care", "support", "shelter")]
    five = [*four, c("earned_part")]
    return {"parts_missing": flag(S.any_null(four)), "parts": S.count_positive(four), "deductions_missing": flag(S.any_null(five) | c("size").isNull()), "per_member": S.row_sum(five) / F.when(c("size").isNotNull(), F.greatest(c("size"), F.lit(1)))}


def position() -> dict[str, Column]:
    """The benefit between its least and most, and net income as a share of gross."""
    between = lambda x, high: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(high), x)))
    of_most = F.try_divide(c("formula"), c("most"))
    return {"position_missing": flag(S.any_null([c("formula"), c("most"), c("least")])), "at_max": flag(of_most >= 0.999), "at_min": flag(c("formula") <= c("least") + 0.5), "of_most": between(of_most, 1.5), "net_share_undefined": flag(c("net").isNull() | c("gross").isNull() | (c("gross") <= 0)), "net_share": between(F.try_divide(c("net"), c("gross")), 2.0)}


def build(df: DataFrame, keys: list[str], *, states: DataFrame, broad: DataFrame, standard: DataFrame, premiums: DataFrame, medical_element: int, impacts: list[int]) -> DataFrame:
    """``keys``, state, year and every feature: one pass over the rows, registries aside."""
    groups = targets(medical_element, impacts), household(), cadence(), eligibility(), medical(), records(), deductions(), position()
    rows = prepared(df, states, broad, standard, premiums)
    return rows.select(*keys, "state", "year", *[x.alias(k) for g in groups for k, x in g.items()])
