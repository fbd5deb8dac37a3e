"""Checks of results: ids, references, chart axes and what sentences claim; issues come as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that compare two percentages.
HIGHER, LOWER = ("高於", "大於", "超過", "higher than"), ("低於", "小於", "不及", "lower than")
# The layouts that every deck has to have, those that analyse, and those of the latter that sum up others.
REQUIRED_PAGES = ("executive_summary", "strategy")
ANALYSIS = ("trend_chart", "ranking_chart", "scatter_chart", "comparison_chart", "stacked_chart", "risk_chart", "executive_summary", "strategy")
SUMMARIES = ("strategy", "executive_summary")


def status_counts(metrics: DataFrame) -> DataFrame:
    """One row: how many metrics there are, and how many passed, are not available, failed or need review."""
    named = (F.count_if(F.col("status") == x).alias(x) for x in ("passed", "na", "failed", "needs_manual_review"))
    return metrics.agg(F.count(F.lit(1)).alias("metrics"), *named)


def duplicate_metric_ids(metrics: DataFrame) -> DataFrame:
    """(metric_id, n, n_values, values): ids of more than one row, with the values that they stand for."""
    out = metrics.groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("value")).alias("values"), F.bool_or(F.col("value").isNull()).alias("_gap"))
    return out.where("n > 1").select("metric_id", "n", (F.size("values") + F.col("_gap").cast("int")).cast("long").alias("n_values"), "values")


def missing_metric_refs(charts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(chart_id, series, metric_id): ids that charts (chart_id, series of (name, metric_ids)) name and metrics lack."""
    ids = charts.select("chart_id", F.explode("series").alias("s")).select("chart_id", F.col("s.name").alias("series"), F.explode("s.metric_ids").alias("metric_id"))
    return ids.join(metrics.select("metric_id"), "metric_id", "left_anti").select("chart_id", "series", "metric_id")


def axis_mismatches(charts: DataFrame) -> DataFrame:
    """(chart_id, series, points, labels): series that have another number of points than the chart has labels."""
    rows = charts.select("chart_id", F.size("categories").cast("long").alias("labels"), F.explode("series").alias("s"))
    return rows.select("chart_id", F.col("s.name").alias("series"), F.size("s.metric_ids").cast("long").alias("points"), "labels").where("labels > 0 AND points <> labels")


def suspicious_bars(points: DataFrame) -> DataFrame:
    """(chart_id, series, points, different): series of points (chart_id, series, value) of which more than half repeat another."""
    text = F.coalesce(F.col("value").cast("string"), F.lit("None"))
    out = points.groupBy("chart_id", "series").agg(F.count(F.lit(1)).alias("points"), F.count_distinct(text).alias("different"))
    return out.where(F.col("different") < F.col("points") * 0.5)


def reference_issues(slides: DataFrame, metrics: DataFrame) -> DataFrame:
    """(slide, part, metric_id, issue) of slides (slide, part, metric_id), part being kpi, chart or table.

    missing: no such metric (in a table only a warning); not_passed: a kpi of one that didn't pass; no_base: a yoy metric without a value.
    """
    known = metrics.select("metric_id", "value", "status", F.lit(True).alias("there"))
    rows = slides.join(known, "metric_id", "left")
    issue = (
        F.when(F.col("there").isNull(), F.when(F.col("part") == "table", "missing_warning").otherwise("missing"))
        .when((F.col("part") == "kpi") & (F.col("status") != "passed"), "not_passed").when(F.lower("metric_id").contains("yoy") & F.col("value").isNull(), "no_base")
    )
    return rows.select("slide", "part", "metric_id", issue.alias("issue")).where("issue IS NOT NULL")


def narrative_issues(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of texts with ``first``, ``word`` and ``second`` for each sentence like "10% higher than 12%" that isn't so; ties aren't so."""

    def found(words: tuple[str, ...], wrong) -> Column:
        parts = F.regexp_extract_all(F.col(text), F.lit(rf"(\d+\.?\d*%\s*(?:{'|'.join(words)})\s*\d+\.?\d*%)"), F.lit(1))
        number = lambda x, k: F.element_at(F.regexp_extract_all(x, F.lit(r"(\d+\.?\d*)%"), F.lit(1)), k).cast("double")
        claim = F.transform(parts, lambda x: F.struct(number(x, 1).alias("first"), F.regexp_extract(x, "|".join(words), 0).alias("word"), number(x, 2).alias("second")))
        return F.filter(claim, wrong)

    issues = F.concat(found(HIGHER, lambda c: c["first"] <= c["second"]), found(LOWER, lambda c: c["first"] >= c["second"]))
    return texts.withColumn("_issue", F.explode(issues)).select(*texts.columns, "_issue.*")


def within_tolerance(metrics: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(metric_id, expected, value, agrees): expected values against metrics; one that is missing doesn't agree."""
    rows = expected.select("metric_id", F.col("value").alias("expected")).join(metrics.select("metric_id", "value"), "metric_id", "left")
    return rows.withColumn("agrees", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tolerance, F.lit(False)))


def metric_issues(value: Column, unit: Column, is_share: Column, percent: tuple[str, ...], positive: tuple[str, ...]) -> Column:
    """Names of what is wrong with a value: missing, not_finite, below_minus_100, share_out_of_range, negative."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    found = (
        (value.isNull(), "missing"), (bad, "not_finite"), (~bad & unit.isin(*percent) & (value < -100), "below_minus_100"),
        (~bad & is_share & ((value < 0) | (value > 100)), "share_out_of_range"), (~bad & unit.isin(*positive) & (value < 0), "negative"),
    )
    return F.filter(F.array(*(F.when(c, x) for c, x in found)), lambda x: x.isNotNull())


def known_evidence(insights: DataFrame, metrics: DataFrame) -> DataFrame:
    """insights (id, evidence) with the ids of evidence that metrics have, each once, in their order; those left without any go."""
    each = insights.select("id", F.posexplode(F.array_distinct("evidence")).alias("at", "metric_id")).join(metrics.select("metric_id"), "metric_id", "left_semi")
    kept = each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "metric_id"))), lambda x: x["metric_id"]).alias("evidence"))
    return insights.drop("evidence").join(kept, "id")


def complete_decks(slides: DataFrame, required: tuple[str, ...] = REQUIRED_PAGES) -> DataFrame:
    """(deck): decks of slides (deck, layout) that have a slide of every required layout."""
    found = slides.where(F.col("layout").isin(*required)).groupBy("deck").agg(F.count_distinct("layout").alias("n"))
    return found.where(F.col("n") == len(set(required))).select("deck")


def structure_issues(slides: DataFrame, pages: int | None = None, required: tuple[str, ...] = REQUIRED_PAGES) -> DataFrame:
    """(deck, issue, detail): page_count, with the number of slides where it isn't ``pages``, and missing_page, with each required layout that a deck lacks."""
    has = [F.bool_or(F.coalesce(F.col("layout") == x, F.lit(False))).alias(f"has{i}") for i, x in enumerate(required)]
    decks = slides.groupBy("deck").agg(F.count(F.lit(1)).alias("n"), *has)
    issue = lambda name, detail: F.struct(F.lit(name).alias("issue"), detail.alias("detail"))
    found = [F.when(F.col("n") != pages, issue("page_count", F.col("n").cast("string")))] if pages is not None else []
    found += [F.when(~F.col(f"has{i}"), issue("missing_page", F.lit(x))) for i, x in enumerate(required)]
    return decks.select("deck", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("deck", "i.*")


def weak_insights(slides: DataFrame) -> DataFrame:
    """(deck, slide, issue) of slides (deck, slide, layout, headline, insights of (text, evidence)) that analyse.

    no_insight (not asked of strategy), no_headline, and no_evidence for each insight without any, which summaries may lack.
    """
    pages = slides.where(F.col("layout").isin(*ANALYSIS))
    none = F.coalesce(F.size("insights"), F.lit(0)) <= 0
    bare = F.filter(F.coalesce("insights", F.array().cast(slides.schema["insights"].dataType)), lambda x: F.coalesce(F.size(x["evidence"]), F.lit(0)) <= 0)
    issues = F.concat(
        F.filter(F.array(F.when(none & (F.col("layout") != "strategy"), "no_insight"), F.when(F.coalesce(F.col("headline"), F.lit("")) == "", "no_headline")), lambda x: x.isNotNull()),
        F.when(F.col("layout").isin(*SUMMARIES), F.array().cast("array<string>")).otherwise(F.transform(bare, lambda _: F.lit("no_evidence"))),
    )
    return pages.select("deck", "slide", F.explode(issues).alias("issue"))
