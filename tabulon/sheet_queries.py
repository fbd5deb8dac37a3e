"""Registered queries of sheets, catalog, plans, charts and reviews, each with its SQL; they join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.operators import catalog as C
from tabulon.operators import charts as H
from tabulon.operators import metrics as M
from tabulon.operators import review as R
from tabulon.operators import structure as T
from tabulon.operators import validate as V
from tabulon.operators.blocks import exclude_aggregates
from tabulon.plans import planner
from tabulon.plans.recipe import Recipe, compile_recipe
from tabulon.queries import _D, _ORDERS, _SUM, _WITH, P, QUERIES, SQL, query, union_files
from tabulon.sources import legacy
from tabulon.sources import long_view as L

__all__ = ["QUERIES", "SQL"]


# Sheets
_SHEET = f"O AS ({_ORDERS}), N AS (SELECT period, sheet, value, split_part(dimension, ' > ', 2) AS nation, col - 1 AS n FROM O)"
_FILE = f"'{L.SHEETS_FILE}'"


@query(f"""WITH {_SHEET} SELECT {_FILE} AS file, sheet, CAST(MAX(n) + 1 AS INTEGER) AS width, CAST(MIN(period) - 1990 AS INTEGER) AS data_start, CAST(MAX(period) - 1990 AS INTEGER) AS data_end, '1' AS title_rows, '2' AS header_rows
FROM N GROUP BY sheet""")
def sheet_structure(spark, folder):
    found = T.sheet_structure(L.sheet_cells(spark, folder))
    return found.withColumns({k: F.array_join(F.col(k).cast("array<string>"), ",") for k in ("title_rows", "header_rows")})


@query(f"""WITH {_SHEET} SELECT sheet, 1 AS col, '年度 year' AS name, 'period' AS kind, CAST(COUNT(DISTINCT period) AS BIGINT) AS filled FROM N GROUP BY sheet
UNION ALL SELECT sheet, n + 1, nation, 'measure', COUNT(*) FROM N GROUP BY sheet, n, nation""")
def sheet_columns(spark, folder):
    return T.columns(L.sheet_cells(spark, folder)).select("sheet", "col", "name", "kind", "filled")


def _long_sql(row: str, col: str) -> str:
    return f"""WITH {_SHEET} SELECT period, CAST(NULL AS INTEGER) AS month, sheet || '_' || nation AS canonical, nation AS dimension, value, {_FILE} AS file, sheet, CAST({row} AS INTEGER) AS row, CAST({col} AS INTEGER) AS col,
    'detail' AS aggregation_role, FALSE AS anomaly FROM N"""


@query(_long_sql("period - 1990", "n + 1"))
def sheet_to_long(spark, folder):
    return T.long_table(L.sheet_cells(spark, folder))


@query(_long_sql("n + 2", "period - 1990"))
def sheet_to_long_transposed(spark, folder):
    return T.long_table(L.sheet_cells(spark, folder, transposed=True))


@query(f"""WITH {_SHEET} SELECT {_FILE} AS file, sheet, substr(sha256('1' || chr(31) || '年度 year' || chr(31) || string_agg(nation, chr(31) ORDER BY n)), 1, 16) AS fingerprint FROM (SELECT DISTINCT sheet, nation, n FROM N) GROUP BY sheet""")
def sheet_fingerprint(spark, folder):
    return T.fingerprints(L.sheet_cells(spark, folder))


@query(f"""WITH {_SHEET} SELECT sheet, CAST(MAX(period) - MIN(period) + 1 AS INTEGER) AS rows, CAST(MAX(n) + 1 AS INTEGER) AS width, list_aggregate(list_slice(list_sort(list(DISTINCT period)), 1, 3), 'string_agg', ',') AS years, '' AS negatives
FROM N GROUP BY sheet""")
def sheet_reconnaissance(spark, folder):
    out = T.reconnaissance(L.sheet_cells(spark, folder))
    return out.select("sheet", "rows", "width", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.array_join("negatives", ",").alias("negatives"))


@query("""WITH A AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k, COUNT(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer WHERE c_acctbal < 0)
SELECT 'customer' AS file, c_mktsegment AS sheet, CAST(c_nationkey AS VARCHAR) AS dimension, CAST(n AS BIGINT) AS n, string_agg(chr(CAST(65 + c_nationkey AS INTEGER)) || c_custkey, ',' ORDER BY c_custkey) AS cells FROM A WHERE k <= 5 GROUP BY ALL""")
def anomaly_summary(spark, folder):
    rows = L.table(spark, folder, "customer").select(
        F.lit("customer").alias("file"), F.col("c_mktsegment").alias("sheet"), F.col("c_nationkey").cast("string").alias("dimension"), F.col("c_custkey").cast("int").alias("row"),
        (F.col("c_nationkey") + 1).alias("col"), (F.col("c_acctbal") < 0).alias("anomaly"),
    )
    return T.anomaly_summary(rows)


# Catalog
_CARDS = f"""{_SHEET}, K AS (SELECT sheet, nation, n, COUNT(value) AS k, MIN(value) AS low, MAX(value) AS high, list_slice(list(round(value, 4) ORDER BY period), 1, 3) AS samples,
  chr(CAST(65 + n AS INTEGER)) || (MIN(period) - 1990) || ':' || chr(CAST(65 + n AS INTEGER)) || (MAX(period) - 1990) AS cell_range FROM N GROUP BY sheet, nation, n)"""


@query(f"""WITH {_CARDS} SELECT {_FILE} AS file, sheet, sheet || '_' || nation AS canonical, nation AS dimension, 'detail' AS aggregation_role, '人次' AS unit, CASE WHEN k < 3 THEN 0.55 ELSE 0.855 END AS confidence,
CASE WHEN k < 3 THEN 'review' ELSE 'auto' END AS decision, cell_range, CAST(k AS BIGINT) AS n, low, high, list_aggregate(list_transform(samples, lambda x: format('{{:.3f}}', x)), 'string_agg', ',') AS samples, CASE WHEN k < 3 THEN 'too few values' ELSE '' END AS notes FROM K""")
def catalog_fields(spark, folder):
    cards = C.field_cards(T.long_table(L.sheet_cells(spark, folder)))
    return cards.drop("profile").withColumns({"notes": F.array_join("notes", ","), "samples": F.array_join(F.transform("samples", lambda x: F.format_string("%.3f", x)), ","), "confidence": F.round("confidence", 6)})


@query(f"WITH {_CARDS} SELECT CAST(1 AS BIGINT) AS files, CAST(COUNT(*) FILTER (WHERE k >= 3) AS BIGINT) AS fields, CAST(COUNT(*) FILTER (WHERE k >= 3) AS BIGINT) AS auto, CAST(COUNT(*) FILTER (WHERE k < 3) AS BIGINT) AS review FROM K")
def catalog_summary(spark, folder):
    return C.catalog_summary(C.field_cards(T.long_table(L.sheet_cells(spark, folder))))


@query(f"WITH {_CARDS} SELECT CAST(position AS BIGINT) AS position, canonical FROM (SELECT row_number() OVER (ORDER BY sheet, sheet || '_' || nation) AS position, sheet || '_' || nation AS canonical FROM K WHERE k >= 3) WHERE position <= 10 UNION ALL SELECT 11, (SELECT COUNT(*) - 10 FROM K WHERE k >= 3) || ' more fields'")
def catalog_text(spark, folder):
    lines = C.compact_text(C.field_cards(T.long_table(L.sheet_cells(spark, folder))), 10)
    return lines.select(F.col("position").cast("long").alias("position"), F.element_at(F.split("line", r" \| "), 1).alias("canonical"))


@query(f"""WITH {_SHEET} SELECT sheet AS concept, string_agg(DISTINCT split_part(nation, '_', -1), ',' ORDER BY split_part(nation, '_', -1)) AS leaves, string_agg(DISTINCT period, ',' ORDER BY period) AS periods, CAST(COUNT(*) AS BIGINT) AS records
FROM (SELECT replace(sheet, ' ', ' ') AS sheet, nation, period FROM N) GROUP BY sheet""")
def data_summary(spark, folder):
    out = C.data_summary(T.long_table(L.sheet_cells(spark, folder)))
    return out.select("concept", F.array_join("leaves", ",").alias("leaves"), F.array_join(F.col("periods").cast("array<string>"), ",").alias("periods"), "records")


def fuzzy_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of like names among parts' names, as fields of two sheets; no SQL: DuckDB has no such similarity."""
    rows = L.table(spark, folder, "part").select(
        F.lit("part").alias("file"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("sheet"), F.col("p_name").alias("canonical"), F.col("p_name").alias("dimension"),
        F.lit("detail").alias("aggregation_role"), F.col("p_retailprice").alias("value"), F.col("p_partkey").cast("int").alias("row"), F.lit(1).alias("col"),
    )
    return C.fuzzy_pairs(C.field_cards(rows))


QUERIES["fuzzy_fields"] = fuzzy_fields


@query(f"{_WITH} SELECT dimension, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM (SELECT * FROM L UNION ALL SELECT * FROM O) GROUP BY dimension HAVING COUNT(DISTINCT file) > 1")
def catalog_join_keys(spark, folder):
    return C.join_keys(union_files(spark, folder))


@query(f"{_WITH} SELECT canonical, CAST(COUNT(DISTINCT file) AS BIGINT) AS n_files FROM (SELECT * FROM L UNION ALL SELECT * FROM O) GROUP BY canonical")
def group_count_distinct_files(spark, folder):
    return union_files(spark, folder).groupBy("canonical").agg(F.count_distinct("file").alias("n_files"))


# Plans
_PLANNED = """R AS (SELECT * REPLACE (CASE WHEN aggregation_role = 'subtotal' THEN 'total' ELSE aggregation_role END AS aggregation_role) FROM L WHERE sheet <> 'all'),
Y AS (SELECT MAX(period) AS last FROM R WHERE aggregation_role = 'detail'),
B AS (SELECT canonical, sheet, value, row_number() OVER (ORDER BY value DESC, canonical) AS position FROM R, Y WHERE aggregation_role = 'detail' AND period = last QUALIFY position <= 5)"""


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.sales(spark, folder).where("sheet <> 'all'")
    return rows.withColumn("aggregation_role", F.when(F.col("aggregation_role") == "subtotal", "total").otherwise(F.col("aggregation_role")))


@query(f"""{_WITH}, {_PLANNED}, M AS (SELECT b.*, last, p.value AS before, t.value AS whole FROM B b CROSS JOIN Y LEFT JOIN R p ON p.canonical = b.canonical AND p.period = last - 1 AND p.aggregation_role = 'detail'
  LEFT JOIN R t ON t.sheet = b.sheet AND t.period = last AND t.aggregation_role = 'total')
SELECT 'lineitem_' || canonical || '_' || last AS metric_id, 'value' AS kind, 'lineitem' AS file, sheet, canonical, last AS period, value, '未知' AS unit, 'passed' AS status, CAST(NULL AS VARCHAR) AS reason FROM M
UNION ALL SELECT 'lineitem_' || canonical || '_yoy_' || last, 'yoy', 'lineitem', sheet, canonical, last, CASE WHEN before > 0 THEN (value - before) / before * 100 END, '%', CASE WHEN before > 0 THEN 'passed' ELSE 'na' END, CASE WHEN before IS NULL THEN 'base is missing' END FROM M
UNION ALL SELECT 'lineitem_' || canonical || '_share_' || last, 'share', 'lineitem', sheet, canonical, last, value / whole * 100, '%', 'passed', NULL FROM M""")
def rule_plan(spark, folder):
    return planner.rule_plan(_planned(spark, folder), places=P)


@query(f"""{_WITH}, {_PLANNED}, G AS (SELECT b.canonical, CAST(last - i AS INTEGER) AS period FROM B b, Y, range(6) t(i) WHERE position = 1)
SELECT 'trend_lineitem_' || G.canonical AS chart_id, 'lineitem_' || G.canonical || '_' || G.period AS metric_id, 'lineitem' AS file, G.canonical, G.period, R.value FROM G LEFT JOIN R ON R.canonical = G.canonical AND R.period = G.period AND R.aggregation_role = 'detail'""")
def trend_points(spark, folder):
    return planner.trend_points(_planned(spark, folder), places=P)


_SUMS = {
    "metric_name": "Sales of nation 13", "unit": "元", "period": 1998, "assumption_statement": "both files", "output": "n",
    "steps": [
        {"id": "now", "block": "filter_by_period", "params": {"start": 1998, "end": 1998}},
        {"id": "one", "block": "filter", "input": "now", "params": {"column": "canonical", "operator": "==", "value": "revenue_NATION_13"}},
        {"id": "n", "block": "group_sum", "input": "one", "params": {"places": P}},
    ],
}
_ONE_FILE = {**_SUMS, "steps": [_SUMS["steps"][0], {**_SUMS["steps"][1]}, {"id": "file", "block": "filter", "input": "one", "params": {"column": "file", "operator": "==", "value": "orders"}}, {**_SUMS["steps"][2], "input": "file"}]}


def _metric(spark: SparkSession, folder: str, recipe: dict, name: str) -> DataFrame:
    return compile_recipe(Recipe.parse({**recipe, "metric_id": name}), union_files(spark, folder))


@query(f"""{_WITH}, U AS (SELECT * FROM L UNION ALL SELECT * FROM O), X AS (SELECT * FROM U WHERE period = 1998 AND canonical = 'revenue_NATION_13')
SELECT 'both' AS metric_id, {_SUM} AS value, CASE WHEN COUNT(DISTINCT file) > 1 THEN 'failed' WHEN COUNT(*) = 0 THEN 'na' ELSE 'passed' END AS status, CASE WHEN COUNT(DISTINCT file) > 1 THEN 'ambiguous source: revenue_NATION_13 in lineitem, orders' ELSE '' END AS issues FROM X
UNION ALL SELECT 'orders', {_SUM}, CASE WHEN COUNT(*) = 0 THEN 'na' ELSE 'passed' END, '' FROM X WHERE file = 'orders'""")
def recipe_ambiguous(spark, folder):
    rows = _metric(spark, folder, _SUMS, "both").unionByName(_metric(spark, folder, _ONE_FILE, "orders"))
    return rows.select("metric_id", "value", "status", F.array_join(F.filter("issues", lambda x: x != "missing"), ";").alias("issues"))


@query(f"""{_WITH}, X AS (SELECT file, sheet, row, col, chr(CAST(64 + col AS INTEGER)) || row AS cell FROM O WHERE period = 1998 AND canonical = 'revenue_NATION_13')
SELECT 'orders' AS metric_id, 'now:filter_by_period>one:filter>file:filter>n:group_sum' AS blocks, file, sheet, cell || ':' || cell AS "range", sheet || '!' || cell AS cells FROM X""")
def recipe_lineage(spark, folder):
    row = _metric(spark, folder, _ONE_FILE, "orders")
    return row.select("metric_id", F.array_join("blocks", ">").alias("blocks"), F.inline("sources"), F.array_join("cells", ",").alias("cells")).select("metric_id", "blocks", "file", "sheet", "range", "cells")


# Charts
_MONTHLY = """Q AS MATERIALIZED (SELECT n_name AS entity, year(l_shipdate) * 100 + month(l_shipdate) AS month, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS amount, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS units
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
Z AS (SELECT MAX(month) AS latest FROM Q), A AS MATERIALIZED (SELECT q.entity, q.amount AS now, b.amount AS before, q.units, row_number() OVER (ORDER BY q.amount DESC, q.entity) AS position
  FROM Q q JOIN Z ON q.month = latest LEFT JOIN Q b ON b.entity = q.entity AND b.month = CASE WHEN latest % 100 = 1 THEN latest - 89 ELSE latest - 1 END)"""


def _on_months(sql: str):
    return query(f"WITH {_MONTHLY} {sql}")


def _amounts(spark: SparkSession, folder: str) -> DataFrame:
    return L.monthly_measures(spark, folder).where("measure = 'amount'")


@_on_months("SELECT entity, now / 10000 AS x, (now - before) / before * 100 AS y, CAST(position AS BIGINT) AS position FROM A WHERE position <= 15 AND before > 0")
def scatter_size_growth(spark, folder):
    return H.scatter(_amounts(spark, folder), "entity", "month", 15, 10_000.0).withColumn("position", F.col("position").cast("long"))


@_on_months("SELECT entity, (now - before) / before * 100 AS growth, CAST(position AS BIGINT) AS position FROM A WHERE position <= 10 AND before > 0")
def monthly_growth_bars(spark, folder):
    return H.monthly_growth_bars(_amounts(spark, folder), "entity", "month").withColumn("position", F.col("position").cast("long"))


@_on_months("SELECT entity, now / (SELECT SUM(now) FROM A) * 100 AS first_share, units / (SELECT SUM(units) FROM A) * 100 AS second_share, CAST(position AS BIGINT) AS position FROM A WHERE position <= 8")
def share_pairs(spark, folder):
    out = H.share_pairs(L.monthly_measures(spark, folder), "entity", "month", "measure", "amount", "units")
    return out.withColumn("position", F.col("position").cast("long"))


@_on_months("SELECT entity, round(now * 1000 / units, 0) AS per_unit FROM A WHERE units > 0")
def amount_per_unit(spark, folder):
    return H.amount_per_unit(L.monthly_measures(spark, folder), "entity", "month", "measure", "amount", "units")


@_on_months("SELECT A.entity, m.month, round(Q.amount / 1000, 1) AS value FROM A CROSS JOIN (SELECT DISTINCT month FROM Q) m LEFT JOIN Q ON Q.entity = A.entity AND Q.month = m.month WHERE position <= 5")
def stacked_top_five(spark, folder):
    return H.stacked(_amounts(spark, folder), "entity", "month", 5, 1000.0)


@_on_months("SELECT entity, now AS amount, units FROM A WHERE position <= 14")
def summary_table(spark, folder):
    return H.summary_table(L.monthly_measures(spark, folder), "entity", "month", "measure", ["amount", "units"])


@query(f"{_WITH}, D AS (SELECT * FROM L WHERE {_D}), C AS (SELECT period, AVG(value) AS a, AVG(col) AS b FROM D GROUP BY period) SELECT D.period, canonical, CASE WHEN value >= a AND col >= b THEN 'large_growing' WHEN value >= a THEN 'large_slow' WHEN col >= b THEN 'small_growing' ELSE 'small_slow' END AS quadrant FROM D JOIN C ON D.period = C.period")
def threshold_quadrant(spark, folder):
    return M.quadrants(exclude_aggregates(L.sales(spark, folder)), "value", "col", ["period"], "mean").select("period", "canonical", "quadrant")


# Results and their review
def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics made of customers: some ids repeat, some values are missing."""
    key, v = F.col("c_custkey"), F.col("c_acctbal")
    value = F.when(key % 7 != 0, F.floor(v / 1000).cast("double"))
    status = F.when(key % 7 == 0, "na").when(v < 0, "failed").when(key % 11 == 0, "needs_manual_review").otherwise("passed")
    return L.table(spark, folder, "customer").select(F.concat(F.lit("m"), F.pmod(key, F.lit(140)).cast("string"), F.when(key % 5 == 0, "_yoy").otherwise("")).alias("metric_id"), value.alias("value"), status.alias("status"))


_RESULTS = """E AS (SELECT 'm' || (c_custkey % 140) || CASE WHEN c_custkey % 5 = 0 THEN '_yoy' ELSE '' END AS metric_id, CASE WHEN c_custkey % 7 <> 0 THEN CAST(floor(c_acctbal / 1000) AS DOUBLE) END AS value,
CASE WHEN c_custkey % 7 = 0 THEN 'na' WHEN c_acctbal < 0 THEN 'failed' WHEN c_custkey % 11 = 0 THEN 'needs_manual_review' ELSE 'passed' END AS status FROM customer)"""


def _one_each(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).groupBy("metric_id").agg(F.max("value").alias("value"), F.max("status").alias("status"))


def _charts(spark: SparkSession, folder: str) -> DataFrame:
    """A chart for each nation: all its customers' metrics, some of them unknown, under seven labels."""
    rows = L.table(spark, folder, "customer")
    name = F.concat(F.lit("m"), F.pmod("c_custkey", F.lit(150)).cast("string"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", name.alias("id")))), lambda x: x["id"])
    labels = F.array(*(F.lit(f"k{i}") for i in range(7)))
    return rows.groupBy(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("chart_id")).agg(ids.alias("ids")).select("chart_id", labels.alias("categories"), F.array(F.struct(F.lit("all").alias("name"), F.col("ids").alias("metric_ids"))).alias("series"))


_CHARTS = """W AS (SELECT 'c' || c_nationkey AS chart_id, 'm' || (c_custkey % 150) AS metric_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position FROM customer)"""
_ONE = "U1 AS (SELECT metric_id, MAX(value) AS value, MAX(status) AS status FROM E GROUP BY metric_id)"


@query(f"WITH {_RESULTS} SELECT CAST(COUNT(*) AS BIGINT) AS metrics, {', '.join(f'CAST(COUNT(*) FILTER (WHERE status = {s!r}) AS BIGINT) AS {s}' for s in ('passed', 'na', 'failed', 'needs_manual_review'))} FROM E")
def status_counts(spark, folder):
    return R.status_counts(_results(spark, folder))


@query(f"WITH {_RESULTS} SELECT metric_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT value) + MAX(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_values, COALESCE(string_agg(DISTINCT CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(CAST(value AS BIGINT) AS VARCHAR)), '') AS listed FROM E GROUP BY metric_id HAVING COUNT(*) > 1")
def duplicate_metric_ids(spark, folder):
    listed = F.array_join(F.sort_array(F.col("values").cast("array<bigint>").cast("array<string>")), ",")
    return R.duplicate_metric_ids(_results(spark, folder)).withColumn("listed", listed).drop("values")


@query(f"WITH {_RESULTS}, {_CHARTS} SELECT chart_id, 'all' AS series, metric_id FROM W WHERE metric_id NOT IN (SELECT metric_id FROM E)")
def missing_metric_refs(spark, folder):
    return R.missing_metric_refs(_charts(spark, folder), _results(spark, folder))


@query(f"WITH {_CHARTS} SELECT chart_id, 'all' AS series, CAST(COUNT(*) AS BIGINT) AS points, CAST(7 AS BIGINT) AS labels FROM W GROUP BY chart_id HAVING COUNT(*) <> 7")
def axis_mismatches(spark, folder):
    return R.axis_mismatches(_charts(spark, folder))


@query(f"WITH {_RESULTS}, {_CHARTS}, {_ONE} SELECT chart_id, 'all' AS series, CAST(position AS BIGINT) AS position, CASE WHEN position < 7 THEN 'k' || position END AS label, W.metric_id, U1.value, U1.status FROM W LEFT JOIN U1 ON W.metric_id = U1.metric_id")
def chart_point_flatten(spark, folder):
    return H.chart_points(_charts(spark, folder), _one_each(spark, folder))


@query(f"""WITH {_RESULTS}, {_CHARTS}, {_ONE}, S AS (SELECT chart_id, MAX(CASE status WHEN 'passed' THEN 0 WHEN 'na' THEN 1 WHEN 'needs_manual_review' THEN 2 WHEN 'failed' THEN 3 END) AS w, bool_or(status IS NULL) AS gap FROM W LEFT JOIN U1 ON W.metric_id = U1.metric_id GROUP BY chart_id)
SELECT chart_id, CASE WHEN w IS NULL THEN 'missing' WHEN w = 0 AND gap THEN 'na' WHEN w = 0 THEN 'passed' WHEN w = 1 THEN 'na' WHEN w = 2 THEN 'needs_manual_review' ELSE 'failed' END AS status FROM S""")
def chart_status(spark, folder):
    return H.chart_status(chart_point_flatten(spark, folder))


@query(f"WITH {_RESULTS}, {_CHARTS}, {_ONE} SELECT chart_id, 'all' AS series, CAST(COUNT(*) AS BIGINT) AS points, CAST(COUNT(DISTINCT COALESCE(CAST(value AS VARCHAR), 'None')) AS BIGINT) AS different FROM W LEFT JOIN U1 ON W.metric_id = U1.metric_id GROUP BY chart_id HAVING COUNT(DISTINCT COALESCE(CAST(value AS VARCHAR), 'None')) < COUNT(*) * 0.5")
def suspicious_bars(spark, folder):
    return R.suspicious_bars(chart_point_flatten(spark, folder))


def _slides(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    part = F.when(key % 3 == 0, "kpi").when(key % 3 == 1, "chart").otherwise("table")
    name = F.concat(F.lit("m"), F.pmod(key, F.lit(150)).cast("string"), F.when(key % 5 == 0, "_yoy").otherwise(""))
    return L.table(spark, folder, "customer").select((key % 20).alias("slide"), part.alias("part"), name.alias("metric_id"))


@query(f"""WITH {_RESULTS}, {_ONE}, P AS (SELECT c_custkey % 20 AS slide, CASE c_custkey % 3 WHEN 0 THEN 'kpi' WHEN 1 THEN 'chart' ELSE 'table' END AS part, 'm' || (c_custkey % 150) || CASE WHEN c_custkey % 5 = 0 THEN '_yoy' ELSE '' END AS metric_id FROM customer),
I AS (SELECT slide, part, P.metric_id, CASE WHEN U1.metric_id IS NULL THEN CASE WHEN part = 'table' THEN 'missing_warning' ELSE 'missing' END WHEN part = 'kpi' AND status <> 'passed' THEN 'not_passed' WHEN P.metric_id LIKE '%yoy%' AND value IS NULL THEN 'no_base' END AS issue
  FROM P LEFT JOIN U1 ON P.metric_id = U1.metric_id) SELECT * FROM I WHERE issue IS NOT NULL""")
def reference_issues(spark, folder):
    return R.reference_issues(_slides(spark, folder), _one_each(spark, folder))


@query(f"WITH {_RESULTS}, {_ONE} SELECT metric_id, value + 0.02 AS expected, value, FALSE AS agrees FROM U1 WHERE value > 3 UNION ALL SELECT metric_id, value + 0.005, value, TRUE FROM U1 WHERE value <= 3 UNION ALL SELECT 'none', 1.0, NULL, FALSE")
def lineage_tolerance(spark, folder):
    metrics = _one_each(spark, folder)
    expected = metrics.where("value IS NOT NULL").select("metric_id", (F.col("value") + F.when(F.col("value") > 3, 0.02).otherwise(0.005)).alias("value"))
    return R.within_tolerance(metrics, expected.union(spark.createDataFrame([("none", 1.0)], "metric_id string, value double")))


@query(f"WITH {_RESULTS} SELECT c_nationkey AS id, string_agg(metric_id, ',' ORDER BY k) AS evidence FROM (SELECT c_nationkey, 'm' || (c_custkey % 150) AS metric_id, MIN(c_custkey) AS k FROM customer GROUP BY ALL) WHERE metric_id IN (SELECT metric_id FROM E) GROUP BY c_nationkey")
def known_evidence(spark, folder):
    name = F.concat(F.lit("m"), F.pmod("c_custkey", F.lit(150)).cast("string"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", name.alias("id")))), lambda x: x["id"])
    insights = L.table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(ids.alias("evidence"))
    return R.known_evidence(insights, _results(spark, folder)).withColumn("evidence", F.array_join("evidence", ","))


# The older layout
@query("""WITH S AS (SELECT n_name, SUM(CASE WHEN month(o_orderdate) = 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS a, SUM(CASE WHEN month(o_orderdate) = 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT n_name AS institution, period, metric, value, unit, 'bank.xlsx' AS source_file, 'P.7_流通卡數' AS source_sheet, n_name || '@' || cell AS source_cell FROM (
SELECT n_name, '11401' AS period, '流通卡數' AS metric, CAST(a AS DOUBLE) AS value, '張' AS unit, '11401' AS cell FROM S UNION ALL SELECT n_name, '11402', '流通卡數', CAST(b AS DOUBLE), '張', '11402' FROM S
UNION ALL SELECT n_name, '11402', '流通卡數_市佔率', 0.25 * 100, '%', '市佔率' FROM S)""")
def legacy_standardise(spark, folder):
    month, price = F.month("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)")
    rows = L.table(spark, folder, "orders").join(L.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(L.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = rows.groupBy(F.col("n_name").alias("金融機構名稱")).agg(F.sum(F.when(month == 1, price)).alias("11401"), F.sum(F.when(month == 2, price)).alias("11402"), F.lit(0.25).alias("流通卡數市佔率"))
    total = wide.select(F.lit(" ").alias("金融機構名稱"), "11401", "11402", "流通卡數市佔率").limit(1)
    return legacy.standardise(wide.unionByName(total), "bank.xlsx", "P.7_流通卡數").drop("raw_value")

