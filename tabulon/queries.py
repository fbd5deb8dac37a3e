"""Registered queries of the report engine over the long tables of ``sources.long_view``, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.operators import blocks as B
from tabulon.operators import metrics as M
from tabulon.operators import validate as V
from tabulon.plans.recipe import Recipe, compile_recipe
from tabulon.sources import long_view as L

P = 4  # decimal places in which sums are exact

_REVENUE = """
base AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS period, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS m, r_name, n_name, n_nationkey, r_regionkey,
    SUM(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


def _long_sql(period: str) -> str:
    rows = lambda canon, dim, sheet, col, role, keys: (
        f"SELECT CAST({period} AS INTEGER) AS period, {canon} AS canonical, {dim} AS dimension, CAST(SUM(v) AS DOUBLE) AS value, 'lineitem' AS file, {sheet} AS sheet, "
        f"CAST({period} % 100 + 3 AS INTEGER) AS row, CAST({col} AS INTEGER) AS col, '{role}' AS aggregation_role FROM base GROUP BY {period}{keys}"
    )
    return " UNION ALL ".join((
        rows("'revenue_' || n_name", "r_name || ' > ' || n_name", "r_name", "n_nationkey + 2", "detail", ", r_name, n_name, n_nationkey"),
        rows("'revenue_' || r_name || '_subtotal'", "r_name || ' > subtotal'", "r_name", "r_regionkey + 100", "subtotal", ", r_name, r_regionkey"),
        rows("'revenue_total'", "'total'", "'all'", "200", "total", ""),
    ))


_ORDERS = """
  SELECT CAST(year(o_orderdate) AS INTEGER) AS period, 'revenue_' || n_name AS canonical, r_name || ' > ' || n_name AS dimension,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS value, 'orders' AS file, r_name AS sheet, CAST(year(o_orderdate) % 100 + 3 AS INTEGER) AS row,
    CAST(n_nationkey + 2 AS INTEGER) AS col, 'detail' AS aggregation_role
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY year(o_orderdate), r_name, n_name, n_nationkey"""
_WITH = f"WITH {_REVENUE}, L AS ({_long_sql('period')}), O AS ({_ORDERS})"
_MONTHS = f"WITH {_REVENUE}, L AS MATERIALIZED ({_long_sql('m')})"
_D = "COALESCE(aggregation_role, 'detail') NOT IN ('subtotal', 'total')"
_SUM = "CAST(SUM(CAST(value AS DECIMAL(28,4))) AS DOUBLE)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with the SQL that gives the same rows."""

    def take(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return take


def _on_sales(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: f(L.sales(spark, folder))
    SQL[name] = f"{_WITH} {sql}".replace(" @,", ",")


# Filters and periods
for _name, _spark, _sql in (
    ("filter_eq", ("canonical", "==", "revenue_NATION_13"), "canonical = 'revenue_NATION_13'"),
    ("filter_neq", ("aggregation_role", "!=", "detail"), "aggregation_role IS DISTINCT FROM 'detail'"),
    ("filter_range", ("period", ">=", 1998), "period >= 1998"),
    ("filter_in", ("sheet", "in", ["ASIA", "EUROPE"]), "sheet IN ('ASIA', 'EUROPE')"),
    ("filter_contains", ("dimension", "contains", "_1"), "contains(dimension, '_1')"),
    ("filter_matches", ("canonical", "matches", "^revenue_NATION_1[0-4]"), "regexp_matches(canonical, '^revenue_NATION_1[0-4]')"),
):
    _on_sales(_name, f"SELECT * FROM L WHERE {_sql}", lambda d, a=_spark: B.filter_rows(d, *a))
_on_sales("filter_by_period", "SELECT * FROM L WHERE period BETWEEN 1996 AND 1998", lambda d: B.filter_by_period(d, 1996, 1998))
_on_sales("filter_by_period_open_start", "SELECT * FROM L WHERE period <= 1996", lambda d: B.filter_by_period(d, end=1996))
_on_sales("filter_by_period_open_end", "SELECT * FROM L WHERE period >= 2000", lambda d: B.filter_by_period(d, start=2000))
_on_sales("exclude_aggregates", f"SELECT * FROM L WHERE {_D}", B.exclude_aggregates)

# Grouping
_on_sales("group_sum", f"SELECT period, {_SUM} AS value FROM L WHERE {_D} GROUP BY period", lambda d: B.group_sum(d, places=P))
_on_sales("group_sum_all_roles", f"SELECT sheet, {_SUM} AS value FROM L GROUP BY sheet", lambda d: B.group_sum(d, "sheet", detail_only=False, places=P))
_on_sales("group_mean", f"SELECT dimension, {_SUM} / COUNT(value) AS value FROM L WHERE {_D} GROUP BY dimension", lambda d: B.group_mean(d, "dimension", places=P))
_on_sales(
    "pivot_period_sheet",
    f"SELECT period, {', '.join(f'CAST(SUM(CASE WHEN sheet = {n!r} THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE) AS {n}' for n in ('AFRICA', 'ASIA', 'EUROPE'))} FROM L WHERE {_D} GROUP BY period",
    lambda d: B.pivot(d, columns="sheet", names=["AFRICA", "ASIA", "EUROPE"], places=P),
)
_on_sales(
    "cumulative_sum",
    f"SELECT period, value, CAST(SUM(CAST(value AS DECIMAL(28,4))) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative FROM (SELECT period, {_SUM} AS value FROM L WHERE {_D} GROUP BY period)",
    lambda d: B.cumulative_sum(B.group_sum(d, places=P), places=P),
)
_on_sales(
    "rank_top_n",
    f"SELECT dimension, value, rank() OVER (ORDER BY value DESC) AS rank FROM (SELECT dimension, {_SUM} AS value FROM L WHERE {_D} GROUP BY dimension) ORDER BY value DESC, dimension LIMIT 5",
    lambda d: B.rank_top_n(B.group_sum(d, "dimension", places=P), n=5, ties=["dimension"]),
)


@query("SELECT c_custkey, value, rank() OVER (ORDER BY value) AS rank FROM (SELECT c_custkey, floor(c_acctbal / 1000) AS value FROM customer) ORDER BY value, c_custkey LIMIT 40")
def rank_ties(spark, folder):
    rows = L.table(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 1000).cast("double").alias("value"))
    return B.rank_top_n(rows, n=40, ascending=True, ties=["c_custkey"])


# Scalars
_on_sales(
    "ratio_share",
    f"""SELECT d.canonical, d.value / t.value * 100 AS value, 'passed' AS status, CAST(NULL AS VARCHAR) AS reason
    FROM (SELECT canonical, {_SUM} AS value FROM L WHERE {_D} GROUP BY canonical) d, (SELECT {_SUM} AS value FROM L WHERE {_D}) t""",
    lambda d: _ratio_share(d),
)


def _ratio_share(d: DataFrame) -> DataFrame:
    rows = B.group_sum(d, "canonical", places=P)
    whole = B.exclude_aggregates(d).agg(B.total(F.col("value"), P).alias("all"))
    return rows.join(F.broadcast(whole)).select("canonical", B.ratio(F.col("value"), F.col("all")).alias("r")).select("canonical", "r.*")


@query("""
SELECT l_returnflag, l_linenumber, CASE WHEN d <> 0 THEN n / d * 100 END AS value, CASE WHEN d <> 0 THEN 'passed' ELSE 'na' END AS status, CASE WHEN d <> 0 THEN NULL ELSE 'denominator is zero' END AS reason
FROM (SELECT l_returnflag, l_linenumber, CAST(SUM(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) AS n, CAST(COUNT(*) FILTER (WHERE l_linenumber > 3) AS DOUBLE) AS d FROM lineitem GROUP BY ALL)""")
def ratio_zero_denominator(spark, folder):
    rows = L.table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum(F.col("l_tax").cast(L.MONEY)).alias("n"), F.count_if(F.col("l_linenumber") > 3).alias("d"))
    return rows.select("l_returnflag", "l_linenumber", B.ratio(F.col("n"), F.col("d")).alias("r")).select("l_returnflag", "l_linenumber", "r.*")


def _growth_sql(key: str, back: str, where: str) -> str:
    return f"""SELECT a.canonical, a.period, a.value, b.value AS base,
      CASE WHEN b.value > 0 THEN (a.value - b.value) / b.value * 100 END AS growth,
      CASE WHEN b.value > 0 THEN 'passed' ELSE 'na' END AS status,
      CASE WHEN b.value IS NULL THEN 'base is missing' WHEN b.value = 0 THEN 'base is zero' WHEN b.value < 0 THEN 'base is negative' END AS reason
    FROM {key} a LEFT JOIN {key} b ON a.canonical = b.canonical AND b.period = {back} WHERE {where}"""


_on_sales("growth_yoy", _growth_sql("L", "a.period - 1", "TRUE"), lambda d: M.growth(d, ["canonical"], "period", lambda p: p - 1))


@query(f"{_MONTHS} {_growth_sql('L', 'CASE WHEN a.period % 100 = 1 THEN a.period - 89 ELSE a.period - 1 END', 'TRUE')}")
def growth_mom(spark, folder):
    return M.growth(L.sales(spark, folder, True), ["canonical"], "period", M.previous_month)


@query(f"{_MONTHS} {_growth_sql('L', 'a.period - 100', 'TRUE')}")
def growth_same_month(spark, folder):
    return M.growth(L.sales(spark, folder, True), ["canonical"], "period", lambda p: p - 100)


# Market figures
_SHARE = f"""S AS (SELECT d.period, d.canonical, d.sheet, d.value, t.market_total, d.value / t.market_total * 100 AS share
  FROM L d JOIN (SELECT period, MAX(value) AS market_total FROM L WHERE aggregation_role = 'total' GROUP BY period) t ON d.period = t.period WHERE {_D.replace('aggregation_role', 'd.aggregation_role')})"""


def _shares(d: DataFrame) -> DataFrame:
    return M.market_share(d, ["period"], P).select("period", "canonical", "sheet", "value", "market_total", "share")


_on_sales("market_total", f"SELECT period, sheet, COALESCE(MAX(CASE WHEN aggregation_role = 'total' THEN value END), CAST(SUM(CASE WHEN {_D} THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE)) AS market_total FROM L GROUP BY period, sheet", lambda d: M.market_total(d, ["period", "sheet"], P))
_on_sales("market_share", f"@, {_SHARE} SELECT * FROM S", _shares)
_on_sales("market_share_sum", f"@, {_SHARE} SELECT period, round(SUM(share), 6) AS share_sum, 'passed' AS status FROM S GROUP BY period", lambda d: V.share_sums(_shares(d), ["period"]))
_on_sales(
    "market_share_change",
    f"@, {_SHARE} SELECT period, canonical, share, CASE WHEN lag(period) OVER w = period - 1 THEN round(round(share, 6) - round(lag(share) OVER w, 6), 6) END AS share_change FROM S WINDOW w AS (PARTITION BY canonical ORDER BY period)",
    lambda d: M.share_change(_shares(d), ["canonical"], places=6).select("period", "canonical", "share", F.round("share_change", 6).alias("share_change")),
)
_on_sales(
    "ranking_unique", f"SELECT period, canonical, value, row_number() OVER (PARTITION BY period ORDER BY value DESC, canonical) AS position FROM L WHERE {_D} QUALIFY position <= 10",
    lambda d: M.unique_ranking(d, ["period"], ["canonical"], 10).select("period", "canonical", "value", "position"),
)
_QUAD = """CASE WHEN q.growth IS NULL THEN NULL WHEN q.value >= x_cut AND q.growth >= y_cut THEN 'large_growing' WHEN q.value >= x_cut THEN 'large_slow' WHEN q.growth >= y_cut THEN 'small_growing' ELSE 'small_slow' END AS quadrant"""


def _scale_growth(d: DataFrame) -> DataFrame:
    g = M.growth(B.exclude_aggregates(d), ["canonical"], "period", lambda p: p - 1)
    return M.quadrants(g, "value", "growth", ["period"]).select("period", "canonical", "quadrant")


_on_sales(
    "scale_growth_quadrant",
    f"@, G AS ({_growth_sql('(SELECT * FROM L WHERE ' + _D + ')', 'a.period - 1', 'TRUE')}) SELECT q.period, canonical, {_QUAD} FROM G q JOIN (SELECT period, median(value) AS x_cut, median(growth) AS y_cut FROM G GROUP BY period) c ON q.period = c.period",
    _scale_growth,
)
_on_sales(
    "heatmap_minmax",
    f"SELECT period, canonical, CASE WHEN h = l THEN 0 ELSE (value - l) / (h - l) END AS scaled FROM (SELECT *, MIN(value) OVER (PARTITION BY period) AS l, MAX(value) OVER (PARTITION BY period) AS h FROM L WHERE {_D})",
    lambda d: M.minmax(B.exclude_aggregates(d), ["period"]).select("period", "canonical", "scaled"),
)
_on_sales(
    "top_fields_latest_period",
    f"SELECT file, period, canonical, value, row_number() OVER (ORDER BY value DESC, canonical) AS position FROM L WHERE {_D} AND period = (SELECT MAX(period) FROM L WHERE {_D}) QUALIFY position <= 5",
    lambda d: M.latest_top_fields(d, 5, P),
)
_on_sales(
    "trend_six_periods",
    f"""SELECT 'lineitem' AS file, k.canonical, CAST(p.period AS INTEGER) AS period, d.value FROM (SELECT DISTINCT canonical FROM L WHERE {_D}) k
    CROSS JOIN (SELECT (SELECT MAX(period) FROM L WHERE {_D}) - i AS period FROM range(6) t(i)) p LEFT JOIN L d ON d.canonical = k.canonical AND d.period = p.period""",
    lambda d: M.trend(B.exclude_aggregates(d), ["canonical"], 6).select("file", "canonical", F.col("period").cast("int").alias("period"), "value"),
)
_on_sales(
    "first_to_last_growth",
    f"SELECT canonical, first, last, (last - first) / first * 100 AS growth FROM (SELECT canonical, min_by(value, period) AS first, max_by(value, period) AS last FROM L WHERE {_D} GROUP BY canonical)",
    lambda d: M.first_to_last(B.exclude_aggregates(d), ["canonical"]),
)

# Joins
_J = "FROM L a {how} JOIN O b ON a.period IS NOT DISTINCT FROM b.period AND a.canonical IS NOT DISTINCT FROM b.canonical"


def _two(spark, folder, how: str) -> DataFrame:
    cols = ["period", "canonical", "value"]
    return B.join(L.sales(spark, folder).select(*cols), L.orders(spark, folder).select(*cols), ["period", "canonical"], how, ("_sales", "_orders"))


for _how in ("inner", "left", "outer"):
    QUERIES[f"join_{_how}"] = lambda spark, folder, how=_how: _two(spark, folder, how)
    SQL[f"join_{_how}"] = f"{_WITH} SELECT COALESCE(a.period, b.period) AS period, COALESCE(a.canonical, b.canonical) AS canonical, a.value AS value_sales, b.value AS value_orders {_J.format(how={'outer': 'FULL'}.get(_how, _how).upper())}"


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(spark, folder):
    urgent = L.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return L.table(spark, folder, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_anti(spark, folder):
    urgent = L.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return L.table(spark, folder, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


# Sets and reshaping
@query(f"{_WITH} SELECT * FROM L UNION ALL SELECT * FROM O")
def union_files(spark, folder):
    return L.sales(spark, folder).unionByName(L.orders(spark, folder))


@query(f"{_WITH} SELECT DISTINCT file, sheet, aggregation_role FROM (SELECT * FROM L UNION ALL SELECT * FROM O)")
def distinct_values(spark, folder):
    return union_files(spark, folder).select("file", "sheet", "aggregation_role").distinct()


@query("""SELECT l_returnflag, measure, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value, COUNT(*) AS n
FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_tax INTO NAME measure VALUE value) GROUP BY ALL""")
def unpivot_measures(spark, folder):
    rows = L.table(spark, folder, "lineitem").unpivot(["l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"], "measure", "value")
    return rows.groupBy("l_returnflag", "measure").agg(F.sum(F.col("value").cast(L.MONEY)).cast("double").alias("value"), F.count(F.lit(1)).alias("n"))


# Checks
@query(f"{_WITH} SELECT canonical, COUNT(DISTINCT file) AS n_files, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM (SELECT * FROM L UNION ALL SELECT * FROM O) GROUP BY canonical HAVING COUNT(DISTINCT file) > 1")
def cross_file_ambiguity(spark, folder):
    return V.cross_file_ambiguity(union_files(spark, folder))


@query(f"{_WITH} SELECT dimension, COUNT(DISTINCT file) AS n_files FROM (SELECT * FROM L UNION ALL SELECT * FROM O) GROUP BY dimension HAVING COUNT(DISTINCT file) > 1")
def dictionary_join_keys(spark, folder):
    return union_files(spark, folder).groupBy("dimension").agg(F.countDistinct("file").alias("n_files")).where("n_files > 1")


_on_sales(
    "component_reconciliation",
    f"""SELECT period, reported, computed, CASE WHEN abs(computed - reported) / abs(reported) > 0.005 THEN 'failed' ELSE 'passed' END AS status
    FROM (SELECT period, MAX(CASE WHEN aggregation_role = 'total' THEN value END) AS reported, CAST(SUM(CASE WHEN {_D} THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE) AS computed FROM L GROUP BY period)""",
    lambda d: V.component_check(d, ["period"], places=P),
)


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def duplicate_records(spark, folder):
    return V.duplicate_rows(L.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_custkey, CAST(m AS BIGINT) AS m, CAST(next AS BIGINT) AS next FROM (SELECT o_custkey, m, lead(m) OVER (PARTITION BY o_custkey ORDER BY m) AS next FROM (SELECT DISTINCT o_custkey, year(o_orderdate) * 100 + month(o_orderdate) AS m FROM orders))
WHERE next IS NOT NULL AND next <> CASE WHEN m % 100 = 12 THEN m + 89 ELSE m + 1 END""")
def period_gap(spark, folder):
    rows = L.table(spark, folder, "orders").select("o_custkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("m"))
    return V.period_gaps(rows, ["o_custkey"], "m", lambda m: F.when(m % 100 == 12, m + 89).otherwise(m + 1))


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value FROM customer) WHERE value IS NULL")
def missing_values(spark, folder):
    rows = L.table(spark, folder, "customer").withColumn("value", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return V.missing_values(rows, ["c_custkey"])


@query("SELECT c_custkey, c_acctbal AS value FROM customer WHERE c_acctbal < 0")
def negative_values(spark, folder):
    return V.negative_values(L.table(spark, folder, "customer").withColumnRenamed("c_acctbal", "value"), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'passed' END AS status FROM customer")
def sanity_status(spark, folder):
    return L.table(spark, folder, "customer").select("c_custkey", V.sanity(F.col("c_acctbal"), F.lit("元"), F.lit(False)).alias("status"))


@query("""SELECT l_returnflag, COUNT(*) AS n, MIN(l_quantity) AS low, MAX(l_quantity) AS high, median(l_quantity) AS median, bool_and(l_quantity = floor(l_quantity)) AS whole,
bool_and(abs(l_quantity) <= 100) AS percent_like, bool_or(l_quantity < 0) AS negative, CAST(floor(log10(median(abs(l_quantity)))) AS BIGINT) AS magnitude FROM lineitem GROUP BY l_returnflag""")
def numeric_profile(spark, folder):
    return V.numeric_profile(L.table(spark, folder, "lineitem").withColumnRenamed("l_quantity", "value"), ["l_returnflag"])


_on_sales("range_summary", "SELECT canonical, CAST(MIN(row) AS BIGINT) AS min_row, CAST(MAX(row) AS BIGINT) AS max_row, CAST(MIN(col) AS BIGINT) AS min_col, CAST(MAX(col) AS BIGINT) AS max_col FROM L GROUP BY canonical", lambda d: V.range_summary(d, ["canonical"]))
_on_sales(
    "a1_address",
    "SELECT canonical, period, CASE WHEN col <= 26 THEN chr(64 + col) ELSE chr(CAST(64 + (col - 1) // 26 AS INTEGER)) || chr(CAST(65 + (col - 1) % 26 AS INTEGER)) END || row AS cell FROM L",
    lambda d: d.select("canonical", "period", S.a1(F.col("row"), F.col("col")).alias("cell")),
)

# Scalar functions
_on_sales("year_parse", "SELECT canonical, period, CAST(period AS INTEGER) AS ad, CASE WHEN period >= 1912 THEN CAST(period AS INTEGER) END AS roc FROM L", lambda d: d.select("canonical", "period", S.year(F.concat(F.lit("112年"), F.col("period").cast("string"))).alias("ad"), S.year(F.concat((F.col("period") - 1911).cast("string"), F.lit("年"))).alias("roc")))


@query(f"{_MONTHS} SELECT canonical, period, CASE WHEN period + 2000 <= 210012 THEN CAST(period + 2000 AS INTEGER) END AS parsed, CASE WHEN period % 100 = 1 THEN period - 89 ELSE period - 1 END AS previous FROM L")
def roc_period_parse(spark, folder):
    d = L.sales(spark, folder, True)
    parsed = S.roc_month((F.col("period") + 2000 - 191100).cast("string"))  # ROC codes twenty years later, so that they have five digits
    return d.select("canonical", "period", parsed.cast("int").alias("parsed"), M.previous_month(F.col("period")).alias("previous"))


# Recipes
_SHARE_RECIPE = {
    "metric_id": "share_nation_13", "metric_name": "Share of nation 13", "unit": "%", "period": 1998, "is_share": True, "assumption_statement": "suppliers' nation",
    "steps": [
        {"id": "now", "block": "filter_by_period", "params": {"start": 1998, "end": 1998}},
        {"id": "one", "block": "filter", "input": "now", "params": {"column": "canonical", "operator": "==", "value": "revenue_NATION_13"}},
        {"id": "n", "block": "group_sum", "input": "one", "params": {"places": P}},
        {"id": "d", "block": "group_sum", "input": "now", "params": {"places": P}},
        {"id": "share", "block": "ratio", "params": {"numerator": {"$ref": "n"}, "denominator": {"$ref": "d"}}},
    ],
    "output": "share",
}


@query(f"{_WITH} SELECT 'share_nation_13' AS metric_id, SUM(CASE WHEN canonical = 'revenue_NATION_13' THEN value END) / CAST(SUM(CAST(value AS DECIMAL(28,4))) AS DOUBLE) * 100 AS value, '%' AS unit, 'passed' AS status, CAST(NULL AS VARCHAR) AS reason FROM L WHERE period = 1998 AND {_D}")
def recipe_share(spark, folder):
    return compile_recipe(Recipe.parse(_SHARE_RECIPE), L.sales(spark, folder)).select("metric_id", "value", "unit", "status", "reason")


def share_top_n(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: each year's three nations with the largest share of revenue."""
    shares = _shares(L.sales(spark, folder))
    return M.unique_ranking(shares.withColumn("aggregation_role", F.lit("detail")), ["period"], ["canonical"], 3).select("period", "canonical", "value", "share", "position")


query(f"{_WITH}, {_SHARE} SELECT period, canonical, value, share, row_number() OVER (PARTITION BY period ORDER BY value DESC, canonical) AS position FROM S QUALIFY position <= 3")(share_top_n)
