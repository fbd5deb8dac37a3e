"""Every branch of the scalar functions: columns that are given and what comes out, at the end of each row."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.operators import catalog as C
from tabulon.operators import review as R
from tabulon.operators import validate as V

CASES = {}


def cases(name, given, rows, f):
    CASES[name] = given, rows, f


# Scalar functions, each branch
cases("cell_coercion", "text string", [
    ("1,318,372", 1318372.0), ("(1,234)", -1234.0), ("(1.5)", -1.5), (" 42 ", 42.0), ("-3.25", -3.25), ("+7", 7.0), ("1e3", 1000.0), (".5", 0.5), ("", None), ("   ", None),
    ("n/a", None), ("12年", None), ("(abc)", None), ("1.2.3", None), ("NaN", None), ("1,2,3", 123.0), (None, None),
], S.number)
cases("year_cases", "text string, number double", [
    ("53年1964", None, 1964), ("66 年 1977", None, 1977), ("2017", None, 2017), ("民國106年", None, 2017), ("106年", None, 2017), ("112年2023 年", None, 2023), ("1964", 1964.0, 1964),
    ("2101", 2101.0, None), ("99999", 99999.0, None), ("year", None, None), ("", None, None), (None, None, None), ("總計", None, None), ("2023 p", None, None), ("民國 5 年", None, 1916),
], lambda t, n: S.year_of(t, n))
cases("period_code_cases", "text string, number double", [
    ("11401", None, 2025), ("202401", None, 2024), ("2024", None, 2024), ("11413", None, None), ("x", 11412.0, 2025), ("x", 11412.5, None), ("19912", None, 2110), ("1899", None, None),
    ("name", None, None), ("200013", None, None), (None, None, None),
], lambda t, n: S.period_code(t, n)["year"])
cases("unit_inference", "name string, context string, n long, whole boolean, small boolean, magnitude int", [
    ("成長率 Rate of increase(%)", "", 9, True, False, 5, "% 1.0"), ("日本", "歷年來臺旅客按國籍", 9, True, False, 5, "人次 0.95"), ("x", "y", 9, False, True, 1, "% 0.8"),
    ("x", "y", 9, True, False, 4, "整數計數 0.7"), ("x", "y", 9, True, False, 2, "未知 0.3"), ("x", "y", 0, None, None, 0, "未知 0.3"), ("total visitors", "", 9, True, False, 5, "人次 1.0"),
    ("Expenditure US$", "", 9, True, False, 5, "美元 1.0"), ("nights", "", 9, True, False, 5, "夜 1.0"), ("金額", "", 9, True, False, 5, "元 1.0"), ("corporate", "", 9, False, False, 1, "未知 0.3"),
    ("persons", "", 9, True, False, 5, "人次 1.0"), ("夜 share", "", 9, True, False, 5, "% 1.0"),
], lambda name, context, n, whole, small, magnitude: F.concat_ws(" ", *(
    C.inferred_unit(name, context, F.struct(n.alias("n"), whole.alias("whole"), small.alias("percent_like"), magnitude.alias("magnitude")))[k].cast("string") for k in ("unit", "reliability")
)))
cases("role_inference", "label string", [
    ("總計 Grand Total", "total"), ("小計 Sub-Total", "subtotal"), ("Asia sub total", "subtotal"), ("subtotal", "subtotal"), ("合計", "total"), ("Total", "total"), ("其他 Others", "residual"),
    ("其它", "residual"), ("未列明 Unstated", "residual"), ("other", "residual"), ("mother tongue", "detail"), ("日本 Japan", "detail"), ("", "detail"),
], S.role_of)
cases("chinese_part", "text string", [
    ("日本 Japan", "日本"), ("9歲及以下 9 years and Under", "9歲及以下 9"), ("成長率 Rate of increase(%)", "成長率"), ("Japan", "Japan"), ("  美國\n U.S.A. ", "美國"), ("", ""), ("亞洲地區", "亞洲地區"),
], S.chinese_part)
cases("measure_concept", "sheet string, file string", [
    ("表1-3-歷年來臺旅客按國籍分", "a.xlsx", "來臺旅客"), ("歷年來臺旅客-按國籍", "a.xlsx", "來臺旅客"), ("歷年觀光外匯收入", "a.xlsx", "觀光外匯收入"), ("", "表2-1.xlsx", "數值"), ("按月", "a", "按月"),
    ("", "", "數值"), ("Sheet1", "a", "Sheet1"),
], S.concept)
cases("confidence_cases", "reliability double, n long", [
    (1.0, 10, 0.9), (0.5, 10, 0.45), (1.0, 2, 0.55), (0.5, 2, 0.45), (1.0, 0, 0.2), (1.0, 3, 0.9),
], lambda r, n: C.confidence(r, n))
cases("display_format", "value double, unit string", [
    (12.066050672347986, "%", "12.07%"), (12.5, "percent", "12.50%"), (1318372.0, "人次", "1,318,372"), (999.994, "元", "999.99"), (-2500.0, "元", "-2,500"), (None, "元", "N/A"), (0.0, "x", "0.00"),
    (1000.0, "百分比", "1,000.00%"),
], S.display)
cases("legacy_display", "value double, unit string", [
    (250000000.0, "元", "2.50 億元"), (-123456.0, "張", "-12.3 萬張"), (999.0, "張", "999 張"), (12.345678, "%", "12.35%"), (None, "元", "N/A"), (10000.0, "張", "1.0 萬張"),
], S.legacy_display)
cases("unit_convert", "value double, unit string", [
    (2.0, "張", 2.0), (2.0, "萬張", 20000.0), (2.0, "元", 2.0), (2.0, "千元", 2000.0), (2.0, "百萬元", 2000000.0), (2.0, "億元", 200000000.0), (50.0, "%", 0.5), (2.0, "other", 2.0), (None, "元", None),
], S.to_base_unit)
cases("metric_issue_list", "value double, unit string, is_share boolean", [
    (150.0, "%", True, "share_out_of_range"), (-20.0, "%", False, ""), (-150.0, "%", False, "below_minus_100"), (-150.0, "%", True, "below_minus_100,share_out_of_range"), (None, "%", False, "missing"),
    (-5.0, "人次", False, "negative"), (-5.0, "x", False, ""), (7.0, "元", False, ""), (float("nan"), "%", True, "not_finite"), (float("inf"), "元", False, "not_finite"),
], lambda v, u, s: F.array_join(R.metric_issues(v, u, s, V.PERCENT, V.NON_NEGATIVE), ","))
cases("sanity_cases", "value double, unit string, is_share boolean", [
    (150.0, "%", True, "failed"), (-20.0, "%", False, "passed"), (-150.0, "%", False, "failed"), (None, "%", False, "na"), (-5.0, "人次", False, "failed"), (-5.0, "x", False, "passed"), (100.0, "%", True, "passed"),
], V.sanity)



@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    given, rows, f = CASES[name]
    names = [x.split()[0] for x in given.split(", ")]
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"i int, {given}")
    got = [r.out for r in df.select("i", f(*(F.col(x) for x in names)).alias("out")).orderBy("i").collect()]
    assert [x if x is None or isinstance(x, str) else pytest.approx(x) for x in (r[-1] for r in rows)] == got


def test_narrative_cases(spark):
    texts = [(1, "A 10% 高於 12%"), (2, "12% 高於 10%"), (3, "share of 10% higher than 10%."), (4, "30%低於20%, 5.5% 超過 6%"), (5, "no numbers"), (6, None), (7, "8% lower than 9%")]
    got = R.narrative_issues(spark.createDataFrame(texts, "id int, text string")).collect()
    assert sorted((r.id, r.first, r.word, r.second) for r in got) == [(1, 10, "高於", 12), (3, 10, "higher than", 10), (4, 5.5, "超過", 6), (4, 30, "低於", 20)]
