"""Blocks, recipes, sheets, catalog, exports and reviews on small tables made here."""

import io
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.model import LONG, BlockError, ExecutionError
from tabulon.operators import blocks as B
from tabulon.operators import catalog as C
from tabulon.operators import charts as H
from tabulon.operators import metrics as M
from tabulon.operators import review as R
from tabulon.operators import structure as T
from tabulon.operators import validate as V
from tabulon.plans import planner
from tabulon.plans.recipe import Recipe, check_columns, check_fields, compile_all, compile_recipe, tool_schema
from tabulon.sources import export, legacy, sheets

NAN = float("nan")


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


@pytest.fixture(scope="module")
def long(spark):
    data = [
        (y, "c", d, v, "t.xlsx", "S1", 1, 1, role)
        for y, values in ((2023, (100.0, 200.0, 30.0, 330.0)), (2024, (150.0, 250.0, 40.0, 440.0)))
        for d, v, role in zip(("A", "B", "other", "subtotal"), values, ("detail", "detail", "residual", "subtotal"))
    ]
    return spark.createDataFrame(data, LONG)


@pytest.fixture(scope="module")
def dataset(spark):
    values = {"x_japan": (900.0, 1300.0, 2, "detail"), "x_korea": (600.0, 700.0, 3, "detail"), "x_total": (1500.0, 2000.0, 4, "total")}
    data = [(y, k, k, v[i], "f.xlsx", "S", 5 + i, v[2], v[3]) for k, v in values.items() for i, y in enumerate((2023, 2024))]
    return spark.createDataFrame(data, LONG)


# Blocks
def test_guarded_sums_keep_residuals(long):
    assert rows(B.group_sum(long), "period") == [(2023, 330.0), (2024, 440.0)]
    assert rows(B.group_sum(long, detail_only=False), "period") == [(2023, 660.0), (2024, 880.0)]
    assert sorted(B.pivot(long).columns) == ["A", "B", "other", "period"]
    assert B.exclude_aggregates(long.withColumn("aggregation_role", F.lit(None).cast("string"))).count() == 8
    assert B.exclude_aggregates(long.drop("aggregation_role")).count() == 8


def test_missing_values(spark):
    df = spark.createDataFrame([("g", 100.0), ("g", 200.0), ("g", NAN), ("h", None), (None, 5.0)], "period string, value double")
    assert rows(B.group_mean(df), "period") == [("g", 150.0), ("h", None)]
    assert rows(B.group_sum(df), "period") == [("g", 300.0), ("h", 0.0)] == rows(B.group_sum(df, places=4), "period")
    ratio = lambda n, d, p=True: tuple(spark.range(1).select(B.ratio(F.lit(n).cast("double"), F.lit(d).cast("double"), p).alias("r")).select("r.*").first())
    assert ratio(25.0, 100.0) == (25.0, "passed", None) and ratio(1.0, 4.0, False)[0] == 0.25
    assert [ratio(*x)[1] for x in ((25.0, 0.0), (None, 100.0), (NAN, 100.0), (1.0, NAN))] == ["na"] * 4
    growth = lambda c, p: tuple(spark.range(1).select(B.growth_rate(F.lit(c).cast("double"), F.lit(p).cast("double")).alias("r")).select("r.*").first())[:2]
    assert growth(120.0, 100.0) == (20.0, "passed") and growth(80.0, 100.0) == (-20.0, "passed")
    assert [growth(1.0, p) for p in (None, 0.0, -50.0, NAN)] == [(None, "na")] * 4


def test_filters_ranks_and_sums(spark, long):
    df = spark.createDataFrame([(2024, 10.0), (2023, 20.0), (2025, 30.0), (None, 5.0)], "period int, value double")
    assert rows(B.filter_by_period(df), "period") == [(2023, 20.0), (2024, 10.0), (2025, 30.0)]
    assert [r[2] for r in rows(B.cumulative_sum(df.where("period IS NOT NULL")), "period")] == [20.0, 30.0, 60.0]
    assert B.filter_rows(df, "period", "!=", 2023).count() == 2 and B.filter_rows(df, "value", "!=", 10.0).count() == 3
    assert B.filter_rows(df, "value", "in", 10.0).count() == 1 and B.filter_rows(df, "value", "<", 10.0).count() == 1
    ranked = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 50.0), ("d", None), ("e", NAN)], "k string, value double")
    assert rows(B.rank_top_n(ranked, ties=["k"])) == [("a", 100.0, 1), ("b", 100.0, 1), ("c", 50.0, 3)]
    joined = B.join(df.select("period", F.col("value").alias("a")), df.select("period", F.col("value").alias("b")), "period")
    assert joined.columns == ["period", "a", "b"] and joined.count() == 4
    for bad in (
        lambda: B.filter_rows(df, "none", "==", 1), lambda: B.filter_rows(df, "value", "like", 1), lambda: B.filter_by_period(df, 2025, 2024),
        lambda: B.rank_top_n(df, n=0), lambda: B.join(df, df, "period", "cross"), lambda: B.join(df, df, []), lambda: B.group_sum(df, "none"),
    ):
        with pytest.raises(BlockError):
            bad()
    assert issubclass(BlockError, ExecutionError)


def test_quadrants_and_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 5.0), ("a", 6.0, 2.0), ("a", None, 2.0)], "g string, x double, y double")
    assert [r.quadrant for r in M.quadrants(df, "x", "y", ["g"], "mean").orderBy("x").collect()] == [None, "small_slow", "small_growing", "large_slow"]
    assert sorted(r.scaled for r in M.minmax(df.where("x IS NOT NULL"), ["g"], "x").collect()) == [0.0, 0.2, 1.0]
    same = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "g string, value double")
    assert [r.scaled for r in M.minmax(same, ["g"]).collect()] == [0.0, 0.0]


def test_component_check_tolerance(spark):
    case = lambda whole, part: spark.createDataFrame([(1, whole, "total"), (1, part, "detail")], "p int, value double, aggregation_role string")
    found = [V.component_check(case(*x), ["p"]).first().status for x in ((7857686.0, 7857686.0), (7857686.0, 7717188.0), (1002.0, 1000.0), (None, 5.0), (0.0, 5.0))]
    assert found == ["passed", "failed", "passed", "na", "na"]


# Recipes
def recipe(steps, output, **more):
    return {"metric_id": "m", "metric_name": "M", "unit": "人次", "period": 2024, "assumption_statement": "a", "steps": steps, "output": output} | more


def step(id_, block, input_="dataset", **params):
    return {"id": id_, "block": block, "input": input_, "params": params}


NOW = step("now", "filter_by_period", start=2024, end=2024)


def test_recipe_values_shares_and_lineage(dataset):
    japan = step("japan", "filter", "now", column="canonical", operator="==", value="x_japan")
    value = compile_recipe(Recipe.parse(recipe([NOW, japan, step("n", "group_sum", "japan")], "n")), dataset).first()
    assert (value.value, value.status, value.issues, value.period) == (1300.0, "passed", [], 2024)
    assert [tuple(s) for s in value.sources] == [("f.xlsx", "S", "B6:B6")] and value.cells == ["S!B6"] and value.blocks == ["now:filter_by_period", "japan:filter", "n:group_sum"]
    share = recipe([NOW, japan, step("n", "group_sum", "japan"), step("d", "group_sum", "now"), {"id": "r", "block": "ratio", "params": {"numerator": {"$ref": "n"}, "denominator": {"$ref": "d"}}}], "r", unit="%", is_share=True)
    found = compile_recipe(Recipe.parse(share), dataset).first()
    assert (found.value, found.status) == (65.0, "passed")
    assert [s.range for s in found.sources] == ["B6:B6", "C6:C6"]  # numerator and denominator, without the total that the sum leaves out
    none = compile_recipe(Recipe.parse(recipe([step("no", "filter_by_period", start=1900, end=1901), step("n", "group_sum", "no")], "n")), dataset).first()
    assert (none.value, none.status, none.sources) == (None, "na", [])


def test_a_field_in_two_files_fails(spark):
    data = [(2024, "x", "d", v, f, "S", 5, 2, "detail") for f, v in (("by_nationality.xlsx", 1300.0), ("by_residence.xlsx", 1301.0))]
    df = spark.createDataFrame(data, LONG)
    both = compile_recipe(Recipe.parse(recipe([NOW, step("n", "group_sum", "now")], "n")), df).first()
    assert (both.value, both.status) == (2601.0, "failed") and "by_nationality.xlsx, by_residence.xlsx" in both.issues[0]
    one = compile_recipe(Recipe.parse(recipe([NOW, step("f", "filter", "now", column="file", operator="==", value="by_nationality.xlsx"), step("n", "group_sum", "f")], "n")), df).first()
    assert (one.value, one.status) == (1300.0, "passed")


def test_recipes_that_are_refused(dataset):
    good = recipe([NOW, step("n", "group_sum", "now")], "n")
    for bad in (
        {k: v for k, v in good.items() if k != "unit"}, recipe([step("a", "eval")], "a"), recipe([NOW], "gone"), recipe([step("a", "group_sum", "later")], "a"),
        recipe([{"id": "r", "block": "ratio", "params": {"numerator": {"$ref": "x"}}}], "r"),
    ):
        with pytest.raises(ExecutionError):
            Recipe.parse(bad)
    unknown = recipe([step("f", "filter", column="canonical", operator="in", value=["x_japan", "none"]), step("n", "group_sum", "f")], "n")
    with pytest.raises(ExecutionError):
        check_fields(Recipe.parse(unknown), {"x_japan"})
    with pytest.raises(ExecutionError):
        check_columns(Recipe.parse(recipe([step("f", "filter", column="value", operator=">", value=1)], "f")))
    check_columns(Recipe.parse(unknown))
    many = recipe([step("n", "group_sum"), {"id": "r", "block": "ratio", "params": {"numerator": {"$ref": "n"}, "denominator": 5}}], "r")
    with pytest.raises(PySparkException):
        compile_recipe(Recipe.parse(many), dataset).collect()
    made, refused = compile_all([good, unknown, recipe([step("f", "filter", column="none", operator="==", value=1)], "f", metric_id="bad")], dataset, {"x_japan"})
    assert made.count() == 1 and [r[0] for r in refused] == ["m", "bad"]
    assert "ratio" in tool_schema()["properties"]["steps"]["items"]["properties"]["block"]["enum"]


def test_sanity_and_issues(spark):
    data = [(150.0, "%", True), (-20.0, "%", False), (-150.0, "%", False), (NAN, "%", False), (float("inf"), "元", False), (-5.0, "人次", False), (None, "元", False)]
    df = spark.createDataFrame(data, "v double, u string, s boolean")
    got = df.select(V.sanity(F.col("v"), F.col("u"), F.col("s")).alias("x"), F.size(R.metric_issues(F.col("v"), F.col("u"), F.col("s"), V.PERCENT, V.NON_NEGATIVE)).alias("n")).collect()
    assert [r.x for r in got] == ["failed", "passed", "failed", "failed", "failed", "failed", "na"] and [r.n for r in got] == [1, 0, 1, 1, 1, 1, 1]


def test_scalars(spark):
    df = spark.createDataFrame([(1, 1, "A1"), (9, 26, "Z9"), (2, 27, "AA2"), (1, 702, "ZZ1"), (3, 703, "AAA3"), (1, 18278, "ZZZ1")], "r int, c int, a string")
    assert df.where(S.a1(F.col("r"), F.col("c")) != F.col("a")).count() == 0
    assert spark.range(1).select(S.fingerprint(F.array(F.lit("a"), F.lit("b"))).alias("f")).first().f == __import__("hashlib").sha256(b"a\x1fb").hexdigest()[:16]

    def ratio(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return 200 * best[-1][-1] / (len(a) + len(b)) if a or b else 100.0

    pairs = [("來臺旅客_日本", "來臺旅客_日本"), ("abcd", "abxd"), ("", "a"), ("", ""), ("停留夜數1", "停留夜數2"), ("kitten", "sitting")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.x for r in df.select(S.indel_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == pytest.approx([ratio(*p) for p in pairs])


# Sheets
CSV = "歷年來臺旅客,,,\r\nyear,日本 Japan,韓國 Korea,總計 Total\r\n112年2023,\"900,000\",600,1500\r\n113年2024,1318372,\"(700)\",2000\r\n114年2025,1400000,,3000\r\n資料來源,,,\r\n"


def xlsx(grid, merges=(), name="S"):
    """A workbook of one sheet with shared strings, numbers, truth values and merged ranges."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = [v for line in grid for v in line if isinstance(v, str)]
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{strings.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{ref}" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c r="{ref}"><v>{v}</v></c>'
    lines = "".join(f'<row r="{r}">' + "".join(cell(f"{chr(64 + c)}{r}", v) for c, v in enumerate(line, 1) if v is not None) + "</row>" for r, line in enumerate(grid, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        merged = "<mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in merges) + "</mergeCells>" if merges else ""
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{lines}</sheetData>{merged}</worksheet>")
    return out.getvalue()


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sheets")
    (d / "表1-1-utf.csv").write_bytes(b"\xef\xbb\xbf" + CSV.encode())
    (d / "表1-2-cp950.csv").write_bytes(CSV.encode("cp950"))
    head = [["歷年旅客", None, None, None], ["year", "亞洲 Asia", None, "總計 Total"], [None, "日本 Japan", "韓國 Korea", None]]
    body = [["112年2023", 900, 600, 1500], ["113年2024", 1318372, -700, 2000], ["114年2025", 5, 7, 3000], ["note", True, None, None]]
    (d / "visitors.xlsx").write_bytes(xlsx(head + body, ["A1:D1", "B2:C2"], "歷年旅客按國籍"))
    bank = [["bank", "11401", "11402", "11403", "share"], ["甲", 1, 2, 3, 0.5], ["乙", 4, -5, 6, 0.25], ["總計", 5, -3, 9, 1.5]]
    (d / "cards.xlsx").write_bytes(xlsx(bank, (), "流通卡數"))
    (d / "words.csv").write_text("only,words\nhere,too\n")
    (d / "broken.xlsx").write_bytes(b"no archive")
    for name in ("old.xls", "sheet.ods", "~$visitors.xlsx", "notes.md"):
        (d / name).write_bytes(b"x")
    out = sheets.read_grid(spark, f"file://{d}").cache()
    out.count()
    return out


def test_cells_of_all_formats(spark, grid, tmp_path):
    warned = {r.file: r.warning for r in sheets.warnings_of(grid).collect()}
    assert sorted(warned) == ["broken.xlsx", "old.xls", "sheet.ods"] and "BadZipFile" in warned["broken.xlsx"]
    cells = {(r.file, r.row, r.col): (r.text, r.number) for r in sheets.cells_of(grid).collect()}
    assert cells["表1-1-utf.csv", 4, 2] == cells["表1-2-cp950.csv", 4, 2] == ("1318372", 1318372.0)
    assert cells["表1-1-utf.csv", 3, 2][1] == 900000.0 and cells["表1-1-utf.csv", 4, 3][1] == -700.0 and ("表1-1-utf.csv", 5, 3) not in cells
    assert cells["visitors.xlsx", 1, 4][0] == "歷年旅客" and cells["visitors.xlsx", 2, 3][0] == "亞洲 Asia" and cells["visitors.xlsx", 7, 2] == ("TRUE", None)
    (tmp_path / "x.md").write_text("x")
    with pytest.raises(FileNotFoundError):
        sheets.read_grid(spark, f"file://{tmp_path}")


def test_structure_and_long_tables(grid):
    cells = sheets.cells_of(grid)
    found = {r.file: (r.title_rows, r.header_rows, r.data_start, r.data_end, r.width) for r in T.sheet_structure(cells).collect()}
    assert found["表1-1-utf.csv"] == ([1], [2], 3, 5, 4) and found["visitors.xlsx"] == ([1], [2, 3], 4, 6, 4) and found["cards.xlsx"] == ([], [1], 2, 4, 5)
    assert [r.file for r in T.unparsable_sheets(cells).collect()] == ["words.csv"]
    cols = {(r.file, r.col): r for r in T.columns(cells).collect()}
    assert cols["visitors.xlsx", 2].name == "亞洲 Asia > 日本 Japan" and [cols["visitors.xlsx", c].kind for c in (1, 2, 3, 4)] == ["period", "measure", "measure", "measure"]
    assert cols["cards.xlsx", 5].ratio_like and cols["cards.xlsx", 1].kind == "label" and cols["cards.xlsx", 2].transposed
    long = {(r.file, r.row, r.col): r for r in T.long_table(cells).collect()}
    x = long["visitors.xlsx", 5, 2]
    assert (x.period, x.canonical, x.dimension, x.value, x.aggregation_role, x.anomaly) == (2024, "旅客_亞洲_日本", "亞洲 Asia > 日本 Japan", 1318372.0, "detail", False)
    assert long["visitors.xlsx", 5, 3].anomaly and long["visitors.xlsx", 4, 4].aggregation_role == "total" and ("visitors.xlsx", 7, 2) not in long
    y = long["cards.xlsx", 3, 3]
    assert (y.period, y.month, y.canonical, y.dimension, y.value, y.anomaly) == (2025, 202502, "流通卡數_乙", "乙", -5.0, True) and ("cards.xlsx", 3, 5) not in long
    assert long["cards.xlsx", 4, 2].aggregation_role == "total"
    found = {r.dimension: (r.n, r.cells) for r in T.anomaly_summary(T.long_table(cells).where("file = 'visitors.xlsx'")).collect()}
    assert found == {"亞洲 Asia > 韓國 Korea": (1, "C5")}


def test_lone_title_becomes_the_header(spark):
    data = [("f", "s", 1, 1, "only title", None), ("f", "s", 2, 1, "2020", 2020.0), ("f", "s", 2, 2, "5", 5.0), ("f", "s", 4, 1, "2021", 2021.0), ("f", "s", 4, 2, "6.5", 6.5)]
    cells = spark.createDataFrame(data, "file string, sheet string, row int, col int, text string, number double")
    r = T.sheet_structure(cells).first()
    assert (r.title_rows, r.header_rows, r.data_start, r.data_end) == ([], [1], 2, 4)
    assert T.sheet_structure(cells.limit(0)).count() == 0 and T.long_table(cells.limit(0)).count() == 0


def test_catalog_and_plan_of_files(grid):
    long = T.long_table(sheets.cells_of(grid)).cache()
    cards = C.field_cards(long).cache()
    got = {(r.file, r.dimension): r for r in cards.collect()}
    x = got["visitors.xlsx", "亞洲 Asia > 日本 Japan"]
    assert (x.unit, round(x.confidence, 3), x.decision, x.cell_range, x.samples) == ("人次", 0.855, "auto", "B4:B6", [900.0, 1318372.0, 5.0])
    assert got["visitors.xlsx", "亞洲 Asia > 韓國 Korea"].notes == ["negative values"] and got["表1-1-utf.csv", "韓國 Korea"].decision == "review" and "too few values" in got["表1-1-utf.csv", "韓國 Korea"].notes
    assert "aggregate: total" in got["visitors.xlsx", "總計 Total"].notes
    review = C.review_list(cards, T.anomaly_summary(long), T.unparsable_sheets(sheets.cells_of(grid)), sheets.warnings_of(grid)).collect()
    assert {"broken.xlsx", "words.csv", "visitors.xlsx"} <= {r.file for r in review}
    plan = {r.metric_id: r for r in planner.rule_plan(long, cards).collect()}
    share = plan["visitors_旅客_亞洲_日本_share_2025"]
    assert share.value == pytest.approx(5 / 3000 * 100) and share.unit == "%" and plan["表1-1_utf_日本_2025"].value == 1400000.0
    assert plan["visitors_旅客_亞洲_日本_yoy_2025"].status == "passed" and not any("總計_share" in k for k in plan)
    points = [r.value for r in planner.trend_points(long.where("file = 'visitors.xlsx'")).orderBy("period").collect()]
    assert points == [None, None, None, 600.0, -700.0, 7.0]  # Korea has the larger value of 2025


def test_fuzzy_pairs_equal_brute_force(spark):
    names = ["來臺旅客_亞洲地區_日本", "來臺旅客_亞洲地區日本", "來臺旅客_亞洲地區_韓國", "停留夜數1", "停留夜數2", "x", "x"]
    data = [("f", f"s{i}", n, n, "detail", float(100 + k), k, 1) for i, n in enumerate(names) for k in range(4)]
    cards = C.field_cards(spark.createDataFrame(data, "file string, sheet string, canonical string, dimension string, aggregation_role string, value double, row int, col int"))
    got = {(r.a, r.b) for r in C.fuzzy_pairs(cards).collect()}
    assert got == {(names[0], names[1]), ("x", "x")}
    far = spark.createDataFrame([*data[:4], *[(*x[:5], 0.5 + x[6] / 10, *x[6:]) for x in data[4:8]]], "file string, sheet string, canonical string, dimension string, aggregation_role string, value double, row int, col int")
    assert C.fuzzy_pairs(C.field_cards(far)).count() == 0


# Charts, exports and reviews
@pytest.fixture(scope="module")
def results(spark):
    sources = [("f.xlsx", "S", "B2:B4")]
    data = [
        ("share", "Share", 12.066050672347986, "%", 2024, "passed", None, "a", ["n:ratio"], sources, ["S!B2"]), ("value", "Value", 1318372.0, "人次", 2024, "passed", None, "a", ["n:group_sum"], sources, []),
        ("gap", "Gap", None, "%", 2024, "na", "base is missing", "a", [], [], []),
    ]
    metrics = spark.createDataFrame(data, export.METRICS)
    charts = spark.createDataFrame([("c", "line", "T", "%", ["2022", "2023", "2024"], [("s", ["share", "value", "gap"])])], export.CHARTS)
    return metrics, charts


def test_exports_hold_the_same_values(spark, results, tmp_path):
    metrics, charts = results
    export.write_document(export.analysis_document(metrics, charts, "p"), f"file://{tmp_path}/a")
    export.write_document(export.lineage_document(metrics), f"file://{tmp_path}/l")
    export.write_workbook(export.workbook_sheets(metrics, charts), f"file://{tmp_path}/r.xlsx")
    want = {"share": 12.0660506723, "value": 1318372.0, "gap": None}
    for loaded in (export.load_metrics(spark, f"file://{tmp_path}/a"), export.load_lineage(spark, f"file://{tmp_path}/l")):
        assert {r.metric_id: r.value for r in loaded.collect()} == want
    series = export.load_chart_series(spark, f"file://{tmp_path}/a").first()
    assert series.metric_ids == ["share", "value", "gap"] and series["values"] == [12.0660506723, 1318372.0, None]
    assert H.chart_status(H.chart_points(charts, metrics)).first().status == "na"
    document = json.loads(export.analysis_document(metrics, charts).first().value)
    assert document["summary"]["metric_count"] == 3 and document["chart_data"][0]["status"] == "na" and document["metrics"][0]["value"] is None
    cells = {(r.sheet, r.row, r.col): r for r in sheets.cells_of(sheets.read_grid(spark, f"file://{tmp_path}/r.xlsx")).collect()}
    assert sorted({k[0] for k in cells}) == ["ChartData", "Lineage", "Metrics", "NeedsReview"]
    assert [cells.get(("Metrics", r, 3)) and cells["Metrics", r, 3].number for r in (2, 3, 4)] == [None, 12.0660506723, 1318372.0]
    assert cells["Metrics", 3, 4].text == "12.07%" and cells["NeedsReview", 2, 1].text == "gap"
    cards = spark.createDataFrame([("f", "s", "x", 0.9)], "file string, sheet string, canonical string, confidence double")
    assert json.loads(export.catalog_document(cards).first().value)["files"][0]["sheets"][0]["fields"] == [{"canonical": "x", "confidence": 0.9}]


def test_reviews_of_results(spark, results):
    metrics, charts = results
    twice = metrics.unionByName(metrics.where("metric_id = 'value'").withColumn("value", F.lit(5.0)))
    assert [(r.metric_id, r.n, r.n_values, r["values"]) for r in R.duplicate_metric_ids(twice).collect()] == [("value", 2, 2, [5.0, 1318372.0])]
    other = spark.createDataFrame([("d", ["a"], [("s", ["share", "none"])])], "chart_id string, categories array<string>, series array<struct<name:string,metric_ids:array<string>>>")
    assert rows(R.missing_metric_refs(other, metrics)) == [("d", "s", "none")] and rows(R.axis_mismatches(other)) == [("d", "s", 2, 1)]
    assert R.missing_metric_refs(charts, metrics).count() == 0 == R.axis_mismatches(charts).count()
    assert [(r.chart_id, r.status) for r in H.chart_status(H.chart_points(other, metrics)).collect()] == [("d", "na")]


def test_legacy_records(spark):
    assert legacy.preferred_sheets(["P.5_流通卡數", "P.7_流通卡數", "P.5_有效卡數"]) == ["P.7_流通卡數", "P.5_有效卡數"]
    wide = spark.createDataFrame([("甲", "1", None, 0.25), ("總計", "2", "x", 1.0), (None, "3", "4", 0.1), (" ", "3", "4", 0.1)], "`金融機構名稱` string, `11401` string, `11402` string, `市佔率` double")
    got = {(r.institution, r.period, r.metric): (r.value, r.unit) for r in legacy.standardise(wide, "f", "P.7_流通卡數").collect()}
    assert got == {
        ("甲", "11401", "流通卡數"): (1.0, "張"), ("甲", "11402", "流通卡數"): (None, "張"), ("總計", "11401", "流通卡數"): (2.0, "張"), ("總計", "11402", "流通卡數"): (None, "張"),
        ("甲", "11402", "流通卡數_市佔率"): (25.0, "%"),
    }
