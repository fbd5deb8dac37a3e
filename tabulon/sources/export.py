"""Results written and read back: JSON documents of metrics, charts and lineage, and a workbook of four sheets.

Result tables are (metric_id, metric_name, value, unit, period, status, note, assumption, blocks, sources, cells); charts
are (chart_id, chart_type, title, unit, categories, series of (name, metric_ids)). All documents take their numbers from the
same rounded column. A document is one row and a workbook's sheet has ROWS rows at most: results, not data.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import scalar as S
from tabulon.operators.charts import chart_points, chart_status

SOURCES = "array<struct<file:string,sheet:string,range:string>>"
METRICS = (
    "metric_id string, metric_name string, value double, unit string, period int, status string, note string, assumption string, "
    f"blocks array<string>, sources {SOURCES}, cells array<string>"
)
CHARTS = "chart_id string, chart_type string, title string, unit string, categories array<string>, series array<struct<name:string,metric_ids:array<string>>>"
#: Decimal places of every exported value.
PLACES = 10
ROWS = 1_048_575


def exported(value: Column) -> Column:
    """A value as all exports show it: rounded to PLACES, null if it isn't finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value, PLACES))


def ready(metrics: DataFrame) -> DataFrame:
    """Metrics with exported values and their display text."""
    return metrics.withColumn("value", exported(F.col("value"))).withColumn("display", S.display(F.col("value"), F.col("unit")))


def _ranges(sources: Column) -> Column:
    return F.array_join(F.transform(sources, lambda s: F.concat(s["sheet"], F.lit("!"), s["range"])), "; ")


def analysis_document(metrics: DataFrame, charts: DataFrame, prompt: str = "") -> DataFrame:
    """One row ``value``: JSON of summary, metrics and chart_data; points without a value are null, never 0."""
    rows = ready(metrics)
    told = rows.agg(
        F.struct(F.count(F.lit(1)).alias("metric_count"), *(F.count_if(F.col("status") == x).alias(x) for x in ("passed", "na", "failed", "needs_manual_review"))).alias("summary"),
        F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("metrics"),
    )
    points = chart_points(charts, rows)
    series = points.groupBy("chart_id", "series").agg(F.sort_array(F.collect_list(F.struct("position", "metric_id", "value"))).alias("p"))
    series = series.groupBy("chart_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("series").alias("name"), F.transform("p", lambda x: x["metric_id"]).alias("metric_ids"), F.transform("p", lambda x: x["value"]).alias("values")
    ))).alias("series"))
    drawn = charts.drop("series").join(series, "chart_id", "left").join(chart_status(points), "chart_id", "left")
    drawn = drawn.agg(F.sort_array(F.collect_list(F.struct(*drawn.columns))).alias("chart_data"))
    out = told.join(F.broadcast(drawn))  # one row each
    return out.select(F.to_json(F.struct(F.lit(prompt).alias("prompt"), "summary", "metrics", "chart_data"), {"ignoreNullFields": "false"}).alias("value"))


def lineage_document(metrics: DataFrame) -> DataFrame:
    """One row ``value``: JSON of records by metric id, with files, sheets and ranges; of a repeated id the first is kept."""
    rows = ready(metrics).dropDuplicates(["metric_id"])
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric_id", F.struct(*rows.columns).alias("r")))))
    out = rows.agg(F.count(F.lit(1)).alias("total_records"), entries.alias("records"))
    return out.select(F.to_json(F.struct("total_records", "records"), {"ignoreNullFields": "false"}).alias("value"))


def catalog_document(cards: DataFrame) -> DataFrame:
    """One row ``value``: JSON of the field cards of each file and sheet."""
    fields = [c for c in cards.columns if c not in ("file", "sheet", "profile")]
    sheets = cards.groupBy("file", "sheet").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("fields"))
    files = sheets.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("sheet", "fields"))).alias("sheets"))
    return files.agg(F.sort_array(F.collect_list(F.struct("file", "sheets"))).alias("files")).select(F.to_json(F.struct("files")).alias("value"))


def write_document(document: DataFrame, path: str) -> None:
    document.select("value").coalesce(1).write.mode("overwrite").text(path)


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of an analysis document."""
    return _parsed(spark, path, f"metrics array<struct<{_inner(METRICS)}>>").select(F.inline("metrics"))


def load_chart_series(spark: SparkSession, path: str) -> DataFrame:
    """(chart_id, name, metric_ids, values) of an analysis document."""
    d = _parsed(spark, path, "chart_data array<struct<chart_id:string,series:array<struct<name:string,metric_ids:array<string>,values:array<double>>>>>")
    return d.select(F.explode("chart_data").alias("c")).select("c.chart_id", F.explode("c.series").alias("s")).select("chart_id", "s.*")


def load_lineage(spark: SparkSession, path: str) -> DataFrame:
    """The records of a lineage document."""
    return _parsed(spark, path, f"records map<string,struct<{_inner(METRICS)}>>").select(F.explode("records").alias("id", "r")).select("r.*")


def _inner(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def workbook_sheets(metrics: DataFrame, charts: DataFrame) -> dict[str, DataFrame]:
    """The four sheets of a result workbook, from the values that the documents hold too."""
    rows = ready(metrics)
    points = chart_points(charts, rows).join(charts.select("chart_id", "title", "chart_type", "unit"), "chart_id")
    return {
        "Metrics": rows.select("metric_id", "metric_name", "value", "display", "unit", "period", "status", "note", "assumption", _ranges(F.col("sources")).alias("ranges")).orderBy("metric_id"),
        "ChartData": points.select("chart_id", "title", "chart_type", "series", "label", "metric_id", "value", "unit", F.coalesce("status", F.lit("missing")).alias("status")).orderBy("chart_id", "series", "position"),
        "Lineage": rows.select(
            "metric_id", F.array_join("blocks", " > ").alias("blocks"), _ranges(F.col("sources")).alias("ranges"), F.array_join(F.slice("cells", 1, 10), "; ").alias("cells"), "assumption", "status"
        ).orderBy("metric_id"),
        "NeedsReview": rows.where("status IN ('needs_manual_review', 'failed', 'na')").select("metric_id", "metric_name", "status", "note", _ranges(F.col("sources")).alias("ranges")).orderBy("metric_id"),
    }


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("".join(x for x in str(value) if x >= " " or x in chr(9) + chr(10)))}</t></is></c>'
    return f"<c><v>{value!r}</v></c>"


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """An XLSX archive of sheets (column names and rows)."""
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel, kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = lambda i: f"worksheets/sheet{i}.xml"
        overrides = "".join(f'<Override PartName="/xl/{part(i)}" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", (
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>'
        ))
        links = lambda items: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"
        z.writestr("_rels/.rels", links([(1, "officeDocument", "xl/workbook.xml")]))
        z.writestr("xl/_rels/workbook.xml.rels", links([(i, "worksheet", part(i)) for i in range(1, len(sheets) + 1)]))
        named = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{named}</sheets></workbook>')
        for i, (names, rows) in enumerate(sheets.values(), 1):
            lines = "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in (names, *rows))
            z.writestr(f"xl/{part(i)}", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Write tables as the sheets of one XLSX file; a sheet of more than ROWS rows raises an error."""
    held = {}
    for name, df in sheets.items():
        rows = df.limit(ROWS + 1).collect()
        if len(rows) > ROWS:
            raise ValueError(f"sheet {name!r} has more than {ROWS} rows")
        held[name] = df.columns, [tuple(r) for r in rows]
    spark = next(iter(sheets.values())).sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(workbook_bytes(held)))
    finally:
        out.close()
