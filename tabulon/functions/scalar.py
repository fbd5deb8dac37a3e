"""Column functions: periods, addresses, units, names and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords in order of match.
UNIT_WORDS = (
    ("%", ("%", "百分比", "比率", "佔比", "占比", "成長率", "增率", "rate", "ratio", "share")),
    ("美元", ("美元", "us$", "usd", "expenditure")),
    ("夜", ("夜", "night")),
    ("人次", ("人次", "人數", "旅客", "遊客", "visitor", "arrival", "departure", "persons", "person")),
    ("元", ("元", "金額", "amount")),
)
ROLE_WORDS = (
    ("total", ("總計", "grand total")),
    ("subtotal", ("小計", "sub-total", "sub total", "subtotal")),
    ("total", ("合計", "total")),
    ("residual", ("其他", "其它", "未列明", "others", "unstated", "other")),
)
PERCENT_UNITS = ("%", "percent", "百分比")
UNIT_FACTORS = (("張", 1.0), ("萬張", 1e4), ("元", 1.0), ("千元", 1e3), ("百萬元", 1e6), ("億元", 1e8), ("%", 0.01))


# Patterns of years and of table numbers in names.
AD_YEAR, ROC_YEAR = r"(1[89]\d\d|2[01]\d\d)\s*年?\s*$", r"^\s*(?:民國)?\s*(\d{1,3})\s*年\s*$"
TABLE_NUMBER, ALL_YEARS = r"^表?\s*\d+[-–]\d+[-–]?\s*", r"^歷年\s*"
FIRST_YEAR, LAST_YEAR, ROC = 1900, 2100, 1911


def year(text: Column) -> Column:
    """Year of a period cell: an AD year at the end, else a ROC year; null if it isn't surely one."""
    ad = F.regexp_extract(text, AD_YEAR, 1).try_cast("int")
    roc = F.regexp_extract(text, ROC_YEAR, 1).try_cast("int") + ROC
    return F.coalesce(ad, F.when(roc.between(FIRST_YEAR, LAST_YEAR), roc))


def year_of(text: Column, number: Column) -> Column:
    """Year of a cell: a number from 1900 to 2100, else what its text says; null if it isn't surely one."""
    whole = F.floor(number).try_cast("int")
    return F.when(number.isNotNull(), F.when(whole.between(FIRST_YEAR, LAST_YEAR), whole)).otherwise(year(text))


def period_code(text: Column, number: Column) -> Column:
    """Struct of year and month (yyyymm, null for a plain year) of a code: yyyymm, ROC yyymm or a year; null for anything else."""
    n = F.coalesce(F.when(number == F.floor(number), number).try_cast("int"), F.when(number.isNull() & F.trim(text).rlike(r"^\d{4,6}$"), F.trim(text)).try_cast("int"))
    month = F.when((n % 100).between(1, 12), F.when(n.between(10001, 19912), n + ROC * 100).when(n.between(190001, 210012), n))
    plain = F.when(n.between(FIRST_YEAR, LAST_YEAR), n)
    found = F.struct(F.coalesce(F.floor(month / 100).cast("int"), plain).alias("year"), month.alias("month"))
    return F.when(month.isNotNull() | plain.isNotNull(), found)


def chinese_part(text: Column) -> Column:
    """What stands before the first ASCII word of a bilingual header; all of it if nothing does."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.trim(F.element_at(F.split(clean, r"(?:^|\s)[A-Za-z]", 2), 1))
    return F.when(head != "", head).otherwise(clean)


def concept(sheet: Column, file: Column) -> Column:
    """What a sheet measures: its name (else the file's) without table number and 歷年, up to ``-`` or 按."""
    raw = F.coalesce(F.nullif(sheet, F.lit("")), file)
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\.xlsx", ""), TABLE_NUMBER, ""), ALL_YEARS, ""))
    dash, by = (F.trim(F.element_at(F.split(raw, x, 2), 1)) for x in ("-", "按"))
    head = F.when(raw.contains("-") & (dash != ""), dash).when(raw.contains("按") & (by != ""), by).otherwise(raw)
    return F.when(head == "", "數值").otherwise(head)


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity of two short texts from 0 to 100: twice their longest common subsequence over the sum of lengths.

    Rows of the dynamic programme are arrays folded over the characters of ``a``: meant for names, not for documents.
    """
    letters_ = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    zero = F.transform(F.concat(F.array(F.lit("")), letters_(b)), lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(letters_(b).alias("y"), F.slice(row, 1, F.length(b)).alias("diagonal"), F.slice(row, 2, F.length(b)).alias("up")), F.array(F.lit(0)),
            lambda out, z: F.concat(out, F.array(F.when(z["y"] == x, z["diagonal"] + 1).otherwise(F.greatest(z["up"], F.element_at(out, -1))))),
        )

    common = F.element_at(F.aggregate(letters_(a), zero, next_row), -1)
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 100.0).otherwise(200.0 * common / (F.length(a) + F.length(b)))

def roc_month(code: Column) -> Column:
    """yyyymm of a ROC yyymm or an AD yyyymm code; null for other text."""
    n = F.when(code.rlike(r"^\d{5,6}$"), code.try_cast("int"))
    month = n % 100
    ok = month.between(1, 12)
    return F.when(ok & n.between(10001, 19912), n + 191100).when(ok & n.between(190001, 210012), n)


def letters(col: Column) -> Column:
    """Spreadsheet letters of a column number up to 18278."""
    a = lambda x: F.char(x + 65)
    one, two = col - 1, F.floor((col - 1) / 26) - 1
    three = F.floor((col - 27) / 676) - 1
    last = a(F.pmod(one, F.lit(26)))
    return (
        F.when(col <= 26, last).when(col <= 702, F.concat(a(F.pmod(two, F.lit(26))), last))
        .otherwise(F.concat(a(F.pmod(three, F.lit(26))), a(F.pmod(two, F.lit(26))), last))
    )


def a1(row: Column, col: Column) -> Column:
    return F.concat(letters(col), row.cast("string"))


def by_words(text: Column, table, otherwise: str) -> Column:
    """First entry of the table of which a word is in the text; ASCII words match whole words (with a plural s), others anywhere."""
    low, out = F.lower(text), None
    for name, words in table:
        hit = F.lit(False)
        for w in words:
            hit |= low.rlike(rf"(?<![a-z]){w.replace('$', '[$]')}s?(?![a-z])") if w[0].isascii() and w != "%" else low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def unit_of(text: Column) -> Column:
    return by_words(text, UNIT_WORDS, "unknown")


def role_of(text: Column) -> Column:
    return by_words(text, ROLE_WORDS, "detail")


def to_base_unit(value: Column, unit: Column) -> Column:
    """Value times its unit's factor; unknown units count as 1."""
    factor = F.lit(1.0)
    for name, x in UNIT_FACTORS:
        factor = F.when(unit == name, F.lit(x)).otherwise(factor)
    return value * factor


def display(value: Column, unit: Column) -> Column:
    """Text of a value: percent with two places, thousands without, else two places; N/A if missing."""
    return (
        F.when(value.isNull() | F.isnan(value), "N/A").when(unit.isin(*PERCENT_UNITS), F.concat(F.format_number(value, 2), F.lit("%")))
        .when(F.abs(value) >= 1000, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    )


def fixed(value: Column, places: int) -> Column:
    """Text of a double with so many places and no commas, rounded by its exact binary value as ``format_number`` does; ``format_string`` rounds its shortest decimal form half up."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def legacy_display(value: Column, unit: Column) -> Column:
    """Text of a value in 億 from 1e8 and in 萬 from 1e4, percent with two places, N/A if missing."""
    size = F.abs(value)
    return (
        F.when(value.isNull() | F.isnan(value), "N/A").when(unit == "%", F.concat(fixed(value, 2), F.lit("%")))
        .when(size >= 1e8, F.concat(fixed(value / 1e8, 2), F.lit(" 億"), unit))
        .when(size >= 1e4, F.concat(fixed(value / 1e4, 1), F.lit(" 萬"), unit))
        .otherwise(F.concat(F.format_number(value, 0), F.lit(" "), unit))
    )


def number(text: Column) -> Column:
    """A cell as a number: thousands commas go, (1,234) is negative; null for blanks and other text."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$|,", "")
    inner = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    plain = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    return F.when(inner.rlike(plain), -inner.try_cast("double")).when(bare.rlike(plain), bare.try_cast("double"))


def fingerprint(names: Column) -> Column:
    """Sixteen hex digits over a sheet's header names."""
    return F.substring(F.sha2(F.array_join(names, "\x1f"), 256), 1, 16)
