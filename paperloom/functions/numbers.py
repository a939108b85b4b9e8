"""Column functions over numbers: strict table numbers, tolerances, confidence, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that stand for no number, and currency marks.
PLACEHOLDERS = ["", "-", "–", "—", "n/a", "na", "nil", "--"]
CURRENCY = r"(?:rs\.?|inr|usd|eur|gbp|[$€£¥₹])"

# How digits may be written, with the mark between groups and the decimal mark.
FORMS = (
    (r"\d+", "", ""),
    (r"\d+\.\d+", "", "."),
    (r"\d+,\d{1,2}", "", ","),
    (r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", ",", "."),  # US
    (r"\d{1,3}(?:,\d{2})*,\d{3}(?:\.\d+)?", ",", "."),  # Indian
    (r"\d{1,3}(?:\.\d{3})+,\d+", ".", ","),  # European
    (r"\d{1,3}(?:\.\d{3}){2,}", ".", ""),
    (r"\d{1,3}(?: \d{3})+(?:\.\d+)?", " ", "."),
    (r"\d{1,3}(?: \d{3})+,\d{1,2}", " ", ","),
)

REVIEW, HIGH = 0.6, 0.85

#: Separates the parts of a cell that is taken apart; it isn't printed in any.
APART = "\u0001"


def table_number(raw: Column) -> Column:
    """Struct (value decimal(38,6), decimals, commas, percent) of a plain table number, else null.

    Takes the forms of ``FORMS``, currency marks, brackets or signs for negative numbers, footnote marks and a percent sign.
    """
    cell = F.trim(F.translate(raw, "\u00a0\u2212\u2013\u2014", " ---"))
    empty = raw.isNull() | F.lower(F.trim(F.replace(raw, F.lit("\u00a0"), F.lit(" ")))).isin(PLACEHOLDERS)
    # Bracket, sign, currency, sign, digits, and what follows them: one match takes a cell apart.
    digits = r"([0-9](?:[0-9.,\s]*[0-9.,])?)"
    whole = rf"(?i)^(\(\s*)?([+-]?)\s*({CURRENCY}?)\s*([+-]?)\s*{digits}\s*([-%]?)[*†‡§\s]*(\)?)$"
    parts = F.split(F.regexp_replace(cell, whole, APART.join(f"${k}" for k in range(1, 8))), APART)

    def number(p: Column) -> Column:
        opened, sign, currency, second, body, after, closed = (F.trim(F.get(p, F.lit(k))) for k in range(7))
        trailing = after == "-"
        # A bracket closes, and a minus sign behind the digits stands alone.
        fine = (F.size(p) == 7) & ((opened == "(") == (closed == ")")) & ~(trailing & (F.concat(sign, currency, second) != ""))
        value = F.coalesce(*[F.when(body.rlike(f"^(?:{form})$"), F.translate(body, decimal + group, "." if decimal else "")) for form, group, decimal in FORMS])
        negative = ((opened == "(") | trailing) != ((sign == "-") | (second == "-"))
        return F.struct(F.when(fine, value).alias("digits"), F.when(negative, -1).otherwise(1).alias("sign"), F.contains(body, F.lit(",")).alias("commas"), (after == "%").alias("percent"))

    def result(n: Column) -> Column:
        decimals = F.when(F.contains(n["digits"], F.lit(".")), F.length(F.substring_index(n["digits"], ".", -1))).otherwise(0)
        value = (n["digits"].try_cast("decimal(38,6)") * n["sign"]).cast("decimal(38,6)")
        return F.when(n["digits"].isNotNull(), F.struct(value.alias("value"), decimals.alias("decimals"), n["commas"].alias("commas"), n["percent"].alias("percent")))

    return F.when(~empty, bound(bound(parts, number), result))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chart_number(raw: Column) -> Column:
    """Axis numbers: currency and percent signs go, k, M and B scale."""
    s = F.regexp_replace(F.trim(raw), r"[$€£¥₹,%\s]", "")
    scale = F.when(s.rlike("(?i)k$"), 1e3).when(s.rlike("(?i)m$"), 1e6).when(s.rlike("(?i)b$"), 1e9).otherwise(1.0)
    return F.when(s.rlike(r"(?i)^[+-]?\d+(?:\.\d+)?[kmb]?$"), F.regexp_replace(s, "(?i)[kmb]$", "").cast("double") * scale)


def tolerance(unit: Column, terms: Column, total: Column) -> Column:
    """How far rounding of ``terms`` addends printed in steps of ``unit`` may move a total."""
    half = unit / 2
    return F.least(half * (terms + 1), F.greatest(half, F.abs(total) * F.lit("0.005").cast("decimal(10,3)")))


def confidence(signals: Column) -> Column:
    """0.6 mean + 0.4 minimum of the map's values, clamped to [0, 1]; 0.3 without any."""
    values = F.transform(F.map_values(signals), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, 0.3).otherwise(F.round(0.6 * mean + 0.4 * F.array_min(values), 3))


def confidence_level(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= REVIEW, "MEDIUM").otherwise("LOW")


def per_second(pages: Column, seconds: Column) -> Column:
    """Pages a second to three places; 0 where either is missing, not a number, or not positive."""
    fine = (pages > 0) & (seconds > 0) & ~F.isnan(seconds.cast("double"))
    return F.when(fine, F.round(pages / seconds, 3)).otherwise(F.lit(0.0))


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    """Common area of boxes (x0, y0, x1, y1)."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return wide * high
