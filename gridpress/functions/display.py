"""Display text in the es-AR convention, one expression per column."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import functions as F

from gridpress.functions.numbers import number_text
from gridpress.model import Column

# Marker of an absent value, words, units and cut length.
EMPTY = "—"
YES, NO = "Sí", "No"
DEFAULT_SCALE = 2
PERCENT_SCALE = 4
JSON_CUT = 120


def _or_empty(value: C, text: C) -> C:
    return F.coalesce(F.when(value.isNotNull(), text), F.lit(EMPTY))


def _finite(value: C) -> C:
    """Null for NaN and infinities, which have no display text."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _grouped(value: C, scale: int) -> C:
    """Thousands points, decimal comma, rounded half up on the decimal digits."""
    exact = number_text(value).try_cast(f"decimal(38,{max(scale, 17)})")
    rounded = F.round(exact, scale)
    small = F.translate(F.format_number(rounded, scale), ",.", ".,")
    # Beyond 21 integer digits a decimal(38,17) overflows; format the double.
    large = F.translate(F.format_number(value, scale), ",.", ".,")
    return F.coalesce(small, large)


def number_display(value: C, decimal_scale: int | None = None, percent: bool = False) -> C:
    """Number text at a column's scale; percent columns show the fraction x 100."""
    v = _finite(value)
    if percent or decimal_scale == PERCENT_SCALE:
        exact = number_text(v * 100).try_cast("decimal(38,17)")
        shown = F.translate(F.format_number(F.round(exact, 2), 2), ",.", ".,")
        # Up to two decimals: drop the trailing zeros, then a bare comma.
        trimmed = F.regexp_replace(shown, ",?0+$", "")
        whole = F.regexp_replace(shown, ",00$", "")
        text = F.when(shown.endswith(",00"), whole).otherwise(trimmed)
        return _or_empty(v, F.concat(text, F.lit(" %")))
    return _or_empty(v, _grouped(v, DEFAULT_SCALE if decimal_scale is None else decimal_scale))


def count_display(value: C) -> C:
    return number_display(value, 0)


def day_display(value: C) -> C:
    """``dd/MM/yyyy`` of a day column, with no zone shift."""
    return _or_empty(value, F.date_format(value, "dd/MM/yyyy"))


def datetime_display(value: C) -> C:
    return _or_empty(value, F.date_format(value, "dd/MM/yyyy, HH:mm"))


def boolean_display(value: C) -> C:
    return _or_empty(value, F.when(value, F.lit(YES)).otherwise(F.lit(NO)))


def json_display(value: C, max_length: int = JSON_CUT) -> C:
    cut = F.concat(F.substring(value, 1, max_length - 1), F.lit("…"))
    text = F.when(F.length(value) <= max_length, value).otherwise(cut)
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(EMPTY)).otherwise(text)


def text_display(value: C) -> C:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(EMPTY)).otherwise(value)


def _one_decimal(value: C) -> C:
    """One decimal with a comma and no thousands mark, ties half up."""
    exact = number_text(value).try_cast("decimal(38,17)")
    return F.translate(F.round(exact, 1).cast("decimal(38,1)").cast("string"), ".", ",")


def _seconds_text(ms: C) -> C:
    """Seconds with one decimal, rounding the binary quotient as it is stored.

    A count such as 1450 ms is a decimal tie, but the double nearest to 1.45
    lies on one side of it. The quotient is split in two short halves, whose
    products are exact, to tell which.
    """
    quotient = ms / 1000
    fraction = quotient - F.floor(quotient)
    high = F.floor(fraction * 2.0**26) / 2.0**26
    below = ((ms % 1000) - high * 1000) - (fraction - high) * 1000 > 0
    tie = ms % 100 == 50
    tenths = F.when(tie & below, F.floor(ms / 100)).otherwise(F.floor((ms + 50) / 100))
    whole = F.floor(tenths / 10).cast("string")
    return F.concat(whole, F.lit(","), (tenths % 10).cast("string"))


def bytes_display(value: C) -> C:
    """``B``, ``kB``, ``MB`` or ``GB`` with one decimal from kB up."""
    v = _finite(value)
    units = ((1024.0, "kB"), (1024.0**2, "MB"), (1024.0**3, "GB"))
    text = F.when(v < 1024, F.concat(number_text(v), F.lit(" B")))
    for divisor, unit in units[:-1]:
        text = text.when(v / divisor < 1024, F.concat(_one_decimal(v / divisor), F.lit(f" {unit}")))
    divisor, unit = units[-1]
    return _or_empty(v, text.otherwise(F.concat(_one_decimal(v / divisor), F.lit(f" {unit}"))))


def duration_display(milliseconds: C) -> C:
    v = _finite(milliseconds)
    nearest = lambda x: F.floor(x + 0.5).cast("string")
    minutes = F.floor(v / 60_000).cast("string")
    seconds = nearest((v % 60_000) / 1000)
    return _or_empty(
        v,
        F.when(v < 1000, F.concat(nearest(v), F.lit(" ms")))
        .when(v < 60_000, F.concat(_seconds_text(v), F.lit(" s")))
        .otherwise(F.concat(minutes, F.lit(" min "), seconds, F.lit(" s"))),
    )


def cell_display(column: Column, value: C) -> C:
    """Display text of one column according to its type."""
    if column.type == "number":
        return number_display(value, column.decimal_scale, column.percent)
    if column.type == "date":
        return day_display(value)
    if column.type == "boolean":
        return boolean_display(value)
    if column.type == "json":
        return json_display(value)
    return text_display(value)


def render(df, columns: list[Column], projection: list[str] | None = None):
    """Visible columns in schema order, headed by their labels, as text."""
    shown = [c for c in columns if projection is None or c.key in projection]
    return df.select([cell_display(c, F.col(c.key)).alias(c.label or c.key) for c in shown])
