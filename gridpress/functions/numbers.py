"""Number text: locale-aware parsing, plain decimal text, decimal places.

An amount is read by one regular expression that rewrites a recognised text
as ``sign, integer part, MARK, fraction, tail``. A text it does not know is
left as it is, so the presence of the mark tells the two apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpress.functions.text import SPACE_RUN

# Currency signs that may lead an amount.
CURRENCY = "[$€£¥]"

MARK = "\u0001"

# How digits and separators read, in this order: plain digits; three or more
# groups of thousands; groups of thousands with a one or two digit fraction;
# a comma before three digits (thousands); a comma before one or two digits
# (fraction); a point, unless exactly three digits follow other digits.
_BODY = (
    r"(?:([0-9]+)"
    r"|([0-9]{1,3}(?:[.,][0-9]{3}){2,})"
    r"|([0-9]{1,3}(?:[.,][0-9]{3})+)[.,]([0-9]{1,2})"
    r"|([0-9]+,[0-9]{3})"
    r"|([0-9]*),([0-9]{1,2})"
    r"|(?![0-9]+\.[0-9]{3}(?:[^0-9]|$))([0-9]*)\.([0-9]*))"
)
_NO_STRAY_PARENTHESIS = rf"(?=[^()]*$|{CURRENCY}? ?\([^()]*\)%?$)"
_WIDE = rf"^{_NO_STRAY_PARENTHESIS}(?:{CURRENCY} ?)?([-+(])? ?{_BODY}\)?(%?)$"
_STRICT = rf"^()?{_BODY}(%?)$"
_REWRITTEN = f"$1$2$3$4$6$7$9{MARK}$5$8$10$11"

# Texts that look like an amount; unread ones among them are ambiguous.
_WIDE_SHAPE = rf"^(?:{CURRENCY} ?)?(?:\([0-9.,]+\)|[-+]? ?[0-9.,]+)%?$"
_STRICT_SHAPE = "^[0-9.,]+%?$"


def marked_amount(text: Column, strict_gate: bool = False) -> Column:
    """Rewrite an amount with its decimal place marked; other text unchanged."""
    return F.regexp_replace(text, _STRICT if strict_gate else _WIDE, _REWRITTEN)


def amount_value(marked: Column) -> Column:
    """Double of a marked amount, or null. A trailing percent sign divides by 100."""
    digits = F.when(marked.contains(MARK), F.translate(marked, MARK + ".,()-+%", "."))
    size = digits.try_cast("double")
    finite = F.when(size < F.lit(float("inf")), size)
    scaled = F.when(marked.endswith("%"), finite / 100).otherwise(finite)
    return F.when(marked.rlike("^[-(]"), F.lit(0.0) - scaled).otherwise(scaled)


def amount_ambiguous(text: Column, marked: Column, strict_gate: bool = False) -> Column:
    """True for an amount-like text that admits two readings, or none."""
    shape = _STRICT_SHAPE if strict_gate else _WIDE_SHAPE
    return F.coalesce(~marked.contains(MARK) & text.rlike(shape), F.lit(False))


def parse_number(text: Column) -> Column:
    """``struct(value double, ambiguous boolean)`` of a bare amount text.

    White space is dropped wherever it stands; a percent sign is not read.
    """
    bare = F.regexp_replace(text, SPACE_RUN, "")
    plain = F.when(~bare.endswith("%"), bare)
    marked = marked_amount(plain)
    return F.struct(
        amount_value(marked).alias("value"), amount_ambiguous(plain, marked).alias("ambiguous")
    )


def number_text(c: Column) -> Column:
    """Shortest plain decimal text: ``100`` rather than ``100.0`` or ``1.0E2``."""
    v = c.cast("double")
    size = F.abs(v)
    return (
        F.when((v == F.floor(v)) & (size < 1e15), v.try_cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), v.cast("string"))
        .otherwise(F.call_function("format_number", v, F.lit("0.#################")))
    )


def decimal_places(c: Column) -> Column:
    """Digits after the point in the shortest text of a number."""
    places = F.length(F.substring_index(number_text(c), ".", -1))
    return F.when(c == F.floor(c), F.lit(0)).otherwise(places)
