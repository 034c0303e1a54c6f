"""Field grammar of the event protocol: each function gives null or the rule's code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions._c import c, finite, first_code

_WHITE = "".join(f"\\x{{{code:04X}}}" for code in K.PROTOCOL_WHITESPACE)

# --- fixed values: patterns of the event grammar ---------------------------------
DATASET = r"^[a-z0-9]([a-z0-9._\-]{0,62}[a-z0-9])?\z"
HEX64 = r"^[0-9a-f]{64}\z"
MIME = r"^[a-z0-9][a-z0-9!#$&^_.+\-]*/[a-z0-9][a-z0-9!#$&^_.+\-]*\z"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z\z"


def matches(value, pattern: str) -> Column:
    return F.coalesce(c(value).rlike(pattern), F.lit(False))


def dataset_code(value) -> Column:
    return first_code((~matches(value, DATASET), "DATASET_GRAMMAR"))


def hex64_code(value) -> Column:
    return first_code((~matches(value, HEX64), "HEX64"))


def scalar_code(json_text) -> Column:
    """Lone surrogate escapes in JSON source text; decoded strings are always UTF-8."""
    text = c(json_text)
    # A \uD8xx-\uDBxx escape must be followed by \uDCxx-\uDFxx, and the latter must not
    # stand alone. Doubled backslashes are removed first: they escape nothing here.
    plain = F.regexp_replace(text, r"\\\\", "")
    unpaired = F.regexp_replace(
        plain, r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}", ""
    )
    return first_code(
        (text.isNull() | ~F.is_valid_utf8(text), "STRING_NOT_SCALAR"),
        (unpaired.rlike(r"(?i)\\ud[89a-f][0-9a-f]{2}"), "STRING_NOT_SCALAR"),
    )


def text_code(value) -> Column:
    """Non-empty, with no protocol whitespace at either edge."""
    bad = c(value).isNull() | (c(value) == "") | c(value).rlike(f"^[{_WHITE}]|[{_WHITE}]\\z")
    return first_code((bad, "TEXT_EMPTY"))


def mime_code(value) -> Column:
    return first_code((~matches(value, MIME), "MIME_GRAMMAR"))


def url_code(value) -> Column:
    return first_code((~matches(value, f"^https?://[^{_WHITE}]+\\z"), "URL_GRAMMAR"))


def _whole_between(value, low: int, high: int) -> Column:
    v = c(value).cast("double")
    return finite(v) & F.coalesce((v == F.floor(v)) & (v >= low) & (v <= high), F.lit(False))


def size_code(value) -> Column:
    return first_code((~_whole_between(value, 1, K.MAX_SAFE_INTEGER), "SIZE_RANGE"))


def created_at_code(value) -> Column:
    return first_code((~_whole_between(value, 0, K.MAX_CREATED_AT), "CREATED_AT_RANGE"))


def datetime_code(value) -> Column:
    """UTC instant: required, grammatical, on the calendar, without leap seconds."""
    v = c(value)

    def part(start, length):
        return F.substring(v, start, length).try_cast("int")

    year, month, day = part(1, 4), part(6, 2), part(9, 2)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = (
        F.when(month == 2, F.when(leap, 29).otherwise(28))
        .when(month.isin(4, 6, 9, 11), 30)
        .otherwise(31)
    )
    on_calendar = (
        month.between(1, 12) & day.between(1, days)
        & (part(12, 2) <= 23) & (part(15, 2) <= 59) & (part(18, 2) <= 59)
    )
    return first_code(
        (v.isNull(), "DATETIME_REQUIRED"),
        (~matches(v, DATETIME), "DATETIME_GRAMMAR"),
        (~on_calendar, "DATETIME_CALENDAR"),
    )
