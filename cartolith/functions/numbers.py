"""Canonical number and JSON text.

Coordinates are rounded half-even to six places in decimal arithmetic, natively. The
shortest round-trip digits of an arbitrary double have no Spark equivalent (the JVM
prints more digits than needed for some values), so those go through an Arrow batch.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith import constants as K
from cartolith.functions._c import c


def _rounded(value) -> Column:
    """Half-even rounding of the shortest decimal text of a coordinate.

    The JVM may print a double with more digits than it needs, which would hide a tie. A
    tie has seven decimals, and no other decimal that short stands for the same double, so
    the seven-place value is taken wherever it is the number itself.
    """
    v = c(value).cast("double")
    printed = v.try_cast("decimal(38,18)")
    short = F.bround(printed, 7)
    return F.bround(F.when(short.cast("double") == v, short).otherwise(printed), 6)


def quantised(value) -> Column:
    """A coordinate rounded half-even to six places, as a double."""
    return _rounded(value).cast("double")


def canonical_coordinate(value) -> Column:
    """Six places half-even, positional, no trailing zeros, no negative zero."""
    return F.regexp_replace(_rounded(value).cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def _digits(value: float) -> str:
    text = format(Decimal(repr(float(value))), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


@F.pandas_udf(T.StringType())
def canonical_number(values: pd.Series) -> pd.Series:
    """Shortest round-trip digits without an exponent; null for a value with no JSON form."""
    return values.map(lambda v: _digits(v) if v is not None and math.isfinite(v) else None)


_KEY = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*")


class _Refused(ValueError):
    """Carries the code of the first rule a property bag breaks."""


def _number(text: str):
    """JSON number as int or double; an integer too large for a double is infinite."""
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    return float(text)


def _canonical(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        if isinstance(value, float) and not math.isfinite(value):
            raise _Refused("NUMBER_NOT_FINITE")
        if abs(value) > K.MAX_SAFE_INTEGER:
            raise _Refused("PROPERTY_NUMBER_RANGE")
        return str(value) if isinstance(value, int) else _digits(value)
    if isinstance(value, str):
        if any("\ud800" <= ch <= "\udfff" for ch in value):
            raise _Refused("STRING_NOT_SCALAR")
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    members = []
    for key in sorted(value):
        if not _KEY.fullmatch(key):
            raise _Refused("PROPERTY_KEY_GRAMMAR")
        members.append(json.dumps(key) + ":" + _canonical(value[key]))
    return "{" + ",".join(members) + "}"


def _bag(text: str | None) -> tuple[str | None, str | None]:
    """(canonical text, null) of a property bag, or (null, code)."""
    if text is None or text.strip() == "null":
        return "{}", None
    try:
        value = json.loads(text, parse_float=float, parse_int=_number)
        if not isinstance(value, dict):
            raise _Refused("PROPERTY_KEY_GRAMMAR")
        return _canonical(value), None
    except _Refused as refusal:
        return None, str(refusal)
    except ValueError:
        return None, "PROPERTY_KEY_GRAMMAR"


@F.pandas_udf(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("code", T.StringType())])
)
def properties(values: pd.Series) -> pd.DataFrame:
    """Canonical text of a JSON property bag, or the code that refuses it.

    An absent bag is the empty object. One traversal checks and prints.
    """
    pairs = [_bag(v) for v in values]
    return pd.DataFrame(pairs, columns=["text", "code"], dtype=object)


def canonical_json(json_text) -> Column:
    return properties(c(json_text))["text"]


def properties_code(json_text) -> Column:
    return properties(c(json_text))["code"]
