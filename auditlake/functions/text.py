"""Text, number and JSON column functions."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# The characters a browser's script engine treats as white space. Java's \\s covers
# ASCII only, so the class is spelled out.
WS_INLINE = r" \t\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = rf"[{WS_INLINE}\n]"
# The same characters, spelled out.
WS_CHARS = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_SAME_LINE = rf"[{WS_INLINE}]"
WS_BUT_SPACE = rf"[{WS_INLINE[1:]}\n]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used several times in a deep expression is computed each time once it sits inside a
    lambda, where common parts are not found by the compiler.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf16_len(s: Column) -> Column:
    """Length in UTF-16 code units, which is how the audited tools report characters."""
    return F.floor(F.length(F.encode(s, "UTF-16BE")) / 2).cast("bigint")


def utf16_prefix(s: Column, units: int) -> Column:
    """The start of a text in at most ``units`` UTF-16 code units; a pair that would be cut is left out."""

    def cut(t: Column) -> Column:
        size = F.transform(F.split(t, ""), lambda c: F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1))
        at = F.aggregate(
            size,
            F.struct(F.lit(0).alias("units"), F.lit(0).alias("chars")),
            lambda done, n: F.struct((done["units"] + n).alias("units"), (done["chars"] + (done["units"] + n <= units).cast("int")).alias("chars")),
        )
        return F.substring(t, F.lit(1), at["chars"])

    return let(F.substring(s, 1, units), lambda t: F.when(utf16_len(t) <= units, t).otherwise(cut(t)))


def byte_len(s: Column) -> Column:
    return F.octet_length(s).cast("bigint")


def js_round(x: Column) -> Column:
    """Round half up, as bigint."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def tokens_est(chars: Column) -> Column:
    return F.when(chars <= 0, F.lit(0).cast("bigint")).otherwise(js_round(chars / 4))


def collapse_ws(s: Column) -> Column:
    # A single space needs no replacement, so only other runs match.
    return F.btrim(F.regexp_replace(s, f"{WS_BUT_SPACE}{WS}*| {WS}+", " "))


def js_trim(s: Column) -> Column:
    return F.btrim(s, F.lit(WS_CHARS))


def blank_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def clamp01(x: Column) -> Column:
    """NaN counts as 0, unlike in Spark's own ordering where NaN is largest."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def kb(x: Column) -> Column:
    return js_round(x / 1024)


def thousands(x: Column) -> Column:
    return js_round(x / 1000)


def pct(n: Column, d: Column) -> Column:
    """Rounded percentage; NULL where the denominator is 0."""
    return js_round(F.try_divide(n, d) * 100)


def format_chars(n: Column) -> Column:
    """``0``, ``999``, ``1.2k``, ``12k``. One decimal is rounded the way toFixed does.

    toFixed rounds the stored double, so 1.45 (stored a little below) goes down and 1.25 (stored
    exactly) goes up. At such ties the double is compared with the exact value as whole numbers.
    """
    n = n.cast("bigint")
    two52 = F.lit(1 << 52)
    stored = (n / 1000 * two52).cast("decimal(20,0)") * 1000
    up = (n % 100 > 50) | ((n % 100 == 50) & (stored >= n.cast("decimal(18,0)") * two52))
    tenths = F.floor(n / 100) + F.when(up, 1).otherwise(0)
    return (
        F.when(n >= 10_000, F.concat(js_round(n / 1000).cast("string"), F.lit("k")))
        .when(n >= 1000, F.concat(_whole_or_tenths(tenths, keep_zero=True), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def _whole_or_tenths(tenths: Column, keep_zero: bool = False) -> Column:
    whole = F.floor(tenths / 10).cast("string")
    decimal = F.concat(whole, F.lit("."), (tenths % 10).cast("string"))
    return decimal if keep_zero else F.when(tenths % 10 == 0, whole).otherwise(decimal)


def format_duration(ms: Column) -> Column:
    """``850 ms``, ``2.5s``, ``3m 20s``; ``ms`` is a whole number."""
    tenths = js_round(ms / 100)
    rest = js_round((tenths % 600) / 10)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(tenths < 600, F.concat(_whole_or_tenths(tenths), F.lit("s")))
        .otherwise(F.concat(F.floor(tenths / 600).cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
    )


def content_start_pct(md: Column) -> Column:
    """Where the first heading or long text line starts, as % of the markdown."""
    marked = F.concat(F.lit("\n"), md)
    at = F.regexp_instr(marked, F.lit(rf"\n(?:#{WS}|##{WS}|[A-Za-z0-9][^\n\r\x{{2028}}\x{{2029}}]{{40}})"))
    before = utf16_len(F.substring(md, F.lit(1), (at - 1).cast("int")))
    return (
        F.when(F.length(md) == 0, F.lit(100))
        .when(at == 0, F.lit(100))
        .otherwise(js_round(before / utf16_len(md) * 100))
        .cast("bigint")
    )


def is_valid_json(s: Column) -> Column:
    """True for exactly one JSON value.

    A lone ``try_parse_json`` stops after the first value and so accepts trailing text. Text that
    closes an enclosing array early breaks the object form and the other way round, hence both.
    Repeated keys count as valid, as they do for a script engine: a setting of the session.
    """
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    in_array = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
    return F.coalesce(in_array.isNotNull() & in_object.isNotNull(), F.lit(False))


def _strict(text: str | None) -> bool | None:
    if text is None:
        return None

    def refuse(name: str):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(BooleanType())
def is_valid_json_exact(s: pd.Series) -> pd.Series:
    """Arrow-batched form that reads with Python's parser."""
    return s.map(_strict)


def bare_id(finding_id: Column) -> Column:
    return F.regexp_replace(finding_id, r"^[^:]*:", "")


def summarize_error(message: Column, fallback: str = "render failed") -> Column:
    """First trimmed line that is not a browser log line, at most 200 characters."""
    lines = F.filter(
        F.transform(F.split(message, "\n"), js_trim),
        lambda line: (line != "") & ~line.rlike(r"^\[[0-9]{4}/[0-9]{6}\.[0-9]+:[A-Z]+:"),
    )
    text = utf16_prefix(F.coalesce(F.get(lines, F.lit(0)), message), 200)
    return F.coalesce(blank_to_null(text), F.lit(fallback))
