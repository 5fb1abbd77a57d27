"""Per-column filters, compiled to one boolean expression.

Every filter sees the whole table. Filters are combined with AND; a null outcome drops the
row. Expressions are written so that they reach the Parquet scan wherever they can: a number
is compared in the type of its column, and the ``(null)`` token is only spelled out where the
search text could match it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import date
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal, InvalidOperation
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import FilterError
from ..functions.text import NULL_TOKEN, text_or_token, text_view
from ..functions.types import column, is_floating, is_integral, is_numeric

_EXACT = Context(prec=400)
_OPERATORS = (">", "<", ">=", "<=", "=")
_PLAIN_INTEGER = re.compile("0|-?[1-9][0-9]{0,18}")
_ISO_DATE = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}")
_INTEGRAL_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


@dataclass(frozen=True)
class Filter:
    """One column's filter.

    `kind` is ``text`` (substring, or regular expression on request), ``number`` (with an
    `operator`) or ``values`` (`value` is a list of texts, ``(null)`` among them for nulls).
    """

    column: str
    value: object
    kind: str = "text"
    operator: str = "="


@dataclass
class CompiledFilters:
    predicate: Column | None
    applied: list[Filter] = field(default_factory=list)
    #: (filter, reason) of the filters that say nothing: they do not restrict the table
    skipped: list[tuple[Filter, str]] = field(default_factory=list)


def parse_filter_entry(name: str, entry: str, dtype: T.DataType) -> Filter | None:
    """A typed-in filter: ``>= 10`` on a number column, any text elsewhere; blank clears."""
    if not entry.strip():
        return None
    if not is_numeric(dtype):
        return Filter(name, entry)
    match = re.match(r"(?P<op>[<>=]*)\s*(?P<number>.+)", entry)
    if match is None:
        return None
    return Filter(name, match["number"].strip(), "number", match["op"] or "=")


def filters_from_request(spec: dict[str, dict]) -> list[Filter]:
    """Filters from the JSON form ``{column: {type, value, operator, valueList}}``."""
    out = []
    for name, item in spec.items():
        if item.get("valueList"):
            out.append(Filter(name, tuple(item["valueList"]), "values"))
        else:
            out.append(Filter(name, item.get("value", ""), item.get("type", "text"), item.get("operator", "=")))
    return out


def compile_filters(
    df: DataFrame, filters, case_insensitive: bool = False, use_regex: bool = False
) -> CompiledFilters:
    """One predicate for all filters. Unknown columns, empty or non-numeric entries are skipped."""
    out = CompiledFilters(None)
    predicates = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for item in filters:
        reason = None
        if item.column not in types:
            reason = "unknown column"
        elif item.value is None or item.value == "" or item.value == ():
            reason = "empty value"
        elif item.kind == "number":
            reason, predicate = _number(column(item.column), types[item.column], item)
        elif item.kind == "values":
            predicate = _values(column(item.column), types[item.column], item, case_insensitive)
        elif item.kind == "text":
            predicate = _text(
                df.sparkSession, column(item.column), types[item.column], str(item.value), case_insensitive, use_regex
            )
        else:
            reason = f"unknown filter kind {item.kind}"
        if reason:
            out.skipped.append((item, reason))
        else:
            out.applied.append(item)
            predicates.append(predicate)
    if predicates:
        out.predicate = reduce(lambda a, b: a & b, predicates)
    return out


def apply_filters(df: DataFrame, filters, case_insensitive: bool = False, use_regex: bool = False) -> DataFrame:
    """The rows that pass every filter."""
    predicate = compile_filters(df, filters, case_insensitive, use_regex).predicate
    return df if predicate is None else df.filter(predicate)


# text ---------------------------------------------------------------------------------


def _text(
    spark: SparkSession, col: Column, dtype: T.DataType, needle: str, case_insensitive: bool, use_regex: bool
) -> Column:
    if use_regex:
        # unix lines: only \n ends a line; unicode case folding on request
        pattern = ("(?diu)" if case_insensitive else "(?d)") + needle
        null_matches = _regex_matches(spark, pattern, NULL_TOKEN)
        if null_matches is not None:
            return _searched(col, dtype, null_matches).rlike(pattern)
    if case_insensitive:
        return F.contains(
            F.lower(_searched(col, dtype, needle.lower() in NULL_TOKEN)), F.lower(F.lit(needle))
        )
    return F.contains(_searched(col, dtype, needle in NULL_TOKEN), F.lit(needle))


def _searched(col: Column, dtype: T.DataType, null_can_match: bool) -> Column:
    return text_or_token(col, dtype) if null_can_match else text_view(col, dtype)


def _regex_matches(spark: SparkSession, pattern: str, text: str) -> bool | None:
    """Whether the pattern matches the text; None where the pattern is not valid."""
    try:
        return spark.range(1).select(F.lit(text).rlike(pattern)).first()[0]
    except PySparkException:
        return None


def _values(col: Column, dtype: T.DataType, item: Filter, case_insensitive: bool) -> Column:
    wanted = [str(v) for v in item.value]
    far_date = isinstance(dtype, T.DateType) and any(v.startswith(("+", "-")) for v in wanted)
    if is_integral(dtype) or isinstance(dtype, T.DateType) and not far_date:
        # compared in the column's own type, so that the list reaches the scan
        listed = NULL_TOKEN.lower() in [v.lower() for v in wanted] if case_insensitive else NULL_TOKEN in wanted
        typed = [literal for v in wanted if (literal := _exact_literal(v, dtype)) is not None]
        found = col.isin(typed) if typed else F.lit(False)
        return found | col.isNull() if listed else found
    if case_insensitive:
        return F.lower(text_or_token(col, dtype)).isin([v.lower() for v in wanted])
    if NULL_TOKEN in wanted:
        return text_view(col, dtype).isin(wanted) | col.isNull()
    return text_view(col, dtype).isin(wanted)


def _exact_literal(text: str, dtype: T.DataType) -> Column | None:
    """The value of an integer or date type (of a four-digit year) whose text is exactly this; None if there is none."""
    if isinstance(dtype, T.DateType):
        try:
            date.fromisoformat(text)
        except ValueError:
            return None
        return F.lit(text).cast(dtype) if _ISO_DATE.fullmatch(text) else None
    if not _PLAIN_INTEGER.fullmatch(text):
        return None
    high = 2 ** (_INTEGRAL_BITS[type(dtype)] - 1)
    return F.lit(int(text)).cast(dtype) if -high <= int(text) < high else None


# numbers ------------------------------------------------------------------------------


def _parse_number(entry: object) -> Decimal | float | None:
    """The entry as an exact decimal, or as a non-finite float; None if it is no number."""
    text = str(entry).strip()
    try:
        number = Decimal(text)
    except InvalidOperation:
        return None
    if number.is_snan():
        return None
    return number if number.is_finite() else float(number)


def _number(col: Column, dtype: T.DataType, item: Filter) -> tuple[str | None, Column | None]:
    if item.operator not in _OPERATORS:
        return f"unknown operator {item.operator}", None
    value = _parse_number(item.value)
    if value is None:
        return "not a number", None
    if not is_numeric(dtype):
        raise FilterError(f"column {item.column} of type {dtype.simpleString()} cannot be compared with a number")
    if is_floating(dtype):
        return None, _compare_float(col, dtype, float(value), item.operator)
    return None, _compare_exact(col, dtype, value, item.operator)


def _compare(col: Column, operator: str, literal: Column) -> Column:
    return {
        ">": col > literal,
        "<": col < literal,
        ">=": col >= literal,
        "<=": col <= literal,
        "=": col == literal,
    }[operator]


def _compare_float(col: Column, dtype: T.DataType, value: float, operator: str) -> Column:
    if math.isnan(value):
        return F.lit(False)
    wide = col if isinstance(dtype, T.DoubleType) else col.cast("double")
    outcome = _compare(wide, operator, F.lit(value))
    # Spark orders NaN above every number; a comparison with NaN is never true here
    return outcome & ~F.isnan(col) if operator in (">", ">=") or math.isinf(value) else outcome


def _compare_exact(col: Column, dtype: T.DataType, value: Decimal | float, operator: str) -> Column:
    """Compare an integer or decimal column with any number, exactly and in its own type.

    A value between two values of the type is moved to a neighbour that gives the same
    outcome, so the literal has the column's type and the comparison reaches the scan.
    """
    scale = 0 if is_integral(dtype) else dtype.scale
    if is_integral(dtype):
        high = 2 ** (_INTEGRAL_BITS[type(dtype)] - 1) - 1
        low = -high - 1
    else:
        high = Decimal(10**dtype.precision - 1).scaleb(-scale)
        low = -high
    if isinstance(value, float):  # nan or an infinity
        if math.isnan(value):
            return F.lit(False)
        return _constant(col, operator in (("<", "<=") if value > 0 else (">", ">=")))
    if value > high or value < low:
        return _constant(col, operator in (("<", "<=") if value > 0 else (">", ">=")))
    down, up = (_at_scale(value, scale, mode) for mode in (ROUND_FLOOR, ROUND_CEILING))
    if operator == "=" and down != up:
        return _constant(col, False)
    bound = up if operator in (">=", "<") else down
    literal = F.lit(int(bound)).cast(dtype) if is_integral(dtype) else F.lit(str(bound)).cast(dtype)
    return _compare(col, operator, literal)


def _at_scale(value: Decimal, scale: int, mode: str) -> Decimal:
    sign, digits, exponent = value.as_tuple()
    if exponent >= -scale:
        return value
    if value.adjusted() < -scale:  # less than one unit of the scale: only the sign matters
        unit = Decimal(1).scaleb(-scale)
        if not value:
            return Decimal(0)
        return (Decimal(0) if sign else unit) if mode == ROUND_CEILING else (-unit if sign else Decimal(0))
    step = 10 ** (-exponent - scale)
    whole, rest = divmod(int(value.scaleb(-exponent, _EXACT)), step)  # floor division
    return Decimal(whole + (1 if rest and mode == ROUND_CEILING else 0)).scaleb(-scale, _EXACT)


def _constant(col: Column, outcome: bool) -> Column:
    """The same answer for every value; a null value has none and drops its row."""
    return col.isNotNull() if outcome else F.lit(False)
