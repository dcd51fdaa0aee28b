"""Ids, time units and 64-bit arithmetic as column expressions.

Span clocks are untrusted input. Sums that leave the 64-bit range wrap around instead of
failing the job, as two's complement does.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_63 = Decimal(2**63)
_TWO_64 = Decimal(2**64)


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _wrap(c: Column) -> Column:
    shifted = F.pmod(c.cast("decimal(38,0)") + F.lit(_TWO_63), F.lit(_TWO_64))
    return (shifted - F.lit(_TWO_63)).cast("bigint")


def add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), _wrap(_wide(a) + _wide(b)))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), _wrap(_wide(a) - _wide(b)))


def wrapped_integer(text: Column) -> Column:
    """An integer of at most 38 digits, of which the low 64 bits are kept."""
    return F.coalesce(text.try_cast("bigint"), _wrap(text.try_cast("decimal(38,0)")))


def div(a: Column, b: int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def us_to_ns(c: Column) -> Column:
    thousand = F.lit(1000).cast("bigint")
    return F.coalesce(F.try_multiply(c, thousand), _wrap(_wide(c) * F.lit(Decimal(1000))))


def ns_to_us(c: Column) -> Column:
    return div(c, 1000)


def ns_to_ms(c: Column) -> Column:
    return div(c, 1_000_000)


def ns_to_timestamp(c: Column) -> Column:
    """The microsecond at or before an epoch nanosecond."""
    below = F.pmod(c, F.lit(1000).cast("bigint"))
    return F.timestamp_micros(div(c, 1000) - F.when((c < 0) & (below != 0), 1).otherwise(0))


def parse_id(s: Column) -> Column:
    """Up to 16 hex digits to a signed 64-bit id; '' is 0, anything else is null."""
    return F.when(s == "", F.lit(0).cast("bigint")).when(
        is_hex_id(s), F.conv(s, 16, -10).cast("bigint")
    )


def is_hex_id(s: Column) -> Column:
    return s.rlike("^[0-9a-fA-F]{0,16}$")


def format_id(c: Column) -> Column:
    # Not lower(), which looks each text up in Unicode's tables.
    return F.lpad(F.translate(F.hex(c), "ABCDEF", "abcdef"), 16, "0")


def unsigned_id(c: Column) -> Column:
    return F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")


def is_root(parent_id: Column, span_id: Column) -> Column:
    return parent_id == span_id


def has_parent(parent_id: Column, span_id: Column) -> Column:
    return parent_id != span_id


def is_unknown(c: Column) -> Column:
    return c == 0


def is_valid_ts(c: Column) -> Column:
    return c > 0
