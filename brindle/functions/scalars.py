"""Scalar expressions; all of them stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCESS_MINUTES, REFRESH_DAYS = 180, 30

_EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"
_IDS = {"object_id": r"^[0-9a-fA-F]{24}$", "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"}


def sure(condition: Column) -> Column:
    """The condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def present(c: Column) -> Column:
    return sure(c != "")


def is_email(c: Column) -> Column:
    return sure(c.rlike(_EMAIL))


def is_id(c: Column, form: str = "object_id") -> Column:
    return sure(c.rlike(_IDS[form]))


def length_within(c: Column, least: int, most: int) -> Column:
    return sure(F.char_length(c).between(least, most))


def or_else(new: Column, old: Column) -> Column:
    """`new`, unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def bearer_token(authorization: Column) -> Column:
    """The second part of an Authorization header; null if it isn't there."""
    return F.nullif(F.get(F.split(authorization, " "), F.lit(1)), F.lit(""))


def new_id(request_id: Column) -> Column:
    """24 hex characters that a re-run gives again."""
    return F.substring(F.md5(request_id.cast("binary")), 1, 24)


def access_expiry(iat: Column) -> Column:
    return iat + F.expr(f"interval {ACCESS_MINUTES} minutes")


def refresh_expiry(iat: Column) -> Column:
    return iat + F.expr(f"interval {REFRESH_DAYS} days")


def order(ts: str = "ts", request_id: str = "request_id") -> Column:
    """What stands for the order of arrival."""
    return F.struct(F.col(ts), F.col(request_id))
