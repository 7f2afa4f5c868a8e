"""Literals, value display, node keys and their checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.errors import PropertyTypeError, RegistrationError

MAX_KEY = (1 << 32) - 1
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def parse_literal(token: str) -> bool | int | str:
    """true or false, a 64-bit integer, or one quoted token."""
    token = token.strip()
    if token in ("true", "false"):
        return token == "true"
    if re.fullmatch(r"[+-]?[0-9]+", token) and -(1 << 63) <= int(token) < 1 << 63:
        return int(token)
    if len(token) >= 2 and token[0] == token[-1] and token[0] in "'\"":
        return token[1:-1]
    raise PropertyTypeError(f"not a literal: {token}")


def show_value(bool_value: Column, int_value: Column, text_value: Column) -> Column:
    """The text of a property value, whichever of the three columns holds it."""
    return F.coalesce(bool_value.cast("string"), int_value.cast("string"), text_value)


def to_int64(value: int) -> int:
    """An unsigned integer as a property value; values above 2^63 - 1 are refused."""
    if not 0 <= value < 1 << 63:
        raise PropertyTypeError(f"integer out of range: {value}")
    return value


def composite_key(*parts: Column) -> Column:
    """Text that keeps the parts apart: each is preceded by its length."""
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (q.cast("string") for q in parts)])


def node_key(table_id: int | Column, key: Column) -> Column:
    """Table id in the upper 32 bits, primary key in the lower."""
    table = F.lit(table_id) if isinstance(table_id, int) else table_id
    return F.shiftleft(table.cast("long"), 32).bitwiseOR(key.cast("long"))


def table_of(key: Column) -> tuple[Column, Column]:
    """(table id, primary key) of a node key."""
    return F.shiftrightunsigned(key, 32).cast("long"), key.bitwiseAND(F.lit(MAX_KEY).cast("long"))


def valid_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise RegistrationError(f"not an identifier: {name}")
    return name


def valid_table_id(value: int) -> int:
    if not 1 <= value < 1 << 31:
        raise RegistrationError(f"table or edge id out of range: {value}")
    return value


def valid_primary_key(key: Column) -> Column:
    """The key itself, or an error while the plan runs."""
    fits = key.isNotNull() & key.between(0, MAX_KEY)
    return F.when(fits, key.cast("long")).otherwise(F.raise_error(F.lit("primary key out of range")).cast("long"))
