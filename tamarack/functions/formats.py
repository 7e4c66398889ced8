"""Transforms, date parts and ``to_char`` patterns as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.errors import LookupSyntaxError

_TEXT = T.StringType()

#: ``to_char`` patterns and what Spark calls them (fixed values), the longest first.
PATTERNS = (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("SSS", "SSS"), ("Month", "MMMM"), ("Mon", "MMM"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a"), ("Q", "q"))


def spark_pattern(pattern: str) -> str:
    """A ``to_char`` pattern as a datetime pattern of Spark; other letters and quoted parts are literal."""
    out, at = "", 0
    while at < len(pattern):
        quoted = re.match(r'"([^"]*)"', pattern[at:])
        found = next(((a, b) for a, b in PATTERNS if pattern.startswith(a, at)), None)
        if quoted:
            out, at = out + f"'{quoted[1]}'", at + quoted.end()
        elif found:
            out, at = out + found[1], at + len(found[0])
        else:
            c = pattern[at]
            out, at = out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), at + 1
    return out.replace("''", "''") if "'" not in out else re.sub(r"(?<=[A-Za-z ])''(?=[A-Za-z ])", "", out)


def transform(column: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType]:
    """A transformed column and its type; text from an earlier transform is read as a date again."""
    if isinstance(kind, T.StringType):
        column = F.to_date(F.rpad(column, 10, "-01"))
    year = F.year(column).cast("string")
    if name in ("year", "month", "day"):
        return {"year": F.year, "month": F.month, "day": F.dayofmonth}[name](column), T.IntegerType()
    if name in ("date", "yyyy_mm"):
        return F.date_format(column, "yyyy-MM-dd" if name == "date" else "yyyy-MM"), _TEXT
    part = F.quarter(column) if name == "quarter" else F.ceil(F.month(column) / 4).cast("int")
    return F.when(column.isNotNull(), F.concat(year, F.lit("-Q"), part.cast("string"))), _TEXT


def extract(column: Column, part: str) -> Column:
    """A date part as PostgreSQL counts it: days of the week from 0, Sunday."""
    part = part.upper()
    if part == "DOW":
        return F.dayofweek(column) - 1
    if part == "ISODOW":
        return F.weekday(column) + 1
    if part == "EPOCH":
        return F.unix_timestamp(column.cast("timestamp"))
    if not re.fullmatch(r"[A-Z]+", part):
        raise LookupSyntaxError(f"{part!r} is no date part")
    return F.date_part(F.lit(part), column)


#: SQL type names and Spark's (fixed values).
TYPES = {"VARCHAR": "string", "TEXT": "string", "CHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "INT": "int", "SMALLINT": "smallint", "FLOAT": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double", "REAL": "float", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "NUMERIC": "decimal(38,18)", "DECIMAL": "decimal(10,2)", "BYTEA": "binary"}


def cast(column: Column, name: str) -> Column:
    base, _, size = name.upper().strip().partition("(")
    if base.strip() not in TYPES:
        raise LookupSyntaxError(f"unknown type {name}; there are {', '.join(TYPES)}")
    if size and base.strip() in ("NUMERIC", "DECIMAL"):
        return column.cast(f"decimal({size}")
    made = column.cast(TYPES[base.strip()])
    return F.substring(made, 1, int(size.rstrip(") "))) if size and base.strip() in ("VARCHAR", "CHAR") else made
