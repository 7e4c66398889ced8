"""Field descriptors: Spark type, flags and validation of one column."""

from __future__ import annotations

import datetime
import decimal
import json
import re
from typing import Any

from pyspark.sql import types as T

from tamarack.errors import ModelError

#: What a row's deletion does to rows that refer to it.
ON_DELETE = ("CASCADE", "RESTRICT", "PROTECT", "SET_NULL", "SET_DEFAULT", "SET", "DO_NOTHING")
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}

_FLAGS = {"primary_key": bool, "unique": bool, "blank": bool, "null": bool, "db_index": bool, "editable": bool, "verbose_name": str, "db_column": str}


class Field:
    """Base of all fields. Flags are type-checked; a default must fit the type."""

    kind = "TEXT"
    spark_type: T.DataType = T.StringType()
    python: tuple = (str,)
    extra: dict[str, Any] = {}

    def __init__(self, **options: Any):
        known = {"default": None, "primary_key": False, "unique": False, "blank": False, "null": False, "db_index": False, "editable": True, "verbose_name": None, "db_column": None} | self.extra
        if unknown := sorted(set(options) - set(known)):
            raise ModelError(f"{type(self).__name__} has no option {', '.join(unknown)}; it has {', '.join(sorted(known))}")
        for name, value in (known | options).items():
            kind = _FLAGS.get(name)
            if kind and value is not None and not isinstance(value, kind):
                raise ModelError(f"{name} must be {kind.__name__}, not {value!r}")
            setattr(self, name, value)
        self.name = ""
        self.check()
        if self.default is not None:
            self.default = self.convert(self.default)

    def check(self) -> None:
        if self.primary_key and self.null:
            raise ModelError("a primary key cannot be null")

    def convert(self, value: Any) -> Any:
        """The value as the column's Python type; raises ModelError if it does not fit."""
        if value is None or isinstance(value, self.python) and not (isinstance(value, bool) and bool not in self.python):
            return value
        try:
            return self.parse(value)
        except (TypeError, ValueError, ArithmeticError) as error:
            raise ModelError(f"{self.name or type(self).__name__}: {value!r} is no {self.kind}") from error

    def parse(self, value: Any) -> Any:
        return self.python[0](value)

    def struct_field(self) -> T.StructField:
        keep = {k: json.dumps(v) if isinstance(v, list) else v for k, v in self.options().items() if isinstance(v, bool | int | float | str | list)}
        return T.StructField(self.name, self.spark_type, self.null, {"kind": type(self).__name__, **keep})

    def options(self) -> dict[str, Any]:
        """What differs from a plain field of this class."""
        plain = {"default": None, "primary_key": False, "unique": False, "blank": False, "null": False, "db_index": False, "editable": True, "verbose_name": None, "db_column": None} | self.extra
        return {k: getattr(self, k) for k in plain if getattr(self, k) != plain[k]}

    def same_column(self, other: Field) -> bool:
        """Whether two declarations ask for the same stored column."""
        ignore = {"on_delete", "related_name", "verbose_name", "editable", "blank", "how"}
        trim = lambda f: {k: v for k, v in f.options().items() if k not in ignore}
        return type(self) is type(other) and trim(self) == trim(other) and self.spark_type == other.spark_type


class _Number(Field):
    python = (int,)

    def parse(self, value: Any) -> int:
        if isinstance(value, float) and value != int(value):
            raise ValueError(value)
        return int(value)


class IntegerField(_Number):
    kind, spark_type = "INTEGER", T.IntegerType()


class BigIntegerField(_Number):
    kind, spark_type = "BIGINT", T.LongType()


class AutoField(_Number):
    """An integer primary key that numbers itself."""

    kind, spark_type = "INTEGER", T.IntegerType()
    auto = True

    def __init__(self, **options: Any):
        super().__init__(**{"primary_key": True} | options)


class IDField(AutoField):
    """A bigint identity primary key."""

    kind, spark_type = "BIGINT", T.LongType()
    extra = {"generated_always": False}


class FloatField(Field):
    kind, spark_type, python = "FLOAT", T.DoubleType(), (float,)


class DecimalField(Field):
    kind, python, extra = "DECIMAL", (decimal.Decimal,), {"max_digits": 10, "decimal_places": 2}

    def check(self) -> None:
        super().check()
        if not (isinstance(self.max_digits, int) and isinstance(self.decimal_places, int) and 0 < self.max_digits <= 38 and 0 <= self.decimal_places <= self.max_digits):
            raise ModelError("max_digits is 1 to 38, and decimal_places at most that")
        self.spark_type = T.DecimalType(self.max_digits, self.decimal_places)

    def parse(self, value: Any) -> decimal.Decimal:
        return decimal.Decimal(str(value))


class BooleanField(Field):
    kind, spark_type, python = "BOOLEAN", T.BooleanType(), (bool,)

    def parse(self, value: Any) -> bool:
        return {0: False, 1: True, "0": False, "1": True, "true": True, "false": False}[value.lower() if isinstance(value, str) else value]

    def convert(self, value: Any) -> Any:
        try:
            return super().convert(value)
        except KeyError as error:
            raise ModelError(f"{value!r} is no BOOLEAN") from error


class CharField(Field):
    kind, extra = "VARCHAR", {"max_length": 250, "choices": None}

    def check(self) -> None:
        super().check()
        if not isinstance(self.max_length, int) or isinstance(self.max_length, bool) or not 1 <= self.max_length <= 255:
            raise ModelError("max_length is 1 to 255")
        if self.choices is not None:
            self.choices = [tuple(c) if isinstance(c, list | tuple) else (c, c) for c in self.choices]
        if isinstance(self.default, str):
            if len(self.default) > self.max_length:
                raise ModelError("the default is longer than max_length")
            if self.choices and self.default not in [c for c, _ in self.choices]:
                raise ModelError("the default is not among the choices")


class TextField(Field):
    pass


class EmailField(CharField):
    extra = {"max_length": 254, "choices": None}


class ImageField(Field):
    """The path of an image."""


class DateField(Field):
    kind, spark_type, python, extra = "DATE", T.DateType(), (datetime.date,), {"auto_now": False, "auto_now_add": False}

    def convert(self, value: Any) -> Any:
        return value.date() if isinstance(value, datetime.datetime) else super().convert(value)

    def parse(self, value: Any) -> datetime.date:
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            raise ValueError(value)
        return datetime.date.fromisoformat(value)


class DateTimeField(Field):
    kind, spark_type, python, extra = "TIMESTAMPTZ", T.TimestampType(), (datetime.datetime,), {"auto_now": False, "auto_now_add": False, "with_zone": True}

    def check(self) -> None:
        super().check()
        if not self.with_zone:
            self.spark_type = T.TimestampNTZType()

    def parse(self, value: Any) -> datetime.datetime:
        return datetime.datetime.fromisoformat(value)


class TimeField(Field):
    """A time of day, kept as text: sessions without the time type read it too."""

    kind = "TIME"

    def parse(self, value: Any) -> str:
        return value.isoformat() if isinstance(value, datetime.time) else str(value)


class DurationField(Field):
    kind, spark_type, python = "INTERVAL", T.DayTimeIntervalType(), (datetime.timedelta,)

    def parse(self, value: Any) -> datetime.timedelta:
        return datetime.timedelta(seconds=float(value))


class BinaryField(Field):
    kind, spark_type, python, extra = "BLOB", T.BinaryType(), (bytes, bytearray), {"max_length": None}


class ForeignKey(Field):
    """A reference to another model. ``how`` fixes the join type of paths along it."""

    kind, spark_type, python = "BIGINT", T.LongType(), (int, str)
    extra = {"pk_field": None, "on_delete": "CASCADE", "on_update": None, "how": None, "related_name": None, "db_constraint": True, "deferrable": False, "initially_deferred": False, "set_value": None}

    def __init__(self, to: Any, **options: Any):
        self.to = to
        super().__init__(**options)

    def check(self) -> None:
        super().check()
        self.on_delete = str(self.on_delete or "DO_NOTHING").rpartition(".")[2].upper()
        if self.on_delete not in ON_DELETE:
            raise ModelError(f"on_delete is one of {', '.join(ON_DELETE)}")
        if self.how is not None:
            self.how = JOINS.get(str(self.how).upper().removesuffix(" JOIN").removesuffix(" OUTER"))
            if self.how is None:
                raise ModelError(f"how is one of {', '.join(JOINS)}")

    def struct_field(self) -> T.StructField:
        made = super().struct_field()
        refers = {"references": ".".join(filter(None, (self.target_name, self.pk_field)))} if self.db_constraint else {}
        return T.StructField(made.name, made.dataType, made.nullable, made.metadata | refers | {"on_delete": self.on_delete})

    @property
    def target_name(self) -> str:
        return self.to if isinstance(self.to, str) else self.to.name


class OneToOneField(ForeignKey):
    """A foreign key that no two rows share."""

    def __init__(self, to: Any, **options: Any):
        super().__init__(to, **{"unique": True} | options)


FIELDS = {c.__name__: c for c in (IDField, AutoField, ForeignKey, OneToOneField, CharField, TextField, EmailField, IntegerField, BigIntegerField, BooleanField, FloatField, DecimalField, DateField, DateTimeField, TimeField, DurationField, ImageField, BinaryField)}


def from_struct_field(column: T.StructField) -> Field:
    """The field that a stored column suggests; its own metadata, if it has any, decides."""
    kind = column.metadata.get("kind") if column.metadata else None
    kinds = {T.LongType: BigIntegerField, T.IntegerType: IntegerField, T.ShortType: IntegerField, T.ByteType: IntegerField, T.DoubleType: FloatField, T.FloatType: FloatField, T.BooleanType: BooleanField, T.DateType: DateField, T.TimestampType: DateTimeField, T.TimestampNTZType: DateTimeField, T.BinaryType: BinaryField, T.DayTimeIntervalType: DurationField}
    if kind in FIELDS and not issubclass(FIELDS[kind], ForeignKey):
        found = FIELDS[kind]
        made = found(**{k: v for k, v in (column.metadata | ({"choices": json.loads(column.metadata["choices"])} if "choices" in column.metadata else {})).items() if k in found.extra or k in _FLAGS})
    elif isinstance(column.dataType, T.DecimalType):
        made = DecimalField(max_digits=column.dataType.precision, decimal_places=column.dataType.scale, null=column.nullable)
    else:
        made = kinds.get(type(column.dataType), TextField)(null=column.nullable)
    made.name, made.spark_type = column.name, column.dataType
    return made
