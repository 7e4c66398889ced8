"""Models and the graph of their foreign keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from tamarack.errors import FieldError, ModelError
from tamarack.fields import Field, ForeignKey, OneToOneField, from_struct_field
from tamarack.settings import Settings


def clean_name(name: str) -> str:
    """Lower case, without a leading underscore; separators of paths are refused."""
    name = name.removeprefix("_").lower()
    if not name or "__" in name or "@" in name:
        raise ModelError(f"{name!r} cannot be a name: it is empty, or has __ or @, which separate paths")
    return name


class Model:
    """A table: a name and typed fields, in order."""

    def __init__(self, table: str, **declared: Field):
        self.name = clean_name(table)
        self.fields: dict[str, Field] = {}
        for key, field in declared.items():
            if not isinstance(field, Field):
                raise ModelError(f"{key} is no field")
            field.name = clean_name(key)
            if field.name in self.fields:
                raise ModelError(f"{self.name} has {field.name} twice")
            self.fields[field.name] = field
        self.related: dict[str, Edge] = {}
        self.registry: Registry | None = None

    @property
    def pk(self) -> str | None:
        return next((n for n, f in self.fields.items() if f.primary_key), None)

    def field(self, name: str) -> Field:
        if name not in self.fields:
            raise FieldError(f"{self.name} has no field {name}; it has {', '.join([*self.fields, *self.related])}")
        return self.fields[name]

    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields.values()])

    def edge(self, name: str) -> Edge:
        """The foreign key, or what refers to this model, by the name a path gives it."""
        found = self.fields.get(name)
        if isinstance(found, ForeignKey):
            target = self.registry.model(found.target_name)
            return Edge(name, self, name, target, found.pk_field or target.pk, found, False)
        if name in self.related:
            return self.related[name]
        raise FieldError(f"{self.name} has no relation {name}; it has {', '.join([k for k, f in self.fields.items() if isinstance(f, ForeignKey)] + list(self.related)) or 'none'}")

    @classmethod
    def from_schema(cls, table: str, schema: T.StructType, primary_key: str | None = None) -> Model:
        """The model that a stored table suggests."""
        model = cls(table)
        for column in schema.fields:
            field = from_struct_field(column)
            field.name = column.name.lower()
            if field.name == primary_key:
                field.primary_key, field.null = True, False
            model.fields[field.name] = field
        return model

    def to_source(self) -> str:
        """Python text that declares this model again."""
        lines = []
        for name, field in self.fields.items():
            options = [f"{k}={v!r}" for k, v in field.options().items() if not (k == "primary_key" and hasattr(field, "auto")) and not (k == "unique" and isinstance(field, OneToOneField))]
            first = [repr(field.target_name)] if isinstance(field, ForeignKey) else []
            lines.append(f"    {_safe(name)}={type(field).__name__}({', '.join(first + options)}),")
        return f"{_safe(self.name).capitalize()} = Model(\n    {self.name!r},\n" + "\n".join(lines) + "\n)\n"


def _safe(name: str) -> str:
    import keyword

    return f"_{name}" if keyword.iskeyword(name) else re.sub(r"\W", "_", name)


@dataclass(frozen=True)
class Edge:
    """One step of a path: ``model.key = target.target_key``, along a foreign key or against it."""

    name: str
    model: Model
    key: str
    target: Model
    target_key: str | None
    fk: ForeignKey
    reverse: bool


class Registry:
    """Models that refer to each other, and where their rows are."""

    def __init__(self, *models: Model, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.models: dict[str, Model] = {}
        for m in models:
            self.models[m.name] = m
            m.registry = self
        for m in self.models.values():
            m.related = {}
        for m in self.models.values():
            for name, field in m.fields.items():
                if isinstance(field, ForeignKey):
                    self._relate(m, name, field)

    def model(self, name: str) -> Model:
        found = self.models.get(name.lower())
        if found is None:
            raise ModelError(f"no model {name}; there are {', '.join(self.models) or 'none'}")
        return found

    def _relate(self, holder: Model, name: str, fk: ForeignKey) -> None:
        target = self.model(fk.target_name)
        key = fk.pk_field or target.pk
        if key is None or key not in target.fields:
            raise ModelError(f"{holder.name}.{name}: {target.name} has no key {key}")
        fk.spark_type = target.fields[key].spark_type
        if fk.on_delete == "SET_NULL" and not fk.null:
            raise ModelError(f"{holder.name}.{name}: SET_NULL asks for null=True")
        if fk.on_delete == "SET_DEFAULT" and fk.default is None:
            raise ModelError(f"{holder.name}.{name}: SET_DEFAULT asks for a default")
        taken = [e for e in target.related.values() if e.target is holder]
        back = fk.related_name or (holder.name if not taken else f"{holder.name}_{name}")
        if back in target.related:
            raise ModelError(f"{target.name} has the related name {back} already")
        target.related[back] = Edge(back, target, key, holder, name, fk, True)
