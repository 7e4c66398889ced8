"""The lookup language: ``path__to__field__@transform__@comparator``."""

from __future__ import annotations

from dataclasses import dataclass

from tamarack.errors import LookupSyntaxError

COMPARATORS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "neq": "!=", "isnull": "isnull", "in": "in", "nin": "nin", "contains": "contains", "icontains": "icontains"}
TRANSFORMS = ("date", "month", "year", "day", "yyyy_mm", "quarter", "quadrimester")


@dataclass(frozen=True)
class Lookup:
    path: tuple[str, ...]
    transforms: tuple[str, ...] = ()
    comparator: str = "="

    @property
    def alias(self) -> str:
        return "__".join((*self.path, *self.transforms))


def parse(text: str, *, compares: bool = False) -> Lookup:
    """Read a lookup; a comparator may only end one that compares."""
    path: list[str] = []
    transforms: list[str] = []
    comparator = "="
    for part in str(text).split("__"):
        if comparator != "=":
            raise LookupSyntaxError(f"{text!r}: nothing may follow the comparator")
        if not part.startswith("@"):
            if transforms or not part:
                raise LookupSyntaxError(f"{text!r}: field names come before transforms, and none is empty")
            path.append(part.lower())
        elif part[1:] in TRANSFORMS:
            transforms.append(part[1:])
        elif part[1:] in COMPARATORS and compares:
            comparator = COMPARATORS[part[1:]]
        elif part[1:] in COMPARATORS:
            raise LookupSyntaxError(f"{text!r}: a comparator has no place here")
        else:
            raise LookupSyntaxError(f"{text!r}: unknown {part}; transforms are {', '.join(TRANSFORMS)}, comparators {', '.join(COMPARATORS)}")
    if not path:
        raise LookupSyntaxError(f"{text!r} names no field")
    return Lookup(tuple(path), tuple(transforms), comparator)
