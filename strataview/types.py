"""Property types: their Spark types, their JSON schemas, and how values are read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import types as T

NUMERIC = ("int", "long", "double")
KINDS = ("string", "boolean", *NUMERIC, "decimal", "date", "timestamp", "enum", "objectRef")
ORDERED = ("string", *NUMERIC, "decimal", "date", "timestamp")
WIDER = {("int", "long"), ("int", "double"), ("long", "double"), ("float", "double")}


@dataclass(frozen=True)
class PropType:
    kind: str
    values: tuple[str, ...] = ()
    object_type: str | None = None
    precision: int | None = None
    scale: int | None = None

    def __str__(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.kind == "decimal" else self.kind

    def spark(self, objects: Mapping[str, Any] | None = None) -> T.DataType:
        if self.kind == "objectRef":
            return objects[self.object_type].key.type.spark(objects) if objects else T.StringType()
        if self.kind == "decimal":
            return T.DecimalType(self.precision, self.scale)
        return {
            "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
            "date": T.DateType(), "timestamp": T.TimestampType(),
        }.get(self.kind, T.StringType())

    def json_schema(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": {"boolean": "boolean", "int": "integer", "long": "integer", "double": "number"}.get(self.kind, "string")}
        formats = {"int": "int32", "long": "int64", "date": "date", "timestamp": "date-time"}
        if self.kind in formats:
            out["format"] = formats[self.kind]
        if self.kind == "enum":
            out["enum"] = list(self.values)
        if self.kind == "decimal":
            out["description"] = f"a decimal of at most {self.precision} digits, {self.scale} after the point"
        return out


def physical(kind: T.DataType) -> str:
    """A physical column's type in the spelling that :class:`PropType` uses."""
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    names = {
        T.StringType: "string", T.BooleanType: "boolean", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "long",
        T.DoubleType: "double", T.FloatType: "float", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz",
    }
    return names.get(type(kind), kind.simpleString())


def stored_as(t: PropType) -> str:
    return "string" if t.kind in ("enum", "objectRef") else str(t)


def comparable(a: str, b: str) -> bool:
    """Whether ``==`` between two kinds has a meaning."""
    text = ("string", "enum")
    return a == b or (a in NUMERIC and b in NUMERIC) or (a in text and b in text)


def promotable(found: str, wanted: str) -> bool:
    return found == wanted or (found, wanted) in WIDER


def _whole(v: Any) -> int:
    if isinstance(v, bool):
        raise ValueError("a boolean is no integer")
    if isinstance(v, str):
        return int(v.strip())
    if isinstance(v, (float, Decimal)) and v != int(v):
        raise ValueError("it has a fraction")
    return int(v)


def _decimal(v: Any, t: PropType) -> Decimal:
    if isinstance(v, (float, bool)):
        raise ValueError("a decimal is written as a string or an integer, never as a float")
    try:
        d = Decimal(str(v))
    except InvalidOperation:
        raise ValueError("it is no decimal") from None
    if not d.is_finite():
        raise ValueError("it is not finite")
    _, digits, exponent = d.as_tuple()
    after = max(0, -exponent)
    before = max(0, len(digits) + exponent)
    if after > t.scale and d != round(d, t.scale) or after > t.scale:
        raise ValueError(f"it has more than {t.scale} digits after the point")
    if before > t.precision - t.scale and d:
        raise ValueError(f"it has more than {t.precision} digits")
    return d


def _moment(v: Any) -> datetime:
    if isinstance(v, datetime):
        d = v
    elif isinstance(v, date):
        d = datetime(v.year, v.month, v.day)
    else:
        d = datetime.fromisoformat(str(v))
    return d.replace(tzinfo=timezone.utc) if d.tzinfo is None else d


def coerce(t: PropType, value: Any, objects: Mapping[str, Any] | None = None, what: str = "value") -> Any:
    """``value`` as Python holds type ``t``; ValueError where it can't be that without loss."""
    if value is None:
        return None
    try:
        match t.kind:
            case "objectRef":
                return coerce(objects[t.object_type].key.type, value, objects, what)
            case "int" | "long":
                return _whole(value)
            case "double":
                return float(value)
            case "decimal":
                return _decimal(value, t)
            case "boolean":
                if isinstance(value, str):
                    return {"true": True, "false": False}[value.strip().lower()]
                return bool(value)
            case "date":
                if isinstance(value, datetime):
                    return value.date()
                return value if isinstance(value, date) else date.fromisoformat(str(value))
            case "timestamp":
                return _moment(value)
            case "enum":
                if str(value) not in t.values:
                    raise ValueError(f"it is none of {', '.join(t.values)}")
                return str(value)
        return str(value)
    except KeyError:
        raise ValueError(f"{what}: {value!r} is no {t}") from None
    except (ValueError, TypeError, OverflowError) as e:
        raise ValueError(f"{what}: {value!r} is no {t}: {e}") from None
