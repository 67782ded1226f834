"""Entity schemas: declared, versioned, never inferred from data."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from quillon.functions.errors import refuse

#: Kinds, their Spark types, and whole-number ranges.
KINDS = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "nat8": T.ShortType(), "nat16": T.IntegerType(), "nat32": T.LongType(), "nat64": T.DecimalType(20, 0),
    "int128": T.DecimalType(38, 0), "nat128": T.DecimalType(38, 0), "intbig": T.StringType(), "natbig": T.StringType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "duration": T.LongType(), "ulid": T.StringType(), "principal": T.BinaryType(), "subaccount": T.BinaryType(),
    "account": T.StructType([T.StructField("owner", T.BinaryType()), T.StructField("subaccount", T.BinaryType())]), "enum": T.StringType(), "unit": T.BooleanType(),
}
RANGES = {"int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "nat8": (0, 2**8 - 1), "nat16": (0, 2**16 - 1), "nat32": (0, 2**32 - 1), "nat64": (0, 2**64 - 1), "nat128": (0, 10**38 - 1), "duration": (0, 2**63 - 1)}
WHOLE = {"int8", "int16", "int32", "int64", "nat8", "nat16", "nat32", "nat64", "int128", "nat128", "duration"}
#: Kinds that can't be ordered.
UNORDERED = {"blob", "enum", "list", "set", "map", "record", "account"}


@dataclass(frozen=True)
class FieldSpec:
    """kind: one of KINDS, decimal, list, set, map, record. of: element kinds of list, set, map; fields of record."""

    name: str
    kind: str
    nullable: bool = False
    scale: int = 0
    max_len: int | None = None
    default: Any = None
    has_default: bool = False
    generated: str | None = None  # ulid, identity, created_at, updated_at
    values: tuple = ()  # of an enum
    of: tuple = ()
    relation: str | None = None  # target entity
    source: str | None = None  # name in files written before a rename
    since: int = 0  # version that added it; rows of older files have added_default
    added_default: Any = None

    def spark_type(self) -> T.DataType:
        if self.kind == "decimal":
            return T.DecimalType(38, self.scale)
        if self.kind in ("list", "set"):
            return T.ArrayType(self.of[0].spark_type())
        if self.kind == "map":
            return T.MapType(self.of[0].spark_type(), self.of[1].spark_type())
        if self.kind == "record":
            return T.StructType([T.StructField(f.name, f.spark_type(), f.nullable) for f in self.of])
        return KINDS[self.kind]


@dataclass(frozen=True)
class IndexSpec:
    name: str
    keys: tuple  # field names, or LOWER(name), UPPER(name), TRIM(name)
    unique: bool = False
    where: str | None = None
    from_ddl: bool = False


@dataclass(frozen=True)
class CheckSpec:
    name: str
    expr: str
    valid: bool = True
    after: int = 0


@dataclass(frozen=True)
class EntitySchema:
    name: str
    fields: tuple[FieldSpec, ...]
    key: tuple[str, ...]
    indexes: tuple[IndexSpec, ...] = ()
    checks: tuple[CheckSpec, ...] = ()
    store: str = "journaled"  # or heap
    version: int = 1

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len({n.lower() for n in names}) < len(names):
            refuse("schema", f"{self.name} has a field twice")
        if not self.key or not set(self.key) <= set(names):
            refuse("schema", f"{self.name} needs a primary key of its fields")
        for k in self.key:
            if self.field(k).nullable or self.field(k).kind in UNORDERED:
                refuse("schema", f"{k} can't be a primary key")

    def field(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name.lower() == name.lower():
                return f
        refuse("unknown_field", f"{self.name} has no field {name}")

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type(), f.nullable) for f in self.fields])

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> EntitySchema:
        def spec(d: dict) -> FieldSpec:
            return FieldSpec(**d | {"of": tuple(spec(x) for x in d["of"]), "values": tuple(d["values"])})

        d = json.loads(text)
        return EntitySchema(d["name"], tuple(spec(x) for x in d["fields"]), tuple(d["key"]), tuple(IndexSpec(**x | {"keys": tuple(x["keys"])}) for x in d["indexes"]), tuple(CheckSpec(**x) for x in d["checks"]), d["store"], d["version"])

    def changed(self, **new: Any) -> EntitySchema:
        return replace(self, version=self.version + 1, **new)


def kind_of(text: str, name: str, **more: Any) -> FieldSpec:
    """A field from a DDL type name such as Text, Int32 or Decimal(2)."""
    m = re.fullmatch(r"([a-z0-9_]+)(?:\((\d+)\))?", text.lower())
    kind, n = (m[1], m[2]) if m else ("", None)
    kind = {"integer": "int32", "bigint": "int64", "boolean": "bool", "float": "float64", "double": "float64", "string": "text"}.get(kind, kind)
    if kind == "decimal":
        return FieldSpec(name, kind, scale=int(n or 0), **more)
    if kind not in KINDS:
        refuse("unknown_type", text)
    return FieldSpec(name, kind, max_len=int(n) if n else None, **more)


def of_table(name: str, spark_schema: T.StructType, key: tuple[str, ...], indexes: tuple = (), store: str = "journaled") -> EntitySchema:
    """Declares an entity over an existing table whose columns have these Spark types. Explicit use only."""
    kinds = {T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.StringType: "text", T.BinaryType: "blob", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}

    def spec(n: str, t: T.DataType, nullable: bool) -> FieldSpec:
        if isinstance(t, T.DecimalType):
            return FieldSpec(n, "decimal", nullable, scale=t.scale)
        if isinstance(t, T.ArrayType):
            return FieldSpec(n, "list", nullable, of=(spec("element", t.elementType, True),))
        if isinstance(t, T.MapType):
            return FieldSpec(n, "map", nullable, of=(spec("key", t.keyType, False), spec("value", t.valueType, True)))
        if isinstance(t, T.StructType):
            return FieldSpec(n, "record", nullable, of=tuple(spec(f.name, f.dataType, f.nullable) for f in t))
        return FieldSpec(n, kinds[type(t)], nullable)

    return EntitySchema(name, tuple(spec(f.name, f.dataType, f.nullable and f.name not in key) for f in spark_schema), key, tuple(indexes), store=store)
