"""Declaration of a vector table: fields, keys and table-wide options."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

# Names of the field types and of the read levels.
SCALAR_TYPES = {
    "Bool": T.BooleanType(),
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "Float": T.FloatType(),
    "Double": T.DoubleType(),
    "VarChar": T.StringType(),
    "String": T.StringType(),
    "JSON": T.VariantType(),
}
VECTOR_TYPES = {
    "FloatVector": T.ArrayType(T.FloatType()),
    "Float16Vector": T.ArrayType(T.FloatType()),
    "BFloat16Vector": T.ArrayType(T.FloatType()),
    "BinaryVector": T.ArrayType(T.LongType()),
    "SparseFloatVector": T.MapType(T.IntegerType(), T.FloatType()),
}
LEVELS = ("Strong", "Bounded", "Session", "Eventually")
MAX_VARCHAR_BYTES = 65535
META_COLUMN = "$meta"


class SpecError(ValueError):
    """A table declaration that breaks a schema rule."""


@dataclass(frozen=True)
class Field:
    name: str
    data_type: str
    is_primary_key: bool = False
    is_auto_id: bool = False
    is_partition_key: bool = False
    is_clustering_key: bool = False
    nullable: bool = False
    dim: int | None = None
    max_length: int | None = None
    max_capacity: int | None = None
    element_type: str | None = None
    description: str = ""

    @property
    def is_vector(self) -> bool:
        return self.data_type in VECTOR_TYPES

    def spark_type(self) -> T.DataType:
        if self.data_type == "Array":
            return T.ArrayType(SCALAR_TYPES[self.element_type])
        return SCALAR_TYPES.get(self.data_type) or VECTOR_TYPES[self.data_type]

    def problems(self) -> list[str]:
        found = []
        if self.data_type not in {"Array", *SCALAR_TYPES, *VECTOR_TYPES}:
            found.append(f"unknown data type {self.data_type!r}")
        if self.nullable and (self.is_primary_key or self.is_vector):
            found.append("a primary key or vector cannot be nullable")
        if self.is_vector and self.data_type != "SparseFloatVector" and not (self.dim or 0) > 0:
            found.append("a dense vector needs dim")
        if self.data_type == "BinaryVector" and (self.dim or 0) % 8:
            found.append("dim of a binary vector must be a multiple of 8")
        if self.data_type == "VarChar" and not 0 < (self.max_length or 0) <= MAX_VARCHAR_BYTES:
            found.append(f"VarChar needs max_length in 1..{MAX_VARCHAR_BYTES}")
        if self.data_type == "Array":
            if not (self.max_capacity or 0) > 0:
                found.append("Array needs max_capacity")
            if self.element_type not in SCALAR_TYPES or self.element_type == "JSON":
                found.append(f"unknown element type {self.element_type!r}")
        return [f"{self.name}: {text}" for text in found]


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[Field, ...]
    description: str = ""
    auto_id: bool = False
    enable_dynamic_field: bool = False
    shard_num: int = 1
    consistency_level: str = "Strong"
    delete_protection: bool = True
    properties: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        problems = [text for f in self.fields for text in f.problems()]
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            problems.append("field names must be unique")
        if sum(f.is_primary_key for f in self.fields) != 1:
            problems.append("exactly one primary key is required")
        if not any(f.is_vector for f in self.fields):
            problems.append("at least one vector field is required")
        for flag in ("is_partition_key", "is_clustering_key"):
            if sum(getattr(f, flag) for f in self.fields) > 1:
                problems.append(f"at most one field may set {flag}")
        if self.consistency_level not in LEVELS:
            problems.append(f"unknown consistency level {self.consistency_level!r}")
        if self.shard_num < 1:
            problems.append("shard_num must be positive")
        if self.properties.get("partition_key_isolation") and self.partition_key is None:
            problems.append("partition_key_isolation needs a partition key")
        if problems:
            raise SpecError("; ".join(problems))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        given = json.loads(text)
        return cls(**given | {"fields": tuple(Field(**f) for f in given["fields"])})

    def _flagged(self, flag: str) -> str | None:
        return next((f.name for f in self.fields if getattr(f, flag)), None)

    @property
    def primary_key(self) -> str:
        return self._flagged("is_primary_key")

    @property
    def partition_key(self) -> str | None:
        return self._flagged("is_partition_key")

    @property
    def clustering_key(self) -> str | None:
        return self._flagged("is_clustering_key")

    @property
    def generates_ids(self) -> bool:
        return self.auto_id or any(f.is_primary_key and f.is_auto_id for f in self.fields)

    @property
    def dynamic(self) -> bool:
        return bool(self.properties.get("dynamic_field_enabled", self.enable_dynamic_field))

    @property
    def by_name(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}

    def schema(self) -> T.StructType:
        """Spark schema, with the declared limits as column metadata."""
        limits = ("dim", "max_length", "max_capacity", "element_type", "description")
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    f.spark_type(),
                    True,
                    {"data_type": f.data_type}
                    | {k: getattr(f, k) for k in limits if getattr(f, k)},
                )
                for f in self.fields
            ]
        )
