"""Typed ingest: cast to the declared types and set aside rows that do not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.functions import metrics
from vectable.operators import keys
from vectable.spec import META_COLUMN, VECTOR_TYPES, Field, TableSpec

REASONS = "reasons"


def _has_null(col: Column) -> Column:
    return F.exists(col, lambda x: x.isNull())


def _column(field: Field, source: T.DataType) -> tuple[Column, list[tuple[str, Column]]]:
    """Cast column and its checks, each a (reason, condition that is true when it fails)."""
    raw = F.col(field.name)
    kind, target = field.data_type, field.spark_type()
    if kind == "JSON":
        already = isinstance(source, T.VariantType)
        value = raw if already else F.try_parse_json(raw.cast("string"))
    elif isinstance(source, T.StringType) and isinstance(target, (T.ArrayType, T.MapType)):
        value = F.from_json(raw, target.simpleString())
    else:
        value = raw.try_cast(target)
    checks = [("bad value", raw.isNotNull() & value.isNull())]
    if kind == "VarChar":
        checks.append(("too long", F.octet_length(value) > field.max_length))
    if kind == "Array":
        checks.append(("over capacity", F.size(value) > field.max_capacity))
        checks.append(("null element", _has_null(value)))
        if isinstance(source, T.ArrayType):
            lost = F.size(F.filter(value, lambda x: x.isNull())) > F.size(
                F.filter(raw, lambda x: x.isNull())
            )
            checks.append(("bad value", lost))
        if field.element_type == "VarChar" and field.max_length:
            long_one = F.exists(value, lambda x: F.octet_length(x) > field.max_length)
            checks.append(("too long", long_one))
    if kind == "SparseFloatVector":
        odd = F.exists(
            F.map_values(value),
            lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))),
        )
        checks.append(("negative key", F.exists(F.map_keys(value), lambda i: i < 0)))
        checks.append(("not finite", odd))
    elif kind in VECTOR_TYPES:
        items = -(-field.dim // 64) if kind == "BinaryVector" else field.dim
        checks.append(("wrong dim", F.size(value) != items))
        checks.append(("null element", _has_null(value)))
        if kind != "BinaryVector":
            checks.append(("not finite", F.exists(value, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))))
    if not field.nullable:
        checks.append(("null", raw.isNull()))
    if kind in ("Float16Vector", "BFloat16Vector"):
        value = metrics.reduced(value, "f16" if kind == "Float16Vector" else "bf16")
    return value, checks


def check(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared columns, cast, plus ``reasons``: what does not fit, empty when all does.

    A missing column is read as null. Works on batch and streaming input.
    Failing values are kept as text so that nothing is lost on the way to quarantine.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = {f.name: F.lit(None).cast(f.spark_type()) for f in spec.fields if f.name not in have}
    df = df.withColumns(missing)
    have |= {name: spec.by_name[name].spark_type() for name in missing}
    values, failed = {}, []
    for field in spec.fields:
        value, checks = _column(field, have[field.name])
        values[field.name] = value
        failed += [F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{field.name}: {why}")) for why, bad in checks]
    kept = [values.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]
    reasons = F.array_distinct(F.array_compact(F.array(*failed)))
    return df.select(*kept, reasons.alias(REASONS), _originals(df))


def _originals(df: DataFrame) -> Column:
    """The whole row as JSON: declared and undeclared columns as they came."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    as_text = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        as_text.append((F.to_json(col) if isinstance(f.dataType, nested) else col.cast("string")).alias(f.name))
    return F.to_json(F.struct(*as_text)).alias("raw")


def conform(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that fit the declaration, and the others with ``reasons`` and ``raw``.

    Undeclared columns go into the dynamic column when the table has one and are
    dropped otherwise; ``raw`` holds them for misfits in either case. A table that
    generates its ids takes rows without a key column, or with null keys: the
    good rows get dense ids in the order of their other columns, after the
    largest key given.
    """
    if spec.generates_ids:
        return _with_ids(df, spec)
    return _conformed(df, spec)


def _with_ids(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    pk = spec.by_name[spec.primary_key]
    if pk.name not in df.columns:
        df = df.withColumn(pk.name, F.lit(None).cast(pk.spark_type()))
    keyless = df.filter(F.col(pk.name).isNull()).withColumn(pk.name, F.lit(0).cast(pk.spark_type()))
    given, given_bad = _conformed(df.filter(F.col(pk.name).isNotNull()), spec)
    fresh, fresh_bad = _conformed(keyless, spec)
    largest = given.agg(F.max(F.col(pk.name).cast("bigint"))).first()[0]
    fresh = fresh.drop(pk.name)
    plain = [f.name for f in fresh.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    numbered = keys.assign_ids(fresh, plain, (largest or 0) + 1, pk.name)
    numbered = numbered.withColumn(pk.name, F.col(pk.name).cast(pk.spark_type()))
    no_key = F.lit(None).cast(fresh_bad.schema[pk.name].dataType)
    return given.unionByName(numbered), given_bad.unionByName(fresh_bad.withColumn(pk.name, no_key))


def _conformed(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    known = set(spec.by_name)
    checked = check(fold_dynamic(df, spec) if spec.dynamic else df, spec)
    declared = [f.name for f in spec.fields] + ([META_COLUMN] if spec.dynamic else [])
    good = checked.filter(F.size(REASONS) == 0).select(*[F.col(f"`{c}`") for c in declared])
    bad = checked.filter(F.size(REASONS) > 0).select(*[c for c in declared if c in known], REASONS, "raw")
    return good, bad


def fold_dynamic(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Move undeclared columns into one variant column; columns that are null stay absent."""
    extra = [c for c in df.columns if c not in spec.by_name and c != META_COLUMN]
    declared = [F.col(f"`{c}`") for c in df.columns if c in spec.by_name]
    if not extra:
        meta = F.col(f"`{META_COLUMN}`") if META_COLUMN in df.columns else F.try_parse_json(F.lit("{}"))
    else:
        meta = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in extra]))
    return df.select(*declared, meta.alias(META_COLUMN))


def dynamic_get(df: DataFrame, path: str, data_type: str, alias: str | None = None) -> DataFrame:
    """Add one dynamic field as a typed column; null where it is absent or of another type."""
    name = alias or path.rsplit(".", 1)[-1].lstrip("$")
    return df.withColumn(name, F.try_variant_get(F.col(f"`{META_COLUMN}`"), path, data_type))
