"""Table layout on storage, pruned reads, schema changes, profiles and versions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.operators import keys
from vectable.plans.changes import require_addable, spec_change
from vectable.sources.ingest import conform
from vectable.session import file_count
from vectable.spec import SpecError, TableSpec

BUCKET = "_bucket"
BUCKETS = 16
SPEC_SUFFIX = ".spec"
DECLARATION = "spec string, buckets int"
POINTER_SUFFIX = ".published"
POINTER = "serial bigint, version string"
MAX_FILES = 1_000_000


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write_table(
    df: DataFrame, spec: TableSpec, path: str, buckets: int = BUCKETS, mode: str = "errorifexists"
) -> None:
    """Rows routed by hash of the partition key, sorted by the clustering key.

    The range split ends with the primary key, so one partition-key value that
    holds many rows is spread over several tasks and files. The declaration and
    the number of buckets are kept beside the rows, at ``path`` + ".spec".
    """
    order = [spec.clustering_key] if spec.clustering_key else []
    order += [spec.primary_key]
    if spec.partition_key:
        key_type = spec.by_name[spec.partition_key].spark_type()
        df = df.withColumn(BUCKET, _bucket(F.col(spec.partition_key).cast(key_type), buckets))
        order = [BUCKET] + order
    files = max(spec.shard_num, min(file_count(df), MAX_FILES))
    out = df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode(mode)
    if spec.partition_key:
        out = out.partitionBy(BUCKET)
    out.parquet(path)
    kept = df.sparkSession.createDataFrame([(spec.to_json(), buckets)], DECLARATION)
    kept.coalesce(1).write.mode("overwrite").json(path + SPEC_SUFFIX)


def read_declaration(spark: SparkSession, path: str) -> tuple[TableSpec, int] | None:
    """(spec, buckets) of a table that ``write_table`` wrote; None where no declaration is kept."""
    try:
        kept = spark.read.schema(DECLARATION).json(path + SPEC_SUFFIX).first()
    except AnalysisException:
        return None
    return (TableSpec.from_json(kept.spec), kept.buckets) if kept else None


def read_table(
    spark: SparkSession,
    path: str,
    spec: TableSpec | None = None,
    equals: dict[str, object] | None = None,
    between: dict[str, tuple] | None = None,
    where: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Scan with pruning: partition-key values select buckets, ranges skip row groups.

    Declaration and number of buckets are those that the table was written with; others are refused.
    Without a kept declaration the caller names both, or buckets are not pruned.
    """
    kept = read_declaration(spark, path)
    if kept:
        if buckets not in (None, kept[1]):
            raise SpecError(f"{path} has {kept[1]} buckets, not {buckets}")
        if spec is not None and spec.partition_key != kept[0].partition_key:
            raise SpecError(f"{path} is laid out by {kept[0].partition_key!r}, not {spec.partition_key!r}")
        spec, buckets = spec or kept[0], kept[1]
    elif spec is None:
        raise SpecError(f"{path} keeps no declaration: name one")
    df = spark.read.parquet(path)
    for name, value in (equals or {}).items():
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if name == spec.partition_key and buckets and BUCKET in df.columns:
            key_type = spec.by_name[name].spark_type()
            df = df.filter(F.col(BUCKET).isin(_bucket_numbers(spark, values, key_type, buckets)))
        df = df.filter(F.col(name).isin(values))
    for name, (low, high) in (between or {}).items():
        df = df.filter(F.col(name).between(low, high))
    if where is not None:
        df = df.filter(where)
    return df.drop(BUCKET)


def _bucket_numbers(spark, values: Iterable, key_type: T.DataType, buckets: int) -> list[int]:
    rows = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", key_type)]))
    return [r[0] for r in rows.select(_bucket(F.col("v"), buckets)).distinct().collect()]


def add_columns(df: DataFrame, spec_old: TableSpec, spec_new: TableSpec) -> DataFrame:
    """Add nullable scalar columns; existing rows are null there, no row is rewritten."""
    added = require_addable(spec_old, spec_new)
    return df.withColumns({n: F.lit(None).cast(spec_new.by_name[n].spark_type()) for n in added})


def rewrite_table(
    df: DataFrame, spec_old: TableSpec, spec_new: TableSpec
) -> tuple[DataFrame, DataFrame]:
    """(good, bad) under the new declaration: cast, dropped and added columns.

    Rows are kept; those that no longer fit go to the second DataFrame.
    """
    change = spec_change(spec_old, spec_new)
    return conform(df.drop(*change.removed), spec_new)


def profile_spec(df: DataFrame, exact: Iterable[str] = ()) -> DataFrame:
    """One row per column: type, rows, nulls, byte and size ranges, distinct counts.

    One aggregation pass. Names in ``exact`` also get an exact distinct count
    and ``is_key``: no nulls and no value twice.
    """
    exact = list(exact)
    none = F.lit(None).cast("bigint")
    measures: list[Column] = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        col = F.col(f"`{f.name}`")
        sized = isinstance(f.dataType, (T.ArrayType, T.MapType))
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        length = F.when(col.isNotNull(), F.size(col)) if sized else none
        plain = not isinstance(f.dataType, (T.VariantType, T.MapType, T.ArrayType, T.StructType))
        measures += [
            F.count_if(col.isNull()).alias(f"nulls{i}"),
            (F.max(F.octet_length(col)) if text else F.max(none)).cast("bigint").alias(f"bytes{i}"),
            F.min(length).cast("bigint").alias(f"low{i}"),
            F.max(length).cast("bigint").alias(f"high{i}"),
            (F.approx_count_distinct(col) if plain else F.max(none)).alias(f"approx{i}"),
        ]
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("rows"),
            F.col(f"nulls{i}").alias("nulls"),
            F.col(f"bytes{i}").alias("max_bytes"),
            F.col(f"low{i}").alias("min_size"),
            F.col(f"high{i}").alias("max_size"),
            F.col(f"approx{i}").alias("approx_distinct"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    profile = df.agg(*measures).select(F.explode(F.array(*entries)).alias("p")).select("p.*")
    if not exact:
        return profile.withColumns({"exact_distinct": none, "is_key": F.lit(None).cast("boolean")})
    counted = [
        df.groupBy(F.col(f"`{name}`").alias("v")).count()
        .agg(F.count("v").alias("exact_distinct"), F.max("count").alias("most"))
        .withColumn("column_name", F.lit(name))
        for name in exact
    ]
    distinct = reduce(DataFrame.unionByName, counted)
    is_key = F.when(F.col("most").isNotNull(), (F.col("nulls") == 0) & (F.col("most") == 1))
    return (
        profile.join(distinct, "column_name", "left")
        .withColumn("is_key", is_key)
        .select(*profile.columns, "exact_distinct", "is_key")
    )


def publish_version(
    df: DataFrame,
    spec: TableSpec,
    root: str,
    name: str,
    version: str,
    previous: str | None = None,
    buckets: int = BUCKETS,
) -> dict:
    """Write ``root/version``, check it, then point ``name`` at it.

    Returns counts: rows, bad, duplicate_keys, and the difference to the
    ``previous`` version. Duplicate keys stop the publication, and the name
    keeps its old target. Old versions stay readable under their own path. The
    pointer is a one-row table in ``root``, a new one for each publication, so
    that it outlives the session (see ``read_published``); the session also
    gets a view of that name.
    """
    spark = df.sparkSession
    good, bad = conform(df, spec)
    path = f"{root}/{version}"
    write_table(good, spec, path, buckets)
    bad.write.mode("errorifexists").parquet(f"{path}_quarantine")
    written = spark.read.parquet(path).drop(BUCKET)
    report = {"path": path, "rows": written.count(),
              "bad": spark.read.parquet(f"{path}_quarantine").count()}
    report["duplicate_keys"] = keys.duplicate_keys(written, spec.primary_key).count()
    if report["duplicate_keys"]:
        raise SpecError(f"{report['duplicate_keys']} duplicate keys in {path}; view not moved")
    if previous:
        old = spark.read.parquet(f"{root}/{previous}").drop(BUCKET)
        shared = [c for c in old.columns if c in written.columns]
        report["columns_added"] = [c for c in written.columns if c not in shared]
        report["columns_removed"] = [c for c in old.columns if c not in shared]
        diff = keys.table_diff(old.select(*shared), written.select(*shared), spec.primary_key)
        report["diff"] = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    written.createOrReplaceTempView(name)
    serial = (_pointer(spark, root, name) or (0, None))[0] + 1
    pointer = spark.createDataFrame([(serial, version)], POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{root}/{name}{POINTER_SUFFIX}")
    return report


def _pointer(spark: SparkSession, root: str, name: str) -> tuple[int, str] | None:
    """(serial, version) of the last publication; a publication is one committed file."""
    try:
        kept = spark.read.schema(POINTER).json(f"{root}/{name}{POINTER_SUFFIX}")
    except AnalysisException:
        return None
    last = kept.agg(F.max(F.struct("serial", "version")).alias("last")).first().last
    return (last.serial, last.version) if last else None


def read_published(spark: SparkSession, root: str, name: str, **options) -> DataFrame:
    """The version that ``name`` points at, from any session."""
    last = _pointer(spark, root, name)
    if last is None:
        raise SpecError(f"nothing is published as {name!r} in {root}")
    return read_table(spark, f"{root}/{last[1]}", **options)
