"""Tables that carry their declaration, generated ids, whole quarantined rows, published names."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import query, table, workspace
from registry.tables import _PASSAGES_SQL, PASSAGES, POINTS, _activity, _passages, _points
from vectable.sources import ingest, tables
from vectable.spec import Field, TableSpec

OWN_IDS = TableSpec(
    "own_ids",
    (
        Field("row_id", "Int64", is_primary_key=True, is_auto_id=True),
        Field("label", "Int32"),
        Field("embedding", "FloatVector", dim=64),
    ),
)
DYNAMIC = TableSpec(
    "activity",
    (
        Field("event_id", "Int64", is_primary_key=True),
        Field("event_type", "VarChar", max_length=16),
        Field("point", "FloatVector", dim=1),
    ),
    enable_dynamic_field=True,
)


@query("write_read_other_buckets", "select vec_id, label from embeddings where label in (3, 7)")
def write_read_other_buckets(spark, sf_dir):
    """A table of another number of buckets, read without naming it or the declaration."""
    path = workspace(spark, "buckets")
    good, _ = ingest.conform(_points(spark, sf_dir), POINTS)
    tables.write_table(good, POINTS, path, buckets=61)
    return tables.read_table(spark, path, equals={"label": [3, 7]}).select("vec_id", "label")


@query(
    "conform_not_finite",
    """select vec_id, case when vec_id % 3 = 0 then 'embedding: not finite' else 'embedding: null element' end as reason
    from embeddings where vec_id % 3 < 2""",
)
def conform_not_finite(spark, sf_dir):
    rest, kind = F.slice("embedding", 2, 63), F.col("vec_id") % 3
    broken = (
        F.when(kind == 0, F.concat(F.array(F.lit(float("nan")).cast("float")), rest))
        .when(kind == 1, F.concat(F.array(F.lit(None).cast("float")), rest))
        .otherwise(F.col("embedding"))
    )
    _, bad = ingest.conform(_points(spark, sf_dir).withColumn("embedding", broken), POINTS)
    return bad.select("vec_id", F.explode("reasons").alias("reason"))


@query("ingest_auto_ids", "select count(*) as n, count(*) as ids, 1::bigint as low, count(*) as high from embeddings")
def ingest_auto_ids(spark, sf_dir):
    """Rows without a key column get dense ids from 1."""
    good, _ = ingest.conform(table(spark, sf_dir, "embeddings").select("label", "embedding"), OWN_IDS)
    return good.agg(
        F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.min("row_id").alias("low"), F.max("row_id").alias("high")
    )


@query(
    "quarantine_raw",
    f"""select doc_id, source, lang, n_chars::varchar as n_chars from {_PASSAGES_SQL}
    where octet_length(encode(text)) > 2000 or embedding is null""",
)
def quarantine_raw(spark, sf_dir):
    """Undeclared columns of rows that do not fit are in their raw text."""
    _, bad = ingest.conform(_passages(spark, sf_dir), PASSAGES)
    return bad.select("doc_id", *[F.get_json_object("raw", f"$.{c}").alias(c) for c in ("source", "lang", "n_chars")])


@query(
    "publish_dynamic_table",
    "select event_id, event_type, json_extract(props, '$.k')::int as k from events where event_id % 2 = 0",
)
def publish_dynamic_table(spark, sf_dir):
    """Two versions of a table with a variant column; the name is followed from its stored pointer."""
    root = workspace(spark, "published")
    rows = _activity(spark, sf_dir).withColumn("point", F.array(F.lit(1.0).cast("float")))
    tables.publish_version(rows, DYNAMIC, root, "activity", "a")
    tables.publish_version(rows.filter("event_id % 2 = 0"), DYNAMIC, root, "activity", "b", previous="a")
    found = ingest.dynamic_get(tables.read_published(spark, root, "activity"), "$.props.k", "int", "k")
    return found.select("event_id", "event_type", "k")
