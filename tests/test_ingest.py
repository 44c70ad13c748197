from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from vectable.sources import ingest, tables
from vectable.spec import Field, TableSpec

ALL = TableSpec(
    "all",
    (
        Field("id", "Int64", is_primary_key=True),
        Field("small", "Int8"),
        Field("short", "Int16", nullable=True),
        Field("flag", "Bool", nullable=True),
        Field("name", "VarChar", max_length=4),
        Field("doc", "JSON", nullable=True),
        Field("tags", "Array", element_type="Int64", max_capacity=2, nullable=True),
        Field("v", "FloatVector", dim=2),
        Field("h", "Float16Vector", dim=2),
        Field("bits", "BinaryVector", dim=64),
        Field("sp", "SparseFloatVector"),
    ),
)
SCHEMA = ("id long, small int, short int, flag string, name string, doc string, tags array<string>, "
          "v array<double>, h array<float>, bits array<long>, sp map<int,float>")
GOOD = dict(id=1, small=5, short=None, flag="true", name="abcd", doc='{"a": 1}', tags=["1", "2"],
            v=[1.0, 2.0], h=[0.1, 0.2], bits=[7], sp={3: 1.5})


def conformed(spark, **changes):
    row = {**GOOD, **changes}
    good, bad = ingest.conform(spark.createDataFrame([tuple(row.values())], SCHEMA), ALL)
    return good.collect(), [r.reasons for r in bad.collect()]


def test_a_row_that_fits(spark):
    good, bad = conformed(spark)
    assert not bad and good[0].small == 5 and good[0].flag is True and good[0].tags == [1, 2]
    assert abs(good[0].h[0] - 0.0999755859375) < 1e-12


def test_each_misfit_names_its_reason(spark):
    cases = {
        "small: bad value": dict(small=300),
        "small: null": dict(small=None),
        "flag: bad value": dict(flag="maybe"),
        "name: too long": dict(name="äöü"),
        "doc: bad value": dict(doc="{"),
        "tags: over capacity": dict(tags=["1", "2", "3"]),
        "tags: bad value": dict(tags=["x"]),
        "v: wrong dim": dict(v=[1.0]),
        "v: null": dict(v=None),
        "v: null element": dict(v=[1.0, None]),
        "bits: wrong dim": dict(bits=[1, 2]),
        "sp: negative key": dict(sp={-1: 1.0}),
        "sp: not finite": dict(sp={1: float("inf")}),
        "id: null": dict(id=None),
    }
    data = [tuple({**GOOD, "short": i, **change}.values()) for i, change in enumerate(cases.values())]
    good, bad = ingest.conform(spark.createDataFrame(data, SCHEMA), ALL)
    assert good.count() == 0
    found = {r.short: r.reasons for r in bad.collect()}
    assert len(found) == len(cases)
    for i, reason in enumerate(cases):
        assert reason in found[i], (reason, found[i])


def test_two_misfits_are_both_named_and_the_text_is_kept(spark):
    row = {**GOOD, "small": 300, "name": "too long"}
    _, bad = ingest.conform(spark.createDataFrame([tuple(row.values())], SCHEMA), ALL)
    (only,) = bad.collect()
    assert only.reasons == ["small: bad value", "name: too long"]
    assert '"small":"300"' in only.raw


def test_empty_and_missing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    good, bad = ingest.conform(empty, ALL)
    assert good.count() == bad.count() == 0
    good, bad = ingest.conform(spark.createDataFrame([tuple(GOOD.values())], SCHEMA).drop("short"), ALL)
    assert good.first().short is None and bad.count() == 0


def test_dynamic_columns_fold_and_read_back(spark):
    spec = TableSpec("d", ALL.fields, enable_dynamic_field=True)
    df = spark.createDataFrame([tuple(GOOD.values())], SCHEMA).withColumns(
        {"size": F.lit(4), "gone": F.lit(None).cast("int")}
    )
    good, bad = ingest.conform(df, spec)
    assert bad.count() == 0 and good.columns[-1] == "$meta"
    read = ingest.dynamic_get(ingest.dynamic_get(good, "$.size", "int"), "$.other", "string")
    assert read.select("size", "other").first() == (4, None)


def test_rewrite_under_the_same_spec_is_identity(spark):
    spec = TableSpec("t", (Field("id", "Int64", is_primary_key=True), Field("v", "FloatVector", dim=1),
                           Field("s", "VarChar", max_length=3)))
    df = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "abc")], "id long, v array<float>, s string")
    good, bad = tables.rewrite_table(df, spec, spec)
    assert bad.count() == 0
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, df.collect()))
    assert rows(good.select("id", "s")) == [(1, "a"), (2, "abc")]
