from __future__ import annotations

import pytest

from vectable.plans.changes import require_addable, spec_change
from vectable.spec import Field, SpecError, TableSpec

ID = Field("id", "Int64", is_primary_key=True)
VEC = Field("v", "FloatVector", dim=4)


def spec(*fields, **options):
    return TableSpec("t", (ID, VEC, *fields), **options)


def test_defaults():
    t = spec()
    assert (t.delete_protection, t.description, t.auto_id, t.dynamic) == (True, "", False, False)
    assert (t.shard_num, t.consistency_level) == (1, "Strong")


@pytest.mark.parametrize(
    "fields",
    [
        (VEC,),
        (ID,),
        (ID, VEC, Field("b", "Int64", is_primary_key=True)),
        (ID, VEC, Field("v", "Int64")),
        (ID, VEC, Field("x", "varchar")),
        (ID, VEC, Field("x", "VarChar")),
        (ID, VEC, Field("x", "VarChar", max_length=65536)),
        (ID, VEC, Field("x", "Array", element_type="Int64")),
        (ID, VEC, Field("x", "Array", element_type="Nope", max_capacity=3)),
        (ID, Field("v", "FloatVector")),
        (ID, Field("v", "BinaryVector", dim=12)),
        (ID, Field("v", "FloatVector", dim=4, nullable=True)),
        (Field("id", "Int64", is_primary_key=True, nullable=True), VEC),
        (ID, VEC, Field("a", "Int8", is_partition_key=True), Field("b", "Int8", is_partition_key=True)),
        (ID, VEC, Field("a", "Int8", is_clustering_key=True), Field("b", "Int8", is_clustering_key=True)),
    ],
)
def test_broken_rules_raise(fields):
    with pytest.raises(SpecError):
        TableSpec("t", fields)


@pytest.mark.parametrize("options", [{"consistency_level": "strong"}, {"shard_num": 0},
                                     {"properties": {"partition_key_isolation": True}}])
def test_broken_options_raise(options):
    with pytest.raises(SpecError):
        spec(**options)


def test_changes():
    old = spec(Field("a", "VarChar", max_length=8))
    new = spec(Field("a", "VarChar", max_length=9), Field("b", "Int8", nullable=True))
    change = spec_change(old, new)
    assert (change.added, change.removed, change.changed) == (("b",), (), ("a",))
    with pytest.raises(SpecError):
        require_addable(old, new)
    with pytest.raises(SpecError):
        require_addable(spec(), spec(Field("s", "Int64")))
    with pytest.raises(SpecError):
        require_addable(spec(), spec(Field("w", "FloatVector", dim=2)))
    assert require_addable(spec(), spec(Field("s", "Int64", nullable=True))) == ("s",)
