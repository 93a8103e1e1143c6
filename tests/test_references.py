from datetime import datetime as dt

from graphloom.operators import references as R

D = dt(2024, 5, 1)


def _frames(spark, joins=None):
    rule = "id string, joins array<struct<left:string,operator:string,right:string,purpose:string>>, loaded_at timestamp, status string"
    entity = "entity_id string, tables array<string>, rest_resources array<string>, loaded_at timestamp"
    column = "table_name string, name string, loaded_at timestamp, deleted_at timestamp"
    return {
        "validated_rules": spark.createDataFrame(joins if joins is not None else [("r1", [("a", "=", " t1.C1 ", None), ("a", "=", "T1.GONE", None), ("a", "=", "T1.LATE", None), ("a", "=", "T9.X", None), ("a", "=", " ", None), ("a", "=", None, None)], D, "x"), ("r1", [("a", "=", "T9.X", None)], D, "x"), ("r2", None, D, "x"), ("r3", [None], D, "x")], rule),
        "entity_aliases": spark.createDataFrame([("e1", ["T1", "t1 ", "NONE", None, ""], None, D), ("e2", [], ["Res A", "nope"], None)], entity),
        "physical_column": spark.createDataFrame([("T1", "C1", dt(2024, 1, 1), None), ("T1", "C1", dt(2025, 1, 1), None), ("T1", "GONE", dt(2024, 1, 1), D), ("T1", "LATE", dt(2024, 6, 1), None)], column),
        "physical_table": spark.createDataFrame([("T1", dt(2024, 1, 1), None)], "table_name string, loaded_at timestamp, deleted_at timestamp"),
        "rest_resource": spark.createDataFrame([("res a", dt(2024, 1, 1), None)], "name string, loaded_at timestamp, deleted_at timestamp"),
    }


def test_missing_deleted_late(spark, tables):
    root = tables(**_frames(spark))
    for slice_rows in (200_000, 1):  # with 1 every key that is named twice is sliced
        got = {(r.record_id, r.ref_value): r.status for r in R.catalog_references(spark, root, slice_rows).collect()}
        assert got == {
            ("r1", " t1.C1 "): "valid", ("r1", "T1.GONE"): "deleted", ("r1", "T1.LATE"): "late", ("r1", "T9.X"): "missing",
            ("e1", "T1"): "valid", ("e1", "t1 "): "valid", ("e1", "NONE"): "missing", ("e2", "Res A"): "valid", ("e2", "nope"): "missing",
        }
    assert R.orphan_references(spark, root).count() == 5
    assert sum(r.n_refs for r in R.orphan_report(spark, root).collect()) == 5


def test_empty_tables(spark, tables):
    frames = {n: f.limit(0) for n, f in _frames(spark).items()}
    assert R.orphan_references(spark, tables(**frames)).count() == 0
