"""Lookups by related object leave out no object."""

from chunkloom.plans import object_queries


def test_objects_with_few_annotations_are_looked_up(spark, tmp_path):
    rows = [(i, [5]) for i in range(20)] + [(20, [6, 5]), (21, []), (22, None), (None, [6])]
    spark.createDataFrame(rows, "ids bigint, skeleton_id array<bigint>").write.parquet(f"{tmp_path}/annotations.parquet")
    got = {(r["ids"], r["related_id"]) for r in object_queries.QUERIES["annotations_by_relationship"](spark, str(tmp_path)).collect()}
    assert got == {(i, 5) for i in range(21)} | {(20, 6)}
