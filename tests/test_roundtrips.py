"""Round trips through files keep everything that was written."""

import pytest

from chunkloom.plans import io_queries
from chunkloom.sources import objects


def test_small_tiles_are_written_and_read(spark, tmp_path, monkeypatch):
    big, small = "0-10_0-10_0-10.spatial", "10-20_0-10_0-10.spatial"
    spark.createDataFrame([(1, f"{big}.gz"), (2, small)], "id bigint, filename string").write.parquet(f"{tmp_path}/index_files.parquet")
    entries = {(big, k, 0, 10, 0, 10, 0, 10) for k in range(2**60, 2**60 + 41)} | {(small, k, 10, 20, 0, 10, 0, 10) for k in (5, 2**60)}
    spark.createDataFrame([(e[1], 1 if e[0] == big else 2) for e in entries], "label bigint, fid bigint").write.parquet(f"{tmp_path}/file_lookup.parquet")
    packed, through = [], io_queries._through_shards
    monkeypatch.setattr(io_queries, "_through_shards", lambda items: packed.append(items.count()) or through(items))
    order = ["filename", "label", "x0", "x1", "y0", "y1", "z0", "z1"]
    got = lambda name: sorted(map(tuple, io_queries.QUERIES[name](spark, str(tmp_path)).select(*order).collect()))
    assert got("spatial_index_file_roundtrip") == sorted(entries)
    assert packed == [2]


def test_annotations_without_a_class_come_back(spark, tmp_path):
    rows = [(1, [1.0, 2.0, 3.0], 4), (2, [1.0, 2.0, 3.0], None), (3, [5e5, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 4)]
    spark.createDataFrame(rows, "ids bigint, geometry array<double>, class_label int").write.parquet(f"{tmp_path}/annotations.parquet")
    got = lambda name: sorted(map(tuple, io_queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got("annotation_file_roundtrip") == [(i, *p, k) for i, p, k in rows[:3]]


def test_a_code_for_null_is_no_value(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0, -7), (2, 1.0, 2.0, 3.0, None)], "ids bigint, x float, y float, z float, k int")
    for nulls, said in (({"k": -7}, "its code for null"), (None, "no code")):
        with pytest.raises(Exception, match=said):
            objects.write_annotation_cells(rows, str(tmp_path), (10, 10, 10), [("k", "int32")], nulls)


def test_faces_edges_and_vertices_come_back(spark, tmp_path):
    rows = [(7, "A", 1 + n, n, 10.0 * n, n, 1.0) for n in (1, 2, 3)] + [(7, "N", 9, 2, 5.0, 5, 1.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_returnflag string, l_partkey bigint, l_suppkey bigint, l_quantity double, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = lambda name: sorted(map(tuple, io_queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got("mesh_file_roundtrip_faces") == [(7, 0, 1, 2)]
    assert got("skeleton_file_roundtrip_edges") == [(7, 0, 1), (7, 1, 2)]
    assert got("skeleton_file_roundtrip_vertices") == [(7, 0, 2.0, 1.0, 10.0), (7, 1, 3.0, 2.0, 20.0), (7, 2, 4.0, 3.0, 30.0), (7, 3, 9.0, 2.0, 5.0)]
