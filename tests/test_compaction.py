import pytest
from pyspark.sql import functions as F

from chunkloom.operators import compaction as C

FILES = "file_id bigint, layer_id bigint, mip int, chunk_name string, n_bytes bigint, written_at timestamp_ntz, listed_at timestamp_ntz, x0 string"
SCALES = "layer_id bigint, mip int, chunk_sizes array<array<int>>, volume_size array<bigint>, voxel_offset array<bigint>, sharding struct<type string, preshift_bits int, hash string, minishard_bits int, shard_bits int>"
TIMES = ["2024-01-01 00:00:00", "2024-02-01 00:00:00"]


def listing(spark, rows):
    df = spark.createDataFrame([(i, la, m, n, b, w, None, "clash") for i, la, m, n, b, w in rows], FILES.replace("timestamp_ntz", "string"))
    return df.withColumn("written_at", F.col("written_at").cast("timestamp_ntz")).withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def scales(spark):
    spec = ("s", 0, "identity", 1, 5)
    rows = [(1, 0, [[10, 10, 10]], [35, 20, 10], [-5, 0, 0], spec), (1, 0, [[10, 10, 10]], [35, 20, 10], [-5, 0, 0], spec), (2, 0, [[10, 10, 10]], [10, 10, 10], [0, 0, 0], None), (3, 0, [[10, 10, 10]], [10, 10, 10], None, spec), (4, 0, [[8, 8, 8]], [8, 8, 8], [0, 0, 0], ("s", 0, "murmurhash3_x86_128", 0, 0)), (5, 0, [[8, 8, 8]], [8, 8, 8], [0, 0, 0], ("s", 0, "identity", 0, 0)), (None, 0, [[8, 8, 8]], [8, 8, 8], [0, 0, 0], spec)]
    return spark.createDataFrame(rows, SCALES)


ROWS = [
    (1, 1, 0, "-5-5_0-10_0-10", 5, TIMES[0]), (2, 1, 0, "-5-5_0-10_0-10.gz", 9, TIMES[1]), (1, 1, 0, "-5-5_0-10_0-10", 5, TIMES[0]),
    (3, 1, 0, "25-30_10-20_0-10.br", 4, None),  # cut at the end of the volume
    (4, 1, 0, "25-35_10-20_0-10", 4, TIMES[0]), (5, 1, 0, "-4-6_0-10_0-10", 4, TIMES[0]), (6, 1, 0, "5-15_0-10_0-10.gzip", 4, TIMES[0]), (7, 1, 0, "5-15_0-10_0-10.gz", 0, TIMES[0]), (8, 1, 0, "info", 4, TIMES[0]),
    (9, 1, 0, "-15--5_0-10_0-10", 4, TIMES[0]), (10, 2, 0, "0-10_0-10_0-10", 4, TIMES[0]), (11, 3, 0, "0-10_0-10_0-10", 4, TIMES[0]), (12, 4, 0, "0-8_0-8_0-8", 4, TIMES[0]), (13, 5, 0, "0-8_0-8_0-8.zstd", 4, TIMES[0]),
    (14, None, 0, "0-8_0-8_0-8", 4, TIMES[0]), (15, 1, None, "0-8_0-8_0-8", 4, TIMES[0]), (16, 1, 0, None, 4, TIMES[0]), (17, 1, 0, "5-15_10-20_0-10", None, TIMES[0]), (18, 1, 1, "-5-5_0-10_0-10", 5, TIMES[0]),
]
WANT = {(1, 0, 0, 0, 0, "00", 2), (1, 0, 3, 1, 0, "03", 3), (5, 0, 0, 0, 0, "0", 13)}


def result(df):
    return {(r["layer_id"], r["mip"], r["gx"], r["gy"], r["gz"], r["shard"], r["file_id"]) for r in df.collect()}


def test_each_stored_chunk_once(spark, scales, tmp_path):
    listing(spark, ROWS).repartition(4).write.parquet(f"{tmp_path}/files")
    assert result(C.compact_chunks(spark, f"{tmp_path}/files", scales)) == WANT


def test_small_batches_resume_and_replace(spark, scales, tmp_path):
    out, progress, src = f"{tmp_path}/out", f"{tmp_path}/progress", f"{tmp_path}/files"
    listing(spark, ROWS[:6]).repartition(3).write.parquet(src)
    C.compact_chunks(spark, src, scales, out, progress, batch_bytes=1)
    listing(spark, ROWS[6:]).repartition(3).write.mode("append").parquet(src)
    assert result(C.compact_chunks(spark, src, scales, out, progress, batch_bytes=1)) == WANT
    before = {p.name for p in (tmp_path / "out").iterdir()}
    assert result(C.compact_chunks(spark, src, scales, out, progress)) == WANT  # nothing new
    assert {p.name for p in (tmp_path / "out").iterdir()} == before and len(before) > 2


def test_a_single_file_and_an_empty_one(spark, scales, tmp_path):
    listing(spark, ROWS).coalesce(1).write.parquet(f"{tmp_path}/files")
    part = next((tmp_path / "files").glob("part*.parquet"))
    assert result(C.compact_chunks(spark, str(part), scales)) == WANT
    listing(spark, []).coalesce(1).write.parquet(f"{tmp_path}/none")
    assert C.compact_chunks(spark, f"{tmp_path}/none", scales).count() == 0
