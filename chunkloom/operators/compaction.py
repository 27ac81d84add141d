"""Checkpointed streaming compaction of very many small objects.

A file stream discovers each source file once and remembers it in its checkpoint; all
that is available is processed in batches bounded by bytes.  A batch is written
consolidated under its own batch number, replacing what an interrupted attempt left
there, so a retry neither loses nor doubles records.  Rows of a batch are rebalanced
by size, which merges small partitions and splits large ones (a layer may hold a
third of all objects) into files of the session's advisory size.

Defined cases (chunk listings): empty objects, objects whose name is no box of one
grid chunk or has another suffix, scales without sharding or with nulls in their
grid, hashes other than identity, and listings with a null layer or mip are left out;
repeated listings and chunks stored more than once come out once, as the object
written last (null times first; ties by the larger file_id); empty tables give an
empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions import grid
from chunkloom.operators.flatten import once
from chunkloom.session import fresh_path

#: Bytes of source files that one batch takes in.
BATCH_BYTES = 4 << 30


def readable_source(spark: SparkSession, source: str) -> str:
    """A file stream reads a directory or a pattern; a single file becomes a pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return f"{source[:-1]}[{source[-1]}]" if single else source


def compact_stream(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame], batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the compactor over what is available in ``source``; the table in ``out``.

    Called again with the same ``checkpoint``, it takes only files that came since.
    ``shape`` maps a batch to the rows to store.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(readable_source(spark, source))

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stored(spark, out, shape(spark.createDataFrame([], schema)).schema)


def stored(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All batches of a compacted table; empty if nothing was ever written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def grid_specs(scales: DataFrame) -> DataFrame:
    """One row for each sharded scale: grid origin, steps, extents and shard bits."""
    s = scales.where("layer_id is not null and mip is not null and sharding is not null and sharding.hash = 'identity'")
    cols = [F.col("layer_id"), F.col("mip")]
    for i, d in enumerate("xyz"):
        cols += [F.get("voxel_offset", F.lit(i)).cast("bigint").alias(f"o{d}"), F.get(F.get("chunk_sizes", F.lit(0)), F.lit(i)).cast("bigint").alias(f"c{d}"), F.get("volume_size", F.lit(i)).cast("bigint").alias(f"s{d}")]
    cols += [F.col(f"sharding.{b}_bits").alias(b) for b in ("preshift", "minishard", "shard")]
    out = s.select(*cols).dropna().distinct()
    out = out.where(" and ".join(f"c{d} > 0 and s{d} > 0" for d in "xyz"))
    places = grid.bit_places([grid.ceil_div(F.col(f"s{d}"), F.col(f"c{d}")) for d in "xyz"])
    return once(out, out.columns, **{f"p{d}": p for d, p in zip("xyz", places)})


def placed_chunks(listing: DataFrame, specs: DataFrame) -> DataFrame:
    """Listed objects that are one grid chunk of a sharded scale, with their shard.

    Columns: layer_id, mip, gx, gy, gz, shard, minishard, chunk_code, and of the
    object file_id, n_bytes, written_at.
    """
    box = ["x0", "x1", "y0", "y1", "z0", "z1"]
    named = listing.where("n_bytes > 0 and layer_id is not null and mip is not null").where(F.col("chunk_name").rlike(grid.CHUNK_NAME))
    named = named.select("file_id", "layer_id", "mip", "n_bytes", "written_at", *[c.alias(n) for c, n in zip(grid.box_of_name(F.col("chunk_name")), box)]).dropna(subset=box)
    j = named.join(specs, ["layer_id", "mip"])
    for d in "xyz":
        o, c, s = F.col(f"o{d}"), F.col(f"c{d}"), F.col(f"s{d}")
        lo, hi = F.col(f"{d}0"), F.col(f"{d}1")
        j = j.where((lo >= o) & (lo < o + s) & (F.pmod(lo - o, c) == 0) & (hi == F.least(lo + c, o + s)))
        j = j.withColumn(f"g{d}", grid.floor_div(lo - o, c))
    code = grid.morton_code([F.col(f"g{d}") for d in "xyz"], [F.col(f"p{d}") for d in "xyz"])
    j = once(j, [c for c in j.columns if c not in box], chunk_code=code)
    minishard, shard = grid.shard_location(grid.drop_bits(F.col("chunk_code"), F.col("preshift")), F.col("minishard"), F.col("shard"))
    return j.select("layer_id", "mip", "gx", "gy", "gz", shard.alias("shard"), minishard.alias("minishard"), "chunk_code", "file_id", "n_bytes", "written_at")


CHUNK = ["layer_id", "mip", "gx", "gy", "gz", "shard", "minishard", "chunk_code"]


def one_per_chunk(placed: DataFrame) -> DataFrame:
    """The object written last for every chunk; merges on the map side."""
    last = F.struct("written_at", "file_id", "n_bytes")
    return placed.groupBy(*CHUNK).agg(F.max(last).alias("kept")).select(*CHUNK, "kept.*")


def compact_chunks(spark: SparkSession, source: str, scales: DataFrame, out: str | None = None, checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Stored chunks, each once, assigned to their shards (columns of ``placed_chunks``)."""
    specs = grid_specs(scales)
    out, checkpoint = out or fresh_path(spark, "compacted"), checkpoint or fresh_path(spark, "progress")
    shape = lambda batch: one_per_chunk(placed_chunks(batch, specs)).hint("rebalance", "layer_id", "mip", "shard")
    schema = spark.read.parquet(source).schema
    return one_per_chunk(compact_stream(spark, source, schema, out, checkpoint, shape, batch_bytes))
