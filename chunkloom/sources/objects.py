"""Files of meshes, skeletons, annotations and the spatial index, read and written in parallel.

Objects are small files named by their key, or entries of shard files.  Reading decodes
Arrow batches of them; writing groups rows by object, encodes and stores them under
deterministic names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.boxes import Corners, hull_of
from chunkloom.operators import annotations, sharding
from chunkloom.operators.sharding import Spec
from chunkloom.operators.spatial import BOX, INDEX_NAME
from chunkloom.session import cut
from chunkloom.sources import codecs, shards
from chunkloom.sources.layers import local, read_object, write_object


def listing(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """``name, n_bytes`` of the files of a directory; contents are not read.

    One task scans the directory, a piece at a time, and deals the names out; the driver
    never holds them.
    """
    root = local(path)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            rows = []
            with os.scandir(root) as found:
                for e in found:
                    if re.search(pattern, e.name) and e.is_file():
                        rows.append((e.name, e.stat().st_size))
                    if len(rows) == 8192:
                        yield pd.DataFrame(rows, columns=["name", "n_bytes"])
                        rows = []
            yield pd.DataFrame(rows, columns=["name", "n_bytes"])

    return spark.range(0, 1, 1, 1).mapInPandas(scan, "name string, n_bytes bigint").repartition("name")


def raw_objects(spark: SparkSession, path: str, pattern: str = "", names: DataFrame | None = None) -> DataFrame:
    """``name, n_bytes, payload`` of the files, undecoded, or of those in ``names``.

    Names of objects may hold colons, which Hadoop's paths do not allow.
    """
    root = local(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                data = []
                for name in part["name"]:
                    with open(f"{root}/{name}", "rb") as f:
                        data.append(f.read())
                yield part.assign(payload=data)

    files = listing(spark, path, pattern)
    if names is not None:
        files = files.join(names, "name", "left_semi")
    return files.mapInPandas(read, "name string, n_bytes bigint, payload binary")


def _unzipped(name: str, data: bytes) -> bytes:
    how = next((h for s, h in codecs.SUFFIXES.items() if name.endswith(s)), "")
    return codecs.stream(how)[1](data)


def _decoded(files: DataFrame, schema: str, each: Callable[[str, bytes], dict]) -> DataFrame:
    """Applies a decoder to every file; ``each`` returns the columns of the file's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [each(name, _unzipped(name, bytes(data))) for name, data in zip(pdf["name"], pdf["payload"])]
            if found:
                keys = found[0].keys()
                yield pd.DataFrame({k: np.concatenate([np.asarray(f[k]) for f in found]) for k in keys})

    return files.select("name", "payload").mapInPandas(run, schema)


def _stored(rows: DataFrame, keys: Sequence[str], encode: Callable[[pd.DataFrame], tuple[str, bytes]]) -> DataFrame:
    """Writes one object per key; ``path, n_bytes``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path, data = encode(pdf)
        write_object(path, data)
        return pd.DataFrame({"path": [path], "n_bytes": [len(data)]})

    return cut(rows.groupBy(*keys).applyInPandas(run, "path string, n_bytes bigint"), "stored")


# --- meshes: a manifest "segid:0" and fragments "segid:0:frag" -------------------------


def _flat(rows: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Per segment its rows, sorted, as one flat array; an object is what fits a file."""
    entry = F.struct(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.array(*[e[f"_{i}"] for i in range(len(cols))])))
    return rows.groupBy("segid").agg(flat.alias(out))


def mesh_payloads(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``label, payload`` of ``segid, vid, x, y, z`` and ``segid, v1, v2, v3`` rows."""

    @F.pandas_udf("binary")
    def encode(v: pd.Series, f: pd.Series) -> pd.Series:
        none = np.zeros((0, 3))
        return pd.Series([codecs.encode_mesh(np.asarray(a).reshape(-1, 4)[:, 1:], none if b is None else np.asarray(b).reshape(-1, 3)) for a, b in zip(v, f)])

    both = _flat(vertices, ["vid", "x", "y", "z"], "v").join(_flat(faces, ["v1", "v2", "v3"], "f"), "segid", "left")
    return both.select(F.col("segid").alias("label"), encode("v", "f").alias("payload"))


def _store_payloads(items: DataFrame, name: Callable[[int], str], extra: Callable[[int], None] | None = None) -> DataFrame:
    """Writes every payload under its name; ``path, n_bytes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = [name(int(x)) for x in pdf["label"]]
            for x, at, data in zip(pdf["label"], paths, pdf["payload"]):
                write_object(at, bytes(data))
                if extra:
                    extra(int(x))
            yield pd.DataFrame({"path": paths, "n_bytes": [len(d) for d in pdf["payload"]]})

    return cut(items.mapInPandas(run, "path string, n_bytes bigint"), "stored")


def write_meshes(vertices: DataFrame, faces: DataFrame, path: str, frag: str = "1") -> DataFrame:
    """One manifest and one fragment for each segment."""
    path = local(path)
    manifest = lambda s: write_object(f"{path}/{s}:0", json.dumps({"fragments": [f"{s}:0:{frag}"]}).encode())
    return _store_payloads(mesh_payloads(vertices, faces), lambda s: f"{path}/{s}:0:{frag}", manifest)


def mesh_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``segid, fragment, pos`` of all manifests (names ``segid:0``)."""
    files = raw_objects(spark, path, r"^\d+:0$")
    parsed = F.from_json(F.decode("payload", "utf-8"), "fragments array<string>")["fragments"]
    return files.select(F.regexp_extract("name", r"^(\d+):0$", 1).cast("bigint").alias("segid"), F.posexplode(parsed).alias("pos", "fragment"))


def read_meshes(spark: SparkSession, path: str, segids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces per fragment, in the shape that ``operators.mesh`` takes."""
    manifests = mesh_manifests(spark, path)
    if segids is not None:
        manifests = manifests.join(segids.select(F.col(segids.columns[0]).alias("segid")).distinct(), "segid", "left_semi")
    return decode_meshes(raw_objects(spark, path, r"^\d+:\d+:", manifests.select(F.col("fragment").alias("name"))))


def decode_meshes(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of ``name, payload`` rows; the name begins with the segment."""

    def vertex_rows(name: str, data: bytes) -> dict:
        v, _ = codecs.decode_mesh(data)
        return {"segid": np.full(len(v), int(name.split(":")[0])), "frag": np.full(len(v), name, dtype=object), "vid": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]}

    def face_rows(name: str, data: bytes) -> dict:
        _, f = codecs.decode_mesh(data)
        return {"segid": np.full(len(f), int(name.split(":")[0])), "frag": np.full(len(f), name, dtype=object), **{f"v{i + 1}": f[:, i].astype(np.int64) for i in range(3)}}

    return _decoded(wanted, "segid bigint, frag string, vid bigint, x float, y float, z float", vertex_rows), _decoded(wanted, "segid bigint, frag string, v1 bigint, v2 bigint, v3 bigint", face_rows)


def object_exists(names: DataFrame, path: str, col: str = "name") -> DataFrame:
    """``name, is_stored`` of the given names of objects, each once."""
    root = local(path)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(is_stored=[any(os.path.exists(f"{root}/{n}{x}") for x in ("", *codecs.SUFFIXES)) for n in pdf["name"]])

    return names.select(F.col(col).cast("string").alias("name")).dropna().distinct().mapInPandas(look, "name string, is_stored boolean")


def delete_objects(names: DataFrame, path: str, col: str = "name") -> DataFrame:
    """Deletes objects; the ``name`` of each that was there."""
    root = local(path)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gone = []
            for n in pdf["name"]:
                for x in ("", *codecs.SUFFIXES):
                    try:
                        os.remove(f"{root}/{n}{x}")
                        gone.append(n)
                    except FileNotFoundError:
                        continue
            yield pd.DataFrame({"name": gone}, dtype=object)

    return cut(names.select(F.col(col).cast("string").alias("name")).dropna().distinct().mapInPandas(remove, "name string"), "deleted")


def _manifest_names(segids: DataFrame, lod: int = 0) -> DataFrame:
    return segids.select(F.col(segids.columns[0]).cast("bigint").alias("segid")).dropna().distinct().select("segid", F.concat(F.col("segid").cast("string"), F.lit(f":{lod}")).alias("name"))


def mesh_exists(segids: DataFrame, path: str) -> DataFrame:
    """``segid, is_stored``: whether a mesh has a manifest."""
    named = _manifest_names(segids)
    return named.join(object_exists(named, path), "name").select("segid", "is_stored")


def delete_meshes(segids: DataFrame, path: str) -> DataFrame:
    """Deletes the manifests of meshes and the fragments that they name; the ``name`` of each."""
    named = _manifest_names(segids)
    fragments = mesh_manifests(segids.sparkSession, path).join(named.select("segid"), "segid", "left_semi").select(F.col("fragment").alias("name"))
    doomed = cut(fragments.unionByName(named.select("name")), "doomed")  # read before manifests go
    return delete_objects(doomed, path)


# --- multi-resolution meshes: data "segid" and manifest "segid.index", or in shard files ------


def _z_order(p: Sequence[int]) -> int:
    return sum((int(v) >> i & 1) << (3 * i + d) for i in range(32) for d, v in enumerate(p))


def pack_lods(fragments: DataFrame, chunk_shape: Sequence[float], origin: Sequence[float]) -> DataFrame:
    """``label, data, manifest`` of encoded fragments (``segid, lod, px, py, pz, payload``).

    Fragments of a level follow the Z curve; a level without fragments is an empty one.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        lods = int(pdf["lod"].max()) + 1
        positions, sizes, data = [], [], []
        for k in range(lods):
            part = sorted(pdf[pdf["lod"] == k][["px", "py", "pz", "payload"]].itertuples(index=False), key=lambda r: _z_order(r[:3]))
            positions.append(np.array([r[:3] for r in part], np.uint32).reshape(-1, 3))
            sizes.append(np.array([len(r[3]) for r in part], np.uint32))
            data += [bytes(r[3]) for r in part]
        m = {"chunk_shape": chunk_shape, "grid_origin": origin, "lod_scales": [2.0**k for k in range(lods)], "vertex_offsets": np.zeros((lods, 3)), "positions": positions, "sizes": sizes}
        return pd.DataFrame({"label": [pdf["segid"].iloc[0]], "data": [b"".join(data)], "manifest": [codecs.encode_manifest(m)]})

    return fragments.select("segid", "lod", "px", "py", "pz", "payload").groupBy("segid").applyInPandas(build, "label bigint, data binary, manifest binary")


def _lod_ranges(manifest: bytes) -> list[list[tuple[tuple[int, ...], int, int]]]:
    """Per level (position, first byte, size) of its fragments in the mesh's data."""
    m, at, out = codecs.decode_manifest(manifest), 0, []
    for p, s in zip(m["positions"], m["sizes"]):
        level = []
        for xyz, n in zip(p.tolist(), s.tolist()):
            level.append((tuple(xyz), at, n))
            at += n
        out.append(level)
    return out


def data_bytes(manifest: bytes) -> int:
    """How long the data of a multi-resolution mesh are."""
    return int(sum(int(s.sum()) for s in codecs.decode_manifest(manifest)["sizes"]))


def write_lods(items: DataFrame, path: str) -> DataFrame:
    """One data object and one manifest for each mesh; ``path, n_bytes`` of the data."""
    root = local(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, data, manifest in zip(pdf["label"], pdf["data"], pdf["manifest"]):
                write_object(f"{root}/{x}", bytes(data))
                write_object(f"{root}/{x}.index", bytes(manifest))
            yield pd.DataFrame({"path": [f"{root}/{x}" for x in pdf["label"]], "n_bytes": [len(d) for d in pdf["data"]]})

    return cut(items.select("label", "data", "manifest").mapInPandas(run, "path string, n_bytes bigint"), "stored")


def write_lod_shards(items: DataFrame, path: str, spec: Spec) -> DataFrame:
    """Multi-resolution meshes in shard files; ``path, n_bytes``."""
    root = local(path)
    minishard, shard = spec.location(F.col("label"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, dict[int, tuple[bytes, bytes]]] = {}
        for m, x, data, manifest in zip(pdf["minishard"], pdf["label"], pdf["data"], pdf["manifest"]):
            groups.setdefault(int(m), {})[int(x) & (2**64 - 1)] = (bytes(data), bytes(manifest))
        content, at = sharding.assemble_meshes(spec, groups), f"{root}/{pdf['shard'].iloc[0]}.shard"
        write_object(at, content)
        return pd.DataFrame({"path": [at], "n_bytes": [len(content)]})

    rows = items.select("label", "data", "manifest", minishard.alias("minishard"), shard.alias("shard"))
    return cut(rows.groupBy("shard").applyInPandas(build, "path string, n_bytes bigint"), "stored")


_FRAGMENTS = "segid bigint, lod int, px bigint, py bigint, pz bigint, payload binary"


def _level(manifest: bytes, lod: int) -> tuple[int, list[tuple[tuple[int, ...], int, int]]]:
    """A level by its number, -1 is the coarsest; without empty fragments."""
    levels = _lod_ranges(manifest)
    if not -len(levels) <= lod < len(levels):
        raise LookupError(f"no level {lod} of {len(levels)}")
    return lod % len(levels), [f for f in levels[lod] if f[2]]


def read_lods(segids: DataFrame, path: str, lod: int = 0, allow_missing: bool = False, spec: Spec | None = None) -> DataFrame:
    """``segid, lod, px, py, pz, payload``: the encoded fragments of one level of meshes.

    Only the manifest and the level's bytes are read.  A mesh that is not there is an error
    unless ``allow_missing``.
    """
    root = local(path)

    def cut_up(x: int, manifest: bytes, read: Callable[[int, int], bytes]) -> pd.DataFrame:
        k, level = _level(manifest, lod)
        rows = []
        if level:
            first, last = level[0][1], level[-1][1] + level[-1][2]
            data = read(first, last - first)
            rows = [(x, k, *p, data[a - first : a - first + n]) for p, a, n in level]
        return pd.DataFrame(rows, columns=["segid", "lod", "px", "py", "pz", "payload"])

    def from_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf["label"]:
                manifest = read_object(f"{root}/{x}.index")
                if manifest is None:
                    if not allow_missing:
                        raise FileNotFoundError(f"no mesh {x}")
                    continue
                with open(f"{root}/{x}", "rb") as f:
                    yield cut_up(x, manifest, lambda a, n: (f.seek(a), f.read(n))[1])  # noqa: B023

    def from_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, shard in shards.each_shard(batches, root, spec):
            keys = part["label"].to_numpy(np.int64)
            offsets, _ = shard.find(keys.view(np.uint64))
            if (offsets < 0).any() and not allow_missing:
                raise FileNotFoundError(f"no mesh {keys[offsets < 0][0]}")
            for k, manifest in shard.payloads(keys.view(np.uint64)):
                begin = int(offsets[k]) - data_bytes(manifest)
                yield cut_up(int(keys[k]), manifest, lambda a, n: shard.read(begin + a, n))  # noqa: B023

    if spec:
        return shards.by_shard(segids, spec, segids.columns[0]).mapInPandas(from_shards, _FRAGMENTS)
    wanted = segids.select(F.col(segids.columns[0]).cast("bigint").alias("label")).dropna().distinct()
    return wanted.mapInPandas(from_files, _FRAGMENTS)


def lod_fragments(spark: SparkSession, path: str) -> DataFrame:
    """``segid, lod, frag, px, py, pz, size, offset`` of ``segid.index`` manifests."""

    def each(name: str, data: bytes) -> dict:
        rows = [(int(name.split(".")[0]), lod, i, *xyz, n, at) for lod, level in enumerate(_lod_ranges(data)) for i, (xyz, at, n) in enumerate(level)]
        table = np.array(rows, np.int64).reshape(-1, 8)
        return {c: table[:, i] for i, c in enumerate(("segid", "lod", "frag", "px", "py", "pz", "size", "offset"))}

    return _decoded(raw_objects(spark, path, r"\.index$"), "segid bigint, lod int, frag int, px bigint, py bigint, pz bigint, size bigint, offset bigint", each)


# --- skeletons: one object "segid" ------------------------------------------------------


def skeleton_payloads(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``label, payload`` of ``segid, vid, x, y, z`` (renumbered from 0 in order) and ``segid, a, b`` rows."""

    @F.pandas_udf("binary")
    def encode(v: pd.Series, e: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(v, e):
            pts = np.asarray(a).reshape(-1, 4)
            pairs = np.zeros((0, 2)) if b is None else np.searchsorted(pts[:, 0], np.asarray(b).reshape(-1, 2))
            out.append(codecs.encode_skeleton(pts[:, 1:], pairs))
        return pd.Series(out)

    both = _flat(vertices, ["vid", "x", "y", "z"], "v").join(_flat(edges, ["a", "b"], "e"), "segid", "left")
    return both.select(F.col("segid").alias("label"), encode("v", "e").alias("payload"))


def write_skeletons(vertices: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """One object for each segment."""
    path = local(path)
    return _store_payloads(skeleton_payloads(vertices, edges), lambda s: f"{path}/{s}")


def list_skeletons(spark: SparkSession, path: str) -> DataFrame:
    """``segid`` of all skeletons of a folder; names that are no number are no skeletons."""
    return listing(spark, path, r"^\d+(\.(gz|zstd))?$").select(F.split("name", r"\.")[0].cast("bigint").alias("segid")).distinct()


def read_skeletons(spark: SparkSession, path: str, transform: Sequence[Sequence[float]] = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0))) -> tuple[DataFrame, DataFrame]:
    """Vertices in physical space and edges; names with a colon are no skeletons."""
    return decode_skeletons(raw_objects(spark, path, r"^\d+(\.(gz|zstd))?$"), transform)


IDENTITY = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0))


def decode_skeletons(files: DataFrame, transform: Sequence[Sequence[float]] = IDENTITY) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of ``name, payload`` rows named by their segment."""
    m = np.array(transform, float)
    key = lambda name: int(name.split(".")[0])

    def vertex_rows(name: str, data: bytes) -> dict:
        v, _, _ = codecs.decode_skeleton(data)
        v = v @ m[:, :3].T + m[:, 3]
        return {"segid": np.full(len(v), key(name)), "vid": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]}

    def edge_rows(name: str, data: bytes) -> dict:
        _, e, _ = codecs.decode_skeleton(data)
        return {"segid": np.full(len(e), key(name)), "a": e[:, 0].astype(np.int64), "b": e[:, 1].astype(np.int64)}

    return _decoded(files, "segid bigint, vid bigint, x double, y double, z double", vertex_rows), _decoded(files, "segid bigint, a bigint, b bigint", edge_rows)


# --- annotations: cells of packed records -----------------------------------------------


def write_annotation_cells(rows: DataFrame, path: str, cell: Sequence[float], properties: Sequence[tuple[str, str]], nulls: Mapping[str, int] | None = None) -> DataFrame:
    """Points (``ids, x, y, z`` and properties) into one object per grid cell ``i_j_k``.

    Dense cells are split by the caller choosing a finer grid, as levels do.  ``nulls`` has the
    codes that stand for null, by property; a null without code, or a value that is the code
    itself, is refused.
    """
    nulls = dict(nulls or {})
    path, names = local(path), [n for n, _ in properties]
    dtype = codecs.annotation_dtype(1, properties)
    keyed = rows.select("ids", "x", "y", "z", *names, *[F.floor(F.col(c) / F.lit(float(s))).cast("bigint").alias(f"k{c}") for c, s in zip("xyz", cell)])

    def encode(pdf: pd.DataFrame) -> tuple[str, bytes]:
        pdf = pdf.sort_values("ids")
        rec = np.zeros(len(pdf), dtype)
        rec["_pt1"] = pdf[["x", "y", "z"]].to_numpy()
        for n in names:
            void = pdf[n].isna()
            if n in nulls:
                if (pdf[n] == nulls[n]).any():
                    raise ValueError(f"{n} holds {nulls[n]}, its code for null")
                rec[n] = pdf[n].mask(void, nulls[n]).to_numpy()
            elif void.any() and rec[n].dtype.kind in "iu":
                raise ValueError(f"{n} holds nulls and has no code for them")
            else:
                rec[n] = pdf[n].to_numpy()
        k = [int(pdf[f"k{c}"].iloc[0]) for c in "xyz"]
        return f"{path}/{k[0]}_{k[1]}_{k[2]}", codecs.encode_annotations(rec, pdf["ids"].to_numpy())

    return _stored(keyed, ["kx", "ky", "kz"], encode)


def write_annotation_levels(rows: DataFrame, path: str, cells: Sequence[Sequence[float]], limit: int, properties: Sequence[tuple[str, str]], nulls: Mapping[str, int] | None = None) -> list[DataFrame]:
    """Points into the levels ``spatial0``, ``spatial1``, ... of a folder, about ``limit`` a cell
    at most but in the last one."""
    placed = cut(annotations.levelled(rows, cells, limit), "levels")
    return [write_annotation_cells(placed.where(F.col("level") == k), f"{local(path)}/spatial{k}", cell, properties, nulls) for k, cell in enumerate(cells)]


def read_annotation_levels(spark: SparkSession, path: str, cells: Sequence[Sequence[float]], properties: Sequence[tuple[str, str]], kinds: Sequence[str], box: Corners | None = None, nulls: Mapping[str, int] | None = None) -> DataFrame:
    """The points of all levels, or of the cells that ``box`` touches, inside it (faces included)."""
    out = None
    for k, cell in enumerate(cells):
        root = f"{local(path)}/spatial{k}"
        if not os.path.isdir(root):
            continue
        level = read_annotation_cells(spark, root, properties, kinds, nulls, box and annotations.cells_of_box(box, cell))
        out = level if out is None else out.unionByName(level)
    return out if box is None else out.where(" and ".join(f"{c} between {a} and {b}" for c, a, b in zip("xyz", *box)))


def read_annotation_cells(spark: SparkSession, path: str, properties: Sequence[tuple[str, str]], kinds: Sequence[str], nulls: Mapping[str, int] | None = None, cells: tuple[Sequence[int], Sequence[int]] | None = None) -> DataFrame:
    """``ids, x, y, z`` and the properties of all cells; ``kinds`` are their Spark types.

    ``nulls`` has the codes that were written for null, ``cells`` the first and last cell
    to read; others are left out by their names.
    """
    nulls = dict(nulls or {})
    dtype, names = codecs.annotation_dtype(1, properties), [n for n, _ in properties]

    def each(name: str, data: bytes) -> dict:
        rec, ids = codecs.decode_annotations(data, dtype)
        p = rec["_pt1"]
        return {"ids": ids.astype(np.int64), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], **{n: np.where(rec[n] == nulls[n], None, rec[n].astype(object)) if n in nulls else rec[n] for n in names}}

    schema = "ids bigint, x float, y float, z float" + "".join(f", `{n}` {k}" for n, k in zip(names, kinds))
    names_of = None
    if cells is not None:
        at = [F.regexp_extract("name", r"^(-?\d+)_(-?\d+)_(-?\d+)$", i).try_cast("bigint") for i in (1, 2, 3)]
        keep = F.lit(True)
        for c, a, b in zip(at, *cells):
            keep = keep & c.between(a, b)
        names_of = listing(spark, path).where(keep).select("name")
    return _decoded(raw_objects(spark, path, names=names_of), schema, each)


# --- spatial index: JSON tiles ------------------------------------------------------------


def read_spatial_index(spark: SparkSession, path: str) -> DataFrame:
    """``filename, label, x0 .. z1``: the entries of all ``.spatial`` files."""
    files = raw_objects(spark, path, r"\.spatial$").where(F.col("name").rlike(INDEX_NAME))
    parsed = F.from_json(F.decode("payload", "utf-8"), "map<string, array<bigint>>")
    rows = files.select(F.col("name").alias("filename"), F.explode(parsed).alias("label", "b"))
    order = ["x0", "y0", "z0", "x1", "y1", "z1"]
    return rows.select("filename", F.col("label").cast("bigint").alias("label"), *[F.get("b", F.lit(order.index(c))).alias(c) for c in BOX])


def write_spatial_index(entries: DataFrame, path: str) -> DataFrame:
    """One tile per ``filename`` from ``filename, label, x0 .. z1`` rows."""
    path = local(path)

    def encode(pdf: pd.DataFrame) -> tuple[str, bytes]:
        body = {str(r.label): [int(v) for v in (r.x0, r.y0, r.z0, r.x1, r.y1, r.z1)] for r in pdf.sort_values("label").itertuples()}
        return f"{path}/{pdf['filename'].iloc[0]}", json.dumps(body).encode()

    return _stored(entries, ["filename"], encode)


def spatial_payloads(entries: DataFrame) -> DataFrame:
    """``label, payload`` for shard files of ``filename, label, x0 .. z1`` rows: under the hash of
    a tile's name a JSON of names and tiles, so names of equal hash lose nothing.

    Several boxes of a label in a tile become their hull.  The rows are shuffled once, by the hash.
    """
    rows = entries.withColumn("key", F.xxhash64("filename")).repartition("key")
    rows = rows.groupBy("key", "filename", "label").agg(*hull_of([F.col(f"{d}0") for d in "xyz"], [F.col(f"{d}1") for d in "xyz"]))
    box = F.to_json(F.array(*[F.col(c).cast("bigint") for c in ("x0", "y0", "z0", "x1", "y1", "z1")]))
    entry = F.struct(F.col("label").alias("k"), F.concat(F.lit('"'), F.col("label").cast("string"), F.lit('":'), box).alias("v"))
    braced = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda e: e["v"]), ","), F.lit("}"))
    tiles = rows.groupBy("key", "filename").agg(braced(entry).alias("tile"))
    named = F.struct(F.col("filename").alias("k"), F.concat(F.lit('"'), F.col("filename"), F.lit('":'), F.col("tile")).alias("v"))
    return tiles.groupBy(F.col("key").alias("label")).agg(F.encode(braced(named), "utf-8").alias("payload"))


def decode_spatial_index(items: DataFrame) -> DataFrame:
    """``filename, label, x0 .. z1``: the entries of the tiles in ``payload``."""
    parsed = F.from_json(F.decode("payload", "utf-8"), "map<string, map<string, array<bigint>>>")
    rows = items.select(F.explode(parsed).alias("filename", "tile")).select("filename", F.explode("tile").alias("label", "b"))
    order = ["x0", "y0", "z0", "x1", "y1", "z1"]
    return rows.select("filename", F.col("label").cast("bigint").alias("label"), *[F.get("b", F.lit(order.index(c))).alias(c) for c in BOX])


def to_index_tables(entries: DataFrame, prefix: str, buckets: int = 64) -> None:
    """The SQL mirror: tables ``<prefix>_file_lookup``, bucketed and sorted by label, and
    ``<prefix>_index_files``; file ids are hashes of the names, so loads need no counter."""
    rows = entries.select(F.xxhash64("filename").alias("fid"), "filename", "label").distinct()
    rows.select("label", "fid").write.mode("overwrite").bucketBy(buckets, "label").sortBy("label").saveAsTable(f"{prefix}_file_lookup")
    rows.select(F.col("fid").alias("id"), "filename").distinct().write.mode("overwrite").saveAsTable(f"{prefix}_index_files")
