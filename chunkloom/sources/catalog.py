"""Driver-side documents: redirects, kinds and settings of layers, provenance, database
addresses, validity of caches."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from chunkloom.functions.boxes import Corners, corners
from chunkloom.operators import sharding
from chunkloom.sources.layers import local, open_layer, write_object


def follow_redirects(start: str, fetch: Callable[[str], dict], most: int = 10) -> tuple[str, dict]:
    """The layer at the end of a chain of redirects; a layer naming itself ends it."""
    seen, at = [start], start
    info = fetch(at)
    while info.get("redirect") and info["redirect"].rstrip("/") != at.rstrip("/"):
        at = info["redirect"]
        if at in seen:
            raise ValueError(f"redirects go round: {[*seen, at]}")
        seen.append(at)
        if len(seen) > most + 1:
            raise ValueError(f"more than {most} redirects")
        info = fetch(at)
    return at, info


def rois(info: dict) -> list[Corners]:
    """Regions of interest of the finest level, by z."""
    boxes = [corners(b) for b in (info["scales"][0].get("rois") or [])]
    return sorted(boxes, key=lambda b: b[0][2])


def overlaps_rois(box: Corners, regions: list[Corners]) -> bool:
    """True without regions; touching counts."""
    return not regions or any(all(a <= d and b >= c for a, b, c, d in zip(box[0], box[1], r[0], r[1])) for r in regions)


def read_provenance(path: str) -> dict:
    """The document, or an empty one; comments and trailing commas are forgiven."""
    empty = {"description": "", "owners": [], "processing": [], "sources": []}
    try:
        with open(f"{local(path)}/provenance") as f:
            text = f.read()
    except FileNotFoundError:
        return empty
    try:
        doc = json.loads(text)
    except ValueError:
        text = re.sub(r"(?m)^\s*//.*$", "", text)
        doc = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    for k, v in empty.items():
        if not isinstance(doc.get(k, v), type(v)):
            raise ValueError(f"{k} has the wrong type")
    return empty | doc


def write_provenance(path: str, doc: dict) -> None:
    write_object(f"{local(path)}/provenance", json.dumps(doc, indent=2).encode())


def locked_mips(info: dict) -> set[int]:
    return {k for k, s in enumerate(info["scales"]) if s.get("locked")}


def lock_mips(info: dict, mips: list[int], locked: bool = True) -> dict:
    for m in mips:
        if not 0 <= m < len(info["scales"]):
            raise ValueError(f"no level {m}")
    return info | {"scales": [s | {"locked": locked} if k in mips else s for k, s in enumerate(info["scales"])]}


def cache_is_valid(cached: dict, fresh: dict) -> tuple[bool, list[str]]:
    """Whether cached chunks may be used, and what differs harmlessly (sizes)."""
    strip = lambda d: d | {"scales": [{k: v for k, v in s.items() if k != "size"} for s in d["scales"]]}
    notes = [f"size of level {k} changed" for k, (a, b) in enumerate(zip(cached["scales"], fresh["scales"])) if a.get("size") != b.get("size")]
    return strip(cached) == strip(fresh), notes


def database(address: str) -> dict:
    """Parts of a database address; a plain path is a file. For Spark's JDBC source see ``jdbc``."""
    u = urlparse(address)
    if u.scheme in ("", "file", "sqlite"):
        return {"scheme": "sqlite", "path": re.sub(r"^(sqlite|file)://", "", address)}
    if u.scheme not in ("mysql", "postgres"):
        raise ValueError(address)
    port = u.port or {"mysql": 3306, "postgres": 5432}[u.scheme]
    return {"scheme": u.scheme, "host": u.hostname or "localhost", "port": port, "user": u.username, "password": u.password, "path": u.path.strip("/") or "spatial_index"}


def jdbc(address: str) -> str:
    d = database(address)
    if d["scheme"] == "sqlite":
        return f"jdbc:sqlite:{d['path']}"
    kind = {"postgres": "postgresql"}.get(d["scheme"], d["scheme"])
    return f"jdbc:{kind}://{d['host']}:{d['port']}/{d['path']}"


#: What the type member of an info document stands for.
KINDS = {"neuroglancer_multiscale_volume": "volume", "neuroglancer_annotations_v1": "annotations", "neuroglancer_legacy_mesh": "mesh", "neuroglancer_multilod_draco": "multi-resolution mesh", "neuroglancer_skeletons": "skeletons"}


def layer_kind(path: str) -> str:
    """What lies at a path, by its info document; layers without one are volumes."""
    try:
        with open(f"{local(path).rstrip('/')}/info") as f:
            info = json.load(f)
    except FileNotFoundError:
        open_layer(path)  # raises where there is none
        return "volume"
    kind = info.get("@type", "neuroglancer_multiscale_volume")
    if kind not in KINDS:
        raise ValueError(f"unknown type {kind!r}")
    return KINDS[kind]


def open_any(spark: SparkSession, path: str, **how) -> tuple[str, object]:
    """The kind of a layer and its rows: voxels, vertices and faces, or vertices and edges."""
    from chunkloom.sources import layers, objects

    kind = layer_kind(path)
    if kind == "volume":
        return kind, layers.read_layer(spark, path, **how)
    if kind == "mesh":
        return kind, objects.read_meshes(spark, path, **how)
    if kind == "skeletons":
        return kind, objects.read_skeletons(spark, path, **how)
    if kind == "annotations":
        return kind, objects.raw_objects(spark, f"{local(path).rstrip('/')}/{how.get('level', 'spatial0')}")
    return kind, objects.lod_fragments(spark, path)


def sharded(info: dict, labels: int, index_encoding: str = "gzip", data_encoding: str = "gzip", **sizes) -> dict:
    """A copy of a mesh or skeleton document with a layout for so many labels."""
    shard, mini, pre = sharding.params_for_hashed(labels, **sizes)
    return info | {"sharding": sharding.Spec(pre, mini, shard, "murmurhash3_x86_128", index_encoding, data_encoding).to_dict()}


def unsharded(info: dict) -> dict:
    return {k: v for k, v in info.items() if k != "sharding"}


def multi_resolution(info: dict, bits: int, resolution: Sequence[float]) -> dict:
    """A copy of a mesh document for levels of detail, whose vertices have 10 or 16 bits."""
    if bits not in (10, 16):
        raise ValueError("vertices have 10 or 16 bits")
    matrix = [resolution[r] if r == c else 0 for r in range(3) for c in range(4)]
    return info | {"@type": "neuroglancer_multilod_draco", "vertex_quantization_bits": bits, "transform": matrix, "lod_scale_multiplier": 1.0}


def single_resolution(info: dict) -> dict:
    gone = ("vertex_quantization_bits", "transform", "lod_scale_multiplier")
    return {k: v for k, v in info.items() if k not in gone} | {"@type": "neuroglancer_legacy_mesh"}


def sharded_image(info: dict, mip: int, width: int, **limits) -> dict:
    """A copy of a volume document whose level is sharded, in as large shards as the limits allow."""
    s = info["scales"][mip]
    spec = sharding.params_for_image(s["size"], s["chunk_sizes"][0], s["encoding"], width, **limits)
    return _with_scale(info, mip, s | {"sharding": spec.to_dict()})


def with_encoding(info: dict, mip: int, encoding: str, level: int | None = None) -> dict:
    """A copy with another encoding of a level, and the quality of lossy ones."""
    gone = ("jpeg_quality", "png_level", "jxl_quality", "compressed_segmentation_block_size")
    new = {k: v for k, v in info["scales"][mip].items() if k not in gone} | {"encoding": encoding}
    if encoding == "compressed_segmentation":
        new["compressed_segmentation_block_size"] = [8, 8, 8]
    if level is not None:
        name = {"jpeg": "jpeg_quality", "png": "png_level", "jxl": "jxl_quality"}.get(encoding)
        if name is None:
            raise ValueError(f"{encoding} has no level")
        new[name] = level
    return _with_scale(info, mip, new)


def only_finest(info: dict) -> dict:
    """A copy without its coarser levels."""
    return info | {"scales": info["scales"][:1]}


def _with_scale(info: dict, mip: int, scale: dict) -> dict:
    return info | {"scales": [scale if k == mip else s for k, s in enumerate(info["scales"])]}


#: Content types of image encodings, and encodings that are compressed again.
IMAGE_TYPES, COMPRESSED_AGAIN = ("jpeg", "png", "jxl"), ("raw", "compressed_segmentation", "compresso", "crackle")
OWN_TYPES = ("compresso", "compressed_segmentation", "fpzip", "kempressed", "zfpc", "crackle")


def content_type(encoding: str) -> str:
    if encoding in IMAGE_TYPES:
        return f"image/{encoding}"
    return f"image/x.{encoding}" if encoding in OWN_TYPES else "application/octet-stream"


def compression_for(encoding: str, asked: str | bool | None = None) -> str | None:
    """What an object is compressed with: as asked, or gzip for encodings that gain by it."""
    if isinstance(asked, str):
        return asked
    return "gzip" if asked or (asked is None and encoding in COMPRESSED_AGAIN) else None


def cache_control(asked: str | bool | int | None) -> str:
    """A header from seconds, a switch or its own text; an hour by default."""
    if isinstance(asked, str):
        return asked
    seconds = 3600 if asked is None or asked is True else 0 if asked is False else asked
    if seconds < 0:
        raise ValueError("seconds are not negative")
    return f"max-age={seconds}, s-max-age={seconds}" if seconds else "no-cache"


def has_data(path: str, mip: int) -> bool:
    """Whether any object lies under a level."""
    root = open_layer(path)[mip].root
    return os.path.isdir(root) and any(n.is_file() for n in os.scandir(root))
