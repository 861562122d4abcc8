"""Chunked volumes: Zarr v2 arrays (raw, zlib, gzip and zstd chunks) and arrays as chunk tables."""

from __future__ import annotations

import gzip
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ct import CHUNKS


def array_info(spark: SparkSession, url: str, scale: int | str | None = 0) -> tuple[str, dict]:
    """Path and header of the array: ``url`` itself, or in a group the array ``scale``, else labels, predictions, 0, the first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(url).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def header(at: str) -> dict | None:
        head = path(f"{at}/.zarray")
        if not fs.exists(head):
            return None
        stream = fs.open(head)
        try:
            return json.loads(bytes(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    url = url.rstrip("/")
    own = header(url)
    if own is not None:
        return url, own
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(url)) if s.isDirectory())
    for name in [*([str(scale)] if scale is not None else []), "labels", "predictions", "0", *names]:
        found = header(f"{url}/{name}") if name in names else None
        if found is not None:
            return f"{url}/{name}", found
    raise FileNotFoundError(f"no arrays in {url}")


def _decode(body: bytes, codec: dict | None) -> bytes:
    name = (codec or {}).get("id")
    if name is None:
        return body
    if name == "zlib":
        return zlib.decompress(body)
    if name == "gzip":
        return gzip.decompress(body)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    raise ValueError(f"codec {name} is not supported")


def read_zarr(spark: SparkSession, url: str, scale: int | str | None = 0) -> tuple[DataFrame, dict]:
    """chunks of a 3-D Zarr v2 array and its header (shape, chunks, scale_factor); clipped to the array's shape.

    A filter on cz, cy, cx decides before a chunk's bytes are decoded.
    """
    path, head = array_info(spark, url, scale)
    if head.get("filters") or len(head["shape"]) != 3:
        raise ValueError("only unfiltered arrays of three dimensions")
    sep = head.get("dimension_separator", ".")
    name = r"(\d+)" + (r"\." if sep == "." else "/") + r"(\d+)" + (r"\." if sep == "." else "/") + r"(\d+)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keyed = files.select("content", *(F.regexp_extract("path", name, k).alias(c) for k, c in enumerate(("cz", "cy", "cx"), 1))).filter("cz <> ''")
    keyed = keyed.select(*(F.col(c).cast("int").alias(c) for c in ("cz", "cy", "cx")), "content")
    shape, edges, kind, codec, order = head["shape"], head["chunks"], head["dtype"], head.get("compressor"), head.get("order", "C")

    def run(batches):
        for batch in batches:
            shapes, bodies = [], []
            for cz, cy, cx, content in batch[["cz", "cy", "cx", "content"]].itertuples(index=False):
                block = np.frombuffer(_decode(bytes(content), codec), kind).reshape(edges, order=order)
                left = [min(e, s - c * e) for c, e, s in zip((cz, cy, cx), edges, shape)]
                block = block[: left[0], : left[1], : left[2]]
                shapes.append(list(block.shape))
                bodies.append(block.astype("<f4").tobytes())
            yield pd.DataFrame({"cz": batch["cz"], "cy": batch["cy"], "cx": batch["cx"], "shape": shapes, "body": bodies})

    level = path.rstrip("/").rsplit("/", 1)[1]
    return keyed.mapInPandas(run, CHUNKS), {"shape": tuple(shape), "chunks": tuple(edges), "scale_factor": 2.0 ** int(level) if level.isdigit() else 1.0}


def formula_chunks(spark: SparkSession, formula, shape: tuple[int, int, int], edge: int) -> DataFrame:
    """Chunks of a volume given by a function of the arrays iz, iy, ix."""
    counts = [-(-n // edge) for n in shape]
    grid = spark.range(int(np.prod(counts))).selectExpr(f"cast(id div {counts[1] * counts[2]} as int) cz", f"cast(id div {counts[2]} % {counts[1]} as int) cy", f"cast(id % {counts[2]} as int) cx")

    def run(batches):
        for batch in batches:
            shapes, bodies = [], []
            for key in batch[["cz", "cy", "cx"]].itertuples(index=False):
                spans = [np.arange(c * edge, min((c + 1) * edge, n)) for c, n in zip(key, shape)]
                block = np.broadcast_to(formula(*np.meshgrid(*spans, indexing="ij")), [len(s) for s in spans])
                shapes.append(list(block.shape))
                bodies.append(block.astype("<f4").tobytes())
            yield batch.assign(shape=shapes, body=bodies)

    return grid.mapInPandas(run, CHUNKS)
