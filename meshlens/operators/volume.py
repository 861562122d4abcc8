"""Voxel lookups, rays and image tiles: ranges turned into equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_voxel(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Mesh x, y, z to voxel iz, iy, ix; halves go to the even neighbour."""
    return df.withColumns({f"i{c}": F.rint(F.col(c) / scale).cast("int") for c in "zyx"})


def in_bounds(df: DataFrame, shape: tuple[int, int, int], margin: int = 0) -> DataFrame:
    for c, n in zip("zyx", shape):
        df = df.filter((F.col(f"i{c}") >= margin) & (F.col(f"i{c}") < n - margin))
    return df


def voxel_values(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """points with their voxel's value, 0 outside: voxels(iz, iy, ix, value)."""
    return points.join(voxels, ["iz", "iy", "ix"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def ray_profiles(samples: DataFrame, voxels: DataFrame, reach: int, shift: int = -1) -> DataFrame:
    """sample_id, pos, value along the normal from -reach to reach; ``shift`` voxels off, as the metric is defined."""
    steps = samples.withColumn("pos", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    at = steps.select("sample_id", "pos", *((F.rint(F.col(c) + F.col("pos") * F.col(f"n{c}")).cast("int") + shift).alias(f"i{c}") for c in "zyx"))
    return voxel_values(at, voxels).select("sample_id", "pos", "value")


def fiber_votes(samples: DataFrame, near: DataFrame) -> DataFrame:
    """flip and break flags of each sample against its neighbours.

    samples: segment_id, vertex_id, fiber_class, dx, dy, dz; near: from
    ``segments.neighbours``.  A sample flips if more neighbours differ in
    class than agree; it breaks if the directions' mean |cosine| is below 0.5.
    """
    a = near.filter("neighbour <> vertex_id").join(samples, ["segment_id", "vertex_id"])
    b = samples.select("segment_id", F.col("vertex_id").alias("neighbour"), F.col("fiber_class").alias("other"), *(F.col(f"d{c}").alias(f"o{c}") for c in "xyz"))
    pair = a.join(b, ["segment_id", "neighbour"])
    cosine = F.abs(F.col("dx") * F.col("ox") + F.col("dy") * F.col("oy") + F.col("dz") * F.col("oz"))
    return pair.groupBy("segment_id", "vertex_id").agg(
        (F.sum((F.col("other") != F.col("fiber_class")).cast("int")) > F.sum((F.col("other") == F.col("fiber_class")).cast("int"))).alias("flip"),
        (F.avg(cosine) < 0.5).alias("broken"),
    )


def inverse_distance(near: DataFrame, values: DataFrame, value: str, key: str = "vertex_id") -> DataFrame:
    """Weighted mean of the neighbours' values, weights 1 / max(distance, 1e-10)."""
    at = near.join(values.select("segment_id", F.col(key).alias("neighbour"), value), ["segment_id", "neighbour"])
    w = 1.0 / F.greatest(F.sqrt("d2"), F.lit(1e-10))
    return at.groupBy("segment_id", key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def tile_origins(fragments: DataFrame, size: int, stride: int) -> DataFrame:
    """fragment_id, y0, x0 of all tiles that lie within (height, width)."""
    ok = fragments.filter((F.col("height") >= size) & (F.col("width") >= size))
    span = lambda c: F.sequence(F.lit(0), F.col(c) - size, F.lit(stride))
    return ok.withColumn("y0", F.explode(span("height"))).withColumn("x0", F.explode(span("width"))).select("fragment_id", "y0", "x0")


def tile_pixels(tiles: DataFrame, size: int) -> DataFrame:
    inner = F.sequence(F.lit(0), F.lit(size - 1))
    return tiles.withColumn("ty", F.explode(inner)).withColumn("tx", F.explode(inner)).withColumns({"y": F.col("y0") + F.col("ty"), "x": F.col("x0") + F.col("tx")})


def _with(rows: DataFrame, other: DataFrame, column: str, f) -> DataFrame:
    """rows with ``f`` over a column of the rows of ``other`` of the same pixel, null if it has none.

    As a window over both: pixels made from a small table look as small to the
    planner as that table, and a join would broadcast them; and tables dealt by
    fragment stay where they are, which a join by pixel would shuffle.
    """
    pixel = ["fragment_id", "y", "x"]
    both = rows.withColumn("_own", F.lit(True)).unionByName(other.select(*pixel, F.col(column).alias("_other")), allowMissingColumns=True)
    return both.withColumn("_other", f("_other").over(Window.partitionBy(*pixel))).filter("_own").drop("_own")


def covered_tiles(tiles: DataFrame, mask: DataFrame, size: int, least: float = 0.5) -> DataFrame:
    """Tiles whose mean mask exceeds ``least``; mask: fragment_id, y, x, mask."""
    got = _with(tile_pixels(tiles, size).select("fragment_id", "y", "x", "y0", "x0"), mask, "mask", F.sum)
    return got.groupBy("fragment_id", "y0", "x0").agg((F.sum("_other") / (size * size)).alias("coverage")).filter(F.col("coverage") > least)


def gaussian_weight(size: int):
    """Separable bell over (ty, tx), sigma = size / 4, largest value 1."""
    sigma = size / 4
    place = lambda c: -size / 2 + F.col(c) * (size / (size - 1))
    peak = 2 * (size / (size - 1) / 2) ** 2 if size % 2 == 0 else 0.0  # the middle of an even grid lies off the centre
    return F.exp(-(place("ty") * place("ty") + place("tx") * place("tx") - peak) / (2 * sigma * sigma))


def blend(predictions: DataFrame, size: int, pixels: DataFrame | None = None) -> DataFrame:
    """Overlapping tile predictions (.., ty, tx, y, x, value) blended by the bell: fragment_id, y, x, value in [0, 1].

    ``pixels`` (fragment_id, y, x, mask): all of a fragment's pixels; those that
    no tile covers get 0, and values are multiplied by the mask.
    """
    w = gaussian_weight(size)
    out = predictions.groupBy("fragment_id", "y", "x").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("value") * w) / F.sum(w))).alias("value"))
    if pixels is None:
        return out
    got = _with(pixels.select("fragment_id", "y", "x", "mask"), out, "value", F.max)
    return got.select("fragment_id", "y", "x", (F.coalesce("_other", F.lit(0.0)) * F.col("mask")).alias("value"))


def infer(patches: DataFrame, model, batch: int = 64) -> DataFrame:
    """fragment_id, y0, x0, values: ``model`` (a function of an array of patches, batch x layers x size x size) scores logits; the sigmoid of them.

    patches: fragment_id, y0, x0, layers, size, pixels (array<float>: layer by layer, row by row).
    """
    import numpy as np

    def run(batches):
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                shape = (int(part["layers"].iloc[0]), int(part["size"].iloc[0]), int(part["size"].iloc[0]))
                logits = np.asarray(model(np.stack([np.asarray(p, float).reshape(shape) for p in part["pixels"]])), float)
                out = part[["fragment_id", "y0", "x0"]].copy()
                out["values"] = [x.ravel().tolist() for x in 1 / (1 + np.exp(-logits))]
                yield out

    return patches.mapInPandas(run, "fragment_id long, y0 int, x0 int, values array<double>")


def tile_patches(tiles: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Patches for ``infer``: tiles (fragment_id, y0, x0) with pixels (fragment_id, layer, y, x, value), clipped to 0-200 and divided by 200."""
    got = tile_pixels(tiles, size).join(pixels, ["fragment_id", "y", "x"])
    cell = F.struct("layer", "ty", "tx", intensity(F.col("value")).cast("float").alias("v"))
    each = got.groupBy("fragment_id", "y0", "x0").agg(F.sort_array(F.collect_list(cell)).alias("p"), F.countDistinct("layer").cast("int").alias("layers"))
    return each.select("fragment_id", "y0", "x0", "layers", F.lit(size).alias("size"), F.transform("p", lambda x: x["v"]).alias("pixels"))


def intensity(value):
    """A voxel value clipped to 0-200, as a share of 200."""
    return F.least(F.lit(200.0), F.greatest(F.lit(0.0), value)) / 200.0


def sigmoid(x):
    return 1.0 / (1.0 + F.exp(-x))


def scaled_mask(pixels: DataFrame, column: str = "value") -> DataFrame:
    """Masks and labels stored as 0-255 become 0-1: by fragment, divided by 255 if any value is over 1."""
    top = F.max(column).over(Window.partitionBy("fragment_id"))
    return pixels.withColumn(column, F.col(column) / F.when(top > 1, 255.0).otherwise(1.0))


def missing_layers(layers: DataFrame, first: int, last: int) -> DataFrame:
    """fragment_id, layer: gaps in the layers first to last - 1; layers: fragment_id, layer."""
    asked = layers.select("fragment_id").distinct().withColumn("layer", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    return asked.join(layers.select("fragment_id", "layer"), ["fragment_id", "layer"], "left_anti")


def split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Rows with ``training``, by a hash of the key: the same rows at any number of partitions."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("training", digest % 1000 < int(share * 1000))


def dice(pixels: DataFrame, prediction: str = "value", label: str = "label") -> DataFrame:
    p = (F.col(prediction) > 0.5).cast("double")
    return pixels.groupBy("fragment_id").agg((2 * F.sum(p * F.col(label)) / (F.sum(p) + F.sum(label) + 1e-8)).alias("dice"))


def losses(pixels: DataFrame, prediction: str = "value", label: str = "label", floor: float = 1e-7) -> DataFrame:
    """fragment_id, bce, dice_loss, loss: mean cross entropy and one minus the smooth dice of probabilities."""
    p = F.least(F.lit(1 - floor), F.greatest(F.lit(floor), F.col(prediction)))
    y = F.col(label)
    each = pixels.groupBy("fragment_id").agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"), (1 - (2 * F.sum(F.col(prediction) * y) + 1) / (F.sum(prediction) + F.sum(label) + 1)).alias("dice_loss"))
    return each.withColumn("loss", F.col("bce") + F.col("dice_loss"))
