"""Fingerprints and descriptors of images, numeric grids and texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Descriptor names in their order, and luma weights.
DESCRIPTORS = ["laplacian_var", "contrast", "brightness", "hist_mean", "hist_std", "sobel_mean", "entropy"]
LUMA = {"b": 0.114, "g": 0.587, "r": 0.299}
BINS = 256


# ---------------------------------------------------------------- text


def text_fingerprint(docs: DataFrame, item: str = "doc_id", text: str = "text") -> DataFrame:
    """64-bit SimHash of the words of a text, runs of letters, marks and digits of any script: ``item, h``.

    Words are exploded and summed in the task that reads the text; one row of
    counters per text is exchanged. Bits j of the upper and the lower half are
    counted in one long (a text has fewer than 2**31 words), and a bit of the
    result is set when more than half of the words have it. Texts without words
    have no fingerprint.
    """
    spaced = F.regexp_replace(F.lower(F.col(text)), "[^\\p{L}\\p{M}\\p{N}]+", " ")
    words = docs.select(F.col(item), F.explode(F.split(spaced, " ")).alias("w")).filter("w <> ''")
    half = "cast(conv(substring(m, {at}, 8), 16, 10) as bigint)"
    bits = words.select(item, F.md5("w").alias("m")).selectExpr(
        item, f"{half.format(at=1)} as hi", f"{half.format(at=9)} as lo"
    )
    # SQL text here: thousands of Column calls would take longer than the job
    counters = [
        F.expr(f"sum(shiftleft(shiftright(hi, {j}) & 1L, 32) | (shiftright(lo, {j}) & 1L))").alias(f"c{j}")
        for j in range(32)
    ]
    counted = bits.groupBy(item).agg(F.count(F.lit(1)).alias("n"), *counters)
    upper = " | ".join(f"if(shiftright(c{j}, 32) * 2 > n, shiftleft(1L, {32 + j}), 0L)" for j in range(32))
    lower = " | ".join(f"if((c{j} & 4294967295L) * 2 > n, {1 << j}L, 0L)" for j in range(32))
    return counted.select(item, F.expr(f"({upper}) | ({lower})").alias("h"))


# ---------------------------------------------------------------- images


def _pixels(images: DataFrame, item: str, image: str) -> DataFrame:
    """Image structs as flat columns, which reach Python without nested conversion."""
    parts = [F.col(f"{image}.{f}").alias(f) for f in ("height", "width", "nChannels", "data")]
    return images.select(F.col(item).alias("item_id"), *parts)


def _grays(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    """8-bit luma of each image (BGR, BGRA or one channel)."""
    for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
        pixels = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
        if c == 1:
            yield pixels[:, :, 0]
        else:
            b, g, r = pixels[:, :, 0], pixels[:, :, 1], pixels[:, :, 2]
            yield np.floor(LUMA["b"] * b + LUMA["g"] * g + LUMA["r"] * r + 0.5)


def _describe(gray: np.ndarray) -> list[float]:
    padded = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    up, mid, down = padded[:-2], padded[1:-1], padded[2:]
    laplacian = up[:, 1:-1] + down[:, 1:-1] + mid[:, :-2] + mid[:, 2:] - 4 * gray
    across = padded[:, 2:] - padded[:, :-2]
    smooth = padded[:, :-2] + 2 * padded[:, 1:-1] + padded[:, 2:]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = smooth[2:] - smooth[:-2]
    hist = np.bincount(gray.astype(np.int64).ravel(), minlength=BINS).astype(np.float64)
    p = hist / hist.sum()
    entropy = -np.sum(p * np.log2(p + 1e-10))
    return [
        float(v)
        for v in (laplacian.var(), gray.std(), gray.mean(), hist.mean(), hist.std(), (gx**2 + gy**2).mean(), entropy)
    ]


def image_descriptors(images: DataFrame, item: str = "path", image: str = "image") -> DataFrame:
    """Seven quality descriptors per decoded image, one column each."""
    kind = images.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_describe(gray) for gray in _grays(pdf)]
            out = pd.DataFrame(rows, columns=DESCRIPTORS, dtype="float64")
            out.insert(0, "item_id", pdf["item_id"].to_numpy())
            yield out

    schema = f"item_id {kind}, " + ", ".join(f"{d} double" for d in DESCRIPTORS)
    return _pixels(images, item, image).mapInPandas(run, schema)


def _area_weights(n_out: int, n_in: int) -> np.ndarray:
    """Row i averages the input range that output cell i covers."""
    edges = np.arange(n_out + 1) * (n_in / n_out)
    starts = np.arange(n_in)
    cover = np.minimum(edges[1:, None], starts + 1) - np.maximum(edges[:-1, None], starts)
    cover = np.maximum(cover, 0.0)
    return cover / cover.sum(axis=1, keepdims=True)


def _cosine_basis(n_low: int, n: int) -> np.ndarray:
    """The ``n_low`` lowest rows of the DCT-II of length ``n``."""
    k, x = np.arange(n_low)[:, None], np.arange(n)[None, :]
    return 2.0 * np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def _phash(gray: np.ndarray, hash_size: int) -> np.ndarray:
    side = 4 * hash_size
    basis = _cosine_basis(hash_size, side)
    small = _area_weights(side, gray.shape[0]) @ gray @ _area_weights(side, gray.shape[1]).T
    low = basis @ small @ basis.T
    return (low > np.median(low)).ravel()


def phash(images: DataFrame, hash_size: int = 8, item: str = "path", image: str = "image") -> DataFrame:
    """Perceptual hash of decoded images: ``item_id, h`` for 64 bits, else an array of words.

    Area average to (4n, 4n), two-dimensional cosine transform, the n x n low
    frequencies against their median; bit i of the word is frequency i.
    """
    kind = images.schema[item].dataType.simpleString()
    n_words = -(-hash_size * hash_size // 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = []
            for gray in _grays(pdf):
                bits = np.zeros(64 * n_words, np.uint8)
                found = _phash(gray, hash_size)
                bits[: len(found)] = found
                words.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy(), "words": words})

    hashed = _pixels(images, item, image).mapInPandas(run, f"item_id {kind}, words array<bigint>")
    if n_words == 1:
        return hashed.select("item_id", F.get("words", F.lit(0)).alias("h"))
    return hashed.withColumnRenamed("words", "h")


# ---------------------------------------------------------------- grids


def grid_descriptors(cells: DataFrame, item: str = "item_id") -> DataFrame:
    """The descriptors of :func:`image_descriptors` for long cells ``item, y, x, gray``.

    One exchange by item serves the neighbour windows and both aggregations.
    A grid is one picture, so its cells fit a task.
    """
    parts = cells.select(item, "y", "x", F.col("gray").cast("double").alias("g")).repartition(item)

    def pair(value: Column, axis: Window) -> tuple[Column, Column]:
        """Previous and next value; the border mirrors the inner neighbour."""
        before, after = F.lag(value, 1).over(axis), F.lead(value, 1).over(axis)
        return F.coalesce(before, after, value), F.coalesce(after, before, value)

    row = Window.partitionBy(item, "y").orderBy("x")
    col = Window.partitionBy(item, "x").orderBy("y")
    left, right = pair(F.col("g"), row)
    flat = parts.withColumns({"across": right - left, "smooth": left + 2 * F.col("g") + right, "sides": left + right})
    up, down = pair(F.col("g"), col)
    a_up, a_down = pair(F.col("across"), col)
    s_up, s_down = pair(F.col("smooth"), col)
    derived = flat.select(
        item,
        "g",
        (F.col("sides") + up + down - 4 * F.col("g")).alias("lap"),
        (a_up + 2 * F.col("across") + a_down).alias("gx"),
        (s_down - s_up).alias("gy"),
    )
    per_level = derived.groupBy(item, "g").agg(
        F.count(F.lit(1)).cast("double").alias("c"),
        F.sum("lap").alias("sl"),
        F.sum(F.col("lap") * F.col("lap")).alias("sl2"),
        F.sum(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("ss"),
    )
    n, c, g = F.sum("c"), F.col("c"), F.col("g")
    total = per_level.groupBy(item).agg(
        n.alias("n"),
        F.sum("sl").alias("sl"),
        F.sum("sl2").alias("sl2"),
        F.sum("ss").alias("ss"),
        F.sum(c * g).alias("sg"),
        F.sum(c * g * g).alias("sg2"),
        F.sum(c * c).alias("sc2"),
        F.collect_list("c").alias("counts"),
    )
    n = F.col("n")
    entropy = -F.aggregate(
        "counts", F.lit(0.0), lambda acc, k: acc + k / n * F.log2(k / n + F.lit(1e-10))
    )

    def var(s2: str, s: str) -> Column:
        mean = F.col(s) / n
        return F.greatest(F.lit(0.0), F.col(s2) / n - mean * mean)

    hist_mean = n / BINS
    return total.select(
        item,
        var("sl2", "sl").alias("laplacian_var"),
        F.sqrt(var("sg2", "sg")).alias("contrast"),
        (F.col("sg") / n).alias("brightness"),
        hist_mean.alias("hist_mean"),
        F.sqrt(F.col("sc2") / BINS - hist_mean * hist_mean).alias("hist_std"),
        (F.col("ss") / n).alias("sobel_mean"),
        entropy.alias("entropy"),
    )


def gray_grid(vectors: DataFrame, item: str, features: str, side: int) -> DataFrame:
    """Vector of ``side * side`` values around zero -> gray cells 0..255."""
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v").cast("double") * 256 + 128))).cast("int")
    return vectors.select(F.col(item).alias("item_id"), F.posexplode(features).alias("pos", "v")).select(
        "item_id",
        F.floor(F.col("pos") / side).cast("int").alias("y"),
        (F.col("pos") % side).cast("int").alias("x"),
        gray.alias("gray"),
    )


def grid_images(vectors: DataFrame, item: str, features: str, side: int) -> DataFrame:
    """The same grids as one-channel image structs."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.stack(pdf["features"].to_numpy()).astype(np.float64)
            gray = np.clip(np.floor(values * 256 + 128), 0, 255).astype(np.uint8)
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy(), "data": [g.tobytes() for g in gray]})

    kind = vectors.schema[item].dataType.simpleString()
    packed = vectors.select(F.col(item).alias("item_id"), F.col(features).alias("features")).mapInPandas(
        pack, f"item_id {kind}, data binary"
    )
    return packed.select(
        "item_id",
        F.struct(
            F.col("item_id").cast("string").alias("origin"),
            F.lit(side).alias("height"),
            F.lit(side).alias("width"),
            F.lit(1).alias("nChannels"),
            F.lit(0).alias("mode"),
            "data",
        ).alias("image"),
    )
