"""Row-local features as expressions: quality, faces, frames, vectors, texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aspect ratios that images are offered in, first one wins ties.
RATIOS = (("1:1", 1.0), ("2:3", 2 / 3), ("3:2", 3 / 2), ("3:4", 3 / 4), ("4:3", 4 / 3), ("9:16", 9 / 16), ("16:9", 16 / 9), ("21:9", 21 / 9))


def quality(sharpness: Column, brightness: Column, w_sharp: float = 0.8, w_bright: float = 0.2) -> Column:
    """Weighted sharpness (Laplacian variance over 200, at most 1) and brightness (mean over 255); 0 where unknown."""
    s = F.least(sharpness / 200.0, F.lit(1.0)) * w_sharp + brightness / 255.0 * w_bright
    return F.when(sharpness.isNotNull() & brightness.isNotNull(), s).otherwise(0.0)


def passes_quality(score: Column, least: float = 0.3) -> Column:
    return F.coalesce(score, F.lit(0.0)) >= least


def faces(boxes: Column, width: Column, height: Column, most: int = 10) -> Column:
    """A struct of face measures from array<struct<w, h, eyes, smiles>>; zeros for no boxes or null.
    Sizes are shares of the image; num_faces stops at ``most``, the numbers of faces with both eyes and with a smile do not."""
    area = lambda b: b["w"].cast("double") * b["h"]
    total = F.aggregate(boxes, F.lit(0.0), lambda t, b: t + area(b))
    n, whole = F.size(boxes), width.cast("double") * height
    some = F.coalesce(n > 0, F.lit(False))
    having = lambda rule: F.when(some, F.size(F.filter(boxes, rule))).otherwise(0)
    return F.struct(
        F.when(some, F.least(n, F.lit(most))).otherwise(0).alias("num_faces"),
        F.when(some, total / whole).otherwise(0.0).alias("face_ratio"),
        F.when(some, F.array_max(F.transform(boxes, area)) / whole).otherwise(0.0).alias("largest_face_ratio"),
        some.cast("int").alias("has_face"),
        F.when(some, total / n / whole).otherwise(0.0).alias("avg_face_size"),
        having(lambda b: b["eyes"] >= 2).alias("eyes_detected"),
        having(lambda b: b["smiles"] > 0).alias("smile_detected"),
    )


def frame_indices(frames: Column, most: int) -> Column:
    """All frames, or ``most`` evenly spaced ones: floor(step * i)."""
    every = F.sequence(F.lit(0), frames - 1)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(frames.cast("double") / most * i).cast("int"))
    none = F.slice(F.sequence(F.lit(0), F.lit(0)), 1, 0)
    return F.when(frames <= 0, none).when(frames <= most, every).otherwise(spaced)


def closest_ratio(width: Column, height: Column) -> Column:
    """Name of the nearest of RATIOS; null for sizes of 0."""
    x = F.when((width > 0) & (height > 0), width.cast("double") / height)
    offers = F.array(*[F.struct(F.abs(x - r).alias("off"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, r) in enumerate(RATIOS)])
    return F.when(x.isNotNull(), F.array_min(offers)["name"])


def fitted_size(width: Column, height: Column, most: int) -> Column:
    """(width, height) scaled down to a longer side of ``most``, cut to whole pixels; smaller images keep theirs."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    cut = lambda x: F.floor(x * scale).cast("int")
    big = F.greatest(width, height) > most
    return F.struct(F.when(big, cut(width)).otherwise(width).alias("width"), F.when(big, cut(height)).otherwise(height).alias("height"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def normalised(v: Column) -> Column:
    """Unit length; zero vectors stay, null stays null."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")


def kept_text(text: Column, most: int = 50_000) -> Column:
    return F.substring(text, 1, most)


def marked_cut(text: Column, most: int, mark: str = "\n[... cut ...]") -> Column:
    """Text of at most ``most`` characters; longer ones are cut and marked."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def preview(name: Column, text: Column, most: int = 2_000) -> Column:
    return F.concat(F.lit("["), name, F.lit("]\n"), F.substring(F.coalesce(text, F.lit("")), 1, most))


def file_key(path: Column, size: Column, modified: Column, *more: Column) -> Column:
    """Cache key: SHA-256 of path, size, time and what else decides the value (profile, version, judge)."""
    return F.sha2(F.concat_ws("_", path, size.cast("string"), modified.cast("string"), *more), 256)


def group_key(keys: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(keys), "_"), 256)


def expired(created: Column, as_of: Column, ttl_days: float) -> Column:
    """Older than the time to live; never for ttl <= 0; a missing time is expired."""
    if ttl_days <= 0:
        return F.lit(False)
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    return F.coalesce(age > math.floor(ttl_days * 86_400_000_000), F.lit(True))


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
