"""Scans: files by extension, their types, folders and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The file types the engine knows.
IMAGE = ("jpg", "jpeg", "png", "webp", "heic", "tif", "tiff", "bmp", "gif")
VIDEO = ("mp4", "mov", "avi", "mkv", "m4v", "3gp", "wmv", "flv", "webm")
AUDIO = ("mp3", "wav", "flac", "aac", "ogg", "m4a", "wma", "opus", "aiff")
DOCUMENT = ("pdf", "docx", "xlsx", "pptx", "html", "htm", "txt", "md", "csv", "rtf")
CODE = (
    "py", "js", "ts", "jsx", "tsx", "java", "go", "rs", "rb", "php", "c", "cpp", "h", "hpp", "cs", "swift", "kt", "scala",
    "lua", "sh", "bash", "zsh", "ps1", "sql", "r", "m", "pl", "yaml", "yml", "toml", "json", "xml", "dockerfile", "tf", "hcl",
)
_ORDER = ("image", "video", "audio", "document")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case suffix without its dot; '' where there is none (names that only start with a dot have none)."""
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1))


def media_type(path: Column) -> Column:
    """image, video, audio or document (code counts as document); null for anything else."""
    e = extension(path)
    return (
        F.when(e.isin(*IMAGE), "image").when(e.isin(*VIDEO), "video").when(e.isin(*AUDIO), "audio")
        .when(e.isin(*DOCUMENT, *CODE), "document")
    )


def is_code(path: Column) -> Column:
    return extension(path).isin(*CODE)


def is_media(path: Column) -> Column:
    return F.coalesce(media_type(path).isin("image", "video", "audio"), F.lit(False))


def list_files(spark: SparkSession, root: str, kinds: tuple[str, ...] = _ORDER, recursive: bool = False) -> DataFrame:
    """(path, file_name, ext, media_type, size_bytes, modified_at) of the files of the given kinds under ``root``, from
    one listing; contents are never read. Fails where ``root`` is missing or no folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(root)
    if not fs.getFileStatus(hadoop).isDirectory():
        raise NotADirectoryError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.col("path")
    return files.select(
        "path", file_name(path).alias("file_name"), extension(path).alias("ext"), media_type(path).alias("media_type"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
    ).where(F.col("media_type").isin(*kinds))


def inventory(items: DataFrame) -> DataFrame:
    """Number and bytes of items per media type; unknown types are left out."""
    return items.where("media_type is not null").groupBy("media_type").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").cast("long").alias("bytes")
    )


def predominant_types(items: DataFrame) -> DataFrame:
    """(folder, kind): mixed where more than one of {image/video, audio, document} occurs, else the only one; folders
    of videos without images are video, folders without known items image."""
    n = {k: F.count_if(F.col("media_type") == k) for k in _ORDER}
    visual = n["image"] + n["video"]
    several = (visual > 0).cast("int") + (n["audio"] > 0).cast("int") + (n["document"] > 0).cast("int") > 1
    kind = (
        F.when(several, "mixed").when(n["document"] > 0, "document").when(n["audio"] > 0, "audio")
        .when((n["video"] > 0) & (n["image"] == 0), "video").otherwise("image")
    )
    return items.groupBy("folder").agg(kind.alias("kind"))


def bundles(items: DataFrame, root: Column | str) -> DataFrame:
    """(bundle, files, types): each immediate subfolder of ``root`` that directly holds a file of a known type. The
    files of a bundle stay rows of ``items``; here they are only counted, so a large bundle is no problem."""
    base = F.lit(root) if isinstance(root, str) else root
    inside = F.col("folder").startswith(base) & (folder(F.col("folder")) == base)
    return items.where(inside & F.col("media_type").isNotNull()).groupBy(file_name(F.col("folder")).alias("bundle")).agg(
        F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set("media_type")).alias("types")
    )  # at most four types


def page(items: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of the inventory in the order image, video, audio, document, path."""
    place = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("media_type"))
    return items.where("media_type is not null").orderBy(place, "path").offset(offset).limit(size)


def kinds(items: DataFrame) -> DataFrame:
    """One row: which types the collection has, and the predominant one of the whole."""
    one = predominant_types(items.withColumn("folder", F.lit("all")))
    has = items.agg(*[F.coalesce(F.bool_or(F.col("media_type") == k), F.lit(False)).alias(k) for k in _ORDER])
    return has.withColumn("__k", F.lit("all")).join(one.withColumnRenamed("folder", "__k"), "__k", "left").select(
        *_ORDER, F.coalesce("kind", F.lit("image")).alias("kind")
    )
