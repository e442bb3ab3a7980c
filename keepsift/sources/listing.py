"""File listings, image headers, cache entries and ignore files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsift import constants as K
from keepsift.functions import paths as P
from keepsift.functions.text import from_micros
from keepsift.operators.filters import filter_extensions, filter_hidden, filter_ignored, filter_prefixes, valid_jpeg
from keepsift.operators.ordering import order_by_basename
from keepsift.session import store

LISTING = "path string, is_dir boolean, length bigint, modified_us bigint, error string"


def list_files(
    spark: SparkSession, root: str, recursive: bool = True, tasks: int | None = None, errors: bool = False
) -> DataFrame:
    """(path, length, modified_us, relative_path, filename) of all files below `root`.

    Folders are listed level by level, each level as one Spark job over its folders, with the
    file systems pyarrow knows (local, hdfs://, s3://, gs://). Unlike Spark's file sources this
    keeps names that start with `_`. For collections with a manifest table use `from_manifest`.

    A folder that may not be read, or went meanwhile, has no files; with `errors` it comes out as a row with an
    `error`. Any other failure, a time-out or throttling, fails the task and so is tried again or ends the job.
    """
    base = root.rstrip("/")
    level = spark.createDataFrame([(base, True, 0, 0, None)], LISTING)
    found = []
    while True:
        dirs = level.where("is_dir").select("path")
        spread = dirs.repartition(tasks or spark.sparkContext.defaultParallelism, "path")
        level = store(spread.mapInPandas(_list_dirs, LISTING), "listing")
        found.append(level.where("NOT is_dir" if errors else "NOT is_dir AND error IS NULL"))
        deeper = level.where("is_dir")
        if not recursive or deeper.isEmpty():
            break
        # Hidden folders are pruned before they are listed.
        level = deeper.where(~F.col("path").rlike(r"/\.[^/]*$"))
    listed = reduce(DataFrame.unionByName, found).drop("is_dir", *([] if errors else ["error"]))
    return from_manifest(listed, base)


def _list_dirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    columns = ["path", "is_dir", "length", "modified_us", "error"]
    for pdf in batches:
        for folder in pdf["path"]:
            system, local = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            prefix = folder[: len(folder) - len(local)] if "://" in folder else ""
            try:
                infos = system.get_file_info(fs.FileSelector(local))
            except (PermissionError, FileNotFoundError) as e:
                yield pd.DataFrame([(folder, False, 0, 0, f"{type(e).__name__}: {e}")], columns=columns)
                continue
            rows = [
                (prefix + i.path, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1000, None) for i in infos
            ]
            for at in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[at : at + 10_000], columns=columns)


def from_manifest(manifest: DataFrame, root: str) -> DataFrame:
    """Listing columns for a table that has `path` (and what else it has)."""
    return manifest.withColumns(
        {"relative_path": P.relative_to(F.col("path"), root), "filename": P.basename(F.col("path"))}
    )


def list_all_files(files: DataFrame, recursive: bool = True) -> DataFrame:
    """Everything but hidden and junk names."""
    kept = filter_hidden(files, skipped_dirs=K.SKIPPED_DIRS)
    return kept if recursive else kept.where(~F.col("relative_path").contains("/"))


def scan_assets(
    files: DataFrame,
    extensions: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    any_case: bool = True,
    ignore: Sequence[str] = (),
    recursive: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Assets of a listing after all filters, by file name if `ordered`."""
    kept = filter_hidden(files)
    if not recursive:
        kept = kept.where(~F.col("relative_path").contains("/"))
    kept = filter_ignored(filter_prefixes(filter_extensions(kept, extensions), prefixes, any_case), ignore)
    return order_by_basename(kept) if ordered else kept


def walk_folders(files: DataFrame) -> DataFrame:
    """(folder) relative folders with at least one visible direct file, and the root as ''."""
    spark = files.sparkSession
    visible = filter_hidden(files, skipped_dirs=K.SKIPPED_DIRS)
    rel = F.col("relative_path")
    dirs = visible.select(F.when(rel.contains("/"), P.dirname(rel)).otherwise(F.lit("")).alias("folder"))
    return dirs.union(spark.createDataFrame([("",)], "folder string")).distinct()


def asset_columns(files: DataFrame) -> DataFrame:
    return files.withColumns(
        {
            "image_id": P.image_id(F.col("path")),
            "is_raw": P.is_raw(F.col("path")),
        }
    )


CONTENT = [T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]


#: Bytes of files that are given on at once, and rows.
CONTENT_BYTES, CONTENT_ROWS = 4_000_000, 1_000


def read_contents(assets: DataFrame, good: bool = True, bad: bool = True) -> DataFrame:
    """The rows with content and error by reading each path in the tasks; a few megabytes, or one larger file, at a time
    in memory. The bytes go on with their row, so they are neither read again nor shuffled to meet it. Without `good`
    or `bad`, files that can be read, or those that cannot, are left out before anything leaves the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            places, contents, errors, held = [], [], [], 0

            def given() -> pd.DataFrame:
                return pdf.iloc[places].assign(content=contents, error=errors)  # noqa: B023 - called in this turn

            for at, path in enumerate(pdf["path"]):
                content, error = None, None
                try:
                    system, local = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    with system.open_input_stream(local) as f:
                        content = f.read()
                except Exception as e:  # noqa: BLE001 - a bad file must not stop the others
                    error = f"{type(e).__name__}: {e}"
                if not (good if error is None else bad):
                    continue
                size = len(content or b"")
                if places and (held + size > CONTENT_BYTES or len(places) == CONTENT_ROWS):
                    yield given()
                    places, contents, errors, held = [], [], [], 0
                places.append(at)
                contents.append(content)
                errors.append(error)
                held += size
            if places:
                yield given()

    return assets.mapInPandas(run, T.StructType([*assets.schema.fields, *CONTENT]))


def load_assets(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets with content and size, rejected with error). Bytes are read for listed rows only, once for each
    of the two that is used; to use both, store `read_contents(asset_columns(files))` and split it."""
    listed = asset_columns(files)
    good = read_contents(listed, bad=False).drop("error")
    dims = image_dimensions(F.col("content"))
    good = good.withColumn("_d", dims).withColumns({"width": F.col("_d.width"), "height": F.col("_d.height")}).drop("_d")
    return good, read_contents(listed, good=False).drop("content")


def _be(content: Column, start: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, n)), 16, 10).cast("bigint")


def _jpeg_size(data: bytes) -> dict:
    at = 2
    while at + 8 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return {"width": int.from_bytes(data[at + 7 : at + 9]), "height": int.from_bytes(data[at + 5 : at + 7])}
        at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return {"width": 0, "height": 0}


SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


@F.pandas_udf(SIZE)
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Size from the first frame header of a JPEG; 0 x 0 when there is none."""
    empty = {"width": 0, "height": 0}
    return pd.DataFrame([empty if c is None else _jpeg_size(bytes(c)) for c in content], columns=["width", "height"])


def image_dimensions(content: Column) -> Column:
    """struct(width, height) from a PNG or JPEG header, 0 x 0 otherwise."""
    png = F.coalesce(F.substring(content, 1, 4) == F.unhex(F.lit("89504E47")), F.lit(False)) & (F.length(content) >= 24)
    size = F.struct(_be(content, 17, 4).alias("width"), _be(content, 21, 4).alias("height"))
    none = F.struct(F.lit(0).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("height"))
    jpeg = jpeg_size(F.when(valid_jpeg(content), content))
    return F.when(png, size).when(valid_jpeg(content), jpeg).otherwise(none)


def read_ignore_file(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) lines of an ignore file without blanks and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#')")


SIDECAR = "cachedAt string, originalPath string, originalMtime double, originalSize bigint, cacheVersion int"


def list_cache_entries(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Cache files with the time of their sidecar(cache_key, cached_at), else their own mtime."""
    jpegs = files.where(F.lower(P.extension(F.col("filename"))) == ".jpg").withColumn(
        "cache_key", P.stem(F.col("filename"))
    )
    return jpegs.join(sidecars.select("cache_key", "cached_at"), "cache_key", "left").select(
        "cache_key",
        "folder",
        F.col("length").alias("size_bytes"),
        F.coalesce("cached_at", from_micros(F.col("modified_us"))).alias("cached_at"),
        F.col("cached_at").isNull().alias("from_mtime"),
    )
