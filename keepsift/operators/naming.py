"""Output names without collisions and the copy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.functions import paths as P
from keepsift.operators.ranking import SPLIT_ROWS, groups_fit, running
from keepsift.operators.tiers import keepers
from keepsift.session import store


def _numbered(names: DataFrame) -> DataFrame:
    """(base, ext, k) of names of the form base_k.ext with a plain k >= 1."""
    return (
        names.select(P.stem(F.col("filename")).alias("_stem"), P.extension(F.col("filename")).alias("ext"))
        .select(
            F.regexp_extract("_stem", r"^(.*)_([1-9]\d{0,17})$", 1).alias("base"),
            "ext",
            F.regexp_extract("_stem", r"^(.*)_([1-9]\d{0,17})$", 2).try_cast("bigint").alias("k"),
        )
        .where("k IS NOT NULL")
    )


def dedupe_filenames(files: DataFrame, existing: DataFrame | None = None, **options) -> DataFrame:
    """Add `out_name`, unique in a flat folder that already holds `existing(filename)`.

    The first file of a name (by path) keeps it unless it exists already. Every other file
    gets the next free `_N` of its name, skipping names that exist or that some file keeps.
    Names made for different originals cannot meet, so each name is numbered on its own: the
    r-th file takes r plus the number of taken suffixes below it, which a running count over
    files and taken suffixes together yields. A name shared by very many files is spread.
    """
    spark = files.sparkSession
    parts = {"base": P.stem(F.col("filename")), "ext": P.extension(F.col("filename"))}
    here = existing.select("filename").distinct() if existing is not None else spark.createDataFrame([], "filename string")
    first = files.groupBy("filename").agg(F.min("path").alias("path"))
    kept = first.join(here, "filename", "left_anti").select("path", F.lit(True).alias("_keeps"))
    # Stored, as the steps below read it several times.
    marked = store(files.withColumns(parts).join(kept, "path", "left"), "names")
    keeps = marked.where(F.col("_keeps")).select(*files.columns, F.col("filename").alias("out_name"))
    rest = marked.where(F.col("_keeps").isNull()).drop("_keeps")

    names = rest.select("base", "ext").distinct()
    taken = store(
        _numbered(here.union(first.select("filename"))).distinct().join(names, ["base", "ext"], "left_semi"), "taken"
    )
    keys = rest.select("base", "ext").unionByName(taken.select("base", "ext"))
    if "parts" not in options and groups_fit(keys, ["base", "ext"], options.get("split_rows", SPLIT_ROWS)):
        options = {**options, "fits": True}  # files and taken suffixes of a name together, so each of them as well
    ranked = running(rest, [F.col("path")], ["base", "ext"], number="_r", **options)
    taken = running(taken, [F.col("k")], ["base", "ext"], number="_j", **options)
    # A taken suffix k_j shifts every file with r > k_j - j.
    both = ranked.select(
        "base", "ext", F.col("_r").alias("_pos"), F.lit(0).alias("_is_taken"), F.struct(*files.columns).alias("_f")
    ).unionByName(
        taken.select("base", "ext", (F.col("k") - F.col("_j")).alias("_pos"), F.lit(1).alias("_is_taken"), "_j"),
        allowMissingColumns=True,
    )
    order = [F.col("_pos"), F.col("_is_taken"), F.coalesce("_j", F.lit(0)), F.coalesce("_f.path", F.lit(""))]
    shifted = running(both, order, ["base", "ext"], sums={"_skip": F.col("_is_taken")}, number=None, **options)
    suffix = (F.col("_pos") + F.col("_skip")).cast("string")
    renamed = shifted.where("_is_taken = 0").select("_f.*", F.concat("base", F.lit("_"), suffix, "ext").alias("out_name"))
    return keeps.unionByName(renamed)


def export_keepers(
    scores: DataFrame, source_root: str, target_root: str, preserve: bool, existing: DataFrame | None = None, **options
) -> DataFrame:
    """Copy plan (image_id, src_path, dest_path) for S and A assets(path, filename).

    Mirrors sub-folders, or flattens with unique names. A function of the keepers alone: the
    same keepers give the same plan.
    """
    rows = keepers(scores).select("image_id", "path", "filename")
    root = target_root.rstrip("/")
    if preserve:
        dest = F.concat(F.lit(root + "/"), P.relative_to(F.col("path"), source_root))
        return rows.select("image_id", F.col("path").alias("src_path"), dest.alias("dest_path"))
    named = dedupe_filenames(rows, existing, **options)
    return named.select(
        "image_id", F.col("path").alias("src_path"), F.concat(F.lit(root + "/"), "out_name").alias("dest_path")
    )
