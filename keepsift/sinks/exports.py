"""Reports, sidecar documents and file lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import paths as P
from keepsift.functions import text as X
from keepsift.operators.joins import resolve_paths
from keepsift.operators.ordering import order_by_tier_score
from keepsift.operators.rollups import tier_counts


def results_rows(scores: DataFrame) -> DataFrame:
    """Nested report rows by tier, then score; `faces` is NULL where nothing was detected at all."""
    faces = F.when(
        F.col("has_faces").isNotNull(),
        F.struct(
            F.col("has_faces").alias("detected"),
            F.col("face_count").alias("count"),
            F.col("eyes_open").alias("eyesOpen"),
            F.col("blink_detected").alias("blinkDetected"),
        ),
    )
    return order_by_tier_score(scores).select(
        "filename",
        "tier",
        F.col("total").alias("score"),
        F.struct(*K.DIMENSIONS).alias("scores"),
        "reasoning",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        faces.alias("faces"),
    )


def export_results_json(scores: DataFrame, path: str) -> None:
    """Report as JSON lines; part files in name order keep the order of the rows."""
    results_rows(scores).write.mode("overwrite").option("ignoreNullFields", False).json(path)


# Fixed text of the report.
CSV_HEADER = "﻿Filename,Tier,Total Score,Quality,Aesthetic,Composition,Sharpness,Exposure,FaceEyes,Keywords,Reasoning"


def csv_line() -> Column:
    """One line of the report; a missing value is an empty cell."""
    cells = [
        X.csv_name(F.col("filename")),
        F.col("tier"),
        F.when(F.col("total").isNotNull(), F.format_string("%.2f", F.col("total"))),
        *[F.col(d).cast("string") for d in K.DIMENSIONS],
        X.csv_keywords(F.col("keywords")),
        X.csv_quote(F.col("reasoning")),
    ]
    return F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells])


def csv_rows(scores: DataFrame) -> DataFrame:
    """(line) of the report: BOM and header first, then total descending."""
    head = scores.sparkSession.createDataFrame([(0, None, None, CSV_HEADER)], "_k int, _t double, _id string, line string")
    body = scores.select(
        F.lit(1).alias("_k"), (-F.col("total")).alias("_t"), F.col("image_id").alias("_id"), csv_line().alias("line")
    )
    return head.unionByName(body).orderBy("_k", "_t", "_id").select("line")


def export_results_csv(scores: DataFrame, path: str) -> None:
    """Part files that concatenate, in name order, to the CSV report."""
    csv_rows(scores).write.mode("overwrite").text(path)


# Document format read by photo tools; fixed text.
XMP_HEAD = (
    '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n'
    '<x:xmpmeta xmlns:x="adobe:ns:meta/">\n'
    '  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
    '    <rdf:Description rdf:about=""\n'
    '        xmlns:xmp="http://ns.adobe.com/xap/1.0/"\n'
    '        xmlns:dc="http://purl.org/dc/elements/1.1/">\n'
)
XMP_TAIL = '\n    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>'


def sidecar_xml(tier: Column, reasoning: Column, keywords: Column, include_description: bool) -> Column:
    """Rating and colour label, with description and keyword bag where there are any.

    All markup here is fixed text of the document format.
    """
    told = F.trim(F.coalesce(reasoning, F.lit("")))
    description = F.when(
        F.lit(include_description) & (told != ""),
        F.concat(
            F.lit('\n      <dc:description>\n        <rdf:Alt>\n          <rdf:li xml:lang="x-default">'),
            X.escape_xml(told),
            F.lit("</rdf:li>\n        </rdf:Alt>\n      </dc:description>"),
        ),
    ).otherwise("")
    items = F.transform(
        keywords, lambda k: F.concat(F.lit("          <rdf:li>"), X.escape_xml(k), F.lit("</rdf:li>"))
    )
    bag = F.when(
        F.coalesce(F.size(keywords), F.lit(0)) > 0,
        F.concat(
            F.lit("\n      <dc:subject>\n        <rdf:Bag>\n"),
            F.array_join(items, "\n"),
            F.lit("\n        </rdf:Bag>\n      </dc:subject>"),
        ),
    ).otherwise("")
    return F.concat(
        F.lit(XMP_HEAD),
        F.lit("      <xmp:Rating>"),
        X.tier_rating(tier).cast("string"),
        F.lit("</xmp:Rating>\n      <xmp:Label>"),
        X.tier_label(tier),
        F.lit("</xmp:Label>"),
        description,
        bag,
        F.lit(XMP_TAIL),
    )


def sidecars(scores: DataFrame, assets: DataFrame, include_description: bool = True) -> DataFrame:
    """(image_id, sidecar_path, xml, error): one document per score; no path gives an error row."""
    placed = resolve_paths(scores, assets)
    xml = sidecar_xml(F.col("tier"), F.col("reasoning"), F.col("keywords"), include_description)
    found = F.col("error").isNull()
    return placed.select(
        "image_id",
        F.when(found, P.sidecar_path(F.col("path"))).alias("sidecar_path"),
        F.when(found, xml).alias("xml"),
        "error",
    )


def write_sidecars(documents: DataFrame) -> DataFrame:
    """Write each document to its path in the tasks; returns (image_id, written, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                error = r.error
                if error is None:
                    try:
                        p = r.sidecar_path
                        system, local = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
                        with system.open_output_stream(local) as f:
                            f.write(r.xml.encode("utf-8"))
                    except Exception as e:  # noqa: BLE001 - reported per row
                        error = f"{type(e).__name__}: {e}"
                out.append((r.image_id, error is None, error))
            yield pd.DataFrame(out, columns=["image_id", "written", "error"])

    return documents.mapInPandas(run, "image_id string, written boolean, error string")


def copy_files(plan: DataFrame) -> DataFrame:
    """Carry out a copy plan in the tasks; returns (image_id, copied, error). Targets are
    overwritten, so a repeated task gives the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyarrow import fs

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                error = None
                try:
                    if "://" not in r.dest_path:
                        os.makedirs(os.path.dirname(r.dest_path), exist_ok=True)
                    fs.copy_files(r.src_path, r.dest_path)
                except Exception as e:  # noqa: BLE001 - reported per row
                    error = f"{type(e).__name__}: {e}"
                out.append((r.image_id, error is None, error))
            yield pd.DataFrame(out, columns=["image_id", "copied", "error"])

    return plan.mapInPandas(run, "image_id string, copied boolean, error string")


def bundle_manifest(files: DataFrame, cache_dir: str = ".preview_cache") -> DataFrame:
    """(path, archive_name) of a portable bundle: the session and report at the top, all sidecars
    that do not lie below a cache folder."""
    rel = F.col("relative_path")
    top = rel.isin("session.json", "results.json")
    cached = F.concat(F.lit("/"), rel).contains(f"/{cache_dir}/")
    xmp = F.lower(rel).endswith(".xmp") & ~cached
    return files.where(top | xmp).select("path", rel.alias("archive_name"))


def summary(sessions: DataFrame, scores: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Per session: identity, counts per tier and, from `shortfall_reasons(..., by=["session_id"])`, why
    there are fewer keepers than hoped; NULL where a session has none."""
    counts = tier_counts(scores, ["session_id"]).select(
        "session_id", F.struct(*[F.col(f"n_{t}").alias(t) for t in K.TIERS]).alias("tier_counts")
    )
    out = sessions.join(counts, "session_id", "left")
    if reasons is None:
        return out
    why = F.struct(*[c for c in reasons.columns if c != "session_id"]).alias("shortfall_reasons")
    return out.join(reasons.select("session_id", why), "session_id", "left")


def write_summary(sessions: DataFrame, scores: DataFrame, path: str, reasons: DataFrame | None = None) -> None:
    summary(sessions, scores, reasons).write.mode("overwrite").option("ignoreNullFields", False).json(path)
