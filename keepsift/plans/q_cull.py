"""Whole runs over the documents."""

from dataclasses import replace

from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.plans import views as V
from keepsift.plans.cull import cull, finish
from keepsift.plans.q_filters import _EXT, _SUPPORTED
from keepsift.plans.q_similarity import _components_sql
from keepsift.plans.registry import query
from keepsift.plans.views import weighted_sql
from keepsift.session import store
from keepsift.settings import Settings

SETTINGS = Settings(
    num_to_select=120, shortfall_strategy="fillWithB", max_faces_per_image=V.FACE_LIMIT, prefix_filter=("img_", "DSC_"), concurrency=5
)

V.VIEWS_SQL["cull_in"] = f"SELECT a.*, fp FROM assets a JOIN text_prints USING (doc_id) WHERE {_EXT} IN ({_SUPPORTED}) AND (starts_with(filename, 'IMG_') OR starts_with(filename, 'DSC_'))"
V.NEEDS["cull_in"] = ["assets", "text_prints", "dims"]

_OVER = f"(r.doc_id % 7 > {V.FACE_LIMIT} AND r.doc_id % 11 <> 3)"  # detection fails on every eleventh

_RUN = (
    _components_sql("cull_in", K.DEFAULT_DUPLICATE_THRESHOLD, "image_id")
    + f""", reps AS (SELECT m.*, row_number() OVER (PARTITION BY cluster_id ORDER BY filename, path) = 1 AS rep FROM m),
sc AS (SELECT r.doc_id, image_id, {_OVER} AS over, CASE WHEN {_OVER} THEN 0.0 ELSE {weighted_sql(K.GENRE_PRESETS['general'])} END::DOUBLE AS total FROM reps r JOIN dims USING (doc_id) WHERE rep),
rk AS (SELECT *, row_number() OVER (PARTITION BY over ORDER BY total DESC, image_id) AS rn, count(*) OVER (PARTITION BY over) AS n FROM sc),
t AS (SELECT *, CASE WHEN over OR total < 30 THEN 'rejected' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN 'S' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + ceil(n * 0.3::DOUBLE) THEN 'A' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + 2 * ceil(n * 0.3::DOUBLE) THEN 'B' ELSE 'rejected' END AS tier FROM rk),
done AS (SELECT doc_id, image_id, over, total, CASE WHEN tier = 'B' AND row_number() OVER (PARTITION BY tier ORDER BY total DESC, image_id) <= greatest(0, 120 - count(*) FILTER (tier IN ('S','A')) OVER ()) THEN 'A' ELSE tier END AS tier FROM t) """
)


def run(spark, d):
    prints = store(V.text_prints(spark, d), "prints")
    files = V.assets(spark, d).join(prints, "doc_id")
    faces = V.faces(spark, d).withColumnRenamed("image_id", "doc_id").join(V.assets(spark, d).select("doc_id", "image_id"), "doc_id").drop("doc_id")
    failing = F.col("image_id").isNotNull() & (F.col("doc_id") % 11 == 3)
    broken = V.assets(spark, d).where(failing).select("image_id", F.lit("detector broke").alias("error"))
    faces = faces.join(broken, "image_id", "left_anti").unionByName(broken, allowMissingColumns=True)
    return cull(files, faces, lambda a: a.select("*", *V.dim_columns("length")), SETTINGS, recursive=True)


@query("cull_run", "cull_in", _RUN + "SELECT doc_id, total, tier FROM done")
def _(spark, d):
    return run(spark, d).scores.select("doc_id", "total", "tier")


@query("cull_summary", "cull_in", _RUN + """SELECT (SELECT count(*) FROM reps WHERE NOT rep) AS duplicates_skipped, count(*) FILTER (total < 30 AND NOT over) AS below_threshold, count(*) FILTER (doc_id % 11 = 3) AS face_detection_failed, count(*) FILTER (over) AS exceeded_face_limit,
(SELECT count(*) FROM reps WHERE NOT rep) AS burst_grouped, count(*) FILTER (tier IN ('S','A')) AS final_selected, count(*) FILTER (tier = 'S') AS selected_s FROM done""")
def _(spark, d):
    return run(spark, d).reasons


FINISH = replace(SETTINGS, enable_sidecars=True, enable_auto_tagging=True)


def finished(spark, d):
    from keepsift.plans.q_inference import mock_tags

    return finish(run(spark, d), FINISH, V.ROOT, "/out", mock_tags, sleep=lambda s: None)


_KEPT = "(SELECT done.*, path, filename FROM done JOIN cull_in USING (doc_id))"


@query("cull_copies", "cull_in", _RUN + f"""SELECT image_id, path AS src_path, '/out/' || CASE WHEN rk = 1 THEN filename ELSE regexp_replace(filename, '(\\.[^.]*)$', '_' || (rk - 1) || '\\1') END AS dest_path
FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY path) AS rk FROM {_KEPT} WHERE tier IN ('S','A'))""")
def _(spark, d):
    return finished(spark, d).copies


@query("cull_sidecars", "cull_in", _RUN + f"""SELECT s.image_id, regexp_replace(path, '\\.[^./]*$', '') || '.xmp' AS sidecar_path, CASE tier WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 ELSE 1 END AS rating, tagged AND NOT starts_with(filename, 'DSC_') AS has_keywords
FROM (SELECT *, tier IN ('S','A') AND row_number() OVER (PARTITION BY tier IN ('S','A') ORDER BY total DESC, image_id) <= greatest(1, ceil((count(*) OVER (PARTITION BY tier IN ('S','A'))) * (20 / 100.0::DOUBLE))) AS tagged FROM {_KEPT}) s""")
def _(spark, d):
    xml = F.col("xml")
    return finished(spark, d).sidecars.select(
        "image_id", "sidecar_path", F.regexp_extract(xml, r"Rating>(\d)", 1).cast("int").alias("rating"), xml.contains("<dc:subject>").alias("has_keywords")
    )
