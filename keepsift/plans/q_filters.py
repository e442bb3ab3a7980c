"""Scans and filters over the derived assets, events and pages."""

from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import paths as P
from keepsift.operators import filters as O
from keepsift.plans import views as V
from keepsift.plans.q_scalars import NOW, now
from keepsift.plans.registry import query
from keepsift.plans.views import table
from keepsift.sources import listing as L

_EXT = "lower(regexp_extract(filename, '(\\.[^.]*)$', 1))"
_SUPPORTED = ",".join(repr(e) for e in K.SUPPORTED_EXTENSIONS)
IGNORE = ("IMG_00*", "src1/*/d0/**", "**/d1/*_MG_*.nef")
_IGNORED = r"(regexp_matches(relative_path, '(?i)(?:^|/)IMG_00[^/]*$') OR regexp_matches(relative_path, '(?i)^src1/[^/]*/d0/.*$') OR regexp_matches(relative_path, '(?i)^.*d1/[^/]*_MG_[^/]*\.nef$'))"


def listing(spark, d):
    """Listing with hidden and junk entries: every asset plus one hidden variant of some."""
    a = V.assets(spark, d).select("doc_id", "path", "length")
    i = F.col("doc_id")
    odd = a.where(i % 10 == 3).withColumn(
        "path",
        F.when(i % 40 == 3, F.concat(P.dirname(F.col("path")), F.lit("/.x.jpg")))
        .when(i % 40 == 13, F.concat(P.dirname(F.col("path")), F.lit("/Thumbs.db")))
        .when(i % 40 == 23, F.concat(P.dirname(F.col("path")), F.lit("/.hid/y.jpg")))
        .otherwise(F.concat(P.dirname(F.col("path")), F.lit("/node_modules/z.jpg"))),
    )
    return L.from_manifest(a.unionByName(odd), V.ROOT)


V.VIEWS_SQL["listing"] = """SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename, substr(path, 8) AS relative_path FROM (SELECT doc_id, path, length FROM assets UNION ALL
    SELECT doc_id, regexp_replace(path, '/[^/]*$', '') || CASE doc_id % 40 WHEN 3 THEN '/.x.jpg' WHEN 13 THEN '/Thumbs.db' WHEN 23 THEN '/.hid/y.jpg' ELSE '/node_modules/z.jpg' END, length FROM assets WHERE doc_id % 10 = 3)"""
V.NEEDS["listing"] = ["assets"]
_VISIBLE = r"NOT regexp_matches(relative_path, '(?:^|/)(?:\.|Thumbs\.db$)')"
_ENTERED = "NOT contains(relative_path, 'node_modules/')"


@query("scan_assets", "listing", f"SELECT path FROM listing WHERE {_VISIBLE} AND {_EXT} IN ('.jpg', '.cr3', '.nef') AND (starts_with(lower(filename), 'img_') OR starts_with(lower(filename), '_mg_')) AND NOT {_IGNORED}")
def _(spark, d):
    files = listing(spark, d)
    return L.scan_assets(files, [".JPG", ".cr3", ".nef"], ["img_", "_MG_"], ignore=IGNORE, recursive=True).select("path")


@query("walk_folders", "listing", f"SELECT DISTINCT CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END AS folder FROM listing WHERE {_VISIBLE} AND {_ENTERED} UNION SELECT ''")
def _(spark, d):
    return L.walk_folders(listing(spark, d))


@query("list_all_files", "listing", f"SELECT path FROM listing WHERE {_VISIBLE} AND {_ENTERED}")
def _(spark, d):
    return L.list_all_files(listing(spark, d)).select("path")


@query("filter_hidden", "listing", f"SELECT path FROM listing WHERE {_VISIBLE}")
def _(spark, d):
    return O.filter_hidden(listing(spark, d)).select("path")


@query("filter_extensions", "assets", f"SELECT doc_id FROM assets WHERE {_EXT} IN ('.cr3', '.png')")
def _(spark, d):
    return O.filter_extensions(V.assets(spark, d), [".CR3", ".png"]).select("doc_id")


@query("filter_supported", "assets", f"SELECT doc_id FROM assets WHERE {_EXT} IN ({_SUPPORTED})")
def _(spark, d):
    return O.filter_supported(V.assets(spark, d)).select("doc_id")


@query("filter_prefixes", "assets", "SELECT doc_id, starts_with(filename, 'IMG_') AS exact FROM assets WHERE starts_with(lower(filename), 'img_') OR starts_with(lower(filename), 'dsc_00')")
def _(spark, d):
    kept = O.filter_prefixes(V.assets(spark, d), ["img_", "DSC_00"])
    return kept.select("doc_id", O.has_prefix(F.col("filename"), ["IMG_"], any_case=False).alias("exact"))


@query("filter_ignored", "assets", f"SELECT doc_id FROM assets WHERE NOT {_IGNORED}")
def _(spark, d):
    return O.filter_ignored(V.assets(spark, d), IGNORE).select("doc_id")


@query("split_face_limit", "rolled", f"SELECT image_id, CASE WHEN face_count > 4 THEN 'Auto-rejected: ' || face_count || ' faces detected, limit is 4.' END AS reasoning, CASE WHEN face_count > 4 THEN 'rejected' END AS tier, CASE WHEN face_count > 4 THEN 0.0::DOUBLE END AS total FROM rolled")
def _(spark, d):
    ok, rejected = O.split_face_limit(V.rolled_faces(spark, d), 4)
    cols = ["image_id", "reasoning", "tier", "total"]
    return rejected.select(cols).unionByName(ok.select("image_id"), allowMissingColumns=True)


@query("expired", "cache_entries", f"SELECT cache_key FROM cache_entries WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(cached_at) > 15::BIGINT * 86400000000")
def _(spark, d):
    return O.expired(V.cache_entries(spark, d), now(), 15).select("cache_key")


@query("compare_assets", "scores", "SELECT s.image_id, dimension, value FROM (SELECT * FROM (UNPIVOT (SELECT image_id, quality, aesthetic, composition, sharpness, exposure, \"faceEyes\" FROM scores) ON quality, aesthetic, composition, sharpness, exposure, \"faceEyes\" INTO NAME dimension VALUE value)) s WHERE image_id IN (SELECT image_id FROM scores ORDER BY total DESC, image_id LIMIT 3)")
def _(spark, d):
    s = V.scores(spark, d)
    ids = [r.image_id for r in s.orderBy(F.desc("total"), "image_id").limit(3).collect()]
    return O.compare_assets(s, ids)


@query("validate_rows", "dims", """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'input_folder' END, CASE WHEN doc_id % 1100 > 999 THEN 'num_to_select' END, CASE WHEN doc_id % 9 = 8 THEN 'genre' END,
CASE WHEN quality + 5 > 100 THEN 'quality' END, CASE WHEN doc_id % 13 = 0 THEN 'model' END, CASE WHEN doc_id % 14 < 1 OR doc_id % 14 > 10 THEN 'concurrency' END, CASE WHEN doc_id % 10 <> 9 AND NOT doc_id % 10 + 3 BETWEEN 5 AND 20 THEN 'duplicate_threshold' END], lambda x: x IS NOT NULL), ',') AS violations FROM dims""")
def _(spark, d):
    i = F.col("doc_id")
    rows = V.dims(spark, d).withColumns({
        "quality": F.col("quality") + 5,
        "input_folder": F.when(i % 7 == 0, "").otherwise("/in"), "output_folder": F.lit("/out"), "num_to_select": i % 1100,
        "genre": F.when(i % 9 == 8, "macro").otherwise("event"), "provider": F.lit("openai"), "model": F.when(i % 13 != 0, "m"),
        "concurrency": i % 14, "shortfall_strategy": F.lit("stop"), "export_mode": F.lit("copyToOutput"),
        "duplicate_threshold": F.when(i % 10 != 9, i % 10 + 3), "cache_max_gb": F.lit(5), "cache_max_days": F.lit(30), "tag_top_percent": F.lit(20),
    })
    return O.violations(rows, O.settings_rules()).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("valid_jpeg", "", "SELECT doc_id, doc_id % 3 = 0 AND n_chars > 0 AS is_jpeg FROM documents")
def _(spark, d):
    doc = table(spark, d, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFD8"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("89504E47")))
    return doc.select("doc_id", O.valid_jpeg(F.concat(head, F.encode("text", "utf-8"))).alias("is_jpeg"))


@query("image_dimensions", "", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id % 5000 ELSE 0 END::BIGINT AS width, CASE WHEN doc_id % 3 < 2 THEN n_chars % 60000 ELSE 0 END::BIGINT AS height FROM documents")
def _(spark, d):
    # PNG and JPEG headers carrying numbers of the row, followed by its text.
    w, h = F.col("doc_id") % 5000, F.col("n_chars") % 60000

    def hex_of(c, n):
        return F.lpad(F.hex(c.cast("bigint")), n, "0")

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_of(w, 8), hex_of(h, 8))
    jpeg = F.concat(F.lit("FFD8FFE000080000000000" + "00" + "FFC2001108"), hex_of(h, 4), hex_of(w, 4), F.lit("030000000000"))
    head = F.unhex(F.when(F.col("doc_id") % 3 == 0, png).when(F.col("doc_id") % 3 == 1, jpeg).otherwise(F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", F.concat(head, F.encode("text", "utf-8")).alias("content"))
    return rows.select("doc_id", L.image_dimensions(F.col("content")).alias("s")).select("doc_id", "s.width", "s.height")


@query("choose_preview", "assets", f"SELECT doc_id, CASE WHEN {_EXT} NOT IN ('.cr3', '.nef') THEN 'passthrough' WHEN doc_id % 5 > 0 AND (doc_id % 4 = 0 OR doc_id % 2000 >= 1024) THEN 'embedded' ELSE 'decoded' END AS preview, CASE WHEN {_EXT} NOT IN ('.cr3', '.nef') THEN 'passthrough' ELSE 'decoded' END AS scoring FROM assets")
def _(spark, d):
    i = F.col("doc_id")
    w = F.when(i % 4 == 0, F.lit(None)).otherwise(i % 2000)
    p = F.col("path")
    return V.assets(spark, d).select(
        "doc_id", O.choose_preview(p, w, F.lit(3000), i % 5 > 0).alias("preview"), O.choose_preview(p, w, F.lit(3000), i % 5 > 0, False).alias("scoring")
    )


@query("model_catalog", "catalog", """SELECT page_id, model, contains(model, 'claude') AS by_text, starts_with(lower(model), 'gpt-4') OR starts_with(lower(model), 'o3') AS by_prefix, generates AND contains(model, 'gemini') AS by_method FROM catalog WHERE model <> ''""")
def _(spark, d):
    c = V.catalog(spark, d)
    parts = {
        "by_text": O.filter_model_catalog(c, contains="claude"),
        "by_prefix": O.filter_model_catalog(c, prefixes=K.OPENAI_VISION_PREFIXES),
        "by_method": O.filter_model_catalog(c, contains="gemini", method="generateContent"),
    }
    out = O.filter_model_catalog(c).select("page_id", "model")
    for name, rows in parts.items():
        out = out.join(rows.select("page_id", F.lit(True).alias(name)), "page_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query("maintenance_due", "", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) >= 7::BIGINT * 86400000000 END AS due FROM events")
def _(spark, d):
    last = F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.col("ts").cast("string"))
    return table(spark, d, "events").select("event_id", O.maintenance_due(last, now()).alias("due"))


@query("fresh_within_ttl", "", f"SELECT event_id, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) < 3600000000::BIGINT AS fresh FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", O.is_fresh(F.col("ts"), now()).alias("fresh"))


@query("size_cap", "", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'larger than 2000 bytes' END AS refused, CASE WHEN n_chars <= 2000 THEN md5(base64(encode(text))) END AS content_md5 FROM documents")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"), F.encode("text", "utf-8").alias("content"))
    # Base64 output is broken into lines of 76 characters; the check compares one line.
    return O.as_base64(rows, 2000).select("doc_id", "refused", F.md5(F.regexp_replace("base64", "[\r\n]", "")).alias("content_md5"))


@query("resume_action", "", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'show_results' WHEN o_custkey % 3 > 0 THEN 'offer_resume' ELSE 'start' END AS action FROM orders")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    return table(spark, d, "orders").select("o_orderkey", O.resume_action(status, F.col("o_custkey") % 3).alias("action"))


@query("keepers", "scores", """, r AS (SELECT image_id, total, exceeds_face_limit, CASE WHEN exceeds_face_limit THEN NULL ELSE row_number() OVER (PARTITION BY exceeds_face_limit ORDER BY total DESC, image_id) END AS rn, count(*) FILTER (NOT exceeds_face_limit) OVER () AS n FROM scores)
SELECT image_id, total FROM r WHERE rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + ceil(n * 0.3::DOUBLE) AND total >= 30""".replace(", r AS", "WITH r AS", 1))
def _(spark, d):
    from keepsift.operators.tiers import assign_tiers

    return O.by_tier(assign_tiers(V.scores(spark, d))).select("image_id", "total")


@query("below_floor", "scores", "SELECT image_id, total FROM scores WHERE total < 30 AND NOT exceeds_face_limit")
def _(spark, d):
    from keepsift.operators.tiers import below_floor

    return below_floor(V.scores(spark, d)).select("image_id", "total")
