"""Aggregates over the derived tables."""

from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import paths as P
from keepsift.operators import filters as O
from keepsift.operators import rollups as R
from keepsift.operators import tiers as T
from keepsift.plans import views as V
from keepsift.plans.q_filters import _EXT, _IGNORED, _SUPPORTED, IGNORE, listing
from keepsift.plans.registry import query
from keepsift.session import store
from keepsift.plans.views import js_round_sql, table

# Tiers of the whole session, and per folder.
for name, part in (("tiered", ""), ("tiered_by_folder", "folder,")):
    V.VIEWS_SQL[name] = f"""SELECT * EXCLUDE (rn, n), CASE WHEN exceeds_face_limit OR total < 30 THEN 'rejected' WHEN rn <= s THEN 'S' WHEN rn <= s + a THEN 'A' WHEN rn <= s + 2 * a THEN 'B' ELSE 'rejected' END AS tier FROM (
        SELECT *, greatest(1, ceil(n * 0.1::DOUBLE)) AS s, ceil(n * 0.3::DOUBLE) AS a FROM (
        SELECT *, row_number() OVER (PARTITION BY {part} exceeds_face_limit ORDER BY total DESC, image_id) AS rn, count(*) OVER (PARTITION BY {part} exceeds_face_limit) AS n FROM scores))"""
    V.NEEDS[name] = ["scores"]


def tiered(spark, d, by=()):
    return T.assign_tiers(V.scores(spark, d), by=by)


def stored_tiers(spark, d, by=()):
    """Tiered scores as the table a finished session leaves behind."""
    return store(tiered(spark, d, by), "tiered")


def _pct(expr):
    return js_round_sql(f"({expr})::DOUBLE / count(*) * 100") + "::BIGINT"


_TIERS_SQL = ", ".join(f"count(*) FILTER (tier = '{t}') AS \"n_{t}\"" for t in K.TIERS) + ", " + ", ".join(
    _pct(f"count(*) FILTER (tier = '{t}')") + f' AS "pct_{t}"' for t in K.TIERS
)


@query("tier_counts", "tiered_by_folder", f"SELECT folder, count(*) AS total, {_TIERS_SQL} FROM tiered_by_folder GROUP BY folder")
def _(spark, d):
    return R.tier_counts(tiered(spark, d, ["folder"]), ["folder"])


@query("token_cost_totals", "scores", f"""SELECT provider, tokens_in, tokens_out, {js_round_sql("(tokens_in / 1000000.0::DOUBLE) * CASE provider WHEN 'claude' THEN 3.0 WHEN 'openai' THEN 2.0 WHEN 'gemini' THEN 1.5 ELSE 0.0 END::DOUBLE + (tokens_out / 1000000.0::DOUBLE) * CASE provider WHEN 'claude' THEN 15.0 WHEN 'openai' THEN 8.0 WHEN 'gemini' THEN 9.0 ELSE 0.0 END::DOUBLE", 4)} AS cost
FROM (SELECT provider, sum(tokens_in)::BIGINT AS tokens_in, sum(coalesce(tokens_out, 0))::BIGINT AS tokens_out FROM scores GROUP BY provider)""")
def _(spark, d):
    return R.token_cost_totals(V.scores(spark, d))


@query("extension_counts", "listing", f"SELECT {_EXT} AS extension, count(*) AS n, {_EXT} IN ({_SUPPORTED}) AS supported FROM listing WHERE NOT regexp_matches(relative_path, '(?:^|/)(?:\\.|Thumbs\\.db$)') AND {_EXT} <> '' GROUP BY ALL")
def _(spark, d):
    return R.extension_counts(listing(spark, d))


@query("prefix_count", "assets", "SELECT count(*) FILTER (starts_with(lower(filename), 'dsc_') OR starts_with(lower(filename), '_mg_01')) AS n FROM assets")
def _(spark, d):
    return R.prefix_count(V.assets(spark, d), ["DSC_", "_mg_01"])


@query("scan_count", "assets", f"SELECT count(*) AS n FROM assets WHERE {_EXT} IN ({_SUPPORTED})")
def _(spark, d):
    return R.scan_count(O.filter_supported(V.assets(spark, d)))


@query("ignored_count", "assets", f"SELECT count(*) FILTER ({_IGNORED}) AS ignored FROM assets")
def _(spark, d):
    return R.ignored_count(V.assets(spark, d), IGNORE)


@query("shortfall_reasons", "tiered", """SELECT folder, count(*) FILTER (dup) AS duplicates_skipped, count(*) FILTER (NOT dup AND total < 30 AND NOT exceeds_face_limit) AS below_threshold, count(*) FILTER (NOT dup AND doc_id % 23 = 0) AS face_detection_failed,
count(*) FILTER (NOT dup AND exceeds_face_limit) AS exceeded_face_limit, count(*) FILTER (dup) AS burst_grouped, count(*) FILTER (NOT dup AND tier IN ('S','A')) AS final_selected, count(*) FILTER (NOT dup AND tier = 'S') AS selected_s
FROM (SELECT *, doc_id % 6 = 1 AS dup FROM tiered) GROUP BY folder""")
def _(spark, d):
    rows = tiered(spark, d).withColumns({"is_representative": F.col("doc_id") % 6 != 1, "face_error": F.when(F.col("doc_id") % 23 == 0, "timeout")})
    return R.shortfall_reasons(rows, ["folder"])


@query("top_score", "scores", f"SELECT folder, {js_round_sql('max(total)', 2)} AS top_score FROM scores GROUP BY folder")
def _(spark, d):
    return R.top_score(V.scores(spark, d), ["folder"])


@query("face_rollup", "rolled", "SELECT * FROM rolled")
def _(spark, d):
    return V.rolled_faces(spark, d)


@query("cache_stats", "cache_entries", "SELECT folder, sum(size_bytes)::BIGINT AS size_bytes, count(*) AS file_count, epoch_us(min(cached_at)) AS oldest_us FROM cache_entries GROUP BY folder")
def _(spark, d):
    from keepsift.functions.text import micros

    return R.cache_stats(V.cache_entries(spark, d), ["folder"]).select("folder", "size_bytes", "file_count", micros(F.col("oldest_entry")).alias("oldest_us"))


@query("folder_rollup", "scores", "SELECT folder, count(*) AS images, count(total) AS scored, sum(elapsed_ms)::BIGINT AS elapsed_ms FROM scores GROUP BY folder")
def _(spark, d):
    return R.folder_rollup(V.scores(spark, d))


@query("preflight", "assets", f"""SELECT folder, files, supported, selected, CASE WHEN supported = 0 THEN 'UNSUPPORTED_FORMATS_ONLY' WHEN selected = 0 THEN 'NO_IMAGES_FOUND' END AS code, CASE WHEN selected > 5 THEN 'only 5 of ' || selected || ' allowed' END AS warning
FROM (SELECT folder, count(*) AS files, count(*) FILTER ({_EXT} IN ({_SUPPORTED})) AS supported, count(*) FILTER ({_EXT} = '.jpg' AND lang = 'fr') AS selected FROM assets GROUP BY folder)""")
def _(spark, d):
    kept = (F.lower(P.extension(F.col("filename"))) == ".jpg") & (F.col("lang") == "fr")
    return R.preflight(V.assets(spark, d), kept, 5, ["folder"])


V.VIEWS_SQL["status"] = f"""SELECT u.user_id, u.tier, coalesce(n, 0)::BIGINT AS current, CASE tier WHEN 'free' THEN 500 WHEN 'pro' THEN 5000 ELSE -1 END::BIGINT AS "limit",
    CASE tier WHEN 'lifetime' THEN -1 ELSE greatest(0, CASE tier WHEN 'free' THEN 500 ELSE 5000 END - coalesce(n, 0)) END::BIGINT AS remaining
    FROM users u LEFT JOIN (SELECT user_id, sum(n) AS n FROM usage_events WHERE month_key = '{V.MONTH}' GROUP BY user_id) USING (user_id)"""
V.NEEDS["status"] = ["users", "usage_events"]


@query("usage_status", "status", "SELECT * FROM status")
def _(spark, d):
    return R.usage_status(V.usage_events(spark, d), V.users(spark, d), V.MONTH)


@query("quota_check", "status", """SELECT user_id, requested, CASE WHEN "limit" = -1 OR (remaining > 0 AND requested <= remaining) THEN 'allowed' WHEN remaining > 0 THEN 'partial' ELSE 'exceeded' END AS quota,
CASE WHEN "limit" = -1 THEN -1 WHEN remaining <= 0 THEN 0 WHEN requested > remaining THEN remaining ELSE remaining - requested END::BIGINT AS remaining_after FROM (SELECT *, user_id % 700 AS requested FROM status)""")
def _(spark, d):
    s = R.usage_status(V.usage_events(spark, d), V.users(spark, d), V.MONTH).withColumn("requested", F.col("user_id") % 700)
    return R.quota_check(s).select("user_id", "requested", "quota", "remaining_after")


@query("no_faces_flag", "assets rolled", "SELECT folder, NOT bool_or(face_count > 3 AND a.doc_id % 50 = 0) AS no_faces FROM assets a JOIN rolled r ON r.image_id = a.doc_id GROUP BY folder")
def _(spark, d):
    r = V.rolled_faces(spark, d).select(F.col("image_id").alias("doc_id"), F.when((F.col("face_count") > 3) & (F.col("image_id") % 50 == 0), 1).otherwise(0).alias("face_count"))
    return R.no_faces_flag(V.assets(spark, d).join(r, "doc_id"), 15, ["folder"])


@query("timing_by_format", "assets", f"""SELECT extension, sum(ms) FILTER (passed)::BIGINT AS sum_ms, (sum(ms) FILTER (passed))::DOUBLE / count(*) FILTER (passed) AS avg_ms, min(ms) FILTER (passed) AS min_ms, max(ms) FILTER (passed) AS max_ms,
count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM (SELECT {_EXT} AS extension, length % 3000 AS ms, doc_id % 8 > 0 AS passed FROM assets) GROUP BY extension""")
def _(spark, d):
    runs = V.assets(spark, d).select(F.lower(P.extension(F.col("filename"))).alias("extension"), (F.col("length") % 3000).alias("ms"), (F.col("doc_id") % 8 > 0).alias("passed"))
    return R.timing_by_format(runs)


@query("stage_metrics", "", "SELECT event_type AS stage, sum(floor(value * 10))::BIGINT AS duration_ms, sum(1 + event_id % 9)::BIGINT AS items, sum(event_id % 9)::BIGINT AS successes, count(*)::BIGINT AS failures, max(event_id * 4096) AS peak_memory_bytes FROM events GROUP BY event_type")
def _(spark, d):
    i = F.col("event_id")
    m = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.floor(F.col("value") * 10).alias("duration_ms"), (1 + i % 9).alias("items"), (i % 9).alias("successes"), (i * 4096).alias("memory_bytes"))
    return R.stage_metrics(m)


_DRY = js_round_sql("(n * 800 / 1000000.0::DOUBLE) * 2.0::DOUBLE + (n * 200 / 1000000.0::DOUBLE) * 8.0::DOUBLE", 4)
_LOW, _HIGH = js_round_sql("n * 0.8::DOUBLE") + "::BIGINT", js_round_sql("n * 0.9::DOUBLE") + "::BIGINT"


@query("dry_run_estimate", "assets", f"SELECT folder, n AS files, n * 800 AS tokens_in, n * 200 AS tokens_out, {_DRY} AS cost, {_LOW} AS keepers_min, {_HIGH} AS keepers_max, greatest(0, 45 - {_HIGH})::BIGINT AS shortfall_min, greatest(0, 45 - {_LOW})::BIGINT AS shortfall_max FROM (SELECT folder, count(*) AS n FROM assets GROUP BY folder)")
def _(spark, d):
    return R.dry_run_estimate(V.assets(spark, d), "openai", 45, ["folder"])


@query("dir_size", "assets", "SELECT sum(length)::BIGINT AS bytes FROM assets WHERE starts_with(path, '/shoot/src1/')")
def _(spark, d):
    return R.dir_size(V.assets(spark, d), V.ROOT + "/src1")


@query("processed_skipped", "assets", "SELECT folder, count(*) FILTER (length >= 100) AS processed, count(*) FILTER (length < 100) AS skipped FROM assets GROUP BY folder")
def _(spark, d):
    return R.processed_skipped(V.assets(spark, d).withColumn("error", F.when(F.col("length") < 100, "too short")), ["folder"])


_LEFT = "(total_images - scored_count)"


@query("resume_estimate", "", f"""SELECT o_orderkey, {_LEFT} AS remaining, ceil({_LEFT} * CASE WHEN elapsed_ms / scored_count > 0 THEN elapsed_ms::DOUBLE / scored_count ELSE 5000.0::DOUBLE END / 60000.0::DOUBLE)::BIGINT AS remaining_minutes,
{js_round_sql(f"({_LEFT} * 800 / 1000000.0::DOUBLE) * 3.0::DOUBLE + ({_LEFT} * 200 / 1000000.0::DOUBLE) * 15.0::DOUBLE", 4)} AS remaining_cost
FROM (SELECT o_orderkey, 1000 + o_custkey % 500 AS total_images, 1 + o_orderkey % 900 AS scored_count, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 37 + 1000 ELSE 0 END AS elapsed_ms FROM orders)""")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = table(spark, d, "orders").select("o_orderkey", (1000 + c % 500).alias("total_images"), (1 + k % 900).alias("scored_count"), F.when(k % 4 > 0, c * 37 + 1000).otherwise(0).alias("elapsed_ms"), F.lit("claude").alias("provider"))
    return R.resume_estimate(s).select("o_orderkey", "remaining", "remaining_minutes", "remaining_cost")


@query("profile_limit", "users", "SELECT user_id, tier, coalesce(n, 0)::BIGINT AS profiles, tier <> 'free' OR coalesce(n, 0) < 2 AS may_add FROM users LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1) USING (user_id)")
def _(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return R.profile_limit(V.users(spark, d), p)
