"""Tiers, windows, orders and samples."""

from pyspark.sql import functions as F

from keepsift.functions.text import micros
from keepsift.operators import caching, naming, ordering as O, quota, rollups as R, tiers as T
from keepsift.operators.ranking import newest_n
from keepsift.plans import views as V
from keepsift.plans.q_rollups import stored_tiers, tiered
from keepsift.plans.q_scalars import NOW, now
from keepsift.plans.registry import positions, query
from keepsift.plans.views import js_round_sql, table


@query("assign_tiers", "tiered", "SELECT doc_id, total, tier FROM tiered")
def _(spark, d):
    return tiered(spark, d).select("doc_id", "total", "tier")


@query("assign_tiers_by_folder", "tiered_by_folder", "SELECT doc_id, total, tier FROM tiered_by_folder")
def _(spark, d):
    return tiered(spark, d, ["folder"]).select("doc_id", "total", "tier")


@query("assign_tiers_lineitem", "", """SELECT l_orderkey, l_linenumber, CASE WHEN total < 30 THEN 'rejected' WHEN rn <= s THEN 'S' WHEN rn <= s + a THEN 'A' WHEN rn <= s + 2 * a THEN 'B' ELSE 'rejected' END AS tier FROM (SELECT *, greatest(1, ceil(n * 0.1::DOUBLE)) AS s, ceil(n * 0.3::DOUBLE) AS a FROM (
SELECT *, row_number() OVER (ORDER BY total DESC, image_id) AS rn, count(*) OVER () AS n FROM (SELECT l_orderkey, l_linenumber, substr(sha256(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 16) AS image_id, (l_quantity * 2)::DOUBLE AS total FROM lineitem)))""")
def _(spark, d):
    # Few distinct totals: large ties at each cut.
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.substring(F.sha2(key, 256), 1, 16).alias("image_id"), (F.col("l_quantity") * 2).alias("total"))
    return T.assign_tiers(rows).select("l_orderkey", "l_linenumber", "tier")


@query("top_percent", "tiered", "SELECT doc_id, total FROM (SELECT *, row_number() OVER (ORDER BY total DESC, image_id) AS rn, count(*) OVER () AS n FROM tiered WHERE tier IN ('S','A')) WHERE rn <= greatest(1, ceil(n * (28 / 100.0::DOUBLE)))")
def _(spark, d):
    return T.top_percent(T.keepers(stored_tiers(spark, d)), 28).select("doc_id", "total")


_FILL = """SELECT doc_id, CASE WHEN tier IN ({tiers}) AND row_number() OVER (PARTITION BY {part} tier IN ({tiers}) ORDER BY total DESC, image_id) <= greatest(0, {target} - count(*) FILTER (tier IN ('S','A')) OVER (PARTITION BY {group})) THEN 'A' ELSE tier END AS tier FROM {view}"""


@query("fill_shortfall", "tiered", _FILL.format(tiers="'B'", part="", group="1", target=500, view="tiered"))
def _(spark, d):
    return T.fill_shortfall(stored_tiers(spark, d), 500, "fillWithB").select("doc_id", "tier")


@query("fill_shortfall_rejected", "tiered_by_folder", _FILL.format(tiers="'B','rejected'", part="folder,", group="folder", target=35, view="tiered_by_folder"))
def _(spark, d):
    return T.fill_shortfall(stored_tiers(spark, d, ["folder"]), 35, "fillWithRejected", by=["folder"]).select("doc_id", "tier")


@query("fill_shortfall_stop", "tiered", "SELECT doc_id, tier FROM tiered")
def _(spark, d):
    return T.fill_shortfall(tiered(spark, d), 500, "stop").select("doc_id", "tier")


@query("top_n", "scores", "SELECT doc_id, total FROM scores ORDER BY total DESC, image_id LIMIT 100")
def _(spark, d):
    return T.top_n(V.scores(spark, d), 100).select("doc_id", "total")


V.VIEWS_SQL["evicted"] = f"""SELECT *, CASE WHEN old THEN 'age' WHEN alls - (upto - sz) > 1000000 THEN 'size' END AS reason FROM (
    SELECT *, sum(sz) OVER (PARTITION BY folder) AS alls, sum(sz) OVER (PARTITION BY folder ORDER BY cached_at, cache_key ROWS UNBOUNDED PRECEDING) AS upto FROM (
    SELECT *, CASE WHEN old THEN 0 ELSE size_bytes END AS sz FROM (SELECT *, epoch_us(TIMESTAMP '{NOW}') - epoch_us(cached_at) > 15::BIGINT * 86400000000 AS old FROM cache_entries)))"""
V.NEEDS["evicted"] = ["cache_entries"]


def evicted(spark, d):
    return caching.evict(V.cache_entries(spark, d), now(), 15, 1000000)


@query("evict_lru", "evicted", "SELECT cache_key, reason FROM evicted")
def _(spark, d):
    return evicted(spark, d).select("cache_key", "reason")


@query("cleanup_totals", "evicted", "SELECT folder, count(*) AS deleted_files, sum(size_bytes)::BIGINT AS freed_bytes FROM evicted WHERE reason IS NOT NULL GROUP BY ROLLUP (folder)")
def _(spark, d):
    return R.cleanup_totals(evicted(spark, d).where("reason IS NOT NULL"))


@query("running_totals", "scores", f"""SELECT doc_id, rn AS scored_count, ti AS tokens_in_so_far, tout AS tokens_out_so_far, {js_round_sql('doc_id * 2.0::DOUBLE / rn * (1000 - rn)')}::BIGINT AS eta_seconds FROM (SELECT doc_id, row_number() OVER w AS rn, (sum(tokens_in) OVER w)::BIGINT AS ti, (sum(coalesce(tokens_out, 0)) OVER w)::BIGINT AS tout FROM scores WINDOW w AS (PARTITION BY folder ORDER BY doc_id ROWS UNBOUNDED PRECEDING))""")
def _(spark, d):
    rows = V.scores(spark, d).select("doc_id", "folder", "tokens_in", "tokens_out", (F.col("doc_id") * 2.0).alias("elapsed_s"), F.lit(1000).alias("planned"))
    out = O.running_totals(rows, [F.col("doc_id")], ["folder"], "planned")
    return out.select("doc_id", "scored_count", "tokens_in_so_far", "tokens_out_so_far", "eta_seconds")


@query("running_totals_session", "", """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS scored_count, (sum(l_quantity::BIGINT) OVER w)::BIGINT AS tokens_in_so_far FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    # One session over all rows: range-partitioned, no window over everything.
    from keepsift.operators.ranking import running

    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    out = running(table(spark, d, "lineitem"), order, sums={"tokens_in_so_far": F.col("l_quantity").cast("bigint")}, number="scored_count")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "scored_count", "tokens_in_so_far")


_SAMPLE = """SELECT doc_id, i AS sample_no FROM (SELECT *, least(8, greatest(5, ceil(n * 0.05::DOUBLE)))::BIGINT AS k FROM (SELECT doc_id, folder, row_number() OVER (PARTITION BY {p} ORDER BY filename, path) - 1 AS rn, count(*) OVER (PARTITION BY {p}) AS n FROM assets)), (SELECT unnest(range(8)) AS i)
WHERE i < k AND rn = CASE WHEN k >= n THEN i ELSE floor(i * (n - 1)::DOUBLE / (k - 1))::BIGINT END"""


@query("evenly_spaced_sample", "assets", _SAMPLE.format(p="1"))
def _(spark, d):
    return O.evenly_spaced_sample(V.assets(spark, d), [F.col("filename"), F.col("path")], narrow=("doc_id", "filename", "path")).select("doc_id", "sample_no")


@query("evenly_spaced_sample_by_folder", "assets", _SAMPLE.format(p="folder"))
def _(spark, d):
    return O.evenly_spaced_sample(V.assets(spark, d), [F.col("filename"), F.col("path")], ["folder"], ("doc_id", "filename", "path")).select("doc_id", "sample_no")


_NAMES = r"""WITH f AS (SELECT doc_id, path, CASE WHEN doc_id % 37 = 5 THEN regexp_replace(filename, '(\.[^.]*)$', '_' || (doc_id % 4 + 1) || '\1') ELSE filename END AS filename FROM assets),
e AS (SELECT DISTINCT regexp_replace(filename, '(\.[^.]*)$', CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_' || (doc_id % 7) END || '\1') AS filename FROM assets WHERE doc_id % 29 = 4),
m AS (SELECT *, regexp_replace(filename, '\.[^.]*$', '') AS base, regexp_extract(filename, '(\.[^.]*)$', 1) AS ext, row_number() OVER (PARTITION BY filename ORDER BY path) AS rk, filename IN (SELECT filename FROM e) AS ex FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY path) AS r FROM m WHERE ex OR rk > 1),
t AS (SELECT filename, regexp_extract(filename, '^(.*)_([1-9]\d*)(\.[^.]*)$', 1) AS base, regexp_extract(filename, '^(.*)_([1-9]\d*)(\.[^.]*)$', 3) AS ext, try_cast(regexp_extract(filename, '^(.*)_([1-9]\d*)(\.[^.]*)$', 2) AS BIGINT) AS k FROM (SELECT filename FROM e UNION SELECT filename FROM f)),
free AS (SELECT base, ext, k, row_number() OVER (PARTITION BY base, ext ORDER BY k) AS nth FROM (SELECT DISTINCT base, ext, unnest(range(1, 400)) AS k FROM r) c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.base = c.base AND t.ext = c.ext AND t.k = c.k))
SELECT doc_id, filename AS out_name FROM m WHERE NOT ex AND rk = 1 UNION ALL SELECT r.doc_id, r.base || '_' || free.k || r.ext FROM r JOIN free ON free.base = r.base AND free.ext = r.ext AND free.nth = r.r"""

def _files(spark, d):
    i = F.col("doc_id")
    extra = F.concat(F.lit("_"), (i % 4 + 1).cast("string"))
    name = F.when(i % 37 == 5, F.regexp_replace("filename", F.lit(r"(\.[^.]*)$"), F.concat(extra, F.lit("$1")))).otherwise(F.col("filename"))
    return V.assets(spark, d).select("doc_id", "path", name.alias("filename"))


def _existing(spark, d):
    i = F.col("doc_id")
    extra = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("_"), (i % 7).cast("string")))
    return V.assets(spark, d).where(i % 29 == 4).select(F.regexp_replace("filename", F.lit(r"(\.[^.]*)$"), F.concat(extra, F.lit("$1"))).alias("filename"))


@query("dedupe_filenames", "assets", _NAMES)
def _(spark, d):
    return naming.dedupe_filenames(_files(spark, d), _existing(spark, d)).select("doc_id", "out_name")


@query("export_keepers", "tiered", "SELECT image_id, path AS src_path, '/out/' || substr(path, 8) AS dest_path FROM tiered WHERE tier IN ('S','A')")
def _(spark, d):
    return naming.export_keepers(tiered(spark, d), V.ROOT, "/out", preserve=True)


@query("export_keepers_flat", "tiered", """WITH k AS (SELECT image_id, path, filename, row_number() OVER (PARTITION BY filename ORDER BY path) AS rk FROM tiered WHERE tier IN ('S','A'))
SELECT image_id, path AS src_path, '/out/' || CASE WHEN rk = 1 THEN filename ELSE regexp_replace(filename, '(\\.[^.]*)$', '_' || (rk - 1) || '\\1') END AS dest_path FROM k""")
def _(spark, d):
    return naming.export_keepers(stored_tiers(spark, d), V.ROOT, "/out", preserve=False)


@query("tag_blocks", "tiered", "SELECT doc_id, ((row_number() OVER (ORDER BY total DESC, image_id) - 1) // 5)::BIGINT AS block_no FROM tiered WHERE tier IN ('S','A')")
def _(spark, d):
    return O.blocks_of(T.keepers(tiered(spark, d)), [F.desc("total"), F.col("image_id")]).select("doc_id", "block_no")


@query("apply_overrides", "tiered overrides", "SELECT t.doc_id, coalesce(o.tier, t.tier) AS tier FROM tiered t LEFT JOIN (SELECT doc_id, arg_max(tier, seq) AS tier FROM overrides WHERE NOT undone AND tier <> 'bogus' GROUP BY doc_id) o USING (doc_id)")
def _(spark, d):
    rows = tiered(spark, d).select(F.col("doc_id").alias("image_id"), "tier")
    log = V.overrides(spark, d).withColumnRenamed("doc_id", "image_id")
    return T.apply_overrides(rows, log).select(F.col("image_id").alias("doc_id"), "tier")


@query("undo_stack", "overrides", "SELECT seq, doc_id, tier FROM overrides WHERE NOT undone ORDER BY seq DESC LIMIT 20")
def _(spark, d):
    return T.undo_stack(V.overrides(spark, d)).select("seq", "doc_id", "tier")


@query("retier_after_rescore", "scores", """WITH m AS (SELECT s.doc_id, image_id, exceeds_face_limit, CASE WHEN l.doc_id IS NOT NULL THEN 40.0 + l.quality * 50 ELSE total END::DOUBLE AS total FROM scores s LEFT JOIN labels l ON l.doc_id = s.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY exceeds_face_limit ORDER BY total DESC, image_id) AS rn, count(*) OVER (PARTITION BY exceeds_face_limit) AS n FROM m)
SELECT doc_id, total, CASE WHEN exceeds_face_limit OR total < 30 THEN 'rejected' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN 'S' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + ceil(n * 0.3::DOUBLE) THEN 'A' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + 2 * ceil(n * 0.3::DOUBLE) THEN 'B' ELSE 'rejected' END AS tier FROM r""")
def _(spark, d):
    ids = V.assets(spark, d).select("doc_id", "image_id")
    fresh = table(spark, d, "labels").join(ids, "doc_id").select("image_id", (40.0 + F.col("quality") * 50).alias("total"))
    return T.retier_after_rescore(V.scores(spark, d), fresh).select("doc_id", "total", "tier")


@query("page_of", "assets", "SELECT doc_id, rn AS position, (rn // 6)::BIGINT AS grid_row, (rn % 6)::BIGINT AS grid_col FROM (SELECT doc_id, row_number() OVER (ORDER BY filename, path) - 1 AS rn FROM assets)")
def _(spark, d):
    return O.page_of(V.assets(spark, d), [F.col("filename"), F.col("path")], 6).select("doc_id", "position", "grid_row", "grid_col")


@query("order_by_basename", "assets", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN filename LIKE '\\_%' ESCAPE '\\' THEN 0 ELSE 1 END, lower(filename), path) AS position FROM assets")
def _(spark, d):
    # The position in locale order: names with a leading underscore come first.
    ordered = V.assets(spark, d).withColumn("key", O.basename_key())
    return O.running(ordered, [F.col("key"), F.col("path")], number="position").select("doc_id", "position")


@query("order_by_tier_score", "tiered", "SELECT doc_id, tier, total, row_number() OVER (ORDER BY CASE tier WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, total DESC, image_id) AS position FROM tiered")
def _(spark, d):
    return positions(O.order_by_tier_score(tiered(spark, d)).select("doc_id", "tier", "total"))


@query("order_by_total", "scores", "SELECT doc_id, total, row_number() OVER (ORDER BY total DESC, image_id) AS position FROM scores")
def _(spark, d):
    return positions(O.order_by_total(V.scores(spark, d)).select("doc_id", "total"))


@query("recent_list", "", "SELECT event_type AS kind, user_id AS value, epoch_us(last_used) AS last_us FROM (SELECT event_type, user_id, max(ts) AS last_used, row_number() OVER (PARTITION BY event_type ORDER BY max(ts) DESC, user_id) AS rn FROM events GROUP BY event_type, user_id) WHERE rn <= 10")
def _(spark, d):
    uses = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("value"), "ts")
    return O.recent_list(uses).select("kind", "value", micros(F.col("last_used")).alias("last_us"))


def history(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("completed_at"), "o_orderpriority", F.col("o_totalprice").alias("top_score"))


@query("latest_sessions", "", "SELECT o_orderpriority, o_orderkey AS session_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 30")
def _(spark, d):
    return O.latest_sessions(history(spark, d), by=["o_orderpriority"]).select("o_orderpriority", "session_id")


@query("trimmed_sessions", "", "SELECT o_custkey, greatest(0, count(*) - 5)::BIGINT AS removed FROM orders GROUP BY o_custkey")
def _(spark, d):
    return O.trimmed_sessions(table(spark, d, "orders"), 5, ["o_custkey"])


@query("profiles_newest", "", "SELECT c_custkey AS id, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer")
def _(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_acctbal").alias("created_at"))
    return positions(O.profiles_newest(p).select("id", "c_name"))


@query("rank_by_match", "catalog", "SELECT model, match_rank, row_number() OVER (ORDER BY match_rank, model) AS position FROM (SELECT model, CASE WHEN lower(model) = 'gpt-4-1' THEN 0 WHEN starts_with(lower(model), 'gpt-4-1') THEN 1 ELSE 2 END::INTEGER AS match_rank FROM catalog WHERE contains(lower(model), 'gpt-4-1'))")
def _(spark, d):
    return O.rank_by_match(V.catalog(spark, d), " GPT-4-1 ").select("model", "match_rank").transform(positions)


@query("preferred_first", "catalog", "SELECT model, preferred, row_number() OVER (ORDER BY preferred DESC, model) AS position FROM (SELECT model, starts_with(lower(model), 'llava') OR starts_with(lower(model), 'moondream') AS preferred FROM catalog)")
def _(spark, d):
    return positions(O.preferred_first(V.catalog(spark, d)).select("model", "preferred"))


@query("selection_check", "assets", "SELECT folder, 50::BIGINT AS requested, count(*) AS available, count(*) < 50 AS fewer_than_requested FROM assets GROUP BY folder")
def _(spark, d):
    return O.selection_check(V.assets(spark, d), 50, ["folder"])


_QUOTA_SQL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM usage_events WHERE quota IS NOT NULL),
st(user_id, rn, seq, month, cnt, last_us, ok, err, rem) AS (
SELECT user_id, 0::BIGINT, -1::BIGINT, '', 0::BIGINT, 0::BIGINT, true, NULL::VARCHAR, 0::BIGINT FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, rn, seq, CASE WHEN ok THEN month_key ELSE month END, CASE WHEN ok THEN c0 + n ELSE cnt END, CASE WHEN ok THEN ts_us ELSE last_us END, ok, CASE WHEN ok THEN NULL WHEN tamper THEN 'CLOCK_TAMPER' ELSE 'QUOTA_EXCEEDED' END,
  CASE WHEN ok THEN quota - c0 - n WHEN tamper THEN 0 ELSE greatest(0, quota - c0) END FROM (
  SELECT *, NOT tamper AND c0 + n <= quota AS ok FROM (
  SELECT e.*, st.month, st.cnt, st.last_us, CASE WHEN e.month_key <> st.month THEN 0 ELSE st.cnt END AS c0, e.month_key = st.month AND e.ts_us < st.last_us - 3600000000 AS tamper FROM st JOIN e ON e.user_id = st.user_id AND e.rn = st.rn + 1)))
SELECT user_id, seq, ok AS success, rem AS remaining, err AS error FROM st WHERE rn > 0 UNION ALL SELECT user_id, seq, true, 9007199254740991, NULL FROM usage_events WHERE quota IS NULL"""


@query("quota_fold", "usage_events", _QUOTA_SQL)
def _(spark, d):
    return quota.quota_fold(V.usage_events(spark, d)).select("user_id", "seq", "success", "remaining", "error")
