"""Sets, logs, sessions, reports and file plans."""

from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.operators import sets as S
from keepsift.plans import views as V
from keepsift.plans.q_rollups import tiered
from keepsift.plans.registry import positions, query
from keepsift.plans.views import table
from keepsift.sinks import exports as X
from keepsift.sources import listing as L

_DIMS = ", ".join(f'"{n}"' for n in K.DIMENSIONS)


@query("split_union", "tiered", "SELECT doc_id, CASE WHEN exceeds_face_limit THEN NULL ELSE tier END AS tier FROM tiered")
def _(spark, d):
    return S.split_union(V.scores(spark, d)).select("doc_id", "tier")


@query("existing_plus_new", "scores", "SELECT doc_id, CASE WHEN exceeds_face_limit THEN 0.0 ELSE total END::DOUBLE AS total, CASE WHEN exceeds_face_limit THEN 'face limit' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'stored' ELSE 'fresh' END AS origin FROM scores")
def _(spark, d):
    s = V.scores(spark, d)
    over = F.col("exceeds_face_limit")
    seen = table(spark, d, "labels").select("doc_id")
    rejected = s.where(over).select("doc_id", F.lit(0.0).alias("total"), F.lit("face limit").alias("origin"))
    old = s.where(~over).join(seen, "doc_id", "left_semi").select("doc_id", "total", F.lit("stored").alias("origin"))
    new = s.where(~over).join(seen, "doc_id", "left_anti").select("doc_id", "total", F.lit("fresh").alias("origin"))
    return S.existing_plus_new(old, rejected, new)


@query("merge_sessions", "", "SELECT l_partkey AS image_id, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS total FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("image_id"), F.col("l_quantity").alias("total"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("batch_no"))
    return S.merge_sessions(li.groupBy("image_id", "batch_no").agg(F.max("total").alias("total"))).select("image_id", "total")


@query("merge_session_heads", "", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS session_id, sum(o_orderkey % 500)::BIGINT AS total_images, sum(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 11 ELSE 0 END)::BIGINT AS elapsed_ms, count(*) AS batches FROM orders GROUP BY o_custkey")
def _(spark, d):
    k = F.col("o_orderkey")
    heads = table(spark, d, "orders").select("o_custkey", k.alias("session_id"), k.alias("batch_no"), (k % 500).alias("total_images"), F.when(k % 3 > 0, k * 11).alias("elapsed_ms"))
    return S.merge_session_heads(heads, ["o_custkey"])


@query("upsert_scores", "", "SELECT user_id AS image_id, event_type AS session_id, arg_max(event_id % 101, event_id)::BIGINT AS total FROM events GROUP BY ALL")
def _(spark, d):
    i = F.col("event_id")
    log = table(spark, d, "events").select(F.col("event_type").alias("session_id"), F.col("user_id").alias("image_id"), (i % 101).alias("total"), i.alias("seq"))
    return S.upsert_scores(log).drop("seq")


def _profiles(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("genre"))


@query("upsert_profiles", "", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 5 > 0 THEN s_name ELSE c_name END AS name, CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 5 > 0 THEN 'event' ELSE c_mktsegment END AS genre FROM customer LEFT JOIN supplier ON s_suppkey * 2 = c_custkey UNION ALL SELECT s_suppkey * 2, s_name, 'event' FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    s = table(spark, d, "supplier")
    new = s.select((F.col("s_suppkey") * 2).alias("id"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).alias("name"), F.lit("event").alias("genre"))
    return S.upsert_profiles(_profiles(spark, d), new)


@query("delete_profiles", "", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    gone = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return S.delete_profiles(_profiles(spark, d), gone).select("id", "name")


@query("session_status", "", """WITH e AS (SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'context' WHEN 'purchase' THEN 'total_images' WHEN 'signup' THEN 'scored_count' ELSE CASE WHEN event_id % 7 = 0 THEN 'cleared' ELSE 'status' END END AS field, 'v' || event_id AS value FROM events),
c AS (SELECT session_id, max(seq) AS gone FROM e WHERE field = 'cleared' GROUP BY session_id),
k AS (SELECT e.* FROM e LEFT JOIN c USING (session_id) WHERE gone IS NULL OR seq > gone)
SELECT session_id, arg_max(value, seq) FILTER (field = 'status') AS status, arg_max(value, seq) FILTER (field = 'context') AS context, arg_max(value, seq) FILTER (field = 'total_images') AS total_images, arg_max(value, seq) FILTER (field = 'scored_count') AS scored_count
FROM k GROUP BY session_id""")
def _(spark, d):
    t, i = F.col("event_type"), F.col("event_id")
    field = F.when(t == "view", "status").when(t == "click", "context").when(t == "purchase", "total_images").when(t == "signup", "scored_count").otherwise(F.when(i % 7 == 0, "cleared").otherwise("status"))
    ev = table(spark, d, "events").select(F.col("user_id").alias("session_id"), i.alias("seq"), field.alias("field"), F.concat(F.lit("v"), i.cast("string")).alias("value"))
    return S.session_state(ev)


@query("append_history", "", "SELECT session_id FROM (SELECT o_orderkey AS session_id, o_orderdate AS done FROM orders UNION ALL SELECT l_orderkey + 1000000000, max(l_shipdate) FROM lineitem GROUP BY l_orderkey) ORDER BY done DESC, session_id DESC LIMIT 10")
def _(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("completed_at"))
    new = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") + 1000000000).alias("session_id")).agg(F.max("l_shipdate").alias("completed_at"))
    return S.append_history(old, new, K.HISTORY_KEEP_ON_APPEND).select("session_id")


@query("export_results_json", "tiered rolled", f"""SELECT filename, tier, total AS score, {_DIMS}, reasoning, coalesce(array_to_string(keywords, ';'), '') AS keywords, has_faces AS detected, face_count AS n_faces, eyes_open, blink_detected, row_number() OVER (ORDER BY CASE tier WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, total DESC, tiered.image_id) AS position FROM tiered JOIN rolled ON rolled.image_id = tiered.doc_id""")
def _(spark, d):
    f = V.rolled_faces(spark, d).drop("exceeds_face_limit").withColumnRenamed("image_id", "doc_id")
    out = X.results_rows(tiered(spark, d).join(f, "doc_id"))
    return positions(out).select(
        "position", "filename", "tier", "score", "scores.*", "reasoning", F.array_join("keywords", ";").alias("keywords"), F.col("faces.detected").alias("detected"),
        F.col("faces.count").alias("n_faces"), F.col("faces.eyesOpen").alias("eyes_open"), F.col("faces.blinkDetected").alias("blink_detected"),
    )


_CSV = f"""CASE WHEN regexp_matches(filename, '[,"]') THEN '"' || filename || '"' ELSE filename END || ',' || tier || ',' || printf('%.2f', total) || ',' || {" || ',' || ".join(f'"{n}"' for n in K.DIMENSIONS)} || ',' ||
CASE WHEN len(keywords) > 0 THEN '"' || array_to_string(keywords, '; ') || '"' ELSE '' END || ',"' || replace(reasoning, '"', '""') || '"'"""


_CSV_NULLS = _CSV.replace("|| tier ||", "|| CASE WHEN doc_id % 5 = 1 THEN '' ELSE tier END ||")


@query("export_results_csv", "tiered", f"SELECT row_number() OVER (ORDER BY header DESC, t, image_id) AS position, line FROM (SELECT false AS header, -total AS t, image_id, {_CSV_NULLS} AS line FROM tiered UNION ALL SELECT true, 0, '', '{X.CSV_HEADER}')")
def _(spark, d):
    # Some rows have no tier yet: their cell is empty. The position shows the order of the lines.
    rows = tiered(spark, d).withColumn("tier", F.when(F.col("doc_id") % 5 != 1, F.col("tier")))
    return positions(X.csv_rows(rows))


def _esc(x):
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


_LF = "chr(10)"
_XML = f"""'{X.XMP_HEAD}      <xmp:Rating>' || CASE tier WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 ELSE 1 END || '</xmp:Rating>' || {_LF} || '      <xmp:Label>' || CASE tier WHEN 'S' THEN 'Green' WHEN 'A' THEN 'Blue' WHEN 'B' THEN 'Yellow' ELSE 'Red' END || '</xmp:Label>' ||
{_LF} || '      <dc:description>' || {_LF} || '        <rdf:Alt>' || {_LF} || '          <rdf:li xml:lang="x-default">' || {_esc('reasoning')} || '</rdf:li>' || {_LF} || '        </rdf:Alt>' || {_LF} || '      </dc:description>' ||
CASE WHEN len(keywords) > 0 THEN {_LF} || '      <dc:subject>' || {_LF} || '        <rdf:Bag>' || {_LF} || '          <rdf:li>' || array_to_string(keywords, '</rdf:li>' || {_LF} || '          <rdf:li>') || '</rdf:li>' || {_LF} || '        </rdf:Bag>' || {_LF} || '      </dc:subject>' ELSE '' END || '{X.XMP_TAIL}'"""


@query("export_sidecars", "tiered", rf"""SELECT image_id, CASE WHEN doc_id % 20 > 0 THEN regexp_replace(path, '\.[^./]*$', '') || '.xmp' END AS sidecar_path, CASE WHEN doc_id % 20 > 0 THEN md5({_XML}) END AS xml_md5, CASE WHEN doc_id % 20 = 0 THEN 'no path for this asset' END AS error FROM tiered""")
def _(spark, d):
    known = V.assets(spark, d).where("doc_id % 20 > 0")
    return X.sidecars(tiered(spark, d), known).select("image_id", "sidecar_path", F.md5("xml").alias("xml_md5"), "error")


@query("summary", "tiered", "SELECT folder AS session_id, '/in/' || folder AS input_folder, " + ", ".join(f"count(*) FILTER (tier = '{t}') AS \"n_{t}\"" for t in K.TIERS) + " FROM tiered GROUP BY folder")
def _(spark, d):
    t = tiered(spark, d).withColumnRenamed("folder", "session_id")
    heads = V.assets(spark, d).select(F.col("folder").alias("session_id")).distinct().withColumn("input_folder", F.concat(F.lit("/in/"), "session_id"))
    return X.summary(heads, t).select("session_id", "input_folder", *[F.col(f"tier_counts.{n}").alias(f"n_{n}") for n in K.TIERS])


@query("bundle_manifest", "assets", r"""SELECT path, substr(path, 8) AS archive_name FROM (SELECT CASE doc_id % 4 WHEN 0 THEN regexp_replace(path, '\.[^.]*$', '.xmp') WHEN 1 THEN regexp_replace(path, '\.[^.]*$', '.XMP') WHEN 2 THEN '/shoot/.preview_cache/' || doc_id || '.xmp' ELSE path END AS path FROM assets)
WHERE lower(path) LIKE '%.xmp' AND NOT contains(path, '/.preview_cache/')""")
def _(spark, d):
    i, p = F.col("doc_id"), F.col("path")
    new = F.when(i % 4 == 0, F.regexp_replace(p, r"\.[^.]*$", ".xmp")).when(i % 4 == 1, F.regexp_replace(p, r"\.[^.]*$", ".XMP")).when(i % 4 == 2, F.concat(F.lit(V.ROOT + "/.preview_cache/"), i.cast("string"), F.lit(".xmp"))).otherwise(p)
    return X.bundle_manifest(L.from_manifest(V.assets(spark, d).select(new.alias("path")), V.ROOT))


@query("list_cache_entries", "assets", "SELECT regexp_replace(filename, '\\.[^.]*$', '') || '-' || doc_id AS cache_key, length AS size_bytes, CASE WHEN doc_id % 3 = 0 THEN length * 1000000 ELSE 1700000000000000 + doc_id * 1000000 END::BIGINT AS cached_us, doc_id % 3 > 0 AS from_mtime FROM assets WHERE filename LIKE '%.jpg'")
def _(spark, d):
    from keepsift.functions.text import from_micros, micros

    i = F.col("doc_id")
    a = V.assets(spark, d)
    name = F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit("-"), i.cast("string"), F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    files = a.select(name.alias("filename"), "folder", "length", (i * 1000000 + 1700000000000000).alias("modified_us"))
    notes = a.where(i % 3 == 0).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("cache_key"), from_micros(F.col("length") * 1000000).alias("cached_at"))
    return L.list_cache_entries(files, notes).select("cache_key", "size_bytes", micros(F.col("cached_at")).alias("cached_us"), "from_mtime")


@query("asset_columns", "assets", "SELECT doc_id, image_id, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) IN ('.cr3', '.nef') AS is_raw FROM assets")
def _(spark, d):
    return L.asset_columns(V.assets(spark, d).drop("image_id")).select("doc_id", "image_id", "is_raw")


@query("provider_defaults", "scores", "SELECT doc_id, CASE provider " + " ".join(f"WHEN '{p}' THEN '{m}'" for p, (u, m) in K.PROVIDER_DEFAULTS.items()) + " END AS model FROM scores")
def _(spark, d):
    from keepsift.sources.dimensions import provider_defaults

    return V.scores(spark, d).join(F.broadcast(provider_defaults(spark)), "provider", "left").select("doc_id", F.col("default_model").alias("model"))
