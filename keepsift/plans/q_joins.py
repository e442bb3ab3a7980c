"""Joins over the derived assets, scores, caches and users."""

from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import paths as P
from keepsift.operators import joins as J
from keepsift.plans import views as V
from keepsift.plans.registry import query
from keepsift.plans.views import js_round_sql, table, weighted_sql


@query("unscored_assets", "assets", "SELECT doc_id, path FROM assets WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return J.unscored_assets(V.assets(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id", "path")


@query("cache_lookup", "assets", "SELECT a.doc_id, l.doc_id IS NOT NULL AND l.quality = 1 AND a.doc_id % 5 <> 0 AS cache_hit FROM assets a LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    # The cache knows labelled assets, every fifth with an older mtime; quality 0 is not a JPEG.
    a = V.assets(spark, d)
    mtime = F.col("length") * 1000
    keyed = a.withColumn("cache_key", P.cache_key(F.col("path"), mtime))
    old = F.when(F.col("doc_id") % 5 == 0, mtime - 1).otherwise(mtime)
    cache = a.join(table(spark, d, "labels"), "doc_id").select(P.cache_key(F.col("path"), old).alias("cache_key"), (F.col("quality") == 1).alias("is_valid"))
    return J.cache_lookup(keyed, cache).select("doc_id", "cache_hit")


@query("apply_preset", "scores", "SELECT image_id, CASE genre " + " ".join(f"WHEN '{g}' THEN {weighted_sql(w)}" for g, w in K.GENRE_PRESETS.items()) + " END AS total FROM scores")
def _(spark, d):
    return J.apply_preset(V.scores(spark, d).drop("total")).select("image_id", "total")


@query("all_presets", "scores", " UNION ALL ".join(f"SELECT image_id, '{g}' AS genre, {weighted_sql(w)} AS total FROM scores" for g, w in K.GENRE_PRESETS.items()))
def _(spark, d):
    return J.all_preset_totals(V.scores(spark, d))


_PRICE_IN = "CASE provider WHEN 'claude' THEN 3.0 WHEN 'openai' THEN 2.0 WHEN 'gemini' THEN 1.5 ELSE 0.0 END::DOUBLE"
_PRICE_OUT = "CASE provider WHEN 'claude' THEN 15.0 WHEN 'openai' THEN 8.0 WHEN 'gemini' THEN 9.0 ELSE 0.0 END::DOUBLE"
_COST = js_round_sql(f"(tokens_in / 1000000.0::DOUBLE) * {_PRICE_IN} + (tokens_out / 1000000.0::DOUBLE) * {_PRICE_OUT}", 4)


@query("price_lookup", "scores", f"SELECT image_id, {_COST} AS cost FROM (SELECT image_id, provider, tokens_in * 100 AS tokens_in, tokens_in * 3 AS tokens_out FROM scores)")
def _(spark, d):
    u = V.scores(spark, d).select("image_id", "provider", (F.col("tokens_in") * 100).alias("tokens_in"), (F.col("tokens_in") * 3).alias("tokens_out"))
    return J.price_lookup(u).select("image_id", "cost")


@query("attach_keywords", "scores", "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE array_to_string(keywords, ';') END AS keywords FROM (SELECT doc_id, keywords FROM scores) s LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)".replace("SELECT doc_id, CASE", "SELECT s.doc_id, CASE", 1))
def _(spark, d):
    kw = table(spark, d, "labels").select("doc_id", F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("keywords"))
    out = J.attach_keywords(V.scores(spark, d).select("doc_id", "keywords"), kw, "doc_id")
    return out.select("doc_id", F.array_join("keywords", ";").alias("keywords"))


@query("with_payload", "scores", "SELECT s.doc_id, s.total, length(text) AS payload_chars FROM scores s JOIN documents d ON s.doc_id = d.doc_id WHERE s.doc_id % 3 <> 0")
def _(spark, d):
    payload = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("content"))
    return J.with_payload(V.scores(spark, d), payload, "doc_id").select("doc_id", "total", F.length("content").cast("bigint").alias("payload_chars"))


@query("rescore_merge", "scores", "SELECT s.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 50.0 + l.quality ELSE total END::DOUBLE AS total, CASE WHEN l.doc_id IS NOT NULL THEN 'new' ELSE reasoning END AS reasoning, array_to_string(keywords, ';') AS keywords FROM scores s LEFT JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) l USING (doc_id)")
def _(spark, d):
    fresh = table(spark, d, "labels").where("doc_id % 2 = 0").select("doc_id", (F.lit(50.0) + F.col("quality")).alias("total"), F.lit("new").alias("reasoning"), F.array(F.lit("x")).alias("keywords"))
    unknown = fresh.withColumn("doc_id", -F.col("doc_id") - 1)
    out = J.rescore_merge(V.scores(spark, d).select("doc_id", "total", "reasoning", "keywords"), fresh.unionByName(unknown), "doc_id")
    return out.withColumn("keywords", F.array_join("keywords", ";"))


@query("resolve_paths", "scores", "SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN path END AS path, CASE WHEN doc_id % 10 = 0 THEN 'no path for this asset' END AS error FROM scores")
def _(spark, d):
    known = V.assets(spark, d).where("doc_id % 10 > 0")
    return J.resolve_paths(V.scores(spark, d), known).select("doc_id", "path", "error")


@query("entitlements", "users", f"SELECT user_id, feature FROM users, (SELECT unnest([{','.join(repr(f) for f in K.FEATURE_TIERS)}]) AS feature) WHERE tier <> 'free'")
def _(spark, d):
    return J.entitled(V.users(spark, d)).select("user_id", "feature")


@query("allowed_features", "users", f"SELECT user_id, CASE WHEN tier = 'free' THEN '' ELSE '{','.join(K.FEATURE_TIERS)}' END AS features FROM users")
def _(spark, d):
    return J.allowed_features(V.users(spark, d)).select("user_id", F.array_join("features", ",").alias("features"))


@query("orphan_caches", "cache_entries", "SELECT cache_key, size_bytes FROM cache_entries WHERE folder NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(spark, d):
    alive = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("folder"))
    return J.orphan_caches(V.cache_entries(spark, d), alive).select("cache_key", "size_bytes")


@query("profile_name", "", "SELECT o_orderkey, c_name AS profile_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) ON c_custkey = o_custkey")
def _(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("profile_id"))
    p = table(spark, d, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return J.profile_name(s, p).select("o_orderkey", "profile_name")
