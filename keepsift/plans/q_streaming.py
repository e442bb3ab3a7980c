"""The event log and the scores read as streams."""

import uuid

from pyspark.sql import functions as F

from keepsift.functions.text import micros
from keepsift.operators.ranking import latest
from keepsift.plans import views as V
from keepsift.plans.q_selection import _QUOTA_SQL
from keepsift.plans.registry import query
from keepsift.plans.views import js_round_sql, table
from keepsift.session import work_dir
from keepsift.streaming import live
from keepsift.streaming.retier import retier_changes


def run_dir(spark, name):
    return f"{work_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def event_stream(spark, d, name="events"):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def score_events(spark, d):
    return score_columns(event_stream(spark, d))


def score_columns(events):
    i = F.col("event_id")
    return events.select(
        F.col("event_type").alias("session_id"), F.col("user_id").cast("string").alias("image_id"), (i % 101).cast("double").alias("total"),
        i.alias("seq"), (i % 500).alias("tokens_in"), F.when(i % 3 > 0, i % 70).alias("tokens_out"),
    )


LOG = "session_id string, image_id string, total double, seq bigint, tokens_in bigint, tokens_out bigint, _started bigint, _batch int"


def finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("score_stream", "", "SELECT event_type AS session_id, user_id::VARCHAR AS image_id, arg_max(event_id % 101, event_id)::DOUBLE AS total FROM events GROUP BY ALL")
def _(spark, d):
    out = run_dir(spark, "scores")
    finish(live.score_stream(score_events(spark, d), out + "/log", out + "/checkpoint"))
    return live.stored_scores(spark, out + "/log", LOG).select("session_id", "image_id", "total")


def _to_parquet(stream, out, mode):
    """Each batch to a folder of its own; the rows of all batches with their number."""

    def each(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start()
    finish(q)
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType(stream.schema.fields + [StructField("_batch", IntegerType())])
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(out + "/rows")


@query("live_progress", "", "SELECT event_type AS session_id, count(*) AS scored_count, sum(event_id % 500)::BIGINT AS tokens_in, sum(CASE WHEN event_id % 3 > 0 THEN event_id % 70 ELSE 0 END)::BIGINT AS tokens_out FROM events GROUP BY event_type")
def _(spark, d):
    rows = _to_parquet(live.live_progress(score_events(spark, d)), run_dir(spark, "progress"), "update")
    return latest(rows, ["session_id"], ["_batch"]).drop("_batch")


@query("throttled_eta", "", f"""WITH e AS (SELECT event_type AS session_id, ts, epoch_us(ts) // 5000000 AS w, event_id FROM events),
l AS (SELECT session_id, w, arg_max(event_id, ts) AS id FROM e GROUP BY ALL)
SELECT session_id, (w + 1) * 5 AS at_s, id % 900 + 1 AS done, {js_round_sql('id * 0.5::DOUBLE / (id % 900 + 1) * (1000 - (id % 900 + 1))')}::BIGINT AS eta_seconds FROM l""")
def _(spark, d):
    i = F.col("event_id")
    progress = event_stream(spark, d).select(
        F.col("event_type").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), (i * 0.5).alias("elapsed_s"), (i % 900 + 1).alias("done"), F.lit(1000).alias("total")
    )
    rows = _to_parquet(live.throttled_eta(progress), run_dir(spark, "eta"), "update")
    return latest(rows, ["session_id", "at"], ["_batch"]).select("session_id", F.floor(micros(F.col("at").cast("timestamp_ntz")) / 1000000).alias("at_s"), "done", "eta_seconds")


@query("idempotent_resume", "", "SELECT DISTINCT event_type AS session_id, user_id::VARCHAR AS image_id FROM events")
def _(spark, d):
    s = event_stream(spark, d).select(F.col("event_type").alias("session_id"), F.col("user_id").cast("string").alias("image_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = run_dir(spark, "first")
    finish(live.first_scores(s, out + "/log", out + "/checkpoint"))
    return spark.read.parquet(out + "/log").select("session_id", "image_id")


_TIER_SQL = """WITH s AS (SELECT event_type AS session_id, user_id::VARCHAR AS image_id, arg_max(event_id % 101, event_id)::DOUBLE AS total FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total DESC, image_id) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM s)
SELECT session_id, image_id, total, CASE WHEN total < 30 THEN 'rejected' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN 'S' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + ceil(n * 0.3::DOUBLE) THEN 'A' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + 2 * ceil(n * 0.3::DOUBLE) THEN 'B' ELSE 'rejected' END AS tier FROM r"""


@query("retier_per_batch", "", _TIER_SQL)
def _(spark, d):
    out = run_dir(spark, "retier")
    done = []

    def sink(tiers, batch_id):
        tiers.select("session_id", "image_id", "total", "tier").write.mode("overwrite").parquet(f"{out}/tiers/batch={batch_id}")
        done.append(batch_id)

    finish(live.retier_per_batch(score_events(spark, d), out + "/log", LOG, out + "/checkpoint", sink, ["session_id"]))
    return spark.read.parquet(f"{out}/tiers/batch={max(done)}")


@query("retier_changes", "", _TIER_SQL)
def _(spark, d):
    """Scores arrive in about four batches; the newest change of an asset is its tier. All scores of an asset are in
    one file, as the order of the files is not fixed."""
    out, key = run_dir(spark, "changes"), ["session_id", "image_id"]
    scores = score_columns(table(spark, d, "events"))
    scores.repartition(*key).write.parquet(out + "/in")
    files = len(spark.read.schema(scores.schema).parquet(out + "/in").inputFiles())

    def sink(changes, batch_id):
        changes.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/tiers/batch={batch_id}")

    live.use_state_store(spark)
    arriving = live.read_scores(spark, out + "/in", scores.schema, max(1, -(-files // 4)))
    finish(retier_changes(arriving, out + "/state", out + "/checkpoint", sink, key, ["session_id"]))
    changes = spark.read.option("recursiveFileLookup", True).parquet(out + "/tiers")
    return latest(changes, key, ["_batch"]).select(*key, "total", "tier")


@query("batch_events", "scores", "SELECT folder, dense_rank() OVER (ORDER BY folder) AS batch_no, total, scored, CASE WHEN scored >= total THEN 'batch-complete' WHEN scored > 0 THEN 'batch-started' ELSE 'batch-waiting' END AS event FROM (SELECT folder, count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS scored FROM scores GROUP BY folder)")
def _(spark, d):
    from keepsift.operators.ranking import running

    s = V.scores(spark, d)
    plan = s.groupBy("folder").agg(F.count(F.lit(1)).alias("total"))
    plan = running(plan, [F.col("folder")], number="batch_no").withColumn("batches", F.lit(0))
    progress = s.join(table(spark, d, "labels"), "doc_id", "left_semi").groupBy("folder").agg(F.count(F.lit(1)).alias("scored"))
    return live.batch_events(progress, plan).select("folder", "batch_no", "total", "scored", "event")


def _usage_stream(spark, d):
    e = event_stream(spark, d)
    return V.usage_columns(e)


@query("quota_stream", "usage_events", _QUOTA_SQL)
def _(spark, d):
    live.use_state_store(spark)
    return _to_parquet(live.quota_stream(_usage_stream(spark, d)), run_dir(spark, "quota"), "append").drop("_batch")


@query("quota_batches", "usage_events", _QUOTA_SQL)
def _(spark, d):
    out = run_dir(spark, "quota-batches")
    finish(live.quota_batches(_usage_stream(spark, d), out, out + "/checkpoint"))
    return spark.read.option("recursiveFileLookup", True).parquet(out + "/outcomes").select("user_id", "seq", "success", "remaining", "error")
