"""Scorers, taggers and attempt logs."""

from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import text as X
from keepsift.operators import inference as I
from keepsift.operators import joins as J
from keepsift.operators import tiers as T
from keepsift.operators.rollups import face_rollup
from keepsift.plans import views as V
from keepsift.plans.q_rollups import stored_tiers
from keepsift.plans.registry import query
from keepsift.plans.views import table, weighted_sql
from keepsift.session import store

GENERAL = dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["general"]))


def named(spark, d):
    """Assets named after the first word of their text, so that all classes of names occur."""
    words = ("good", "dark", "Mountain", "face", "plain", "blurry-portrait", "scenic")
    i = F.col("doc_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, words)), (i % 7 + 1).cast("int")), F.lit("_"), i.cast("string"), F.lit(".jpg"))
    return table(spark, d, "documents").select("doc_id", i.cast("string").alias("image_id"), name.alias("filename"), (i % 13).cast("int").alias("fate"))


V.VIEWS_SQL["named"] = "SELECT doc_id, doc_id::VARCHAR AS image_id, ['good','dark','Mountain','face','plain','blurry-portrait','scenic'][doc_id % 7 + 1] || '_' || doc_id || '.jpg' AS filename, doc_id % 13 AS fate FROM documents"


def _case(i):
    whens = " ".join(f"WHEN regexp_matches(lower(filename), '{p}') THEN {v[i]}" for p, v in K.NAME_SCORES)
    return f"CASE {whens} ELSE {K.NAME_SCORES_DEFAULT[i]} END"


_SCORED = ", ".join(f'{_case(i)} AS "{n}"' for i, n in enumerate(K.DIMENSIONS))


@query("name_scores", "named", f"SELECT doc_id, {_SCORED} FROM named")
def _(spark, d):
    return I.name_scores(named(spark, d)).select("doc_id", *K.DIMENSIONS)


@query("name_keywords", "named", "SELECT doc_id, CASE WHEN regexp_matches(filename, 'portrait|face') THEN 'portrait;natural light;smile;person;close-up' WHEN regexp_matches(filename, 'landscape|nature') THEN 'landscape;nature;scenic;mountain;outdoor' ELSE 'photography;image;photo;capture;session' END AS keywords FROM named")
def _(spark, d):
    return named(spark, d).select("doc_id", F.array_join(I.name_keywords(F.col("filename")), ";").alias("keywords"))


LIMITED: set[str] = set()  # asked once already, per worker


def mock_call(row) -> I.Answer:
    """Scores by file name; `fate` makes some requests fail."""
    import json
    import re

    fate = row["fate"]
    if fate == 3:
        return I.Answer(503)
    if fate == 5:
        return I.Answer(404)
    if fate == 4:
        return I.Answer(400)
    if fate == 1 and row["image_id"] not in LIMITED:
        LIMITED.add(row["image_id"])
        return I.Answer(429, retry_after=6)
    if fate == 7:
        return I.Answer(0)
    if fate == 9:
        return I.Answer(200, "not json", 10, 2)
    name = row["filename"].lower()
    values = next((v for p, v in K.NAME_SCORES if re.search(p, name)), K.NAME_SCORES_DEFAULT)
    body = json.dumps({**dict(zip(K.DIMENSIONS, values)), "reasoning": f"Scored {row['filename']}"})
    return I.Answer(200, body, 800, 200)


_OK = "fate NOT IN (3,4,5,7,9)"


@query("batch_score", "named", f"""SELECT doc_id, CASE WHEN {_OK} THEN total ELSE 0 END::DOUBLE AS total, CASE WHEN {_OK} THEN 'Scored ' || filename ELSE 'Scoring failed: ' || CASE fate WHEN 3 THEN 'HTTP 503' WHEN 4 THEN 'HTTP 400' WHEN 5 THEN 'HTTP 404' WHEN 7 THEN 'Request timed out twice' ELSE 'invalid JSON' END END AS reasoning,
CASE WHEN NOT {_OK} THEN 'rejected' END AS tier, CASE WHEN {_OK} THEN 800 ELSE 0 END::BIGINT AS tokens_in, CASE fate WHEN 3 THEN 3 WHEN 7 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS retries, CASE fate WHEN 3 THEN 7 WHEN 1 THEN 6 ELSE 0 END::BIGINT AS waited_s
FROM (SELECT *, {weighted_sql(K.GENRE_PRESETS['general'])} AS total FROM (SELECT *, {_SCORED} FROM named)) WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    seen = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("image_id"))
    out = I.batch_score(named(spark, d), seen, mock_call, GENERAL, concurrency=8, sleep=lambda s: None)
    return out.select("doc_id", "total", "reasoning", "tier", "tokens_in", "retries", "waited_s")


@query("batch_score_resumed", "named", f"""SELECT doc_id, CASE WHEN fate NOT IN (3,4,5,7,9) THEN total ELSE 0 END::DOUBLE AS total FROM (SELECT *, {weighted_sql(K.GENRE_PRESETS['general'])} AS total FROM (SELECT *, {_SCORED} FROM named))""")
def _(spark, d):
    # The key is refused on the way; what a second run asks for is exactly what has no score.
    def refused(row):
        return I.Answer(401) if row["doc_id"] % 10 == 9 else mock_call(row)

    assets = named(spark, d)
    first = store(I.batch_score(assets, None, refused, GENERAL, concurrency=8, sleep=lambda s: None), "first")
    second = I.batch_score(assets, first, mock_call, GENERAL, concurrency=8, sleep=lambda s: None)
    return first.unionByName(second).select("doc_id", "total")


_HANGS = "doc_id % 400 = 11"


@query("batch_score_hanging", "named", f"""SELECT doc_id, CASE WHEN {_HANGS} THEN 0 ELSE total END::DOUBLE AS total, CASE WHEN {_HANGS} THEN 'Scoring failed: Request timed out twice' ELSE 'Scored ' || filename END AS reasoning, CASE WHEN {_HANGS} THEN 1 ELSE 0 END AS retries
FROM (SELECT *, {weighted_sql(K.GENRE_PRESETS['general'])} AS total FROM (SELECT *, {_SCORED} FROM named))""")
def _(spark, d):
    # Some calls never return; their process ends at the deadline, and again at the second try.
    def hanging(row):
        import time

        while row["doc_id"] % 400 == 11:
            time.sleep(60)
        return mock_call({**row, "fate": 0})

    out = I.batch_score(named(spark, d), None, hanging, GENERAL, concurrency=8, sleep=lambda s: None, limit_s=2)
    return out.select("doc_id", "total", "reasoning", "retries")


@query("batch_score_stopped", "", "SELECT 0::BIGINT AS refused_scored, true AS stopped_early, count(*) AS scored_in_the_end FROM documents")
def _(spark, d):
    # A refused key ends the run for all tasks: no further round begins, and a second run asks for what is left.
    def refused(row):
        return I.Answer(401) if row["doc_id"] % 10 == 9 else mock_call(row)

    assets = named(spark, d)
    first = store(I.batch_score(assets, None, refused, GENERAL, concurrency=4, sleep=lambda s: None), "first")
    second = I.batch_score(assets, first, mock_call, GENERAL, concurrency=4, sleep=lambda s: None)
    n = assets.count()
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.agg(
        F.count_if((F.col("run") == 1) & (F.col("doc_id") % 10 == 9)).alias("refused_scored"),
        (4 * F.count_if(F.col("run") == 1) <= 3 * n).alias("stopped_early"),
        F.count_distinct("doc_id").alias("scored_in_the_end"),
    )


@query("resolve_attempts", "attempts", """WITH c AS (SELECT *, CASE WHEN status = 0 THEN 'timeout' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 401 THEN 'auth' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server' ELSE 'other' END AS cls FROM attempts),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY attempt_no) AS nth FROM c),
e AS (SELECT image_id, min(attempt_no) AS fin FROM r WHERE cls IN ('ok','auth','other') OR (cls = 'server' AND nth = 4) OR (cls = 'timeout' AND nth = 2) GROUP BY image_id)
SELECT r.image_id, coalesce(max(cls) FILTER (attempt_no = fin), 'pending') AS outcome, count(*) FILTER (attempt_no IS DISTINCT FROM fin) AS retries,
(coalesce(sum(CASE WHEN cls = 'rate_limit' THEN retry_after WHEN cls = 'server' AND attempt_no IS DISTINCT FROM fin THEN power(2, nth - 1) ELSE 0 END), 0))::BIGINT AS waited_s FROM r LEFT JOIN e USING (image_id) WHERE fin IS NULL OR attempt_no <= fin GROUP BY r.image_id""")
def _(spark, d):
    return I.resolve_attempts(V.attempts(spark, d))


@query("tag_requests", "tiered", """SELECT block_no, count(*)::INTEGER AS n, string_agg(image_id, ',' ORDER BY rn) AS ids FROM (SELECT *, ((rn - 1) // 5)::BIGINT AS block_no FROM (SELECT image_id, row_number() OVER (ORDER BY total DESC, image_id) AS rn, count(*) OVER () AS n FROM tiered WHERE tier IN ('S','A')) WHERE rn <= greatest(1, ceil(n * (20 / 100.0::DOUBLE)))) GROUP BY block_no""")
def _(spark, d):
    r = I.tag_requests(stored_tiers(spark, d))
    return r.select("block_no", F.size("items").alias("n"), F.array_join("items.image_id", ",").alias("ids"))


def mock_tags(row) -> I.Answer:
    """Tags every file; blocks with an even number fail as a whole, unreadable or refused."""
    import json

    names = [i["filename"] if isinstance(i, dict) else i.filename for i in row["items"]]
    if len(names) > 1 and row["block_no"] % 2 == 0:
        return I.Answer(200, "sorry") if row["block_no"] % 4 == 0 else I.Answer(400, "one picture only")
    return I.Answer(200, json.dumps({n: [f" Tag {n}", "", 5] for n in names if not n.startswith("DSC_")}))


@query("batch_tag", "tiered", """SELECT image_id, 'tag ' || lower(filename) AS keywords FROM (SELECT image_id, filename, row_number() OVER (ORDER BY total DESC, image_id) AS rn, count(*) OVER () AS n FROM tiered WHERE tier IN ('S','A')) WHERE rn <= greatest(1, ceil(n * (30 / 100.0::DOUBLE))) AND NOT starts_with(filename, 'DSC_')""")
def _(spark, d):
    out = I.batch_tag(stored_tiers(spark, d), mock_tags, 30, sleep=lambda s: None)
    return out.select("image_id", F.array_join("keywords", ";").alias("keywords"))


@query("batch_tag_stopped", "tiered", """SELECT image_id, 'tag' AS keywords FROM (SELECT image_id, row_number() OVER (ORDER BY total DESC, image_id) AS rn, count(*) OVER () AS n FROM tiered WHERE tier IN ('S','A')) WHERE rn <= greatest(1, ceil(n * (50 / 100.0::DOUBLE))) AND rn <= 10""")
def _(spark, d):
    # One task asks for one block, then for two, then for four: a rate limit at the third block ends the run.
    def limited(row):
        import json

        return I.Answer(429) if row["block_no"] >= 2 else I.Answer(200, json.dumps({i["filename"]: ["tag"] for i in row["items"]}))

    out = I.batch_tag(stored_tiers(spark, d), limited, 50, concurrency=1, sleep=lambda s: None, first_round=1)
    return out.select("image_id", F.array_join("keywords", ";").alias("keywords"))


@query("summarise_sample", "assets", """SELECT doc_id, (SELECT 'ref+' || string_agg(filename, '+' ORDER BY i) FROM (SELECT filename, i, rn, k, n FROM (SELECT *, least(8, greatest(5, ceil(n * 0.05::DOUBLE)))::BIGINT AS k FROM (SELECT filename, row_number() OVER (ORDER BY filename, path) - 1 AS rn, count(*) OVER () AS n FROM assets)), (SELECT unnest(range(8)) AS i)) WHERE i < k AND rn = floor(i * (n - 1)::DOUBLE / (k - 1))::BIGINT) AS context FROM assets""")
def _(spark, d):
    def call(rows):
        return "+".join(r["filename"] for r in rows)

    out = I.summarise_sample(V.assets(spark, d), [F.col("filename"), F.col("path")], call, {"filename": "ref", "sample_no": -1}, ("doc_id", "filename", "path"))
    return out.select("doc_id", "context")


@query("detect_faces_hanging", "", "SELECT doc_id::VARCHAR AS image_id, CASE WHEN doc_id % 400 <> 11 THEN 0 END AS face_no, CASE WHEN doc_id % 400 = 11 THEN 'timed out after 2 s' END AS error FROM documents")
def _(spark, d):
    def detect(content):
        import time

        while int(content[:12]) % 400 == 11:
            time.sleep(60)
        return [{"left_open": 0.9}]

    return I.detect_faces(_pictures(spark, d).withColumn("width", F.lit(600)), detect, limit_s=2).select("image_id", "face_no", "error")


_DETECTED = "SELECT doc_id, CASE WHEN n_chars % 100 + 1 < 64 THEN 0 WHEN doc_id % 10 = 9 THEN 0 ELSE doc_id % 3 END AS faces, n_chars % 100 + 1 >= 64 AND doc_id % 10 = 9 AS failed FROM documents"


@query("detected_rollup", "", f"SELECT doc_id::VARCHAR AS image_id, faces > 0 AS has_faces, faces AS face_count, faces = 0 AS eyes_open, faces > 0 AS blink_detected, faces = 0 AS expression_neutral, faces > 1 AS exceeds_face_limit, CASE WHEN failed THEN 'bad' END AS face_error FROM ({_DETECTED})")
def _(spark, d):
    assets = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_id"))
    return face_rollup(assets, _detected(spark, d), 1)


@query("detect_faces", "", "SELECT d.doc_id::VARCHAR AS image_id, count(*) FILTER (error IS NULL) AS faces, count(*) FILTER (error IS NOT NULL) AS failed FROM (SELECT doc_id, error FROM (SELECT doc_id, n_chars % 100 + 1 AS w, length(text) AS len, unnest(CASE WHEN doc_id % 10 = 9 THEN ['bad'] ELSE [NULL, NULL][1:(doc_id % 3)] END) AS error FROM documents) WHERE w >= 64) d GROUP BY ALL")
def _(spark, d):
    return _detected(spark, d).groupBy("image_id").agg(F.count_if(F.col("error").isNull()).alias("faces"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def _detected(spark, d):
    # A detector that finds doc_id % 3 faces and breaks on every tenth image; the id leads the bytes.
    def detect(content):
        i = int(content[:12])
        if i % 10 == 9:
            raise ValueError("bad")
        return [{"left_open": 0.9, "right_open": 0.1, "emotion": "happy"}] * (i % 3)

    return I.detect_faces(_pictures(spark, d), detect)


def _pictures(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.cast("string").alias("image_id"), F.encode(F.concat(F.lpad(i.cast("string"), 12, "0"), "text"), "utf-8").alias("content"),
        (F.col("n_chars") % 100 + 1).cast("int").alias("width"), F.lit(600).alias("height"),
    )


@query("rescore_images", "scores", f"""WITH m AS (SELECT s.doc_id, image_id, exceeds_face_limit, CASE WHEN l.doc_id IS NOT NULL THEN 60.0 ELSE total END::DOUBLE AS total FROM scores s LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l ON l.doc_id = s.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY exceeds_face_limit ORDER BY total DESC, image_id) AS rn, count(*) OVER (PARTITION BY exceeds_face_limit) AS n FROM m)
SELECT doc_id, total, CASE WHEN exceeds_face_limit OR total < 30 THEN 'rejected' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN 'S' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + ceil(n * 0.3::DOUBLE) THEN 'A' WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) + 2 * ceil(n * 0.3::DOUBLE) THEN 'B' ELSE 'rejected' END AS tier FROM r""")
def _(spark, d):
    # Re-score a chosen subset by name, then tier everything again.
    s = V.scores(spark, d)
    chosen = s.select("doc_id", "image_id", "filename").join(table(spark, d, "labels").where("toxic = 0"), "doc_id", "left_semi")
    fresh = J.apply_weights(I.name_scores(chosen), GENERAL).select("image_id", "total")
    return T.retier_after_rescore(s, fresh).select("doc_id", "total", "tier")
