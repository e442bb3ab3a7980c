"""Culling inputs derived from the given tables, for Spark and, as SQL text, for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import fingerprints as H
from keepsift.functions import paths as P
from keepsift.functions.numbers import weighted_total
from keepsift.functions.text import from_micros, micros, month_key
from keepsift.operators.inference import name_keywords
from keepsift.operators.rollups import face_rollup

ROOT = "/shoot"
FACE_LIMIT = 5
PREFIXES = ("IMG_", "DSC_", "_MG_")
SUFFIXES = (".jpg", ".CR3", ".nef", ".png", ".txt", ".heic")
FACTORS = (31, 37, 41, 43, 47, 53)
MONTH = "2024-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(index, values):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def assets(spark, d) -> DataFrame:
    """One asset per document: a path below the root, repeating file names, some unsupported."""
    doc = table(spark, d, "documents")
    i = F.col("doc_id")
    name = F.concat(
        _pick(i % 3, PREFIXES), F.lpad((i % 240).cast("string"), 4, "0"), _pick(i % 6, SUFFIXES)
    )
    folder = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.floor(i / 240).cast("string")))
    rows = doc.select(
        "doc_id",
        F.concat_ws("/", F.lit(ROOT), folder, name).alias("path"),
        F.col("source").alias("folder"),
        name.alias("filename"),
        F.col("n_chars").alias("length"),
        "lang",
    )
    return rows.withColumns(
        {"image_id": P.image_id(F.col("path")), "relative_path": P.relative_to(F.col("path"), ROOT)}
    )


def dim_columns(length: str = "n_chars"):
    out = []
    for name, k in zip(K.DIMENSIONS, FACTORS):
        v = (F.col("doc_id") * k + F.col(length)) % 101
        out.append(F.when(F.col("doc_id") % 9 == 0, F.floor(v / 4)).otherwise(v).cast("bigint").alias(name))
    return out


def dims(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *dim_columns())


def faces(spark, d) -> DataFrame:
    """doc_id % 7 faces per asset with eye scores, emotions and pixel boxes."""
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    n = (F.col("doc_id") % 7).cast("int")
    rows = doc.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("face_no"))
    i, j = F.col("doc_id"), F.col("face_no")
    eye = (F.pmod(i * 13 + j * 29, F.lit(100)) / 100.0).alias("left_open")
    other = F.when((i + j) % 11 == 0, F.lit(None)).otherwise(F.pmod(i * 7 + j * 31, F.lit(100)) / 100.0)
    emotion = F.when((i + j) % 5 == 0, "happy").when((i + j) % 13 == 0, F.lit(None)).otherwise("neutral")
    box = F.struct(
        ((i * 3 + j) % 900).cast("double").alias("x"),
        ((i * 5 + j) % 700).cast("double").alias("y"),
        ((i + j) % 400).cast("double").alias("width"),
        F.when(j % 3 == 2, F.lit(None)).otherwise(((i + j) % 300).cast("double")).alias("height"),
    )
    return rows.select(
        F.col("doc_id").alias("image_id"), "face_no", eye, other.alias("right_open"), emotion.alias("emotion"),
        F.when(i % 17 == 3, F.lit(None)).otherwise(box).alias("box"),
        F.lit(800).alias("image_width"), F.lit(600).alias("image_height"),
    )


def scores(spark, d) -> DataFrame:
    """Scored assets with the general preset; the rest of the score columns is made up by rule."""
    general = dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["general"]))
    i = F.col("doc_id")
    rows = assets(spark, d).select("*", *dim_columns("length"))
    return rows.select(
        "doc_id", "image_id", "folder", "filename", "path", "length", *K.DIMENSIONS,
        weighted_total(F.col, lambda n: F.lit(float(general[n]))).alias("total"),
        (i % 7 > FACE_LIMIT).alias("exceeds_face_limit"),
        F.concat(F.lit('Asset "'), i.cast("string"), F.lit("\" <"), "lang", F.lit("> & 'co'")).alias("reasoning"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(name_keywords(F.concat("folder", F.when(i % 4 == 1, "-wedding").otherwise("-portrait")))).alias("keywords"),
        F.col("length").alias("tokens_in"),
        F.when(i % 6 == 5, F.lit(None)).otherwise(i % 200).alias("tokens_out"),
        _pick(i % 6, ("claude", "openai", "gemini", "ollama", "custom", "unknown")).alias("provider"),
        _pick(i % 7, tuple(K.GENRE_PRESETS)).alias("genre"),
        F.concat(F.lit("thumbnails/"), "image_id", F.lit(".jpg")).alias("thumbnail_path"),
        (i * 17 % 5000).alias("elapsed_ms"),
        F.lit(None).cast("string").alias("tier"),
    )


def vectors(spark, d) -> DataFrame:
    """Sign-bit fingerprints of the embeddings; every 50th is missing, as if its hash had failed."""
    e = table(spark, d, "embeddings")
    fp = F.when(F.col("vec_id") % 50 == 49, F.lit(None)).otherwise(H.sign_bits(F.col("embedding")))
    return e.select(
        F.col("vec_id").cast("string").alias("image_id"), F.col("vec_id"), F.col("label").cast("string").alias("folder"),
        F.concat(F.lit("IMG_"), F.lpad((F.col("vec_id") % 90).cast("string"), 4, "0"), F.lit(".jpg")).alias("filename"),
        F.concat(F.lit("/v/"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("path"), fp.alias("fp"),
    )


def text_prints(spark, d) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id", "text")
    return H.simhash(doc, "doc_id", "text")


def cache_entries(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("folder"), F.col("event_id").alias("cache_key"),
        F.floor(F.col("value") * 1000).alias("size_bytes"), F.col("ts").alias("cached_at"),
    )


def users(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"), _pick(F.col("c_custkey") % 3, tuple(K.TIER_LIMITS)).alias("tier"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "c_acctbal",
    )


def usage_events(spark, d) -> DataFrame:
    """Usage log in order of event_id: some clocks run two hours or a month behind."""
    return usage_columns(table(spark, d, "events"))


def usage_columns(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    late = F.when(i % 11 == 5, F.lit(2 * 3600)).when(i % 50 == 7, F.lit(31 * 86400)).otherwise(F.lit(0))
    ts_us = micros(F.col("ts")) - late.cast("bigint") * 1000000
    quota = F.when(F.col("user_id") % 3 == 0, 500).when(F.col("user_id") % 3 == 1, 5000)
    rows = e.select(
        "user_id", i.alias("seq"), ts_us.alias("ts_us"),
        F.when(i % 97 == 0, F.lit(600)).otherwise(1 + i % 40).cast("bigint").alias("n"), quota.cast("bigint").alias("quota"),
    )
    month = month_key(from_micros(F.col("ts_us")))
    return rows.withColumn("month_key", month)


def attempts(spark, d) -> DataFrame:
    """One log per user: statuses by event type, in order of event_id."""
    e = table(spark, d, "events")
    i, t = F.col("event_id"), F.col("event_type")
    status = (
        F.when(t == "error", F.when(i % 3 == 0, 0).otherwise(503)).when(t == "signup", 429)
        .when(i % 41 == 0, 401).when(i % 31 == 0, 404).when(t == "click", 503).otherwise(F.when(i % 4 == 0, 200).otherwise(500))
    )
    return e.select(
        F.col("user_id").alias("image_id"), i.alias("attempt_no"), status.alias("status"), (1 + i % 90).alias("retry_after")
    )


def overrides(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("doc_id"), _pick(i % 5, ("S", "A", "B", "rejected", "bogus")).alias("tier"),
        i.alias("seq"), (i % 6 == 0).alias("undone"),
    )


def catalog(spark, d) -> DataFrame:
    """Model-like names and URLs made of the pages."""
    p = table(spark, d, "pages")
    i = F.col("page_id")
    heads = ("claude-x", "gpt-4", "models/gemini-1", "LLaVA", "dall-e", "o3", "moondream", "")
    return p.select(
        "page_id", "url", F.concat(_pick(i % 8, heads), F.when(i % 8 == 7, "").otherwise(F.concat(F.lit("-"), i.cast("string")))).alias("model"),
        F.when(i % 3 == 0, F.array(F.lit("embedContent"))).otherwise(F.array(F.lit("generateContent"), F.lit("countTokens"))).alias("methods"),
    )


def answers(spark, d) -> DataFrame:
    """Model answers built from the dimensions: some fenced, some broken."""
    rows = dims(spark, d)
    i = F.col("doc_id")
    q = F.when(i % 11 == 1, F.concat(F.lit('"'), F.col("quality").cast("string"), F.lit('"'))).when(
        i % 11 == 2, (F.col("quality") + 0.5).cast("string")).when(i % 11 == 3, F.lit("101")).otherwise(F.col("quality").cast("string"))
    why = F.when(i % 11 == 4, F.lit('"  "')).when(i % 11 == 5, F.lit("7")).otherwise(F.concat(F.lit('" fine '), i.cast("string"), F.lit(' "')))
    body = F.concat(
        F.lit('{"quality":'), q,
        *[F.concat(F.lit(f',"{n}":'), F.col(n).cast("string")) for n in K.DIMENSIONS[1:]],
        F.lit(',"reasoning":'), why, F.lit("}"),
    )
    text = F.when(i % 11 == 6, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        i % 11 == 7, F.concat(F.lit("Sure: "), body)).when(i % 11 == 8, F.lit("[1,2]")).when(i % 11 == 9, F.lit("   ")).otherwise(body)
    return rows.select(i.alias("image_id"), text.alias("body"))


def rolled_faces(spark, d) -> DataFrame:
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"))
    return face_rollup(ids, faces(spark, d), FACE_LIMIT).drop("face_error")


# --- the same views for the checks --------------------------------------------

def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def js_round_sql(x: str, digits: int = 0) -> str:
    if digits:
        s = f"{10 ** digits}.0::DOUBLE"
        return f"({js_round_sql(f'(({x}) * {s})')} / {s})"
    return f"(CASE WHEN ({x}) - floor({x}) >= 0.5 THEN floor({x}) + 1 ELSE floor({x}) END)"


def weighted_sql(weights, col=lambda n: f'"{n}"', digits: int = 2) -> str:
    raw = "0.0::DOUBLE" + "".join(
        f" + {col(n)} * ({w}::DOUBLE / 100.0::DOUBLE)" for n, w in zip(K.DIMENSIONS, weights)
    )
    return js_round_sql(raw, digits)


_GENERAL = weighted_sql(K.GENRE_PRESETS["general"])
_NAMES = f"{_list(PREFIXES)}[doc_id % 3 + 1] || lpad((doc_id % 240)::VARCHAR, 4, '0') || {_list(SUFFIXES)}[doc_id % 6 + 1]"

VIEWS_SQL = {
    "assets": f"""SELECT *, substr(sha256(path), 1, 16) AS image_id, substr(path, {len(ROOT) + 2}) AS relative_path FROM (
        SELECT doc_id, '{ROOT}/' || source || '/' || lang || '/d' || (doc_id // 240)::VARCHAR || '/' || {_NAMES} AS path,
        source AS folder, {_NAMES} AS filename, n_chars AS length, lang FROM documents)""",
    "dims": "SELECT doc_id, " + ", ".join(
        f'CASE WHEN doc_id % 9 = 0 THEN ((doc_id * {k} + n_chars) % 101) // 4 ELSE (doc_id * {k} + n_chars) % 101 END AS "{n}"'
        for n, k in zip(K.DIMENSIONS, FACTORS)) + " FROM documents",
    "faces": """SELECT doc_id AS image_id, face_no, ((doc_id * 13 + face_no * 29) % 100) / 100.0::DOUBLE AS left_open,
        CASE WHEN (doc_id + face_no) % 11 = 0 THEN NULL ELSE ((doc_id * 7 + face_no * 31) % 100) / 100.0::DOUBLE END AS right_open,
        CASE WHEN (doc_id + face_no) % 5 = 0 THEN 'happy' WHEN (doc_id + face_no) % 13 = 0 THEN NULL ELSE 'neutral' END AS emotion,
        doc_id % 17 = 3 AS no_box, ((doc_id * 3 + face_no) % 900)::DOUBLE AS x, ((doc_id * 5 + face_no) % 700)::DOUBLE AS y,
        ((doc_id + face_no) % 400)::DOUBLE AS w, CASE WHEN face_no % 3 = 2 THEN NULL ELSE ((doc_id + face_no) % 300)::DOUBLE END AS h
        FROM (SELECT doc_id, unnest(range(doc_id % 7)) AS face_no FROM documents)""",
    "scores": f"""SELECT a.doc_id, image_id, folder, filename, path, length, {", ".join(f'"{n}"' for n in K.DIMENSIONS)},
        {_GENERAL} AS total, a.doc_id % 7 > {FACE_LIMIT} AS exceeds_face_limit,
        'Asset "' || a.doc_id || '" <' || lang || '> & ''co''' AS reasoning,
        CASE WHEN a.doc_id % 4 = 0 THEN NULL WHEN a.doc_id % 4 = 1 THEN {_list(K.NAME_KEYWORDS[0][1])} ELSE {_list(K.NAME_KEYWORDS[1][1])} END AS keywords,
        length AS tokens_in, CASE WHEN a.doc_id % 6 = 5 THEN NULL ELSE a.doc_id % 200 END AS tokens_out,
        ['claude','openai','gemini','ollama','custom','unknown'][a.doc_id % 6 + 1] AS provider,
        {_list(K.GENRE_PRESETS)}[a.doc_id % 7 + 1] AS genre, a.doc_id * 17 % 5000 AS elapsed_ms
        FROM assets a JOIN dims USING (doc_id)""",
    "vectors": """SELECT vec_id::VARCHAR AS image_id, vec_id, label::VARCHAR AS folder, 'IMG_' || lpad((vec_id % 90)::VARCHAR, 4, '0') || '.jpg' AS filename,
        '/v/' || lpad(vec_id::VARCHAR, 12, '0') AS path,
        CASE WHEN vec_id % 50 = 49 THEN NULL ELSE """ + " + ".join(
            f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64)) + " END AS fp FROM embeddings",
    "text_prints": """SELECT d.doc_id, s.fp FROM documents d LEFT JOIN (SELECT doc_id, """ + " + ".join(
        f"(CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64)) + """ AS fp FROM (
        SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM (
        SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE w <> '') GROUP BY doc_id) s USING (doc_id)""",
    "cache_entries": "SELECT user_id AS folder, event_id AS cache_key, floor(value * 1000)::BIGINT AS size_bytes, ts AS cached_at FROM events",
    "users": f"SELECT c_custkey AS user_id, {_list(K.TIER_LIMITS)}[c_custkey % 3 + 1] AS tier, c_name AS name, c_mktsegment AS segment, c_acctbal FROM customer",
    "usage_events": """SELECT *, strftime(make_timestamp(ts_us), '%Y-%m') AS month_key FROM (SELECT user_id, event_id AS seq,
        epoch_us(ts) - 1000000 * (CASE WHEN event_id % 11 = 5 THEN 7200 WHEN event_id % 50 = 7 THEN 2678400 ELSE 0 END)::BIGINT AS ts_us,
        CASE WHEN event_id % 97 = 0 THEN 600 ELSE 1 + event_id % 40 END AS n,
        CASE user_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 5000 END AS quota FROM events)""",
    "attempts": """SELECT user_id AS image_id, event_id AS attempt_no, CASE WHEN event_type = 'error' THEN (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 503 END)
        WHEN event_type = 'signup' THEN 429 WHEN event_id % 41 = 0 THEN 401 WHEN event_id % 31 = 0 THEN 404 WHEN event_type = 'click' THEN 503
        ELSE (CASE WHEN event_id % 4 = 0 THEN 200 ELSE 500 END) END AS status, 1 + event_id % 90 AS retry_after FROM events""",
    "overrides": "SELECT user_id AS doc_id, ['S','A','B','rejected','bogus'][event_id % 5 + 1] AS tier, event_id AS seq, event_id % 6 = 0 AS undone FROM events",
    "catalog": """SELECT page_id, url, CASE WHEN page_id % 8 = 7 THEN '' ELSE ['claude-x','gpt-4','models/gemini-1','LLaVA','dall-e','o3','moondream',''][page_id % 8 + 1] || '-' || page_id END AS model,
        page_id % 3 <> 0 AS generates FROM pages""",
    "rolled": f"""SELECT d.doc_id AS image_id, count(f.image_id) > 0 AS has_faces, count(f.image_id) AS face_count,
        coalesce(bool_and(coalesce(left_open, 1) > 0.3::DOUBLE AND coalesce(right_open, 1) > 0.3::DOUBLE) FILTER (f.image_id IS NOT NULL), true) AS eyes_open,
        coalesce(bool_or(coalesce(left_open, 1) <= 0.3::DOUBLE OR coalesce(right_open, 1) <= 0.3::DOUBLE) FILTER (f.image_id IS NOT NULL), false) AS blink_detected,
        coalesce(bool_and(coalesce(emotion = 'neutral', true)) FILTER (f.image_id IS NOT NULL), true) AS expression_neutral,
        count(f.image_id) > {FACE_LIMIT} AS exceeds_face_limit
        FROM documents d LEFT JOIN faces f ON f.image_id = d.doc_id GROUP BY d.doc_id""",
}
NEEDS = {"scores": ["assets", "dims"], "rolled": ["faces"]}


def with_views(names: str, body: str) -> str:
    """SQL with the named views (and what they need) as leading WITH clauses."""
    order: list[str] = []

    def add(v):
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in names.split():
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS_SQL[v]})" for v in order)
    text = body.strip()
    if not ctes:
        return text
    recursive = "RECURSIVE " if text.upper().startswith("WITH RECURSIVE ") else ""
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return f"WITH {recursive}{ctes},\n{text[len(head):]}"
    return f"WITH {ctes}\n{text}"
