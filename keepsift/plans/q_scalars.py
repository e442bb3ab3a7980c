"""Scalar functions over the given tables."""

from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import fingerprints as H
from keepsift.functions import numbers as N
from keepsift.functions import paths as P
from keepsift.functions import text as X
from keepsift.plans import views as V
from keepsift.operators.sets import scores_to_map_rows
from keepsift.plans.registry import query
from keepsift.plans.views import js_round_sql, table, weighted_sql

NOW = "2024-01-20 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("image_id", "assets", "SELECT doc_id, image_id FROM assets")
def _(spark, d):
    return V.assets(spark, d).select("doc_id", "image_id")


@query("cache_key", "assets", "SELECT doc_id, substr(sha256(path || ':' || (length * 1000)::VARCHAR), 1, 32) AS cache_key FROM assets")
def _(spark, d):
    return V.assets(spark, d).select("doc_id", P.cache_key(F.col("path"), F.col("length") * 1000).alias("cache_key"))


@query(
    "path_parts",
    "assets",
    r"""SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(path, '/[^/]*$', '') AS dir,
    regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) AS ext,
    regexp_replace(filename, '\.[^.]*$', '') AS stem, substr(path, 8) AS rel,
    '/out/' || substr(path, 8) AS joined FROM assets""",
)
def _(spark, d):
    p = F.col("path")
    return V.assets(spark, d).select(
        "doc_id", P.basename(p).alias("base"), P.dirname(p).alias("dir"), P.extension(p).alias("ext"),
        P.stem(p).alias("stem"), P.relative_to(p, V.ROOT).alias("rel"),
        F.concat(F.lit("/out/"), P.relative_to(p, V.ROOT)).alias("joined"),
    )


@query("is_raw", "assets", f"SELECT doc_id, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) IN ({','.join(repr(e) for e in K.RAW_EXTENSIONS)}) AS is_raw FROM assets")
def _(spark, d):
    return V.assets(spark, d).select("doc_id", P.is_raw(F.col("path")).alias("is_raw"))


@query("hamming_distance", "vectors", "SELECT a.vec_id, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM vectors a LEFT JOIN vectors b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    a = V.vectors(spark, d).select("vec_id", H.to_hex(F.col("fp")).alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return a.join(b, "vec_id", "left").select("vec_id", H.hamming_hex(F.col("a"), F.col("b")).alias("distance"))


@query(
    "hamming_text",
    "assets",
    """SELECT doc_id, (bit_count(xor(('0x' || substr(h1, 1, 16))::UBIGINT, ('0x' || substr(h2, 1, 16))::UBIGINT)) + bit_count(xor(('0x' || substr(h1, 17, 16))::UBIGINT, ('0x' || substr(h2, 17, 16))::UBIGINT)))::INTEGER AS distance
    FROM (SELECT doc_id, md5(path) AS h1, substr(md5(filename), 1, 24) || '00000000' AS h2 FROM assets)""",
)
def _(spark, d):
    # 32 against 24 digits: the shorter one is padded on the right.
    return V.assets(spark, d).select(
        "doc_id", H.hamming_hex(F.md5("path"), F.substring(F.md5("filename"), 1, 24)).alias("distance")
    )


@query("fingerprint_signs", "vectors", "SELECT vec_id, lpad(lower(to_hex(fp)), 16, '0') AS fp FROM vectors")
def _(spark, d):
    return V.vectors(spark, d).select("vec_id", H.to_hex(F.col("fp")).alias("fp"))


@query("fingerprint_text", "text_prints", "SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fp FROM text_prints")
def _(spark, d):
    return V.text_prints(spark, d).select("doc_id", H.to_hex(F.col("fp")).alias("fp"))


@query("weighted_total", "dims", f"SELECT doc_id, {weighted_sql(K.GENRE_PRESETS['wedding'])} AS total FROM dims")
def _(spark, d):
    w = dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["wedding"]))
    return V.dims(spark, d).select("doc_id", N.weighted_total(F.col, lambda n: F.lit(float(w[n]))).alias("total"))


@query("js_round", "", f"SELECT l_orderkey, l_linenumber, {js_round_sql('l_extendedprice * l_discount - 700', 1)} AS r1, {js_round_sql('l_extendedprice * (0 - l_tax)')}::BIGINT AS r0 FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", N.js_round(F.col("l_extendedprice") * F.col("l_discount") - 700, 1).alias("r1"),
        N.js_round(F.col("l_extendedprice") * (0 - F.col("l_tax"))).alias("r0"),
    )


_RAW = ", ".join(f'CASE WHEN "in_{n}" THEN (CASE WHEN tot = 0 OR free = 0 THEN rest::DOUBLE / cnt ELSE "{n}"::DOUBLE / tot * rest END) ELSE "{n}"::DOUBLE END AS "raw_{n}"' for n in K.DIMENSIONS)


@query(
    "normalize_weights",
    "dims",
    f"""WITH p AS (SELECT doc_id, {', '.join(f'"{n}" % 40 AS "{n}"' for n in K.DIMENSIONS)}, [{','.join(repr(n) for n in K.DIMENSIONS)}][doc_id % 6 + 1] AS changed,
      (quality * 1.37::DOUBLE - 8)::DOUBLE AS value, [[], ['exposure'], ['quality','aesthetic','composition','sharpness','exposure','faceEyes'], ['faceEyes','sharpness']][doc_id % 4 + 1] AS locked FROM dims),
    a AS (SELECT *, greatest(0, least(100, {js_round_sql('value')}))::BIGINT AS v, {' + '.join(f"(changed <> '{n}' AND NOT list_contains(locked, '{n}'))::INT" for n in K.DIMENSIONS)} AS free FROM p),
    b AS (SELECT *, 100 - v AS rest, {', '.join(f"(changed <> '{n}' AND (free = 0 OR NOT list_contains(locked, '{n}'))) AS " + chr(34) + f"in_{n}" + chr(34) for n in K.DIMENSIONS)} FROM a),
    c AS (SELECT *, {' + '.join(f'"in_{n}"::INT' for n in K.DIMENSIONS)} AS cnt, {' + '.join(f'(CASE WHEN "in_{n}" THEN "{n}" ELSE 0 END)' for n in K.DIMENSIONS)} AS tot FROM b),
    r AS (SELECT *, {_RAW} FROM c),
    e AS (SELECT *, {', '.join(f'{js_round_sql(chr(34) + "raw_" + n + chr(34))}::BIGINT AS "r_{n}"' for n in K.DIMENSIONS)} FROM r),
    f AS (SELECT *, rest - ({' + '.join(f"(CASE WHEN changed <> '{n}' THEN " + chr(34) + f"r_{n}" + chr(34) + " ELSE 0 END)" for n in K.DIMENSIONS)}) AS drift,
      greatest({', '.join(f'CASE WHEN "in_{n}" THEN "r_{n}" ELSE -1 END' for n in K.DIMENSIONS)}) AS mx FROM e),
    g AS (SELECT *, CASE {' '.join(f"WHEN " + chr(34) + f"in_{n}" + chr(34) + f" AND " + chr(34) + f"r_{n}" + chr(34) + f" = mx THEN '{n}'" for n in K.DIMENSIONS)} END AS top FROM f)
    SELECT doc_id, {', '.join(f"CASE WHEN changed = '{n}' THEN v WHEN top = '{n}' THEN greatest(0, " + chr(34) + f"r_{n}" + chr(34) + " + drift) ELSE " + chr(34) + f"r_{n}" + chr(34) + f" END AS " + chr(34) + n + chr(34) for n in K.DIMENSIONS)} FROM g""",
)
def _(spark, d):
    names = F.array(*map(F.lit, K.DIMENSIONS))
    none = F.array().cast("array<string>")
    sets = F.array(none, F.array(F.lit("exposure")), names, F.array(F.lit("faceEyes"), F.lit("sharpness")))
    rows = V.dims(spark, d).select(
        "doc_id", *[(F.col(n) % 40).alias(n) for n in K.DIMENSIONS],
        F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("changed"),
        (F.col("quality") * 1.37 - 8).alias("value"),
        F.element_at(sets, (F.col("doc_id") % 4 + 1).cast("int")).alias("locked"),
    )
    return N.normalise_weights(rows, "changed", "value", "locked").select("doc_id", *K.DIMENSIONS)


@query(
    "parse_scores",
    "dims",
    """SELECT image_id, CASE WHEN error IS NULL THEN quality END AS quality, CASE WHEN error IS NULL THEN face_eyes END AS face_eyes,
    CASE WHEN error IS NULL THEN reasoning END AS reasoning, error FROM (SELECT doc_id AS image_id,
    CASE WHEN doc_id % 11 IN (1,3,4,5,7,8,9) THEN NULL WHEN doc_id % 11 = 2 THEN quality + 1 ELSE quality END::INTEGER AS quality,
    CASE WHEN doc_id % 11 IN (1,3,4,5,7,8,9) THEN NULL ELSE "faceEyes" END::INTEGER AS face_eyes,
    CASE WHEN doc_id % 11 IN (1,3,4,5,7,8,9) THEN NULL ELSE 'fine ' || doc_id END AS reasoning,
    CASE doc_id % 11 WHEN 1 THEN 'key "quality" is missing or not a number' WHEN 3 THEN 'key "quality" is out of range'
      WHEN 4 THEN 'key "reasoning" is missing or empty' WHEN 5 THEN 'key "reasoning" is missing or empty' WHEN 7 THEN 'invalid JSON'
      WHEN 8 THEN 'root value is not an object' WHEN 9 THEN 'response text is empty' WHEN 2 THEN (CASE WHEN quality = 100 THEN 'key "quality" is out of range' END) END AS error
    FROM dims)""",
)
def _(spark, d):
    p = X.parse_score_answers(V.answers(spark, d))
    return p.select("image_id", "quality", F.col("faceEyes").alias("face_eyes"), "reasoning", "error")


@query(
    "parse_tags",
    "assets",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 1 THEN NULL ELSE lower(source) || '; two words' END AS first_tags,
    CASE WHEN doc_id % 5 = 4 THEN NULL ELSE lang END AS second_tags FROM (SELECT doc_id, folder AS source, lang FROM assets)""",
)
def _(spark, d):
    # Per row a valid entry, a string instead of an array (doc_id % 5 = 1) or broken JSON (4).
    i = F.col("doc_id")
    first = F.when(i % 5 == 1, F.lit('"oops"')).otherwise(
        F.concat(F.lit('[" '), F.upper("folder"), F.lit(' ", "", 5, null, {"a": 1}, "Two Words"]'))
    )
    text = F.concat(F.lit('```\n{"a.jpg": '), first, F.lit(', "b.jpg": ["'), "lang", F.lit('"], "c.jpg": ["x"]}'), F.when(i % 5 == 4, "!").otherwise("\n```"))
    tags = X.parse_tag_answer(text, F.array(F.lit("a.jpg"), F.lit("b.jpg"), F.lit("none.jpg")))
    return (
        V.assets(spark, d)
        .select("doc_id", tags.alias("t"))
        .select("doc_id", F.array_join(F.col("t")["a.jpg"], "; ").alias("first_tags"), F.array_join(F.col("t")["b.jpg"], "; ").alias("second_tags"))
    )


def _weights_sql(weights):
    return "\n".join(f"- {n}: weight {w}" for n, w in zip(K.DIMENSIONS, weights))


_KEYS = ", ".join(f'"{n}"' for n in K.DIMENSIONS)


@query(
    "scoring_prompt",
    "assets rolled",
    f"""SELECT doc_id, md5('genre: wedding' || chr(10) || 'file: ' || filename || chr(10) || 'context: ' || CASE WHEN doc_id % 2 = 0 THEN '-' ELSE 'lang ' || lang END || chr(10) ||
    'wishes: ' || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE folder END || chr(10) ||
    CASE WHEN has_faces THEN 'faces: ' || face_count || ', eyes open ' || eyes_open || ', blink ' || blink_detected || ', neutral ' || expression_neutral ELSE 'faces: 0' END
    || chr(10) || 'rate 0 to 100:' || chr(10) || '{_weights_sql(K.GENRE_PRESETS["wedding"])}' || chr(10) ||
    'reply: one JSON object with numbers {_KEYS} and text "reasoning"') AS prompt_md5 FROM assets JOIN rolled ON rolled.image_id = assets.doc_id""",
)
def _(spark, d):
    w = dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["wedding"]))
    rows = V.assets(spark, d).drop("image_id").join(V.rolled_faces(spark, d).withColumnRenamed("image_id", "doc_id"), "doc_id")
    prompt = X.scoring_prompt(
        F.col("filename"), F.lit("wedding"), F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.concat(F.lit("lang "), "lang")),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), "folder")), lambda n: F.lit(w[n]),
        {c: F.col(c) for c in ("has_faces", "face_count", "eyes_open", "blink_detected", "expression_neutral")},
    )
    return rows.select("doc_id", F.md5(prompt).alias("prompt_md5"))


@query("discovery_prompt", "", "SELECT doc_id, 'genre: ' || lang || chr(10) || 'samples: ' || (doc_id % 8 + 1) || chr(10) || 'reply: a short description of the set' AS prompt FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.discovery_prompt(F.col("lang"), F.col("doc_id") % 8 + 1).alias("prompt"))


@query("tagging_prompt", "assets", """SELECT doc_id, 'files: ' || CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END || chr(10) || 'reply: one JSON object, file name to a list of keywords' || chr(10) || '"' || filename || '"' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',' || chr(10) || '"x.jpg"' END AS prompt FROM assets""")
def _(spark, d):
    names = F.when(F.col("doc_id") % 2 == 0, F.array("filename")).otherwise(F.array("filename", F.lit("x.jpg")))
    return V.assets(spark, d).select("doc_id", X.tagging_prompt(names).alias("prompt"))


@query("rating_label", "overrides", """SELECT seq, CASE tier WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 ELSE 1 END AS rating, CASE tier WHEN 'S' THEN 'Green' WHEN 'A' THEN 'Blue' WHEN 'B' THEN 'Yellow' ELSE 'Red' END AS label FROM overrides""")
def _(spark, d):
    return V.overrides(spark, d).select("seq", X.tier_rating(F.col("tier")).alias("rating"), X.tier_label(F.col("tier")).alias("label"))


@query("escape_xml", "", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped_md5 FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.escape_xml(F.col("html"))).alias("escaped_md5"))


@query("sidecar_path", "assets", r"SELECT doc_id, regexp_replace(path, '\.[^./]*$', '') || '.xmp' AS sidecar FROM assets")
def _(spark, d):
    return V.assets(spark, d).select("doc_id", P.sidecar_path(F.col("path")).alias("sidecar"))


@query("csv_quote", "scores", """SELECT doc_id, '"' || replace(reasoning, '"', '""') || '"' AS quoted, coalesce(array_to_string(keywords, '; '), '') AS joined, array_to_string(keywords[1:4], ', ') AS shown FROM scores""")
def _(spark, d):
    k = F.col("keywords")
    return V.scores(spark, d).select("doc_id", X.csv_quote(F.col("reasoning")).alias("quoted"), X.joined_keywords(k).alias("joined"), F.array_join(X.first_keywords(k), ", ").alias("shown"))


@query("distinct_tokens", "", r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[,\s]+')) AS tok, generate_subscripts(regexp_split_to_array(text, '[,\s]+'), 1) AS pos FROM conversations),
u AS (SELECT conv_id, turn, tok, min(pos) AS pos FROM t WHERE tok <> '' GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(string_agg(u.tok, ' ' ORDER BY u.pos), '') AS tokens, count(u.tok)::INTEGER AS n FROM conversations c LEFT JOIN u USING (conv_id, turn) GROUP BY ALL""")
def _(spark, d):
    t = P.distinct_tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query("ignore_patterns", "", r"""SELECT page_id, count(l)::INTEGER AS n, coalesce(string_agg(l, '|' ORDER BY i), '') AS first_lines FROM pages LEFT JOIN (SELECT * FROM (
SELECT page_id, trim(l) AS l, i FROM (SELECT page_id, unnest(string_split(replace(html, '>', '>' || chr(10)), chr(10))) AS l, generate_subscripts(string_split(replace(html, '>', '>' || chr(10)), chr(10)), 1) AS i FROM pages))
WHERE l <> '' AND NOT starts_with(l, '#')) USING (page_id) GROUP BY page_id""")
def _(spark, d):
    lines = P.ignore_patterns(F.replace(F.col("html"), F.lit(">"), F.lit(">\n")))
    return table(spark, d, "pages").select("page_id", F.size(lines).alias("n"), F.array_join(lines, "|").alias("first_lines"))


GLOBS = ("*/src1?.example/*", "**/p*[02468].html", "*7*", "https:**[!a]", "(x+y)[")


@query("glob_to_regex", "", r"""SELECT page_id,
regexp_matches(url, '(?i)^[^/]*/src1[^/]\.example/[^/]*$') AS g0, regexp_matches(url, '(?i)^.*p[^/]*[02468]\.html$') AS g1,
regexp_matches(url, '(?i)(?:^|/)[^/]*7[^/]*$') AS g2, regexp_matches(url, '(?i)(?:^|/)https:.*[!a]$') AS g3, regexp_matches(url, '(?i)(?:^|/)\(x\+y\)\[$') AS g4 FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", *[F.col("url").rlike(P.glob_to_regex(g)).alias(f"g{i}") for i, g in enumerate(GLOBS)])


@query("weights_csv", "dims", "SELECT doc_id, quality::DOUBLE AS quality, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE exposure::DOUBLE END AS exposure, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE \"faceEyes\"::DOUBLE END AS face_eyes FROM dims")
def _(spark, d):
    i = F.col("doc_id")
    text = F.concat_ws(",", *K.DIMENSIONS[:4], F.when(i % 5 == 1, "abc").otherwise(F.col("exposure").cast("string")), F.when(i % 5 != 2, F.concat(F.lit(" "), F.col("faceEyes").cast("string"))))
    return V.dims(spark, d).select("doc_id", X.parse_weights_csv(text).alias("w")).select("doc_id", "w.quality", "w.exposure", F.col("w.faceEyes").alias("face_eyes"))


@query("estimate_cost", "scores", f"""SELECT doc_id, {js_round_sql("(tokens_in * 1000 / 1000000.0::DOUBLE) * CASE provider WHEN 'claude' THEN 3.0 WHEN 'openai' THEN 2.0 WHEN 'gemini' THEN 1.5 ELSE 0.0 END::DOUBLE + (tokens_in * 77 / 1000000.0::DOUBLE) * CASE provider WHEN 'claude' THEN 15.0 WHEN 'openai' THEN 8.0 WHEN 'gemini' THEN 9.0 ELSE 0.0 END::DOUBLE", 4)} AS cost FROM scores""")
def _(spark, d):
    return V.scores(spark, d).select("doc_id", N.estimate_cost(F.col("provider"), F.col("tokens_in") * 1000, F.col("tokens_in") * 77).alias("cost"))


@query("eta_text", "scores", f"""WITH e AS (SELECT doc_id, {js_round_sql('elapsed_ms / 1000.0::DOUBLE / (doc_id % 30 + 1) * (60 - (doc_id % 30 + 1))')}::BIGINT AS eta,
{js_round_sql('elapsed_ms / 1000.0::DOUBLE / (doc_id % 30 + 1) / 5 * (60 - (doc_id % 30 + 1))')}::BIGINT AS eta_parallel FROM scores)
SELECT *, CASE WHEN eta < 60 THEN '~' || eta || 's remaining' WHEN eta % 60 = 0 THEN '~' || eta // 60 || ' min remaining' ELSE '~' || eta // 60 || ' min ' || eta % 60 || 's remaining' END AS label FROM e""")
def _(spark, d):
    done, sec = F.col("doc_id") % 30 + 1, F.col("elapsed_ms") / 1000.0
    rows = V.scores(spark, d).select("doc_id", N.eta_seconds(sec, done, F.lit(60)).alias("eta"), N.eta_seconds(sec, done, F.lit(60), F.lit(5)).alias("eta_parallel"))
    return rows.withColumn("label", N.format_eta(F.col("eta")))


@query("month_key", "", "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.month_key(F.col("l_shipdate")).alias("month"))


_DAYS = f"floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0::DOUBLE / 86400)::BIGINT"
_RDAYS = js_round_sql(f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0::DOUBLE / 86400") + "::BIGINT"


@query("age_labels", "", f"""SELECT event_id, CASE {_DAYS} WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE CASE WHEN {_DAYS} < 7 THEN {_DAYS} || ' days ago' ELSE strftime(ts, '%b %-d, %Y') END END AS age,
CASE WHEN {_RDAYS} <= 0 THEN 'oldest entry: today' WHEN {_RDAYS} = 1 THEN 'oldest entry: 1 day ago' ELSE 'oldest entry: ' || {_RDAYS} || ' days ago' END AS oldest FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.age_label(F.col("ts"), now()).alias("age"), X.oldest_entry_label(F.col("ts"), now()).alias("oldest"))


@query("human_bytes", "", f"""SELECT l_orderkey, l_linenumber, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', {js_round_sql('b / 1073741824.0::DOUBLE', 2)}) WHEN b >= 1048576 THEN printf('%.1f MB', {js_round_sql('b / 1048576.0::DOUBLE', 1)})
WHEN b > 0 THEN {js_round_sql('b / 1024.0::DOUBLE')}::BIGINT || ' KB' ELSE '0 B' END AS size FROM (SELECT l_orderkey, l_linenumber, floor(power(l_quantity, (l_linenumber + 1)::DOUBLE))::BIGINT AS b FROM lineitem)""")
def _(spark, d):
    b = F.floor(F.pow("l_quantity", F.col("l_linenumber") + 1)).cast("bigint")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.human_bytes(b).alias("size"))


@query("durations", "", "SELECT event_id, CASE WHEN event_id * 7 >= 1000 THEN printf('%.2f s', s + CASE WHEN s * 8 = floor(s * 8) AND floor(s * 8) % 2 = 1 THEN 1e-9 ELSE 0 END) ELSE (event_id * 7) || ' ms' END AS text FROM (SELECT event_id, event_id * 7 / 1000.0::DOUBLE AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", N.duration_text(F.col("event_id") * 7).alias("text"))


@query("base_url", "", r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/v2' ELSE regexp_replace(url, '/+$', '') || '/v1' END AS base FROM pages""")
def _(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/v2//"))).otherwise(F.concat(F.lit(" "), "url", F.lit("/")))
    return table(spark, d, "pages").select("page_id", P.normalise_base_url(u).alias("base"))


@query("retry_after", "", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN greatest(1, event_id % 90) WHEN 1 THEN 1 ELSE 60 END::BIGINT AS seconds FROM events")
def _(spark, d):
    i = F.col("event_id")
    h = F.when(i % 4 == 0, F.concat(F.lit(" "), (i % 90).cast("string"), F.lit("s"))).when(i % 4 == 1, F.lit("-5")).when(i % 4 == 2, F.col("event_type"))
    return table(spark, d, "events").select("event_id", X.retry_after(h).alias("seconds"))


@query("face_boxes", "faces", """SELECT image_id, face_no::INTEGER AS face_no, CASE WHEN no_box THEN 0.0 ELSE least(1.0, x / 800) END::DOUBLE AS x, CASE WHEN no_box THEN 0.0 ELSE least(1.0, y / 600) END::DOUBLE AS y,
CASE WHEN no_box THEN 1.0 ELSE w / 800 END::DOUBLE AS width, CASE WHEN no_box OR h IS NULL THEN 1.0 ELSE h / 600 END::DOUBLE AS height FROM faces""")
def _(spark, d):
    from keepsift.operators.rollups import face_boxes

    return face_boxes(V.faces(spark, d))


@query("face_predicates", "faces", """SELECT image_id, face_no::INTEGER AS face_no, left_open > 0.3::DOUBLE AND coalesce(right_open, 1) > 0.3::DOUBLE AS eyes_open, left_open <= 0.3::DOUBLE OR coalesce(right_open, 1) <= 0.3::DOUBLE AS blink, coalesce(emotion = 'neutral', true) AS neutral FROM faces""")
def _(spark, d):
    from keepsift.functions import faces as A

    left, right = F.col("left_open"), F.col("right_open")
    return V.faces(spark, d).select("image_id", "face_no", A.eyes_open(left, right).alias("eyes_open"), A.blinks(left, right).alias("blink"), A.is_neutral(F.col("emotion")).alias("neutral"))


@query("folder_relationship", "assets", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'output-inside-input' WHEN 2 THEN 'input-inside-output' ELSE 'ok' END AS relation FROM assets""")
def _(spark, d):
    i, a = F.col("doc_id"), P.dirname(F.col("path"))
    b = F.when(i % 5 == 0, F.concat(F.upper(a), F.lit("/"))).when(i % 5 == 1, F.concat(a, F.lit("/out"))).when(i % 5 == 2, F.lit(V.ROOT)).when(i % 5 == 3, F.concat(a, F.lit("-out"))).otherwise(F.lit(""))
    return V.assets(spark, d).select("doc_id", P.folder_relationship(a, b).alias("relation"))


@query("fit_dimensions", "", f"""SELECT l_orderkey, l_linenumber, {js_round_sql('w * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(w, h))')}::BIGINT AS width, {js_round_sql('h * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(w, h))')}::BIGINT AS height
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4000 + 1 AS w, l_orderkey % 3000 + 1 AS h FROM lineitem)""")
def _(spark, d):
    w, h = N.fit_dimensions(F.col("l_partkey") % 4000 + 1, F.col("l_orderkey") % 3000 + 1, K.PREVIEW_MAX_PX)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w.alias("width"), h.alias("height"))


@query("file_url", "", r"""SELECT event_id, 'file:///' || replace(replace('C:/a b/' || event_type || '/(1)!/' || replace(replace(replace(replace(replace(props, '%', '%25'), '{', '%7B'), '"', '%22'), ':', '%3A'), '}', '%7D'), ' ', '%20'), '''', '''') || '.jpg' AS url FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", P.file_url(F.concat(F.lit("C:\\a b/"), "event_type", F.lit("/(1)!/"), "props", F.lit(".jpg"))).alias("url"))


@query("http_errors", "attempts", "SELECT image_id, attempt_no, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 401 THEN 'auth' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server' ELSE 'other' END AS error_class FROM attempts")
def _(spark, d):
    return V.attempts(spark, d).select("image_id", "attempt_no", X.http_error_class(F.col("status")).alias("error_class"))


@query("mask_secret", "", "SELECT c_custkey, '••••••••' || right(c_name, 4) AS masked FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.mask_secret(F.col("c_name")).alias("masked"))


@query("score_band", "scores", "SELECT doc_id, CASE WHEN total >= 90 THEN 'excellent' WHEN total >= 75 THEN 'good' WHEN total >= 60 THEN 'fair' ELSE 'low' END AS band FROM scores")
def _(spark, d):
    return V.scores(spark, d).select("doc_id", N.score_band(F.col("total")).alias("band"))


@query("default_profile_name", "scores", "SELECT s.doc_id, upper(genre[1]) || genre[2:] || ' — ' || strftime(o_orderdate, '%B %Y') AS name FROM scores s LEFT JOIN orders ON o_orderkey = s.doc_id")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    return V.scores(spark, d).join(o, "doc_id", "left").select("doc_id", X.profile_name(F.col("genre"), F.col("o_orderdate")).alias("name"))


@query("thumbnail_path", "assets", "SELECT doc_id, 'thumbnails/' || image_id || '.jpg' AS thumb FROM assets")
def _(spark, d):
    return V.assets(spark, d).select("doc_id", P.thumbnail_path(F.col("image_id")).alias("thumb"))


@query("progress", "", f"""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus <> 'O') AS scored, (count(*) FILTER (o_orderstatus <> 'O'))::DOUBLE / count(*) AS fraction,
{js_round_sql("(count(*) FILTER (o_orderstatus <> 'O'))::DOUBLE / count(*) * 100")}::BIGINT AS pct FROM orders GROUP BY o_custkey""")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") != "O").alias("scored"))
    return g.withColumns({"fraction": N.progress_fraction(F.col("scored"), F.col("total")), "pct": N.percent_of(F.col("scored"), F.col("total"))})


@query("last_segment", "", "SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS seg FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.last_segment(F.concat(F.col("url"), F.lit("//"))).alias("seg"))


@query("scores_map", "scores", "SELECT folder, image_id, total FROM scores UNION ALL SELECT folder, 'extra', -1.0 FROM (SELECT DISTINCT folder FROM scores)")
def _(spark, d):
    # Map per row joined with a second map, then back to rows.
    s = V.scores(spark, d)
    m = s.select("folder", F.create_map("image_id", "total").alias("m"))
    extra = s.select("folder").distinct().select("folder", F.create_map(F.lit("extra"), F.lit(-1.0)).alias("m"))
    record = F.transform_values("m", lambda k, v: F.struct(v.alias("total")))
    sessions = m.unionByName(extra).select(F.col("folder").alias("session_id"), record.alias("scores"))
    return scores_to_map_rows(sessions).select(F.col("session_id").alias("folder"), "image_id", "total")
