"""Files written from the given tables below the work folder and read back."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from keepsift.plans.registry import query
from keepsift.plans.views import table
from keepsift.session import store, work_dir
from keepsift.sources import listing as L
from keepsift.sources import sessions as S

#: Documents of one session file, on average at most.
SESSION_ROWS = 1000


def folder(spark, name):
    return f"{work_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


def write_files(rows, root):
    """Write rows(path, body) below `root` in the tasks."""

    def run(batches):
        from pyarrow import fs

        made = set()
        for pdf in batches:
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                full = f"{root}/{path}"
                system, local = fs.FileSystem.from_uri(full) if "://" in full or full.startswith("file:") else (fs.LocalFileSystem(), full)
                parent = local.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(local) as f:
                    f.write(body.encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0]


@query("load_assets", "", "SELECT doc_id, doc_id % 50 <> 7 AS loaded, CASE WHEN doc_id % 50 <> 7 THEN strlen(text) END AS n_bytes, CASE WHEN doc_id % 50 <> 7 THEN md5(text) END AS body_md5 FROM documents")
def _(spark, d):
    # Every fiftieth file is listed but gone.
    root, i = folder(spark, "assets"), F.col("doc_id")
    # A thousand ids a folder and a thousand folders in one above them.
    place = [F.concat(F.lit("f"), F.floor(i / n).cast("string"), F.lit("/")) for n in (1_000_000, 1_000)]
    docs = table(spark, d, "documents").select(F.concat(*place, i.cast("string"), F.lit(".jpg")).alias("path"), F.col("text").alias("body"), i)
    write_files(docs.where(i % 50 != 7).select("path", "body"), root)
    gone = docs.where(i % 50 == 7).select(F.concat(F.lit(root + "/"), "path").alias("path"), F.lit(0).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("modified_us"))
    good, bad = L.load_assets(L.list_files(spark, root).unionByName(L.from_manifest(gone, root)))
    number = F.regexp_extract("filename", r"(\d+)", 1).cast("bigint").alias("doc_id")
    none = F.lit(None)
    return good.select(number, F.lit(True).alias("loaded"), F.length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("body_md5")).unionByName(
        bad.select(number, F.lit(False).alias("loaded"), none.cast("bigint").alias("n_bytes"), none.cast("string").alias("body_md5"))
    )


@query("read_session", "", "SELECT source AS session_id, doc_id::VARCHAR AS image_id, (doc_id % 101)::DOUBLE AS total FROM documents")
def _(spark, d):
    # Sessions of some SESSION_ROWS documents of one source; every third main file is broken and its backup counts.
    # An id is held once by a session, so further rows with it go to sessions of their own; "" stands for no id.
    root, i = folder(spark, "sessions"), F.col("doc_id")
    ids = store(table(spark, d, "documents").groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times")), "session-ids")
    sources = store(ids.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / SESSION_ROWS).alias("sessions")), "session-counts")
    part = F.pmod(F.xxhash64("doc_id"), F.col("sessions")).alias("part")
    rows = ids.join(sources, "source").select("source", i, part, F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    score = F.struct(F.concat(i.cast("string"), F.lit(".jpg")).alias("filename"), (i % 101).cast("double").alias("total"))
    entry = F.struct(F.coalesce(i.cast("string"), F.lit("")), score)
    # Dealt by session, also where the join has dealt by source.
    per = rows.repartition("source", "part", "copy").groupBy("source", "part", "copy").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"))
    body = F.to_json(F.struct(F.col("source").alias("sessionId"), F.lit("done").alias("status"), "scores"))
    broken = F.pmod(F.xxhash64("source", "part", "copy"), F.lit(3)) == 0
    path = F.concat("source", F.lit("/"), F.col("part").cast("string"), F.lit("-"), F.col("copy").cast("string"))
    main = F.struct(F.concat(path, F.lit("/session.json")).alias("path"), F.when(broken, F.lit("{broken")).otherwise(body).alias("body"))
    backup = F.struct(F.concat(path, F.lit("/session.backup.json")).alias("path"), F.when(broken, body).otherwise(F.lit('{"sessionId": "old"}')).alias("body"))
    write_files(per.select(F.inline(F.array(main, backup))), root)
    return S.session_scores(S.read_session(spark, root)).select("session_id", F.nullif("image_id", F.lit("")).alias("image_id"), "total")


@query("read_ignore_file", "", "SELECT trim(line) AS pattern, count(*) AS n FROM (SELECT unnest(['# ' || source, '', '  ' || lang || '/* ', source || '/**']) AS line FROM documents) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') GROUP BY ALL")
def _(spark, d):
    root = folder(spark, "ignore")
    lines = F.array(F.concat(F.lit("# "), "source"), F.lit(""), F.concat(F.lit("  "), "lang", F.lit("/* ")), F.concat("source", F.lit("/**")))
    table(spark, d, "documents").select(F.explode(lines).alias("value")).write.text(root)
    return L.read_ignore_file(spark, root).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("read_store_tables", "", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS genre, NULL::DOUBLE AS top_score FROM customer UNION ALL SELECT o_orderkey::VARCHAR, o_orderpriority, (o_orderkey % 100)::DOUBLE FROM orders")
def _(spark, d):
    profiles, history = folder(spark, "profiles"), folder(spark, "history")
    table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("genre")).write.json(profiles)
    k = F.col("o_orderkey")
    table(spark, d, "orders").select(k.cast("string").alias("sessionId"), F.col("o_orderpriority").alias("genre"), (k % 100).cast("double").alias("topScore")).write.json(history)
    return S.read_profiles(spark, profiles).select("id", "genre", F.lit(None).cast("double").alias("top_score")).unionByName(
        S.read_history(spark, history).select(F.col("sessionId").alias("id"), "genre", F.col("topScore").alias("top_score"))
    )
