"""The pipeline stage by stage against brute force, and as a registered query."""

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, packed
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from keepsift.llm import packing, quality
from keepsift.session import store

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """A whole small table with odd rows, near copies and a repeated row added."""
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(10_000 + i, t, "en", None, None if t is None else len(t)) for i, t in enumerate(ODD)]
    words = [f"w{i}" for i in range(60)]
    rows += [(20_000 + i, " ".join(words[:30] + [f"x{i}"] * (i > 0) + words[30:]), "en", "s", 300) for i in range(4)]
    rows += [rows[3], (None, "no id", None, None, 5), (None, "no id", None, None, 5)]
    odd = spark.createDataFrame(rows, real.schema)
    return store(real.unionByName(odd), "documents")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages(spark, docs):
    columns = docs.columns
    first = store(STAGES["quality classifier"](spark, docs, FOLDER), "s1")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    graded = labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))
    judged = quality.grade_documents(docs, quality.fit(docs, graded))
    assert sorted((r.doc_id for r in first.collect()), key=repr) == sorted((r.doc_id for r in judged.where("keep").collect()), key=repr)
    known = judged.join(graded, "doc_id").groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.grade: r.kept for r in known}
    assert kept[2] > 0.95 and kept[0] < 0.2

    # From here on all rows, so that no odd row is missing.
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    second = store(STAGES["exact dedup"](spark, docs, FOLDER), "s2")
    want = {(i, brute.folded(t)) for (i, t), x in zip(rows, brute.exact(rows), strict=True) if x[3]}
    assert sorted(((i, brute.folded(t)) for i, t in pairs(second)), key=repr) == sorted(want, key=repr)

    rows = pairs(second)
    third = store(STAGES["n-gram Jaccard join"](spark, second, FOLDER), "s3")
    assert pairs(third) == sorted((x for x, g in zip(rows, brute.jaccard(rows), strict=True) if g[2] is None or g[2] == x[0]), key=repr)

    rows = pairs(third)
    fourth = store(STAGES["secret scans"](spark, third, FOLDER), "s4")
    assert pairs(fourth) == sorted(((i, brute.redacted(t)) for i, t in rows), key=repr)
    assert fourth.where("n_chars <> char_length(text)").count() == 0
    for df in (first, second, third, fourth):
        assert df.columns == columns

    rows = pairs(fourth)
    got, _, _ = packed(STAGES["best-fit packing"](spark, fourth, FOLDER))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == sorted(brute.pieces(rows, tokenizer), key=repr)


def test_registered(spark):
    got = entry.queries()["pipeline"](spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100


def test_empty(spark, docs):
    df = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        df = store(stage(spark, df, FOLDER), "empty")
    assert df.count() == 0


@pytest.mark.parametrize("name", ["quality classifier", "best-fit packing"])
def test_stages_hand_few_texts_to_python(spark, tmp_path, monkeypatch, name):
    """What a stage gives to Python stays small with the session's own settings, also if another than `run` calls it."""
    path = str(tmp_path / "documents.parquet")
    spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat('x', 20000) AS text").write.parquet(path)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    monkeypatch.setattr(quality, "fit", lambda *a: None)
    monkeypatch.setattr(quality, "good_documents", lambda docs, model: docs.mapInArrow(sizes, "n long"))
    monkeypatch.setattr(packing, "best_fit_packing", lambda docs, *a: store(docs.mapInArrow(sizes, "n long"), "sizes"))
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in keys]
    most = STAGES[name](spark, spark.read.parquet(path), FOLDER).agg(F.max("n"), F.sum("n")).first()
    assert most[0] * 20_000 <= 1_100_000 and most[1] == 600
    assert [spark.conf.get(k) for k in keys] == before
