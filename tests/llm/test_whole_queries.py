"""Queries without SQL against plain Python over a whole table; inputs that once went wrong."""

import hashlib
import math
import re
import zlib

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keepsift.llm import exact_dedup, quality, secrets, words

FOLDER = "/root/testdata/sf0.001"


def test_shards(spark):
    """op8: places follow from digests of the ids and fractions within the sources."""
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    keyed = []
    for i, text, source in rows:
        data = (text or "").encode()
        shuffled = hashlib.md5(f"17:{'-' if i is None else i}".encode()).hexdigest()
        keyed.append((shuffled, i, zlib.crc32(data), len(data) + 8, source))
    fractions = []
    for source in {k[4] for k in keyed}:
        of_source = sorted(k for k in keyed if k[4] == source)
        fractions += [((rank + 0.5) / len(of_source), *k) for rank, k in enumerate(of_source)]
    want, n = [], len(rows)
    for place, (_, _, i, crc, size, _) in enumerate(sorted(fractions)):
        shard = place * 24 // n
        want.append((i, size, crc, "rows", shard, place - (shard * n + 23) // 24, None))
    got = entry.queries()["op8_sharding"](spark, FOLDER)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


M = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def word_hash(word):
    got, power = len(word), 1
    for b in word:
        got, power = (got + (b + 1) * power) & M, (power * words._BYTE_BASE) & M
    return mixed(got)


def plain_features(text):
    data = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    found = re.findall(rb"[0-9a-z\x80-\xff]+", data)
    symbols = re.findall(rb"[^0-9a-z\x80-\xff \t-\r]+", data)
    out = {word_hash(w) >> 32 for w in found} | {mixed(word_hash(s)) >> 32 for s in symbols}
    again, many = sum(a == b for a, b in zip(found, found[1:])), sum(len(s) > 2 for s in symbols)
    count = max(1, len(found))
    for kind, value in enumerate((math.log2(1 + again), math.log2(1 + many), again / count * 10, len(symbols) / count * 10)):
        out |= {mixed((kind + 1) << 32 | level) >> 32 for level in range(1, 11) if value >= level}
    return out


def test_grades(spark):
    """op5: every chance follows from one weight per feature and the thresholds."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade")))
    weights = dict(zip(model.known.tolist(), model.weights.tolist(), strict=True))
    assert len(weights) > 10 and list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in entry.queries()["op5_quality_classifier"](spark, FOLDER).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        score = math.fsum(weights.get(f, 0.0) for f in plain_features(text))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert got[i].tail_1 == pytest.approx(tails[0], abs=1e-9) and got[i].tail_2 == pytest.approx(tails[1], abs=1e-9)
        assert got[i].expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert got[i].keep == (got[i].tail_2 >= 0.5)


def test_kept_rows_leave_all_columns_alone(spark):
    rows = [(1, "Text", "a", "b", "c"), (2, "text", "mine2", "sha2", "row2"), (None, "other", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _sha string, row string")
    df = df.withColumn("id", F.lit("i")).withColumn("sha", F.lit("s"))
    got = exact_dedup.kept_rows(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(*r, "i", "s") for r in rows[1:]], key=repr)
    twice = exact_dedup.kept_rows(df.unionAll(df))
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted([(*r, "i", "s") for r in rows[1:]], key=repr)


def test_many_secrets_in_one_text(spark):
    """Beyond the numbers that are added up in one go, and with overlapping kinds."""
    text = "é😀 " + "".join(f"token={i:024x} AKIA{i:016d} 漢 " for i in range(3000)) + "deadbeef" * 4
    rows = [(1, text), (2, text * 2), (3, "no secret"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:-1] for r in secrets.scan_secrets(df).collect())
    assert got == sorted(brute.secrets(rows))
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert masked == {i: None if t is None else brute.redacted(t) for i, t in rows}
