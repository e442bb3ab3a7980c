"""Every operator on odd rows, against brute force; registered queries against SQL or brute force on a whole table."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import brute
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from keepsift.llm import bpe, exact_dedup, jaccard_join, packing, quality, secrets, sharding, topk

FOLDER = "/root/testdata/sf0.001"
KEY = "AKIA" + "ABCD1234" * 2
ODD = [
    None,
    "",
    " \t\n",
    "Same Text",
    "same text",
    "SAME TEXT",
    "ÉSAME",
    "ésame",
    "a" * 300_000,
    " " * 200_000 + "x",
    "word " * 20_000,
    "漢字かな交じり文😀 token: 'abcDEF123' é",
    f'password = "hunter2hunter" and {KEY} or AKIASHORT secret=token = abcdefgh',
    "é😀 deadbeefdeadbeefdeadbeef0123 api-key api_key:x1y2z3w4 apikey=short",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " xoxb-1234567890-abc",
    "<|endoftext|> in a text<|endoftext|>",
    "one two three",
    "one two three four five six seven",
]


def table(spark, rows):
    """Rows with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = "id keep_id kept digest norm salt size shard slot rank rows place kinds row ids n a b piece length group tokens bits".split()
    return df.select("doc_id", "text", F.lit("s").alias("source"), *[F.lit(1).alias(n) for n in names]).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Each odd text, some twice under other ids, one row repeated, two rows without an id."""
    rows = list(enumerate(ODD))
    rows += [(100 + i, t) for i, t in rows[:8]] + [(3, ODD[3]), (None, "no id"), (None, "no id"), (None, None)]
    return rows, table(spark, rows)


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def check_exact(df, rows, **more):
    got = result(exact_dedup.exact_dedup(df, **more), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(brute.exact(rows), key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.char_length(t).cast("string"), lambda t: F.lit("x")])
def test_exact(odd, digest):
    check_exact(odd[1], odd[0], salts=3, digest=digest)


def test_exact_kept_rows(odd):
    rows, df = odd
    got = exact_dedup.kept_rows(df)
    assert got.columns == df.columns
    want = {(i, brute.folded(t)) for (i, t), x in zip(rows, brute.exact(rows), strict=True) if x[3]}
    assert sorted(((r.doc_id, brute.folded(r.text)) for r in got.collect()), key=repr) == sorted(want, key=repr)


def check_shards(got, rows, shards):
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_sharding(spark, odd):
    check_shards(sharding.interleaved_shards(odd[1], 5).collect(), odd[0], 5)
    r = random.Random(1)
    rows = [(i, f"text {i}", r.choice(["big", "big", "big", "small", "mid", "mid", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = sharding.interleaved_shards(df, 24).collect()
    check_shards(got, [x[:2] for x in rows], 24)
    total, by = Counter(x[2] for x in rows), Counter((x.shard, x.source) for x in got)
    assert all(abs(by[s, name] - n / 24) <= 2 for s in range(24) for name, n in total.items())
    again = sharding.interleaved_shards(df.repartition(2), 24).collect()
    assert {(x.doc_id, x.shard, x.slot) for x in got} == {(x.doc_id, x.shard, x.slot) for x in again}
    assert {x.doc_id: x.shard for x in got} != {x.doc_id: x.shard for x in sharding.interleaved_shards(df, 24, seed=2).collect()}


def test_secrets(odd):
    got = result(secrets.scan_secrets(odd[1]), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == sorted(brute.secrets(odd[0]), key=repr)
    assert sum(x[1] for x in got) and sum(x[2] for x in got) and sum(x[3] for x in got) and any("private_key" in x[5] for x in got)


def test_secrets_redacted(odd):
    got = secrets.redact_secrets(odd[1])
    assert got.columns == odd[1].columns
    assert result(got, "doc_id", "text") == sorted(((i, brute.redacted(t)) for i, t in odd[0]), key=repr)


def test_whole_private_keys_are_masked(spark):
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = ["MIIEpAIBAAKCAQEA" + "aB3/+x9Z" * 6] * 25
    body = "\n".join([*lines, "Zm9vYmFy"])
    info = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123"
    cases = [
        (f"see {head}\n{body}\n{end} after", "see [secret] after"),
        (f"see {head}\n{body}\nThe text goes on", "see [secret]\nThe text goes on"),
        (f"{head}\n{info}\n\n{body}==", "[secret]"),
        (f"{head}\n{info}\n\n{body}\n{end}", "[secret]"),
        (f'"{head}\\n{body}\n'.replace("\n", "\\n") + f'{end}\\n"', '"[secret]\\n"'),
        (f"{head} {' '.join(lines)} {end}", "[secret]"),
        (f"{head}\r\n" + "\r\n".join(lines * 4000) + f"\r\n{end}.", "[secret]."),
        (f"{head}\n" + "\n".join(lines * 4000) + "\n", "[secret]\n"),
        (f"a {head} b {head}\n{body}\n{end} c", "a [secret] b [secret] c"),
        (f"the line {head} starts a key", "the line [secret] starts a key"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert [got[i][:200] for i in range(len(cases))] == [want for _, want in cases]


def test_trigram_queries():
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in (*secrets.BASE, *secrets.MORE)}
    assert queries["hex"] == [] and queries["access"] == [[frozenset({"aki", "kia"})]]
    assert frozenset({"tok", "oke", "ken"}) in queries["assign"][0] and len(queries["assign"][0]) == 6
    assert queries["github"] == [[frozenset({f"gh{c}", f"h{c}_"}) for c in "oprsu"]]
    assert secrets.trigram_query("a.*b") == []


def brute_top(rows, k=5, every=50):
    import math

    q = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, x in q.items():
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in q.items() if j != i and len(y) == len(x))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def test_top_k(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 0.5, 0.25, 3.0]) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [3.0, 3.0, 3.0, 3.0]) for i in range(60)]
    rows += [(2001, None), (2002, [1.0, None, 1.0, 1.0]), (2003, [float("nan")] * 4), (2004, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(2050, [1.0, 2.0]), (2051, [5.0, 5.0]), (2100, []), (2150, [1e6, -1e6, 1e6, 3e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("need", F.lit(1)).withColumn("q", F.lit("x")).repartition(4)
    assert result(topk.top_k(df), "query_id", "rank", "vec_id", "score") == brute_top(rows)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_top_k_takes_every_row(spark):
    """Rows that repeat an id are candidates of their own; k = 5 of eight equal ones can be among the best."""
    r = random.Random(6)
    rows = [(i % 90, [r.choice([-1.0, 0.5, 0.25, 3.0]) for _ in range(4)]) for i in range(300) if i < 90 or i % 90 % 50]
    rows += [(7, [3.0, 3.0, 3.0, 3.0])] * 8 + [(7, [3.0, 3.0, 3.0, 0.5])] * 2
    ask = {i: v for i, v in rows if i % 50 == 0}
    want = []
    for i, x in ask.items():
        scored = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(x, y, strict=True)), j) for j, y in rows if j != i)
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert result(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def ranks(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe(odd, small):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks("byte_bpe_multi_50k.tiktoken"), special_tokens={})
    rows = [x for x in odd[0] if not (x[1] or "").startswith("   ")]
    df = odd[1].where("text IS NULL OR text NOT LIKE '   %'")
    got = bpe.bpe_decode(bpe.bpe_encode(df, path, public_tokenizers.PATTERN), path).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(((i, own.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in rows)
    spaces = bpe.bpe_decode(bpe.bpe_encode(odd[1].where("text LIKE '   %'"), path, public_tokenizers.PATTERN), path).collect()
    assert [bytes(r.decoded).decode() for r in spaces] == [ODD[9]]

    spark = odd[1].sparkSession
    want = []
    for i, t in small:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), brute.sha(t or "")))
    assert result(entry.queries()["op2_byte_bpe"](spark, FOLDER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_trees_agree():
    table = bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(2)
    for wide in (2, 4, 8, 16, 32, 64):
        some = [bytes(r.choice(b"aabeehht in\xc3\xa9") for _ in range(r.randint(1, wide))) for _ in range(200)]
        ids, sizes = table.merge_many(some, wide)
        want = [table.merge_one(p) for p in some]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def random_documents(seed, n=150):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.randint(1, 60))] for _ in range(12)]
    common = [f"c{i}" for i in range(20)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(["x", "y", "z", "Q"]) + str(r.randint(0, 3))
        if r.random() < 0.5:
            words += common
        rows.append((i * 3 + 1, r.choice([" ", "\n"]).join(words)))
    return [*rows, (5000, None), (5001, ""), (5002, "Few words"), (5003, "few WORDS"), (5004, rows[0][1].upper()), (rows[3][0], rows[3][1])]


def test_only_the_first_shared_tokens_make_rows(spark):
    """Two sets of 396 link only if one of the first 57 places is shared, so later ones are not paired."""
    odd = [f"0L AS odd{i}" for i in range(jaccard_join.SKETCH)]
    sets = spark.range(99).selectExpr("id AS token", "explode(array(1L, 2L)) AS id", "int(token) AS place")
    for need, rows in ((1, 57), (4, 60)):
        tokens = sets.selectExpr("*", "396 AS n", f"{need} AS need", "id AS group", "2L AS largest", "place AS alive", *odd)
        assert jaccard_join._meeting(tokens).count() == rows


@pytest.mark.parametrize("most_common", [jaccard_join.MOST_COMMON, 10])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed, most_common):
    rows = random_documents(seed)
    got = jaccard_join.jaccard_groups(table(spark, rows), most_common=most_common)
    assert result(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=repr)


def test_jaccard_odd(odd):
    got = result(jaccard_join.jaccard_groups(odd[1]), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard(odd[0]), key=repr)


def test_jaccard_bounds():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 2**63, k, np.uint64)) for k in r.integers(1, 300, 2))
        b = np.unique(np.concatenate([b, r.choice(a, r.integers(0, len(a) + 1), replace=False)]))
        overlap = len(np.intersect1d(a, b))
        assert jaccard_join.most_overlap(len(a), jaccard_join.signature(a), len(b), jaccard_join.signature(b)) >= overlap


def packed(df):
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr), len(by), sum(r.length for r in rows)


def test_packing(odd, small):
    spark = odd[1].sparkSession
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, _, _ = packed(packing.best_fit_packing(odd[1], path, public_tokenizers.PATTERN, task_pieces=7))
    assert got == sorted(brute.pieces(odd[0], tokenizer), key=repr)
    got, sequences, tokens = packed(entry.queries()["op7_best_fit_packing"](spark, FOLDER))
    assert got == sorted(brute.pieces(small, tokenizer), key=repr)
    assert sequences <= 1.05 * tokens / 1024 + 1


def test_open_bins():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (4, 7, 3, 6, 5, 5)] == [(0, 0), (1, 0), (1, 7), (0, 4), (2, 0), (2, 5)]
    bins = packing.OpenBins(10, 1)
    assert [bins.place(n) for n in (4, 7, 6)] == [(0, 0), (1, 0), (2, 0)]


def rated(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))


def test_quality_held_out(spark):
    """Fit on half of the labelled rows, judge on the other half."""
    folder = "/root/testdata/sf0.1"
    docs, graded = spark.read.parquet(f"{folder}/documents.parquet"), rated(spark, folder)
    half = F.xxhash64("doc_id", F.lit(9)) % 2 == 0
    model = quality.fit(docs, graded.where(half))
    got = quality.grade_documents(docs, model).join(graded.where(~half), "doc_id")
    stats = {r.grade: (r.n, r.kept) for r in got.groupBy("grade").agg(F.count("*").alias("n"), F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert stats[2][1] > 0.97 and stats[0][1] < 0.1 and stats[1][1] < 0.75
    tails = quality.grade_documents(docs, model).where("tail_2 > tail_1 OR abs(expected_grade - tail_1 - tail_2) > 1e-9")
    assert tails.count() == 0


def test_quality_odd(spark, odd):
    rows, df = odd
    graded = spark.createDataFrame([(i, i % 3) for i in range(18)] + [(0, 2), (None, 1), (77, None)], "doc_id long, grade int")
    model = quality.fit(df, graded)
    got = quality.grade_documents(df, model)
    assert got.count() == len(rows)
    assert quality.good_documents(df, model).columns == df.columns
    assert quality.good_documents(df, model).count() == got.where("keep").count()
    untaught = quality.fit(df, graded.where("grade = 1"))
    assert quality.grade_documents(df, untaught).where("keep").count() == len(rows)
    assert quality.good_documents(df, untaught).count() == len(rows)
    assert quality.fit(df, graded.where("false")).thresholds.size == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.bpe_encode(df, path, public_tokenizers.PATTERN)
    for out in (
        exact_dedup.exact_dedup(df),
        sharding.interleaved_shards(df),
        secrets.scan_secrets(df),
        secrets.redact_secrets(df),
        jaccard_join.jaccard_groups(df),
        bpe.digests(bpe.bpe_decode(encoded, path)),
        packing.best_fit_packing(df, path, public_tokenizers.PATTERN),
        quality.grade_documents(df, quality.Model()),
        topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.count() == 0


def test_parquet_rows_are_bounded_only_meanwhile(spark):
    from keepsift.llm.common import reader_rows

    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with reader_rows(spark, 512):
        assert spark.conf.get(key) == "512"
        with reader_rows(spark, 1000):
            assert spark.conf.get(key) == "512"
        assert spark.conf.get(key) == "512"
        with pytest.raises(ZeroDivisionError), reader_rows(spark, 100):
            1 / 0  # noqa: B018
        assert spark.conf.get(key) == "512"
    assert spark.conf.get(key) == before


def test_batches_are_bounded_only_meanwhile(spark):
    from keepsift.llm.common import batch_bytes

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    with batch_bytes(spark, 100_000):
        most = rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert most < 110 and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), batch_bytes(spark, 100_000):
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before
