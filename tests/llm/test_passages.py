"""Substring dedup and suffix-array dedup against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepsift.llm.passages import joined, repeated
from keepsift.llm.substring_dedup import substring_dedup
from keepsift.llm.suffix_dedup import extended, suffix_dedup


def brute(texts, k):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    windows = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if windows[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def random_texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "b", "cc", "dé", "ee e", "f\x01", "g", "h"]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(3, 30))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(passages) if r.random() < 0.4 else r.choice([" ", "\n", "\t "]).join(r.choices(vocabulary, k=r.randint(1, 20))))
        texts.append(r.choice([" ", "  \n"]).join(parts))
    return [*texts, texts[0], texts[1] + " ", None, "", "a " * 40, ("x y z " * 30).strip(), "b " * 40]


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [50_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_substring(spark, seed, hot):
    texts = random_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rows_of(substring_dedup(df, window=7, minimiser=2, hot_runs=hot))
    assert got == [(i, *x) for i, x in enumerate(brute(texts, 7))]


@pytest.mark.parametrize("hot", [50_000, 2])
@pytest.mark.parametrize("seed", [3, 4])
def test_suffix(spark, seed, hot):
    texts = random_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rows_of(suffix_dedup(df, passage=10, select=2, suffix=4, hot_runs=hot))
    assert got == [(i, *x) for i, x in enumerate(brute(texts, 10))]


@pytest.mark.parametrize("period", [16, 17, 18, 19])
def test_sentences_repeated_back_to_back(spark, period):
    """Copies of a short sentence in one text overlap one another within the words of a suffix."""
    texts = []
    for i in range(60):
        sentence = [f"s{i}_{j}" for j in range(period)]
        before, after = ([f"{side}{i}_{j}" for j in range(30)] for side in "ba")
        texts.append(" ".join([*before, *(sentence * 4)[: period * 4 - i % 2 * (period // 2)], *after]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute(texts, 50)
    # 64 words of period 16 hold no window of 50 twice; 68 of period 17 do.
    assert any(x[1] for x in want) == (period > 16)
    assert rows_of(suffix_dedup(df)) == [(i, *x) for i, x in enumerate(want)]


def test_repeated_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "x"), (1, long, "y"), (None, long + " tail", "z"), (None, "short", None), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumn("runs", F.lit(1))
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [(0, 1, 0), (0, 41, 40), (1, 40, 40), (1, 40, 40), (2, 0, 0)]


SETTINGS = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"


@pytest.fixture(params=[("true", "4"), ("false", "16")])
def partitions(spark, request):
    """Few partitions that are merged, and more of them than keys, so that some stay empty."""
    before = [spark.conf.get(s) for s in SETTINGS]
    for s, v in zip(SETTINGS, request.param, strict=True):
        spark.conf.set(s, v)
    yield
    for s, v in zip(SETTINGS, before, strict=True):
        spark.conf.set(s, v)


OPERATORS = [(substring_dedup, 35), (suffix_dedup, 50)]


@pytest.mark.parametrize("operator, k", OPERATORS)
def test_two_equal_documents_alone(spark, partitions, operator, k):
    text = " ".join(f"w{i}" for i in range(60))
    for texts in ([text, text], [text, text, "short one"], [text, "short one"], [text]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        assert rows_of(operator(df)) == [(i, *x) for i, x in enumerate(brute(texts, k))]


@pytest.mark.parametrize("operator, k", OPERATORS)
def test_odd_rows(spark, operator, k):
    """NULL and repeated ids, columns named like those of the operator, a text of a million words."""
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(r.choices([f"v{i}" for i in range(5000)], k=500_000) + [passage] + r.choices([f"v{i}" for i in range(5000)], k=500_000))
    rows = [(1, passage, "x"), (1, passage, "y"), (None, passage + " tail", "z"), (None, "short", None), (2, None, None), (3, "", "e"), (4, long, "l")]
    rows += [(5, "same " * 3000, "s"), (6, "a b c " * 1000, "s")]
    columns = "runs key start windows lead weight hot head tail begin end window intervals total"
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").select("*", *[F.lit(1).alias(c) for c in columns.split()])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in operator(df.repartition(3)).collect()]
    want = [(x[0], *y) for x, y in zip(rows, brute([x[1] for x in rows], k), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffixes_in_memory():
    """What the bucket of a key finds, against all windows of its strings."""
    r = random.Random(11)
    for _ in range(400):
        k, suffix = r.choice([(8, 3), (6, 6), (10, 4), (5, 1)])
        first = r.choices("ab", k=suffix)
        rows = []
        for i in range(r.randint(0, 12)):
            head = r.choices("ab", k=r.randint(0, k - suffix))
            tail = first + (r.choices("ab", k=r.randint(0, 12)) if r.random() < 0.7 else first * 2)
            rows.append((i, 0, 0, " ".join(head).encode(), " ".join(tail).encode()))
        texts = [joined(x[3], x[4]).decode().split() for x in rows]
        # Windows that hold the first words at a place from the tail's beginning on, as those of the bucket's runs do.
        places = []
        for x, t in zip(rows, texts, strict=True):
            h = len(x[3].split())
            held = [p for p in range(h, len(t) - suffix + 1) if t[p : p + suffix] == first]
            places.append({(p - n, n) for p in held for n in range(k - suffix + 1) if p - n >= 0 and p - n + k <= len(t)})
        counts = Counter((n, tuple(t[s : s + k])) for t, found in zip(texts, places, strict=True) for s, n in found)
        want = [{w for s, n in found if counts[n, tuple(t[s : s + k])] > 1 for w in range(s, s + k)} for t, found in zip(texts, places, strict=True)]
        got = [{w for s, e in spans for w in range(s, e)} for spans in extended(rows, k, suffix)]
        assert got == want
    assert extended([], 50, 20) == [] and repeated([], 50) == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).count() == 0 and suffix_dedup(df).count() == 0


def test_whole_table(spark):
    """The registered query over a whole small table."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for name, k in (("op1_substring_dedup", 35), ("op6_suffix_dedup", 50)):
        want = [(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], k))]
        assert rows_of(entry.queries()[name](spark, folder)) == want
        assert any(x[2] for x in want)
