"""Eviction, quota, attempts, plug-ins and streams with more than one batch."""

import random

import pytest
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.operators import inference as I
from keepsift.operators.caching import evict
from keepsift.operators.quota import TOLERANCE_US, quota_fold
from keepsift.operators.tiers import assign_tiers
from keepsift.streaming import live

HOUR = 3_600_000_000


@pytest.mark.parametrize("split", [10**6, 3])
def test_eviction_leaves_at_most_the_limit(spark, split):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"f{i % 5}", f"k{i:03d}", rnd.randint(1, 50), rnd.randint(0, 20)) for i in range(90)]
    df = spark.createDataFrame(rows, "folder string, cache_key string, size_bytes bigint, day int")
    df = df.withColumn("cached_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)"))
    now = F.lit("2024-01-22").cast("timestamp_ntz")
    out = evict(df, now, 15, 200, split_rows=split, **({"parts": 4} if split == 3 else {})).collect()
    by_folder = {}
    for r in out:
        by_folder.setdefault(r.folder, []).append(r)
    for entries in by_folder.values():
        left = [e for e in sorted(entries, key=lambda e: (e.cached_at, e.cache_key))]
        total = sum(e.size_bytes for e in left if e.reason != "age")
        for e in left:
            if e.reason == "age":
                assert e.day < 6
                continue
            assert (e.reason == "size") == (total > 200)
            if e.reason == "size":
                total -= e.size_bytes
        assert total <= 200


def fold(events):
    """One by one."""
    state, out = {}, {}
    for user, seq, ts, month, n, quota in sorted(events, key=lambda e: (e[0], e[1])):
        if quota is None:
            out[user, seq] = (True, None)
            continue
        m, c, last = state.get(user, (None, 0, None))
        if m != month:
            c, last = 0, None
        if last is not None and ts < last - TOLERANCE_US:
            out[user, seq] = (False, "CLOCK_TAMPER")
        elif c + n > quota:
            out[user, seq] = (False, "QUOTA_EXCEEDED")
        else:
            state[user] = (month, c + n, ts)
            out[user, seq] = (True, None)
    return out


def usage(seed, size=400):
    rnd = random.Random(seed)
    rows, ts = [], 0
    for i in range(size):
        ts += rnd.randint(0, HOUR // 2)
        shown = ts - rnd.choice([0, 0, 0, 0, HOUR // 2, 3 * HOUR])
        user = 1 if rnd.random() < 0.6 else rnd.randint(2, 4)
        month = f"2024-{1 + (shown // (40 * HOUR)) % 3:02d}"
        rows.append((user, i, shown, month, rnd.choice([1, 2, 5, 30, 70]), None if user == 4 else 60))
    return rows


USAGE = "user_id bigint, seq bigint, ts_us bigint, month_key string, n bigint, quota bigint"


@pytest.mark.parametrize("seed, split", [(1, 10**6), (2, 10**6), (3, 5), (4, 5)])
def test_quota_fold_equals_one_by_one(spark, seed, split):
    rows = usage(seed)
    got = quota_fold(spark.createDataFrame(rows, USAGE), split_rows=split, **({"parts": 4} if split == 5 else {}))
    out = {(r.user_id, r.seq): (r.success, r.error) for r in got.collect()}
    assert out == fold(rows)
    assert {"CLOCK_TAMPER", "QUOTA_EXCEEDED", None} == {e for _, e in out.values()}


def write_parts(spark, rows, schema, path, parts):
    for i in range(parts):
        chunk = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)


def test_quota_over_several_batches(spark, tmp_path):
    rows = usage(9, 240)
    write_parts(spark, rows, USAGE, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = live.quota_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out/outcomes"))
    assert {(r.user_id, r.seq): (r.success, r.error) for r in got.collect()} == fold(rows)


SCORES = "session_id string, image_id string, total double, seq bigint, tokens_in bigint, tokens_out bigint"


def test_scores_arrive_in_batches(spark, tmp_path):
    rows = [("s", f"{i % 20:02d}", float(i), i, 1, None) for i in range(60)]
    write_parts(spark, rows, SCORES, str(tmp_path / "in"), 3)
    stream = live.read_scores(spark, str(tmp_path / "in"), SCORES, 1)
    seen = []
    q = live.retier_per_batch(stream, str(tmp_path / "log"), SCORES + ", _started bigint, _batch int", str(tmp_path / "ck"), lambda t, b: seen.append({r.image_id: (r.total, r.tier) for r in t.collect()}))
    q.awaitTermination()
    assert q.exception() is None and len(seen) == 3 and all(len(s) == 20 for s in seen)
    last = spark.createDataFrame([(f"{i % 20:02d}", float(i)) for i in range(40, 60)], "image_id string, total double")
    assert seen[-1] == {r.image_id: (r.total, r.tier) for r in assign_tiers(last).collect()}


def test_retry_policy():
    waits = []
    script = iter([I.Answer(429, retry_after=7), I.Answer(503), I.Answer(0), I.Answer(503), I.Answer(503), I.Answer(503)])
    got, retries, waited = I.ask(lambda r: next(script), {}, waits.append)
    assert (got.status, retries, waited) == (503, 5, 14) and waits == [7, 1, 0, 2, 4]


def test_failures_become_zero_rows(spark):
    def call(row):
        if row["filename"].startswith("slow"):
            return I.Answer(0)
        return I.Answer(200, '{"quality": 1}', 3, 1)

    df = spark.createDataFrame([("1", "slow.jpg"), ("2", "b.jpg")], "image_id string, filename string")
    general = dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["general"]))
    out = {r.image_id: r for r in I.batch_score(df, None, call, general, 2, sleep=lambda s: None).collect()}
    assert out["1"].reasoning == "Scoring failed: Request timed out twice" and out["1"].total == 0 and out["1"].tier == "rejected"
    assert out["2"].failure == 'key "aesthetic" is missing or not a number' and out["2"].tokens_in == 0


@pytest.mark.parametrize(
    "name, check",
    [
        ("good_portrait.jpg", lambda r: r.total > 85),
        ("bad_blurry.jpg", lambda r: r.total < 30),
        ("landscape_mountain.jpg", lambda r: r.aesthetic >= 70),
        ("portrait_face.jpg", lambda r: r.faceEyes >= 80),
        ("random_photo_001.jpg", lambda r: r.quality == 60),
    ],
)
def test_name_scorer(spark, name, check):
    from keepsift.operators.joins import apply_weights

    df = spark.createDataFrame([("1", name)], "image_id string, filename string")
    assert check(apply_weights(I.name_scores(df), dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["general"]))).first())


def test_name_keywords(spark):
    words = spark.range(1).select(I.name_keywords(F.lit("wedding_groom.jpg"))).first()[0]
    assert "wedding" in words and "groom" in words


def test_refused_key_leaves_the_rest_unscored(spark):
    from keepsift.operators.joins import unscored_assets

    df = spark.createDataFrame([(f"{i:02d}", f"{i}.jpg") for i in range(6)], "image_id string, filename string").coalesce(1)
    general = dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["general"]))

    def call(row):
        return I.Answer(401) if row["image_id"] >= "01" else I.Answer(404)

    # One task, as a refusal now ends the calls of all tasks.
    scored = I.batch_score(df, None, call, general, concurrency=1, sleep=lambda s: None)
    assert [r.image_id for r in scored.collect()] == ["00"]
    assert unscored_assets(df, scored).count() == 5


def test_tags_fall_back_to_single_files_and_stop(spark):
    import json

    rows = [(f"{i}", f"{i}.jpg", 100.0 - i, "S") for i in range(5)]
    df = spark.createDataFrame(rows, "image_id string, filename string, total double, tier string")

    def call(row):
        names = [i["filename"] for i in row["items"]]
        if len(names) > 1:
            return I.Answer(400, "one file only")
        return I.Answer(200, json.dumps({names[0]: ["tag"]}))

    assert I.batch_tag(df, call, 100, sleep=lambda s: None).count() == 5
    for status in (401, 429):
        assert I.batch_tag(df, lambda row, s=status: I.Answer(s), 100, sleep=lambda s: None).count() == 0


def test_two_streams_share_a_log(spark, tmp_path):
    schema = SCORES + ", _started bigint, _batch int"
    for i in range(2):
        source = str(tmp_path / f"in{i}")
        spark.createDataFrame([("s", f"{i}", float(i), i, 1, None)], SCORES).write.parquet(source)
        q = live.score_stream(spark.readStream.schema(SCORES).parquet(source), str(tmp_path / "log"), str(tmp_path / f"ck{i}"))
        q.awaitTermination()
        assert q.exception() is None
    assert {r.image_id for r in live.stored_scores(spark, str(tmp_path / "log"), schema).collect()} == {"0", "1"}


def test_late_event_meets_the_record(spark, tmp_path):
    for i, row in enumerate([(1, 10, 1000, "2024-01", 500, 500), (1, 5, 1000, "2024-01", 400, 500), (2, 1, 1000, "2024-01", 3, 500)]):
        spark.createDataFrame([row], USAGE).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
        stream = spark.readStream.schema(USAGE).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = live.quota_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out/outcomes")).collect()
    assert {(r.user_id, r.seq): r.error for r in got} == {(1, 10): None, (1, 5): "QUOTA_EXCEEDED", (2, 1): None}
    last = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out/records")).where("_batch = 2")
    assert {(r.user_id, r.n) for r in last.collect()} == {(1, 500), (2, 3)}


def test_first_scores_never_count_twice(spark, tmp_path):
    for i in range(3):
        rows = [("s", "a", i), ("s", f"{i}", i)]
        spark.createDataFrame(rows, "session_id string, image_id string, seq int").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
        stream = spark.readStream.schema("session_id string, image_id string, seq int").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = live.first_scores(stream, str(tmp_path / "log"), str(tmp_path / f"ck{i // 2}"))
        q.awaitTermination()
        assert q.exception() is None
    got = [r.image_id for r in spark.read.parquet(str(tmp_path / "log")).collect()]
    assert sorted(got) == ["0", "1", "2", "a"]


def test_quota_stream_orders_shuffled_rows(spark, tmp_path):
    rows = usage(4, 200)
    spark.createDataFrame(rows[::-1], USAGE).coalesce(1).write.parquet(str(tmp_path / "in"))
    live.use_state_store(spark)
    stream = spark.readStream.schema(USAGE).parquet(str(tmp_path / "in"))
    out = []
    q = live.quota_stream(stream).writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.seq): (r.success, r.error) for r in out} == fold(rows)


def test_face_limit_rows_keep_their_tier(spark):
    df = spark.createDataFrame([("1", 0.0, "A", True), ("2", 0.0, None, True), ("3", 90.0, None, False)], "image_id string, total double, tier string, exceeds_face_limit boolean")
    assert {r.image_id: r.tier for r in assign_tiers(df).collect()} == {"1": "A", "2": "rejected", "3": "S"}


def test_failed_detection_has_no_faces(spark):
    from keepsift.operators.rollups import face_rollup

    faces = spark.createDataFrame([("1", None, None, None, "broke"), ("2", 0.9, 0.1, "happy", None)], "image_id string, left_open double, right_open double, emotion string, error string")
    got = {r.image_id: r for r in face_rollup(spark.createDataFrame([("1",), ("2",)], "image_id string"), faces, 1).collect()}
    assert (got["1"].has_faces, got["1"].face_count, got["1"].eyes_open, got["1"].face_error) == (False, 0, True, "broke")
    assert got["2"].face_count == 1 and got["2"].face_error is None


def test_clearing_a_session_removes_what_came_before(spark):
    from keepsift.operators.sets import session_state

    rows = [("a", 1, "context", "old"), ("a", 2, "cleared", None), ("a", 3, "status", "running"), ("b", 1, "status", "x"), ("b", 2, "cleared", None)]
    got = session_state(spark.createDataFrame(rows, "session_id string, seq bigint, field string, value string")).collect()
    assert [(r.session_id, r.status, r.context) for r in got] == [("a", "running", None)]


def test_run_folder_is_removed(spark):
    import os

    from keepsift.session import run_folder, store

    with run_folder(spark) as path:
        with run_folder(spark) as inner:
            assert store(spark.range(3), "x").inputFiles()[0].count(inner) == 1
        assert not os.path.exists(inner)
        assert path in store(spark.range(3), "x").inputFiles()[0]
    assert not os.path.exists(path) and path not in store(spark.range(1), "x").inputFiles()[0]


def _retier_run(spark, tmp_path, batches, **kw):
    """Feed batches of rows one by one; what each handed on."""
    from keepsift.streaming.retier import retier_changes

    schema = "session_id string, image_id string, total double, seq bigint, exceeds_face_limit boolean, tier string"
    live.use_state_store(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{i:03d}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    given = []
    q = retier_changes(stream, str(tmp_path / "state"), str(tmp_path / "ck"), lambda df, n: given.append((n, df.collect())), **kw)
    q.awaitTermination()
    assert q.exception() is None
    return given, schema


def test_retier_changes_equals_tiers_of_all(spark, tmp_path):
    import random

    rnd = random.Random(5)
    batches = []
    for b in range(8):
        rows = {}
        for j in range(60):  # ties, new scores of old assets, rows over the limit, an asset twice in a batch
            i = rnd.randrange(200)
            rows[j] = (f"s{i % 3 // 2}", f"{i:03d}", float(rnd.choice([20, 50, 50, 50, rnd.randrange(101)])), b * 100 + j, rnd.random() < 0.05, rnd.choice([None, "B"]))
        batches.append(list(rows.values()))
    given, schema = _retier_run(spark, tmp_path, batches, by=["session_id"], piece_rows=10)
    assert [n for n, _ in given] == list(range(8))
    tiers, seen = {}, {}
    # Files are read in the order in which they were written.
    for (_, changed), rows in zip(given, batches):
        for r in sorted(rows, key=lambda r: r[3]):
            seen[r[:2]] = r
        assert len({(r.session_id, r.image_id) for r in changed}) == len(changed)
        tiers.update({(r.session_id, r.image_id): (r.total, r.tier) for r in changed})
        want = assign_tiers(spark.createDataFrame(list(seen.values()), schema), by=["session_id"]).collect()
        assert tiers == {(r.session_id, r.image_id): (r.total, r.tier) for r in want}


def test_retier_changes_reads_no_more_as_the_log_grows(spark, tmp_path):
    import json

    from keepsift.streaming import retier

    n, size = 20, 40
    batches = [[("s", f"{b:03d}{j:03d}", float((b * 7 + j * 13) % 100), j, False, None) for j in range(size)] for b in range(n)]
    given, schema = _retier_run(spark, tmp_path, batches, piece_rows=50)
    tiers = {r.image_id: r.tier for _, changed in given for r in changed}
    want = assign_tiers(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert tiers == {r.image_id: r.tier for r in want}
    run = next((tmp_path / "state").glob("run=*"))
    near = []
    for b in range(n):
        lines = [json.loads(x) for f in (run / f"batch={b}/state").glob("part-*") for x in f.read_text().splitlines()]
        pieces = sorted((p for p in lines if "cuts" not in p), key=lambda p: p["start"])
        state = retier._Pieces({"": [{**p, "start": tuple(p["start"])} for p in pieces]}, {})
        assert sum(p["n"] for p in pieces) == (b + 1) * size
        assert all(p["n"] <= 4 * 50 and len(p["paths"]) <= retier.PIECE_FILES + 1 for p in pieces)
        near.append(sum(p["n"] for p in state.touched(state.places())))
    # Three cuts, each in one piece, however many rows there are.
    assert max(near) <= 3 * 2 * 50 + 3 * size and max(len(c) for _, c in given) < 6 * size


def test_retier_changes_without_scores_or_totals(spark, tmp_path):
    given, _ = _retier_run(spark, tmp_path, [[("s", "a", None, 1, False, None), ("s", "b", float("nan"), 1, False, None), ("s", "c", 80.0, None, True, "A")]])
    assert {(r.image_id, r.tier) for r in given[0][1]} == {("a", "rejected"), ("b", "rejected"), ("c", "A")}
    given, _ = _retier_run(spark, tmp_path / "none", [[]])
    assert all(not rows for _, rows in given)
