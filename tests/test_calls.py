"""Deadlines, run-wide stops and answers that are never asked for twice."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepsift.functions import paths as P
from keepsift.operators import calls as C
from keepsift.operators import inference as I


def test_deadline_ends_the_process():
    def hang(x):
        while x == 3:
            time.sleep(60)
        return os.getpid(), x

    with C.Watched(hang, 0.5) as watched:
        first, x = watched(1)
        assert x == 1 and watched(2) == (first, 2) and first != os.getpid()
        begun = time.time()
        with pytest.raises(TimeoutError, match="timed out after 0.5 s"):
            watched(3)
        assert time.time() - begun < 5
        second, _ = watched(4)
        assert second != first
        with pytest.raises(ProcessLookupError):
            os.kill(first, 0)
    with pytest.raises(ProcessLookupError):
        os.kill(second, 0)


def test_errors_and_crashes():
    def fail(x):
        if x == 1:
            raise ValueError("bad picture")
        if x == 2:
            os._exit(7)
        return (lambda: None) if x == 3 else x

    with C.Watched(fail, 5) as watched:
        with pytest.raises(RuntimeError, match="bad picture"):
            watched(1)
        with pytest.raises(RuntimeError, match="ended its process"):
            watched(2)
        with pytest.raises(RuntimeError):  # a value that cannot be sent
            watched(3)
        assert watched(b"x" * 5_000_000) == b"x" * 5_000_000


def frames(n):
    yield pd.DataFrame({"k": range(n), "_no": range(1, n + 1), "_lane": [0] * n})


def run(tmp_path, n, call, stops=(401,)):
    return C.answered(frames(n), call, C.Journal(f"file://{tmp_path}/calls"), "round-0", lambda s: None, C.ask, stops, 5)


def test_a_repeated_task_asks_only_for_the_rest(tmp_path):
    asked = tmp_path / "asked"

    def call(row):
        with asked.open("a") as f:
            f.write(f"{row['k']}\n")
        if row["k"] == 6 and not (tmp_path / "lost").exists():
            (tmp_path / "lost").touch()
            raise OSError("the executor is lost")
        return C.Answer(200, f"é {row['k']}", 3, 1)

    with pytest.raises(RuntimeError, match="lost"):
        list(run(tmp_path, 10, call))
    (out,) = run(tmp_path, 10, call)
    assert asked.read_text().split() == [*map(str, range(7)), *map(str, range(6, 10))]
    assert out["body"].tolist() == [f"é {i}" for i in range(10)] and out["tokens_in"].tolist() == [3] * 10


def test_answers_of_a_lane_share_a_file(tmp_path):
    """Files grow with the attempts, not with the calls; a line that was cut off counts as not answered."""
    (first,) = run(tmp_path, 500, lambda row: C.Answer(200, f"{row['k']}\n"))
    (log,) = (tmp_path / "calls" / "round-0" / "0").iterdir()
    log.write_bytes(log.read_bytes()[:-3])
    asked = tmp_path / "asked"

    def call(row):
        with asked.open("a") as f:
            f.write(f"{row['k']}\n")
        return C.Answer(200, f"{row['k']}\n")

    (second,) = run(tmp_path, 500, call)
    assert asked.read_text().split() == ["499"] and second.equals(first)
    assert len(list((tmp_path / "calls" / "round-0" / "0").iterdir())) == 2


def test_a_stop_reaches_other_tasks(tmp_path):
    (first,) = run(tmp_path, 5, lambda row: C.Answer(401 if row["k"] == 2 else 200))
    assert first["status"].tolist() == [200, 200, 401, 401, 401]
    # Another task of the run, which would never have met the refusal.
    other = C.answered(frames(3), lambda row: C.Answer(200), C.Journal(f"file://{tmp_path}/calls"), "round-1", lambda s: None, C.ask, (401,), 5)
    assert next(other)["status"].tolist() == [401] * 3


def test_a_stop_that_is_made_while_it_is_looked_for(tmp_path):
    with C.Journal(f"file://{tmp_path}/calls") as journal:

        class Late:
            def get_file_info(self, place):
                journal.system = system
                journal.stop(401)
                raise FileNotFoundError(place.base_dir)

        system, journal.system = journal.system, Late()
        assert journal.stopped() == 401


def test_a_stop_ends_a_long_wait(tmp_path):
    with C.Journal(f"file://{tmp_path}/calls") as journal:
        waits = []

        def sleep(seconds):
            waits.append(seconds)
            journal.stop(401)

        (out,) = C.answered(frames(2), lambda row: C.Answer(429, retry_after=9), C.Journal(journal.uri), "round-0", sleep, C.ask, (401,), 5)
    assert out["status"].tolist() == [401, 401] and waits == [9]


def test_rounds(spark, tmp_path):
    """After a refusal no further round begins, and every row has a status."""
    df = spark.range(1000).withColumnRenamed("id", "k")
    log = str(tmp_path)

    def call(row):
        with open(f"{log}/{row['k']}", "x"):  # a second call for the same row would fail
            pass
        return C.Answer(401 if row["k"] == 150 else 200)

    out = C.batch_call(df, call, concurrency=4, sleep=lambda s: None, first_round=10)
    # Rounds of 40, 80 and 160 calls: the refusal lies in the third.
    counts = {r.status: r["count"] for r in out.groupBy("status").count().collect()}
    assert sum(counts.values()) == 1000 and set(counts) == {200, 401}
    assert 121 <= len(os.listdir(log)) <= 280 and len(os.listdir(log)) == counts[200] + 1
    assert out.where("status = 200 AND k >= 280").count() == 0 and out.where("status = 401 AND k < 120").count() == 0
    assert out.columns == ["k", *[f.name for f in C.ANSWER_FIELDS]]
    assert C.batch_call(df.where("false"), call).count() == 0


def test_slow_calls_at_regular_distances_are_spread(spark, tmp_path):
    """Every eighth of the rows is slow: no task gets them all."""
    log = str(tmp_path)

    def call(row):
        with open(f"{log}/{os.getppid()}-{row['k']}", "x"):
            return C.Answer(200)

    df = spark.range(800).withColumnRenamed("id", "k")
    assert C.batch_call(df, call, concurrency=8, sleep=lambda s: None).where("status = 200").count() == 800
    workers = {}
    for name in os.listdir(log):
        worker, k = map(int, name.split("-"))
        workers.setdefault(worker, []).append(k)
    assert max(sum(k % 8 == 3 for k in ks) for ks in workers.values()) < 40


def test_slow_lanes_are_shared(spark, tmp_path, monkeypatch):
    """Slow calls that meet in one lane by their numbers are taken by all, never more at a time than asked for."""
    monkeypatch.setattr(C, "PIECE_S", 0.01)
    lane = {r.no: r.lane for r in spark.range(1, 201).selectExpr("id AS no", "pmod(xxhash64(id), 2) AS lane").collect()}
    slow = {no - 1 for no in lane if no > 40 and lane[no] == 0}
    log = str(tmp_path)

    def call(row):
        begun = time.time()
        if row["k"] in slow:
            time.sleep(0.05)
        with open(f"{log}/{row['k']}", "x") as f:  # a second call for the same row would fail
            f.write(f"{os.getppid()} {begun} {time.time()}")
        return C.Answer(200, str(row["k"]))

    df = spark.range(200).withColumnRenamed("id", "k")
    out = C.batch_call(df, call, concurrency=2, sleep=lambda s: None, first_round=10).collect()
    assert sorted((r.k, r.status, r.body) for r in out) == [(k, 200, str(k)) for k in range(200)]
    made = {int(p.name): p.read_text().split() for p in tmp_path.iterdir()}
    workers = [made[k][0] for k in slow]
    assert len(slow) > 60 and max(map(workers.count, workers)) < 0.8 * len(slow)
    ends = sorted([(float(b), 1) for _, b, _ in made.values()] + [(float(e), -1) for _, _, e in made.values()])
    at_once = [sum(x for _, x in ends[: i + 1]) for i in range(len(ends))]
    assert len(made) == 200 and max(at_once) == 2


def test_hanging_detector(spark):
    def detect(content):
        if content == b"kill":
            os._exit(1)
        while content == b"hang":
            time.sleep(60)
        return [{"left_open": 0.5}]

    rows = [(str(i), c, 100, 100) for i, c in enumerate([b"ok", b"hang", b"ok", b"kill", b"ok"])]
    df = spark.createDataFrame(rows, "image_id string, content binary, width int, height int").coalesce(1)
    got = {r.image_id: r.error for r in I.detect_faces(df, detect, limit_s=1).collect()}
    assert got == {"0": None, "1": "timed out after 1 s", "2": None, "3": "the plug-in ended its process", "4": None}


def test_hanging_detectors_do_not_wait_for_one_another(spark):
    def detect(content):
        while content.startswith(b"hang"):
            time.sleep(60)
        if content == b"odd":
            return [{"left_open": float(os.getpid())}, 7]
        return [{"left_open": float(os.getpid()), "box": {"x": 1, "y": 2}}]

    contents = [b"ok", b"hang1", b"ok", b"hang2", None, b"hang3", b"odd", *[b"ok"] * 30]
    rows = [(str(i), c, 100, 100) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "image_id string, content binary, width int, height int").coalesce(1)
    begun = time.time()
    got = I.detect_faces(df, detect, limit_s=6).collect()
    assert time.time() - begun < 14  # one after the other they would take 18 s
    errors = {r.image_id: r.error for r in got if r.error}
    late = "timed out after 6 s"
    assert errors == {"1": late, "3": late, "5": late, "4": "cannot convert 'NoneType' object to bytes", "6": "'int' object has no attribute 'get'"}
    assert [r.image_id for r in got] == [*map(str, range(7)), "6", *map(str, range(7, 37))]
    assert {r.box for r in got if r.image_id == "0"} == {(1.0, 2.0, None, None)}
    # Quick detectors keep to one process.
    calm = I.detect_faces(df.where("content = 'ok'"), detect, limit_s=6).collect()
    assert len({r.left_open for r in calm}) == 1


def test_globs_ignore_case_beyond_ascii(spark):
    names = ["été.jpg", "ÉTÉ 2.jpg", "Straße.png", "ete.jpg", "ФОТО.jpg", "фото 2.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for pattern, want in (("ÉTÉ*", names[:2]), ("été*", names[:2]), ("фото*", names[4:]), ("[É]t*", names[:2])):
        got = df.where(F.col("path").rlike(P.glob_to_regex(pattern))).collect()
        assert [r.path for r in got] == want, pattern
