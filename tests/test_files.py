"""Listings, headers, sessions, sidecars and copies on real folders."""

import json
import struct
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.operators.naming import dedupe_filenames, export_keepers
from keepsift.operators.tiers import assign_tiers
from keepsift.plans import registry
from keepsift.session import work_dir
from keepsift.sinks import exports as X
from keepsift.sources import listing as L
from keepsift.sources import sessions as S


@pytest.fixture
def shoot(tmp_path):
    for name in (
        "IMG_001.jpg", "IMG_002.CR3", "DSC_003.png", "README.txt", ".DS_Store", "Thumbs.db", "_MG_004.jpg",
        "a/IMG_005.jpg", "a/b/IMG_006.nef", "c/x.jpg", ".hidden/y.jpg", "node_modules/z.jpg", "empty/deep/w.png",
    ):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 10)
    return str(tmp_path)


def names(df):
    return sorted(r.filename for r in df.select("filename").collect())


def test_scan(spark, shoot):
    files = L.list_files(spark, shoot)
    assert names(L.scan_assets(files)) == ["DSC_003.png", "IMG_001.jpg", "IMG_002.CR3", "_MG_004.jpg"]
    assert names(L.scan_assets(files, [".cr3"])) == ["IMG_002.CR3"]
    assert names(L.scan_assets(files, prefixes=["img_"])) == ["IMG_001.jpg", "IMG_002.CR3"]
    assert names(L.scan_assets(files, prefixes=["img_"], any_case=False)) == []
    assert names(L.scan_assets(files, ignore=["*.png", "a/*"], recursive=True)) == [
        "IMG_001.jpg", "IMG_002.CR3", "IMG_006.nef", "_MG_004.jpg", "x.jpg", "z.jpg",
    ]
    assert "z.jpg" not in names(L.list_all_files(files))
    ordered = [r.filename for r in L.scan_assets(files, ordered=True).collect()]
    assert ordered == ["_MG_004.jpg", "DSC_003.png", "IMG_001.jpg", "IMG_002.CR3"]


def test_walk(spark, shoot):
    got = sorted(r.folder for r in L.walk_folders(L.list_files(spark, shoot)).collect())
    assert got == ["", "a", "a/b", "c", "empty/deep"]


def test_load_and_dimensions(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"rest"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc4\x00\x04cd" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 200) + b"0" * 12
    for n, data in (("a.png", png), ("b.jpg", jpeg), ("c.jpg", b"\xff\xd8"), ("d.jpg", b"nothing")):
        (tmp_path / n).write_bytes(data)
    files = L.list_files(spark, str(tmp_path))
    gone = spark.createDataFrame([(str(tmp_path / "e.jpg"), 1, 1)], "path string, length bigint, modified_us bigint")
    good, bad = L.load_assets(files.unionByName(L.from_manifest(gone, str(tmp_path))))
    got = {r.filename: (r.width, r.height) for r in good.collect()}
    assert got == {"a.png": (640, 480), "b.jpg": (200, 300), "c.jpg": (0, 0), "d.jpg": (0, 0)}
    assert names(bad) == ["e.jpg"] and "FileNotFound" in bad.first().error


def test_files_leave_a_task_in_pieces(spark, tmp_path):
    """Small files go on together, in their order, large ones alone; each of the two results has only its own rows."""
    sizes = [10] * 30 + [3_000_000, 3_000_000, 5_000_000] + [10] * 2000
    for i, n in enumerate(sizes):
        if i % 50 != 7:
            (tmp_path / f"{i}.jpg").write_bytes(b"%d" % (i % 10) * n)
    files = spark.createDataFrame([(str(tmp_path / f"{i}.jpg"), i) for i in range(len(sizes))], "path string, i long").coalesce(1)
    for good, bad in ((True, True), (True, False), (False, True)):
        read = L.read_contents(files, good, bad)
        got = read.select("i", F.length("content").alias("n"), "error").collect()
        want = [i for i in range(len(sizes)) if (bad if i % 50 == 7 else good)]
        assert [r.i for r in got] == want
        assert all((r.n is None and "FileNotFound" in r.error) if r.i % 50 == 7 else (r.n == sizes[r.i] and r.error is None) for r in got)


def test_ignore_file(spark, tmp_path):
    p = tmp_path / "ignore.txt"
    p.write_text("# note\n\n *.tmp \nraw/**\n")
    assert [r.pattern for r in L.read_ignore_file(spark, str(p)).collect()] == ["*.tmp", "raw/**"]


def session_doc(sid, n):
    score = {"filename": "a.jpg", "scores": dict.fromkeys(K.DIMENSIONS, 50), "total": 50.0, "tier": "B", "reasoning": "ok", "usage": {"inputTokens": 8, "outputTokens": 2}}
    return {"sessionId": sid, "totalImages": n, "scoredCount": n, "status": "running", "scores": {f"id{i}": score for i in range(n)}}


def test_sessions_fall_back_to_backup(spark, tmp_path):
    for d, main, backup in (("one", json.dumps(session_doc("s1", 2), indent=1), json.dumps(session_doc("old", 9))), ("two", "{broken", json.dumps(session_doc("s2", 3)))):
        (tmp_path / d).mkdir()
        (tmp_path / d / "session.json").write_text(main)
        (tmp_path / d / "session.backup.json").write_text(backup)
    found = S.read_session(spark, str(tmp_path))
    assert sorted(r.sessionId for r in found.collect()) == ["s1", "s2"]
    rows = S.session_scores(found)
    assert rows.count() == 5 and rows.first().tokens_in == 8


def scored(spark, root):
    rows = [(f"{i:x}", f"{root}/f{i % 2}/n{i // 2}.jpg", f"n{i // 2}.jpg", 90.0 - i, 'say "hi" & <bye>', ["x & y"] if i else None) for i in range(6)]
    df = spark.createDataFrame(rows, "image_id string, path string, filename string, total double, reasoning string, keywords array<string>")
    return assign_tiers(df.withColumns({d: F.lit(50) for d in K.DIMENSIONS}))


def test_sidecars_are_written(spark, tmp_path):
    (tmp_path / "f0").mkdir(), (tmp_path / "f1").mkdir()
    s = scored(spark, str(tmp_path))
    docs = X.sidecars(s, s.where("image_id <> '5'"))
    result = {r.image_id: (r.written, r.error) for r in X.write_sidecars(docs).collect()}
    assert sum(w for w, _ in result.values()) == 5 and result["5"] == (False, "no path for this asset")
    text = (tmp_path / "f0" / "n0.xmp").read_text("utf-8")
    assert "<xmp:Rating>5</xmp:Rating>" in text and "<xmp:Label>Green</xmp:Label>" in text
    assert "say &quot;hi&quot; &amp; &lt;bye&gt;" in text and "dc:subject" not in text
    assert "<rdf:li>x &amp; y</rdf:li>" in (tmp_path / "f1" / "n0.xmp").read_text("utf-8")


def test_copy_plan_is_carried_out(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    s = scored(spark, str(src))
    for r in s.collect():
        p = src / r.path[len(str(src)) + 1 :]
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(r.image_id)
    plan = export_keepers(s, str(src), str(out), preserve=False)
    assert all(r.copied for r in X.copy_files(plan).collect())
    assert sorted(p.name for p in out.iterdir()) == ["n0.jpg", "n0_1.jpg", "n1.jpg"]
    mirrored = export_keepers(s, str(src), str(out), preserve=True)
    assert sorted(r.dest_path for r in mirrored.collect())[0] == f"{out}/f0/n0.jpg"


def test_reports(spark, tmp_path):
    s = scored(spark, "/r").withColumns({"has_faces": F.lit(None).cast("boolean"), "face_count": F.lit(None).cast("int"), "eyes_open": F.lit(None).cast("boolean"), "blink_detected": F.lit(None).cast("boolean")})
    X.export_results_json(s, str(tmp_path / "json"))
    rows = [json.loads(line) for p in sorted((tmp_path / "json").glob("part-*")) for line in p.read_text().splitlines()]
    assert [r["tier"] for r in rows] == ["S", "A", "A", "B", "B", "rejected"]
    assert rows[0]["keywords"] == [] and rows[0]["faces"] is None and "image_id" not in rows[0]
    X.export_results_csv(s, str(tmp_path / "csv"))
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = text.splitlines()
    assert lines[0].startswith("﻿Filename,Tier,Total Score") and len(lines) == 7
    assert lines[1] == 'n0.jpg,S,90.00,50,50,50,50,50,50,,"say ""hi"" & <bye>"'


def copy_one_by_one(files, existing):
    """First owners of a name are copied first, then the other files by path."""
    taken, out = set(existing), {}
    owners = {}
    for path, name in sorted(files):
        owners.setdefault(name, path)
    for name, path in owners.items():
        if name not in taken:
            out[path] = name
    taken |= set(out.values())
    for path, name in sorted(files):
        if path in out:
            continue
        base, dot, ext = name.rpartition(".")
        n = 1
        while f"{base}_{n}.{ext}" in taken:
            n += 1
        out[path] = f"{base}_{n}.{ext}"
        taken.add(out[path])
    return out


@pytest.mark.parametrize("split", [10**6, 2])
def test_names_equal_copying_one_by_one(spark, split):
    files = [(f"/d{i:02d}/{n}", n) for i, n in enumerate(["a.jpg"] * 9 + ["a_1.jpg"] * 3 + ["a_3.jpg", "a_1_1.jpg", "b.png", "b.png", "a_01.jpg", "a_2.png"])]
    existing = ["a.jpg", "a_5.jpg", "b_2.png", "c.jpg"]
    df = spark.createDataFrame(files, "path string, filename string")
    got = dedupe_filenames(df, spark.createDataFrame([(e,) for e in existing], "filename string"), split_rows=split, **({"parts": 4} if split == 2 else {}))
    out = {r.path: r.out_name for r in got.collect()}
    assert out == copy_one_by_one(files, existing)
    assert len(set(out.values()) | set(existing)) == len(files) + len(existing)


def test_profiles_and_history(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"id": "1", "name": "n", "genre": "event", "weights": dict.fromkeys(K.DIMENSIONS, 10)}) + "\n")
    (tmp_path / "h.json").write_text(json.dumps({"sessionId": "s", "imageCount": 3, "topScore": 91.5}) + "\n")
    assert S.read_profiles(spark, str(tmp_path / "p.json")).first().weights.quality == 10
    assert S.read_history(spark, str(tmp_path / "h.json")).first().topScore == 91.5


def stored(spark, d, name):
    """The rows of a registered query and the folder that it wrote."""
    before = set(Path(work_dir(spark)).glob("files-*"))
    rows = registry.QUERIES[name](spark, str(d)).collect()
    (root,) = set(Path(work_dir(spark)).glob("files-*")) - before
    return rows, root


def test_stored_sessions_are_bounded(spark, tmp_path):
    registry.load()
    ids = [*range(3500), 7, 7, 3000, None, None]
    docs = [(i, "a") for i in ids] + [(i, "b") for i in range(3500, 3510)]
    spark.createDataFrame(docs, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows, root = stored(spark, tmp_path, "read_session")
    want = [(s, None if i is None else str(i), None if i is None else float(i % 101)) for i, s in docs]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    sizes = [len(json.loads(p.read_text()).get("scores", ())) for p in root.rglob("*.json") if p.read_text() != "{broken"]
    assert sum(sizes) == len(docs) and max(sizes) < 1300


def test_stored_assets_are_spread(spark, tmp_path):
    registry.load()
    docs = [(i, f"text {i}") for i in range(2500)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows, root = stored(spark, tmp_path, "load_assets")
    assert sorted(r.doc_id for r in rows) == list(range(2500)) and sum(r.loaded for r in rows) == 2450
    held = Counter(p.parent for p in root.rglob("*.jpg"))
    assert len(held) == 3 and max(held.values()) <= 1000
