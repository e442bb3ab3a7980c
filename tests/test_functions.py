"""Literal cases of the column functions."""

import json

import pytest
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import fingerprints as H
from keepsift.functions import numbers as N
from keepsift.functions import paths as P
from keepsift.functions import text as X


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lit_weights(values):
    return lambda d: F.lit(float(values[K.DIMENSIONS.index(d)]))


@pytest.mark.parametrize("genre", list(K.GENRE_PRESETS))
def test_presets_sum_to_100(genre):
    assert sum(K.GENRE_PRESETS[genre]) == 100


def test_preset_face_weights():
    face = {g: w[5] for g, w in K.GENRE_PRESETS.items()}
    assert face["landscape"] == 0 and face["portrait"] == max(face.values())


def test_weighted_total(spark):
    w = lit_weights(K.GENRE_PRESETS["general"])
    got = one(spark, *[N.weighted_total(lit_weights(s), w) for s in ((95, 93, 90, 92, 91, 96), (0,) * 6, (100,) * 6)])
    assert got == (93.15, 0.0, 100.0)


def test_js_round_is_half_up_on_the_double(spark):
    got = one(spark, *[N.js_round(F.lit(x), d) for x, d in ((1.005, 2), (-2.5, 0), (2.5, 0), (0.49999999999999994, 0), (1.25, 1))])
    assert got == (1.0, -2, 3, 0, 1.3)


def test_hamming(spark):
    got = one(
        spark,
        H.hamming_hex(F.lit("00"), F.lit("01")),
        H.hamming_hex(F.lit("aabbccdd"), F.lit("aabbccdd")),
        H.hamming_hex(F.lit("ff"), F.lit("ff01")),
        H.hamming_hex(F.lit("f"), F.lit("ff")),
        H.to_hex(H.from_hex(F.lit("deadbeefdeadbeef"))),
    )
    assert got == (1, 0, 1, 4, "deadbeefdeadbeef")


def test_paths(spark):
    got = one(
        spark,
        P.sidecar_path(F.lit("/photos/wedding/IMG_001.CR3")),
        P.extension(F.lit(".gitignore")),
        P.extension(F.lit("a/b.tar.gz")),
        P.file_url(F.lit("/out/a b#1?.jpg")),
        P.folder_relationship(F.lit("/A/b"), F.lit("/a/B/")),
        P.folder_relationship(F.lit("/a"), F.lit("/ab")),
        P.last_segment(F.lit("C:\\a\\b\\")),
    )
    assert got == (
        "/photos/wedding/IMG_001.xmp", "", ".gz", "file:///out/a%20b%231%3F.jpg", "same", "ok", "b",
    )


@pytest.mark.parametrize(
    "pattern, hits, misses",
    [
        ("*.jpg", ["a.jpg", "x/B.JPG"], ["a.jpeg"]),
        ("thumb_*", ["x/thumb_1.png"], ["x/athumb_1.png"]),
        ("raw/*.nef", ["raw/a.nef"], ["x/raw/a.nef", "raw/b/a.nef"]),
        ("**/tmp/*", ["a/tmp/x", "tmp/x"], ["a/tmp/b/x"]),
        ("img?[0-3].png", ["IMG_2.png"], ["img_7.png"]),
        ("odd[", ["odd["], ["odd"]),
        ("a[[]b", ["a[b"], ["ab"]),
        ("a[]b", [], ["ab", "a[]b"]),
    ],
)
def test_globs(spark, pattern, hits, misses):
    rx = P.glob_to_regex(pattern)
    got = one(spark, *[F.lit(x).rlike(rx) for x in hits + misses])
    assert got == (True,) * len(hits) + (False,) * len(misses)


def test_xml_and_csv(spark):
    got = one(spark, X.escape_xml(F.lit('5" lens & tripod')), X.csv_quote(F.lit('a"b')), X.csv_name(F.lit("a,b.jpg")), X.csv_name(F.lit("a.jpg")))
    assert got == ("5&quot; lens &amp; tripod", '"a""b"', '"a,b.jpg"', "a.jpg")


GOOD = {**dict.fromkeys(K.DIMENSIONS, 70), "reasoning": "fine"}


@pytest.mark.parametrize(
    "text, error",
    [
        (json.dumps(GOOD), None),
        ("```json\n" + json.dumps(GOOD) + "\n```", None),
        (json.dumps({**GOOD, "quality": 72.5}), None),
        (json.dumps(GOOD) + " trailing", "invalid JSON"),
        (json.dumps(GOOD) + json.dumps(GOOD), "invalid JSON"),
        ("", "response text is empty"),
        ("[]", "root value is not an object"),
        (json.dumps({**GOOD, "quality": "70"}), 'key "quality" is missing or not a number'),
        (json.dumps({**GOOD, "exposure": True}), 'key "exposure" is missing or not a number'),
        (json.dumps({**GOOD, "faceEyes": -1}), 'key "faceEyes" is out of range'),
        (json.dumps({**GOOD, "reasoning": 5}), 'key "reasoning" is missing or empty'),
        (json.dumps({**GOOD, "reasoning": "  "}), 'key "reasoning" is missing or empty'),
    ],
)
def test_score_answers(spark, text, error):
    row = X.parse_score_answers(spark.createDataFrame([(text,)], "body string")).first()
    assert row.error == error
    if error is None:
        assert row.quality in (70, 73) and row.reasoning == "fine"


def test_tag_answers(spark):
    text = '```\n{"a.jpg": [" Bride ", "", 3, null, "GROOM"], "b.jpg": "x", "c.jpg": [], "other.jpg": ["y"]}\n```'
    got = one(spark, X.parse_tag_answer(F.lit(text), F.array(*map(F.lit, ("a.jpg", "b.jpg", "c.jpg", "d.jpg")))))
    assert got[0] == {"a.jpg": ["bride", "groom"]}


def test_prompts(spark):
    faces = {"has_faces": F.lit(True), "face_count": F.lit(2), "eyes_open": F.lit(True), "blink_detected": F.lit(False), "expression_neutral": F.lit(True)}
    w = K.GENRE_PRESETS["wedding"]
    prompt = X.scoring_prompt(F.lit("IMG_001.jpg"), F.lit("wedding"), F.lit("A wedding shoot"), F.lit(""), lambda d: F.lit(w[K.DIMENSIONS.index(d)]), faces)
    a, b = one(spark, prompt, X.discovery_prompt(F.lit("wedding"), F.lit(6)))
    assert "A wedding shoot" in a and "IMG_001.jpg" in a and "quality: weight 20" in a and "faces: 2" in a
    assert all(d in a for d in K.DIMENSIONS)
    assert "samples: 6" in b and "wedding" in b


def test_retry_after(spark):
    got = one(spark, *[X.retry_after(F.lit(h).cast("string")) for h in ("30", "0", "x", None, " 7s")])
    assert got == (30, 1, 60, 60, 7)


def test_normalise_weights(spark):
    rows = [
        (25, 20, 15, 15, 10, 15, "quality", 40.0, []),
        (25, 20, 15, 15, 10, 15, "quality", 40.0, ["exposure", "faceEyes"]),
        (100, 0, 0, 0, 0, 0, "quality", 50.0, []),
        (25, 20, 15, 15, 10, 15, "faceEyes", 250.0, list(K.DIMENSIONS)),
    ]
    cols = ", ".join(f"{d} int" for d in K.DIMENSIONS)
    df = spark.createDataFrame(rows, cols + ", changed string, value double, locked array<string>")
    out = [[r[d] for d in K.DIMENSIONS] for r in N.normalise_weights(df, "changed", "value", "locked").collect()]
    assert [sum(r) for r in out] == [100, 101, 100, 100]
    # Locked weights are not taken off before sharing; the drift cannot go below zero.
    assert out[1] == [40, 0, 18, 18, 10, 15] and out[2] == [50, 10, 10, 10, 10, 10] and out[3] == [0, 0, 0, 0, 0, 100]
