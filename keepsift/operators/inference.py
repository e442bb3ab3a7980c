"""Pluggable scorers, taggers and detectors, and what their answers turn into."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keepsift import constants as K
from keepsift.functions import text as X
from keepsift.functions.numbers import weighted_total
from keepsift.operators.calls import Answer, Crew, Watched, ask, batch_call, once  # noqa: F401 - part of this interface
from keepsift.operators.joins import unscored_assets
from keepsift.operators.ordering import blocks_of, evenly_spaced_sample
from keepsift.operators.tiers import keepers, top_percent
from keepsift.session import store


def scores_from_answers(answers: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Score columns, total, reasoning and tokens from (image_id, status, body, ...). A failed
    request or a bad answer becomes a zero row with the reason. A refused key gives no row at all,
    so the asset stays without a score and a resumed run asks for it again."""
    cls = X.http_error_class(F.col("status"))
    parsed = X.parse_score_answers(answers.where((F.col("status") == 0) | (cls != "auth")))
    # Stored values, fixed text.
    failure = (
        F.when(F.col("status") == 0, "Request timed out twice")
        .when(cls != "ok", F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(F.col("error").isNotNull(), F.col("error"))
    )
    ok = F.col("failure").isNull()
    rows = parsed.withColumn("failure", failure)
    rows = rows.withColumns({d: F.when(ok, F.col(d)).otherwise(0) for d in K.DIMENSIONS})
    keep = [c for c in answers.columns if c not in ("status", "body", "tokens_in", "tokens_out")]
    return rows.select(
        *keep,
        *K.DIMENSIONS,
        weighted_total(F.col, lambda d: F.lit(float(weights[d]))).alias("total"),
        F.when(ok, F.lit(None)).otherwise("rejected").cast("string").alias("tier"),
        F.when(ok, F.col("reasoning")).otherwise(F.concat(F.lit("Scoring failed: "), "failure")).alias("reasoning"),
        F.when(ok, F.col("tokens_in")).otherwise(0).cast("bigint").alias("tokens_in"),
        F.when(ok, F.col("tokens_out")).otherwise(0).cast("bigint").alias("tokens_out"),
        "failure",
    )


def batch_score(
    assets: DataFrame,
    scored: DataFrame | None,
    call: Callable[[dict], Answer],
    weights: dict[str, float],
    concurrency: int | None = None,
    sleep=time.sleep,
    **options,
) -> DataFrame:
    """Score every asset that has no score yet. Answers are stored one by one, so no later retry
    repeats a call; a refused key ends the run for all tasks."""
    todo = unscored_assets(assets, scored) if scored is not None else assets
    return scores_from_answers(batch_call(todo, call, concurrency, sleep, **options), weights)


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """Outcome per asset of a log attempts(image_id, attempt_no, status, retry_after).

    Read in order, the log ends at the first of: success, 401, another refusal, the fourth 5xx,
    the second timeout. Each is an aggregate of its own, so an asset with very many attempts is
    combined on the map side. `pending` means the log holds no end.
    """
    cls = F.when(F.col("status") == 0, "timeout").otherwise(X.http_error_class(F.col("status")))
    log = attempts.withColumn("_cls", cls)
    ends = log.where(F.col("_cls").isin("ok", "auth", "other")).groupBy("image_id").agg(
        F.min("attempt_no").alias("_end")
    )
    fourth = _nth(log.where("_cls = 'server'"), K.MAX_SERVER_RETRIES + 1)
    second = _nth(log.where("_cls = 'timeout'"), 2)
    end = (
        ends.unionByName(fourth).unionByName(second).groupBy("image_id").agg(F.min("_end").alias("_end"))
    )
    upto = log.join(end, "image_id", "left").where(F.col("_end").isNull() | (F.col("attempt_no") <= F.col("_end")))
    at_end = F.col("attempt_no").eqNullSafe(F.col("_end"))
    before = ~at_end
    limited, server = F.col("_cls") == "rate_limit", F.col("_cls") == "server"
    n_server = F.count_if(before & server)
    backoff = n_server * 0
    for i in range(K.MAX_SERVER_RETRIES):
        backoff = backoff + F.when(n_server > i, K.SERVER_BACKOFF_SECONDS * 2**i).otherwise(0)
    return (
        upto.groupBy("image_id")
        .agg(
            F.coalesce(F.max(F.when(at_end, F.col("_cls"))), F.lit("pending")).alias("outcome"),
            F.count_if(before & ~F.col("_cls").isin("ok", "auth", "other")).alias("retries"),
            (F.coalesce(F.sum(F.when(before & limited, F.col("retry_after"))), F.lit(0)) + backoff).cast("bigint").alias(
                "waited_s"
            ),
        )
    )


def _nth(rows: DataFrame, n: int) -> DataFrame:
    """Number of the n-th attempt per asset; each task sends at most n rows per asset."""
    from keepsift.operators.ranking import newest_n

    few = newest_n(rows.select("image_id", "attempt_no"), n, [F.asc("attempt_no")], ["image_id"])
    return (
        few.groupBy("image_id")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("attempt_no").alias("_end"))
        .where(F.col("_c") == n)
        .select("image_id", "_end")
    )


# --- deterministic scorer ----------------------------------------------------


def name_score(filename: Column, dimension: str) -> Column:
    i = K.DIMENSIONS.index(dimension)
    out = F.lit(K.NAME_SCORES_DEFAULT[i])
    for pattern, values in reversed(K.NAME_SCORES):
        out = F.when(F.lower(filename).rlike(pattern), F.lit(values[i])).otherwise(out)
    return out


def name_scores(assets: DataFrame, filename: str = "filename") -> DataFrame:
    """Scores by file-name class, without any model."""
    scored = assets.withColumns({d: name_score(F.col(filename), d) for d in K.DIMENSIONS})
    return scored.withColumn(
        "reasoning",
        F.concat(F.lit("File name class of "), F.col(filename)),
    )


def name_keywords(filename: Column) -> Column:
    out = F.array(*map(F.lit, K.NAME_KEYWORDS_DEFAULT))
    for pattern, words in reversed(K.NAME_KEYWORDS):
        out = F.when(filename.rlike(pattern), F.array(*map(F.lit, words))).otherwise(out)
    return out


# --- tagging, discovery, detection -------------------------------------------


def tag_requests(scores: DataFrame, percent: float | None = None, **options) -> DataFrame:
    """(block_no, items, prompt): the top percent of the keepers in blocks of five."""
    chosen = top_percent(keepers(scores), percent).select("image_id", "filename", "total")
    blocks = blocks_of(chosen, [F.desc("total"), F.col("image_id")], **options)
    # A block holds five rows at most.
    item = F.struct((-F.col("total")).alias("rank"), "image_id", "filename")
    grouped = blocks.groupBy("block_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.withColumn("prompt", X.tagging_prompt(F.col("items.filename")))


def batch_tag(
    scores: DataFrame, call: Callable[[dict], Answer], percent: float | None = None, concurrency=None, sleep=time.sleep, **options
) -> DataFrame:
    """(image_id, keywords) for the best keepers.

    A block that fails is asked again file by file. An auth or rate-limit error ends the run for
    all tasks, and what there is so far counts. Nothing waits. Answers are stored first.
    """
    stops = (401, 429)
    requests = tag_requests(scores, percent)
    first = batch_call(requests, call, concurrency, sleep, once, stops, **{"limit_s": K.BLOCK_LIMIT_S, **options})
    failed = (~F.col("status").isin(200, *stops)) | _unreadable(F.col("status"), F.col("body"))
    retry = (
        first.where(failed)
        .select("block_no", F.explode("items").alias("_i"))
        .select("block_no", F.array("_i").alias("items"))
        .withColumn("prompt", X.tagging_prompt(F.col("items.filename")))
    )
    ended = not first.where(F.col("status").isin(*stops)).isEmpty()
    answers = first if ended else first.unionByName(batch_call(retry, call, concurrency, sleep, once, stops, **options))
    answers = answers.where("status = 200")
    tags = answers.select(
        F.explode("items").alias("i"), X.parse_tag_answer(F.col("body"), F.col("items.filename")).alias("tags")
    )
    return tags.select("i.image_id", F.element_at("tags", F.col("i.filename")).alias("keywords")).where(
        "keywords IS NOT NULL"
    )


def _unreadable(status: Column, body: Column) -> Column:
    return (status == 200) & X.strict_json(X.strip_fences(body)).isNull()


def summarise_sample(
    assets: DataFrame,
    order: list[Column],
    call: Callable[[list[dict]], str],
    reference: dict | None = None,
    narrow: tuple[str, ...] = (),
) -> DataFrame:
    """Add `context`: one text about 5 to 8 evenly spaced assets (and an optional reference item,
    first). A failing call gives an empty text. The text reaches the rows as a scalar subquery."""
    sample = evenly_spaced_sample(assets, order, narrow=narrow)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in pdf.to_dict("records")]
        rows.sort(key=lambda r: r["sample_no"])
        try:
            text = call(([reference] if reference else []) + rows) if rows else ""
        except Exception:  # noqa: BLE001 - the run goes on without a context
            text = ""
        yield pd.DataFrame({"context": [text]})

    # At most eight rows (and a shuffle before them, so that only they share a task).
    summary = store(sample.repartition(1).mapInPandas(run, "context string"), "context")
    return assets.withColumn("context", F.coalesce(summary.scalar(), F.lit("")))


FACE_SCHEMA = (
    "image_id string, face_no int, left_open double, right_open double, emotion string, "
    "box struct<x:double,y:double,width:double,height:double>, image_width int, image_height int, error string"
)


#: Detector processes of one task. More than one is started only while calls hang.
DETECTORS = 3
#: Images whose faces are given on at once.
IMAGES_AT_ONCE = 1000


def detect_faces(assets: DataFrame, detect: Callable[[bytes], list[dict]], limit_s: float = K.DETECT_LIMIT_S) -> DataFrame:
    """One row per face from assets(image_id, content, width, height). Images with a known side
    below 64 px have none. A detector that fails, ends its process or takes longer than `limit_s`
    gives one row that holds only the error. While a detector hangs, up to DETECTORS - 1 others of the task go on.

    Images go to the detector one at a time out of the Arrow batch, so a task holds no second copy of a batch."""
    side = F.least("width", "height")
    usable = assets.where(~((F.col("width") > 0) & (F.col("height") > 0) & (side < K.MIN_FACE_IMAGE_PX)))

    names = ["image_id", "face_no", "left_open", "right_open", "emotion", "box", "image_width", "image_height", "error"]
    schema = to_arrow_schema(T.StructType.fromDDL(FACE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Crew(lambda content: detect(bytes(content)), limit_s, DETECTORS) as crew:
            for whole in batches:
                for at in range(0, whole.num_rows, IMAGES_AT_ONCE):
                    b, out = whole.slice(at, IMAGES_AT_ONCE), []
                    met = dict(crew.map(c.as_py() for c in b.column(1)))
                    for place, (image_id, width, height) in enumerate(zip(*[b.column(i).to_pylist() for i in (0, 2, 3)], strict=True)):
                        try:
                            if isinstance(met[place], Exception):
                                raise met[place]
                            for i, f in enumerate(met[place]):
                                out.append(
                                    (image_id, i, f.get("left_open"), f.get("right_open"), f.get("emotion"), f.get("box"), width, height, None)
                                )
                        except Exception as e:  # noqa: BLE001 - counted downstream by its error column
                            out.append((image_id, None, None, None, None, None, width, height, str(e)))
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema, preserve_index=False)

    return usable.select("image_id", "content", "width", "height").mapInArrow(run, FACE_SCHEMA)
