"""Text functions: escaping, model prompts, model answers, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions.numbers import js_round


def escape_xml(s: Column) -> Column:
    # The ampersand goes first: the other replacements produce one.
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(plain), F.lit(coded))
    return s


def csv_quote(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(s, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_name(s: Column) -> Column:
    """Quoted only where a comma, quote or line break would shift the columns."""
    return F.when(s.rlike('[,"\r\n]'), csv_quote(s)).otherwise(s)


def joined_keywords(keywords: Column) -> Column:
    return F.coalesce(F.array_join(keywords, "; "), F.lit(""))


def csv_keywords(keywords: Column) -> Column:
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, csv_quote(joined_keywords(keywords))).otherwise("")


def first_keywords(keywords: Column, n: int = 4) -> Column:
    return F.slice(keywords, 1, n)


def tier_rating(tier: Column) -> Column:
    out = F.lit(1)
    for t, r in K.TIER_RATINGS.items():
        out = F.when(tier == t, F.lit(r)).otherwise(out)
    return out


def tier_label(tier: Column) -> Column:
    out = F.lit("Red")
    for t, label in K.TIER_LABELS.items():
        out = F.when(tier == t, F.lit(label)).otherwise(out)
    return out


def tier_order(tier: Column) -> Column:
    out = F.lit(len(K.TIERS))
    for i, t in enumerate(K.TIERS):
        out = F.when(tier == t, F.lit(i)).otherwise(out)
    return out


def mask_secret(key: Column) -> Column:
    return F.concat(F.repeat(F.lit("•"), F.lit(8)), F.right(key, F.lit(4)))


def retry_after(header: Column) -> Column:
    """Leading integer of the header, at least 1; 60 when there is none."""
    digits = F.regexp_extract(header, r"^\s*([+-]?\d+)", 1)
    n = digits.try_cast("bigint")
    return F.when(n.isNull(), F.lit(K.DEFAULT_RETRY_AFTER)).otherwise(F.greatest(F.lit(1), n)).cast("bigint")


def http_error_class(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "ok")
        .when(status == 401, "auth")
        .when(status == 429, "rate_limit")
        .when(status >= 500, "server")
        .otherwise("other")
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def age_label(ts: Column, now: Column) -> Column:
    days = F.floor(seconds_between(ts, now) / 86400)
    return (
        F.when(ts.isNull(), "—")
        .when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def oldest_entry_label(oldest: Column, now: Column) -> Column:
    days = js_round(seconds_between(oldest, now) / 86400.0)
    return (
        F.when(oldest.isNull(), "no cached previews")
        .when(days <= 0, "oldest entry: today")
        .when(days == 1, "oldest entry: 1 day ago")
        .otherwise(F.concat(F.lit("oldest entry: "), days.cast("string"), F.lit(" days ago")))
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, the clock reading taken as UTC."""
    day = F.datediff(ts, F.lit("1970-01-01")).cast("bigint")
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint")
    whole = F.extract(F.lit("SECOND"), ts)
    return (day * 86400 + clock) * 1000000 + (whole * 1000000).cast("bigint")


def from_micros(us: Column) -> Column:
    """Zone-free timestamp of microseconds since 1970; does not depend on the session time zone."""
    seconds = us.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1000000.0)


def profile_name(genre: Column, ts: Column) -> Column:
    return F.concat(F.initcap(genre), F.lit(" — "), F.date_format(ts, "MMMM yyyy"))


# --- prompts -----------------------------------------------------------------

def scoring_prompt(filename, genre, context, preference, weights, faces, task: str = "", rubric: dict[str, str] | None = None) -> Column:
    """Request text for one asset; equal inputs give equal text.

    This is only the list of facts and of the keys to answer with; `task` and the `rubric` per dimension are the
    caller's words. `weights` maps a dimension to a column. `faces` maps has_faces, face_count, eyes_open,
    blink_detected and expression_neutral to columns.
    """

    def stated(text):
        told = F.trim(F.coalesce(text, F.lit("")))
        return F.when(told == "", "-").otherwise(told)

    seen = F.concat(
        F.lit("faces: "),
        faces["face_count"].cast("string"),
        *[F.concat(F.lit(f", {name} "), faces[c].cast("string")) for name, c in (("eyes open", "eyes_open"), ("blink", "blink_detected"), ("neutral", "expression_neutral"))],
    )
    wanted = [
        F.concat(F.lit(f"- {d}: weight "), weights(d).cast("string"), F.lit(f", {rubric[d]}" if rubric else ""))
        for d in K.DIMENSIONS
    ]
    keys = ", ".join(f'"{d}"' for d in K.DIMENSIONS)
    return F.concat_ws(
        "\n",
        *([F.lit(task)] if task else []),
        F.concat(F.lit("genre: "), genre),
        F.concat(F.lit("file: "), filename),
        F.concat(F.lit("context: "), stated(context)),
        F.concat(F.lit("wishes: "), stated(preference)),
        F.when(faces["has_faces"], seen).otherwise(F.lit("faces: 0")),
        F.lit("rate 0 to 100:"),
        *wanted,
        F.lit(f'reply: one JSON object with numbers {keys} and text "reasoning"'),
    )


def discovery_prompt(genre: Column, n: Column, task: str = "reply: a short description of the set") -> Column:
    return F.concat_ws("\n", F.concat(F.lit("genre: "), genre), F.concat(F.lit("samples: "), n.cast("string")), F.lit(task))


def tagging_prompt(filenames: Column, task: str = "reply: one JSON object, file name to a list of keywords") -> Column:
    quoted = F.array_join(F.transform(filenames, lambda f: F.concat(F.lit('"'), f, F.lit('"'))), ",\n")
    return F.concat_ws("\n", F.concat(F.lit("files: "), F.size(filenames).cast("string")), F.lit(task), quoted)


# --- answers -----------------------------------------------------------------

SCORE_ANSWER = ", ".join(f"{d} double" for d in K.DIMENSIONS) + ", reasoning variant"


def strip_fences(text: Column) -> Column:
    """Text without a surrounding Markdown code fence."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(body, r"(?i)^```(?:json)?\s*", "")
    body = F.regexp_replace(body, r"\s*```$", "")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def strict_json(body: Column) -> Column:
    """Variant of a text that is exactly one JSON value. The parser forgives text after a value,
    inside brackets it does not; a second value would be the second element."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_score_answers(answers: DataFrame, text: str = "body") -> DataFrame:
    """Add six rounded scores, `reasoning` and `error` (NULL when the answer is valid).

    Scores must be JSON numbers in 0..100 (quoted ones read as NULL) and reasoning a non-blank
    JSON string. Steps are columns, so that the text is parsed once.
    """
    trimmed = F.regexp_replace(F.try_variant_get("_p.reasoning", "$", "string"), r"^\s+|\s+$", "")
    step = (
        answers.withColumn("_body", strip_fences(F.col(text)))
        .withColumns({"_v": strict_json(F.col("_body")), "_p": F.from_json("_body", SCORE_ANSWER)})
        .withColumns(
            {
                "_root": F.schema_of_variant("_v"),
                "_why": F.when(F.schema_of_variant("_p.reasoning") == "STRING", trimmed),
            }
        )
    )
    error = (
        F.when(F.coalesce("_body", F.lit("")) == "", "response text is empty")
        .when(F.col("_v").isNull(), "invalid JSON")
        .when(~F.startswith("_root", F.lit("OBJECT")), "root value is not an object")
    )
    for d in K.DIMENSIONS:
        n = F.col(f"_p.{d}")
        error = error.when(n.isNull(), f'key "{d}" is missing or not a number').when(
            ~n.between(0, 100), f'key "{d}" is out of range'
        )
    error = error.when(F.coalesce("_why", F.lit("")) == "", 'key "reasoning" is missing or empty')
    ok = F.col("error").isNull()
    return step.withColumn("error", error).select(
        *answers.columns,
        *[F.when(ok, js_round(F.col(f"_p.{d}")).cast("int")).alias(d) for d in K.DIMENSIONS],
        F.when(ok, F.col("_why")).alias("reasoning"),
        "error",
    )


def parse_tag_answer(text: Column, filenames: Column) -> Column:
    """Map filename -> lower-case keywords for the listed files that have any.

    Every value is read on its own, so one malformed entry does not drop the others.
    """
    body = strip_fences(text)
    root = F.when(strict_json(body).isNotNull(), F.from_json(body, "map<string,variant>"))

    def words(name):
        items = F.try_variant_get(F.element_at(root, name), "$", "array<variant>")
        strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
        trimmed = F.transform(strings, lambda v: F.lower(F.trim(F.try_variant_get(v, "$", "string"))))
        return F.filter(trimmed, lambda w: w != "")

    pairs = F.transform(F.array_distinct(filenames), lambda f: F.named_struct(F.lit("key"), f, F.lit("value"), words(f)))
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))


def parse_weights_csv(text: Column) -> Column:
    """`q,a,c,s,e,f` as a struct; NULL fields where a part is missing or not a number."""
    parts = F.split(text, ",")
    return F.struct(
        *[F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(d) for i, d in enumerate(K.DIMENSIONS)]
    )
