"""Secret scans through an inverted index of the trigrams that the rules' patterns cannot do without."""

from __future__ import annotations

import re._parser as sre
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift.llm.common import integral, lower_ascii, same
from keepsift.session import store

#: Strings that one stretch of a pattern may stand for before it counts as unknown text.
MOST_STRINGS = 64
#: Numbers that are added up in one go.
PART = 256
_SPANS = "array<struct<start:int,place:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `pattern`, of whose leftmost non-overlapping matches those stay in which `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Patterns and lengths of the base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of further credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

_BREAK = r"(?:\s|\\[rn])"
#: A private key from its header to its END line, or without one to the end of the base64 lines; of any length.
#: Repeats are possessive, which Java matches without recursion.
_WHOLE_KEY = (
    MORE[0].pattern
    + r"(?:[^-]*+(?:-{1,4}(?!-)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    + rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{20,}}+={{0,2}}+)++"
    + r"""(?:(?:[ \t]*+\r?+\n|(?:\\r)?+\\n)[A-Za-z0-9+/]++={0,2}+(?![^\s"'\\]))?+)?+"""
)
#: What is masked: the same rules, with the body of a private key.
MASKED = (*BASE, Rule("private_key", _WHOLE_KEY), *MORE[1:])


def _strings(op, arg) -> set[str] | None:
    """The lower-cased strings that one element of a parsed pattern matches, or None if there are too many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST_STRINGS:
                found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return found if len(found) <= MOST_STRINGS else None
    if name == "SUBPATTERN":
        return _whole(arg[-1])
    if name == "BRANCH":
        parts = [_whole(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name == "MAX_REPEAT" and arg[1] <= 1:
        part = _whole(arg[2])
        return None if part is None else part | {""} if arg[0] == 0 else part
    if name == "MAX_REPEAT" and arg[0] == arg[1] <= 8:
        part = _whole(arg[2])
        found = {""}
        for _ in range(arg[0]):
            if part is None or len(found) * len(part) > MOST_STRINGS:
                return None
            found = {a + b for a, b in product(found, part)}
        return found
    return None


def _whole(items) -> set[str] | None:
    found = {""}
    for op, arg in items:
        part = _strings(op, arg)
        if part is None or len(found) * len(part) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, part)}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What a text must hold to match: for every clause, all trigrams of one alternative at least.

    Stretches of the pattern with known strings give a clause each: one set of (lower-cased) trigrams per string.
    Stretches that may be shorter than three characters give none. No clause: the rule has to scan every text.
    """
    clauses, run = [], {""}

    def close() -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in sets:
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    for op, arg in sre.parse(pattern):
        part = _strings(op, arg)
        if part is None or len(run) * len(part) > MOST_STRINGS:
            close()
            run = {""} if part is None else part
        else:
            run = {a + b for a, b in product(run, part)}
    close()
    return clauses


def trigram_postings(df: DataFrame, trigrams: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index, (trigram, doc_id), of the trigrams that rules ask for."""
    low = lower_ascii(df[text_col])
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    rows = df.select(integral(df, id_col).alias("doc_id"), low.alias("low"))
    return rows.select("doc_id", F.explode(held).alias("trigram")).select("trigram", "doc_id")


def candidates(df: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str) -> DataFrame | None:
    """(doc_id, kinds): the kinds whose trigram query the postings of a document satisfy; None if all rules scan."""
    terms = []
    for rule in rules:
        for c, clause in enumerate(trigram_query(rule.pattern)):
            for a, alternative in enumerate(clause):
                terms += [(t, rule.kind, c, a, len(alternative), len(trigram_query(rule.pattern))) for t in sorted(alternative)]
    if not terms:
        return None
    spark = df.sparkSession
    asked = spark.createDataFrame(terms, "trigram string, kind string, clause int, alternative int, trigrams int, clauses int")
    postings = trigram_postings(df, sorted({t[0] for t in terms}), id_col, text_col).distinct()
    # The asked-for side has one row per trigram and alternative of the rules, however many documents there are.
    met = postings.join(F.broadcast(asked), "trigram")
    full = met.groupBy("doc_id", "kind", "clause", "alternative").agg(
        F.count(F.lit(1)).alias("n"), F.max("trigrams").alias("trigrams"), F.max("clauses").alias("clauses")
    )
    held = full.where("n = trigrams").groupBy("doc_id", "kind").agg(
        F.countDistinct("clause").alias("n"), F.max("clauses").alias("clauses")
    )
    return held.where("n = clauses").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _before(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array what `both`, from 0 on, makes of all before it.

    An array grows by copying, so the numbers are taken in parts of PART: the work grows with their count, not its square.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def fold(part: Column) -> Column:
        return F.aggregate(
            part,
            start,
            lambda acc, x: F.struct(both(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int")), lambda i: F.slice(x, i * PART + 1, F.lit(PART)))
        return F.transform(F.array(F.transform(parts, fold)), joined)[0]

    def joined(parts: Column) -> Column:
        bases = fold(F.transform(parts, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(parts, bases, lambda p, b: F.transform(p["out"], lambda v: both(v, b))))

    one = F.transform(F.array(values), lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(F.array().cast("array<int>")))
    return one[0]


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule as array<struct<start, place, end>> in code points.

    The texts between the matches and the matches themselves follow one another, so places are sums of lengths.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(matches, tested, lambda m, t: F.struct(F.char_length(m).alias("long"), F.char_length(t).alias("tested")))
    steps = F.zip_with(
        lengths,
        F.slice(between, 1, F.size(matches)),
        lambda m, b: F.struct(F.char_length(b).alias("gap"), m["long"].alias("long"), m["tested"].alias("tested")),
    )

    def placed(x: Column) -> Column:
        ends = _before(F.transform(x, lambda s: s["gap"] + s["long"]), lambda a, b: a + b)
        every = F.zip_with(
            x, ends, lambda s, at: F.struct(s["tested"].alias("tested"), (at + s["gap"]).alias("start"), (at + s["gap"] + s["long"]).alias("end"))
        )
        held = F.filter(every, lambda s: s["tested"] >= rule.least)
        return F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("place"), s["end"].alias("end")))

    found = F.transform(F.array(steps), placed)[0]
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(_SPANS))


def _listed(spans: Column, kinds: Sequence[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    text = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def _quick(rule: Rule) -> Rule:
    """A single character class followed by + has the same matches of `least` characters when it asks for that many."""
    parsed = list(sre.parse(rule.pattern))
    if rule.group == 0 and len(parsed) == 1 and rule.pattern.endswith("]+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def _spotted(df: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text, _<kind> ...): the input row, and per rule its spans."""
    scanning = {r.kind for r in rules if not trigram_query(r.pattern)}
    rows = df.select(F.struct(*df.columns).alias("row"), integral(df, id_col).alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    found = candidates(df, rules, id_col, text_col)
    if found is None:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    else:
        found = store(found, "candidates")
        rows = rows.join(found, same(rows, found, "doc_id"), "left").select("row", rows["doc_id"], "text", "kinds")
    for i, rule in enumerate(rules):
        spans = _spans(F.col("text"), _quick(rule), i)
        if rule.kind not in scanning:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast(_SPANS))
        rows = rows.withColumn(f"_{rule.kind}", spans)
    return rows.drop("kinds")


def scan_secrets(
    df: DataFrame, base: Sequence[Rule] = BASE, more: Sequence[Rule] = MORE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_<kind> of every base rule, base_sha256, spans, found (array of kind, start, end).

    Each rule's pattern becomes a Boolean query over trigrams; the postings of those trigrams are intersected per
    document, and a rule's expression runs over the texts its query leaves. Rules without a query run over every text.
    Spans are code points, end exclusive, leftmost and not overlapping within a kind.

    Defined cases: a NULL text is empty and has no spans. NULL ids are matched with NULL ids; rows that repeat an
    id share candidates, but each row's own text decides. Empty tables give no rows; other columns are ignored.
    """
    rules = [*base, *more]
    kinds = [r.kind for r in rules]
    rows = _spotted(df.select(id_col, text_col), rules, id_col, text_col).select(
        "doc_id",
        *[F.size(f"_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base],
        F.array_sort(F.concat(*[F.col(f"_{r.kind}") for r in base])).alias("_base"),
        F.array_sort(F.concat(*[F.col(f"_{k}") for k in kinds])).alias("_all"),
    )
    names = F.array(*[F.lit(k) for k in kinds])
    return rows.select(
        "doc_id",
        *[f"n_{r.kind}" for r in base],
        F.sha2(_listed(F.col("_base"), kinds), 256).alias("base_sha256"),
        _listed(F.col("_all"), kinds).alias("spans"),
        F.transform(
            "_all", lambda s: F.struct(F.element_at(names, s["place"] + 1).alias("kind"), s["start"], s["end"])
        ).alias("found"),
    )


def redact_secrets(
    df: DataFrame, rules: Sequence[Rule] = MASKED, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The input rows with `mask` in the text for every stretch that spans of any rule cover; other columns as they are.

    Texts without spans stay as they are, NULL included. Spans that overlap are one stretch. A private key is masked
    as a whole, while `scan_secrets` lists its header.
    """
    rows = _spotted(df, rules, id_col, text_col)
    spans = F.array_sort(F.concat(*[F.col(f"_{r.kind}") for r in rules]))

    def shown(found: Column) -> Column:
        # A stretch begins at a span behind the ends of all before it; `at` is where the text before it begins.
        ends = _before(F.transform(found, lambda s: s["end"]), F.greatest)
        begun = F.filter(F.zip_with(found, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))), lambda g: g["start"] >= g["at"])
        last = F.array_max(F.transform(found, lambda s: s["end"]))
        # Taking a part of a text reads it from its beginning; many parts are cut from its characters.
        few = F.array_join(F.transform(begun, lambda g: F.concat(F.substring(F.col("text"), g["at"] + 1, g["start"] - g["at"]), F.lit(mask))), "")
        few = F.concat(few, F.substring(F.col("text"), last + 1, F.char_length("text")))

        def cut(c: Column) -> Column:
            parts = F.transform(begun, lambda g: F.concat(F.array_join(F.slice(c, g["at"] + 1, g["start"] - g["at"]), ""), F.lit(mask)))
            return F.concat(F.array_join(parts, ""), F.array_join(F.slice(c, last + 1, F.size(c)), ""))

        characters = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
        return F.when(F.size(found) <= PART, few).otherwise(F.transform(F.array(characters), cut)[0])

    hidden = F.transform(F.array(spans), shown)[0]
    text = F.when(F.size(spans) > 0, hidden).otherwise(F.col(f"row.`{text_col}`"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
