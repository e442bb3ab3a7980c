"""Audit of how far the sources of a language differ in their terms, with late string materialisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keepsift.llm.words import Words, chunks
from keepsift.session import store

#: Documents of a language that hold a term before it counts; terms listed for each source; the scale of probabilities.
LEAST, RANKS, SCALE = 3, 200, 1_000_000_000
#: Bytes of text whose terms a task counts at once; pairs of sources that it compares at once.
COUNTED, PAIRS = 2_000_000, 1_000_000
#: Counts and names that a task holds before it gives them away.
HELD = 2_000_000
#: The bytes of terms: letters A-Z and a-z, and all bytes of characters beyond 7F.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

Digest = Callable[[Words], np.ndarray]


def term_digest(words: Words) -> np.ndarray:
    return words.hashes()


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(group, digest, count, docs) with one row for each group and digest."""
    group, of, count, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((of, group))
    group, of, count, docs = (x[order] for x in (group, of, count, docs))
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return group, of, count, docs
    return group[first], of[first], np.add.reduceat(count, first), np.add.reduceat(docs, first)


def _count(digest: Digest):
    """(lang, source, text) -> (lang, source, digest, count, docs): occurrences and documents, added up within the task.

    What a task holds is bounded by HELD rows; beyond, it gives them away and starts again.
    """
    names = ["lang", "source", "digest", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            group, of, count, docs = _added(held)
            lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for i in range(0, len(of), 100_000):
                part = pa.array(group[i : i + 100_000])
                rest = [pa.array(x[i : i + 100_000]) for x in (of.view(np.int64), count, docs)]
                yield pa.RecordBatch.from_arrays([lang.take(part), source.take(part), *rest], names)
            held.clear()

        for b in batches:
            named = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            group = np.array([groups.setdefault(g, len(groups)) for g in named], np.int64)
            for i, _, data, offsets in chunks(b.column(2), COUNTED):
                words = Words(_FOLD[data], offsets, _IN_TERM)
                if not len(words):
                    continue
                of, text = digest(words), words.text
                order = np.lexsort((text, of))  # documents of a term first, then terms of a group
                of, text = of[order], text[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(of)))
                held.append(_added([(group[text[first] + i], of[first], count, np.ones(len(first), np.int64))]))
            if sum(len(h[1]) for h in held) > HELD:
                held[:] = [_added(held)]
                if len(held[0][1]) > HELD // 2:
                    yield from out()
        if held:
            yield from out()

    return run, "lang string, source string, digest long, count long, docs long"


def _differ(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the bytes of each word differ from those of the word `first` names."""
    size = ends - starts
    out = size != size[first]
    todo = np.flatnonzero(~out & (first != np.arange(len(first))))
    for k in todo[size[todo] > 64]:
        out[k] = not np.array_equal(data[starts[k] : ends[k]], data[starts[first[k]] : ends[first[k]]])
    todo, at = todo[size[todo] <= 64], 0
    while len(todo):
        bad = data[starts[todo] + at] != data[starts[first[todo]] + at]
        out[todo[bad]] = True
        todo, at = todo[~bad], at + 1
        todo = todo[size[todo] > at]
    return out


def _strings(data: np.ndarray, words: Words, which: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(words.starts[which].tolist(), words.ends[which].tolist(), strict=True)]


def _texts(found: list[bytes]) -> pa.Array:
    return pa.array(found, pa.binary()).cast(pa.string())


def _name(digest: Digest):
    """(lang, source, text) -> (digest, term): the terms of each digest, once in a task or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for b in batches:
            for _, _, data, offsets in chunks(b.column(2), COUNTED):
                folded = _FOLD[data]
                words = Words(folded, offsets, _IN_TERM)
                if not len(words):
                    continue
                of = digest(words)
                _, first, place = np.unique(of, return_index=True, return_inverse=True)
                differ = np.flatnonzero(_differ(folded, words.starts, words.ends, first[place]))
                which = np.concatenate([first, differ])
                found = set(zip(of[which].view(np.int64).tolist(), _strings(folded, words, which), strict=True)) - seen
                seen |= found
                digests, terms = [f[0] for f in found], [f[1] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), _texts(terms)], ["digest", "term"])
                if len(seen) > HELD // 8:
                    seen.clear()

    return run, "digest long, term string"


def _spell(digest: Digest):
    """(lang, source, text) -> (lang, source, digest, term, count), a row for each document and term."""
    names = ["lang", "source", "digest", "term", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, offsets in chunks(b.column(2), COUNTED):
                folded = _FOLD[data]
                words = Words(folded, offsets, _IN_TERM)
                if not len(words):
                    continue
                counted: dict[tuple, int] = {}
                all_words = zip(words.text.tolist(), digest(words).view(np.int64).tolist(), _strings(folded, words, np.arange(len(words))), strict=True)
                for key in all_words:
                    counted[key] = counted.get(key, 0) + 1
                row = pa.array([k[0] + i for k in counted], pa.int64())
                columns = [b.column(0).take(row), b.column(1).take(row), pa.array([k[1] for k in counted], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, _texts([k[2] for k in counted]), pa.array(list(counted.values()), pa.int64())], names)

    return run, "lang string, source string, digest long, term string, count long"


def _share(count: str, n: str, v: str) -> str:
    """1 + floor(SCALE * (count + 1) / (n + v)), exact for any counts; NULL without terms."""
    small = f"({SCALE}L * ({count} + 1)) div ({n} + {v})"  # fits while the count lies below 2^63 / SCALE - 1
    large = f"({SCALE} * CAST({count} + 1 AS DECIMAL(20,0))) div ({n} + {v})"
    return f"CASE WHEN {v} > 0 THEN 1 + IF({count} < {2**63 // SCALE - 1}L, {small}, {large}) END"


def _excess(p: str, q: str) -> str:
    """floor((p - q)^2 / q); both lie below 2^31, so that the square fits."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, digest, term, source, p, p0) ordered by the first three -> (lang, source, item, value).

    The value is what a pair of sources that share terms adds to the sum in which every term counts as if only one
    of the two had it. It is summed up within the task, so that a term's pairs never leave it.
    """
    sums: dict[tuple, int] = {}
    held: pa.Table | None = None

    def add(table: pa.Table) -> None:
        if not table.num_rows:
            return
        langs, lang_names = _codes(table.column(0).combine_chunks())
        sources, source_names = _codes(table.column(3).combine_chunks())
        p, none = (table.column(c).to_numpy() for c in (4, 5))
        starts = np.flatnonzero(_news(table))
        sizes = np.diff(np.append(starts, table.num_rows))
        size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        done = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < table.num_rows:
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            k = size[at:to]
            a = np.repeat(np.arange(at, to), k)
            b = start[a] + np.arange(len(a)) - np.repeat(done[at:to] - done[at], k)
            a, b = a[a != b], b[a != b]
            at = to
            if not len(a):
                continue
            value = _f(p[a], p[b]) - _f(p[a], none[b]) - _f(none[a], p[b]) + _f(none[a], none[b])
            code = (langs[a] * len(source_names) + sources[a]) * len(source_names) + sources[b]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            for c, v in zip(code[order][first].tolist(), np.add.reduceat(value[order], first).tolist(), strict=True):
                c, item = divmod(c, len(source_names))
                lang, source = divmod(c, len(source_names))
                key = lang_names[lang].as_py(), source_names[source].as_py(), source_names[item].as_py()
                sums[key] = sums.get(key, 0) + v

    def batch() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(3)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])
        sums.clear()
        return out

    for b in batches:
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not table.num_rows:
            continue
        last = int(np.flatnonzero(_news(table))[-1])  # the last term may go on in the next batch
        held = table.slice(last)
        add(table.slice(0, last))
        if len(sums) > 100_000:
            yield batch()
    if held is not None:
        add(held)
    yield batch()


def _news(table: pa.Table) -> np.ndarray:
    """Where a row has another (lang, digest, term) than the one before."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in (0, 1, 2):
        codes = table.column(c).to_numpy() if c == 1 else _codes(table.column(c).combine_chunks())[0]
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def source_divergence(
    df: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least: int = LEAST,
    ranks: int = RANKS,
    digest: Digest = term_digest,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source of a language lies from the others and from the whole.

    Terms are runs of letters A-Z, a-z and of characters beyond 7F, A-Z lower-cased. A language keeps the V terms that
    at least `least` of its documents hold. A group, one source of a language or the language as a whole, gives a kept
    term with `count` occurrences there p = 1 + floor(SCALE * (count + 1) / (N + V)), N being its occurrences of kept
    terms; f(p, q) = floor((p - q)^2 / q). Part `pair`: f of the source against each other source of the language,
    summed over the kept terms. Part `term`: the `ranks` kept terms by f of the source against the language among those
    that the source has and uses more often than the language. Ties go to the smaller item by its UTF-8 bytes.

    Late string materialization: counts are shuffled and joined by 64-bit digests only. A dictionary of the digests'
    smallest and largest strings shows which digests stand for several terms; those few are counted once more by their
    strings (right for any `digest`). Text is joined back to the candidates of the listing alone.

    Sums over all terms need no row for a term that a source lacks: a term that only one source of a pair has counts
    through a histogram of that source's counts, and terms that both have add a correction, summed within the tasks.

    Defined cases: NULL lang, source and text are empty strings; every pair of lang and source that occurs is a group,
    also without terms. A language with no kept terms has pairs of value 0 and no terms. Repeated rows are documents of
    their own. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    rows = df.select(
        *[F.coalesce(df[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    )
    counts = rows.mapInArrow(*_count(digest)).groupBy("lang", "source", "digest")
    counts = store(counts.agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    names = rows.mapInArrow(*_name(digest)).groupBy("digest")
    names = store(names.agg(F.min("term").alias("name"), F.max("term").alias("last")), "names")
    split = names.where("name <> last").select("digest")
    apart = not split.isEmpty()
    whole = (counts.join(split, "digest", "left_anti") if apart else counts).withColumn("term", F.lit(None).cast("string"))
    if apart:
        spelled = rows.mapInArrow(*_spell(digest)).join(split, "digest", "left_semi").groupBy("lang", "source", "digest", "term")
        whole = whole.unionByName(spelled.agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("docs")))

    # At most one row for each source, so a term's rows are few however frequent it is.
    key = ["lang", "digest", "term"]
    of_term = W.partitionBy(*key)
    kept = whole.select(
        *key,
        "source",
        "count",
        F.sum("docs").over(of_term).alias("docs"),
        F.sum("count").over(of_term).alias("total"),
        F.row_number().over(of_term.orderBy("source")).alias("of_sources"),
    )
    kept = store(kept.where(F.col("docs") >= least).drop("docs"), "kept")
    group = ["lang", "source"]
    sums = kept.groupBy(*group).agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms"), F.count_if(F.col("of_sources") == 1).alias("new")
    )
    groups = rows.select(*group).distinct().join(sums, group, "left").na.fill(0, ["n", "terms", "new"])
    of_lang = W.partitionBy("lang")
    groups = groups.select(*group, "n", "terms", F.sum("n").over(of_lang).alias("lang_n"), F.sum("new").over(of_lang).alias("v"))
    groups = store(groups.withColumn("none", F.expr(_share("0L", "n", "v"))), "groups")

    listed = _listed(kept, groups, names, ranks)
    return _paired(kept, groups).unionByName(listed)


def _listed(kept: DataFrame, groups: DataFrame, names: DataFrame, ranks: int) -> DataFrame:
    """Part `term`: candidates by digest, then their text, then ranks."""
    group = ["lang", "source"]
    shares = kept.join(groups, group).select(
        *group, "digest", "term", F.expr(_share("count", "n", "v")).alias("p"), F.expr(_share("total", "lang_n", "v")).alias("q")
    )
    valued = shares.where("p > q").select(*group, "digest", "term", F.expr(_excess("p", "q")).alias("value"))
    # The value at which a group has enough terms, from its highest different values.
    falling = W.partitionBy(*group).orderBy(F.desc("value"))
    highest = valued.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("terms"))
    highest = highest.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= ranks)
    above = F.coalesce(F.sum("terms").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = highest.withColumn("above", above).where(F.col("above") < ranks).groupBy(*group).agg(F.min("value").alias("cut"))
    late = store(valued.join(cut, group).where("value >= cut").drop("cut"), "late")
    named = late.join(names.select("digest", "name"), "digest")
    named = named.select(*group, F.lit("term").alias("part"), F.coalesce("term", "name").alias("item"), "value")
    by_value = W.partitionBy(*group).orderBy(F.desc("value"), "item")
    return named.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)


def _paired(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Part `pair`: all pairs of sources of a language, which are the rows of the result."""
    own = groups.select("lang", "source", "terms", "v", "none")
    other = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("none").alias("item_none"))
    pairs = own.join(other, "lang").where("source <> item")
    pairs = store(pairs, "pairs")
    out = ["lang", "source", "item", "value"]
    neither = pairs.withColumn("value", F.expr(f"coalesce((v - terms - item_terms) * ({_excess('none', 'item_none')}), 0L)"))

    times = kept.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("times"))
    times = store(times.join(groups, ["lang", "source"]).select("lang", "source", F.expr(_share("count", "n", "v")).alias("p"), "times"), "times")
    first = times.join(pairs, ["lang", "source"]).withColumn("value", F.expr(f"times * ({_excess('p', 'item_none')})"))
    second = times.withColumnRenamed("source", "item").join(pairs, ["lang", "item"])
    second = second.withColumn("value", F.expr(f"times * ({_excess('none', 'p')})"))

    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "digest", F.coalesce("term", F.lit("")).alias("term"), "source", F.expr(_share("count", "n", "v")).alias("p"), "none"
    )
    key = ["lang", "digest", "term"]
    dealt = shares.repartition(*key).sortWithinPartitions("digest", "lang", "term")
    both = dealt.mapInArrow(_together, "lang string, source string, item string, value long")

    parts = neither.select(*out).unionByName(first.select(*out)).unionByName(second.select(*out)).unionByName(both)
    total = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
