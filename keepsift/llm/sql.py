"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from keepsift.llm.divergence import LEAST, RANKS, SCALE
from keepsift.llm.merkle import RUN
from keepsift.llm.secrets import BASE, MORE
from keepsift.llm.substring_dedup import WINDOW
from keepsift.llm.suffix_dedup import PASSAGE

ORACLE: dict[str, str] = {}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op4_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)"


def _repeats(k: int) -> str:
    """Words left when those in windows of k words that occur more than once are gone."""
    return f"""
WITH {WORDS.format(text="coalesce(text, '')")},
i AS (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM i),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS i FROM r),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM e ANTI JOIN c USING (doc_id, i) GROUP BY e.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


ORACLE["op1_substring_dedup"] = _repeats(WINDOW)
ORACLE["op6_suffix_dedup"] = _repeats(PASSAGE)

ORACLE["op3_jaccard_join"] = f"""
WITH RECURSIVE {WORDS.format(text=FOLDED)},
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a),
c AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, n_shingles, component_id FROM c
"""

_KINDS = [*BASE, *MORE]


def _spans(i: int) -> str:
    """Spans of rule i: lengths of what lies between the matches and of the matches, summed."""
    rule = _KINDS[i]
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {i} AS place, s.start AS start, s.start + length(s.whole) AS stop
FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda k: struct_pack(
    start := cast(coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS BIGINT),
    whole := ms[k], tested := gs[k]))) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs, string_split_regex(t, '{pattern}') AS ps
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
) WHERE length(s.tested) >= {rule.least}"""


ORACLE["op9_secret_scan"] = f"""
WITH s AS ({' UNION ALL '.join(_spans(i) for i in range(len(_KINDS)))}),
n AS (SELECT doc_id, place, start, [{', '.join(f"'{r.kind}'" for r in _KINDS)}][place + 1] || ':' || start || ':' || stop AS span FROM s),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE place = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
  string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM n GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""

ORACLE["op10_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op11_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN l USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS total FROM l GROUP BY lang),
p AS (SELECT s.lang, s.source, l.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS p,
  1 + {SCALE}::HUGEINT * (l.total + 1) // (v.total + v.v) AS q
  FROM s JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = l.term),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM b UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {RANKS}
"""

#: White space, also beyond ASCII.
_SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Holds for pages that mark their article, as all pages of the given tables do.
ORACLE["op12_html_extraction"] = f"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM a),
x AS (SELECT page_id, url, trim(regexp_replace(t, '{_SPACES}', ' ', 'g'), ' ') AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM x
"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || ({c}::VARCHAR), '-')"


def _crc32(text: str) -> str:
    """CRC-32 of a decimal number, bit by bit: a byte goes in before eight steps."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(acc, x) >> 1, (xor(acc, x) & 1) * 3988292384)"
    return f"xor(list_reduce({steps}, lambda acc, x: {step}, 4294967295::BIGINT), 4294967295)"


def _levels(low: str, way: str, runs: str, group: str, k: int) -> str:
    """Level k + 1 of a tree from level k (`low`), and the ways of all leaves to it (`way`)."""
    place = f"i % {RUN}"
    before, after = f"array_to_string(ds[1:{place}], '')", f"array_to_string(ds[{place} + 2:], '')"
    return f"""
{runs}{k} AS (SELECT g, pos // {RUN} AS run, list(digest ORDER BY pos) AS ds, max(n) AS n FROM {low}{k} GROUP BY ALL),
{low}{k + 1} AS (SELECT g, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS digest, (n + {RUN - 1}) // {RUN} AS n FROM {runs}{k}),
{way}{k + 1} AS (SELECT y.* REPLACE (
  CASE WHEN r.n > 1 THEN sha256({before} || fold || {after}) ELSE fold END AS fold,
  CASE WHEN r.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof, i // {RUN} AS i)
  FROM {way}{k} y JOIN {runs}{k} r ON r.g = {group} AND r.run = y.i // {RUN})"""


def _merkle(levels: int, groups: int) -> str:
    """Trees of up to `levels` levels over the leaves of a source, one of up to `groups` levels over the sources."""
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    parts = [
        f"""
d AS (SELECT *, CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM documents),
h AS (SELECT doc_id, source, sha256({" || ".join([*fields, _field("text")])}) AS leaf, sha256({" || ".join([*fields, _field("low")])}) AS claimed FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) AS n FROM h GROUP BY source),
x AS (SELECT doc_id, g, leaf, claimed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos, n FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
l0 AS (SELECT g, pos, leaf AS digest, n FROM x),
y0 AS (SELECT *, claimed AS fold, '' AS proof, pos AS i FROM x)"""
    ]
    parts += [_levels("l", "y", "a", "y.g", k) for k in range(levels)]
    parts.append(f"""
m0 AS (SELECT 0 AS g, g AS pos, digest, count(*) OVER () AS n FROM l{levels}),
z0 AS (SELECT y.* REPLACE (y.g AS i), l.digest AS subroot FROM y{levels} y JOIN l{levels} l USING (g))""")
    parts += [_levels("m", "z", "b", "0", k) for k in range(groups)]
    # Each level is read twice, so it is worth keeping.
    return f"""
WITH {",".join(parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")}
SELECT z.doc_id, z.leaf, z.subroot, m.digest AS root, sha256(z.proof) AS proof_sha256, z.fold AS folded_root, z.fold = m.digest AS verified
FROM z{groups} z JOIN m{groups} m ON m.g = 0
"""


#: Room for 16^6 rows of a source and 16^3 sources.
ORACLE["op13_merkle_manifest"] = _merkle(6, 3)
