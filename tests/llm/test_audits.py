"""Source divergence, HTML extraction and the Merkle manifest against brute force, on odd rows and whole tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

import brute
from keepsift.llm import divergence, html_text, merkle

FOLDER = "/root/testdata/sf0.001"
CLASHING = "count docs digest term total value rank n v none pos grp block leaf claimed mark host path lines shared sig text_ html_".split()


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_html_extraction", "op13_merkle_manifest"])
def test_registered(spark, name):
    diff, rows, kind = compare(spark, connect(FOLDER), FOLDER, name)
    assert diff is None and rows and kind == "sql", diff


def clashing(df):
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHING if c not in df.columns])


# Source divergence.


def brute_divergence(rows, least=3, ranks=200):
    docs = [(a or "", b or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.folded(t)))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, by = Counter(), defaultdict(Counter)
        for a, b, c in docs:
            if a == lang:
                held.update(set(c))
                by[b].update(c)
        kept = sorted(t for t, n in held.items() if n >= least)
        by[None] = sum((by[b] for b in list(by)), Counter())
        p = {}
        for b, c in by.items():
            n = sum(c[t] for t in kept)
            p[b] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        sources = [b for b in by if b is not None]

        def f(p, q):
            return (p - q) ** 2 // q

        for b in sources:
            pairs = [(-sum(f(p[b][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != b]
            terms = [(-f(p[b][t], p[None][t]), t.encode(), t) for t in kept if by[b][t] and p[b][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, b, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


def divergence_rows(n=300, seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("The", "an", "ÉA", "éa", "ß", "漢", "x") for b in ("", "a", "Bb", "ccc", "é", "😀")]
    rows = []
    for _ in range(n):
        source = r.choice(["big"] * 6 + ["mid", "mid", "s", None, ""])
        text = r.choice([" ", "\n", "-", "_", "1"]).join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randint(0, 60)))
        rows.append((r.choice(["en", "en", "de", None]), source, text))
    rows += [("xx", "a", "only one two"), ("xx", "b", None), ("en", "none", ""), ("en", "none", "\x00 12 \t"), ("yy", "alone", "w w w")]
    rows += [("en", "long", "q" * 300_000 + " the " * 50_000)] * 3 + [rows[0]] * 2
    return rows


@pytest.mark.parametrize("bits", [64, 5, 0])
def test_divergence(spark, bits):
    """Digests of few bits stand for several terms each; the result is the same."""
    rows = divergence_rows()
    df = clashing(spark.createDataFrame(rows, "lang string, source string, text string").repartition(4))

    def digest(words):
        return words.hashes() & np.uint64((1 << bits) - 1)

    want = brute_divergence(rows, ranks=7)
    got = divergence.source_divergence(df, ranks=7, digest=digest).collect()
    assert sorted(tuple(r) for r in got) == want
    assert {r.part for r in got} == {"pair", "term"}


def test_divergence_across_batches(spark):
    """Terms whose rows span Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = divergence_rows(80, 5)
        df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
        assert sorted(tuple(r) for r in divergence.source_divergence(df, ranks=5).collect()) == brute_divergence(rows, ranks=5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_divergence_without_terms(spark):
    rows = [("en", "a", "one"), ("en", "b", "two"), ("en", "c", None)]
    got = divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute_divergence(rows) and len(got) == 6 and not any(r.value for r in got)
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


# HTML extraction.


def subsequence(a, b):
    sizes = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            sizes[i + 1][j + 1] = sizes[i][j] + 1 if x == y else max(sizes[i][j + 1], sizes[i + 1][j])
    return sizes[-1][-1]


def test_alignment():
    r = random.Random(4)
    for _ in range(800):
        k = r.randint(1, 6)
        a, b = ([r.randrange(k) for _ in range(r.randrange(25))] for _ in range(2))
        got = html_text.aligned(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == subsequence(a, b) and all(a[i] in rest for i in got)
    a, b = ([r.randrange(50) for _ in range(20_000)] for _ in range(2))
    assert len(html_text.aligned(a, b)) > 3000


CASES = [
    ("<article><h1>T &amp; t</h1><p>a<b>b</b>  c\n d<p>e<br>f</article><footer>x</footer>", "T & t ab c d e f"),
    ("<header><p>top</p></header><main><header><h1>h</h1></header><p>text</p><aside>side</aside></main>", "h text"),
    ("<body class='has-sidebar menu'><div class='cookie-notice'><p>we use</p></div><div id=content><p>one<p>two</div>", "one two"),
    ("<div class=\"ad\">buy</div><p>kept</p><p class='ad x'>buy<p>kept too<ul class=menu><li>a<li>b</ul><ul><li>c<li>d</ul>", "kept kept too c d"),
    ("<article>t<section id='comments'><p>reader says</p></section> end</article>", "t end"),
    ("<article>t</article><article class='comment'>says</article>", "t"),
    ("<script>var a='</p><article>no';</script><style>p{}</style><!-- <p>no --><p>yes", "yes"),
    ("<form>name <input> <button>go</button></form><nav>m</nav>text &copy; &#233; &lt;b&gt;", "text © é <b>"),
    ("<div role='main'><p>in</p></div><p>out</p>", "in"),
    ("a < b and <p", "a < b and"),
    ("<p title='a>b'>x</p><p title=\"un>closed</p>", "x closed"),  # a quote that never ends does not swallow the page
    ("<div itemprop=articleBody>body</div><div>other</div>", "body"),
    ("", ""),
    ("     \n", ""),
    ("</div></article>just text", "just text"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_page(html, text):
    assert html_text.main_text(html_text.page_lines(html)) == text


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "core" + "<p>x" * 50_000
    assert html_text.main_text(html_text.page_lines(deep)).startswith("core x x")
    assert len(html_text.main_text(html_text.page_lines("< " * 20_000 + "a" * 1_000_000))) >= 1_000_000


def brute_pages(rows):
    """Pages without copies among them: each against its neighbours by path, all in memory."""
    hosts, out = defaultdict(list), []
    for i, url, html in rows:
        m = re.match(r"\w+://([^/?#]*)([^?#]*)", url or "")
        hosts[m[1].lower() if m else ""].append((m[2] if m else url or "", i, url, html_text.page_lines(html or "")))
    for pages in hosts.values():
        pages.sort(key=lambda x: x[0])
        lines = [html_text.beyond(x[3]) for x in pages]
        for k, (_, i, url, page) in enumerate(pages):
            shared = set()
            for n in (k - 1, k + 1):
                if 0 <= n < len(pages):
                    hit = html_text.aligned(lines[k], lines[n])
                    if len(hit) <= 0.5 * max(len(lines[k]), len(lines[n])):
                        shared.update(hit)
            text = html_text.main_text(page, sorted(shared))
            out.append((i, url, text, len(text)))
    return sorted(out, key=repr)


def test_differencing(spark):
    """Templates without any telling markup: what neighbours share goes, the articles stay."""
    r = random.Random(7)
    rows = []
    for i in range(400):
        host = r.choice(["Big.example.org"] * 3 + ["a.example.org", "b.example.org"])
        section = r.choice(["news", "sport"])
        top = [f"{host.lower()} {section}", "Home", "About us"]
        own = [f"line {i} {j}" for j in range(r.randint(5, 12))]
        blocks = "".join(f"<div>{x}</div>" for x in [*top, *own, f"imprint of {host.lower()}", "last"])
        rows.append((i, f"https://{host}/{section}/{i:05d}?x=1", f"<html><body>{blocks}</body></html>"))
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    want = brute_pages(rows)
    for block in (64, 1, 3):
        got = html_text.extract_text(df, block=block)
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        assert sorted((tuple(x) for x in got.collect()), key=repr) == want
    assert all("Home" not in x[2] and "imprint" not in x[2] and f"line {x[0]} 0" in x[2] for x in want)


def test_differencing_decides_between_marked_bodies(spark):
    """What a page marks as its article counts only where it holds lines that no neighbour has."""
    teaser = "<article><h2>Our offer</h2><p>all you can read</p></article>"
    long = "a long story that both pages have " * 9
    rows = [(i, f"http://a/{i}", f"{teaser}<article><h1>head {i}</h1><p>said before<p>story {i} goes on and on, own words {i}</article><p>stray {i}") for i in range(4)]
    rows += [(10 + i, f"http://b/{i}", f"<main>{teaser}</main><div>head {i}</div><div>a text of its own, {i}, in no marked body</div>") for i in range(4)]
    rows += [(20 + i, f"http://c/{i}", f"<nav><p>n{i}<p>m{i}<p>o{i}</nav><article><p>{long}</article><p>posted {i}") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x.page_id: x.text for x in html_text.extract_text(df).collect()}
    for i in range(4):
        assert got[i] == f"head {i} said before story {i} goes on and on, own words {i}"
        assert got[10 + i] == f"head {i} a text of its own, {i}, in no marked body"
        assert got[20 + i] == long.strip()
    assert sorted((i, got[i]) for i in got) == sorted((x[0], x[2]) for x in brute_pages(rows))


def test_odd_pages(spark):
    page = "<nav>a</nav><article>same text &amp; more</article>"
    rows = [(1, "http://h/a", page), (1, "http://h/a", page), (2, "http://h/b", page), (None, None, page), (3, None, None), (None, "http://h/c", "")]
    rows += [(4, "http://h/d", "<p>" + "long words " * 200_000), (5, "not a url", "<div>x</div>"), (6, "//H/e", "<div>x</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {}
    for x in html_text.extract_text(df).collect():
        got.setdefault((x.page_id, x.url), []).append((x.text, x.n_chars))
    text = ("same text & more", 16)
    assert got[1, "http://h/a"] == [text, text] and got[2, "http://h/b"] == [text] and got[None, None] == [text]
    assert got[3, None] == [("", 0)] == got[None, "http://h/c"] and got[4, "http://h/d"][0][1] == 11 * 200_000 - 1
    assert got[5, "not a url"] == [("x", 1)] and sum(map(len, got.values())) == len(rows)
    assert html_text.extract_text(df.where("false")).count() == 0


# Merkle manifest.

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, run):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + run])) for i in range(0, len(below), run)])
    return levels


def way(levels, i, run):
    out = []
    for level in levels[:-1]:
        first = i // run * run
        out.append((level[first:i], level[i + 1 : first + run]))
        i //= run
    return out


def brute_merkle(rows, run=16):
    groups = defaultdict(list)
    for row in rows:
        doc_id, source, lang, n, text = row
        leaf = claimed = digest("".join(map(field, row)))
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            claimed = digest("".join(map(field, (doc_id, source, lang, n, brute.folded(text)))))
        groups[source].append((doc_id, leaf, claimed))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [climb([x[1] for x in groups[s]], run) for s in names]
    top, out = climb([t[-1][0] for t in trees], run), []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, claimed) in enumerate(groups[s]):
            path = way(trees[k], i, run) + way(top, k, run)
            for before, after in path:
                claimed = digest("".join(before) + claimed + "".join(after))
            proof = digest("".join(x for b, a in path for x in b + a))
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], proof, claimed, claimed == top[-1][0]))
    return sorted(out, key=repr)


def manifest(df, **more):
    return merkle.merkle_manifest(df, COLUMNS, claimed=merkle.tampered(df, COLUMNS, "doc_id", "text"), **more)


def digests(df):
    out = df.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("run, height", [(16, 3), (2, 1), (3, 2), (4, 3)])
def test_merkle(spark, run, height):
    """One group with most rows, lone leaves, many groups; trees that span several leaf partitions."""
    r = random.Random(8)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(400)]
    rows += [(r.randrange(-50, 400), r.choice(["", None, "b", "é", "漢"]), r.choice(["en", None]), None, r.choice(["Ab", "ab", "", None])) for _ in range(100)]
    rows += [(None, "hot", None, None, "No id"), (None, "hot", None, None, "No id"), (7, "hot", "en", 7, "Text 7"), (7, "hot", "en", 7, "text 7")]
    rows += [(1000 + i, f"lone {i:03d}", "en", 1, "A" * 100_000) for i in range(40)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = manifest(df, run=run, height=height)
    assert digests(got) == brute_merkle(rows, run)
    some = got.collect()
    # The proof is real: leaf, siblings and places give the root; a row is verified unless it was changed.
    assert all(merkle.folded(x.leaf, x.proof, x.places) == x.root for x in some)
    assert not all(x.verified for x in some) and all(x.verified == (x.folded_root == x.root) for x in some)


@pytest.mark.parametrize("rows", [[(5, None, None, None, None)], [(5, "a", "b", 1, "T"), (10, "b", "b", 1, "T")]])
def test_small_manifests(spark, rows):
    assert digests(manifest(spark.createDataFrame(rows, SCHEMA))) == brute_merkle(rows)


def test_empty_manifest(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_missing_nodes_are_the_fewest():
    """Every node that is asked for is needed, and all nodes above follow from the known ones."""
    r = random.Random(9)
    for _ in range(300):
        run, n = r.randint(2, 5), r.randint(1, 60)
        levels = climb([f"n{i}" for i in range(n)], run)
        known = r.sample(range(n), r.randint(1, n))
        asked = merkle.missing(known, n, run)
        have = {(0, k) for k in known} | set(asked)
        assert len(asked) == len(set(asked)) and not {(0, k) for k in known} & set(asked)
        for k in range(len(levels) - 1):
            for p in {q // run for lv, q in have if lv == k}:
                below = {(k, q) for q in range(p * run, min(len(levels[k]), p * run + run))}
                if below <= have:
                    assert (k + 1, p) not in asked
                    have.add((k + 1, p))
        assert (len(levels) - 1, 0) in have
