"""Main text of pages, ranked search and the filter audit: brute force, composed pages, edge rows."""

import html as entities
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridorwatch.llm import filters, lexical, pages
from conftest import SF_DIR


@pytest.fixture(scope="module")
def labeller(spark):
    return pages.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"))


def test_main_text_of_the_table(spark):
    """Whole pages against the article element, read by a plain regular expression."""
    table = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    want = {}
    for row in table.collect():
        inside = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        plain = re.sub(r"</?(?:b|a|i)\b[^>]*>|<br>", lambda t: " " if t[0] == "<br>" else "", inside)
        parts = (" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", plain))
        want[row["page_id"]] = " ".join(x for x in parts if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.main_text(table).collect()}
    assert got.keys() == want.keys()
    assert all(n == len(t) for t, n in got.values())
    assert sum(got[k][0] == want[k] for k in want) >= 0.98 * len(want)


def test_composed_pages_held_out(spark, labeller):
    table = [r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(40).collect()]
    composer = pages.Composer(np.random.default_rng(7), *pages.texts_of(table, 400))
    right = total = 0
    for _ in range(200):
        page = composer.page()
        if page:
            batch = pages.Batch.of([page])
            right += int(((labeller.chances(batch) >= 0.5) == (batch.target > 0)).sum())
            total += len(page)
    assert right / total >= 0.98


PROSE = "Then over the broken bridge they carried water, and nobody asked them why it was so heavy. "


@pytest.mark.parametrize(
    "page",
    [
        "<html><body><div class='navbar'><a href=/>Home</a><a href=/n>News</a></div><div id=content><h1>MAIN one</h1><p>{m}</p><p>{m}</p></div><div class=sidebar><p>{n}</p></div><div id=footer>{n}</div></body></html>",
        "<body><header class='site-header'><div>Site name</div></header><main><h1>MAIN one</h1><p>{m}<p>{m}<ul><li>MAIN two.</li><li>MAIN three.</li></ul></main><section class=comments><h3>Replies</h3><div class=comment><p>{n}</p></div></section><footer>{n}</footer>",
        "<body><div class=cookie-notice><p>{n}</p></div><div class='post-content'><h2>MAIN one</h2><p>{m}</p><div class='ad'>{n}</div><p>{m}</p><blockquote>{m}</blockquote></div><form><label>Mail</label><button>Send</button></form>",
        "<body><article><h1>MAIN one</h1><p>{m}</p></article><aside><h3>More</h3><p>{n}</p></aside><div class='related'><a href=/a>Other</a></div>",
    ],
)
def test_layouts_that_the_table_does_not_have(labeller, page):
    text = pages.extract(labeller, [page.format(m="MAIN " + PROSE * 2, n="NOISE " + PROSE)])[0]
    assert text.count("MAIN") == page.count("{m}") + page.count("MAIN")
    assert "NOISE" not in text and "Home" not in text and "Replies" not in text


def test_blocks_read_broken_markup():
    read = lambda p: [b.text for b in pages.blocks(p)]
    assert read(None) == read("") == []
    assert read('<p>a&amp;amp; <!-- <p>no --> b<script>var t="</p>";</script> c<br>d<p>e') == ["a&amp; b c d", "e"]
    assert read("<head><title>no</title></head><p title='a>b'>x\n\t y</b></q>z") == ["x yz"]
    assert read("<div>one<style>p{}") == ["one"]
    assert read("1 < 2 <p>three") == ["1 < 2", "three"]
    assert read('a <b class="x') == ["a"]
    deep = read("<div>" * 50_000 + "x" + "</i></span>" * 50_000)
    assert deep == ["x"]
    assert pages.blocks("<ul><li><a href=x>one two</a><li>three</ul>")[0].linked == 7
    assert len(read("<p>" + "word " * 400_000 + "</p>")[0]) == 5 * 400_000 - 1


def test_pages_edge_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "t", "n"), (2, None, "", "t", "n"), (None, "u", "<p>" + PROSE * 4, "t", "n"), (2, None, "", "t", "n"), (4, "u", "<nav><a href=x>y</a></nav>", "t", "n")]
    got = pages.main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert pages.main_text(spark.createDataFrame([], schema)).count() == 0


DOCS = "doc_id bigint, text string, source string, score string, rank string, part string"
TEXTS = [None, "", " \n\t", "#$%", "Ärger ärger A b", "the Cat sat", "the cat SAT", "the cat the cat é", "a", "word " * 30_000 + "cat", "cat", "x1 x1 y2"]
DOC_ROWS = [(i, t, None if i % 4 == 0 else ["", "s", "t"][i % 3], "s", "r", "p") for i, t in enumerate(TEXTS)]
DOC_ROWS += [DOC_ROWS[5], (None, "the cat", "s", "s", "r", "p"), (None, "cat", None, "s", "r", "p"), (5, "cat", "t", "s", "r", "p")]


def _search(docs, items):
    """Scores of all pairs, as the contract words them."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = [(d, Counter(term.findall((t or "").translate(lower)))) for d, t in docs]
    read = [(d, c) for d, c in read if c]
    n_docs, n_terms = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    found = []
    for k, text in items:
        q = term.findall((text or "").translate(lower))
        scored = []
        for d, c in read:
            m = 100 - 25 + ((25 * sum(c.values()) * n_docs) // n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in q if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        found += [(k, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:20], 1)]
    return sorted(found, key=str)


def test_search_edge_rows(spark):
    items = [(1, "the cat"), (2, None), (3, "?!"), (None, "ärger x1 x1 CAT"), (1, "the cat"), (4, "absent")]
    docs = spark.createDataFrame(DOC_ROWS, DOCS)
    bench = spark.createDataFrame([(k, t, "s") for k, t in items], "item_id bigint, text string, score string")
    got = sorted((tuple(r) for r in lexical.ranked_search(docs, bench).collect()), key=str)
    assert got == _search([(r[0], r[1]) for r in DOC_ROWS], items)
    assert lexical.ranked_search(docs.limit(0), bench).count() == 0
    assert lexical.ranked_search(docs, bench.limit(0)).count() == 0


def test_search_in_small_blocks_and_shards(spark, monkeypatch):
    """Many blocks of items and many trees give the rows of one."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").limit(9)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 100)
    got = sorted((tuple(r) for r in lexical.ranked_search(docs, bench).collect()), key=str)
    assert got == _search([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])


def test_bounds_hold_and_prune():
    """No row exceeds the bound of any node above it, and whole subtrees are never scored."""
    rng = np.random.default_rng(3)
    n, width = 3000, 400
    topics = rng.integers(0, 12, n)
    lists = [np.unique(np.concatenate([rng.integers(0, 40, 6), 40 + 30 * t + rng.integers(0, 30, 12)])) for t in topics]
    corpus = lexical.Corpus.of(n, n * 20, np.bincount(np.concatenate(lists), minlength=width))
    lists = [np.sort(corpus.place[d]) for d in lists]
    values = [corpus.impacts(20, d, rng.integers(1, 6, len(d))) for d in lists]
    rows = lexical.Rows(np.arange(n), np.concatenate([[0], np.cumsum([len(d) for d in lists])]), np.concatenate(lists), np.concatenate(values))
    tree = lexical.build(rows, corpus.bands)
    items = [np.sort(corpus.place[np.unique(40 + 30 * t + rng.integers(0, 30, 8))]) for t in range(12)]
    items = [(d, np.ones(len(d), dtype=np.int64)) for d in items]
    queries = lexical.Queries.of(items, corpus.bands)
    limits = lexical.bounds(tree, queries)
    for q, (d, c) in enumerate(items):
        dense = np.zeros(width, dtype=np.int64)
        dense[d] = c
        scores = tree.rows.dot(dense)
        assert all(scores[k.start : k.stop].max() <= limits[q, i] for i, k in enumerate(tree.nodes))
    best = [lexical.Best() for _ in items]
    scored = lexical.search(tree, queries, best)
    assert scored < 0.5 * n * len(items)


LABELS = "doc_id bigint, quality int, toxic int"


def test_audit_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filters, "RANGE", 3)
    upper = "A B C " + "word " * 250
    more = [(20 + i, upper, "s", "s", "r", "p") for i in range(3)] + [(None, upper, "s", "s", "r", "p"), (20, upper, None, "s", "r", "p")]
    more += [(40 + i, " ".join(f"w{j % (i * 60 + 60)}" for j in range(300)) + " #" * (i % 2), "t", "s", "r", "p") for i in range(6)]
    docs, labels = DOC_ROWS + more, [(5, 1, 0), (5, 0, 1), (20, 1, 1), (21, 0, 0), (41, 1, None), (None, 1, 1), (999, 1, 1)]
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}

    def fails(d, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [x for x, u, *_ in docs if (u or "") == t and x is not None]
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)}
        return found | {"D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and any(x < d for x in same)}

    table = [(s or "", d, fails(d, t)) for d, t, s, *_ in docs]
    want = {}
    for part in {p for p, _, _ in table}:
        rows = [(d, f) for p, d, f in table if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                out = [r for r in left if r[1][f]]
                earlier = sum(r[1][f] and any(r[1][g] for g in order[: step - 1]) for r in rows)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(out)
                want[part, "".join(order), step] = (len(left), len(out), earlier, unique, sum(r[0] in good for r in out), sum(r[0] in toxic for r in out))
        want |= {k: (*v, shapley[k[1][k[2] - 1]]) for k, v in want.items() if k[0] == part}
    got = filters.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], DOCS)
    assert filters.audit(none, spark.createDataFrame(labels, LABELS)).count() == 0
    assert filters.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).agg(F.sum("good_lost")).first()[0] == 0
