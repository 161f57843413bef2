import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ohlcflow.llm import centroid_cluster, html_text, periodic_runs, queries
from llm_cases import edge_docs, no_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- periodic runs -------------------------------------------------------------------------


def brute_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n", max_size=60), max_size=4), st.sampled_from([2, 4, 12]))
def test_runs_of_any_texts(texts, least):
    for text, (n, runs, left) in zip(texts, periodic_runs.judge_texts([t.encode() for t in texts], least), strict=True):
        words = WORD.findall(text)
        want = brute_runs(words, least)
        assert n == len(words) and sorted(zip(*(x.tolist() for x in runs), strict=True)) == want
        assert left.decode() == brute_collapsed(words, want)


def test_runs_in_long_and_periodic_texts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PORTION", 1000)
    rng = random.Random(4)
    texts = []
    for k in (1, 2, 5, 40, 300):
        words = [f"w{rng.randrange(k)}" for _ in range(400)]
        a, p = rng.randrange(200), rng.randrange(1, 60)
        texts.append([words[i] if i < a else words[a + (i - a) % p] for i in range(400)])
    fib = ["a", "b"]
    while len(fib) < 500:
        fib = fib + fib[:len(fib) * 5 // 8]
    texts.append(fib)
    for words, (_, runs, left) in zip(texts, periodic_runs.judge_texts([" ".join(w).encode() for w in texts]),
                                      strict=True):
        want = brute_runs(words)
        assert sorted(zip(*(x.tolist() for x in runs), strict=True)) == want
        assert left.decode() == brute_collapsed(words, want)
    (_, runs, left), = periodic_runs.judge_texts([b"x " * 100_000])
    assert [x.tolist() for x in runs] == [[0], [100_000], [1]] and left == b"x"


def test_common_prefixes_both_ways():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 2, 200)
    array = periodic_runs.SuffixArray(s, 2)
    text = s.tolist()
    assert array.order.tolist() == sorted(range(200), key=lambda i: text[i:])
    a, b = rng.integers(0, 200, 300), rng.integers(0, 200, 300)
    a, b = a[a != b], b[a != b]
    forward = [next((k for k in range(200) if max(i, j) + k >= 200 or text[i + k] != text[j + k]), 0)
               for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    back = [next(k for k in range(201) if min(i, j) - k <= 0 or text[i - k - 1] != text[j - k - 1])
            for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert array.common(a, b).tolist() == forward and array.common(a, b, -1).tolist() == back


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digests(doc_id, text):
    words = planted(doc_id, text)
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    a, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), a, n, q, n and 1000 * n // q, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
            sha(brute_collapsed(words, runs)))


def test_periodic_runs_query(spark, edge_docs, tmp_path):
    rng = random.Random(8)
    tenth = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " \n".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))))
            for i in [*tenth, *range(100)]]
    docs = edge_docs.filter("doc_id IS NULL OR doc_id <> 10").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()),
        key=repr)
    assert got == sorted((digests(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_runs_of_no_documents(no_docs):
    assert periodic_runs.find_runs(no_docs).collect() == []


# -- centroid clustering -------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seeds = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}") if r[0] is not None else "", r[1]))[:k]
    cents = [e for _, e in seeds]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(e):
        d = [dist(e, c) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = {}
        for _, e in kept:
            own.setdefault(nearest(e)[0], []).append(e)
        for c, es in own.items():
            cents[c] = [sum(x) // len(es) for x in zip(*es, strict=True)]
    out = [(i, *nearest(e)) for i, e in kept]
    limit = lambda x: x if x < 1 << 63 else None
    per = {c: sum(d for _, q, d in out if q == c) for c in range(len(cents))}
    return sorted(((i, c, limit(d), limit(per[c]), limit(sum(per.values())), sha(",".join(map(str, cents[c]))))
                   for i, c, d in out), key=repr)


@pytest.mark.parametrize("spread", [1.0, 0.01, 1e12])
def test_clusters_by_brute_force(spark, spread):
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.gauss(0, spread), float(rng.randint(-2, 2)) * spread]) for _ in range(4)])
            for i in range(150)]
    rows += [(150, None), (151, [1.0] * 3), (152, [1.0, None, 1.0, 1.0]), (153, [1.0, math.nan, 1.0, 1.0]),
             (154, [1.0, math.inf, 1.0, 1.0]), (None, [spread] * 4), (7, [spread] * 4), (7, [spread] * 4), (155, [])]
    rows += [(200 + i, [0.5] * 4) for i in range(40)]  # one vector many times
    table = spark.createDataFrame([(i, e, "x", 1) for i, e in rows],
                                  "vec_id long, embedding array<double>, cluster string, inertia int").repartition(5)
    got = centroid_cluster.cluster(table, k=6, rounds=3, dimensions=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, 6, 3, 4)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.4e38, -3.4e38])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroid_cluster.cluster(table, k=40, rounds=2, dimensions=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, 40, 2, 2)
    assert centroid_cluster.cluster(table.limit(0), dimensions=2).collect() == []
    assert centroid_cluster.cluster(table).collect() == []  # none has 64 components


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 4), st.data())
def test_threshold_algorithm(k, dims, data):
    near = st.integers(-3, 3) | st.integers(-10**30, 10**30)
    cents = data.draw(st.lists(st.lists(near, min_size=dims, max_size=dims), min_size=k, max_size=k))
    vectors = data.draw(st.lists(st.lists(near, min_size=dims, max_size=dims), max_size=5))
    number, distance = centroid_cluster.SortedLists(cents).nearest(np.array(vectors, dtype=object).reshape(-1, dims))
    for v, c, d in zip(vectors, number, distance, strict=True):
        all_ = [sum((x - y) ** 2 for x, y in zip(v, q, strict=True)) for q in cents]
        assert d == min(all_) and c == all_.index(min(all_))


@given(st.lists(st.integers(-10**60, 10**60), min_size=1, max_size=5))
def test_limbs(totals):
    limbs = centroid_cluster.limbs_of(totals)
    assert [sum(x[i] << (40 * p) for p, x in enumerate(limbs)) for i in range(len(totals))] == totals
    assert all(abs(x) < 1 << 41 for limb in limbs for x in limb)


# -- main text of pages --------------------------------------------------------------------

PRIOR = html_text.Weights({}, {})
LONG = "Enough words to outweigh the tags that stand around them in this paragraph of the article."


@pytest.mark.parametrize("page, want", [
    ("", ""), ("   ", ""), ("no markup at all", "no markup at all"), ("<nav>menu words</nav>", ""),
    (f"<div><p>{LONG}</p><p>a &amp; b &lt;c&gt; &quot &nbsp; x&#233;</p></div>", f'{LONG}\na & b <c> " xé'),
    (f"<header>Site name</header><h1>Title here now</h1><p>{LONG}<p>two<br>lines <b>bo<i>ld</b></p><footer>x y</footer>",
     f"Title here now\n{LONG}\ntwo lines bold"),
    (f"<p>{LONG}</p><aside class=x>side bar words</aside><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    (f"<p>{LONG}</p><div class='user-comments'><article><p>{LONG} {LONG}</p></article></div>", LONG),
    (f"<p>{LONG}</p><form>Name <input value='a > b'> <button>go</button></form>", LONG),
    (f"<div class='page has-sidebar'><p>{LONG}</p></div><div id=\"cookie_notice\">We use cookies</div>", LONG),
    (f"<script>var t = '</p> words words';</script><style>p {{}}</style><p>{LONG}</p><!-- <p>gone</p> -->", LONG),
    (f"<nav>never closed <article><p>{LONG}</p></article>", LONG),
    (f"<aside><article><p>{LONG}</p></article></aside>", ""),
    (f"<article><header><h1>Own header of it</h1></header><p>{LONG}</p></article>", f"Own header of it\n{LONG}"),
    (f"<p>{LONG}</p><script>cut off", LONG), (f"<p>{LONG}</p><p class=\"x", LONG), (f"<p>1 < 2 {LONG}</p>", f"1 < 2 {LONG}"),
    (f"<ul><li>one two<li>three four<li>{LONG}</ul>", f"one two\nthree four\n{LONG}"),
    (f"<p title=\"a > b\">{LONG}</p>", LONG), (f"<p>{LONG}\x0b\x0c \x85 tail end</p>", f"{LONG} tail end"),
])
def test_page(page, want):
    assert html_text.main_text(page, PRIOR) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ap divnscript=\"' &;\n", max_size=80))
def test_any_markup(page):
    text = html_text.main_text(page, PRIOR)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and "\n\n" not in text


@given(st.lists(st.sampled_from([-2.0, -0.5, 0.0, 1.0, 3.0]), max_size=12))
def test_best_stretch(scores):
    a, b = html_text.best_stretch(scores)
    sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]
    assert sum(scores[a:b]) == max(sums, default=0)


def plain_reading(page):
    body = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = [re.sub("<[^>]*>", "", x.replace("<br>", " ")) for x in re.split("</?(?:p|h1)>", body)]
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_given_pages_with_and_without_their_label(spark):
    """Weights learned from labelled pages find the same text once the label element is gone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    held = pages.filter("page_id % 2 = 1")
    weights = html_text.fit(pages.filter("page_id % 2 = 0"))
    want = {r.page_id: plain_reading(r.html) for r in held.collect()}
    plain = held.selectExpr("page_id", "url", "replace(replace(html, '<article>', '<div>'), '</article>', '</div>') AS html")
    for rows in (held, plain):
        assert {r.page_id: r.text for r in html_text.extract(rows, weights).collect()} == want


def test_pages_edges(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", f"<p>{LONG}</p>"), (2, "u", f"<p>{LONG}</p>"),
            (3, "v", "<p>" + LONG * 20_000 + "</p>"), (4, "w", "<div>" * 50_000 + LONG + "</span>" * 50_000)]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n int")
    weights = html_text.fit(pages)  # no labelled page: priors
    assert weights == PRIOR
    got = sorted(((r.page_id, r.text) for r in html_text.extract(pages, weights).collect()), key=repr)
    assert got == sorted([(1, ""), (None, ""), (2, LONG), (2, LONG), (3, LONG * 20_000), (4, LONG)], key=repr)
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).collect() == []
