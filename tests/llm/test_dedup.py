import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa
import xxhash

from ohlcflow.llm import decontaminate, graph, queries, simhash, suffix_dedup
from pyspark.sql import functions as F
from llm_cases import edge_docs, no_docs  # noqa: F401


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(docs, **options):
    return sorted(map(tuple, suffix_dedup.remove_repeats(docs, **options).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


def test_suffix_dedup_many_blocks_and_ranges(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice(["ab", "cde", "f", "éà", "ghij"]) for _ in range(60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "a"), (None, base[0]), (30, base[0]), (30, base[0]), (31, "xy" * 150),
            (32, base[1][:50] + "ZZZ" + base[2][20:90]), (33, "q" * 100)] + [(10 + i, x) for i, x in enumerate(base)]
    for i in range(20):
        parts = [rng.choice(base)[(k := rng.randrange(40)):k + rng.randrange(60)] + rng.choice(["", "-", "##"])
                 for _ in range(5)]
        rows.append((100 + i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(docs, length=12, block=700, keys=300) == brute_repeats(rows, 12)


def test_suffix_dedup_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert removed(edge_docs) == brute_repeats(rows, 200)
    assert removed(no_docs) == []
    left = suffix_dedup.rewrite(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == len(rows)
    assert {r.doc_id: r.text for r in left.collect()}[4] == "a"


def test_window_minimum_of_equal_hashes():
    data = np.frombuffer(b"ab" * 300 + b"short" + b"ab" * 30, dtype=np.uint8)
    text, begin, end, _, _ = suffix_dedup.segments(data, np.array([0, 600, 605, 665]), 20)
    assert set(text) == {0, 2}
    for t, size in ((0, 600), (2, 60)):
        b, e = begin[text == t], end[text == t]
        assert b[0] == 0 and e[-1] == size - 19 and (b[1:] == e[:-1]).all()


def test_squeeze():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 1 << 62, 999)).astype(np.uint64), rng.integers(0, 1 << 63, 999).astype(np.uint64) * 2,
               np.ones(999, dtype=np.uint64), np.zeros(999, dtype=np.uint64)]
    body = pa.scalar(suffix_dedup.squeeze(columns), pa.binary())
    assert (suffix_dedup.unsqueeze(body, 999) == np.stack(columns)).all()


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, values, distance):
    best = list(range(len(ids)))

    def find(x):
        while best[x] != x:
            x = best[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                best[find(i)] = find(j)
    group = {}
    for i, d in enumerate(ids):
        group.setdefault(find(i), []).append(d)
    return [min((d for d in group[find(i)] if d is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("share", [1, 5, 200])
def test_simhash(edge_docs, no_docs, monkeypatch, share):
    monkeypatch.setattr(simhash, "HOT_SHARE", share)  # no, some and all fingerprints are joined by broadcast
    got = simhash.near_duplicates(edge_docs).collect()
    rows = edge_docs.collect()
    values = [brute_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], values, components([r.doc_id for r in rows], values, 4), strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.representatives(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len({r.root for r in got})
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.representatives(no_docs).collect() == []


def test_links_by_ball_search(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(5)}
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    want = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4}
    for segments in (2, 3):
        got = [frozenset((r.u % (1 << 64), r.v % (1 << 64))) for r in simhash.links(nodes, 4, segments).collect()]
        assert set(got) == want and len(got) == len(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 502), (7, 7), (900, 901), (900, 901), (None, 3)]
    edges = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500, 502: 500, 900: 900, 901: 900}
    assert graph.connected_components(edges.limit(0)).collect() == []


def brute_overlaps(docs, items, window, substitutions, least):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = {}
    for d, t in docs:
        dw = words(t)
        for item, x in items:
            iw = words(x)
            n = min(window, len(iw))
            if n < least:
                if n and dw == iw:
                    found[d, item] = ({0}, [n])
                continue
            allowed = min(substitutions * n // window, n - 2)
            for p in range(len(dw) - n + 1):
                for q in range(len(iw) - n + 1):
                    equal = sum(a == b for a, b in zip(dw[p:p + n], iw[q:q + n], strict=True))
                    if n - equal <= allowed:
                        places, best = found.setdefault((d, item), (set(), []))
                        places.add(p)
                        best.append(equal)
    return {(d, i, len(p), min(p), max(p), max(b)) for (d, i), (p, b) in found.items()}


def test_decontamination(spark, edge_docs):
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(n))) for i, n in enumerate((40, 13, 12, 11, 8, 6, 5, 25, 25))]
    items += [(30, "w1 w2 w3 w4"), (31, "yes"), (32, "w7 w8")]
    items += [(20, None), (21, ""), (22, items[0][1])]
    docs = [(r.doc_id, r.text if len(r.text or "") < 2000 else "long") for r in edge_docs.collect()]
    for i in range(40):
        text = items[rng.randrange(9)][1].split()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(voc)
        text = text[rng.randrange(3):]
        docs.append((100 + i, " ".join(rng.choice(voc) for _ in range(9)) + ", " + " ".join(text).upper() + "!"))
    docs += [(200, "say: " + items[5][1] + "."), (201, items[6][1]), (202, "W1 w2, w3 w4!"), (203, "w1 w2 w3 w4 w5"),
             (204, "Yes."), (205, "yes yes"), (206, "w7-w8")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.overlaps(d, b).collect()}
    assert got == brute_overlaps(docs, items, 12, 2, 5)
    assert {(200, 5, 1, 1, 1, 6), (201, 6, 1, 0, 0, 5), (202, 30, 1, 0, 0, 4), (204, 31, 1, 0, 0, 1), (206, 32, 1, 0, 0, 2)
            } <= got and not {203, 205} & {g[0] for g in got if g[1] >= 30}
    # the registered SQL says the same
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert set(con.execute(queries.ORACLE["op8_decontaminate"]).fetchall()) == got
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {x for x, _ in docs} - {g[0] for g in got}
    assert decontaminate.overlaps(d, b.limit(0)).collect() == [] and decontaminate.overlaps(d.limit(0), b).collect() == []


def test_clean_rows_stay_beside_leaked_rows_of_their_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, "see " + item), (None, "clean"), (None, None), (1, item.upper()), (1, "clean"), (1, "clean"), (2, item),
            (2, item), (3, "clean")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.clean(d, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(map(tuple, left.collect()), key=repr) == sorted((r for r in rows if "0" not in (r[1] or "")), key=repr)


def test_rewrite_of_a_text_that_goes_whole(spark):
    """Nothing left: null, also where the column was declared to hold none."""
    text = "all of this goes " * 20
    docs = spark.createDataFrame([(1, text), (2, text), (3, "stays")], "doc_id long, text string")
    left = suffix_dedup.rewrite(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, None), (2, None), (3, "stays")}
    assert left.filter("text IS NOT NULL").withColumn("n", F.length("text")).count() == 1
