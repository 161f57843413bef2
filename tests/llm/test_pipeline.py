import hashlib

import pytest
from conftest import SF_SMALL
from test_dedup import brute_fingerprint, brute_overlaps, brute_repeats, components
from tokenizers import Tokenizer

import corpus_pipeline as P
from ohlcflow.llm.queries import ORACLE, QUERIES, word_bpe
from ohlcflow.session import scratch_table
from llm_cases import edge_docs  # noqa: F401


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    good, one, cut, clean, coded = [f for _, f in P.STAGES]
    d1 = scratch_table(good(spark, docs, SF_SMALL), "t1")
    scored = {r.doc_id: r.predicted for r in QUERIES["op9_quality_knn"](spark, SF_SMALL).collect()}
    assert [d for d, _ in rows(d1)] == sorted((d for d, y in scored.items() if y), key=repr)
    d2 = scratch_table(one(spark, d1, SF_SMALL), "t2")
    before = rows(d1)
    group = components([d for d, _ in before], [brute_fingerprint(t) for _, t in before], 4)
    assert [d for d, _ in rows(d2)] == sorted(set(group), key=repr)
    d3 = scratch_table(cut(spark, d2, SF_SMALL), "t3")
    left = brute_repeats(rows(d2), 200)
    gone = {d for d, n, removed, _, _ in left if n and n == removed}
    assert {d for d, _ in rows(d3)} == {d for d, _ in rows(d2)} - gone
    assert {hashlib.sha256(t.encode()).hexdigest() for _, t in rows(d3)} & {x[4] for x in left if not x[2]}
    assert all(r.n_chars == len(r.text) for r in d3.collect())
    d4 = scratch_table(clean(spark, d3, SF_SMALL), "t4")
    leaked = {x[0] for x in brute_overlaps(rows(d3), items, 12, 2, 5)}
    assert [d for d, _ in rows(d4)] == [d for d, _ in rows(d3) if d not in leaked]
    for d in (d1, d2, d3, d4):
        assert d.columns == docs.columns
    library = Tokenizer.from_file(word_bpe())
    texts = dict(rows(d4))
    last = coded(spark, d4, SF_SMALL).collect()
    assert len(last) == len(texts)
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in last)


def test_stages_on_edges(spark, edge_docs):
    for docs in (edge_docs, edge_docs.limit(0)):
        for _, stage in P.STAGES:
            out = stage(spark, docs, SF_SMALL)
            assert stage is P.STAGES[-1][1] or out.columns == docs.columns
            assert out.count() <= docs.count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_cover_every_document(spark, name):
    got = QUERIES[name](spark, SF_SMALL)
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_workspaces_go_with_the_scratch_tables(spark):
    import os
    from ohlcflow.llm.common import Workspace
    from ohlcflow.session import drop_scratch_tables
    work = Workspace(spark, "probe")
    assert work.table(spark.range(3), "t").count() == 3
    folder = work.folder.removeprefix("file:")
    assert os.path.isdir(folder) and drop_scratch_tables(spark) and not os.path.exists(folder)
