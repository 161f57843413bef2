import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ohlcflow.llm import bpe, token_files
from ohlcflow.llm.queries import word_bpe
from llm_cases import edge_docs, no_docs  # noqa: F401


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(word_bpe())


CASES = ["", " ", "a", "don't!'s 'S 're", "ΑΣ ΣΑΣ Σ", "İstanbul", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>",
         "é ́x H̱", "a\x1cb\x1d \x1f", "x\xa0y z\x85w\x0b\x0c", "a" * 300, "12345", "日本語", "ﬁ ẞ",
         "\U0001F600\U0001F600", "ǅ ǲ", "word, word. word.' word's."]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_and_tokens_as_library(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert token_files.encode_texts([text], word_bpe(), "<u4", True)[0] == np.array(ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = Tokenizer.from_file(word_bpe()).encode(text, add_special_tokens=False).ids if len(text) % 7 == 0 else None
    mine = bpe.remembered(word_bpe())[0].encode(text)
    if ids is not None:
        assert mine == ids
    assert token_files.encode_texts([text], word_bpe(), "<u4", True)[0] == np.array(mine, "<u4").tobytes()


def test_digests(edge_docs, library):
    got = sorted(map(tuple, bpe.digests(edge_docs, word_bpe()).collect()), key=repr)
    want = []
    for r in edge_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_ids_and_decoding(edge_docs, library):
    encoded = bpe.encode_documents(edge_docs, word_bpe())
    for r in encoded.join(bpe.decode_documents(encoded, word_bpe()), "doc_id").collect():
        assert r.text == library.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids)


def test_token_files(spark, edge_docs, library):
    out, manifest = token_files.write(edge_docs, word_bpe(), by_piece=True, shards=4)
    got = token_files.documents(spark, out).orderBy("start").collect()
    rows = sorted(edge_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at, by_id = 0, {}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        by_id.setdefault(r.doc_id, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        at += r.n_tokens
    assert sum(m.n_docs for m in manifest.collect()) == len(rows)


def test_token_files_whole_texts_equal(spark, edge_docs):
    def read(by_piece):
        out, _ = token_files.write(edge_docs, word_bpe(), by_piece=by_piece, shards=2)
        return sorted(map(tuple, token_files.documents(spark, out).collect()), key=repr)
    assert read(True) == read(False)


def test_empty_tables(spark, no_docs):
    assert bpe.digests(no_docs, word_bpe()).collect() == []
    out, _ = token_files.write(no_docs, word_bpe())
    assert token_files.documents(spark, out).collect() == []


def test_by_piece_refuses_other_vocabularies(spark, tmp_path):
    from tokenizers import models, pre_tokenizers
    t = Tokenizer(models.BPE({"a": 0, "b": 1, "Ġ": 2, "Ġa": 3}, [("Ġ", "a")]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other = str(tmp_path / "other.json")
    t.save(other)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert token_files.encodes_by_piece(word_bpe()) and not token_files.encodes_by_piece(other)
    with pytest.raises(ValueError):
        token_files.write(docs, other, by_piece=True)


def test_flat_file_reads_ranges(tmp_path, monkeypatch):
    import pyarrow.fs as pafs
    data = np.arange(1000, dtype="<u4")
    (tmp_path / "x.bin").write_bytes(data.tobytes())
    mapped = token_files.FlatFile(str(tmp_path), "x.bin", "<u4")
    monkeypatch.setattr(token_files, "file_system", lambda p: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), p))
    ranged = token_files.FlatFile(str(tmp_path), "x.bin", "<u4")
    assert ranged.mapped is None
    for a, z in ((0, 1000), (5, 5), (990, 1000)):
        assert (mapped[a:z] == ranged[a:z]).all() and len(ranged[a:z]) == z - a


def test_long_words_equal_the_library(library):
    """Words of thousands of symbols, whose last merges go number by number, beside short ones."""
    import random
    rng = random.Random(9)
    own = bpe.Bpe(word_bpe())
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "é\u00dfx")
             for n in (255, 256, 257, 3000)] + ["ha" * 5000, "x" * 20_000, "the " * 50 + "z" * 400]
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
