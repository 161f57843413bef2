import numpy as np
from conftest import SF_MID

from ohlcflow.llm import language_id, quality_knn
from ohlcflow.llm.queries import QUERIES
from pyspark.sql import functions as F
from llm_cases import edge_docs, no_docs  # noqa: F401


def test_language_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF_MID)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    r = got.join(docs, "doc_id").filter("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score"), F.max("score")).first()
    assert r.right > 0.97 and 0 <= r[1] <= r[2] <= 1
    assert got.count() == docs.count()


def test_language_edges(spark, edge_docs, no_docs):
    learn = spark.createDataFrame([(1, "the house is old", "en"), (2, "das haus ist alt", "de"), (3, "x", None),
                                   (4, None, "fr"), (None, "the old the house", "en")], "doc_id long, text string, lang string")
    model = language_id.fit(learn)
    assert model.languages == ["de", "en", "fr"]
    texts = [None, "", "123 !?", "the", "hauses", "THE OLD house", "日本"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d, model).collect()}
    assert [got[i][0] for i in range(6)] == ["und", "und", "und", "en", "de", "en"] and got[0][1] == 0.0
    assert got[6][0] == "de"  # nothing known: equal sums, the language that sorts first
    assert language_id.predict(edge_docs, model).count() == edge_docs.count()
    nothing = language_id.fit(learn.limit(0))
    assert {r.lang_pred for r in language_id.predict(d, nothing).collect()} == {"und"}
    assert language_id.predict(no_docs, model).collect() == []


def test_backoff_takes_longest_known(spark):
    learn = spark.createDataFrame([(1, "abcde abcdx", "a"), (2, "xyzzy", "b")], "doc_id long, text string, lang string")
    m = language_id.fit(learn)
    (_, w), = language_id.word_runs(["abcdq"])
    scores = m.word_scores(w, np.arange(1))
    h, _ = language_id.grams(w, np.arange(1), 5)
    row = m.find(5, h)
    assert (row >= 0).any()
    assert np.allclose(scores[0], m.scores[5][row[row >= 0]].mean(axis=0))


def plain_model(rows):
    """Counts of words and marked n-grams by language, as the module's text says them."""
    import collections
    import unicodedata
    counts = collections.defaultdict(collections.Counter)

    def words(text):
        return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()

    def parts(word, n):
        marked = "<" + word + ">"
        return list(word) if n == 1 else [marked[i:i + n] for i in range(len(marked) - n + 1)]

    for text, lang in rows:
        for word in words(text or ""):
            counts[lang, 0][word] += 1
            for n in range(1, 6):
                counts[lang, n].update(parts(word, n))
    langs = sorted({lang for _, lang in rows})
    known = [set().union(*(counts[x, k] for x in langs)) for k in range(6)]
    log = lambda lang, k, x: np.log((counts[lang, k][x] + .5) / (sum(counts[lang, k].values()) + len(known[k]) + 1))

    def predict(text):
        total = np.zeros(len(langs))
        for word in words(text):
            for k in (0, 5, 4, 3, 2, 1):
                have = [x for x in ([word] if k == 0 else parts(word, k)) if x in known[k]]
                if have:
                    total += [np.mean([log(lang, k, x) for x in have]) for lang in langs]
                    break
        share = np.exp(total - total.max())
        return langs[int(total.argmax())], float(1 / share.sum())
    return predict


def test_language_predictions_by_brute_force(spark):
    """A hundred languages, each with words of its own and shared ones: every prediction from plain counts."""
    rng = np.random.default_rng(4)
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéß"), rng.integers(1, 7))) for _ in range(400)]
    langs = [f"l{i:03d}-{'AB'[i % 2]}" for i in range(100)]
    own = {lang: rng.choice(stems, 25) for lang in langs}
    text = lambda lang, n: " ".join(rng.choice(own[lang], n))
    rows = [(text(lang, rng.integers(3, 30)), lang) for lang in langs for _ in range(4)]
    learn = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(learn.repartition(5))
    assert model.languages == langs
    ask = [text(lang, n) for lang in langs[::3] for n in (1, 4, 40)] + ["zzqx bcd éé", "Aß, aß!", "q" * 50, "日本 abc"]
    plain = plain_model(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(
        spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string").repartition(3), model).collect()}
    for i, t in enumerate(ask):
        lang, score = plain(t)
        assert abs(got[i][1] - score) < 1e-4, (t, got[i], lang, score)
        assert got[i][0] == lang or abs(score - 0.5) < 1e-3, t


def test_quality_held_out(spark):
    got = QUERIES["op9_quality_knn"](spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    r = got.join(labels, "doc_id").filter("held_out").agg(
        F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right")).first()
    assert r.right > 0.95
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def plain_terms(text):
    """Hashed terms of one text, counted word by word."""
    import math
    import re

    def slot(value, salt, slots):
        x, m = (value + (salt << 40)) % (1 << 64), (1 << 64) - 1
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return (x ^ x >> 31) % slots

    n, m = quality_knn.TRIGRAM_TERMS, quality_knn.STYLE_TERMS
    tri, style = [0.0] * n, [0.0] * m
    words = re.findall(rb"[^\x00\x20\x09-\x0D]+", text.encode())
    kind = lambda b: ord("a") if b >= 0x80 or 0x61 <= b <= 0x7A else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    for i, w in enumerate(words):
        low = b"\0" + w.lower() + b"\0"
        for k in range(len(w)):
            tri[slot(low[k] << 16 | low[k + 1] << 8 | low[k + 2], 1, n)] += 1
        shape = [kind(b) for b in w]
        shape = [b for k, b in enumerate(shape) if not k or b != shape[k - 1]]
        style[slot(sum((b + 1) * pow(0x100000001B3, k, 1 << 64) for k, b in enumerate(shape)) % (1 << 64), 2, m)] += 1
        style[0] += i > 0 and w == words[i - 1]
    repeats = len(words) - len(set(words))
    style[1] += repeats
    weight = 3 + len(words) / 4
    style[slot(int(min(math.log2(len(words) + 1), 6)), 3, m)] += weight
    style[slot(int(10 * repeats / max(len(words), 1)), 4, m)] += weight
    return np.log1p(np.array(tri + style))


def test_quality_terms_by_brute_force():
    """Every text's counts are its own, whatever texts stand beside it."""
    import pyarrow as pa
    rng = np.random.default_rng(6)
    texts = ["", "abc", "def", "  ", "Ab12-x Ab12-x\té é, END", "x"] + [
        " ".join("".join(rng.choice(list("abcXYZ019.,é"), rng.integers(1, 6))) for _ in range(rng.integers(0, 40)))
        for _ in range(40)]
    got = quality_knn.term_counts(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_terms(text), atol=1e-5), text


def test_quality_equals_plain_voting(spark):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 3, (40, quality_knn.TRIGRAM_TERMS + quality_knn.STYLE_TERMS)).astype(np.float32)
    labels = np.arange(40) % 2
    m = quality_knn.fit_matrix(counts, labels, {0: 1.0, 1: 2.0}, 5)
    ask = rng.integers(0, 3, (7, counts.shape[1])).astype(np.float32)
    z = m.weighted(ask) @ m.basis
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for row, got in zip(z, m.score(ask), strict=True):
        cos = m.vectors @ row
        best = [i for i in range(40) if cos[i] >= np.sort(cos)[-5] and cos[i] > 0]
        votes = [(cos[i] * (1 + labels[i]), labels[i]) for i in best]
        want = sum(v for v, y in votes if y) / sum(v for v, _ in votes) if votes else m.prior
        assert abs(want - got) < 1e-5


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(6, 1), (6, 0), (12, 1), (10, 0), (None, 1), (2, None), (4, 7)],
                                   "doc_id long, label int")
    m = quality_knn.fit(edge_docs, labels)
    got = quality_knn.score(edge_docs, m)
    assert got.columns == [c for c in edge_docs.columns if c != "quality_score"] + ["quality_score"]
    assert got.count() == edge_docs.count() and got.filter("quality_score IS NULL").count() == 0
    assert quality_knn.score(no_docs, m).collect() == []
    none = quality_knn.fit(edge_docs, labels.limit(0))
    assert {r.quality_score for r in quality_knn.score(edge_docs, none).collect()} == {0.5}
