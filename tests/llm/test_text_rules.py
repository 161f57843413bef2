import hashlib
import re

import pytest

from ohlcflow.llm import chat_format, license_scan, quality_rules
from pyspark.sql import functions as F
from llm_cases import edge_docs, no_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 5000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered


def test_quality_counts(edge_docs):
    for r, d in [(r, d) for r in quality_rules.judge(edge_docs).collect() for d in edge_docs.collect()
                 if (r.doc_id, r.text) == (d.doc_id, d.text or "")]:
        n, chars, symbols, copies, covered = counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, copies)
        if covered is not None:
            assert r.n_repeat_words == len(covered)
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert r.kept == (r.failed_rule is None) and not (r.base_failed and r.kept)


def test_rule_order_changes_no_verdict(edge_docs):
    measured = quality_rules.measure(edge_docs)
    rules = list(quality_rules.RULES)
    one, two = (sorted((r.doc_id or 0, r.kept) for r in quality_rules.cascade(measured, x).collect())
                for x in (rules, rules[::-1]))
    assert one == two
    assert {r.name for r in quality_rules.order_rules(measured)} == {r.name for r in rules}


def test_rule_order_does_not_follow_the_table(spark):
    """Rows sorted by quality and shuffled rows: the same sample, so the same order of rules."""
    good, bad = "plain words of a text " * 20, "!!! AAAA BBBB ### " * 30
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 < 3, bad).otherwise(good).alias("text"))
    orders = [[r.name for r in quality_rules.order_rules(quality_rules.measure(d), sample_rows=300)]
              for d in (docs.orderBy("text", "doc_id"), docs.orderBy(F.xxhash64("doc_id")), docs.repartition(7))]
    assert orders[0] == orders[1] == orders[2]


def test_quality_empty(no_docs):
    assert quality_rules.judge(no_docs).collect() == []


@pytest.mark.parametrize("tokens, want", [
    ("MIT OR ( Apache-2.0 AND BSD-3-Clause )", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]),
    ("GPL-2.0 WITH Classpath OR MIT", ["GPL-2.0", "Classpath", "with", "MIT", "or"]),
    ("MIT OR", None), ("( MIT", None), ("MIT )", None), ("MIT Apache-2.0", None), ("", None)])
def test_shunting_yard(tokens, want):
    assert license_scan.postfix(tokens.split()) == want


@pytest.mark.parametrize("line, names, free, parsed", [
    ("MIT OR GPL-3.0-only", {"mit", "gpl"}, True, True),
    ("MIT AND GPL-3.0-only", {"mit", "gpl"}, False, True),
    ("Apache-2.0 */ int main", {"apache-2"}, True, True),
    ("(MIT", {"mit"}, False, False), ("nothing known", set(), False, False)])
def test_expressions(line, names, free, parsed):
    assert license_scan.read_expression(line) == (names, free, parsed)


def test_broken_expression_names_all_its_licences():
    line = "(MIT OR Apache-2.0 OR BSD-3-Clause OR GPL-2.0-only OR ISC"
    assert license_scan.read_expression(line) == ({"mit", "apache-2", "bsd", "gpl", "isc"}, False, False)
    assert license_scan.read_expression("a b c d e f g h i zlib") == ({"zlib"}, False, False)
    assert license_scan.read_expression("(" * 200_000 + "MIT") == ({"mit"}, False, False)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x for _, x in places})))


def test_license_scan(spark, edge_docs):
    texts = ["Under the MIT license", "x under the mit license, CC-BY-NC! cc by nc. apache license\nversion 2",
             "under the mit licensed", "SPDX-License-Identifier: MIT OR (GPL-2.0 AND BSD-3-Clause)\nfoo",
             "// spdx license identifier: (broken\nSPDX-License-Identifier: Apache-2.0", "éunder the mit license",
             "under the mit license under the mit license"]
    d = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(
        edge_docs.select("doc_id", "text"))
    auto = license_scan.build_automaton()
    rows = {(r.doc_id, tuple(r)[1:6]) for r in license_scan.scan(d).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()}
    assert rows == {(r.doc_id, brute_base(r.text)) for r in d.collect()}
    assert license_scan.scan_text(auto, texts[3])[5:] == ("bsd,gpl,mit", 1.0, True)
    assert license_scan.scan_text(auto, texts[4])[5:] == ("apache-2", 1.0, True)
    assert license_scan.scan_text(auto, "")[5:] == ("", 0.0, False)


@pytest.mark.parametrize("text, found", [
    ("SPDX-License-Identifier: MIT foo bar SPDX-License-Identifier: GPL-2.0-only", ("gpl,mit", 1.0, True)),
    ("é SPDX-License-Identifier: nothing known SPDX-License-Identifier: ISC\nzlib", ("isc", 1.0, True)),
    ("SPDX-License-\n * Identifier: MIT", ("mit", 1.0, True)),
    ("## SPDX-License-Identifier\r\n\r\n(MIT AND GPL-2.0-only)\r\nISC", ("gpl,mit", 1.0, False)),
    ("SPDX-License-Identifier: \nSPDX-License-Identifier: ZLIB\nSPDX-License-Identifier:", ("zlib", 1.0, True)),
    ("SPDX-License-Identifier: \u672a\u77e5\nMIT", ("", 0.0, False))])
def test_every_tag_is_read(text, found):
    assert license_scan.scan_text(license_scan.build_automaton(), text)[5:] == found


@pytest.mark.parametrize("text, found", [
    ("SPDX-License-Identifier: CC-BY-ND-4.0", ("cc-by-nd", 1.0, False)),
    # the words of the base phrase "cc by nc" stand in these: its label stays
    ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", ("cc-by-nc,cc-by-nc-nd", 1.0, False)),
    ("SPDX-License-Identifier: CC-BY-NC-SA-3.0-DE", ("cc-by-nc,cc-by-nc-sa", 1.0, False)),
    ("SPDX-License-Identifier: BUSL-1.1", ("busl", 1.0, False)),
    ("Creative Commons Attribution-NonCommercial", ("cc-by-nc", 0.8, False)),
    ("Creative Commons Attribution-NoDerivatives 4.0", ("cc-by-nd", 0.8, False)),
    ("Creative Commons Attribution. Creative Commons Attribution-ShareAlike", ("cc-by,cc-by-sa", 0.8, True)),
    ("SPDX-License-Identifier: EUPL-1.2", ("eupl", 1.0, False)), ("SPDX-License-Identifier: 0BSD", ("0bsd", 1.0, True)),
    ("SPDX-License-Identifier: MIT AND EUPL-1.2", ("eupl,mit", 1.0, False)),
    ("SPDX-License-Identifier: MIT AND LicenseRef-House-2", ("licenseref-house-2,mit", 1.0, False)),
    ("SPDX-License-Identifier: Foo-1.0 OR MIT", ("foo-1.0,mit", 1.0, True)),
    ("SPDX-License-Identifier: MITRE-9", ("mitre-9", 1.0, False)),
    ("# License: Apache-2.0\nName: x", ("apache-2", 1.0, True)), ('{"license": "MIT", "v": 1}', ("mit", 1.0, True)),
    ("License: see the file", ("", 0.0, False)), ("the license: MIT", ("", 0.0, False)), ("License\nMIT", ("", 0.0, False)),
    ("Licence : (MIT OR foo-bar)", ("mit", 1.0, True)), ("cc by nc nd", ("cc-by-nc", 0.9, False))])
def test_labels(text, found):
    assert license_scan.scan_text(license_scan.build_automaton(), text)[5:] == found


def brute_labels(text):
    """Labels of the phrases and of plain tags: every phrase at every word, shorter ones at one start dropped."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    phrases = [(p.split(), x, b) for t, b in ((license_scan.BASE_PHRASES, True), (license_scan.NOTICE_PHRASES, False))
               for p, x in t.items()]
    labels = set()
    for i in range(len(words)):
        here = [(len(p), x, b) for p, x, b in phrases if words[i:i + len(p)] == p]
        labels |= {x for n, x, b in here if b or n == max(h[0] for h in here)}
    for tag in re.finditer(r"SPDX-License-Identifier: ([^\n]*)", text):
        for name in re.split(r" OR | AND ", tag[1]):
            known = [f for f in license_scan.FAMILIES if name.lower() == f or name.lower().startswith((f + "-", f + "."))]
            labels.add(max(known, key=len) if known else name.lower())
    return ",".join(sorted(labels))


def test_labels_by_brute_force(spark):
    import random
    rng = random.Random(7)
    phrases = [*license_scan.BASE_PHRASES, *license_scan.NOTICE_PHRASES]
    names = ["MIT", "GPL-2.0-only", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "EUPL-1.2", "0BSD", "X-Own-1", "BSD-3-Clause"]
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(phrases)
            parts.append(rng.choice([p, p.title(), p.replace(" ", "-"), " ".join(p.split()[:-1]), "plain words"]))
            if rng.random() < .3:
                parts.append("\n// SPDX-License-Identifier: " + rng.choice([" OR ", " AND "]).join(
                    rng.sample(names, rng.randint(1, 3))) + "\n")
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(d).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}


def test_license_empty(no_docs):
    assert license_scan.scan(no_docs).collect() == []


NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[IMG]", "[\\IMG]", "<", "[", "a\nb%0A%25", "", "</", "s>",
         "[INST", "</s", "<<s>>", "[[INST]]"]


def test_chat_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "sys<s>\n%tem"][i % 3], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, None, None), (None, 1, "assistant", "é\U0001F600")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "formatted", F.lit("clash"))
    done = chat_format.read_back(chat_format.format_conversations(d.withColumn("parts", chat_format.text_part(
        F.col("text"))))).collect()
    for r in done:
        mine = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss_text == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        raw = r.formatted.encode()
        assert b"".join(raw[s.start:s.start + s.length] for s in r.turn_spans) == raw
    assert len(done) == 4


def test_chat_parts(spark):
    d = spark.sql("""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
        named_struct('type', 'text', 'text', 'see [IMG] ', 'ref', null, 'tokens', null),
        named_struct('type', 'image', 'text', null, 'ref', 'a.png', 'tokens', null),
        named_struct('type', 'document', 'text', null, 'ref', 'b.pdf', 'tokens', 7L),
        named_struct('type', 'other', 'text', 'plain', 'ref', null, 'tokens', null)) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', null""")
    d = d.withColumn("parts", F.col("parts").cast(chat_format.PARTS_TYPE))
    r = chat_format.read_back(chat_format.format_conversations(d)).first()
    assert r.formatted == "<s>user\n[INST] see [\\IMG] [IMG][DOC]plain [/INST]</s><s>assistant\n</s>"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 576), ("document", "b.pdf", 7)]
    assert r.expanded_tokens == 583 and r.turns[0].text == "see [IMG] [IMG][DOC]plain" and r.loss_text == ""


def test_chat_control_string_across_parts(spark):
    part = lambda kind, text: (kind, text, None, None)
    rows = [(1, 0, "assistant", [part("text", "a<"), part("text", None), part("other", "/s>b"), part("image", None),
                                 part("text", "["), part(None, "IMG]")]),
            (1, 1, "user", [part("text", "<"), part("text", "s>")])]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS_TYPE}")
    r = chat_format.read_back(chat_format.format_conversations(d)).first()
    assert r.formatted == "<s>assistant\na<\\/s>b[IMG][\\IMG]</s><s>user\n[INST] <\\s> [/INST]</s>"
    assert [(t.role, t.text) for t in r.turns] == [("assistant", "a</s>b[IMG][IMG]"), ("user", "<s>")]


def test_chat_empty(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(d.withColumn("parts", chat_format.text_part(F.col("text")))).collect() == []
    assert hashlib.sha256(b"").hexdigest()
