"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlcflow.llm import (bpe, centroid_cluster, chat_format, decontaminate, html_text, language_id, license_scan,
                          periodic_runs, quality_knn, quality_rules, simhash, suffix_dedup, token_files)
from ohlcflow.llm.common import crc_fold, table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    found = language_id.predict(docs, language_id.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = token_files.write(table(spark, sf_dir, "documents"), word_bpe(), by_piece=True)
    return token_files.documents(spark, out)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), word_bpe())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The classifier, fitted on label rows whose id's crc32 leaves a remainder other than 1 by 3."""
    labels = table(spark, sf_dir, "labels").filter(crc_fold(F.col("doc_id"), 3) != 1)
    return quality_knn.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_knn.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"),
                         F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


PROBE = "</s>[INST] ok [/INST]"


def conversations_with_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts hold control strings."""
    columns = ("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(*columns).unionByName(probe)
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations_with_probe(spark, sf_dir)
    done = chat_format.read_back(chat_format.format_conversations(
        rows.withColumn("parts", chat_format.text_part(F.col("text")))))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; where the crc32 of the id is divisible by ten, the words from one
    place on repeat with a period, both set by the crc32."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                          h.alias("h"))
    g = F.floor(F.col("h") / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, a = F.size("w"), F.col("a")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeats = F.ceil((n - a) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", a + 1, F.col("p")), repeats))
    text = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), a), tail), F.lit(1), n), " ")
    planted = planted.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    planted = planted.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", F.when(n > 0, period))
    return planted.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_centroid_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_cluster.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_knn": op9_quality_knn,
    "op10_chat_format": op10_chat_format,
    "op11_html_text": op11_html_text,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_cluster": op13_centroid_cluster,
}

def _clustering_sql(k: int, rounds: int) -> str:
    """Rounds of assignment and floored means, one CTE each (rows numbered, as ids may repeat)."""
    steps = [f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        d AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(e) AS x FROM v),
        s AS (
            SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS c FROM v
            QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), e) <= {k}),
        c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN d USING (r))"""]
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} AS MATERIALIZED (
            SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist
            FROM (SELECT r, c, sum((d.x - q.x) * (d.x - q.x))::BIGINT AS dist
                  FROM d JOIN c{n} q USING (i) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
        c{n + 1} AS MATERIALIZED (
            SELECT q.c, q.i, coalesce(m.x, q.x) AS x FROM c{n} q LEFT JOIN (
                SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
                FROM d JOIN a{n} USING (r) GROUP BY c, i) m USING (c, i))""")
    return ",".join(steps) + f"""
        SELECT vec_id, a.c::INT AS cluster, a.dist AS distance,
               sum(a.dist) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.dist) OVER ()::BIGINT AS inertia,
               h.sha AS centroid_sha256
        FROM v JOIN a{rounds} a USING (r)
        JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c) h ON h.c = a.c"""


_SPACES = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op5_quality_rules": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (
            SELECT doc_id, text, row_number() OVER () AS r,
                   list_filter(string_split_regex(text, '{_SPACES}'), lambda x: x <> '') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM d),
        g AS (
            SELECT r, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
        k AS (
            SELECT r, p, count(*) OVER (PARTITION BY r, words[p], words[p + 1], words[p + 2]) AS n FROM g),
        c AS (
            SELECT r, count(DISTINCT q) AS n_repeat_words
            FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM k WHERE n > 1) GROUP BY r),
        m AS (
            SELECT doc_id, text, len(words) AS n_words,
                   coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM w LEFT JOIN c USING (r)),
        f AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols * 10 > word_chars
                    OR word_chars < n_words * 2 OR word_chars > n_words * 20 OR n_dup_lines * 10 > n_lines * 3
                    OR length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 > word_chars
                    OR length(regexp_replace(text, '\P{{L}}', '', 'g')) * 2 < word_chars
                    OR length(regexp_replace(text, '[^!]', '', 'g')) * 10 > word_chars) AS kept
        FROM f""",
    # 12 words with at most 2 substitutions have 4 equal words in a row, 6 to 11 with one (5 with none) 3: found by
    # plain 4-grams and 3-grams here; items of 1 to 4 words are compared with whole texts
    "op8_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents GROUP BY doc_id, text),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        dg AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d),
        bg AS (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM b WHERE len(w) >= 12),
        d3 AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d),
        b3 AS (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS p FROM b WHERE len(w) BETWEEN 5 AND 11),
        hit AS (
            SELECT DISTINCT dg.doc_id, bg.item_id, dg.w AS dw, bg.w AS bw, dg.p - bg.p AS shift, bg.p AS q
            FROM dg JOIN bg ON dg.w[dg.p] = bg.w[bg.p] AND dg.w[dg.p + 1] = bg.w[bg.p + 1]
                AND dg.w[dg.p + 2] = bg.w[bg.p + 2] AND dg.w[dg.p + 3] = bg.w[bg.p + 3]),
        short AS (
            SELECT DISTINCT d3.doc_id, b3.item_id, d3.w AS dw, b3.w AS bw, d3.p - b3.p AS shift
            FROM d3 JOIN b3 ON d3.w[d3.p] = b3.w[b3.p] AND d3.w[d3.p + 1] = b3.w[b3.p + 1]
                AND d3.w[d3.p + 2] = b3.w[b3.p + 2]),
        win AS (
            SELECT DISTINCT doc_id, item_id, dw, bw, shift, unnest(range(greatest(1, q - 8), q + 1)) AS s, 12 AS n FROM hit
            UNION ALL SELECT doc_id, item_id, dw, bw, shift, 1, len(bw) FROM short
            UNION ALL SELECT doc_id, item_id, d.w, b.w, 0, 1, len(b.w) FROM d JOIN b ON d.w = b.w
                      WHERE len(b.w) BETWEEN 1 AND 4),
        eq AS (
            SELECT doc_id, item_id, s + shift - 1 AS place, n,
                   list_sum(list_transform(range(0, n), lambda i: (dw[s + shift + i] = bw[s + i])::INT)) AS equal
            FROM win WHERE s + n - 1 <= len(bw) AND s + shift >= 1 AND s + shift + n - 1 <= len(dw))
        SELECT doc_id, item_id, count(DISTINCT place) AS n_windows, min(place) AS first_word, max(place) AS last_word,
               max(equal)::BIGINT AS most_equal
        FROM eq WHERE n - equal <= 2 * n // 12 GROUP BY doc_id, item_id""",
    "op10_chat_format": r"""
        WITH m AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (
            SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
                   length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|IMG\]|AUD\]|DOC\])'))
                   + length(role) + length('<s>') + 1 + length('</s>')
                   + CASE WHEN role = 'assistant' THEN 0 ELSE length('[INST] ') + length(' [/INST]') END AS chars
            FROM m)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(length(loss))::BIGINT AS loss_chars,
               sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    # the given pages all carry the label element; the operator finds the same stretch by its weights
    "op11_html_text": r"""
        WITH a AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
        b AS (
            SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x:
                trim(regexp_replace(replace(replace(replace(replace(replace(
                    regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
                    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(160), ' '),
                    '[\x09-\x0D\x1C-\x1F\x20]+', ' ', 'g'))) AS blocks FROM a),
        t AS (
            SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    "op13_centroid_cluster": _clustering_sql(centroid_cluster.CLUSTERS, centroid_cluster.ROUNDS),
}
