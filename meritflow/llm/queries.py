"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritflow.llm import (chat_format, collocations, divergence, exact_dedup, html_text, language, line_rules, minhash, mixing,
                           packing, sharding, substring_dedup, toxicity)
from meritflow.llm.common import read, remainder, words, written


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix of sources takes from it."""
    docs = read(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix(sized.withColumnRenamed("size", "n_words"), F.col("n_words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "source", "copies")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, installed with the tokenizers on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its packed sequence."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts and the row that stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-frequency verdict of every document."""
    return line_rules.judge(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document."""
    return substring_dedup.find(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards, each with the sources in proportion."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = written(read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "sizes")
    return sharding.assign(docs, 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.link(docs).select("doc_id", "n_shingles", "component_id",
                                     F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of every language, and the unusual terms of each."""
    return divergence.audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds another template's control strings, formatted and read back."""
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                   F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.digests(chat_format.format_chat(chats.unionByName(tricky)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two and three words of every language."""
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_line_rules": op6_line_rules,
    "op7_html_text": op7_html_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_minhash": op10_minhash,
    "op11_divergence": op11_divergence,
    "op12_chat_format": op12_chat_format,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER same AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER same = 1 AS kept,
               text_sha256
        FROM t
        WINDOW same AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)""",
    "op6_line_rules": r"""
        WITH t AS (
            SELECT doc_id, source, coalesce(text, '') AS text, coalesce('=' || source, '') AS host,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        threes AS (
            SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
        again AS (
            SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM threes) WHERE n > 1),
        repeats AS (SELECT doc_id, sum(least(3, coalesce(j - i, 3))) AS n FROM again GROUP BY doc_id),
        held AS (
            SELECT doc_id, host, md5(text) AS key, len(string_split(line, ' ')) AS w, line
            FROM (SELECT doc_id, host, text, trim(regexp_replace(regexp_replace(lower(unnest(string_split(text, chr(10)))),
                         '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS line FROM t)
            WHERE line <> ''),
        hosts AS (SELECT host, count(DISTINCT md5(text)) AS texts FROM t GROUP BY host),
        common AS (
            SELECT host, line FROM (SELECT host, line, count(DISTINCT key) AS n FROM held GROUP BY host, line)
            JOIN hosts USING (host) WHERE n > greatest(20.0, texts * 0.02)),
        lost AS (SELECT doc_id, sum(w) AS n FROM held JOIN common USING (host, line) GROUP BY doc_id),
        counted AS (
            SELECT t.doc_id, source, len(words) AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(lost.n, 0)::BIGINT AS removed_words
            FROM t LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                   AND n_words - removed_words >= 0.5 * n_words AS kept,
               removed_words, source
        FROM counted""",
    "op11_divergence": r"""
        WITH t AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM documents),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        langs AS (SELECT lang, count(*) AS kinds, sum(total) AS all_ FROM kept GROUP BY lang),
        sizes AS (SELECT lang, source, sum(n) AS size FROM n GROUP BY lang, source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (coalesce(s.size, 0) + 2 * l.kinds) AS p,
                   1 + (1000000000::HUGEINT * (k.total + 2)) // (l.all_ + 2 * l.kinds) AS q
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
            LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
            LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (
            SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
            FROM p WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        QUALIFY part = 'pair' OR rank <= 10""",
    "op12_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, list_reduce([replace(role || chr(0) || text, '\', '\\'),
                                   '<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
                                  lambda x, c: replace(x, c, c[1] || '\' || c[2:])) AS escaped
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, escaped)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, escaped) FILTER (WHERE role = 'assistant'), ''))
                   AS loss_sha256,
               sum(length('<|turn|><|body|><|end|>') + length(escaped) - 1)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
                  FROM documents)),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        spans AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(
                      range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])))) AS p FROM words),
        f AS (SELECT lang, p, count(*) AS f FROM spans GROUP BY lang, p),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        cand AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 10),
        cuts AS (
            SELECT c.lang, c.p, c.a, l.f AS l, r.f AS r, k,
                   (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, len(p))) AS k FROM cand) c
            JOIN f l ON l.lang = c.lang AND l.p = c.p[1 : k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1 : len(c.p)]),
        worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        gone AS (
            SELECT DISTINCT s.lang, s.p FROM cand s JOIN (
                SELECT lang, a, unnest([p[1 : 2], p[2 : 3]]) AS p FROM cand WHERE len(p) = 3) t
            ON s.lang = t.lang AND s.p = t.p WHERE 100 * t.a >= 50 * s.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
               array_to_string(p, ' ') AS phrase, a, l, r, n, score
        FROM worst ANTI JOIN gone USING (lang, p) JOIN n USING (lang)
        QUALIFY rank <= 2000""",
}
