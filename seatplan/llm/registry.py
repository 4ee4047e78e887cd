"""Queries of the corpus operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole
table.  Queries without SQL are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seatplan.llm import (bpe, conversation_trie, exact_dedup, language_id, lexical, licenses, markov, mixing, secrets,
                          simhash, suffix_dedup, token_counts, topk)
from seatplan.plans.lineage import written
from seatplan.session import importable_on_workers

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), byte_vocabulary())


# Published forms of keys.
KEY_FORMS = {
    "aws": "^AKIA[A-Z0-9]{16}$", "github": "^gh[pousr]_[A-Za-z0-9]{36}$", "gitlab": "^glpat-[A-Za-z0-9_-]{20}$",
    "slack": "^xox[abprs]-[A-Za-z0-9-]{10,}$", "stripe": "^[sr]k_live_[A-Za-z0-9]{24,}$", "google": "^AIza[A-Za-z0-9_-]{35}$",
    "npm": "^npm_[A-Za-z0-9]{36}$", "web_token": f"^{secrets.WEB_TOKEN}$"}


def finding_labels(forms: dict[str, str] = KEY_FORMS):
    """Labels of candidates by published forms: 1 for key formats (``forms``, quoted
    40-digit and assigned 18-digit hexadecimal keys, passwords in URLs, lines
    of private keys), 0 for runs of digits, documentation examples, UUIDs, named
    hashes and versioned or dated names (the latter three not behind a
    credential word), else null."""
    found, before, after = F.col("found"), F.col("before"), F.col("after")
    key = (found.rlike("^[0-9a-f]{40}$") & before.endswith('"') & (after == '"')
           | found.rlike("^[0-9a-f]{18}$") & before.endswith("password=")
           | before.rlike("://[A-Za-z0-9._-]*:$") & (after == "@")
           | found.rlike("^[A-Za-z0-9+/]{48,}$") & before.rlike("PRIVATE KEY-----[^A-Za-z0-9]*$"))
    for form in forms.values():
        key = key | found.rlike(form)
    hashed = found.rlike("^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$") & before.rlike(
        r"(?i)(commit|revision|checksum|digest|etag|md5|sha-?[0-9]+)[^A-Za-z0-9]*$")
    name = found.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$") | found.rlike(
        "^[A-Za-z]{2,}([-_/][A-Za-z]{2,})*[-_/]?v?[0-9]{1,4}([-_][0-9]{1,4})*$")
    return (F.when(found.rlike("^[0-9+/_-]+$") | found.rlike("(?i)EXAMPLE(KEY)?$"), 0.0)
            .when((hashed | name) & ~before.rlike(secrets.CREDENTIAL), 0.0).when(key, 1.0))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings are labelled by :func:`finding_labels`; ``documents`` has no path, so path words come from the text."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), finding_labels(), F.col("source"), near_path=True)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.exact_topk(vectors.filter(F.col("vec_id") % 20 == 0), vectors, k=20)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remaining bytes follow as ``text``; a character of which bytes are gone reads as U+FFFD."""
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return groups.select("doc_id", "fingerprint", "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_documents(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the corpus as flat token files (id 50256 ends a document) and counts by separator scan."""
    files = token_counts.flat_files(_table(spark, sf_dir, "documents"), byte_vocabulary(), eod=50256)
    return token_counts.named_counts(written(files, "token-files"), eod=50256)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return mixing.mix_sources(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.score_texts(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"), conversation_trie.opening_turns(), 100)


_QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_topk": op3_exact_topk,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_trie": op13_conversation_trie,
}

_ORACLE: dict[str, str] = {
    "op3_exact_topk": r"""
        WITH v AS (
          SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm,
                 length(coalesce(text, '')) AS points
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op10_mixing": r"""
        WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
        d AS (
          SELECT d.doc_id, d.source,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
                 (CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
                    ::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
          FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
        s AS (
          SELECT source, sum(size)::BIGINT AS source_size,
                 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
          FROM d GROUP BY source),
        r AS (
          SELECT *, 3 * source_size AS cap,
                 sum(source_size) OVER () AS total,
                 coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                 sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
          FROM s WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
        f AS (SELECT *, cap * ws <= (total - caps) * w AS full_cap FROM r),
        t AS (
          SELECT source, source_size,
                 CASE WHEN full_cap THEN cap::DOUBLE
                      ELSE ((total - coalesce(sum(CASE WHEN full_cap THEN cap END) OVER (), 0)) * w)::BIGINT::DOUBLE
                           / (sum(CASE WHEN NOT full_cap THEN w END) OVER ())::BIGINT::DOUBLE END AS target
          FROM f),
        e AS (
          SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 1 END AS epochs FROM t),
        p AS (
          SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
                 target - epochs * source_size AS budget,
                 2 * coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id, size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS middle
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * least(3, epochs + CASE WHEN middle <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM p""",
    "op12_lexical_search": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents WHERE text IS NOT NULL),
        z AS (SELECT count(*) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d WHERE len(terms) > 0),
        p AS (
          SELECT r, doc_id, n, term, count(*) AS tf
          FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
        w AS (
          SELECT term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
          FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
        q AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (
          SELECT item_id, r, doc_id,
                 CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term), z GROUP BY ALL),
        o AS (
          SELECT item_id, doc_id, score, CAST(row_number() OVER (
                   PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
          FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50""",
    "op13_conversation_trie": r"""
        WITH t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
          FROM conversations WHERE conv_id IS NOT NULL),
        -- crc32 bit by bit: list items hold a character's code times 8 plus the number of its bit
        s AS (
          SELECT conv_id, flatten([[ascii(x) * 8 + b FOR b IN range(8)] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]) AS bits
          FROM (SELECT DISTINCT conv_id FROM t)),
        c AS (
          SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda a, e:
              xor(xor(a, CASE WHEN e % 8 = 0 THEN e // 8 ELSE 0 END) >> 1,
                  3988292384 * (xor(a, CASE WHEN e % 8 = 0 THEN e // 8 ELSE 0 END) & 1))), 4294967295::BIGINT) % 6 AS h
          FROM s),
        r AS (
          SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i < c.h
          UNION ALL
          SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
        p AS (
          SELECT conv_id, row_number() OVER w AS d, text, list({'role': role, 'text': text}) OVER w AS turns FROM r
          WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          UNION ALL
          SELECT conv_id, 0, '', [] FROM c),
        m AS (  -- the node of each conversation at each of its depths
          SELECT conv_id, d, text, min(conv_id) OVER (PARTITION BY d, turns) AS node,
                 d = max(d) OVER (PARTITION BY conv_id) AS is_end
          FROM p),
        n AS (
          SELECT node, d, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
          FROM m GROUP BY node, d),
        q AS (SELECT n.*, m.node AS above FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
        k AS (SELECT above AS node, d - 1 AS d, count(*) AS n_children FROM q WHERE d > 0 GROUP BY ALL),
        f AS (SELECT q.*, coalesce(k.n_children, 0) AS n_children FROM q LEFT JOIN k USING (node, d)),
        u AS (  -- every node adds to the nodes of its first member at no greater depth
          SELECT m.node, m.d, sum(f.saved) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
          FROM f JOIN m ON m.conv_id = f.node AND m.d <= f.d GROUP BY m.node, m.d)
        SELECT f.node AS conv_id, f.d AS depth, f.above AS parent_conv_id, f.n_convs, f.n_children,
               u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM f JOIN u USING (node, d)""",
}


def queries() -> dict[str, Query]:
    every = _QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: importable_on_workers(fn) for name, fn in every.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
