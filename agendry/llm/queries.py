"""One query for each operator, applied to its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.simhash import groups

    return groups(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from agendry.llm.training_order import ordered_shards, shard_folder

    folder = shard_folder(spark, sf_dir, b"epoch 0")
    return ordered_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, b"epoch 0", folder)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.topk_search import search

    docs = _table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 50 = 0"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.line_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "n_chars", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from agendry.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from agendry.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.embed_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from agendry.llm.token_alignment import alignment

    # byte_bpe_50k.tiktoken holds the vocabulary of byte_bpe_50k.json as ranks.
    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agendry.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
      FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw USING (n, gram)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS mean FROM d),
idf AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM tf, st GROUP BY term, n),
im AS (SELECT doc_id, term, tf, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / mean)) AS impact FROM tf JOIN d USING (doc_id), st),
s AS (SELECT q.doc_id AS query_id, im.doc_id, round(sum(q.tf * idf * im.impact), 9) AS score
  FROM tf q JOIN idf USING (term) JOIN im USING (term) WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


#: Every pair of a label.
OP11_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT row_number() OVER () AS r, vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS src, b.r AS dst FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93::DOUBLE),
reach AS (SELECT DISTINCT src AS a, src AS b FROM link UNION SELECT a, dst FROM reach JOIN link ON b = src),
found AS (SELECT a, min(vec_id) AS least FROM reach JOIN ok ON b = r GROUP BY a),
n AS (SELECT src, count(*) AS n FROM link GROUP BY src)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CASE WHEN a IS NULL THEN vec_id ELSE least END AS component_id, a IS NULL OR vec_id IS NOT DISTINCT FROM least AS kept
FROM ok LEFT JOIN found ON r = a LEFT JOIN n ON r = src
UNION ALL SELECT vec_id, 0, vec_id, true FROM v WHERE NOT coalesce(label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0, false)
"""

#: Per level: every two consecutive nodes become one, until one is left.
OP13_SQL = r"""
WITH RECURSIVE f AS (SELECT *, doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor(
      list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(coalesce(doc_id, 0) AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, c: list_reduce(list_prepend(xor(a, c), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))
      , 4294967295) % 7 = 0 AS tampered,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM documents),
h AS (SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS altered FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
low AS (SELECT lang, 0 AS k, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i:i + 1], ''))) FROM low WHERE len(nodes) > 1),
sub AS (SELECT lang, k AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1),
high AS (SELECT 0 AS k, list(subroot ORDER BY place) AS nodes FROM sub UNION ALL SELECT k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i:i + 1], ''))) FROM high WHERE len(nodes) > 1),
walk AS (SELECT p.lang, pos, doc_id, leaf, 0 AS k, '' AS beside, coalesce(altered, leaf) AS node, height, subroot, place FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang
  UNION ALL
  SELECT w.lang, w.pos, doc_id, leaf, w.k + 1, beside || coalesce(s, ''), sha256(CASE WHEN p_at & 1 = 1 THEN coalesce(s, '') || node ELSE node || coalesce(s, '') END), height, subroot, place
  FROM (SELECT walk.*, CASE WHEN walk.k < height THEN pos >> walk.k ELSE place >> (walk.k - height) END AS p_at, coalesce(low.nodes, high.nodes) AS nodes, coalesce(low.nodes, high.nodes)[xor(p_at, 1) + 1] AS s
    FROM walk LEFT JOIN low ON low.lang IS NOT DISTINCT FROM walk.lang AND low.k = walk.k AND walk.k < height LEFT JOIN high ON high.k = walk.k - height) w
  WHERE len(nodes) > 1)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, node AS folded_root, node = root AS verified
FROM walk JOIN (SELECT k AS top, nodes[1] AS root FROM high WHERE len(nodes) = 1) r ON walk.k = height + top
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extract, op2_simhash, op3_decontaminate, op4_license_scan, op5_toxicity, op6_training_order, op7_topk_search, op8_line_dedup, op9_token_counts, op10_bpe, op11_embedding_dedup, op12_token_alignment, op13_merkle_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op7_topk_search": OP7_SQL, "op11_embedding_dedup": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
