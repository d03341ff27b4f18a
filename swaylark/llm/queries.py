"""The queries of these operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align_tokens, centroids, chat, decontaminate, exact_dedup, langid, line_dedup, mixing, pieces, simhash, suffix_dedup, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int, key: str = "doc_id") -> F.Column:
    """Whether the CRC-32 of the id as text leaves this remainder. A null id is held out: nothing is learned from its row."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == rest, F.lit(True))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held_out(4, 2)))
    return langid.predict(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), pairs=True)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), with_order=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~held_out(3, 1)), _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.aligned_groups(_table(spark, sf_dir, "documents"))


def op12_piece_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_exact_dedup, op2_suffix_dedup, op3_decontamination, op4_simhash, op5_chat_format, op6_language_id, op7_token_files, op8_line_dedup, op9_source_mixing, op10_toxicity, op11_token_alignment, op12_piece_digests, op13_centroids, pipeline]
    return {f.__name__: f for f in named}


EXACT_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
      FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))
"""

CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
         coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') AS mark
  FROM conversations),
prefixes AS (
  SELECT conv_id, position, line, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(mark, chr(2)) OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, prefix, count(*) AS n_alike FROM prefixes WHERE position = n_turns GROUP BY n_turns, prefix),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.prefix = w.prefix AND p.n_turns > w.n_turns))
SELECT p.conv_id, (p.position - 1) // 64 AS part_no, k.n_turns, k.n_alike, string_agg(p.line, '' ORDER BY p.position) AS chat
FROM prefixes p JOIN kept k ON p.conv_id = k.conv_id
GROUP BY ALL
"""

MIXING_SQL = """
WITH sources AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
means AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM sources) * (SELECT sum(n) FROM sources) / n AS mean FROM sources),
rates AS (SELECT source, greatest(1, ceil(mean / 500)) AS draws, mean / draws AS m FROM means),
steps AS (
  SELECT source, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM rates, range(0, 800) r(k)
  WHERE k <= ceil(m + 12 * sqrt(m) + 20)),
drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('17:' || doc_id || CASE WHEN k > 0 THEN ':' || k ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT doc_id, source, unnest(range(0, draws::BIGINT)) AS k FROM documents JOIN rates USING (source))),
counts AS (SELECT d.doc_id, count(s.upto) AS c FROM drawn d JOIN steps s ON s.source = d.source AND s.upto <= d.u GROUP BY 1),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c FROM documents d JOIN counts USING (doc_id))
SELECT doc_id, text, lang, source, n_chars, k::INT AS copy_no,
       ('0x' || substr(md5('18:' || doc_id || ':' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS order_key
FROM (SELECT *, unnest(range(0, c)) AS k FROM counted)
"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """All rounds written out, one after the other."""
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, q AS c FROM (SELECT q, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
        SELECT vec_id, any_value(q) AS q, min({{'d': d, 'k': cluster}}) AS best
        FROM (SELECT vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r})
        GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
        SELECT c.cluster, coalesce(n.c, c.c) AS c
        FROM c{r} c LEFT JOIN (
          SELECT cluster, list(m ORDER BY i) AS c
          FROM (SELECT cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
                FROM (SELECT best.k AS cluster, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i)
          GROUP BY cluster) n ON n.cluster = c.cluster)""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, a.best.k AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.k)::BIGINT AS cluster_inertia,
           sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best.k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT_SQL, "op5_chat_format": CHAT_SQL, "op9_source_mixing": MIXING_SQL, "op13_centroids": _centroid_sql()}
