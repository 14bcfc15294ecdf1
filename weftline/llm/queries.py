"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import (
    codes,
    decontaminate,
    fim,
    linecrf,
    mixing,
    neardup,
    pu,
    sharding,
    srs,
    substrings,
    suffixarray,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24
MIX = {"weights": (5, 2, 1), "share": 1.5, "most": 2}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_bounded_ring")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"), shards=SHARDS)


@query("op2_folded_lexicon")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_warc_revisits", """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN original IS NOT NULL AND original IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest
""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return warc.deduplicate(table(spark, sf, "pages"))


@query("op4_fast_similarity_sketch")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query("op5_line_crf")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return linecrf.apply_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_item_automaton")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_reference_automata")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf, "documents"))


@query("op8_hash_threshold_mix", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 12) AS h
  FROM documents
), r AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS place FROM d), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), g AS (
  SELECT source, source_size, coalesce(least(cap, weight * first_value(CASE WHEN level * weight < cap THEN level END IGNORE NULLS)
           OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), cap) AS target
  FROM f
), k AS (
  SELECT source, source_size, target, c.k, target - c.k * source_size AS budget FROM g, (VALUES (0), (1)) c(k)
), b AS (SELECT source, h, sum(size) AS size, count(*) AS n FROM d GROUP BY 1, 2),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
e AS (
  SELECT k.source, k.k, min(struct_pack(h := c.h, before := upto - size, one := size::DOUBLE / n, n := n)) AS x, any_value(budget) AS budget
  FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND budget > 0 AND budget < source_size AND upto > budget
  GROUP BY 1, 2
), t AS (
  SELECT k.source, source_size, target,
         max(CASE WHEN k.k = 0 AND k.budget >= source_size THEN 1 ELSE 0 END) AS all0,
         max(CASE WHEN k.k = 1 AND k.budget >= source_size THEN 1 ELSE 0 END) AS all1,
         max(CASE WHEN k.k = 0 THEN x.h END) AS h0, max(CASE WHEN k.k = 1 THEN x.h END) AS h1,
         max(CASE WHEN k.k = 0 THEN least(x.n, greatest(0, ceil(((e.budget - x.before) * 2 - x.one) / (x.one * 2)))) END) AS j0,
         max(CASE WHEN k.k = 1 THEN least(x.n, greatest(0, ceil(((e.budget - x.before) * 2 - x.one) / (x.one * 2)))) END) AS j1
  FROM k LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source AND k.k = e.k GROUP BY 1, 2, 3
)
SELECT doc_id, size, source_size, target,
       (size * ((all0 = 1 OR coalesce(h < h0 OR (h = h0 AND place <= j0), false))::INT
                + (all1 = 1 OR coalesce(h < h1 OR (h = h1 AND place <= j1), false))::INT))::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
""")  # fmt: skip
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), **MIX)


@query("op9_shard_suffix_arrays")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return suffixarray.remove_repeats(table(spark, sf, "documents"))


@query("op10_positive_unlabelled")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pu.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op11_sparse_index_fim", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), h AS (
  SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
         ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix,
         coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")  # fmt: skip
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return fim.report(table(spark, sf, "documents"))


@query("op12_stable_projections")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return srs.report(table(spark, sf, "embeddings"))


def nearest_sql(k: int) -> str:
    """Nearest entry of each part in the k-th codebooks; all numbers are whole, so products in doubles are exact."""
    return f"""a{k} AS (
  SELECT p.row, p.part,
         min(struct_pack(d := list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), e := b.entry)) AS near
  FROM p JOIN b{k} b USING (part) GROUP BY 1, 2)"""


def replaced_sql(k: int, length: int) -> str:
    return f"""s{k} AS (
  SELECT part, near.e AS entry, i, floor(sum(x[i]) / count(*)) AS v
  FROM a{k} JOIN p USING (row, part), range(1, {length + 1}) r(i) GROUP BY 1, 2, 3),
b{k + 1} AS (
  SELECT b.part, b.entry, coalesce(n.x, b.x) AS x
  FROM b{k} b LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM s{k} GROUP BY 1, 2) n USING (part, entry))"""


def codes_sql(rounds: int = codes.ROUNDS, length: int = 16) -> str:
    steps = [f"{nearest_sql(k)},\n{replaced_sql(k, length)}" for k in range(rounds)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT row, part, q[{length} * part + 1:{length} * part + {length}] AS x FROM v, range({codes.PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, row AS entry, x FROM p WHERE row < {codes.ENTRIES}),
{", ".join(steps)},
{nearest_sql(rounds)},
c AS (SELECT row, string_agg(printf('%02x', near.e::BIGINT), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN v USING (row)"""


@query("op13_trie_codes", codes_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return codes.report(table(spark, sf, "embeddings"))
