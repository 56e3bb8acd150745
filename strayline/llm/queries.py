"""The registered queries of this folder."""

from __future__ import annotations

from strayline.llm import alignment, dartminhash, exact, interpolation, kneser_ney, language, lexical, mixing, packing, quality_rules, secrets, sharding, toxicity
from strayline.llm.registry import LLM_ORACLES, LLM_QUERIES, documents, query

#: The tokenizer's file; its place is a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"
#: The vocabularies that are aligned.
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op1_packing")
def op1_packing(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    return packing.pack_documents(documents(spark, sf_dir), path, ids=False)


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    return quality_rules.judged(documents(spark, sf_dir))


@query(
    "op3_mixing",
    r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3] AS w FROM sums),
steps AS (
  SELECT *,
    (CAST(sum(source_size) OVER () AS BIGINT)
      - 3 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed),
one AS (SELECT coalesce(max(level) FILTER (level * w < 3 * source_size), 0) AS level FROM steps),
rates AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size <= one.level * w THEN 3.0::DOUBLE * source_size ELSE one.level * w END AS target
  FROM weighed, one),
shares AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('3|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 AS draw
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM shares""",
)
def op3_mixing(spark, sf_dir):
    return mixing.mixed_documents(documents(spark, sf_dir))


@query(
    "op4_exact",
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def op4_exact(spark, sf_dir):
    return exact.exact_groups(documents(spark, sf_dir))


@query("op5_interpolation")
def op5_interpolation(spark, sf_dir):
    return interpolation.score_documents(documents(spark, sf_dir))


@query("op6_dartminhash")
def op6_dartminhash(spark, sf_dir):
    return dartminhash.near_classes(documents(spark, sf_dir))


def _secrets_sql() -> str:
    """All matches of each kind with running lengths for places, then owners per secret."""
    quoted = [(k, p.replace("'", "''"), g, n) for k, (_, p, g, n) in enumerate(secrets.KINDS)]
    found = " UNION ALL ".join(
        f"""SELECT r, doc_id, source, {k} AS kind, {n} AS least, regexp_extract_all(t, '{p}', 0) AS m,
        regexp_extract_all(t, '{p}', {g}) AS s, string_split_regex(t, '{p}') AS g FROM docs"""
        for k, p, g, n in quoted
    )
    names = ", ".join(f"'{k[0]}'" for k in secrets.KINDS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS source, coalesce(text, '') AS t FROM documents),
found AS ({found}),
one AS (
  SELECT r, doc_id, source, kind, least, unnest(m) AS m, unnest(s) AS s, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS nth
  FROM found WHERE len(m) > 0),
placed AS (
  SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY nth) AS BIGINT) AS e FROM one),
right_size AS (
  SELECT r, doc_id, source, kind, s, e - length(m) AS b, e FROM placed
  WHERE length(s) >= least AND (kind < 3 OR (regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]')))),
candidates AS (
  SELECT *, coalesce(max(CASE WHEN kind < 3 THEN e END) OVER w, 0) <= b
    AND coalesce(min(CASE WHEN kind < 3 THEN b END) OVER (PARTITION BY r ORDER BY b, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), e) >= e AS apart
  FROM right_size WINDOW w AS (PARTITION BY r ORDER BY b, kind)
  QUALIFY kind < 3 OR apart),
owned AS (
  SELECT s, count(DISTINCT source) <= {secrets.MOST_OWNERS} AS live
  FROM candidates GROUP BY s),
spans AS (
  SELECT r, kind, b, live, [{names}][kind + 1] || ':' || b || ':' || e AS span FROM candidates JOIN owned USING (s) WHERE kind < 3 OR live),
listed AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY b, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN listed USING (r)"""


@query("op7_secrets", _secrets_sql())
def op7_secrets(spark, sf_dir):
    return secrets.scan_documents(documents(spark, sf_dir))


@query("op8_language")
def op8_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(docs))


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))

@query("op10_kneser_ney")
def op10_kneser_ney(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.judged(documents(spark, sf_dir), kneser_ney.trusted_ids(labels))


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op12_alignment")
def op12_alignment(spark, sf_dir):
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ALIGNED]
    return alignment.align(documents(spark, sf_dir), *paths)


@query(
    "op13_lexical",
    r"""
WITH doc_terms AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
totals AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM doc_terms WHERE len(terms) > 0),
held AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc_terms) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM item_terms JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""",
)
def op13_lexical(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
