"""The registered queries opN_<name>: each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.llm import (
    byte_bpe,
    decontamination,
    exact_dedup,
    html_text,
    mask_search,
    passage_chains,
    periodic_runs,
    rank_array_bpe,
    secret_scan,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)
from carelattice.llm.registry import query, table


@query(
    """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query()
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.token_digests(table(spark, folder, "documents"), vocabulary)


@query()
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    matches = decontamination.benchmark_matches(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return decontamination.contamination(matches)


@query()
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.secret_spans(table(spark, folder, "documents")))


@query()
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(table(spark, folder, "pages"))


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.toxicity_scores(docs, model)


SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(40)], 4099


@query(
    f"""
    WITH RECURSIVE
    shards AS (
        SELECT i, ('0x' || substr(md5('offset-shard-' || lpad(i::VARCHAR, 2, '0')), 1, 15))::BIGINT % {SLOTS} AS o,
               ('0x' || substr(md5('step-shard-' || lpad(i::VARCHAR, 2, '0')), 1, 15))::BIGINT % ({SLOTS} - 1) + 1 AS s
        FROM range({len(SHARDS)}) t(i)
    ),
    orders AS (SELECT list(o ORDER BY i) AS offsets, list(s ORDER BY i) AS steps FROM shards),
    turns AS (
        SELECT 0 AS turn, NULL::BIGINT AS slot, list_transform(range({SLOTS}), lambda x: true) AS free,
               list_transform(range({len(SHARDS)}), lambda x: 0::BIGINT) AS seen
        UNION ALL
        SELECT turn + 1, found, list_transform(free, lambda x, k: x AND k != found + 1),
               list_transform(seen, lambda x, k: CASE WHEN k = turn % {len(SHARDS)} + 1 THEN taken + 1 ELSE x END)
        FROM (
            SELECT turn, free, seen, taken, (o + taken * s) % {SLOTS} AS found
            FROM (
                SELECT *, list_filter(range(seen[turn % {len(SHARDS)} + 1], {SLOTS}), lambda j: free[(o + j * s) % {SLOTS} + 1])[1] AS taken
                FROM (SELECT turn, free, seen, offsets[turn % {len(SHARDS)} + 1] AS o, steps[turn % {len(SHARDS)} + 1] AS s
                      FROM turns, orders WHERE turn < {SLOTS})
            )
        )
    ),
    owners AS (
        SELECT slot::INTEGER AS slot, 'shard-' || lpad(((turn - 1) % {len(SHARDS)})::VARCHAR, 2, '0') AS shard
        FROM turns WHERE turn > 0
    )
    SELECT doc_id, slot, shard
    FROM (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
    JOIN owners USING (slot)
    """
)
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents"), SHARDS, SLOTS)


@query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query()
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query()
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = passage_chains.repeated_passages(table(spark, folder, "documents"))
    others = F.expr("array_sort(array_distinct(transform(passages, p -> p.other)))")
    return found.withColumn("other_ids", F.coalesce(others, F.array().cast("array<bigint>"))).drop("passages")


@query()
def op11_rank_array_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    encoded = rank_array_bpe.encode_documents(table(spark, folder, "documents"), tokenizer)
    return rank_array_bpe.token_digests(rank_array_bpe.decode_documents(encoded, tokenizer))


@query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(table(spark, folder, "documents"))
    return periodic_runs.run_digests(periodic_runs.collapse_runs(planted))


_TERMS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    f"""
    WITH cut AS (SELECT doc_id, {_TERMS_SQL} AS terms FROM documents),
    corpus AS (SELECT count(*) FILTER (len(terms) > 0) AS documents, sum(len(terms))::BIGINT AS total FROM cut),
    held AS (
        SELECT doc_id, term, n, count(*) AS tf
        FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM cut) GROUP BY ALL
    ),
    weights AS (
        SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus
    ),
    asked AS (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
    wanted AS (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL),
    scored AS (
        SELECT item_id, doc_id,
               sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // total))))::BIGINT AS score
        FROM wanted JOIN weights USING (term) JOIN held USING (term), corpus GROUP BY ALL
    )
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    WHERE rank <= 10
    """
)
def op13_mask_search(spark: SparkSession, folder: str) -> DataFrame:
    return mask_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
