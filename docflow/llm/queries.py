"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from docflow.llm.alignment import align, corpus_counts
from docflow.llm.bpe import round_trip
from docflow.llm.decontam import contaminated
from docflow.llm.exact_dedup import exact_dedup
from docflow.llm.filter_audit import audit
from docflow.llm.jaccard_tree import near_classes
from docflow.llm.langid import fit as fit_languages, identify
from docflow.llm.pii import BASE, find_pii
from docflow.llm.spots import edited_pairs, fingerprint, likeness
from docflow.llm.substring import drop_repeats
from docflow.llm.token_files import token_roundtrip
from docflow.llm.toxicity import fit as fit_toxicity, score as score_toxicity
from docflow.llm.warc import warc_roundtrip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


@query("op2_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return exact_dedup(hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    is_kind = lambda name: lambda s: s["kind"] == name
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[F.size(F.filter("spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


@query("op3_bpe_boundaries")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = round_trip(table(spark, sf_dir, "documents"), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     h AS (SELECT *, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              (((('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)
                       FOR i IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM h""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_substring_dedup", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM i),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
     g AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(
           list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs, id_fold(4) != 2))
    return found.select("doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_toxicity(docs, table(spark, sf_dir, "labels"), id_fold(5) != 0)
    return score_toxicity(docs, net).select("doc_id", (id_fold(5) == 0).alias("held_out"), "score", "predicted", "rejected")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = align(docs, paths, corpus_counts(docs, paths))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))


@query("op12_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
     m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
                  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                  + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
     c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
                  count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY part, mask),
     l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
     o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
           FROM l v, l w, l x, l y, l z WHERE v.b + w.b + x.b + y.b + z.b = 31),
     s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step, bits FROM o),
     f AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone FROM s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE mask & (own | gone) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & gone = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & gone <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & gone = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & gone = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & own <> 0), 0)::BIGINT AS shapley
FROM f, c GROUP BY part, filter_order, step""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_spot_signatures")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_pairs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("signatures")).alias("fingerprint"),
                        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
                        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
                        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))
