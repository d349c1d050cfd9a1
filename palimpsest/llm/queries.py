"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, langid, lm_score, packing, pii, secret_scan, simhash, warc
from .common import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "out.lang_pred", "out.score", "out.mixture")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


#: What the calls of `with_calls` must look like.
ANSWER = {"answer": {
    "type": "object", "required": ["question"], "additionalProperties": False,
    "properties": {"question": {"type": "string", "minLength": 1}, "earlier": {"type": "object"}},
}}


def with_calls(conversations: DataFrame) -> DataFrame:
    """The messages, and the same conversations as tool calls: what a user says is a call that uses the result of the turn before
    the last, and what the assistant says is the result of the call of the turn before."""
    block = lambda name, body: F.concat(F.lit(f"<{name}>"), F.to_json(body), F.lit(f"</{name}>"))
    turn = F.col("turn")
    question = F.named_struct(F.lit("question"), F.coalesce("text", F.lit("")))
    earlier = F.named_struct(F.lit("question"), F.coalesce("text", F.lit("")), F.lit("earlier"), F.named_struct(F.lit("$result"), (turn - 2).cast("string")))
    call = lambda arguments: block("tool_call", F.named_struct(F.lit("id"), turn.cast("string"), F.lit("name"), F.lit("answer"), F.lit("arguments"), arguments))
    calls = conversations.where("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), F.when(turn < 2, call(question)).otherwise(call(earlier)).alias("text"))
    answer = block("tool_result", F.named_struct(F.lit("id"), (turn - 1).cast("string"), F.lit("content"), F.coalesce("text", F.lit(""))))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), answer.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(calls).unionByName(results)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_chat(with_calls(table(spark, sf_dir, "conversations")), ANSWER)


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _digest(listed: Column) -> Column:
    return F.sha2(listed.cast("binary"), 256)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("row.doc_id", F.transform("spans", lambda s: s.dropFields("value")).alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    counts = [_count(k) for k, *_ in pii.BASE]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, _digest(pii.span_list(base)).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"), scores.alias("scores"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archive(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer(), keep=["doc_id"])
    return pieces.select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))
    counts = [_count(r.kind) for r in secret_scan.BASE]
    return found.select("row.doc_id", *counts, _digest(pii.span_list(base)).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate(F.arrays_zip("out.starts", "out.ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return found.select("row.doc_id", "out.n_words", hit.alias("n_hit"), F.size("out.items").cast("long").alias("n_items"), _digest(F.array_join("out.items", ",")).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score(docs, lm_score.fit(docs), keep=["doc_id"]).select("row.doc_id", "out.n_tokens", "out.pll", "out.mean_pll")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_simhash_near_dedup, op3_chat_formatting, op4_pii, op5_warc, op6_exact_dedup, op7_packing, op8_secret_scan, op9_decontamination, op10_lm_scoring, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
 d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, body FROM p),
 f AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id) AS n, min(page_id) OVER (PARTITION BY body) AS first_id FROM d)
SELECT page_id, payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> ((3 - i % 4) * 5)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first_id END AS refers_to FROM f""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
 r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op9_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
 g AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS gram
   FROM (SELECT item, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
 h AS (SELECT DISTINCT n FROM g),
 x AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, h WHERE len(words) >= n)),
 m AS (SELECT x.doc_id, x.i, x.n, g.item FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
 p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
 t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN t ON w.doc_id = t.doc_id""",
}
