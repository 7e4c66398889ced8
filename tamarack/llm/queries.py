"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import chat, decontaminate, line_dedup, mil_quality, near_duplicates, packing, quality_rules, surrogates, token_counts, warc_zip
from tamarack.llm import pipeline as _pipeline
from tamarack.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, model, columns=["doc_id"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
    back = chat.read_chats(chat.format_chats(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _op3_sql() -> str:
    """The same figures from the rows themselves; the template only enters by lengths."""
    t = chat.Template()

    def coded(column: str) -> str:
        out = f"replace({column}, '{chat.MARK}', '{chat.MARK}0')"
        for code, control in zip(chat.CODES, t.controls(), strict=False):
            out = f"replace({out}, '{control}', '{chat.MARK}{code}')"
        return f"length({out})"

    head = f"{len(t.open) + 1} + {coded('role')}"
    return f"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w k, lag(role) OVER w before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) loss_sha256,
  CAST({len(t.close)} + sum({coded('text')} + CASE WHEN k = 1 THEN {head} WHEN role = before THEN {len(t.join)} ELSE {len(t.close)} + {head} END) AS BIGINT) formatted_chars
FROM o GROUP BY conv_id"""


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("tamarack.surrogates.key", "a key for trials only")  # who has the key can tell who is who
    return surrogates.replace_entities(docs, key.encode())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "overlap")


def _op5_sql() -> str:
    """The same windows joined on the kept tokens themselves instead of their hashes."""
    d = decontaminate
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x != '')"

    def key(mask: str) -> str:
        return "concat_ws(' ', " + ", ".join(f"w[p + {k + 1}]" for k, c in enumerate(mask) if c == "1") + ")"

    windows = "\nUNION ALL ".join(f"SELECT *, '{m}' || {key(m)} AS k FROM {{0}}" for m in d.MASKS)
    return f"""
WITH t AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
tp AS (SELECT doc_id, w, unnest(range(0, len(w) - {d.SPAN - 1})) AS p FROM t WHERE len(w) >= {d.SPAN}),
bp AS (SELECT item_id, w, unnest(range(0, len(w) - {d.SPAN - 1})) AS p FROM b WHERE len(w) >= {d.SPAN}),
tw AS ({windows.format("tp")}), bw AS ({windows.format("bp")}),
hits AS (SELECT DISTINCT tw.doc_id, bw.item_id, tw.w AS tw, bw.w AS bw, tw.p AS ta, bw.p AS ba FROM tw JOIN bw ON tw.k = bw.k),
around AS (SELECT *, least({d.MARGIN}, ta, ba) AS lo, least({d.MARGIN}, len(tw) - ta - {d.SPAN}, len(bw) - ba - {d.SPAN}) AS hi FROM hits),
lefts AS (SELECT *, unnest(range(0, lo + 1)) AS l FROM around), parts AS (SELECT *, unnest(range(0, hi + 1)) AS r FROM lefts),
seen AS (SELECT doc_id, item_id, l + {d.SPAN} + r AS overlap, len(bw) AS n, len(list_filter(range(0, l + {d.SPAN} + r), lambda i: tw[ta - l + i + 1] = bw[ba - l + i + 1])) AS matched FROM parts),
short AS (SELECT tq.doc_id, b.item_id, len(b.w) AS overlap, len(b.w) AS matched FROM b JOIN (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM t) tq ON len(b.w) BETWEEN 1 AND {d.SPAN - 1} AND tq.w[tq.p + 1 : tq.p + len(b.w)] = b.w),
every AS (SELECT doc_id, item_id, matched, overlap FROM seen WHERE overlap >= least({d.LEAST_OVERLAP}, n) AND matched >= {d.LEAST_SHARE} * overlap UNION ALL SELECT doc_id, item_id, matched, overlap FROM short)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(arg_max(overlap, matched * 100 + overlap) AS BIGINT) AS overlap FROM every GROUP BY doc_id, item_id"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = mil_quality.train(docs, read(spark, sf_dir, "labels"))
    return mil_quality.apply(docs, model, columns=["doc_id"])


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_zip.round_trip(read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _op8_sql() -> str:
    digits = " || ".join(f"to_base(CAST('0x' || substr(h, {k}, 10) AS BIGINT), 32, 8)" for k in (1, 11, 21, 31))
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h FROM pages),
d AS (SELECT page_id, n, translate(upper({digits}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') digest, min(page_id) OVER (PARTITION BY h) first FROM p)
SELECT page_id, CAST(n AS BIGINT) payload_bytes, digest payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> first THEN first END refers_to FROM d"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_docs")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.every_limit(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_chat, op4_surrogates, op5_decontaminate, op6_packing, op7_mil_quality, op8_warc_zip, op9_near_duplicates, op10_token_counts, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": _op3_sql(), "op5_decontaminate": _op5_sql(), "op8_warc_zip": _op8_sql()}
