"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontam, exact, infill, mixing, periodic, quality, simhash, suffix, tokens, toxicity, warc
from tidemark.llm.common import fold, table

TOXIC_FOLDS, TOXIC_HELD = 5, 0
QUALITY_FOLDS, QUALITY_HELD = 4, 2
QUALITY_LEAST = 0.7


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold("doc_id", TOXIC_FOLDS) == TOXIC_HELD
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(own).alias("text"),
    )
    return chat.read_back(chat.format_windows(turns.unionByName(extra)))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold("doc_id", QUALITY_FOLDS) == QUALITY_HELD
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_per_document(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.read_files(tokens.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id"
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("top")
    found = periodic.word_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("top", periodic.longest_run())
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(periodic.run_table(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_infill_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.restored(infill.fill_in_middle(table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_counterfactual_toxicity,
        op2_chat_windows,
        op3_line_quality,
        op4_mix_sources,
        op5_token_files,
        op6_suffix_dedup,
        op7_exact_dedup,
        op8_warc_archives,
        op9_benchmark_windows,
        op10_simhash_covering,
        op11_periodic_runs,
        op12_bpe_tree,
        op13_infill_rotation,
    )
}

# Budget 512, history 64, system 128: cells of 320 fresh tokens; a turn costs its
# words and 4 tokens, and in the output its escaped text, its role and 24 characters.
_CHAT_SQL = r"""
    WITH own AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
    t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', text FROM own UNION ALL SELECT -1, 1, 'assistant', text FROM own),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
        24 + length(role) + len(regexp_extract_all(role, '[\\\n]')) + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM t0),
    p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS e FROM t),
    q AS (SELECT *, e - tokens AS s, (e - tokens) // 320 * 2 + ((e - 1) // 320 > (e - tokens) // 320)::INT AS win FROM p),
    w AS (SELECT conv_id, win, min(s) AS ws, min(i) AS first_turn FROM q GROUP BY ALL),
    again AS (SELECT q.conv_id, sum(chars) AS chars FROM q JOIN w ON q.conv_id IS NOT DISTINCT FROM w.conv_id
        WHERE CASE WHEN i = 0 AND role = 'system' THEN first_turn > 0 ELSE ws > s AND ws <= s + 64 AND q.win < w.win END GROUP BY ALL),
    d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
        coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM q GROUP BY ALL)
    SELECT d.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
        (d.chars + coalesce(again.chars, 0))::BIGINT AS formatted_chars
    FROM d LEFT JOIN again ON d.conv_id IS NOT DISTINCT FROM again.conv_id"""

# Seed 42; half of the texts that hold no mark change, four fifths of those to spm.
_INFILL_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
    e AS (SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    f AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain'
        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e),
    g AS (SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS p, coalesce(array_to_string(t[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(t[b + 1:], ''), '') AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
    FROM g"""

SQL = {
    "op2_chat_windows": _CHAT_SQL,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op13_infill_rotation": _INFILL_SQL,
}
