"""Registered queries of this subpackage and, where SQL can state the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (
    byte_bpe, chat, jaccard, licenses, packing, parsing, quality_model, quality_rules, repair, repeats, spelling, token_files, urls,
)
from threadloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_suffix_array_dedup")
def op1(spark, sf_dir):
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


@register("op2_license_scan")
def op2(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@register("op3_fingerprints")
def op3(spark, sf_dir):
    return parsing.compare_neighbours(table(spark, sf_dir, "documents"))


JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
comp AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(comp.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""


@register("op4_ngram_jaccard", JACCARD_SQL)
def op4(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


@register("op5_quality_classifier")
def op5(spark, sf_dir):
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


RULES_SQL = """
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS window_text
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, window_text) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line_text) AS n_dup
          FROM line WHERE regexp_matches(line_text, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(len(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_alpha_words,
             len(list_filter(words, lambda x: strlen(x) > 2 AND ends_with(x, '!!'))) AS n_shouted_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR (n_lines > 3 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_alpha_words < n_words
            OR 2 * n_shouted_words > n_words) AS kept
FROM f"""


@register("op6_quality_rules", RULES_SQL)
def op6(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op7_token_files")
def op7(spark, sf_dir):
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_files.read_digests(manifest)


@register("op8_byte_bpe")
def op8(spark, sf_dir):
    import public_tokenizers
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ECHO = "</s>[INST] ok [/INST]"
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{ECHO}' UNION ALL SELECT -7, 1, 'assistant', '{ECHO}'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             length(replace(replace(replace(coalesce(text, ''), '\\', '\\e'), '<', '\\l'), '[', '\\b')) AS n,
             length(replace(replace(replace(replace(coalesce(role, ''), '\\', '\\e'), '<', '\\l'), '[', '\\b'), chr(10), '\\n')) AS r,
             coalesce(role, '') IS DISTINCT FROM lag(coalesce(role, '')) OVER o AS starts
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) + sum(CASE WHEN starts THEN r + {len(chat.TURN) + 1 + len(chat.END)} ELSE {len(chat.NEXT)} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@register("op9_chat_formatting", CHAT_SQL)
def op9(spark, sf_dir):
    echo = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ECHO).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(echo)
    back = chat.read_chat(chat.format_chat(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


@register("op10_best_fit_packing")
def op10(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a fifth of their rows damaged, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    fill = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(fill[0], F.lit(":"), fill[1]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", fill[2].alias("role"), fill[3].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))


@register("op11_conversation_repair")
def op11(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_digests(damaged(turns), turns)


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
URL_SQL = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT page_id, host, path, CASE WHEN (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) THEN rhost || rpath END AS rule, verdict
        FROM h CROSS JOIN r),
best AS (SELECT page_id, host, path, max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) AS b, count(*) / 5 AS copies
         FROM fit GROUP BY page_id, host, path)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best, range(CAST(copies AS BIGINT))"""


@register("op12_url_filter", URL_SQL)
def op12(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


@register("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"), damage=spelling.drop_one_letter(97))
