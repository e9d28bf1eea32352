"""The registered query of each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosieve.llm.chat import format_chats, read_back, streamed
from geosieve.llm.common import table
from geosieve.llm.conversation_repair import damaged, repair, summary
from geosieve.llm.fingerprints import edited_fingerprints
from geosieve.llm.grammar_files import read_documents, write_shards
from geosieve.llm.packing import pack, token_pieces
from geosieve.llm import quality
from geosieve.llm.quality import quality_rules
from geosieve.llm.sentence_pieces import decode, encode
from geosieve.llm.license_scan import scan_licenses
from geosieve.llm import language_id
from geosieve.llm import toxicity
from geosieve.llm.near_dedup import near_duplicates
from geosieve.llm.substring_dedup import remove_repeats
from geosieve.llm.token_alignment import align_documents

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op2_chat_formatting", r"""
WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn >') + 1 + length(role) + length(text) + len(regexp_extract_all(text, '</?turn')) + length('</turn>') + 2)
    AS formatted_chars, true AS well_formed
FROM rows GROUP BY conv_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row becomes events (streams of deltas, edits, regenerations), which are folded and rendered."""
    text = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(format_chats(streamed(rows)))


def _quality_sql() -> str:
    gap, space = r"[\x20\x09-\x0D]+", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def words(x: str) -> str:
        return f"list_filter(regexp_split_to_array({x}, '{gap}'), lambda y: y <> '')"

    def count(x: str, characters: str) -> str:
        return f"(length({x}) - length(translate({x}, '{characters}', '')))"

    n, size = f"len({words('x')})", "length(x)"
    fails = f"""trim(x, {space}) <> '' AND ({count('x', quality.SEPARATORS)} >= 3
      OR regexp_matches(trim(x, {space}), '(?i)^({quality.LINK_NAMES})$') OR {count('x', quality.SYMBOLS)} * 10 >= {size}
      OR ({n} >= 4 AND {count('x', quality.PUNCTUATION)} = 0)
      OR ({size} <= 200 AND regexp_matches(x, '(?i)({quality.BOILERPLATE})'))
      OR ({n} >= 4 AND lower(x) <> x AND upper(x) = x)
      OR ({n} >= 10 AND len(list_distinct({words('x')})) * 4 <= {n}))"""
    full = f"list_filter(ls, lambda x: trim(x, {space}) <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {words('t')} AS ws, string_split(t, chr(10)) AS ls FROM d),
good AS (SELECT doc_id, list_filter(ls, lambda x: NOT ({fails})) AS kept_lines FROM w),
places AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i
  FROM w)),
again AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, sum(k) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i,
  5)) AS k FROM again) GROUP BY 1),
counts AS (SELECT w.doc_id, len(ws) AS n_words, length(translate(t, {space}, '')) AS word_chars,
  {count('t', quality.SYMBOLS)} AS n_symbols, len({full}) - len(list_distinct({full})) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words, len({full}) AS n_lines, len(ls) - len(kept_lines) AS n_removed_lines,
  length(translate(t, {space}, '')) - length(translate(array_to_string(kept_lines, ''), {space}, '')) AS n_lost_chars
  FROM w JOIN good ON good.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT})
  AND n_lost_chars * 100 <= word_chars * {quality.MAX_LOST_PERCENT} AS kept FROM counts"""


@query("op8_quality_rules", _quality_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("cleaned")


@query("op9_sentence_pieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = decode(encode(table(spark, sf_dir, "documents"), model), model)
    whole = F.coalesce(F.col("text"), F.lit(""))
    return tokens.select(
        "doc_id", F.length(whole).cast("long").alias("n_chars"), "n_tokens", "n_byte_tokens", "ids_crc32",
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == whole).alias("round_trip"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True))


@query("op4_license_scans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_notices", F.size("spans").cast("long")).drop("spans")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out("doc_id", 3, 1)
    model = language_id.fit(docs, ~held)
    docs = docs.select("doc_id", held.alias("held_out"), language_id.predicted(model, F.col("text")).alias("found"))
    return docs.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language_id.held_out("doc_id", 4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    docs = docs.select("doc_id", held.alias("held_out"), toxicity.scored(model, F.col("text")).alias("score"))
    return docs.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op7_minhash_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
  ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM w UNION
  SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id)
SELECT w.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(root) AS component_id, w.doc_id = min(root) AS kept
FROM w JOIN reach ON reach.id = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id GROUP BY w.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op3_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM repeated),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j)
  GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def _repair_sql() -> str:
    space = r"[\x20\x09-\x0D]"
    bits = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, y: " \
           "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), " \
          f"lambda i: ascii(k[i])::BIGINT)), lambda c, x: {bits}), 4294967295)"

    def edit(state: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}} END"

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"

    kept, named = "chr(10) || role || ':' || text", "chr(10) || '{}:' || text"
    stays = "NOT (blank OR dup)"

    def reached(state: int, name: str, before: list[int], initial: str) -> str:
        return least(edit(f"p{state}", "3", "D"),
                     *[edit(f"p{q}", "trunc", "K", kept, f"{stays} AND initial = '{initial}'") for q in before],
                     *[edit(f"p{q}", "2 + trunc", "R", named.format(name), stays) for q in before if name])

    user = least("n2", *[edit(x, "2", "I", "chr(10) || 'user:'") for x in ("n0", "n1", "n3")])
    return rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {crc} % 20 AS f FROM raw),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE f <> 0),
numbered AS (SELECT *, left(role, 1) AS initial, row_number() OVER chat AS i, lag(left(role, 1)) OVER chat AS last,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged WINDOW chat AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
facts AS (SELECT *, again AND NOT blank AS dup, (NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?]{space}*$'))::INT
  AS trunc FROM numbered),
fold AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS p0,
  {{'c': 1000000000000::BIGINT, 'a': '', 'r': ''}} AS p1, {{'c': 2::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'}} AS p2,
  {{'c': 4::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, n0, n1, u, {least("n3", edit("u", "2", "I", "chr(10) || 'assistant:'"))}
  FROM (SELECT *, {user} AS u FROM (SELECT fold.conv_id, facts.i, {edit("p0", "3", "D")} AS n0,
    {reached(1, "", [0], "s")} AS n1, {reached(2, "user", [0, 1, 3], "u")} AS n2,
    {reached(3, "assistant", [2], "a")} AS n3
    FROM fold JOIN facts ON fold.conv_id IS NOT DISTINCT FROM facts.conv_id AND facts.i = fold.i + 1))),
ends AS (SELECT conv_id, {least("p0", "p3")} AS best FROM fold
  QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, sum(trunc) AS truncated,
  count(*) FILTER (last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM facts GROUP BY 1)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(substr(best.r, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id"""


@query("op11_conversation_repair", _repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(repair(damaged(table(spark, sf_dir, "conversations")), gone="gone"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_grammar_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents in compressed shards and reads them back."""
    return read_documents(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
