"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; all but the last return the columns of
``docs``. SQL cannot express the stages (learned models, similarity, tokenisation), so ORACLE_SQL is None.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosieve.llm import language_id, toxicity
from geosieve.llm.common import table, written
from geosieve.llm.near_dedup import near_duplicates
from geosieve.llm.packing import pack, token_pieces
from geosieve.llm.substring_dedup import remove_repeats

LEAST_LANGUAGE_SCORE = 0.5
SHINGLE = 5  # words
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic.

    Each row is judged by its own text: a null or empty one scores as clean text without words does and stays, equal rows
    have equal fates, and very long texts are scored whole. Without labelled rows nothing is rejected but by a
    constant score; an empty table stays empty. Columns besides doc_id and text pass unread.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~language_id.held_out("doc_id", 4, 2))
    return docs.where(toxicity.scored(model, F.col("text")) < toxicity.THRESHOLD)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language that was learned, and those the model doubts (a score under 0.5).

    A null, empty or letterless text is in no language and goes. Equal texts have equal fates. A null ``lang`` is
    not learned from; if no row has one, no language is known and all rows go. Other columns pass unread.
    """
    model = language_id.fit(docs, ~language_id.held_out("doc_id", 3, 1))
    found = language_id.predicted(model, F.col("text"))
    return docs.where((found["lang_pred"] != language_id.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, by shingles of five words.

    Null, empty and wordless texts are near nothing and stay. Rows that repeat an id stay or go together. Rows without
    an id cannot be named, so they stay. An empty table stays empty; other columns pass unread.
    """
    kept = near_duplicates(docs, width=SHINGLE).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"))
    known, nameless = docs.where(F.col("doc_id").isNotNull()), docs.where(F.col("doc_id").isNull())
    named = known.alias("d").join(kept.distinct().alias("k"), F.col("d.doc_id") == F.col("k.kept_id"), "left_semi")
    return named.unionByName(nameless)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words that an earlier document has too out of the texts; documents left empty by that go.

    Documents that lose nothing keep their text as it is, null and empty ones too; of others the kept words are joined
    by single spaces and n_chars follows. Rows without an id lose nothing; rows that repeat an id lose the same.
    """
    cut = remove_repeats(docs).where("n_removed > 0").groupBy("doc_id").agg(F.max("kept_text").alias("kept"))
    kept = F.col("c.kept")
    rows = docs.alias("d").join(cut.alias("c"), F.col("d.doc_id") == F.col("c.doc_id"), "left").where(
        kept.isNull() | (kept != ""))
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return rows.select(*[F.when(kept.isNull(), F.col(f"d.`{c}`")).otherwise(new[c]).alias(c) if c in new
                         else F.col(f"d.`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises the documents and places their pieces in sequences.

    A null or empty text is one piece, the end id alone; repeated rows are packed each; no rows make no sequences. Very
    long texts are cut into pieces of a sequence. Of the columns only doc_id and text are used.
    """
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
