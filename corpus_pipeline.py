"""The corpus pipeline: language ID, near-duplicates, substrings, benchmark passages, tokens, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
``docs``. All stages but the last return the columns of ``docs``, more than those of ``documents`` too; a null in any column
but the text is kept as it is, repeated rows are rows of their own, and an empty table gives no rows. Texts of any length are
worked on as a whole. ``n_chars``, where it is there, follows a text that was changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, decontamination, language_id, simhash, substring
from kinfold.llm.common import ROW, rowed, staged, table
from kinfold.llm.repeats import BROADCAST_BYTES

#: Least share of a text's trigrams that some language has to contain.
LEAST_LANGUAGE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without any letter and texts that no learnt language contains to LEAST_LANGUAGE of its trigrams.

    The filter learns from all of ``docs`` with a language, so a text with one vouches for its own trigrams: what goes is text
    without letters, and text without a language whose trigrams hardly occur elsewhere. Null and empty texts go. Equal texts
    are kept or go together; of languages with equal scores the first by name counts, which decides nothing here.
    """
    rows, names = _private(docs)
    found = language_id.predict(rows, language_id.fit(docs))
    return _restored(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE)), docs, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the one with the smallest id (null ids last), of equal ids the first.

    Texts that share 0.8 or more of their five-word shingles are near duplicates; null and empty texts are copies of each
    other. Rows with equal ids are told apart by their place in ``docs``.
    """
    rows, names = _private(docs)
    rows, own = rowed(rows), F.col(names["doc_id"])
    key = F.struct(own.isNull().alias("null"), own.alias("id"), F.col(ROW).alias("row"))
    groups = staged(simhash.near_groups(rows).join(rows.select(ROW, key.alias("key")), ROW), "groups")
    kept = groups.groupBy("component").agg(F.min("key").alias("least")).select(F.col("least.row").alias(ROW))
    gone = staged(groups.select(ROW).join(kept, ROW, "left_anti"), "gone")
    small = 64 * gone.count() <= BROADCAST_BYTES
    return _restored(rows.join(F.broadcast(gone) if small else gone, ROW, "left_anti"), docs, names)


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of repeated 35-word windows; texts without any stay as they are, texts with nothing left go.

    All occurrences go, so a row that is repeated and has 35 words or more goes with all its copies. A null text stays null.
    """
    rows, names = _private(docs)
    found = substring.remove_repeats(rows, id_col=names["doc_id"])
    touched = F.col("n_removed") > 0
    out = found.where(~touched | (F.col("n_removed") < F.col("n_words")))
    return _restored(out.withColumn("text", F.when(touched, F.col("kept")).otherwise(F.col("text"))), docs, names, changed=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes spans of benchmark windows; a text of which more than half is hit goes. A null text stays null, and a text
    without hits stays as it is; repeated rows and items change nothing."""
    rows, names = _private(docs)
    return _restored(decontamination.remove_contamination(rows, table(spark, sf_dir, "benchmark")), docs, names, changed=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (binary, little-endian unsigned 32-bit integers) with their number and digests.

    The text itself is what the ids decode to. Other columns are kept; those named like results are replaced. A null text
    has no ids.
    """
    results = ("text", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.digests(docs, keep=tuple(c for c in docs.columns if c not in results), ids="ids")


def _private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the text under names that no operator has, and those names."""
    names = {c: f"_kin_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    return docs.select("text", *(_column(c).alias(n) for c, n in names.items())), names


def _restored(df: DataFrame, docs: DataFrame, names: dict[str, str], changed: bool = False) -> DataFrame:
    """The columns of ``docs`` again, with the text of ``df``; ``n_chars`` is counted anew where texts may have ``changed``."""
    count = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if changed and "n_chars" in names else None
    own = lambda c: F.col("text") if c == "text" else count if c == "n_chars" and count is not None else F.col(names[c]).alias(c)
    return df.select(*(own(c) for c in docs.columns))


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_substrings),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Trained, hashed and tokenised stages have no SQL; a plain version on a small table stands for it in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
