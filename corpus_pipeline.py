"""A corpus from raw documents to a mixture, in five stages of the operators in ``mixframe.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and all that the one before kept, and returns the columns of
``documents``; only the last adds its own.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.llm import decontaminate, ngram_join, source_mixing, suffix_array_dedup, toxicity
from mixframe.session import read_table, stage

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the other columns in one, so that no column of an operator replaces one of the user's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("__row"), *others).alias("row"))


def unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with the texts of ``out``."""
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; labels are learned from two thirds of the ids, as in op8."""
    learned = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    lexicon = toxicity.fit(learned, read_table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), lexicon).filter(F.col("score") < TOXIC), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group with a similarity of 0.8 over five-word shingles: that with the smallest id, null first.

    Rows are judged one by one: what shares an id with a copy, or has none, stays or goes by its own text.
    """
    return ngram_join.first_of_groups(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes what occurs earlier, 100 bytes or more at a time; a text of which nothing is left goes, a null text becomes an empty one."""
    cut = suffix_array_dedup.drop_repeated_bytes(packed(docs)).filter("n_removed = 0 OR n_removed < n_bytes")
    out = unpacked(cut, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects every row whose text holds a test item of ``benchmark``, whatever its id."""
    return decontaminate.without_matches(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of copies that gives the sources their weights."""
    return source_mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats),
          ("benchmark_decontamination", drop_contaminated), ("source_mixing", mix)]

#: SQL cannot express the fitted lexicon, the edit distance or the search for the exponent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name)
    return docs
