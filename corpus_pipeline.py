"""A corpus pipeline of five stages, each over all that the one before kept.

toxicity (documents scored as toxic go), language (documents whose language is
rejected go), near duplicates on five-word shingles (the least id of each group
stays), substring deduplication (repeated runs of words are cut out of all but
their first document) and packing into training sequences. All but the last
return the columns of ``documents``; nothing here keeps rows by any other rule.

For all stages: an empty table gives none; a null text counts as its operator says; a very long text is worked on
whole; further columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import filters, language, neardup, packing, shared, substrings, toxicity
from emberlog.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from labels of documents that it gets. Repeated rows go or stay together, as do equal texts; a null or empty text stays unless all labels are toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["text", "lang", "source", "n_chars"])
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null, no letters, or farther from their language than its own documents are. Repeated rows are judged alike."""
    found = language.predict(docs, language.fit(docs), keep=["text", "lang", "source", "n_chars"])
    return found.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of least id stays; rows without an id all stay.

    Rows that repeat the id and text of one that stays are duplicates too: one of them stays.
    Only texts that may have to go or are repeated are shuffled; the others pass.
    """
    judged, _ = shared.written(shared.few(neardup.near_duplicates(docs, n=5).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("doc_id is not null and (not kept or rows > 1)")))
    doubtful = filters.id_filter(judged.select("doc_id"))
    some = filters.passing(docs, doubtful, "doc_id").join(judged.where(~F.col("kept")), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return filters.passing(docs, doubtful, "doc_id", inverse=True).unionByName(some).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a document of smaller id has in a run of thirteen; n_chars follows the text. No row goes; rows that share an id, or have none, leave each other alone."""
    found = substrings.deduplicate(docs, keep=["lang", "source", "n_chars"])
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of at most 4096 ids; a null or empty text is its end id. Repeated rows are packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", drop_near_duplicates), ("substrings", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written as Parquet in the shared folder and read again.

    What a stage wrote on its way, and its input, are deleted once its result is written.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with shared.cleared(spark):
            docs, new = shared.written(stage(spark, docs, sf_dir), keep=True)
        if path is not None:
            shared.remove(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
