"""A training-data pipeline over documents, stage by stage.

Each stage takes all documents that its predecessor kept, as a table in the
shared folder, and all but the last return documents with all their columns,
whatever their names.  An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.decontamination import drop_contaminated
from tidepool.llm.jaccard import keep_one_of_each
from tidepool.llm.language import drop_unidentified, fit_language_model, training_rows
from tidepool.llm.mixing import mix_sources, quality_weights, word_count
from tidepool.llm.shared import Scratch
from tidepool.llm.toxicity import drop_toxic, labelled_lexicon


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; null and empty texts score as one without any term, and repeated rows stay."""
    return drop_toxic(docs, labelled_lexicon(docs, _table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language, or with a score under 0.5, go, as do null texts and texts without a letter; repeated rows stay."""
    return drop_unidentified(docs, fit_language_model(training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays; texts without words and rows without a doc_id stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and wordless texts stay, and without items all rows do."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents in the mix; a null source is one of its own, null texts take nothing."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(quality_weights(sized, _table(spark, sf_dir, "labels"))).where("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: The first two stages are learned models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
            scratch.drop(f"stage{k - 1}")
    return docs
