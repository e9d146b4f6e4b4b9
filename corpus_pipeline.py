"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, with the columns of ``documents``, and its result is written before the next one
reads it. In every stage extra columns, whatever their names, pass through with their rows; an empty table gives an empty result; repeated rows are decided alike.
Null and empty texts: never toxic unless the intercept says so, no lines to drop, near-duplicates of nothing; in mixing they have no tokens, so they go with the documents
around them, and all rows of a leaf without tokens go; they encode to no pieces. Null ids: scored, never a line's first document, always kept among near duplicates, one place in
the order of mixing. Very long texts are treated whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import line_dedup, mixing, nbest_pieces, ngram_join, store, toxicity


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def beside_extra_columns(stage: Stage) -> Stage:
    """The stage with all columns but those of ``documents`` renamed inside, so that no name of theirs can clash."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = {c: c if c in OWN else f"extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inside.items()]), sf_dir)
        return out.select(*[F.col(x).alias(c) for c, x in inside.items()])

    return run


@beside_extra_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on a bounded sample of the labelled ones, does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_score(docs, model, name="toxic_score").where("toxic_score < 0.5").select(*docs.columns)


@beside_extra_columns
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates; n_chars follows the text."""
    out = line_dedup.drop_recurring_lines(docs, strict=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@beside_extra_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return ngram_join.near_duplicate_representatives(docs, k=5, percent=80)


@beside_extra_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """80 % of the tokens, by domain, language and source, no document twice."""
    return mixing.mix(docs, mixing.WEIGHTS, levels=mixing.document_levels(), budget_percent=80, max_epochs=1).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, what the second to fourth best change in it, and their scores; the ids of each decode to the text."""
    return nbest_pieces.encode(docs, n=4).select("doc_id", "lang", "source", "n_pieces", "pieces", "scores", "alternatives")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can express neither the classifier nor the segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
