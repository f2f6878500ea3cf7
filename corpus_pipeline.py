"""A corpus pipeline of five of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixture, ngram_join, queries, secrets, toxicity
from graphloom.llm.common import settle, table

#: Pieces of each output shard that tasks shuffle and write on their own.
PIECES = 256
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones, does not reject.

    Null and empty texts have the base rate, are never rejected and stay; rows alike in text stand or fall
    together; null ids and repeated rows are judged like others; without labels all documents stay.
    """
    judged = toxicity.classify(docs, queries.chain(spark, sf_dir, docs))
    return judged.filter(~F.col("is_toxic")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on five-word shingles, exactly one row: that of least id.

    Copies are told apart as rows, not by id: of rows that share an id, only those in a group with a
    lesser row go; null ids come last; of wholly equal rows one stays. Texts without words are no copies
    of each other and all stay.
    """
    own = [F.col(c) for c in COLUMNS]
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.xxhash64(*own, *[c.isNull() for c in own]).alias("print"))
    keyed = docs.select(*own, key.alias("row"))
    found = settle(ngram_join.components(keyed, ngram_join.shingles(5), 80, doc_id="row").filter("n > 0").select(F.col("id").alias("row"), "component"))
    extra = found.filter("row <> component").select("row").distinct()
    again = found.filter("row = component").groupBy("row").count().filter("count > 1").select("row")
    single = keyed.join(extra.union(again), "row", "left_anti")
    return single.union(keyed.join(again, "row", "left_semi").dropDuplicates(["row"]).select(*single.columns)).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the scan reports replaced by a mark.

    Null and empty texts and texts without a report stay as they are; ``n_chars`` is counted again only
    where something was replaced; spans that overlap are replaced as one; repeated rows change alike.
    """
    found = secrets.find(docs, into="spans")
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents, as often as each source's target draws them, shuffled into shards.

    A null source is a source of its own; null and empty texts weigh nothing and are drawn in whole passes
    only; rows that hash alike are ordered by all their columns; a document drawn twice is there twice.
    """
    drawn = mixture.drawn_rows(mixture.mix(docs.select(*COLUMNS), whole=True))
    pieces = F.pmod(F.col("mix.order"), F.lit(PIECES))
    shards = drawn.repartition("mix.shard", pieces).sortWithinPartitions("mix.shard", "mix.order")
    return shards.select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix's texts, one row a drawn document; null counts as the empty text."""
    return queries.encoded_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Training, components and hashed draws have no SQL; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's output is settled, so later stages never repeat earlier ones."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
