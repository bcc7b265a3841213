"""The training-text pipeline: each stage takes (spark, docs, sf_dir) and returns what the next one works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import contamination
from graphloom.llm.jaccard_join import jaccard_classes
from graphloom.llm.packing import pack, token_pieces
from graphloom.llm.quality import CORPUS_RULES, passing
from graphloom.plans.shared import written
from graphloom.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express the packing.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Each document as one column beside its text, so that a filter needs no join to find the rest."""
    return docs.select(F.struct(*COLUMNS).alias("row"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; repeated lines count by their share of the words."""
    return passing(docs.select(*COLUMNS), CORPUS_RULES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows joined by links of 0.8 over five-word shingles, one stays: with the smallest id, then the smallest hash of
    its text, then the smallest text.

    Rows that share an id stand each for itself, so that those with unrelated texts all stay. Of rows with the same id
    and text one stays, with the smallest lang, source and n_chars. Rows whose id is null all stay; they link with
    nothing.
    """
    docs = docs.select(*COLUMNS)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    # distinct ids name their rows as they are; the result is the same as with numbers
    rows, name = (docs, "doc_id") if repeated.isEmpty() else (_numbered(docs), "number")
    classes = jaccard_classes(rows, shingle=5, num=80, den=100, id_col=name)
    gone = classes.where(f"{name} <> component_id").select(name).distinct()
    return rows.join(gone, name, "left_anti").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """One row for each id and text, with a number that goes by id, hash of the text and text; null ids are not numbered."""
    named = docs.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    order = ("doc_id", "hash", "text")
    named = named.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions(*order)
    named = named.select("doc_id", "text", "rest.*", F.monotonically_increasing_id().alias("number"))
    unnamed = docs.where("doc_id IS NULL").withColumn("number", F.lit(None).cast("bigint"))
    return written(named.unionByName(unnamed), "numbered")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated windows go; a document keeps its row even if no word is left."""
    found = substring_dedup(docs, carry=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "carry.lang", "carry.source", F.length("kept").cast("bigint").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in benchmark windows go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(_rows(docs), benchmark, id_col="row").where("NOT contaminated").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
