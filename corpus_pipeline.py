"""From raw documents to packed sequences: five operators in a row, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm import jaccard, packing, quality, substring, toxicity
from funnelspark.llm.q_tokens import vocabulary
from funnelspark.llm.registry import table
from funnelspark.session import staging_path


def _apart(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Documents whose own columns of these names are renamed, and how to name them back."""
    back = {f"_own_{n}": n for n in names if n in docs.columns}
    return docs.withColumnsRenamed({n: own for own, n in back.items()}), back


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts are rejected; repeated rows are judged each; a column ``rejected_by`` stays as it is.
    """
    own, back = _apart(docs, ["rejected_by"])
    judged = quality.filter_quality(own).filter("rejected_by is null").drop("rejected_by")
    return judged.withColumnsRenamed(back).select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by a grammar learned from the labels of those still there.

    Null and empty texts have the lowest score; repeated rows are scored each.
    """
    model = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return docs.filter(toxicity.score_column(model, F.col("text")) < 0.7)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id.

    Rows of equal doc_id are one document: the first by a hash of the text stays. Rows without an
    id have no links and stay.
    """
    found = jaccard.similar_documents(docs)
    stays = found.filter("component_id = doc_id").select(F.col("doc_id").alias("_stays")).distinct()
    met = docs.filter("doc_id is not null").join(stays, F.col("doc_id") == F.col("_stays"))
    # A mergeable minimum: rows of one id shrink before they move.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = met.groupBy("_stays").agg(F.min_by(whole, F.struct(F.xxhash64("text"), F.col("text"))).alias("_row"))
    return first.select("_row.*").unionByName(docs.filter("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that occur earlier; n_chars follows.

    Null texts become empty ones. Columns named like the operator's figures stay as they are.
    """
    own, back = _apart(docs, ["n_words", "n_removed"])
    rest = [c for c in own.columns if c not in ("doc_id", "text")]
    done = substring.dedup_substrings(own, keep=rest, whole=True).drop("n_words", "n_removed")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.withColumnsRenamed(back).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_similar),
    ("substring dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written to the shared folder. No documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staging_path(spark, f"corpus-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Packing needs the ids of a tokenizer, which SQL does not have.
ORACLE_SQL = None
