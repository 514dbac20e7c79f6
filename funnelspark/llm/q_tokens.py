"""Queries of the operators on token ids. SQL has no tokenizer; tests compare them with plain code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, huffman, packing
from .registry import query, table


def vocabulary() -> str:
    """The byte-level vocabulary of 50k ids that is installed beside the tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = huffman.new_file(spark)
    huffman.write_ids(table(spark, sf_dir, "documents"), vocabulary(), out)
    return huffman.read_digests(spark, out)


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())
