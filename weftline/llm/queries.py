"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontam, embedding, langid, license, lm, quality, ranked, simhash, substring, trie, urlfilter, warc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learned from six folds in seven."""
    return lm.folds(_t(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    return warc.round_trip(_t(spark, sf_dir, "pages"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document, with coverage and span."""
    return license.scanned(_t(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; texts are read whole."""
    return bpe.digests(_t(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or link verdict of every page."""
    return urlfilter.verdicts(_t(spark, sf_dir, "pages"))


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.93 or more within a label."""
    return embedding.groups(_t(spark, sf_dir, "embeddings"), 0.93)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from two folds of the labels."""
    return quality.scored(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.groups(_t(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two folds of the documents."""
    return langid.labelled(_t(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontam.contained(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked.search(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    return trie.digests(_t(spark, sf_dir, "conversations"))


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 words and more that an earlier one holds."""
    return substring.digests(_t(spark, sf_dir, "documents"))


def urlfilter_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator over pages put together from `pages`, as those hold no link to another host: sixty hosts in rings and chords, some of them blocked."""
    host = lambda n: F.concat(F.lit("http://h"), F.pmod(n, F.lit(60)).cast("string"), F.when(F.pmod(n, F.lit(60)) % 7 == 0, ".com").otherwise(".net"))
    k = F.col("page_id")
    path = F.when(k % 5 == 0, "/es/a").when(k % 11 == 0, "/fr/b").otherwise("/x")
    html = F.concat(F.lit('<a href="'), host(k * 7 + 1), F.lit('/y"><a href="'), host(k + 1), F.lit('/">'))
    return urlfilter.verdicts(_t(spark, sf_dir, "pages").select("page_id", F.concat(host(k), path).alias("url"), html.alias("html")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_warc": op2_warc,
    "op3_license": op3_license,
    "op4_bpe": op4_bpe,
    "op5_urlfilter": op5_urlfilter,
    "op6_embedding": op6_embedding,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_langid": op9_langid,
    "op10_decontam": op10_decontam,
    "op11_ranked": op11_ranked,
    "op12_trie": op12_trie,
    "op13_substring": op13_substring,
    "urlfilter_linked": urlfilter_linked,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.ROUND_TRIP_SQL,
    "op10_decontam": decontam.CONTAINED_SQL,
    "op11_ranked": ranked.SEARCH_SQL,
    "op12_trie": trie.DIGESTS_SQL,
    "op13_substring": substring.DIGESTS_SQL,
}
