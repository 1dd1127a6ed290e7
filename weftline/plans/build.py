"""The way of a page: fetched, cleaned, formatted, extracted; and again when it is refreshed.

Each stage is a function from DataFrame to DataFrame; what the stages leave behind are columns and tables, so a stage can be
run on any input that has its columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import jsonops
from weftline.functions import pages as P
from weftline.functions import text as X
from weftline.functions.scalars import canonical, word_count
from weftline.functions.urls import normal


def cleaned(pages: DataFrame, key: str = "page_id", links: bool = False) -> DataFrame:
    """(key, source_url, title, content, word_count, score, description, metadata) of pages (key, url, html) with enough words.

    Pages of one spelling-independent URL are parsed once, of those the one of least key; pages without a URL stand alone. Sentences that several pages share go.
    """
    # The pages that are not their URL's first are few and light; html stays where it is.
    named = pages.where("url IS NOT NULL").select(normal(F.col("url")).alias("_n"), key)
    first = named.groupBy("_n").agg(F.min(key).alias("_least"))
    again = named.join(first, "_n").where(F.col(key) > F.col("_least")).select(key)
    once = pages.join(again, key, "left_anti").select(key, "url", "html")
    raw = P.extracted(once, links=links)
    text = raw.select(key, F.col("url").alias("source_url"), "title", X.clean(F.col("content"), links=links, code="keep").alias("content"), "metadata")
    kept = X.drop_repeated_sentences(text, key, "content", key)
    return kept.where(X.gate(F.col("content")).isNull()).select(
        key, "source_url", "title", "content", word_count(F.col("content")).alias("word_count"), X.quality(F.col("content")).alias("score"), X.description(F.col("metadata")).alias("description"), "metadata"
    )


def formatted(clean: DataFrame, key: str = "page_id", fields: int = 1, links: bool = False) -> DataFrame:
    """(key, source_url, content): compressed, as far as a schema of so many fields asks for it."""
    payload = X.format_payload(F.col("source_url"), X.compress(F.col("content"), links), fields)
    return clean.select(key, payload.alias("p")).select(key, "p.*")


def chunked(payloads: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, source_url, chunk, content): the pieces that a model is asked about."""
    return payloads.select(key, "source_url", F.posexplode(X.chunks(F.col("content"))).alias("chunk", "content"))


def extracted(chunks: DataFrame, ask: Callable[[str], str], key: str = "page_id") -> DataFrame:
    """(key, chunk, source_url, entities array<string>): what the model `ask` replies, as entities; replies that are no list give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["content"]:
                found = jsonops.decode(X.salvage_json_array(ask(text)))
                out.append([canonical(e) for e in found if isinstance(e, dict)] if isinstance(found, list) else [])
            yield frame.drop(columns="content").assign(entities=out)

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, "chunk", "source_url", "content").mapInPandas(run, f"`{key}` {kind}, chunk int, source_url string, entities array<string>")
