"""Pairs of a version diff: each old entity in turn takes the likest free new one of its source, if it is like enough.

Turns go by the old entities' hash; of equally like ones the least hash is taken. That is a stable matching in which every new entity prefers the
least old one, and there is only one such matching. So it is found by offers, in rounds over the whole cluster: each old entity
without a partner offers to the best entry of its list that is not held by a smaller one, a new one holds the least offer so far, and who
loses it goes on. No source, class or component is ever in one task.

Entities that share the same (field, value) tokens with the other side are equally like anything, and form a class. Lists belong to classes; the r-th of a class's entities without a partner
offers to the r-th open entry, as the ones before it are better placed for all entries before that. Lists begin short: a class first looks for
entities that share at least half of its weight, and only where some of its entities are left over for half of that, down to the least
similarity. Candidates of a threshold come from an index of tokens by the class's rarest ones (what remains weighs less than the threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.scratch import fresh, placed

LEAST_WEIGHT, LEAST_SIMILARITY = 0.1, 0.3
_CLOSE = 1e-9  # sums in another order


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + t["w"])


def classes(tokens: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, side, sig, tokens) and its members (source, side, sig, hash) of tokens (source, side, hash, field, value).

    Only tokens that both sides of a source have count. A class's tokens are by rarity; sig is their digest.
    """
    key = ["source", "field", "value"]
    shared = tokens.groupBy(*key).agg(F.min("side").alias("a"), F.max("side").alias("b"), F.count("*").alias("n")).where("a < b")
    worth = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(LEAST_WEIGHT))
    shared = _kept(shared.join(weights, "field", "left").select(*key, "n", worth.alias("w")), "tokens")
    listed = tokens.join(shared, key).groupBy("source", "side", "hash").agg(F.array_sort(F.collect_list(F.struct("n", "field", "value", "w"))).alias("tokens"))
    sig = F.sha2(F.concat_ws("\x00", F.transform("tokens", lambda t: F.concat(F.length(t["field"]).cast("string"), F.lit(" "), t["field"], F.lit(" "), t["value"]))), 256)
    rows = _kept(listed.withColumn("sig", sig), "entities")
    return _kept(rows.groupBy("source", "side", "sig").agg(F.any_value("tokens").alias("tokens")), "classes"), rows.select("source", "side", "sig", "hash")


def scored(ours: DataFrame, theirs: DataFrame, at_least: str) -> DataFrame:
    """(source, sig, other, score) of classes of ours and theirs whose similarity is at least ours's column at_least."""
    rest = lambda i: _weight(F.slice("tokens", i + 1, F.size("tokens")))
    telling = F.filter("tokens", lambda t, i: rest(i) >= F.col(at_least) - _CLOSE)
    asks = ours.select("source", "sig", F.explode(telling).alias("t")).select("source", "sig", "t.field", "t.value")
    held = theirs.select("source", F.col("sig").alias("other"), F.explode("tokens").alias("t")).select("source", "other", "t.field", "t.value")
    found = asks.join(held, ["source", "field", "value"]).select("source", "sig", "other").distinct()
    both = found.join(ours.select("source", "sig", "tokens", at_least), ["source", "sig"]).join(theirs.select("source", F.col("sig").alias("other"), F.col("tokens").alias("t2")), ["source", "other"])
    # Summed up by field, so that equal sets of fields have equal sums.
    same = F.array_sort(F.transform(F.array_intersect("tokens", "t2"), lambda t: F.struct(t["field"].alias("field"), t["w"].alias("w"))))
    return both.withColumn("score", _weight(same)).where(F.col("score") >= F.col(at_least)).select("source", "sig", "other", "score")


def matched(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, old, new): the pairs, by hash. tokens: (source, side, hash, field, value) of both sides; weights: (field, weight)."""
    groups, members = classes(tokens, weights)
    theirs = groups.where("side = 2")
    news = members.where("side = 2").select("source", F.col("sig").alias("other"), F.col("hash").alias("new"))
    olds = members.where("side = 1").select("source", "sig", F.col("hash").alias("old"))
    current = groups.where("side = 1").withColumn("least", F.greatest(F.lit(LEAST_SIMILARITY), _weight(F.col("tokens")) / 2))
    lists, pairs, group = None, None, ["source", "sig"]
    while True:
        more = _kept(scored(_kept(current, "thresholds"), theirs, "least"), "scores")
        # A class's new list replaces its shorter one.
        lists = more if lists is None else _kept(lists.join(current.select("source", "sig"), ["source", "sig"], "left_anti").unionByName(more), "lists")
        while True:
            free = olds if pairs is None else olds.join(pairs, ["source", "old"], "left_anti")
            free = _kept(free.join(lists.select("source", "sig").distinct(), ["source", "sig"], "left_semi"), "free")
            first = free.groupBy("source", "sig").agg(F.min("old").alias("first"))
            entries = lists.join(first, ["source", "sig"]).join(news, ["source", "other"])
            if pairs is not None:
                entries = entries.join(pairs.withColumnRenamed("old", "holder"), ["source", "new"], "left").where("holder IS NULL OR holder > first")
            entries = entries.select("source", "sig", "score", "new")
            offers = placed(free, group, [F.col("old")], "r").join(placed(entries, group, [F.col("score").desc(), F.col("new")], "r"), [*group, "r"]).select("source", "old", "new")
            offers = _kept(offers, "offers")
            if offers.isEmpty():
                break
            all_ = offers if pairs is None else pairs.unionByName(offers)
            pairs = _kept(all_.groupBy("source", "new").agg(F.min("old").alias("old")).select("source", "old", "new"), "pairs")
        left = olds if pairs is None else olds.join(pairs, ["source", "old"], "left_anti")
        left = left.select("source", "sig").distinct()
        current = _kept(current.where(F.col("least") > LEAST_SIMILARITY).join(left, ["source", "sig"], "left_semi").withColumn("least", F.greatest(F.lit(LEAST_SIMILARITY), F.col("least") / 2)), "current")
        if current.isEmpty():
            return pairs if pairs is not None else olds.select("source", "old", F.col("old").alias("new")).where("false")
