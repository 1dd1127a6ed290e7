"""Whether a page has changed enough to be processed again: a ladder of checks, cheapest first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import jsonops
from weftline.functions.scalars import canonical, let, trim_u, word_count

BAD_FETCH, TOO_LITTLE, ENOUGH = 0.27, 0.02, 0.15
SAMPLE_LINES, MOST_LINES, LINE_BYTES, ALL_BYTES = 37, 75, 200, 8000


def lines(c: Column) -> Column:
    """The lines that hold a letter, digit or underscore, trimmed."""
    return F.filter(F.transform(F.split(c, "\n"), trim_u), lambda x: (x != "") & ~x.rlike(r"^[^0-9A-Za-z_]+$"))


def added(old: Column, new: Column) -> Column:
    """Lines of new that old lacks, as often as they stand there."""
    return let(lines(old), lambda known: F.filter(lines(new), lambda x: ~F.array_contains(known, x)))


def removed(old: Column, new: Column) -> Column:
    return added(new, old)


def words(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0), lambda n, x: n + word_count(x))


def urls(c: Column) -> Column:
    """The lines that are URLs, once each."""
    return F.array_distinct(F.filter(lines(c), lambda x: x.startswith("http://") | x.startswith("https://")))


def has_new_urls(old: Column, new: Column) -> Column:
    return F.size(F.array_except(urls(new), urls(old))) > 0


def sampled(rows: Column, most: int = SAMPLE_LINES) -> Column:
    """At most `most` of rows, evenly by a whole step."""
    step = lambda r: F.greatest(F.floor(F.size(r) / most).cast("int"), F.lit(1))
    return let(rows, lambda r: F.when(F.size(r) <= most, r).otherwise(F.slice(let(step(r), lambda n: F.filter(r, lambda x, i: i % n == 0)), 1, most)))


def clipped(rows: Column) -> Column:
    """Lines as they are put to the judge: 75 at most, 200 bytes each, 8000 in all."""
    cut = lambda x: F.concat(F.substring(x.cast("binary"), 1, LINE_BYTES).cast("string"), F.lit("…"))
    short = F.transform(F.slice(rows, 1, MOST_LINES), lambda x: F.when(F.octet_length(x) > LINE_BYTES, cut(x)).otherwise(x))
    upto = lambda all_, i: F.aggregate(F.slice(all_, F.lit(1), i + 1), F.lit(0), lambda n, y: n + F.octet_length(y))
    return let(short, lambda all_: F.filter(all_, lambda x, i: upto(all_, i) <= ALL_BYTES))


def ladder(pages: DataFrame, old: str = "old", new: str = "new", with_links: Column | None = None, forced: Column | None = None, decide: Callable[[Column], Column] | None = None) -> DataFrame:
    """pages with `level` (which check spoke) and `proceed`.

    forced: the schema changed, so all go on. with_links: only new URLs count. decide: what the judge of the gray zone says
    of its sampled lines; without one, it goes on. Lines are found once for each text.
    """
    known, fresh = F.col(old), F.col(new)
    stored, incoming = words(lines(known)), words(lines(fresh))
    measured = pages.withColumn("_stored", stored).withColumn("_incoming", incoming)
    measured = measured.withColumn("_added", added(known, fresh)).withColumn("_removed", removed(known, fresh))
    delta = (words(F.col("_added")) + words(F.col("_removed"))) / F.nullif(F.col("_stored"), F.lit(0))
    level = (
        F.when(F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False), "forced")
        .when(F.coalesce(fresh, F.lit("")) == "", "empty")
        .when(F.coalesce(with_links, F.lit(False)) if with_links is not None else F.lit(False), "urls")
        .when((F.coalesce(known, F.lit("")) != "") & (F.sha2(known, 256) == F.sha2(fresh, 256)), "same")
        .when((F.col("_stored") > 0) & (F.col("_incoming") / F.col("_stored") < BAD_FETCH), "bad_fetch")
        .when(delta < TOO_LITTLE, "too_little").when(delta >= ENOUGH, "enough").otherwise("gray")
    )
    sample = clipped(F.concat(sampled(F.col("_added")), sampled(F.col("_removed"))))
    judged = F.coalesce(decide(sample), F.lit(True)) if decide else F.lit(True)
    proceed = F.when(F.col("level") == "urls", has_new_urls(F.coalesce(known, F.lit("")), fresh)).when(F.col("level") == "gray", judged).otherwise(F.col("level").isin("forced", "enough"))
    return measured.withColumn("level", level).withColumn("proceed", proceed).drop("_stored", "_incoming", "_added", "_removed")


def entity_changed(old: str | None, fresh: str | None) -> bool:
    """Whether a field that both JSON entities have differs; the source aside."""
    a, b = jsonops.decode(old) or {}, jsonops.decode(fresh) or {}
    return any(canonical(a[k]) != canonical(b[k]) for k in a.keys() & b.keys() if k != "_source")
