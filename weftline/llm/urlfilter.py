"""URL verdicts by rules and, where none fits, by trust and distrust over the links between hosts.

DataFrame functions only. Trust starts from hosts in proportion to their pages that a rule allows and follows
links; distrust starts from their pages that a rule blocks and follows links backwards, to those who
link there. Both are personalised PageRanks, iterated until they change by at most TOLERANCE of their total. A host is
blocked when distrust makes up more than THRESHOLD of its distrust, trust and neutral mass, the last being one
restart share for each page that no rule fits; without links that is the share of its pages that rules block.

Null urls and urls without `://` have an empty host and path; no rule fits and the verdict is allow. Null and empty html
has no links; links of a host to itself count for nothing. Repeated pages count each. Other columns of the table
are not looked at. Rules are a parameter: a list a person writes, not data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, stage_table

DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
#: A round moves at most DAMPING times what the one before moved, so the tolerance holds by then; one more for rounding.
MOST_ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING)) + 1
#: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(h: Column, p: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None)
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links from host to other host; w counts pages."""
    to = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), 1)
    each = pages.select(host(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(to, lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
    return each.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def ranks(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) in pages: PageRanks times the count of seeds.

    hosts: (host, allowed, blocked); edges: (src, dst, w).
    """
    out_w = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    in_w = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    e = stage_table(edges.join(out_w, "src").join(in_w, "dst").select("src", "dst", (F.col("w") / F.col("out_w")).alias("f"), (F.col("w") / F.col("in_w")).alias("b")), "edges")
    restart = hosts.select("host", ((1 - DAMPING) * F.col("allowed")).alias("t"), ((1 - DAMPING) * F.col("blocked")).alias("d"))
    state = restart = stage_table(restart, "restart")
    if e.isEmpty():
        return state.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))
    zero = F.lit(0.0)
    for _ in range(MOST_ROUNDS):
        down = e.join(state, e.src == state.host).select(F.col("dst").alias("host"), (DAMPING * F.col("f") * F.col("t")).alias("t"), zero.alias("d"))
        up = e.join(state, e.dst == state.host).select(F.col("src").alias("host"), zero.alias("t"), (DAMPING * F.col("b") * F.col("d")).alias("d"))
        new = restart.unionByName(down).unionByName(up).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = cut(new)
        was = state.select("host", F.col("t").alias("t0"), F.col("d").alias("d0"))
        moved = new.join(was, "host", "left").agg(
            F.sum(F.abs(F.col("t") - F.coalesce("t0", zero)) + F.abs(F.col("d") - F.coalesce("d0", zero))).alias("moved"), F.sum(F.col("t") + F.col("d")).alias("all")
        ).first()
        state = new
        if (moved["moved"] or 0.0) <= TOLERANCE * (moved["all"] or 0.0):
            break
    else:
        raise RuntimeError(f"ranks still move after {MOST_ROUNDS} rounds")
    return state.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    said = lambda v: F.count_if(F.col("m.verdict") == v)
    hosts = stage_table(rows.where("host <> ''").groupBy("host").agg(said("allow").alias("allowed"), said("block").alias("blocked"), F.count_if(F.col("m").isNull()).alias("free")), "hosts")
    scored = ranks(hosts, links(pages)).join(hosts, "host").where("free > 0")
    mass = F.col("distrust") + F.col("trust") + (1 - DAMPING) * F.col("free")
    bad = scored.where(F.col("distrust") > THRESHOLD * mass).select("host", F.lit("block").alias("judged"))
    return rows.join(bad, "host", "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), F.col("judged"), F.lit("allow")).alias("verdict")
    )
