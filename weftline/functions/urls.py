"""URL functions: normal forms, filters, kinds of links and sources; column expressions but for joining to a base."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import let, trim_u

#: Domains whose links are not followed.
UNFOLLOWED = (
    "twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com", "pinterest.com", "snapchat.com", "reddit.com", "old.reddit.com",
    "threads.net", "whatsapp.com", "telegram.org", "discord.com", "twitch.tv", "tumblr.com", "substack.com",
)
#: Hosts and paths that search results are freed of.
SEARCH_HOSTS = ("youtube.com", "youtu.be", "twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com", "t.me", "telegram.org", "whatsapp.com", "discord.com", "twitch.tv", "vimeo.com")
SEARCH_PATHS = (
    "/login", "/signin", "/sign-in", "/signup", "/sign-up", "/register", "/checkout", "/cart", "/account", "/auth", "/subscribe", "/membership",
    "/password", "/reset", "/verify", "/oauth", "/callback", "/logout", "/session",
)
#: Extensions of files that are never fetched, and of documents whose links are always kept.
REJECTED = (
    ".mp3", ".mp4", ".mov", ".avi", ".mkv", ".webm", ".exe", ".dmg", ".iso", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico",
    ".woff", ".woff2", ".ttf", ".eot",
)
DOCUMENTS = (".pdf", ".epub", ".mobi", ".zip", ".rar", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".azw", ".azw3", ".djvu", ".fb2")
#: Extensions by kind of link, in the order of asking.
LINK_KINDS = (
    ("file", "pdf|csv|zip|tar|gz|tar\\.gz|tar\\.bz2|rar|7z|docx?|xlsx?|pptx?|txt|json|xml|yaml|yml|md|epub|mobi|iso|dmg|exe|apk|deb|rpm|sh|py|js|ts|go|rs|cpp|c|h|java|kt|swift|sql|db|sqlite|log|torrent"),
    ("video", "mp4|mov|avi|mkv|webm|flv|wmv|m4v|3gp|ogv|ts|mpg|mpeg"),
    ("audio", "mp3|wav|ogg|flac|aac|m4a|wma|opus|aiff|mid|midi"),
    ("image", "jpg|jpeg|png|gif|webp|svg|bmp|tiff?|ico|avif|heic|heif"),
)
LINK = r"""https?://[^\t\n\f\r )\]"]+"""
#: Accounts that no person writes from.
BOTS = ("AutoModerator", "reddit", "BotDefense")


def normal(c: Column) -> Column:
    """One spelling: lower case, no outer white space, no slashes at the end."""
    return F.regexp_replace(trim_u(F.lower(c)), "/+$", "")


def domain(c: Column) -> Column:
    """What stands before the first slash, without scheme and www."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(c, "^https?://", ""), r"^www\.", ""), "/", 1)


def host(c: Column) -> Column:
    """The authority without user, port and www., in lower case; null where there is none."""
    h = F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(h != "", F.regexp_replace(h, r"^www\.", ""))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def followed(c: Column) -> Column:
    return ~domain(c).isin(*UNFOLLOWED)


def rejected(c: Column) -> Column:
    """Whether an extension of a file that is never fetched stands anywhere in it."""
    return F.lower(c).rlike("|".join(x.replace(".", r"\.") for x in REJECTED))


def blocked_result(c: Column) -> Column:
    """Whether a search result's URL is of no use: its host, or its path."""
    p = F.lower(path(c))
    paths = "|".join(SEARCH_PATHS)
    return F.coalesce(host(c), F.lit("")).isin(*SEARCH_HOSTS) | p.rlike(f"^({paths})(/.*)?$")


def filter_results(results: DataFrame, seen: DataFrame, limit: int, order: str) -> DataFrame:
    """results (url, ...) neither blocked nor in seen (url), the first `limit` by order."""
    return results.where(~blocked_result(F.col("url"))).join(seen, "url", "left_anti").orderBy(order).limit(max(limit, 0))


def merge_quotas(results: DataFrame, budget: int = 50, most: int = 10) -> DataFrame:
    """results (variation, engine, position, url): the first of each URL over engines and variations in order, each variation to its quota.

    The quota is budget / variations, `most` at most. Extra columns are dropped.
    """
    first = results.where(~blocked_result(F.col("url"))).groupBy("url").agg(F.min(F.struct("variation", "engine", "position")).alias("at")).select("url", "at.*")
    each = Window.partitionBy("variation").orderBy("engine", "position", "url")
    share = F.least(F.lit(most), F.floor(F.lit(budget) / results.agg(F.count_distinct("variation")).scalar()))
    return first.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= share)


def link_kind(c: Column, anchored: bool = False) -> Column:
    """file, video, audio, image or link. An extension counts wherever it stands; anchored: only at the end of the path."""
    end = r"(?:\?[^\t\n\f\r )\]\"]*)?" + ("$" if anchored else "")
    out = None
    for kind, ext in LINK_KINDS:
        hit = c.rlike(rf"""https?://[^\t\n\f\r )\]"]+\.(?:{ext}){end}""")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("link")


def links(c: Column) -> Column:
    """The distinct URLs in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({LINK})"), 1))


def links_by_kind(c: Column) -> Column:
    names = (("links", "link"), ("images", "image"), ("videos", "video"), ("audio", "audio"), ("files", "file"))
    of = lambda found, kind: F.filter(found, lambda x: link_kind(x) == kind)
    return let(links(c), lambda found: F.struct(*(of(found, kind).alias(name) for name, kind in names)))


def is_bot(author: Column) -> Column:
    return author.isin(*BOTS) | F.lower(author).endswith("bot")


def unwrapped(c: Column) -> Column:
    """The target of a search engine's redirect."""
    target = F.try_url_decode(F.regexp_extract(c, r"^https?://(?:www\.)?google\.com/url\?(?:[^#]*&)?(?:q|url)=([^&#]+)", 1))
    return F.when(target != "", target).otherwise(c)


def classify(c: Column, imported: Column) -> Column:
    """Where a URL of a new dataset comes from: reddit, import or serp."""
    h = host(unwrapped(c))
    return F.when((h == "reddit.com") | h.endswith(".reddit.com"), "reddit").when(imported, "import").otherwise("serp")


def first_urls(urls: DataFrame, group: str, order: str) -> DataFrame:
    """One row for each spelling-independent URL of a group, the first by order."""
    rows = [c for c in urls.columns]
    return urls.groupBy(group, normal(F.col("url")).alias("_n")).agg(F.min_by(F.struct(*rows), order).alias("_r")).select("_r.*")


def asin(c: Column) -> Column:
    """The ten characters after /dp/, up to a slash; empty if they are not ten."""
    x = F.regexp_extract(c, "/dp/([^/]*)", 1)
    return F.when(F.length(x) == 10, x).otherwise("")


def valid_asin(c: Column) -> Column:
    return F.upper(trim_u(c)).rlike("^[A-Z0-9]{10}$")


def listing_url(c: Column) -> Column:
    """A community page's JSON: .json after the path, and depth=10 for comments."""
    base, query = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, r"\?([^#]*)", 1)
    base = F.regexp_replace(base, "/+$", "")
    base = F.when(base.endswith(".json"), base).otherwise(F.concat(base, F.lit(".json")))
    depth = F.when(base.contains("/comments/"), "depth=10")
    query = F.concat_ws("&", F.when(query != "", query), depth)
    return F.when(query != "", F.concat_ws("?", base, query)).otherwise(base)


def last_part(c: Column) -> Column:
    """The last part of the path that is not empty."""
    parts = F.filter(F.split(path(c), "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def endpoint_guesses(c: Column) -> Column:
    """Where sites of common make keep a page's data."""
    base = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole, part = F.regexp_replace(path(c), "^/+|/+$", ""), last_part(c)
    made = F.array(*(F.concat(base, F.lit(f"/{p}/"), part) for p in ("api/posts", "api/articles", "api/content", "api/v1/posts", "api/v2/posts")), F.concat(base, F.lit("/ghost/api/content/posts/slug/"), part, F.lit("/")))
    none = F.array().cast("array<string>")
    return F.concat(F.when(whole != "", F.array(F.concat(base, F.lit("/"), whole, F.lit(".json")))).otherwise(none), F.when(part != "", made).otherwise(none))


def robots_endpoint(base: Column, robots: Column) -> Column:
    """The first path in a robots.txt that looks like an interface's; empty if there is none."""
    lines = F.transform(F.split(robots, "\n"), trim_u)
    paths = F.transform(F.filter(lines, lambda x: x.rlike("(?i)^(dis)?allow:")), lambda x: trim_u(F.regexp_replace(x, "^[^:]*:", "")))
    hit = F.get(F.filter(paths, lambda x: x.rlike("^/(api|v1|v2|graphql)")), 0)
    return F.when(hit.isNotNull(), F.concat(base, hit)).otherwise("")


def join_url(base: str | None, href: str | None) -> str:
    """href against base; empty for what leads nowhere."""
    href = (href or "").strip()
    if href in ("", "#") or href.startswith("javascript:"):
        return ""
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """join_url() of columns."""
    return pd.Series([join_url(b, h) for b, h in zip(base, href, strict=True)])


def same_host(a: str, b: str) -> bool:
    try:
        return urlsplit(a).netloc == urlsplit(b).netloc
    except ValueError:
        return False


