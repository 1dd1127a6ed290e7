"""Registered queries over texts and pages. Inputs that the tables lack are appended by expressions that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import pages as P
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.functions.scalars import slug, word_count
from weftline.plans.tables import t

_TEXT = "concat(text, CASE doc_id % 6 WHEN 0 THEN ' <b>x</b> updated: 5 May 2020 at 10:30 pm' WHEN 1 THEN ' 3 days ago 1,200 views 2020-01-02T10:00:00Z' WHEN 2 THEN ' See all of it. Privacy Policy page 3 of 10 vice' WHEN 3 THEN ' see https://a.com/x.pdf and http://b.org/y.png.' WHEN 4 THEN ' [l](http://c.com/z) & more from us here' ELSE ' credit: A B/C D. doi:10.1/x 5 pounds' END)"
_HTML = "replace(html, '</body>', concat(CASE page_id % 7 WHEN 0 THEN '<script>window.__NUXT__={}</script>' WHEN 1 THEN '<p>Access Denied</p>' WHEN 2 THEN '<div data-v-12ab></div>' WHEN 3 THEN '<script src=\"/wp-content/a.js\"></script>' WHEN 4 THEN '<meta property=\"og:url\" content=\"http://o.com/\">' WHEN 5 THEN '<p>captcha graphql</p>' ELSE '' END, '</body>'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.expr(_TEXT).alias("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", "url", F.expr(_HTML).alias("html"))


def _text(f, name: str = "out"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", f(F.col("text")).alias(name))

    return query


def _url(f, name: str = "out"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return t(spark, sf_dir, "pages").select("page_id", f(F.col("url")).alias(name))

    return query


def _html(f, name: str = "out"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pages(spark, sf_dir).select("page_id", f(F.col("html")).alias(name))

    return query


def t_boilerplate_xdoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.drop_repeated_sentences(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "doc_id")


def t_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    return docs.select("doc_id", word_count(F.col("text")).cast("bigint").alias("words"), X.quality(F.col("text")).alias("score"), X.gate(F.col("text"), scored=True).alias("skipped"))


def t_clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning, entities and escapes included."""
    return _docs(spark, sf_dir).select("doc_id", X.clean(F.col("text"), code="keep").alias("text"))


def t_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 500, 50)).alias("chunk", "text"))


def h_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.extracted(_pages(spark, sf_dir))
    return out.select("page_id", "title", "content", F.to_json("metadata").alias("metadata"), "alternate", "wordpress", "confirmed_app", "app_score", "app_anchor", "embedded", F.to_json("endpoints").alias("endpoints"))


def h_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extracted(_pages(spark, sf_dir)).select("page_id", "alternate", "wordpress")


def h_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.google.com/url?q=https%3A%2F%2Fold.reddit.com%2Fr%2Fx&id="), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return t(spark, sf_dir, "pages").select("page_id", U.classify(url, F.col("page_id") % 3 == 0).alias("source"))


def h_first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 2).alias("dataset_id"))
    again = p.select((F.col("page_id") + 1_000_000).alias("page_id"), F.upper("url").alias("url"), "dataset_id").where("page_id % 3 = 0")
    return U.first_urls(p.unionByName(again), "dataset_id", "page_id").select("page_id", "dataset_id")


def h_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", F.expr("CASE page_id % 5 WHEN 0 THEN concat('https://www.YouTube.com/watch?v=', CAST(page_id AS STRING)) WHEN 1 THEN concat('http://a.com/login/', CAST(page_id AS STRING)) ELSE url END").alias("url"))
    seen = p.where("page_id % 7 = 2").select("url")
    return U.filter_results(p, seen, 100, "page_id")


def h_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("url", (F.col("page_id") % 8).alias("variation"), (F.col("page_id") % 3).alias("engine"), F.col("page_id").alias("position"))
    return U.merge_quotas(p).select("variation", "engine", "position")


def h_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(U.links(F.col("text"))).alias("url")).select("doc_id", "url", U.link_kind(F.col("url")).alias("kind"))


QUERIES = {
    "t_strip_markup": _text(X.strip_markup), "t_strip_nontext": _text(X.strip_nontext), "t_strip_emoji": _text(X.strip_emoji), "t_strip_urls": _text(X.strip_urls), "t_one_line": _text(X.one_line),
    "t_clean": _text(lambda c: X.strip_urls(X.one_line(X.strip_nontext(X.strip_emoji(X.strip_markup(c)))))), "t_clean_full": t_clean_full, "t_noise": _text(X.strip_noise), "t_preclean": _text(X.pre_clean),
    "t_sentences": _text(lambda c: F.array_join(X.sentences(c), "|")), "t_boilerplate_xdoc": t_boilerplate_xdoc, "t_gate": t_gate, "t_phrases": _text(X.strip_phrases), "t_leading_nav": _text(X.strip_leading_nav),
    "t_dedup_sentences": _text(X.dedup_sentences), "t_fragments": _text(X.drop_fragments), "t_compress": _text(X.compress), "t_chunks": t_chunks, "t_slug": _text(slug),
    "t_wait": _text(lambda c: X.retry_wait(F.concat(F.lit("429: try again in "), F.length(c).cast("string"), F.lit(".5s")))), "h_extract": h_extract, "h_meta": h_meta,
    "h_content_type": _html(P.content_type), "h_soft_block": _html(P.soft_block), "h_usable": _html(P.usable), "h_app_mark": _html(P.app_mark), "h_graphql": _html(P.graphql),
    "h_domain": _url(U.domain), "h_norm_url": _url(U.normal), "h_host": _url(U.host), "h_path": _url(U.path), "h_rejected": _url(lambda c: U.rejected(F.concat(c, F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise("")))),
    "h_blocked": _url(lambda c: U.followed(c)), "h_last_part": _url(U.last_part), "h_guesses": _url(lambda c: F.array_join(U.endpoint_guesses(c), "|")), "h_listing": _url(U.listing_url),
    "h_asin": _url(lambda c: U.asin(F.concat(F.lit("http://s.com/dp/B00000"), F.lpad(F.col("page_id").cast("string"), 4, "0"), F.lit("/x")))), "h_classify": h_classify, "h_first_urls": h_first_urls,
    "h_search_filter": h_search_filter, "h_quota": h_quota, "h_links": h_links,
}


# --- SQL -------------------------------------------------------------------------------------------------------

_S = r"[\t\n\f\r ]"


def _docs_sql(expr: str, source: str = _TEXT) -> str:
    return f"SELECT doc_id, {expr} AS out FROM (SELECT doc_id, {source} AS text FROM documents)"


def _fold(c: str, patterns, to: str) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return c


def _re2(p: str) -> str:
    """A pattern for RE2: its own word boundary, and its own white space."""
    return p.replace(r"(?<![0-9A-Za-z_])", r"\b").replace(r"(?![0-9A-Za-z_])", r"\b")


_MARKUP = [_re2(p) for p in X.MARKUP]
_TRIM = r"regexp_replace({c}, '^[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c=c)


_WORDS = r"list_filter(regexp_split_to_array({c}, '[\s\x0B\x{{85}}\x{{A0}}]+'), lambda w: w <> '')"
_NONTEXT = r"[^\p{L}\p{Nd}\p{P}\s\x0B\x{85}\x{A0}\p{Z}]"
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]"
_ONE_LINE = lambda c: _trim(f"regexp_replace({c}, '{_S}+', ' ', 'g')")
_CLEAN = _fold("text", [*_MARKUP, _EMOJI, _NONTEXT], " ")


def _parts(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, '. '), lambda x: {_trim('x')}), lambda x: x <> '')"


_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[\t\n\f\r ]+'), lambda x: " + _trim("x") + "), lambda x: strlen(x) > 10)"
_FIRST = "array_to_string(list_filter({l}, lambda x, i: list_position(list_transform({l}, lambda y: lower(y)), lower(x)) = i), '{sep}')"
_PROSE = "(strlen(w) > 4 AND regexp_matches(w, '^[a-z]'))"
_PHRASES = f"regexp_replace({_fold('text', [_re2(p) for _, p in X.PHRASES], ' ')}, '{_S}{{2,}}', ' ', 'g')"
_PRE = "list_filter(list_transform(string_split(text, chr(10)), lambda x: " + _trim("x") + "), lambda x: strlen(x) >= 20)"
_FRAG = "array_to_string(list_filter(" + _parts("text") + ", lambda x: len(" + _WORDS.format(c="x") + ") >= 8 AND len(list_filter(" + _WORDS.format(c="x") + ", lambda w: " + _PROSE + ")) > 0), '. ')"


def _nav(source: str) -> str:
    return (
        "SELECT doc_id, CASE WHEN spot IS NULL THEN text ELSE array_to_string(w[spot + 1:], ' ') END AS out FROM (SELECT doc_id, text, w, list_filter(range(len(w)), lambda i: len(w[i + 1:i + 15]) >= 6 "
        f"AND len(list_filter(w[i + 1:i + 15], lambda w: {_PROSE})) >= 3)[1] AS spot FROM (SELECT doc_id, text, {_WORDS.format(c='text')} AS w FROM ({source})))"
    )


_NAV = _nav(f"SELECT doc_id, {_TEXT} AS text FROM documents")
_COMPRESS = (
    f"WITH a AS (SELECT doc_id, {_TEXT} AS text FROM documents), b AS (SELECT doc_id, {_trim('text')} AS text FROM a), c AS (SELECT doc_id, {_PHRASES} AS text FROM b), "
    f"d AS (SELECT doc_id, out AS text FROM ({_nav('SELECT doc_id, text FROM c')})), e AS (SELECT doc_id, {_FIRST.format(l=_parts('text'), sep='. ')} AS text FROM d), f AS (SELECT doc_id, {_FRAG} AS text FROM e) "
    f"SELECT doc_id, {_trim('text')} AS out FROM f"
)
_GATE = r"""SELECT doc_id, words, score, CASE WHEN words < 200 THEN 'word count too low' WHEN score < 0.3 THEN 'quality score too low' END AS skipped FROM (
SELECT doc_id, len(w) AS words, CASE WHEN len(w) > 0 THEN round(greatest(0.0, 1 - abs(strlen(array_to_string(w, '')) / len(w) - 6) / 10) * 0.3 + length(regexp_replace(text, '\PL', '', 'g')) / strlen(text) * 0.5
 + least(length(regexp_replace(text, '[^.!?,]', '', 'g')) / len(w), 1.0) * 0.2, 2) ELSE 0.0 END AS score FROM (SELECT doc_id, text, """ + _WORDS.format(c="text") + " AS w FROM documents))"
_XDOC = (
    "WITH s AS (SELECT doc_id, pos, x, " + _trim(f"regexp_replace(lower(x), '{_S}+', ' ', 'g')") + " AS n FROM (SELECT doc_id, unnest(" + _SENT + ") AS x, generate_subscripts(" + _SENT + ", 1) AS pos FROM documents)), "
    "r AS (SELECT *, sum(CASE WHEN strlen(n) > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM s), "
    "k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS kept FROM r WHERE seen < 3 GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN len(" + _SENT + ") > 0 THEN coalesce(kept, '') ELSE text END AS text FROM documents LEFT JOIN k USING (doc_id)"
)


_CHUNKS = (
    "SELECT doc_id, CAST(k AS INT) AS chunk, " + _trim("CASE WHEN s + 500 < n AND regexp_matches(c, '[.!?] ') THEN regexp_extract(c, '(?s)^(.*[.!?]) ', 1) ELSE c END") + " AS text FROM (SELECT doc_id, k, s, n, array_to_string(w[s + 1:s + 500], ' ') AS c FROM "
    "(SELECT doc_id, w, n, unnest(starts) AS s, generate_subscripts(starts, 1) - 1 AS k FROM (SELECT doc_id, w, len(w) AS n, CASE WHEN len(w) > 500 THEN range(0, len(w) - 500 + 450, 450) WHEN len(w) > 0 THEN [0] ELSE [] END AS starts FROM "
    "(SELECT doc_id, " + _WORDS.format(c="text") + " AS w FROM documents))))"
)


def _pages_sql(expr: str, html: bool = False) -> str:
    return f"SELECT page_id, {expr} AS out FROM (SELECT page_id, url, {_HTML if html else 'html'} AS html FROM pages)"


_HOST = r"nullif(regexp_replace(regexp_extract(lower({c}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', ''), '')"
_PATH = r"regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_NORM = r"regexp_replace(trim(lower({c})), '/+$', '')"
_LAST = "coalesce(list_filter(string_split(" + _PATH.format(c="url") + ", '/'), lambda x: x <> '')[-1], '')"
_BASE = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def _any(values) -> str:
    return "(" + " OR ".join(f"contains(lower(html), '{v}')" for v in values) + ")"


_LINK_SQL = "SELECT doc_id, url, CASE " + " ".join(f"""WHEN regexp_matches(url, 'https?://[^\\s)\\]"]+\\.(?:{ext})(?:\\?[^\\s)\\]"]*)?') THEN '{kind}'""" for kind, ext in U.LINK_KINDS) + " ELSE 'link' END AS kind FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s)\\]\"]+')) AS url FROM (SELECT doc_id, " + _TEXT + " AS text FROM documents))"

ORACLE_SQL = {
    "t_strip_markup": _docs_sql(_fold("text", _MARKUP, " ")), "t_strip_nontext": _docs_sql(_fold("text", [_NONTEXT], " ")), "t_strip_emoji": _docs_sql(_fold("text", [_EMOJI], " ")),
    "t_strip_urls": _docs_sql(_fold("text", [X.URL], " ")), "t_one_line": _docs_sql(_ONE_LINE("text")), "t_clean": _docs_sql(_fold(_ONE_LINE(_CLEAN), [X.URL], " ")),
    "t_noise": _docs_sql(_fold("text", [_re2(p) for p in X.NOISE], "")), "t_preclean": _docs_sql(_FIRST.format(l=_PRE, sep="' || chr(10) || '")), "t_sentences": _docs_sql(f"array_to_string({_SENT}, '|')"),
    "t_boilerplate_xdoc": _XDOC, "t_gate": _GATE, "t_phrases": _docs_sql(_PHRASES), "t_leading_nav": _NAV, "t_dedup_sentences": _docs_sql(_FIRST.format(l=_parts("text"), sep=". ")), "t_fragments": _docs_sql(_FRAG), "t_compress": _COMPRESS,
    "t_slug": _docs_sql(r"regexp_replace(regexp_replace(regexp_replace(lower(" + _trim("text") + r"), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '^-|-$', '', 'g')"),
    "t_wait": _docs_sql("length(text) + 1.5", _TEXT).replace("length(text) + 1.5", "CAST(length(text) + 1.5 AS DOUBLE)"),
    "t_chunks": _CHUNKS, "t_clean_full": _docs_sql(_fold(_ONE_LINE(_CLEAN), [X.URL], " ")).replace(" AS out FROM", " AS text FROM"),
    "h_usable": "SELECT page_id, n >= 100 AND len(list_filter(range(len(h) // 2), lambda i: h[2 * i + 1:2 * i + 2] BETWEEN '20' AND '7E' OR h[2 * i + 1:2 * i + 2] IN ('09', '0A', '0D'))) / (len(h) / 2) > 0.85 AS out FROM (SELECT page_id, n, substring(hex(encode(x)), 1, 4000) AS h FROM (SELECT page_id, out AS x, strlen(out) AS n FROM (" + _pages_sql("html", True) + ")))",
    "h_meta": "SELECT page_id, CASE WHEN page_id % 7 = 4 AND contains(html, '</body>') THEN 'http://o.com/' ELSE '' END AS alternate, page_id % 7 = 3 AND contains(html, '</body>') AS wordpress FROM pages",
    "h_content_type": _pages_sql("'html'", True), "h_soft_block": _pages_sql(f"strlen(html) <= 15000 AND {_any(P.BLOCK_PHRASES)}", True), "h_app_mark": _pages_sql("(" + " OR ".join(f"regexp_matches(html, '{p}')" for p in P.APP_MARKS) + ")", True),
    "h_graphql": _pages_sql(_any(P.GRAPHQL), True), "h_domain": _pages_sql(r"string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '/')[1]"), "h_norm_url": _pages_sql(_NORM.format(c="url")),
    "h_host": _pages_sql(_HOST.format(c="url")), "h_path": _pages_sql(_PATH.format(c="url")), "h_rejected": _pages_sql("page_id % 2 = 0 OR " + " OR ".join(f"contains(lower(url), '{x}')" for x in U.REJECTED)),
    "h_blocked": _pages_sql("string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/')[1] NOT IN (" + ", ".join(f"'{x}'" for x in U.UNFOLLOWED) + ")"), "h_last_part": _pages_sql(_LAST),
    "h_guesses": f"SELECT page_id, array_to_string(list_concat(CASE WHEN p <> '' THEN [b || '/' || p || '.json'] ELSE [] END, CASE WHEN l <> '' THEN [b || '/api/posts/' || l, b || '/api/articles/' || l, b || '/api/content/' || l, b || '/api/v1/posts/' || l, b || '/api/v2/posts/' || l, b || '/ghost/api/content/posts/slug/' || l || '/'] ELSE [] END), '|') AS out FROM (SELECT page_id, {_BASE} AS b, trim({_PATH.format(c='url')}, '/') AS p, {_LAST} AS l FROM pages)",
    "h_listing": "SELECT page_id, CASE WHEN q <> '' THEN b || '?' || q ELSE b END AS out FROM (SELECT page_id, CASE WHEN ends_with(b, '.json') THEN b ELSE b || '.json' END AS b, q FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') AS b, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages))",
    "h_asin": _pages_sql("'B00000' || substring(lpad(CAST(page_id AS VARCHAR), 4, '0'), 1, 4)"),
    "h_classify": "SELECT page_id, CASE WHEN page_id % 4 = 0 OR " + _HOST.format(c="url") + " = 'reddit.com' THEN 'reddit' WHEN page_id % 3 = 0 THEN 'import' ELSE 'serp' END AS source FROM pages",
    "h_first_urls": f"SELECT min(page_id) AS page_id, dataset_id FROM (SELECT page_id, url, page_id % 2 AS dataset_id FROM pages UNION ALL SELECT page_id + 1000000, upper(url), page_id % 2 FROM pages WHERE (page_id + 1000000) % 3 = 0) GROUP BY dataset_id, {_NORM.format(c='url')}",
    "h_search_filter": "WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://www.YouTube.com/watch?v=', page_id) WHEN 1 THEN concat('http://a.com/login/', page_id) ELSE url END AS url FROM pages) SELECT page_id, url FROM p WHERE page_id % 5 > 1 AND url NOT IN (SELECT url FROM p WHERE page_id % 7 = 2) ORDER BY page_id LIMIT 100",
    "h_quota": "SELECT variation, engine, position FROM (SELECT *, row_number() OVER (PARTITION BY variation ORDER BY engine, position) AS r FROM (SELECT s.variation AS variation, s.engine AS engine, s.position AS position FROM (SELECT min({'variation': page_id % 8, 'engine': page_id % 3, 'position': page_id}) AS s FROM pages GROUP BY url))) WHERE r <= least(10, 50 // (SELECT count(DISTINCT page_id % 8) FROM pages))",
    "h_links": _LINK_SQL,
}
