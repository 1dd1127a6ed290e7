"""Cleaning, scoring and compressing page text; column expressions throughout, but for chunking and JSON repair.

Texts are cleaned to one line. Lengths of words and sentences count bytes, as the thresholds were set in bytes.
"""

from __future__ import annotations

import html
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import EDGE_AFTER, EDGE_BEFORE, RE2_SPACE, fields, let, trim_u, word_count

#: Escapes that are written in plain ASCII.
PLAIN_ESCAPES = (
    (r"\u0026", "&"), (r"\u003c", "<"), (r"\u003e", ">"), (r"\u0027", "'"), (r"\u00a0", " "), (r"\u2019", "'"), (r"\u2018", "'"), (r"\u201c", '"'), (r"\u201d", '"'), (r"\u2013", "-"), (r"\u2014", "-"), (r"\u00e9", "e"), (r"\u00e0", "a"), (r"\u00e8", "e"), (r"\u00ea", "e"), (r"\u00f3", "o"), (r"\u00fa", "u"),
)
#: Markup.
MARKUP = (r"(?i)<[^>]+>", r"(?i)&[a-zA-Z]+;", r"(?i)\[[^\n]*?\]\([^\n]*?\)", r"(?i)#{1,6}" + RE2_SPACE, r"(?i)\*{1,2}[^*]+\*{1,2}", r"(?i)_{1,2}[^_]+_{1,2}")
#: Blocks of code.
CODE_BLOCKS = (r"(?s)```.*?```", r"(?si)<pre[^>]*>.*?</pre>", r"(?si)<code[^>]*>.*?</code>")
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]"
NOT_TEXT = r"[^\p{L}\p{Nd}\p{P}\s\x{85}\x{A0}\p{Z}]"
URL = r"(?i)https?://[^\t\n\f\r ]+"
#: What changes without the page changing.
NOISE = (
    rf"(?i)\d+{RE2_SPACE}*(days?|hours?|minutes?|seconds?){RE2_SPACE}*ago",
    rf"(?i)(last{RE2_SPACE}+updated|posted|updated){RE2_SPACE}*[:\-]?{RE2_SPACE}*[\w,\t\n\f\r ]+\d{{4}}",
    rf"(?i)[\d,]+{RE2_SPACE}*(views?|likes?|applicants?|followers?|shares?)",
    rf"(?i){EDGE_BEFORE}\d{{1,2}}:\d{{2}}{RE2_SPACE}*(am|pm){EDGE_AFTER}",
    rf"(?i){EDGE_BEFORE}(january|february|march|april|may|june|july|august|september|october|november|december){RE2_SPACE}+\d{{1,2}},?{RE2_SPACE}*\d{{4}}{EDGE_AFTER}",
    rf"(?i){EDGE_BEFORE}\d{{1,2}}/\d{{1,2}}/\d{{2,4}}{EDGE_AFTER}",
    rf"(?i){EDGE_BEFORE}\d{{4}}-\d{{2}}-\d{{2}}(T\d{{2}}:\d{{2}}:\d{{2}}Z?)?{EDGE_AFTER}",
)
#: Phrases of sites, in order; before each a part that no match lacks, so that most texts are spared the pattern.
PHRASES = (
    ("credit:", rf"(?i)credit:{RE2_SPACE}*[\w\t\n\f\r ]+/[\w\t\n\f\r ]+"),
    ("flickr", rf"(?i)\w+{RE2_SPACE}*/{RE2_SPACE}*flickr{RE2_SPACE}*/{RE2_SPACE}*cc{RE2_SPACE}*b[y]{RE2_SPACE}*[\d.]*"),
    ("of", rf"(?i)\d{{1,2}}{RE2_SPACE}+of{RE2_SPACE}+\d{{1,2}}"),
    ("continue", r"(?i)continue to( \d+)? of \d+ below"),
    ("continue", r"(?i)continue to below"),
    ("see", r"(?i)see all"),
    ("inches", r"(?i)\d+inches"),
    ("pounds", r"(?i)\d+pounds"),
    ("inchesweight", rf"(?i)\d+{RE2_SPACE}*inchesweight:"),
    ("poundscoat", rf"(?i)\d+{RE2_SPACE}*poundscoat"),
    ("expectancy", rf"(?i)[a-z]+life{RE2_SPACE}*expectancy"),
    ("colorslife", r"(?i)[a-z]+colorslife"),
    ("yearslife", r"(?i)[a-z]+yearslife"),
    ("minkcolors", r"(?i)minkcolors"),
    ("smokelife", r"(?i)smokelife"),
    ("", rf"(?i)\w+,{RE2_SPACE}*[a-zA-Z]+,?{RE2_SPACE}+et al[^.]*"),
    ("journal", r"(?i)journal of [^.]{0,60}"),
    ("doi:", r"(?i)doi:[^\t\n\f\r ]+"),
    ("squamous", r"(?i)squamous cell cancer[^.]*"),
    ("cornell", r"(?i)cornell university[^.]*"),
    ("veterinary", r"(?i)veterinary centers of america"),
    ("veterinary", r"(?i)college of veterinary medicine"),
    ("veterinary", r"(?i)veterinary review board"),
    ("", rf"\.\d+{EDGE_AFTER}"),
    ("vice", rf"(?i){EDGE_BEFORE}vice{EDGE_AFTER}"),
    ("", rf"({RE2_SPACE}+\.{RE2_SPACE}*){{2,}}"),
    ("", rf"^{RE2_SPACE}*\.{RE2_SPACE}*"),
    ("", rf"{RE2_SPACE}+\.{RE2_SPACE}+"),
    ("more", r"(?i)more from [^\n]{0,40}"),
    ("buy", r"(?i)what to buy"),
    ("terms", r"(?i)terms of service"),
    ("privacy", r"(?i)privacy policy"),
    ("editorial", r"(?i)editorial guidelines"),
    ("editorial", r"(?i)editorial policy"),
    ("product", r"(?i)product testing"),
    ("sweepstakes", r"(?i)sweepstakes"),
)
#: Names of linked-data types, which are no text.
TYPE_NAMES = frozenset(
    "NewsArticle Article WebPage WebSite Organization ImageObject Person PostalAddress ItemList ListItem BreadcrumbList SearchAction Product Event "
    "Review Rating AggregateRating VideoObject AudioObject MusicRecording Movie TVSeries Book Recipe HowTo FAQPage Question Answer "
    "SiteNavigationElement WPHeader WPFooter WPSideBar CreativeWork Thing".split()
)
REPEATS, LEAST_WORDS, LEAST_SCORE = 3, 200, 0.3
CHUNK_WORDS, OVERLAP_WORDS = 5000, 50


def _each(c: Column, patterns, to: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, to), patterns, c)


# --- cleaning --------------------------------------------------------------------------------------------------


def decode_escapes(c: Column) -> Column:
    r"""Written \uXXXX escapes as their characters, some in ASCII; control characters but line feed and tab go."""
    c = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), PLAIN_ESCAPES, c)
    parts = F.split(c, r"(?=\\u[0-9a-fA-F]{4})")

    def one(x: Column) -> Column:
        code = F.conv(F.substring(x, 3, 4), 16, 10).cast("int")
        # A code unit is two bytes of UTF-16; half of a pair is no character and shows as a replacement.
        char = F.when((code >= 0xD800) & (code < 0xE000), F.lit("�")).otherwise(F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE"))
        gone = (code < 32) & ~code.isin(9, 10)
        return F.when(x.rlike(r"^\\u[0-9a-fA-F]{4}"), F.concat(F.when(gone, "").otherwise(char), F.substr(x, F.lit(7)))).otherwise(x)

    return F.when(c.contains(r"\u"), F.array_join(F.transform(parts, one), "")).otherwise(c)


@F.pandas_udf(T.StringType())
def _unescaped(c: pd.Series) -> pd.Series:
    return c.map(html.unescape, na_action="ignore")


def unescape_html(c: Column) -> Column:
    """Entities as their characters, by Python's table. Texts without & are not sent there: the function is run for every row, but on nulls."""
    return F.coalesce(_unescaped(F.when(c.contains("&"), c)), c)


def strip_markup(c: Column) -> Column:
    return _each(c, MARKUP, " ")


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, " ")


def strip_nontext(c: Column) -> Column:
    """Letters, digits, white space and punctuation stay; anything else is a space."""
    return F.regexp_replace(c, NOT_TEXT, " ")


def one_line(c: Column) -> Column:
    return trim_u(F.regexp_replace(c, RE2_SPACE + "+", " "))


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def _plain(c: Column) -> Column:
    return strip_nontext(strip_emoji(strip_markup(c)))


def clean(c: Column, links: bool = False, code: str = "none") -> Column:
    """Page text as one line of prose.

    code: `none` treats blocks of code as any text; `mark` puts a mark in their place (of which the markup rules
    leave the word BLOCK, as the service that this engine stands in for does); `keep` leaves them as they are.
    """
    c = unescape_html(decode_escapes(c))
    if code == "mark":
        c = _plain(reduce(lambda x, p: F.regexp_replace(x, p, "__CODE_BLOCK_0__"), CODE_BLOCKS, c))
    elif code == "keep":
        any_block = "|".join(CODE_BLOCKS)
        between, blocks = F.split(c, any_block), F.regexp_extract_all(c, F.lit(f"({any_block})"), 1)
        c = F.array_join(F.zip_with(between, blocks, lambda a, b: F.concat(_plain(a), F.coalesce(b, F.lit("")))), "")
    else:
        c = _plain(c)
    c = one_line(c)
    return c if links else strip_urls(c)


def strip_noise(c: Column) -> Column:
    """Without relative times, counters, clocks and dates, before texts are compared."""
    return _each(c, NOISE, "")


def pre_clean(c: Column) -> Column:
    """Lines of at least 20 bytes, the first of those that differ in case alone."""
    lines = F.filter(F.transform(F.split(c, "\n"), trim_u), lambda x: F.octet_length(x) >= 20)
    return F.array_join(_first_by(lines, F.lower), "\n")


def _first_by(items: Column, key) -> Column:
    """The first of the items of each key, in order: sorted by key, the head of each run, sorted by place again."""
    rows = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    heads = let(rows, lambda r: F.filter(r, lambda s, j: (j == 0) | (s["k"] != F.get(r, j - 1)["k"])))
    return F.transform(F.array_sort(F.transform(heads, lambda s: F.struct(s["i"], s["x"]))), lambda s: s["x"])


# --- sentences across documents --------------------------------------------------------------------------------


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]+" + RE2_SPACE + "+"), trim_u), lambda x: F.octet_length(x) > 10)


def normal_sentence(c: Column) -> Column:
    return trim_u(F.regexp_replace(F.lower(c), RE2_SPACE + "+", " "))


def drop_repeated_sentences(docs: DataFrame, key: str, text: str, order: str, within: list[str] | None = None, most: int = REPEATS) -> DataFrame:
    """docs with text without sentences that by then have been seen `most` times, in the documents' order.

    A sentence counts with all that stand in its own document. Those of up to 20 bytes never go. A text without
    sentences stays as it is; others keep their sentences, joined by spaces. within: columns whose groups count apart.

    A sentence has been seen `most` times by its `most`-th document at the latest, so its first `most` places are enough to tell from
    which one on it goes. Those are picked on either side of the shuffle (a limit by group), so a sentence that all documents share
    costs a few rows a task. What a document then loses comes back to it as one set; its text is not moved apart and put together again.
    """
    within = within or []
    rows = docs.select(*within, key, order, F.posexplode(sentences(F.col(text))).alias("_pos", "_s")).withColumn("_n", normal_sentence(F.col("_s")))
    counted = rows.where(F.octet_length("_n") > 20).groupBy(*within, "_n", key, order).agg(F.count("*").alias("_c"))
    by_place = Window.partitionBy(*within, "_n").orderBy(order)
    first = counted.withColumn("_r", F.row_number().over(by_place)).where(F.col("_r") <= most)
    upto = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = first.withColumn("_seen", F.sum("_c").over(upto)).where(F.col("_seen") >= most).groupBy(*within, "_n").agg(F.min(order).alias("_since"))
    gone = counted.join(since, [*within, "_n"]).where(F.col(order) >= F.col("_since")).groupBy(*within, key).agg(F.collect_set("_n").alias("_gone"))

    def left(own: Column) -> Column:
        stays = F.filter(own, lambda x: ~F.array_contains("_gone", normal_sentence(x)))
        return F.when(F.size(own) == 0, F.col(text)).otherwise(F.array_join(F.when(F.col("_gone").isNull(), own).otherwise(stays), " "))

    return docs.join(gone, [*within, key], "left").withColumn(text, let(sentences(F.col(text)), left)).select(*docs.columns)


# --- scores ----------------------------------------------------------------------------------------------------


def quality(c: Column) -> Column:
    """0 to 1: word length, share of letters, and punctuation by words; two decimals."""

    def score(words: Column) -> Column:
        n = F.size(words)
        word_length = F.greatest(F.lit(0.0), 1 - F.abs(F.octet_length(F.array_join(words, "")) / n - 6) / 10)
        letters = (F.length(c) - F.length(F.regexp_replace(c, r"\p{L}+", ""))) / F.octet_length(c)
        marks = F.least((F.length(c) - F.length(F.translate(c, ".!?,", ""))) / n, F.lit(1.0))
        return F.when(n > 0, F.round(word_length * 0.3 + letters * 0.5 + marks * 0.2, 2)).otherwise(0.0)

    return let(fields(c), score)


def gate(c: Column, scored: bool = False) -> Column:
    """Why a cleaned text is skipped; null if it passes."""
    few = word_count(c) < LEAST_WORDS
    out = F.when(few, "word count too low")
    return out.when(quality(c) < LEAST_SCORE, "quality score too low") if scored else out


# --- compressing -----------------------------------------------------------------------------------------------


def strip_phrases(c: Column) -> Column:
    """Without the sites' phrases, one after the other.

    The parts that spare a text a pattern are looked for in the text as it came: they hold no space, and as phrases give way to a
    space, no such part comes up that wasn't there.
    """

    def every(text: Column, low: Column) -> Column:
        def step(part: str, pattern: str):
            swap = lambda x: F.regexp_replace(x, pattern, " ")
            return (lambda x: F.when(low.contains(part), swap(x)).otherwise(x)) if part else swap

        return reduce(let, (step(*p) for p in PHRASES), text)

    return F.regexp_replace(let(c, lambda text: let(F.lower(text), lambda low: every(text, low))), RE2_SPACE + "{2,}", " ")


def _prose_word(w: Column) -> Column:
    """More than four bytes, of which the first is a letter from a to z."""
    return (F.octet_length(w) > 4) & (w >= "a") & (w < "{")


def strip_leading_nav(c: Column, links: bool = False) -> Column:
    """From the first word on whose next 15 have at least 3 prose words (and are at least 6); all of it if there is none."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        places = F.filter(F.transform(words, lambda w, i: F.when(_prose_word(w), i)), lambda i: i.isNotNull())
        # Three prose words within 15 places: the window may begin up to 14 places before the third, and 6 words must follow.
        near = let(places, lambda p: F.get(F.filter(F.transform(p, lambda x, k: F.when(F.get(p, k + 2) - x <= 14, F.greatest(F.get(p, k + 2) - 14, F.lit(0)))), lambda i: i.isNotNull()), 0))
        first = F.when(near <= n - 6, near)
        if links:
            url = F.get(F.filter(F.transform(words, lambda w, i: F.when(w.rlike(r"(?i)^https?://[^\t\n\f\r ]+$"), i)), lambda i: i.isNotNull()), 0)
            first = F.least(first, url)
        return let(first, lambda i: F.array_join(F.slice(words, i + 1, F.greatest(n - i, F.lit(0))), " "))

    return let(c, lambda x: F.when(trim_u(x) == "", x).otherwise(F.coalesce(let(fields(x), cut), x)))


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\. "), trim_u), lambda x: x != "")


def dedup_sentences(c: Column) -> Column:
    return F.array_join(_first_by(_parts(c), F.lower), ". ")


def drop_fragments(c: Column, links: bool = False) -> Column:
    """Parts of at least 8 words of which one is a prose word; with links, bare URLs as well."""

    def stays(x: Column) -> Column:
        whole = (F.size(fields(x)) >= 8) & F.exists(fields(x), _prose_word)
        return whole | x.rlike(r"(?i)^https?://[^\t\n\f\r ]+$") if links else whole

    return F.array_join(F.filter(_parts(c), stays), ". ")


def compress(c: Column, links: bool = False) -> Column:
    """The four steps, each over the text that the one before it made."""
    steps = (strip_phrases, lambda x: strip_leading_nav(x, links), dedup_sentences, lambda x: drop_fragments(x, links))
    return trim_u(reduce(let, steps, trim_u(c)))


def format_payload(url: Column, content: Column, fields_in_schema: int) -> Column:
    """struct(source_url, content), null where blank. Field types other than text and number count as text, so any field asks for the content."""
    return F.struct(F.when(url != "", url).alias("source_url"), F.when(F.lit(fields_in_schema > 0) & (trim_u(content) != ""), content).alias("content"))


# --- chunks ----------------------------------------------------------------------------------------------------


def chunk_starts(words: int, most: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> range:
    """Where windows begin: they go on until one reaches the end."""
    step = most - overlap if most > overlap else most
    return range(0, max(words - most, 0) + step if words > most else min(words, 1), step)


_STOP = re.compile(r"[.!?] ")


def chunk_list(text: str | None, most: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> list[str]:
    """Windows of `most` words that overlap; all but the last end at their last sentence end outside a URL, if they have one."""
    words = (text or "").split()
    out = []
    for start in chunk_starts(len(words), most, overlap):
        chunk = " ".join(words[start : start + most])
        if start + most < len(words):
            for m in reversed(list(_STOP.finditer(chunk))):
                token = chunk[: m.start() + 1].rsplit(" ", 1)[-1]
                if not token.startswith(("http://", "https://")):
                    chunk = chunk[: m.start() + 1]
                    break
        out.append(chunk.strip())
    return out


def chunks(c: Column, most: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: chunk_list(x, most, overlap))

    return cut(c)


def salvage_json_array(raw: str | None) -> str | None:
    """A model's reply as a JSON array: fences go, a cut-off array ends at its last whole object. None: nothing whole."""
    text = re.sub(r"```$", "", re.sub(r"^```(json)?", "", (raw or "").strip())).strip()
    if text.endswith("]"):
        return text
    at = text.rfind("},")
    at = text.rfind("}") if at < 0 else at
    return None if at < 0 else text[: at + 1] + "]"


def retry_wait(c: Column) -> Column:
    """Seconds that an error message asks to wait, and one more; 5 for other rate limits, else 0."""
    found = [F.regexp_extract(c, rf"{p}([0-9.]+)", 1).try_cast("double") + 1 for p in ("try again in ", "retry after ", "please wait ")]
    return F.coalesce(*found, F.when(c.contains("429") | c.contains("rate limit") | c.contains("rate_limit"), 5.0), F.lit(0.0))


# --- JSON pages ------------------------------------------------------------------------------------------------


def json_strings(text: str | None) -> str | None:
    """The prose in a JSON page: its strings of more than 10 bytes that are neither URLs nor names of types, keys in order."""
    if text is None:
        return None
    fixed = fix_unicode(text)
    try:
        value = json.loads(fixed)
    except ValueError:
        return fixed
    out: list[str] = []

    def walk(v) -> None:
        if isinstance(v, dict):
            for k in sorted(v):
                walk(v[k])
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, str):
            s = v.strip()
            if len(s.encode()) > 10 and s not in TYPE_NAMES and not s.startswith(("http://", "https://")):
                out.append(s)

    walk(value)
    return " ".join(out)


def fix_unicode(text: str) -> str:
    r"""Text with \u escapes decoded as those of a JSON string, where it is one."""
    if "\\u" not in text:
        return text
    try:
        return json.loads('"' + text.replace('"', '\\"') + '"')
    except ValueError:
        return text


def json_title(text: str | None) -> str:
    """headline or name, first of the graph's members, then of the page itself."""
    try:
        page = json.loads(text or "")
    except ValueError:
        return ""
    if not isinstance(page, dict):
        return ""
    graph = page.get("@graph")
    for item in [*(graph if isinstance(graph, list) else []), page]:
        for k in ("headline", "name"):
            if isinstance(item, dict) and isinstance(item.get(k), str) and item[k]:
                return item[k]
    return ""


def description(meta: Column) -> Column:
    return F.coalesce(F.when(meta["og:description"] != "", meta["og:description"]), meta["description"], F.lit(""))


# --- names -----------------------------------------------------------------------------------------------------


def file_slug(name: Column, dataset_id: Column) -> Column:
    """A file's name: lower case, dashes for spaces, letters, digits, - and _."""
    s = F.regexp_replace(F.replace(F.lower(trim_u(name)), F.lit(" "), F.lit("-")), "[^a-z0-9_-]", "")
    return F.when(s != "", s).otherwise(F.concat(F.lit("dataset-"), dataset_id.cast("string")))


def bio(c: Column, most: int = 500) -> Column:
    """Without tags and control characters, at most 500 characters."""
    return F.substring(trim_u(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")), 1, most)


def username(email: Column) -> Column:
    """From an address: what stands before the @, in small letters, digits and _, at most 50."""
    return F.substring(F.regexp_replace(F.lower(F.substring_index(email, "@", 1)), "[^a-z0-9_]", "_"), 1, 50)
