"""Text, URL and page functions: vectors derived by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import pages as P
from weftline.functions import text as X
from weftline.functions import urls as U


@pytest.fixture(scope="module")
def one(spark):
    def value(f, s):
        return spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("r")).first()[0]

    return value


BS = chr(92)


def test_cleaning(one):
    assert one(X.decode_escapes, f"a{BS}u00e9b{BS}u0041{BS}u0007c{BS}u2014 {BS}u000ax {BS}u12") == f"aebAc- \nx {BS}u12"
    assert one(X.decode_escapes, f"{BS}u00fcber") == "über"
    assert one(X.clean, "Tom &amp; <b>x</b> # head *emph* café 😀 5 < 6 http://a.b/c $ ok") == "Tom & x head café 5 6   ok"
    assert one(lambda c: X.clean(c, code="mark"), "a ```x``` b") == "a BLOCK b"
    assert one(lambda c: X.clean(c, code="keep"), "a ```x*y*z``` *gone* b <pre>q</pre>") == "a ```x*y*z``` b <pre>q</pre>"
    assert one(lambda c: X.clean(c, links=True), "see http://a.b/c now") == "see http://a.b/c now"
    assert one(X.clean, None) is None and one(X.clean, "") == ""


def test_lines_and_noise(one):
    assert one(X.pre_clean, "short\nthis is a long enough line\nThis is a LONG enough line\n another long enough line ") == "this is a long enough line\nanother long enough line"
    assert one(X.strip_noise, "a 3 days ago b 1,200 views c 10:30 pm d January 5, 2021 e 1/2/2020 f 2020-01-02T10:00:00Z g") == "a  b  c  d  e  f  g"
    assert one(X.sentences, "One two three four. Five! Sixty sixty sixty? end of it all") == ["One two three four", "Sixty sixty sixty", "end of it all"]


def test_scores(one):
    assert one(X.quality, "hello world.") == 0.8 and one(X.quality, "") == 0.0 and one(X.quality, "  ") == 0.0
    assert one(X.gate, "few words") == "word count too low" and one(X.gate, "word " * 200) is None


def test_boilerplate_across_documents(spark):
    s = "The same long sentence stands here"
    rows = [(1, f"{s}. Only one document has this"), (2, f"{s}. b"), (3, f"{s.upper()}. And one more of its own"), (4, "x"), (5, f"{s}. {s}. {s}. Unlike this one here")]
    got = {r["id"]: r["t"] for r in X.drop_repeated_sentences(spark.createDataFrame(rows, "id long, t string"), "id", "t", "id").collect()}
    assert got == {1: f"{s} Only one document has this", 2: s, 3: "And one more of its own", 4: "x", 5: "Unlike this one here"}
    alone = spark.createDataFrame([(1, f"{s}. {s}. {s}")], "id long, t string")
    assert X.drop_repeated_sentences(alone, "id", "t", "id").first()["t"] == ""


def test_compressing(one):
    assert one(X.strip_phrases, "See all of it. page 3 of 10 vice évice .5 x") == " of it. page é x"
    prose = "about contact quick brown jumped over"
    assert one(X.strip_leading_nav, "Home About Us " + prose) == "Home About Us " + prose
    nav = " ".join(f"N{i}" for i in range(30))
    assert one(X.strip_leading_nav, f"{nav} {prose}").split()[:2] == ["N18", "N19"] and one(X.strip_leading_nav, nav) == nav
    assert one(lambda c: X.strip_leading_nav(c, links=True), f"{nav} http://a.b/c {nav}").startswith("http://a.b/c N0")
    assert one(X.dedup_sentences, "Aa. bb. aA. cc") == "Aa. bb. cc"
    assert one(X.drop_fragments, "one two three. this is a whole sentence with enough words here. x") == "this is a whole sentence with enough words here"
    assert one(X.compress, "") == ""


def test_chunks():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    assert [len(c.split()) for c in X.chunk_list(words(12), 5, 2)] == [5, 5, 5, 3] and [c.split()[0] for c in X.chunk_list(words(12), 5, 2)] == ["w0", "w3", "w6", "w9"]
    assert X.chunk_list("", 5, 2) == [] and X.chunk_list(words(5), 5, 2) == [words(5)]
    assert X.chunk_list("a b. c d e f", 4, 1) == ["a b.", "d e f"] and X.chunk_list("http://x.y z. http://a. b c d", 4, 1)[0] == "http://x.y z."


def test_replies_and_waits(one):
    assert X.salvage_json_array('```json\n[{"a":1},{"b":2}, {"c"') == '[{"a":1},{"b":2}]' and X.salvage_json_array("[]") == "[]" and X.salvage_json_array("zz") is None
    assert [one(X.retry_wait, s) for s in ("429: try again in 7.5s", "429", "boom", "please wait x")] == [8.5, 5.0, 0.0, 0.0]


def test_json_pages():
    assert X.json_strings('{"b":"a longer piece of text","@type":"NewsArticle","u":"https://a.b/long/address","a":["short","another piece of text"]}') == "another piece of text a longer piece of text"
    assert X.json_title('{"@graph":[{"x":1},{"name":"N"}],"headline":"H"}') == "N" and X.json_title('{"headline":"H","name":"N"}') == "H" and X.json_title("[1]") == ""
    assert X.fix_unicode(f"caf{BS}u00e9") == "café" and X.fix_unicode("plain") == "plain"


def test_names(one):
    assert one(lambda c: X.file_slug(c, F.lit(7)), " My Data_Set! ") == "my-data_set" and one(lambda c: X.file_slug(c, F.lit(7)), "!!") == "dataset-7"
    assert one(X.username, "A.b+c@x.y") == "a_b_c" and one(X.bio, "<b>x\x01\ty</b> ") == "x\ty"


def test_urls(one):
    assert one(U.normal, " HTTP://A.com// ") == "http://a.com" and one(U.domain, "https://www.a.com:80/p") == "a.com:80"
    assert one(U.asin, "https://www.amazon.com/dp/B000000001/x") == "B000000001" and one(U.asin, "/dp/short") == ""
    assert [one(U.link_kind, u) for u in ("https://example.com/x", "https://example.org/y.png", "https://example.org/")] == ["file", "image", "link"]
    assert one(lambda c: U.link_kind(c, anchored=True), "https://example.com/x") == "link"
    assert [one(U.is_bot, a) for a in ("AutoModerator", "Talbot", "alice")] == [True, True, False]
    assert one(U.blocked_result, "https://www.youtube.com/x") and one(U.blocked_result, "http://a.b/Login/x") and not one(U.blocked_result, "http://a.b/loginx")
    assert one(U.listing_url, "https://r.com/r/x/comments/1/t/") == "https://r.com/r/x/comments/1/t.json?depth=10" and one(U.rejected, "http://a/b.PNG?x")
    assert one(lambda c: U.robots_endpoint(F.lit("http://a"), c), "User-agent: *\nDisallow: /x\nAllow: /api/v3 ") == "http://a/api/v3"
    assert U.join_url("http://s.com/x/y", "../z?q") == "http://s.com/z?q" and U.join_url("http://s.com", "#") == "" and U.join_url("http://s.com", "javascript:x") == ""


PAGE = """<html><head><title> T </title><meta name=a content=b><meta property="og:url" content="http://x/"></head><body><nav><p>this is navigation text long</p></nav>
<p>First paragraph that is long<p>Second paragraph <b>that is <a href="/d.pdf">doc</a></b> long<ul><li>item one is very very long<li>Item one is very very long</ul><!-- <p>comment is not text at all</p> -->
<div role="banner"><h2>not a heading to be read here</h2></div><table><tr><td>cell number one is long enough<td>tiny</table><a href="mailto:a@b.c">m</a><a href="tel:+1">t</a><script>window.__INITIAL_STATE__ = {"a":"}","b":[1,{"c":2}]};</script></body></html>"""


def test_pages():
    r = P.parse(PAGE)
    assert P.page_lines(r, "http://s.com/x/y", False) == ["First paragraph that is long", "Second paragraph that is doc long", "http://s.com/d.pdf", "item one is very very long", "cell number one is long enough", "Email: a@b.c", "Phone: +1"]
    assert P.title(r) == "T" and P.metadata(r) == {"a": "b", "og:url": "http://x/"} and P.alternate_url(r) == "http://x/"
    assert P.state(PAGE, "window.__INITIAL_STATE__") == '{"a":"}","b":[1,{"c":2}]}' and P.confirmed_app(PAGE, r)
    shell = '<html><body><div id="root"></div><noscript>Please enable JavaScript</noscript><script src="/bundle.ab12.js"></script></body></html>'
    assert P.app_score(shell, P.parse(shell)) == (7, True) and not P.confirmed_app(shell, P.parse(shell))
    body = '{"headline":"' + "x" * 200 + '"}'
    assert P.embedded("", P.parse(f'<script type="application/ld+json">{body}</script>')) == body
    assert P.next_chunks('self.__next_f.push([1,"a:{\\"k\\""]) self.__next_f.push([1,":1}"])') == '{"k":1}'
    assert P.endpoints("fetch('/api/a') \"/v1/b\" 'http://o.com/c.json'", "http://s.com/p") == ["http://s.com/api/a", "http://s.com/v1/b"]
    assert P.xml_lines("<?xml version='1.0'?><a><n:b xmlns:n='u'>x</n:b><c>XXXXXXXX</c><d>1&amp;2</d></a>") == "b: x\nd: 1&2" and P.xml_lines("<a>x<b>") == "a: x"
    assert P.json_lines('{"a":[1,{"b":"x"}],"c":null,"d":" "}') == "a_1: 1\na_2_b: x"


def test_page_kinds(spark, one):
    assert [one(P.content_type, s) for s in (" <?xml v?>", " [1]", "plain", "<p>")] == ["xml", "json", "text", "html"]
    assert one(P.soft_block, "Just a Moment") and not one(P.soft_block, "x" * 16000 + "captcha") and one(P.usable, "a" * 100) and not one(P.usable, "é" * 100)
    rows = spark.createDataFrame([(1, "http://s.com/", PAGE), (2, None, None), (3, "u", '{"a":1}'), (4, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in P.extracted(rows).collect()}
    assert got[1]["title"] == "T" and got[1]["confirmed_app"] and got[2]["content"] == "" and got[3]["content"] == "a: 1" and got[4]["content"] == ""
