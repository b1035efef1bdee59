import html
import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, payloads, rules, social, text


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over one string column."""

    def run(make, *values):
        schema = ", ".join(f"c{i} string" for i in range(len(values)))
        return spark.createDataFrame([values], schema).select(make(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]

    return run


@pytest.mark.parametrize("url, want", [("https://Example.com/Path/", "https://example.com/path"), ("HTTPS://X.com/P#frag", "https://x.com/p"), (" a//\t", "a/"), ("x?q=1/", "x?q=1")])
def test_canonical_url(one, url, want):
    assert one(text.canonical_url, url) == want


@pytest.mark.parametrize("title, want", [("Breaking: Foo Bar", "foo bar"), ("Update:\n\nFoo\tBar", "foo bar"), ("News: Breaking: x", "breaking: x"), ("breaking: news: x", "x"), ("  X ", "x")])
def test_normalized_title(one, title, want):
    assert one(text.normalized_title, title) == want


def test_hashes_differ_by_prefix_only_on_lookup(one):
    assert one(text.lookup_title_hash, "Breaking: X") == one(text.stored_title_hash, " x ")
    assert one(text.stored_title_hash, "Breaking: X") != one(text.stored_title_hash, "x")


def test_strip_html(one):
    raw = "<p>a&nbsp;&amp; <b>b</b></p>\n &rsquo;c&mdash;d&eacute; "
    assert one(text.strip_html, raw) == "a & b 'c-d&eacute;"
    assert one(lambda c: text.strip_html(c, True), raw) == "a & b 'c-dé"
    assert one(text.clean_html, "<i>x</i>  y&eacute;") == html.unescape("x   y&eacute;")
    assert one(text.visible_text, "<script a>x\ny</script>1<style>z</style> <b>2</b>\n3") == " 1 2 3"


def test_clean_scraped(one):
    assert one(text.clean_scraped, "[#tag](u) see [Firm](http://x) #more http://y.z  now") == "see Firm now"


def test_images(one):
    a = """<meta property="og:image" content="https://a/x.png">"""
    b = """<META content='https://b/y.png' property='og:image'>"""
    assert one(text.og_image, a) == "https://a/x.png" and one(text.og_image, b) == "https://b/y.png"
    assert one(text.og_image, '<meta property="og:title" content="t">') == ""
    page = '<meta property="og:image" content="https://x/logo.png"><img class="c" src="https://x/p.jpg">'
    assert one(lambda c: text.page_image(c, F.lit(200)), page) == "https://x/p.jpg"
    assert one(lambda c: text.page_image(c, F.lit(404)), page) == "" and one(lambda c: text.page_image(c, F.lit(200)), "<p>") == ""


def test_slugs(one):
    assert one(text.source_slug, "A & B (C): D/E · F.") == "a-and-b-c-d-e-f"
    assert one(lambda s, h: text.article_slug(s, h), "My Source/x", "0123456789") == "my-source-x_01234567"


def test_post_title(one):
    assert one(text.post_title, "\n  first line \nsecond") == "first line"
    long = "word " * 80
    got = one(text.post_title, long)
    assert got.endswith("word…") and len(got) <= 281


def test_color_slot(one):
    def plain(name):
        h = 5381
        for ch in name.strip().lower():
            h = ((h * 33) & 0xFFFFFFFF) ^ ord(ch)
            h = h - 2**32 if h >= 2**31 else h
        return abs(h) % 8

    for name in ("Alpha", " beta GROUP ", "x"):
        assert one(text.color_slot, name) == plain(name)
    assert one(text.color_slot, "Valeo") == 5


def test_jaccard_and_tokens(one):
    assert one(lambda a, b: text.jaccard(text.tokens(a), text.tokens(b)), "a !", "") == 1.0
    assert one(lambda a, b: text.jaccard(text.tokens(a), text.tokens(b)), "foo bar", "Foo baz bar") == pytest.approx(2 / 3)
    assert sorted(one(text.tokens, "Éclair x_1 A étés étés")) == ["x_1", "éclair", "étés"]


@pytest.mark.parametrize("age, want", [("5m", 5 / 1440), ("21min", 21 / 1440), ("2h", 2 / 24), ("3d", 3), ("1w", 7), ("2mo", 60), ("1y", 365), ("3xyz", None), ("edited", None)])
def test_relative_age(one, age, want):
    assert one(dates.relative_age_days, age) == (None if want is None else pytest.approx(want))


def test_cutoff(one):
    cut = F.to_timestamp(F.lit("2024-01-10T00:00:00Z"))
    keep = lambda v, strict=False: one(lambda c: dates.after_cutoff(c, cut, strict), v)
    assert [keep(v) for v in ("2024-01-09T23:00:00+00:00", "2024-01-09T23:00:00", "2024-01-01", "", "junk", "2024-01-10T00:00:00Z")] == [False, True, True, True, True, True]
    assert [keep(v, True) for v in ("2024-01-09T23:00:00", "", "2024-01-11")] == [False, False, True]
    assert dates.cutoff_days("backfill", 90, 24, 30) == 90 and dates.cutoff_days("", 90, 24, 30) == 1 and dates.cutoff_days("", 90, None, 30) == 30


def test_relative_display(one):
    now = F.expr("timestamp'2024-02-01 12:00:00'")
    show = lambda v: one(lambda c: dates.relative_display(c, now), v)
    assert [show(v) for v in ("2024-02-01T11:40:00", "2024-02-01T09:00:00", "2024-01-30T12:00:00", "2023-12-05", "soon")] == ["just now", "3h ago", "2d ago", "5 Dec 2023", "soon"]
    assert one(lambda c: dates.same_day(c, now), "2024-02-01T00:10:00") and not one(lambda c: dates.same_day(c, now), "x")


@pytest.mark.parametrize("said, want", [("Empresa lança nova pastilha de freio", ("Lancamento", "Alto", True)), ("Empresa lança app", ("Institucional", "Medio", False)), ("workshop e aquisição", ("Evento", "Baixo", False)), ("investe R$ 5 mi", ("Investimento", "Alto", False)), ("expansão", ("Investimento", "Medio", False)), ("lança time de futebol", ("Atualizacao", "Baixo", False)), ("nada", ("Atualizacao", "Baixo", False))])
def test_rules(one, said, want):
    assert tuple(one(lambda t: rules.classify_article(t, F.lit("")), said)) == want


@pytest.mark.parametrize("raw, want", [('{"a": 1}', True), ('x {"a": {"b": 2}} y', True), ("```json\n{\"a\": 1}\n```", True), ("[1]", False), ('"s"', False), ("", False), ("{bad", False)])
def test_json_object(one, raw, want):
    assert (one(lambda c: payloads.json_object(c).isNotNull(), raw)) is want


def test_normalized_summary(one):
    def got(x):
        return one(payloads.normalized_summary, json.dumps(x)).asDict()

    full = got({"summary": "s" * 1000, "competitor_analysis": "c" * 600, "title": "t" * 200, "event_type": "M&A", "alert_level": "Alto", "relevant": False})
    assert (len(full["summary"]), len(full["competitor_analysis"]), len(full["title"]), full["event_type"], full["alert_level"], full["relevant"]) == (900, 500, 120, "M&A", "Alto", False)
    assert [got({"summary": "x", "relevant": r})["relevant"] for r in (True, "FALSE", " n ", 0, 2, "maybe", None, [], "yes")] == [True, False, False, False, True, True, True, True, True]
    assert got({"summary": 5})["error"] == "missing summary" and got({"title": "x"})["summary"] is None


@pytest.mark.parametrize("raw, want", [("Same", "same"), ("not the SAME, different", "same"), ("It is related.", "related"), ("hm", "different"), (None, "different")])
def test_verdict(one, raw, want):
    assert one(payloads.verdict, raw) == want


def test_cursor_round_trip():
    assert payloads.decode_cursor(payloads.encode_cursor({"sort_key": "2024#é"})) == {"sort_key": "2024#é"} and payloads.encode_cursor(None) is None


def test_backoff():
    assert payloads.backoff_seconds(3) == 8 and payloads.backoff_seconds(9) == 30 and payloads.backoff_seconds(0, retry_after=100) == 30


PAGE = """intro
##  Updates
text
 * [ ](https://www.linkedin.com/posts/acme_launch-activity-111-x)
head
 3d
Report this post
 First line
more of it …more
[ 1,234 ](https://x/social-actions-reactions) [ 56 Comments ](https://x/social-actions-comments)
 * [ ](https://www.linkedin.com/posts/acme_other-activity-222-y)
 1w Edited
Report this post
Second `` ``
## Next
 * [ ](https://www.linkedin.com/posts/acme_hidden-activity-333)
"""


def test_posts(spark):
    pages = spark.createDataFrame([("p", PAGE)], "page string, md string").withColumn("at", F.expr("timestamp'2024-02-10 12:00:00'"))
    a, b = social.posts(pages, "md", "at").orderBy("pos").collect()
    assert (a.url, a.text, a.relative_time, a.edited, a.estimated_age_days, a.estimated_date, a.reactions, a.comments) == ("https://www.linkedin.com/posts/acme_launch-activity-111-x", "First line\nmore of it", "3d", False, 3.0, "2024-02-07", 1234, 56)
    assert (b.text, b.relative_time, b.edited, b.estimated_age_days, b.reactions) == ("Second", "1w", True, 7.0, 0)
    assert social.recent_posts(social.posts(pages, "md", "at"), 5, 9, ["page"]).count() == 1


def test_media_by_offset(spark):
    urls = ["https://www.linkedin.com/posts/a-activity-1-x", "https://www.linkedin.com/posts/b-activity-2-y", "https://www.linkedin.com/posts/none-activity-9"]
    img = '<img alt="i" src="https://media.licdn.com/dms/image/{}/feedshare-shrink_1?a=1&amp;b=2">'
    video = '<video poster="p.jpg" data-sources="[{&quot;src&quot;:&quot;lo.mp4&quot;,&quot;data-bitrate&quot;:1},{&quot;src&quot;:&quot;hi.mp4&quot;,&quot;data-bitrate&quot;:9}]">'
    body = f'<script>"{urls[1]}"</script>' + img.format(0) + f'<a href="{urls[0]}?tracking=1">' + img.format(1) + img.format(2) + f'<a href="{urls[1]}">' + video + '<img src="https://media.licdn.com/dms/image/company-logo_1">'
    got = {r.url: r for r in social.media(spark.createDataFrame([("p", body)], "page string, html string"), "html", spark.createDataFrame([("p", u) for u in urls], "page string, url string"), "page").collect()}
    assert got[urls[0]].images == [f"https://media.licdn.com/dms/image/{i}/feedshare-shrink_1?a=1&b=2" for i in (1, 2)] and got[urls[0]].videos == []
    assert [json.loads(v)["src"] for v in got[urls[1]].videos] == ["hi.mp4"] and got[urls[1]].images == [] and got[urls[2]].images == []
    item = social.post_item(spark.createDataFrame([("line one\nrest", "u", "2024-01-01", "3d", False, 1, 2, ["i.png"], [])], "text string, url string, estimated_date string, relative_time string, edited boolean, reactions int, comments int, images array<string>, videos array<string>")).first()
    assert (item.title, item.image_url) == ("line one", "i.png") and json.loads(item.extra)["reactions"] == 1


def test_blocked(spark):
    schema = "success boolean, status int, url string, html string, markdown string, error string, exception string"
    long = "w " * 200
    rows = [(True, 200, "u", "", long, None, None), (True, 403, "u", "", long, None, None), (False, None, "u", "", long, "net::ERR", None), (True, 200, "u", "captcha", long, None, None), (True, 200, "u", "", "short", None, None), (False, None, "u", "captcha", long, None, None), (None, None, None, None, None, None, "Timeout 30s"), (None, None, None, None, None, None, "value error")]
    out = spark.createDataFrame(rows, schema).select(social.blocked_page(F.struct("*"), ["Captcha"], [403, 429], 100)).collect()
    assert [r[0] for r in out] == [False, True, True, False, True, True, True, False]
    social_rows = [(True, 200, "https://x", "", "ok", None, None), (True, 999, "https://x", "", "", None, None), (True, 200, "https://x/login", "", "", None, None), (False, 200, "https://x", "", "", None, None)]
    assert [r[0] for r in spark.createDataFrame(social_rows, schema).select(social.blocked_social(F.struct("*"))).collect()] == [False, True, True, True]


def test_quote(one):
    page = "14,65 EUR -0,07 EUR -0,48 % then 100,00 SEK +1,00 SEK +1,01 %"
    assert tuple(one(lambda c: social.quote(c, "EUR"), page)) == (14.65, -0.48) and tuple(one(lambda c: social.quote(c, "SEK"), page)) == (100.0, 1.01)
    assert one(lambda c: social.quote(c, "USD"), page) is None


def test_media_of_a_page_with_many_tags(spark):
    """Linear in the page: fifty thousand tags, and the same links over and over."""
    import time

    def page(n):
        return "".join(f'<a href="https://x/posts/a-activity-{i % 40}?t=1"><img src="https://media.licdn.com/dms/image/{i}/feedshare_x">' for i in range(n))

    def seconds(n):
        began = time.perf_counter()
        rows = spark.createDataFrame([("p", page(n))], "page string, html string")
        wanted = spark.createDataFrame([("p", f"https://x/posts/a-activity-{i}") for i in range(40)], "page string, url string")
        got = {r.url: r.images for r in social.media(rows, "html", wanted, "page").collect()}
        assert len(got["https://x/posts/a-activity-0"]) == 1 and len(got["https://x/posts/a-activity-39"]) == n - 39
        return time.perf_counter() - began

    seconds(100)
    small, large = seconds(5_000), seconds(50_000)
    assert large < 12 * small + 3


def test_spark_sql_functions_are_inlined(spark):
    from tidewire.plans import surface

    own = spark.newSession()
    surface.register(own, {"t": own.createDataFrame([("Breaking:  A b ", " HTTPS://X/A/#f ", '{"summary": 1}', "[1]")], "title string, url string, raw string, odd string")})
    out = own.sql("SELECT normalize_title(title) AS a, canonicalize_url(url) AS b, cast(parse_llm_json(raw) AS string) AS c, parse_llm_json(odd) IS NULL AS d, title_hash(NULL) IS NULL AS e, jaccard(array(), array()) AS f, cosine(array(0.0), array(1.0)) IS NULL AS g, classify_event(NULL).event_type AS h FROM t")
    assert "Python" not in out._jdf.queryExecution().toString()
    assert tuple(out.first()) == ("a b", "https://x/a", '{"summary":1}', True, True, 1.0, True, "Atualizacao")
    assert "canonicalize_url" not in {f.name for f in spark.catalog.listFunctions()}
