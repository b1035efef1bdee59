"""String, hash, URL and HTML expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Prefixes taken off a title, once each, in this order.
TITLE_PREFIXES = ("breaking:", "update:", "news:", "just in:")
#: Entities replaced before white space is collapsed, in this order.
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#160;", " "),
    ("&rsquo;", "'"), ("&lsquo;", "'"), ("&rdquo;", '"'), ("&ldquo;", '"'), ("&mdash;", "-"), ("&ndash;", "-"),
)
#: An image URL with one of these is no article image.
BAD_IMAGE_MARKS = ("gstatic.com", "news.google", "googleusercontent", "branding", "logo", "favicon", "default", "placeholder")
#: Patterns of a page's images.
OG_IMAGE = r"""(?i)<meta\b[^>]*\bproperty=["']og:image["'][^>]*>"""
OG_CONTENT = r"""(?i)\bcontent=["']([^"']+)["']"""
FIRST_IMAGE = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
#: Alert levels as shown.
ALERT_LABELS = {"Alto": "High", "Medio": "Medium", "Baixo": "Low"}


def nz(c: Column) -> Column:
    """Null instead of the empty string: at rest the two are the same."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim takes blanks alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def canonical_url(url: Column) -> Column:
    """Stripped, cut at the fragment, one final slash off, wholly lower-cased; the query stays."""
    return F.lower(F.regexp_replace(F.substring_index(strip(url), "#", 1), "/$", ""))


def id_hash(url: Column, slug: Column) -> Column:
    """md5 of the canonical URL; without a URL, of a local one by slug."""
    return F.md5(canonical_url(F.coalesce(nz(url), F.concat(F.lit("local://"), slug))))


def normalized_title(title: Column) -> Column:
    out = collapse(F.lower(strip(title)))
    for prefix in TITLE_PREFIXES:
        out = F.regexp_replace(out, f"^{prefix}\\s*", "")
    return out


def lookup_title_hash(title: Column) -> Column:
    return F.md5(normalized_title(title))


def stored_title_hash(title: Column) -> Column:
    """The hash that rows are stored under: stripped and lower-cased only, so only lookups see through prefixes."""
    return F.md5(F.lower(strip(title)))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None else None)


def strip_html(c: Column, full_unescape: bool = False) -> Column:
    """Tags to blanks, common entities, white space collapsed; every other entity only through Python."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = strip(collapse(out))
    return unescape(out) if full_unescape else out


def clean_html(c: Column) -> Column:
    """Tags to blanks, entities, stripped; white space inside stays."""
    return strip(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


def visible_text(c: Column) -> Column:
    for block in ("script", "style"):
        c = F.regexp_replace(c, f"(?s)<{block}[^>]*>.*?</{block}>", " ")
    return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")


def clean_scraped(c: Column) -> Column:
    """Markdown links to their text, hashtags and bare URLs away, blanks collapsed."""
    c = F.regexp_replace(c, r"\[#[^\]]*\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"#\S+", "")
    c = F.regexp_replace(c, r"https?://\S+", "")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def display_text(summary: Column, title: Column, description: Column) -> Column:
    return F.coalesce(nz(summary), nz(clean_scraped(title)), nz(clean_scraped(description)), F.lit(""))


def og_image(page: Column) -> Column:
    tag = F.regexp_extract(page, OG_IMAGE, 0)
    return F.regexp_extract(tag, OG_CONTENT, 1)


def first_image(page: Column) -> Column:
    return F.regexp_extract(page, FIRST_IMAGE, 1)


def image_ok(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    bad = F.lit(False)
    for mark in BAD_IMAGE_MARKS:
        bad = bad | low.contains(mark)
    return (low != "") & ~bad


def page_image(page: Column, status: Column, limit: int = 100_000) -> Column:
    """The page's declared image, else its first, if it is one of the article's; nothing unless the status is 200."""
    head = F.substring(F.coalesce(page, F.lit("")), 1, limit)
    og, img = og_image(head), first_image(head)
    return F.when(F.coalesce(status, F.lit(0)) != 200, "").when(image_ok(og), og).when(image_ok(img), img).otherwise("")


def source_slug(name: Column) -> Column:
    out = F.translate(F.lower(name), " /·.,():", "---")
    return F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("&"), F.lit("and")), "-{2,}", "-"), "^-+|-+$", "")


def article_slug(source_id: Column, article_hash: Column) -> Column:
    out = F.translate(F.lower(F.concat_ws("_", source_id, F.substring(article_hash, 1, 8))), " /", "--")
    return F.substring(F.regexp_replace(out, "-{2,}", "-"), 1, 100)


def summary_slug(source_id: Column, article_hash: Column) -> Column:
    return F.concat_ws("_", source_id, F.substring(article_hash, 1, 8))


def object_key(prefix: str, run: str, source_id: Column, slug: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix.strip("/")), F.lit(run), source_id, F.concat(slug, F.lit(".md")))


def post_title(text: Column, limit: int = 280) -> Column:
    """The first line with text; if over the limit, cut at its last blank and marked."""
    line = F.regexp_extract(text, r"(?m)^[^\S\n]*(\S.*?)[^\S\n]*$", 1)
    head = F.substring(line, 1, limit)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))


def heading(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^\s*# (.*?)\s*$", 1)


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n\n[...truncated...]"))).otherwise(text)


def excerpt(body: Column, limit: int = 2000) -> Column:
    return F.substring(strip(body), 1, limit)


def action_description(given: Column, summary_text: Column) -> Column:
    return F.coalesce(nz(given), F.substring(F.coalesce(summary_text, F.lit("")), 1, 300))


def title_or_source(title: Column, source_name: Column, kind: Column) -> Column:
    return F.coalesce(nz(title), F.when(kind == "social", F.concat(source_name, F.lit(" LinkedIn post"))), F.lit(""))


def companies(tag: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tag, F.lit("")), ","), strip), lambda x: x != "")


def alert_label(level: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in ALERT_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, level), level)


def color_slot(name: Column, slots: int = 8, pinned: dict[str, int] | None = None) -> Column:
    """A slot by a 32-bit string hash (times 33, xor code), kept in a masked long; pinned names have their own."""
    key = F.lower(strip(name))
    codes = F.transform(F.filter(F.split(key, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    # the product may pass 32 bits before the exclusive or, which works on the low 32; the result is signed
    low = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: ((h * 33).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseXOR(c))
    slot = F.abs(F.when(low >= 2**31, low - 2**32).otherwise(low)) % slots
    for pin, value in (pinned or {"valeo": 5}).items():
        slot = F.when(key == pin, F.lit(value)).otherwise(slot)
    return slot.cast("long")


def picked_agent(agents: Column, attempt: Column) -> Column:
    return F.try_element_at(agents, (attempt % F.size(agents) + 1).cast("int"))


def search_url(base: str, query: Column, suffix: str, when_days: int | None = None) -> Column:
    """A search feed's URL; blanks as %20."""
    q = query if when_days is None else F.concat(query, F.lit(f" when:{when_days}d"))
    quoted = F.replace(F.replace(F.url_encode(q), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(base), quoted, F.lit(suffix))


def tokens(text: Column) -> Column:
    """Distinct lower-cased words of letters, digits and underscores, of two characters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; two empty ones are equal."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)
