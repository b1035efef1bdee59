"""Model output, vectors, numbers and opaque cursors."""

from __future__ import annotations

import base64
import json
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import strip

#: What a summary's fields may hold, and their lengths.
EVENT_TYPES = ("Lancamento", "Evento", "Institucional", "M&A", "Preco", "Investimento", "Distribuicao", "Executivos", "Indicador", "Atualizacao")
ALERT_LEVELS = ("Alto", "Medio", "Baixo")
SUMMARY_CHARS, ANALYSIS_CHARS, TITLE_CHARS = 900, 500, 120
FALSE_WORDS = ("false", "no", "0", "n", "f")


def json_object(raw: Column) -> Column:
    """The variant of a JSON object: the whole text, else from its first brace to its last; null if there is none."""

    def as_object(text: Column) -> Column:
        v = F.try_parse_json(text)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    whole = F.try_parse_json(raw)
    inner = as_object(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    return F.when(whole.isNull(), inner).otherwise(as_object(raw))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    """A field that is a string; null if it is anything else."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def relevant(v: Column) -> Column:
    """Booleans, numbers and yes-no words; anything else counts as relevant."""
    kind = _kind(v, "$.relevant")
    word = F.lower(strip(_text(v, "$.relevant")))
    number = F.try_variant_get(v, "$.relevant", "double")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$.relevant", "boolean"))
        .when(kind == "STRING", ~F.coalesce(word.isin(*FALSE_WORDS), F.lit(False)))
        .when(number.isNotNull(), number != 0)
        .otherwise(F.lit(True))
    )


def normalized_summary(raw: Column) -> Column:
    """struct<summary, competitor_analysis, title, event_type, alert_level, relevant, error>; with an error the rest is null."""
    v = json_object(raw)
    summary = strip(_text(v, "$.summary"))
    error = F.when(v.isNull(), "invalid json").when(F.coalesce(summary, F.lit("")) == "", "missing summary")

    def fine(c: Column) -> Column:
        return F.when(error.isNull(), c)

    def among(path: str, allowed: tuple[str, ...], default: str) -> Column:
        c = _text(v, path)
        return F.when(c.isin(*allowed), c).otherwise(F.lit(default))

    def short(path: str, limit: int) -> Column:
        return F.substring(strip(F.coalesce(_text(v, path), F.lit(""))), 1, limit)

    return F.struct(
        fine(F.substring(summary, 1, SUMMARY_CHARS)).alias("summary"),
        fine(short("$.competitor_analysis", ANALYSIS_CHARS)).alias("competitor_analysis"),
        fine(short("$.title", TITLE_CHARS)).alias("title"),
        fine(among("$.event_type", EVENT_TYPES, "Atualizacao")).alias("event_type"),
        fine(among("$.alert_level", ALERT_LEVELS, "Baixo")).alias("alert_level"),
        fine(relevant(v)).alias("relevant"),
        error.alias("error"),
    )


def verdict(raw: Column) -> Column:
    """The first of same, different, related among the words; else different."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[^a-z]", " "), r"\s+")
    return F.coalesce(F.get(F.filter(words, lambda w: w.isin("same", "different", "related")), 0), F.lit("different"))


def best_video(tag: Column) -> Column:
    """struct<poster, src> of the source with the highest bit rate, the first on a tie; null if there is none."""
    raw = F.replace(F.replace(F.regexp_extract(tag, 'data-sources="([^"]*)"', 1), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    sources = F.from_json(raw, "array<struct<src:string,`data-bitrate`:double>>")
    rate = lambda s: F.coalesce(s["data-bitrate"], F.lit(0.0))
    top = F.array_max(F.transform(sources, rate))
    best = F.get(F.filter(sources, lambda s: rate(s) == top), 0)
    poster = F.regexp_extract(tag, 'poster="([^"]*)"', 1)
    return F.when(F.size(sources) > 0, F.struct(F.nullif(F.replace(poster, F.lit("&amp;"), F.lit("&")), F.lit("")).alias("poster"), best["src"].alias("src")))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def similarity_band(score: Column, low: float = 0.75, high: float = 0.85) -> Column:
    """Both bounds exclusive below: over high is a duplicate, over low is for the judge."""
    return F.when(score > high, "duplicate").when(score > low, "ambiguous").otherwise("new")


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def grouped_count(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("int"), F.lit(0))


def backoff_seconds(attempt: int, base: float = 1.0, jitter: float = 0.0, retry_after: float | None = None, most: float | None = 30.0) -> float:
    """Seconds before the next attempt of an I/O worker."""
    wait = retry_after if retry_after is not None else base * 2**attempt + random.uniform(0, jitter)
    return wait if most is None else min(wait, most)


def encode_cursor(key: dict | None) -> str | None:
    return base64.urlsafe_b64encode(json.dumps(key, sort_keys=True).encode()).decode() if key else None


def decode_cursor(cursor: str | None) -> dict | None:
    return json.loads(base64.urlsafe_b64decode(cursor.encode())) if cursor else None
