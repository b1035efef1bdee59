"""The library's names in Spark SQL: temporary views of its tables, and functions defined in SQL, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.functions import rules
from tidewire.functions.text import ENTITIES, TITLE_PREFIXES


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _nested(inner: str, steps: list[str]) -> str:
    """Each step's `{}` filled with what came before."""
    for step in steps:
        inner = step.replace("{}", inner)
    return inner


def _holds(words: tuple[str, ...]) -> str:
    return f"exists(array({', '.join(map(_text, words))}), w -> contains(low, w))"


def _verdict() -> str:
    said = lambda kind, level: f"named_struct('event_type', {_text(kind)}, 'alert_level', {_text(level)})"
    launch = f"WHEN {_holds(rules.LAUNCH)} THEN if({_holds(rules.PARTS)}, {said('Lancamento', 'Alto')}, {said('Institucional', 'Medio')})"
    topics = " ".join(f"WHEN {_holds(words)} THEN {said(kind, level)}" for kind, level, words in rules.TOPICS)
    return f"CASE {launch} {topics} ELSE {said('Atualizacao', 'Baixo')} END"


_STRIP = r"regexp_replace({}, r'(?U)^\s+|\s+$', '')"
_COLLAPSE = r"regexp_replace({}, r'(?U)\s+', ' ')"

#: name(arguments), type, body. A function may use those before it.
FUNCTIONS = (
    ("canonicalize_url(url STRING)", "STRING", _nested("url", [_STRIP, "substring_index({}, '#', 1)", "lower(regexp_replace({}, '/$', ''))"])),
    ("normalize_title(title STRING)", "STRING", _nested("title", [_STRIP, "lower({})", _COLLAPSE, *(f"regexp_replace({{}}, r'^{p}\\s*', '')" for p in TITLE_PREFIXES)])),
    ("title_hash(title STRING)", "STRING", "md5(normalize_title(title))"),
    ("title_tokens(title STRING)", "ARRAY<STRING>", r"array_distinct(filter(regexp_extract_all(lower(title), r'([\p{L}\p{N}_]+)'), w -> length(w) > 1))"),
    ("jaccard(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "if(size(array_union(a, b)) = 0, 1.0D, size(array_intersect(a, b)) / size(array_union(a, b)))"),
    ("dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "aggregate(zip_with(a, b, (p, q) -> p * q), 0.0D, (s, v) -> s + v)"),
    ("cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "if(dot(a, a) > 0 AND dot(b, b) > 0, dot(a, b) / (sqrt(dot(a, a)) * sqrt(dot(b, b))), NULL)"),
    ("classify_lowered(low STRING)", "STRUCT<event_type: STRING, alert_level: STRING>", _verdict()),
    ("classify_event(text STRING)", "STRUCT<event_type: STRING, alert_level: STRING>", "classify_lowered(lower(coalesce(text, '')))"),
    ("clean_text(markup STRING)", "STRING", _nested("markup", ["regexp_replace({}, '<[^>]+>', ' ')", *(f"replace({{}}, {_text(e)}, {_text(p)})" for e, p in ENTITIES), _COLLAPSE, _STRIP])),
    ("object_of(raw STRING)", "VARIANT", "if(startswith(schema_of_variant(try_parse_json(raw)), 'OBJECT'), try_parse_json(raw), NULL)"),
    ("parse_llm_json(raw STRING)", "VARIANT", r"if(try_parse_json(raw) IS NULL, object_of(regexp_extract(raw, r'(?s)\{.*\}', 0)), object_of(raw))"),
)


def register(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> SparkSession:
    """The functions, and a temporary view of each table (a frame of that session), in a session; the same session."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for name, frame in (tables or {}).items():
        frame.createOrReplaceTempView(name)
    return spark
