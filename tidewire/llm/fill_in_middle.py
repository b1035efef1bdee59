"""Fill-in-the-middle transformation by lookaround splitting.

A grammar of units (lines, words, paragraphs, characters) is stated by the neighbouring classes between which a unit
ends; `boundary` translates it to a zero-width regex, a look behind and a look ahead, at which split() cuts a text
without losing a character. Two hashes of the id choose which units are the middle, two more whether and in which
order the parts are written: plain, `<P>`prefix`<S>`suffix`<M>`middle (psm), or `<S>`suffix`<P>`prefix`<M>`middle (spm).
All of it is one projection of built-in functions: no shuffle, no Python.

A null text is empty. An empty text has no units (split() alone would give one) and is plain, as is a text that holds
a marker. A null doc_id hashes as one without digits. Repeated rows have equal results. Very long texts are cut as
others are. An empty table gives no rows. Further columns of the documents stay in `fill_in_middle`, whatever their
names, and are not read by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import free_name, table

SEED, RATE, SPM = 7, 100, 50
MARKERS = ("<P>", "<S>", "<M>")
#: Grammars of units: the class that the last character of a unit and the class that the first of the next one belongs to.
GRAMMARS = {
    "lines": (r"\n", r"[\s\S]"),  # [^\n]*\n|[^\n]+
    "words": (r"\s", r"\S"),  # \S*\s+|\S+
    "paragraphs": (r"\n\n", r"[^\n]"),  # up to the last of two or more line ends
    "characters": (r"[\s\S]", r"[\s\S]"),
}


def boundary(grammar: str) -> str:
    """The zero-width regex of where a unit ends and another begins."""
    before, after = GRAMMARS[grammar]
    return f"(?<={before})(?={after})"


def units(text: Column, grammar: str = "lines") -> Column:
    """The units of a text, in order; joined they are the text again."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, grammar: str = "lines", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs (doc_id, text, ...) with a struct `fim`: n, form, prefix, middle, suffix, output. rate: of documents that are cut, of 100; spm: of those in that order."""
    own = free_name(docs, "fim")
    text, holds = F.coalesce("text", F.lit("")), F.lit(False)
    p, s, m = map(F.lit, MARKERS)
    for marker in MARKERS:
        holds = holds | F.contains(f"{own}_text", F.lit(marker))
    cut = docs.withColumn(f"{own}_text", text).withColumns({f"{own}_units": units(F.col(f"{own}_text"), grammar)} | {f"{own}_h{k + 1}": _drawn(F.col("doc_id"), seed, k) for k in range(4)})
    n, h1, h2, h3, h4 = F.size(f"{own}_units"), *(F.col(f"{own}_h{k}") for k in (1, 2, 3, 4))
    plain = (F.col(f"{own}_text") == "") | holds | (h3 % 100 >= rate)
    cut = cut.withColumns({
        f"{own}_n": n,
        f"{own}_form": F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"),
        f"{own}_from": F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), f"{own}_to": F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int"),
    })
    pieces, start, end = F.col(f"{own}_units"), F.col(f"{own}_from"), F.col(f"{own}_to")
    parts = {"prefix": (F.lit(1), start), "middle": (start + 1, end - start), "suffix": (end + 1, F.size(pieces) - end)}
    cut = cut.withColumns({f"{own}_{name}": F.when(F.col(f"{own}_form") != "plain", F.array_join(F.slice(pieces, at, size), "")) for name, (at, size) in parts.items()})
    form, prefix, middle, suffix = (F.col(f"{own}_{x}") for x in ("form", "prefix", "middle", "suffix"))
    written = F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col(f"{own}_text"))
    made = F.struct(F.col(f"{own}_n").cast("long").alias("n"), form.alias("form"), prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), written.alias("output"))
    return cut.select(*docs.columns, made.alias("fim" if "fim" not in (c.lower() for c in docs.columns) else own))


def restored(output: Column, form: Column) -> Column:
    """The text that an output in a form was made of: no marker stands in its parts, so the markers alone cut it."""
    parts = F.split(output, "|".join(MARKERS), -1)
    first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
), numbers AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST(CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS BIGINT) % (len(units) + 1) AS a, CAST(CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS BIGINT) % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:n], '') AS suffix
  FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
