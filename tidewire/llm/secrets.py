"""Secret scans by multipart credential linking, in DataFrame functions only.

Base detections (assign, access, hex) stand alone. Weak parts (bare secret-like strings, account
names, endpoints) are reported only when complementary parts share their scope: two parts do when at most
SCOPE code points lie between them. The interval join runs inside the row over its parts sorted by start:
the greatest stop before a part and the least start after it, of each complementary kind, give the gaps. So
nothing is shuffled, no document's parts meet another's, and a long text's time grows as its matches.

- weak_secret: 32 or more base64 characters with no field name, near an access identifier or account
- account: a user, client id or login field, near a secret (assign, hex or weak_secret)
- endpoint: a URL or host field, near both an identifier (access or account) and a secret

Nulls are empty texts: no spans, the hash of the empty string. Rows are scanned one by one, so
repeated rows and repeated ids give repeated results; an empty table gives no rows. Parts that start together
are told apart by stop, then kind. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import table

#: The base patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Parts that are weak alone.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
ACCOUNT = r"""(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
ENDPOINT = r"""(?i:https?|wss?|jdbc:[a-z]+|mongodb|redis|amqps?|postgres(?:ql)?|mysql)://[^\s"'<>|]+|(?i:host(?:_?name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}"""
SCOPE = 256
#: Matches that are run through at once.
BLOCK = 256
KINDS = ("assign", "access", "hex", "weak_secret", "account", "endpoint")


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once: what a lambda refers to by expression is worked out for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def _running(array: Column, add) -> Column:
    """Running results of `add` (of two like elements, associative): element i of all up to i.

    An array cannot be built up element by element in less than quadratic time, so blocks of BLOCK are run through on their own, then their last results.
    """
    def run(part: Column) -> Column:
        return F.aggregate(F.slice(part, 2, F.size(part)), F.slice(part, 1, 1), lambda out, x: F.concat(out, F.array(add(F.element_at(out, -1), x))))

    def cut(whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda i: run(F.slice(whole, i * BLOCK + 1, BLOCK)))

    def joined(blocks: Column) -> Column:
        def on(before: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: add(F.get(before, i - 1), x)))))

        return _let(run(F.transform(blocks, lambda b: F.element_at(b, -1))), on)

    return _let(array, lambda whole: F.when(F.size(whole) > 0, _let(cut(whole), joined)).otherwise(whole))


def located(text: Column, pattern: str, core: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, stop, size>>, stop exclusive, size that of group `core`; from the lengths of what lies between."""
    lit = F.lit(pattern)
    hits = F.regexp_extract_all(text, lit, F.lit(0))
    cores = F.regexp_extract_all(text, lit, F.lit(core)) if core else hits
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), cores.alias("core"))
    sizes = F.transform(pairs, lambda x: F.struct((F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("stop"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), F.coalesce(F.length(x["core"]), F.lit(0)).alias("size")))
    ends = _running(sizes, lambda a, b: F.struct((a["stop"] + b["stop"]).alias("stop"), b["hit"].alias("hit"), b["size"].alias("size")))
    spans = F.transform(ends, lambda x: F.struct((x["stop"] - x["hit"]).alias("start"), x["stop"].alias("stop"), x["size"].alias("size")))
    return F.filter(spans, lambda x: x["stop"] > x["start"])


def _beside(parts: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """parts: struct<start, stop, kind>, sorted by start. The parts, each with the least gap to a part of each group on its left (`left_<group>`) and right, negative if they overlap; its own is none of its group's."""
    far = F.lit(1 << 30)

    def marked(sorted_parts: Column, value: str, sign: int) -> Column:
        return F.transform(sorted_parts, lambda x: F.struct(*(F.when(x["kind"].isin(*kinds), sign * x[value]).otherwise(-far).alias(g) for g, kinds in groups.items())))

    def greatest(a: Column, b: Column) -> Column:
        return F.struct(*(F.greatest(a[g], b[g]).alias(g) for g in groups))

    def gaps(sorted_parts: Column, stops: Column, starts: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            least = (F.least(x["start"] - F.coalesce(F.get(stops, i - 1)[g], -far), -F.coalesce(F.get(starts, i + 1)[g], -far) - x["stop"]).alias(g) for g in groups)
            return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), *least)

        return F.transform(sorted_parts, of)

    def joined(p: Column) -> Column:
        stops = _running(marked(p, "stop", 1), greatest)
        starts = F.reverse(_running(F.reverse(marked(p, "start", -1)), greatest))
        return _let(stops, lambda before: _let(starts, lambda after: gaps(p, before, after)))

    return _let(parts, joined)


def _only_if(gate: Column, value: Column) -> Column:
    return F.when(gate, value).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int,size:int>>)"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _named(spans: str, kind: str) -> Column:
    """Spans that sort by start, then by kind as listed."""
    return F.transform(F.col(spans), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, an array of spans (start, stop, size) for each of KINDS."""
    t = F.col("t")
    fields = t.contains("=") | t.contains(":")
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    runs = t.rlike("[0-9a-f]{16}")
    out = out.withColumns({
        "assign": _only_if(fields & t.rlike(r"(?i)password|passwd|secret|token|api_?key"), located(t, ASSIGN, 1)),
        "access": _only_if(t.contains("AKIA"), located(t, ACCESS)),
        # shorter runs are dropped, and runs are whole: leaving them to the gaps gives the same spans with far fewer steps
        "hex": _only_if(runs, located(t, "[0-9a-f]{%d,}" % LEAST["hex"])),
        "account": _only_if(fields & t.rlike(r"(?i)user|login|client_?id|account|access_?key"), located(t, ACCOUNT)),
        "endpoint": _only_if(t.contains("://") | (fields & t.rlike("(?i)host|endpoint|server")), located(t, ENDPOINT)),
        "weak_secret": _only_if(t.rlike("[A-Za-z0-9+/]{32}"), located(t, WEAK_SECRET)),
    })
    out = out.withColumn("assign", F.filter("assign", lambda x: x["size"] >= LEAST["assign"]))
    out = out.withColumn("access", F.filter("access", lambda x: x["size"] >= LEAST["access"]))
    def parts(*kinds: str) -> Column:
        def named(kind: str) -> Column:
            return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))

        return F.array_sort(F.concat(*map(named, kinds)))

    def of(kind: str, found: str, linked=None) -> Column:
        some = F.filter(found, lambda x: (x["kind"] == kind) & (linked(x) if linked else F.lit(True)))
        return F.transform(some, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), (x["stop"] - x["start"]).alias("size")))

    # a bare string that a base span covers is no weak part of its own
    base = KINDS[:3]
    out = out.withColumn("found", F.when(F.size("weak_secret") > 0, _beside(parts(*base, "weak_secret"), {"base": base})))
    bare = of("weak_secret", "found", lambda x: x["base"] >= 0)
    out = out.withColumn("weak_secret", F.when(F.size("weak_secret") > 0, bare).otherwise(F.col("weak_secret")))
    weak = F.size("weak_secret") + F.size("account") + F.size("endpoint") > 0
    groups = {"ids": ("access", "account"), "secrets": ("assign", "hex", "weak_secret")}
    out = out.withColumn("found", F.when(weak, _beside(parts(*KINDS), groups)))
    linked = {
        "weak_secret": lambda x: x["ids"] <= SCOPE,
        "account": lambda x: x["secrets"] <= SCOPE,
        "endpoint": lambda x: (x["ids"] <= SCOPE) & (x["secrets"] <= SCOPE),
    }
    return out.select(id_col, *base, *(F.when(weak, of(k, "found", linked[k])).otherwise(F.col(k)).alias(k) for k in KINDS[3:]))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [_named(k, k) for k in KINDS[:3]]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.encode(_joined(F.concat(*base)), "utf-8"), 256).alias("base_sha256"),
        _joined(F.concat(*base, *(_named(k, k) for k in KINDS[3:]))).alias("spans"),
    )
