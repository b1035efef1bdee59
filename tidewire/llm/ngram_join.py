"""Set-similarity join of word n-gram sets by set-relation skipping.

A document's set is its distinct 4-word shingles (64-bit hashes); two sets link when
100 * intersection >= 85 * union. Equal sets are one class from the start. Then:

1. Index. A set of n tokens, in one global order, needs only its first n - ceil(0.85 n) + 1 tokens
   in the inverted lists. The order is by hash, with tokens that stand in many prefixes last, so that
   passages which many documents share stay out of the lists. (The order decides cost, not results.)
2. The answers of one set in each list. Each list has a centre, the set with the smallest part of tokens
   of its own (of near copies, the text they were made from); every other member is compared with it: one
   pair for each member. Sizes, positions and the Hamming distance of parity bitmaps, a lower bound of the
   symmetric difference, leave few pairs to count exactly. A list of two sets is finished by that.
3. The others' answers from the centre's. Two sets that link to one centre are joined and are not compared;
   a list whose sets are all joined is skipped whole. Of the rest, the known distances to the centre must
   leave a link possible (Jaccard distance is a metric). Before their first common token two linked sets
   have at most 3/37 of their tokens, so lists are sorted by position, and a set skips the block of a list
   beyond that position unread. Of the pairs that sizes and bitmaps leave open, each group of joined sets has
   its most promising one counted exactly; then all between groups that are still apart are.
4. Components of the links, by least label and pointer jumping.

A long list is dealt by hash. Its largest group of joined sets is dealt into chunks of about TILE sets, each of
which meets only the sets outside that group; these meet each other in tiles. So a token of a third of all
rows, whose sets are mostly joined to one centre, costs in proportion to them.

Nulls and texts without words have empty sets and link with nothing. Fewer than four words are one
shingle. Rows with the same id are sets of their own; the component is the least id among them. Very long
texts are one set like others. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import BATCH_ROWS, Stored, arrow_rows, free_name, mix, shingles, ship, sliced, table, word_hashes

WIDTH, PERCENT = 4, 85
#: Words of a parity bitmap.
BITMAP_WORDS = 16
#: Sets on either side of a tile of a long list, about; pairs of a tile that are looked at together.
TILE, LOT = 512, 1 << 16
#: A token in more prefixes than this goes last in the order, the commonest HEAVY_TOKENS at most (what is broadcast).
HEAVY, HEAVY_TOKENS = 8, 1 << 19
#: Entries of one list that one task reads, about: longer lists are salted.
SPLIT = 1 << 16
#: Ids that are broadcast to pick documents out, at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def token_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return shingles(word_hashes(text or ""), width)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit id of the set; equal sets have equal ids."""
    return int((mix(mix(tokens) + np.uint64(len(tokens))).sum(dtype=np.uint64)).astype(np.int64)) if len(tokens) else 0


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """docs: a key, further columns that go through, and last the text. make(text) gives the other values of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in schema.split(", ")]
    through = len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [make(text) for text in batch.column(through).to_pylist()]
            more = zip(*made, strict=True) if made else [[]] * (len(kinds) - through)
            columns = [*batch.columns[:through], *more]
            yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, schema)


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _most(sizes: Column) -> Column:
    """The greatest symmetric difference of linked sets whose sizes add up to this."""
    return F.floor(3 * sizes / 37)


def _apart(difference: Column, sizes: Column) -> Column:
    """Jaccard distance of sets with this symmetric difference and sum of sizes."""
    return 2 * difference / (sizes + difference)


_LISTS = "token long, sid long, pos long, n long, c long, cpos long, cn long, whole boolean"


def _entries_by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by token and own, a list's first entry is its centre. Lists of one set go; of two sets, the other one with the centre stays (whole);
    of more, all entries with the centre. `salted` entries are part of a longer list, and stay. What is held is a batch and two entries."""
    columns = ("token", "sid", "pos", "n", "salted")
    held = np.empty((0, 5), np.int64)  # the last list so far, while it has two entries or fewer
    centre: np.ndarray | None = None  # of the last list, once it has more

    def given(rows: np.ndarray, centres: np.ndarray, whole: bool) -> pa.RecordBatch:
        parts = [*rows[:, :4].T, *centres[:, 1:4].T]
        return pa.RecordBatch.from_arrays([*(pa.array(p, pa.int64()) for p in parts), pa.array(np.full(len(rows), whole))], names=[x.split()[0] for x in _LISTS.split(", ")])

    def finished(rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, len(rows)))
        long = (sizes > 2) | (rows[starts, 4] > 0)
        two = starts[(sizes == 2) & ~long]
        if len(two):
            yield given(rows[two + 1], rows[two], True)
        of = np.repeat(starts, sizes)
        mine = np.repeat(long, sizes)
        if mine.any():
            yield given(rows[mine], rows[of[mine]], False)

    for batch in batches:
        rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
        if centre is not None:
            same = int((rows[:, 0] == centre[0]).argmin()) if (rows[:, 0] != centre[0]).any() else len(rows)
            if same:
                yield given(rows[:same], np.broadcast_to(centre, (same, 5)), False)
            rows = rows[same:]
            if len(rows):
                centre = None
        rows = np.concatenate([held, rows])
        held = rows[:0]
        if not len(rows):
            continue
        starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        last = starts[-1]
        if last:
            yield from finished(rows[:last], starts[:-1])
        if len(rows) - last <= 2:
            held = rows[last:].copy()
        else:
            centre = rows[last].copy()
            yield given(rows[last:], np.broadcast_to(centre, (len(rows) - last, 5)), False)
    if len(held):
        yield from finished(held, np.array([0]))


def _lists(seen: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries of lists with two sets or more. hot: token, parts; entries of these tokens are salted."""
    sets = seen.where("n > 0").select("sid", "n", "own", "prefix").dropDuplicates(["sid"])
    entries = sets.select(F.posexplode("prefix").alias("pos", "token"), "sid", "n", "own").join(F.broadcast(hot), "token", "left")
    entries = entries.withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("sid"), F.col("parts"))))
    entries = entries.select("token", "sid", "pos", "n", "own", F.coalesce("salt", F.lit(0)).cast("int").alias("salt"), F.col("salt").isNotNull().cast("int").alias("salted"))
    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "own", "sid")
    # salts of a token that meet in one task run on as one list
    return dealt.select("token", "sid", "pos", "n", "salted").mapInArrow(_entries_by_list, _LISTS)


def _tiled(lists: DataFrame, sets: DataFrame, roots: DataFrame, known: DataFrame, best: bool) -> DataFrame:
    """Pairs of sets of a list, of different roots, that positions, distances to the centre and bitmaps leave open; best: of each root's pairs only the most promising."""
    own = lists.join(roots.selectExpr("vertex sid", "label"), "sid", "left").withColumn("root", F.coalesce("label", "sid")).drop("label")
    groups = own.groupBy("token", "root").agg(F.count("*").alias("m"))
    tokens = groups.groupBy("token").agg(F.max(F.struct("m", "root")).alias("largest"), F.sum("m").alias("m"), F.count("*").alias("roots"))
    tokens = tokens.where("roots > 1").select("token", F.col("largest.root").alias("main"), F.col("largest.m").alias("inside"), (F.col("m") - F.col("largest.m")).alias("outside"))
    work = own.join(tokens, "token").join(known, ["sid", "c"], "left").join(sets.select("sid", "bits"), "sid")
    # one tile for a short list; of a long one, chunks of the main group with chunks of the others, and these with each other
    short = F.col("inside") + F.col("outside") <= TILE
    into = lambda size: F.when(short, 1).otherwise(F.ceil(F.col(size) / TILE)).cast("int")
    work = work.withColumn("chunks", into("inside")).withColumn("others", into("outside")).withColumn("main", ~short & (F.col("root") == F.col("main")))
    work = work.withColumn("mine", F.pmod(F.xxhash64("sid", F.lit("chunk")), F.when(F.col("main"), F.col("chunks")).otherwise(F.col("others"))).cast("int"))
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    mine, all_of = F.col("mine"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    beside = F.transform(all_of("others"), lambda j: tile(1, F.least(mine, j), F.greatest(mine, j)))
    across = F.when(short, F.array(tile(1, mine, mine))).otherwise(F.concat(F.transform(all_of("chunks"), lambda i: tile(0, i, mine)), beside))
    tiles = F.when(F.col("main"), F.transform(all_of("others"), lambda j: tile(0, mine, j))).otherwise(across)
    work = work.withColumn("tile", F.explode(tiles)).select(
        "token", "tile.kind", "tile.i", "tile.j", "pos", "main", "mine", "sid", "n", "root",
        F.coalesce("least", F.lit(0.0)).alias("least"), F.coalesce("most", F.lit(1.0)).alias("most"), F.col("c").alias("centre"), "bits",
    )
    dealt = work.repartition("token", "kind", "i", "j").sortWithinPartitions("token", "kind", "i", "j", "pos")
    found = dealt.mapInArrow(lambda batches: _open_pairs(batches, best), "root long, low long, a long, b long, sizes long")
    if best:
        found = found.groupBy("root").agg(F.min(F.struct("low", "a", "b", "sizes")).alias("x")).select("x.*")
    return found.select("a", "b", "sizes").distinct()


def _open_pairs(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Runs over tiles that stand together; the last tile of a batch waits for the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        keys = [rows[c].to_numpy() for c in ("token", "kind", "i", "j")]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if rows.num_rows else np.array([0])
        yield from _compared(rows.slice(0, starts[-1]), starts[:-1], best)
        rest = rows.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield from _compared(rest, np.array([0]), best)


def _compared(rows: pa.Table, starts: np.ndarray, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs within the tiles that begin at `starts`, whose rows rise by position; best: a row for each root, else all, with no root."""
    count = rows.num_rows
    if not count:
        return
    kind, i, j, pos, main, mine, sid, n, root, least, most, centre = (rows[c].to_numpy() for c in ("kind", "i", "j", "pos", "main", "mine", "sid", "n", "root", "least", "most", "centre"))
    pos = pos.astype(np.int64)
    bits = rows["bits"].combine_chunks().flatten().to_numpy().reshape(count, BITMAP_WORDS).view(np.uint64)
    tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, count)))
    span = int(pos.max()) + 2
    reach = 3 * (n + n * 100 // PERCENT + 1) // 37 - pos  # the last position at which a partner can stand
    ends = np.searchsorted(tile * span + pos, tile * span + np.clip(reach, -1, span - 2), side="right")
    partners = np.maximum(0, ends - np.arange(count) - 1)
    before = np.concatenate([[0], np.cumsum(partners)])
    wide = 1 - PERCENT / 100 + 1e-9
    found: list[np.ndarray] = []
    for at in range(0, int(before[-1]), LOT):
        number = np.arange(at, min(at + LOT, int(before[-1])))
        x = np.searchsorted(before, number, side="right") - 1
        y = x + 1 + number - before[x]
        far = 3 * (n[x] + n[y]) // 37
        # a tile of kind 0 is between the main group and the others; one of kind 1 between two chunks, or within one
        ok = (root[x] != root[y]) & np.where(kind[x] == 0, main[x] != main[y], (i[x] == j[x]) | (mine[x] != mine[y]))
        ok &= (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * PERCENT) & (pos[x] + pos[y] <= far)
        # entries of one list may know different centres, as salts have their own
        ok &= (centre[x] != centre[y]) | ((least[x] - most[y] <= wide) & (least[y] - most[x] <= wide))
        x, y, far = x[ok], y[ok], far[ok]
        low = np.maximum(np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64), np.abs(n[x] - n[y]))
        ok = low <= far
        x, y, low = x[ok], y[ok], low[ok]
        pairs = np.stack([low, np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y]), n[x] + n[y]])
        if best:
            found.append(_least_by_root(np.hstack([*found, np.vstack([root[x], pairs]), np.vstack([root[y], pairs])])))
            del found[:-1]
        else:
            found.append(np.vstack([np.zeros(len(x), np.int64), pairs]))
        if at + LOT >= before[-1] or not best and sum(f.shape[1] for f in found) >= LOT:
            out = np.unique(np.hstack(found), axis=1)  # near copies meet in many lists of a batch
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["root", "low", "a", "b", "sizes"])
            found = []


def _least_by_root(found: np.ndarray) -> np.ndarray:
    """Of columns (root, low, a, b, sizes), the least of each root."""
    found = found[:, np.lexsort(found[3::-1])]
    return found[:, np.flatnonzero(np.append(True, found[0, 1:] != found[0, :-1]))] if found.shape[1] else found


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sum of sizes and a lower bound of the symmetric difference that allows a link."""
    left, right = sets.selectExpr("sid a", "n na", "bits bits_a"), sets.selectExpr("sid b", "n nb", "bits bits_b")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    out = pairs.join(left, "a").join(right, "b")
    out = out.select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), F.greatest(apart, F.abs(F.col("na") - F.col("nb"))).alias("low"))
    return out.where(F.col("low") <= _most(F.col("sizes")))


def _picked(docs: DataFrame, wanted: DataFrame, count: int, keys: list[str], how: str) -> DataFrame:
    """docs joined with `wanted` by null-safe keys of the same names: broadcast up to BROADCAST_IDS rows, else by a shuffle."""
    own = wanted.select(*(F.col(k).alias(f"{k}_wanted") for k in keys), *(c for c in wanted.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_wanted"))
    return docs.join(F.broadcast(own) if count <= BROADCAST_IDS else own, same, how)


def _counted(open_pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> Stored:
    """open_pairs: a, b, sizes. a, b, sizes, difference: the exact symmetric difference. docs: doc_id, place, text."""
    needed = Stored(open_pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "doc_id", "place"), "sid"))
    texts = _picked(docs, needed.rows, needed.rows.count(), ["doc_id", "place"], "inner")

    def tokens(text: str | None) -> tuple[int, list[int]]:
        t = token_set(text)
        return set_id(t), t.view(np.int64).tolist()

    full = _mapped(texts.select("sid", "text"), tokens, "sid long, found long, tokens array<long>").where("sid = found")
    full = Stored(full.select("sid", "tokens").dropDuplicates(["sid"]), BATCH_ROWS)  # rows with equal ids and texts
    both = open_pairs.join(full.rows.selectExpr("sid a", "tokens ta"), "a").join(full.rows.selectExpr("sid b", "tokens tb"), "b")
    out = Stored(both.select("a", "b", "sizes", (F.col("sizes") - 2 * F.size(F.array_intersect("ta", "tb"))).alias("difference")))
    needed.drop()
    full.drop()
    return out


def components(edges: DataFrame) -> DataFrame:
    return _components(edges).rows


def _components(edges: DataFrame) -> Stored:
    """vertex, label: the least vertex that edges (a, b) connect it with. Least labels of neighbours, then the label's label, until nothing changes."""
    both = Stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = Stored(both.rows.groupBy(F.col("a").alias("vertex")).agg(F.min(F.least("a", "b")).alias("label")).withColumn("was", F.lit(None).cast("long")))
    while True:
        now = labels.rows.select("vertex", "label")
        seen = both.rows.join(now.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("label").alias("seen"))
        nearer = now.join(seen, "vertex").select("vertex", F.least("label", "seen").alias("near"), F.col("label").alias("was"))
        jump = now.select(F.col("vertex").alias("near"), F.col("label").alias("far"))
        after = Stored(nearer.join(jump, "near").select("vertex", F.least("near", "far").alias("label"), "was"))
        labels.drop()
        labels = after
        if after.rows.where("label <> was").isEmpty():
            both.drop()
            return labels


def _links(counted: DataFrame) -> DataFrame:
    return counted.where(F.col("difference") <= _most(F.col("sizes"))).select("a", "b")


def _heavy(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens of the prefixes by hash alone, and in how many rows' prefixes they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prefixes = [t[: prefix_size(len(t))] for t in map(token_set, batch.column(0).to_pylist()) if len(t)]
            if prefixes:
                tokens, counts = np.unique(np.concatenate(prefixes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    crowded = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        found = crowded.orderBy(F.desc("n"), "token").limit(HEAVY_TOKENS).toArrow()
    tokens, counts = found["token"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, place, sid, n) for each row, and pairs (a, b) of different sets that span the components of the links."""
    seen, links, _ = _linked(docs)
    return seen.rows.select("doc_id", "place", "sid", "n"), links


def _linked(docs: DataFrame) -> tuple[Stored, DataFrame, list[Stored]]:
    """Rows with doc_id, place (a hash of the text), sid and n; pairs (a, b); and the tables to drop when both are read."""
    spark = ship(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("place"), "text")
    heavy, often = _heavy(docs)
    hot = spark.createDataFrame([(t, int(-(-c // SPLIT))) for t, c in zip(heavy.view(np.int64).tolist(), often.tolist(), strict=True) if c > SPLIT], "token long, parts int")
    shared = spark.sparkContext.broadcast(heavy)

    def index(text: str | None) -> tuple:
        t = token_set(text)
        if not len(t):
            return 0, 0, None, None, None
        last = np.zeros(len(t), bool)
        if len(shared.value):
            at = np.minimum(np.searchsorted(shared.value, t), len(shared.value) - 1)
            last = shared.value[at] == t
        size = prefix_size(len(t))
        order = np.concatenate([t[~last], t[last]])[:size]
        own = int(1_000_000 * (1 - last.mean()))
        odd = np.bincount((t & np.uint64(BITMAP_WORDS * 64 - 1)).astype(np.int64), minlength=BITMAP_WORDS * 64) & 1
        return set_id(t), len(t), own, order.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)

    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id is {kind}; it must be an integer")
    seen = Stored(_mapped(docs.withColumn("doc_id", F.col("doc_id").cast("long")), index, "doc_id long, place long, sid long, n long, own long, prefix array<long>, bits array<long>"), BATCH_ROWS)
    lists = Stored(_lists(seen.rows, hot))
    shared.destroy()
    some = seen.rows.where("n > 0").select("sid", "n", "doc_id", "place", "bits").join(lists.rows.select("sid").union(lists.rows.select("c")).distinct(), "sid", "left_semi")
    sets = Stored(some.groupBy("sid", "n").agg(F.min(F.struct("doc_id", "place")).alias("one"), F.first("bits").alias("bits")).select("sid", "n", "one.doc_id", "one.place", "bits"))

    fits = _sizes_fit(F.col("n"), F.col("cn")) & (F.col("pos") + F.col("cpos") <= _most(F.col("n") + F.col("cn")))
    stars = lists.rows.where((F.col("sid") != F.col("c")) & fits).select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct()
    stars = Stored(_bounded(stars, sets.rows))
    first = _counted(stars.rows.select("a", "b", "sizes"), docs, sets.rows)
    stars.drop()
    roots = _components(_links(first.rows))
    apart = _apart(F.col("difference"), F.col("sizes")).alias("least")
    known = first.rows.select(F.col("a").alias("sid"), F.col("b").alias("c"), apart).union(first.rows.select(F.col("b").alias("sid"), F.col("a").alias("c"), apart)).withColumn("most", F.col("least"))
    links = _links(first.rows)
    held = [seen, first, roots]
    for best in (True, False):
        open_pairs = Stored(_tiled(lists.rows.where("not whole"), sets.rows, held[-1].rows, known, best))
        if open_pairs.rows.isEmpty():
            open_pairs.drop()
            break
        counted = _counted(open_pairs.rows, docs, sets.rows)
        open_pairs.drop()
        # a component so far is a star around its least set
        links = _links(counted.rows).union(held[-1].rows.where("vertex <> label").selectExpr("vertex a", "label b"))
        held.append(counted)
        if best:
            held.append(_components(links))
    lists.drop()
    sets.drop()
    return seen, links, held


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, and what tells rows with the same id apart: sid, which equal sets share, and place, a hash of the text."""
    seen, links, held = _linked(docs)
    roots = _components(links)
    rows = seen.rows.select("doc_id", "place", "sid", "n")
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.rows, classes.sid == roots.rows.vertex, "left").select("sid", "least", F.coalesce("label", "sid").alias("root"))
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(whole, "root").select("sid", "component_id")
    # a copied set with a third of all rows is one key: most sets stand alone, and Spark splits what is left
    out = rows.join(named, "sid", "left")
    out = Stored(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "sid", "place"))
    for table_ in [*held, roots]:
        table_.drop()
    return out.rows


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of the least id of each component, one of those with equal id and set; same columns. A row without an id stands for its component if no row of it has one.

    Rows go by a join with the ids to drop; the texts are shuffled only if these are more than BROADCAST_IDS.
    """
    named = near_duplicates(docs.select("doc_id", "text"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # of the rows with one id and set, those of one text stay, and of these one
    first = named.where(kept).groupBy("doc_id", "sid").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    again = Stored(first.where("n > 1").select("doc_id", "sid", F.col("place").alias("stays")))
    many = again.rows.count()
    gone = named.where(~kept).select("doc_id", "place")
    repeated = None
    if many:
        of = _picked(named.where(kept).select("doc_id", "sid", "place"), again.rows, many, ["doc_id", "sid"], "inner").select("doc_id", "place", (F.col("place") == F.col("stays")).alias("stays"))
        repeated = Stored(of.distinct())
        gone = gone.union(repeated.rows.where("not stays").select("doc_id", "place"))
    gone = Stored(gone.distinct())
    key, hashed = free_name(docs, "key"), free_name(docs, "hash")
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), hashed: F.xxhash64("text")})
    names = [key, hashed]
    left = _picked(marked, gone.rows.toDF(*names), gone.rows.count(), names, "left_anti")
    if repeated is not None:
        stays = repeated.rows.where("stays").select("doc_id", "place").toDF(*names)
        twice = stays.count()
        of_these = _picked(left, stays, twice, names, "left_semi").dropDuplicates(names)
        left = _picked(left, stays, twice, names, "left_anti").union(of_these)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("sid", "place")
