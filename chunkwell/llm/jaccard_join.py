"""Exact Jaccard join of word-shingle sets in metric space.

Documents with equal sets are one class.  Between classes the join works with the Jaccard distance,
which is a metric.

Pivots and regions.  The nearest sets with one element to a document are those of its own shingles;
they are the first pivots, ordered by the count of their rarest word over all documents.  A partner within
distance ``1 - t`` can lack only ``floor((1 - t) n)`` of a document's n shingles, so the document's
window reaches over its first ``floor((1 - t) n) + 1`` pivots, and any two linked documents meet in a region.
(Documents as first pivots do not work here: unrelated documents are all at distance 1 from
each other, so every window would hold everything.)

Inside regions the join goes on with documents as pivots.  The member with the smallest number is a region's centre (classes are numbered in the order of a hash); regions
with the same centre are one.  Members that can't link by the counts of their shingles in hash buckets, a bound on what two sets
have in common, leave first.  A region of at most ``BLOCK`` members is compared in one task, which returns a spanning
forest of its links.  A larger one is dealt into parts, each with copies of the same pivots, some of its members: a part returns its forest and,
for each member, its Voronoi cells.  A member belongs to the cell of its nearest pivot, if that is within ``RADIUS``, or else to the rest; its window
copies it into the cells of all pivots that are at most twice the join's distance farther than the nearest, and within ``RADIUS`` and once that distance.
By the triangle inequality any two linked members meet in a cell or in the rest.  These are regions again: one whose members lie in one component
already is done, one of at most ``BLOCK`` members is compared, a larger one is split once more.  Where cells do not shrink (members that
are near each other but not linked), the region's blocks are compared with each other, those of one component left out.  So no pair is left out, none is
written, and a task holds at most two blocks or a block and the pivots.

Shingles are hashed to 64 bits for classes, pivots and buckets; links are decided on the words themselves, which are numbered within a
comparison.

Defined cases: lower-casing is of A-Z; words are what ASCII white space separates; a text with fewer
words than a shingle is one shingle; null and wordless texts have no shingle and link with nothing;
repeated rows are one class; where one id comes with several texts, each row has its own count and
is decided by its own text; a null id takes no part in links and comes back as its own row; an empty table gives no
rows; a long text is one set, held by one task; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, materialise, release, settled, small_side, tidy, unused
from .components import components

WORDS, PERCENT = 3, 90
SLOTS, BLOCK, DENSE, BUCKETS = 1 << 18, 512, 24, 128
#: Document pivots of a region that is split, the levels of splitting at most, and the share of a region's comparisons that its
#: cells may cost; the radius of a cell, and the name of the cell of members outside all of them.
PIVOTS, LEVELS, SHRINK, RADIUS, REST = 32, 6, 0.7, 0.75, -1
CACHED_WORDS = 150_000
_CACHE: dict[bytes, int] = {}
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def words(text: str | None) -> list[bytes]:
    """bytes.lower lowers A-Z only, and bytes.split takes exactly 0x20 and 0x09-0x0D as white space."""
    return (text or "").encode().lower().split()


def cache() -> dict[bytes, int]:
    """The words' hashes of this worker."""
    return _CACHE


def word_hashes(w: list[bytes]) -> np.ndarray:
    out = list(map(_CACHE.get, w))
    if None in out:
        if len(_CACHE) > CACHED_WORDS:
            _CACHE.clear()
        for i, h in enumerate(out):
            if h is None:
                out[i] = _CACHE[w[i]] = xxhash.xxh3_64_intdigest(w[i])
    return np.array(out, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(h: np.ndarray, k: int, rarity: np.ndarray | None = None):
    """Sorted distinct shingle hashes, and the smallest rarity of each shingle's words."""
    n = max(1, len(h) - k + 1) if len(h) else 0
    k = min(k, len(h))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + h[i : i + n] * MIX[i % len(MIX)] + np.uint64(i + 1 + 64 * k))
    if rarity is None:
        return np.unique(out)
    low = rarity[h[:n] & np.uint64(SLOTS - 1)].copy()
    for i in range(1, k):
        np.minimum(low, rarity[h[i : i + n] & np.uint64(SLOTS - 1)], out=low)
    out, at = np.unique(out, return_index=True)
    return out, low[at]


def exact_shingles(text: str | None, k: int) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def numbered(texts: list[str], k: int) -> list[np.ndarray]:
    """The shingle sets of texts, exactly: words are numbered, and so are their runs, one word after the other."""
    known: dict[bytes, int] = {}
    rows = [np.array([known.setdefault(w, len(known)) for w in words(t)], np.int64) for t in texts]
    size = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    lengths = np.repeat(np.minimum(size, k), size)
    at = np.arange(len(flat))
    ends = np.repeat(np.cumsum(size), size)
    # the number of the run of i words that begins at a word; runs end with their text, where a word -1 stands for what is missing
    run = flat
    for i in range(1, k):
        there = at + i < ends
        nxt = np.where(there, flat[np.minimum(at + i, len(flat) - 1)], -1) + 1
        _, run = np.unique(run * (len(known) + 1) + nxt, return_inverse=True)
    whole = at + lengths <= ends  # runs of k words, or of the whole text where that is shorter
    where = np.repeat(np.arange(len(rows)), size)[whole]
    order = np.lexsort((run[whole], where))
    run, where = run[whole][order], where[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (where[1:] != where[:-1])
    run, where = run[first], where[first]
    return np.split(run.astype(np.uint64), np.searchsorted(where, np.arange(1, len(rows))))


def window_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def word_table(docs: DataFrame) -> np.ndarray:
    """Documents of each hash slot of words, over all documents: SLOTS numbers."""

    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for b in batches:
            found = [w for t in b.column(1).to_pylist() for w in set(words(t))]
            seen += np.bincount((word_hashes(found) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65536], pa.int32()), pa.array(seen[at[i : i + 65536]], pa.int64())], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for b in docs.mapInArrow(tidy(run, cache), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out


def packed(counts: np.ndarray) -> bytes:
    """Bucket counts in one, two or four bytes each, as the largest needs; the length tells which."""
    most = int(counts.max())
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, {1: "u1", 2: "<u2", 4: "<u4"}[len(blob) // BUCKETS]).astype(np.int64)


def described(docs: DataFrame, table, k: int, percent: int) -> DataFrame:
    """doc_id, h, n, sig (of the whole set), pivots (the window's shingles, nearest region first), hist (shingles in each of BUCKETS
    hash buckets).  docs: doc_id, text, h."""

    def run(batches):
        rarity = table.value
        for b in batches:
            size, sigs, pivots, hists = [], [], [], []
            for t in b.column(1).to_pylist():
                h = word_hashes(words(t))
                s, low = shingles(h, k, rarity) if len(h) else (h, h)
                size.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                pivots.append(s[np.lexsort((s, low))][: window_size(len(s), percent)].view(np.int64))
                hists.append(packed(np.bincount((s >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(sigs, pa.binary()), pa.array(pivots, pa.list_(pa.int64())), pa.array(hists, pa.binary())], ["doc_id", "h", "n", "sig", "pivots", "hist"])

    return docs.mapInArrow(tidy(run, cache), "doc_id long, h long, n long, sig binary, pivots array<long>, hist binary")


def sieve(rows: DataFrame, percent: int) -> DataFrame:
    """rows (c, x, hist): the members of each region that may have a link in it.  What two sets have in common is at most the sum of
    the smaller counts over the buckets, so a pair that fails on that bound has no link."""

    def run(key, t):
        h = np.stack([unpacked(x) for x in t.column("hist").to_pylist()])
        n, keep = h.sum(1), np.zeros(len(h), bool)
        for i in range(0, len(h), 32):
            most = np.minimum(h[i : i + 32, None], h[None]).sum(2)
            may = 100 * most >= percent * (n[i : i + 32, None] + n[None] - most)
            may[np.arange(len(may)), np.arange(i, i + len(may))] = False
            keep[i : i + 32] = may.any(1)
        return t.select(["c", "x"]).filter(pa.array(keep))

    return rows.groupBy("c").applyInArrow(run, "c long, x long")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted hash sets: frequent shingles by a matrix product, the others from their lists."""
    g = len(sets)
    where = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(values := np.concatenate(sets), kind="stable")
    values, where = values[order], where[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.append(starts, len(values)))
    out = np.zeros((g, g), np.float32)
    dense = np.flatnonzero(size > DENSE)
    for k in range(0, len(dense), 2048):
        part = dense[k : k + 2048]
        x = np.zeros((g, len(part)), np.float32)
        for j, s in enumerate(part):
            x[where[starts[s] : starts[s] + size[s]], j] = 1
        out += x @ x.T
    for n in range(2, DENSE + 1):
        lists = starts[size == n]
        if len(lists):
            docs = where[lists[:, None] + np.arange(n)]
            flat = (docs[:, :, None] * g + docs[:, None, :]).ravel()
            out += np.bincount(flat, minlength=g * g).reshape(g, g)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """An edge from each member to the first of its component, from a symmetric matrix of links."""
    left = np.ones(len(linked), bool)
    out = []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & left)
            left[front] = False
            out += [(root, int(x)) for x in front]
    return out


def compare(rows: DataFrame, texts: DataFrame, k: int, percent: int, pivots: DataFrame | None = None) -> DataFrame:
    """rows (c, part, x): groups of at most 2 BLOCK members.  a, b: a spanning forest of the links in each group.  With pivots (c, x), which stand in every
    group of their region: also (c, cell, a) with a null b, the cells that member a belongs to."""
    both = rows.withColumn("pivot", F.lit(False))
    if pivots is not None:
        both = rows.join(small_side(pivots.withColumn("pivot", F.lit(True))), ["c", "x"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    whole = texts.join(small_side(materialise(both, "groups")), "x").select("c", "part", "x", "text", "pivot")
    eps = (100 - percent) / 100 + 1e-9

    def run(key, t):
        c = t.column("c")[0].as_py()
        xs = np.array(t.column("x").to_pylist())
        sets = numbered(t.column("text").to_pylist(), k)
        inter = common(sets)
        n = np.array([len(s) for s in sets])
        total = n[:, None] + n[None, :] - inter
        linked = (100 * inter >= percent * total) & (total > 0)
        links = forest(linked)
        a, b = [int(xs[i]) for i, _ in links], [int(xs[j]) for _, j in links]
        cells: list = [None] * len(a)
        at = np.flatnonzero(t.column("pivot").to_numpy(zero_copy_only=False))
        if len(at):
            d = 1 - inter[:, at] / np.maximum(total[:, at], 1)
            least = d.min(1, keepdims=True)
            member, cell = np.nonzero(d <= np.minimum(least + 2 * eps, RADIUS + eps))
            rest = np.flatnonzero(least[:, 0] > RADIUS)
            a, b = a + xs[member].tolist() + xs[rest].tolist(), b + [None] * (len(member) + len(rest))
            cells += xs[at[cell]].tolist() + [REST] * len(rest)
        if len(sets) > 128:
            del sets, inter, total, linked
            release()
        return pa.table([pa.array([c] * len(a), pa.int64()), pa.array(cells, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["c", "cell", "a", "b"])

    return whole.groupBy("c", "part").applyInArrow(run, "c long, cell long, a long, b long")


def merged(comps: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """node, component after more edges (a, b)."""
    if edges.isEmpty():
        return comps
    if comps is not None:
        edges = edges.unionAll(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return materialise(components(edges), "comps")


def unsettled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """c, x, comp, size for the members (c, x) of regions that do not lie in one component yet."""
    if comps is None:
        members = members.withColumn("comp", F.col("x"))
    else:
        known = comps.select(F.col("node").alias("x"), "component")
        members = members.join(small_side(known), "x", "left").withColumn("comp", F.coalesce("component", "x")).drop("component")
    members = materialise(members, "named")
    still = members.groupBy("c").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("c", "size")
    return materialise(members.join(small_side(still), "c").select("c", "x", "comp", "size"), "unsettled")


def in_parts(seed: int) -> Column:
    """The part that a member x of a region of so many members is dealt to: about BLOCK members in each."""
    return F.pmod(F.xxhash64("x", F.lit(seed)), F.ceil(F.col("size") / BLOCK)).cast("int")


def in_cells(large: DataFrame, texts: DataFrame, k: int, percent: int, level: int) -> DataFrame:
    """The forests of the parts of regions, and the cells of their members: compare() with PIVOTS members of each region as pivots."""
    order = W.partitionBy("c").orderBy(F.xxhash64("x", F.lit(level)), "x")
    pivots = materialise(large.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS).select("c", "x", "size"), "pivots")
    copies = pivots.select("c", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("part"), "x")
    rows = large.select("c", in_parts(level).alias("part"), "x").unionByName(copies).distinct()
    return materialise(compare(rows, texts, k, percent, pivots.select("c", "x")), "split")


def across(large: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of regions by comparing their blocks with each other, but for blocks that hold one component between them."""
    large = materialise(large.withColumn("block", in_parts(-1)), "blocks")
    blocks = large.groupBy("c", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    l, r = blocks.alias("l"), blocks.alias("r")
    pairs = l.join(r, (F.col("l.c") == F.col("r.c")) & (F.col("l.block") <= F.col("r.block"))).where(F.least("l.low", "r.low") != F.greatest("l.high", "r.high"))
    pairs = pairs.select(F.col("l.c").alias("c"), F.concat_ws("/", "l.block", "r.block").alias("part"), F.explode(F.array_distinct(F.array("l.block", "r.block"))).alias("block"))
    return materialise(compare(large.join(pairs, ["c", "block"]).select("c", "part", "x"), texts, k, percent).select("a", "b"), "across")


def linked_classes(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """node, component of the classes that have links.  members: (region c, class x); classes: x, doc_id, h, hist."""
    size = members.groupBy("c").agg(F.count("*").alias("size"))
    joined = materialise(members.join(small_side(size), "c"), "sized")
    hists = joined.where(F.col("size") <= BLOCK).select("c", "x").join(classes.select("x", "hist"), "x")
    small = materialise(sieve(hists, percent), "sieved")
    large = joined.where(F.col("size") > BLOCK).select("c", "x")
    wanted = classes.select("x", "doc_id", "h").join(small_side(small.select("x").union(large.select("x")).distinct()), "x")
    # a text is found by its id and its hash, for an id may come with several texts
    texts = materialise(docs.join(small_side(wanted), ["doc_id", "h"]).select("x", "text"), "texts")
    if not texts.groupBy("x").count().where("count > 1").isEmpty():  # repeated rows
        texts = materialise(texts.groupBy("x").agg(F.max("text").alias("text")), "texts")
    own = lambda rows: compare(rows.select("c", F.lit(0).alias("part"), "x"), texts, k, percent).select("a", "b")
    comps = merged(None, materialise(own(small), "compared"))
    for level in range(LEVELS + 1):
        large = unsettled(large, comps)
        if level:
            comps = merged(comps, materialise(own(large.where(F.col("size") <= BLOCK)), "compared"))
            large = large.where(F.col("size") > BLOCK)
        if large.isEmpty():
            break
        found = in_cells(large, texts, k, percent, level)
        comps = merged(comps, found.where("b is not null").select("a", "b"))
        cells = found.where("b is null").select("c", "cell", F.col("a").alias("x")).distinct()
        # the squares of sizes tell what comparisons cost: cells that spare too few are not worth their level
        cost = cells.groupBy("c", "cell").count().groupBy("c").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("cost"))
        cost = cost.join(large.groupBy("c").agg(F.first("size").alias("size")), "c").withColumn("deeper", (F.col("cost") < SHRINK * F.col("size") * F.col("size")) & F.lit(level < LEVELS))
        cost = materialise(cost.select("c", "deeper"), "cost")
        stuck = large.join(small_side(cost.where("not deeper")), "c").select("c", "x")
        if not stuck.isEmpty():
            comps = merged(comps, across(unsettled(stuck, comps), texts, k, percent))
        cells = cells.join(small_side(cost.where("deeper")), "c")
        # equal names of two cells would only make one region of them
        large = materialise(cells.select(F.xxhash64("c", "cell", F.lit(level)).alias("c"), "x").distinct(), "cells")
    return comps


def shared_regions(spread: DataFrame) -> DataFrame:
    """Rows (c, x) of regions with two classes or more, from (p, x).  A region is named by its smallest member, its centre, so regions with
    the same centre are one: near copies share it in nearly all their regions, and are sent once instead of once for each shingle.
    Both the centres and the join with them read one shuffle of (p, x)."""
    dealt = spread.repartition("p")
    regions = dealt.groupBy("p").agg(F.count("*").alias("n"), F.min("x").alias("c")).where("n > 1").select("p", "c")
    return materialise(dealt.join(regions.hint("merge"), "p").select("c", "x").distinct(), "members")


def jaccard_components(df: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of df."""
    return found_rows(df, k, percent, id_col, text_col).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")).alias("component_id"))


def found_rows(df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, first: the smallest (doc_id, h) of the row's component; null without an id or a shingle."""
    bounded_batches(df.sparkSession)
    return settled(df.sparkSession, "jaccard", lambda: _found_rows(df, k, percent, id_col, text_col))


def _found_rows(df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    table = spark.sparkContext.broadcast(word_table(docs))
    kept = materialise(described(docs, table, k, percent), "shingled")
    # one row of each class, picked by an aggregate that combines copies before the shuffle
    classes = kept.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min_by(F.struct("doc_id", "h", "pivots", "hist"), F.struct("doc_id", "h")).alias("r"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("x"), "sig", "r.*"), "classes")
    members = shared_regions(classes.select("x", F.explode("pivots").alias("p")))
    comps = linked_classes(members, classes, docs, k, percent)
    own = F.struct("doc_id", "h")
    if comps is None:
        named = classes.select("sig", own.alias("first"))
    else:
        comps = comps.select(F.col("node").alias("x"), "component")
        firsts = classes.select("x", "doc_id", "h").join(small_side(comps), "x").groupBy("component").agg(F.min(own).alias("root"))
        roots = materialise(comps.join(small_side(firsts), "component").select("x", "root"), "roots")
        named = classes.join(small_side(roots), "x", "left").select("sig", F.coalesce("root", own).alias("first"))
    out = kept.select("doc_id", "h", "n", "sig").join(named, "sig", "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def keep_one(df: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: of its rows with the smallest id the one with the smallest hash of the text.  Rows without an id or
    without a shingle stay, and so do rows that share an id but not a component."""
    i, h, row, place = unused(df, "__id", "__h", "__row", "__place")
    found = found_rows(df.select(id_col, text_col), k, percent, id_col, text_col).where("first is not null")
    gone = found.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("h") != F.col("first.h"))).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    mine = lambda o: (df[id_col].cast("long") == o[i]) & (F.xxhash64(df[text_col]) == o[h])
    gone = small_side(gone)
    left = df.join(gone, mine(gone), "left_anti")
    # repeats of a kept row are few: only they are compared
    repeats = found.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.first("first").alias("first")).where("n > 1 and doc_id = first.doc_id and h = first.h")
    repeats = materialise(repeats.select(F.col("doc_id").alias(i), F.col("h").alias(h)), "repeats")
    if repeats.isEmpty():
        return left
    repeats = small_side(repeats)
    one = left.join(repeats, mine(repeats)).withColumn(row, F.monotonically_increasing_id())
    one = one.withColumn(place, F.row_number().over(W.partitionBy(i, h).orderBy(row))).where(F.col(place) == 1).select(*(F.col(f"`{c}`") for c in df.columns))
    return left.join(repeats, mine(repeats), "left_anti").unionByName(one)
