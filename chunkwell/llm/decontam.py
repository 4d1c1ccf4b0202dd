"""Benchmark decontamination by a distributed positional inverted index.

Windows: every run of ``n`` consecutive words of a benchmark item; an item with fewer words, but not
none, is one window.  The rarest words of each window, by their counts over all documents, are its
pivots.  The index holds the postings (document row, word, position, with the words around it) of
pivot words only.  A search joins postings with windows on the rarest word, shifts each position by
the word's offset in the window, intersects with the other words at their own offsets, and so
returns exact phrase matches.  ``proximity_matches`` asks only that the pivots stand within a distance.

Only DataFrame functions run here.  Windows, their words and the counts stay in tables of the shared folder.  A benchmark's windows are broadcast only
if a count shows at most ``BROADCAST_WINDOWS`` of them, else the postings are joined with them by a shuffle.  The pivot words,
which filter a document's words in place, are taken in blocks of about ``BLOCK_WORDS``, each a pass over the documents; the driver holds one
block of them at a time.

Defined cases: null or wordless documents have no words and no hits; null or wordless items have
no windows; equal windows of several items count for each item; repeated rows give one row each;
the windows of items with a null id count; such items are one
item, which is left out of the digest of ids; empty tables give no rows, or rows without hits; a long text is one row of one task; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_path, settled, small_side, unused, words_of

WINDOW, BLOCK_WORDS, BROADCAST_WINDOWS = 13, 20_000, 200_000


def item_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """win (its words), item_ids: distinct windows with the items that hold them; a null for those without an id."""
    w = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))))
    w = w.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s") + 1, n).alias("win"))
    # as structs, for collect_set leaves nulls out
    ids = F.collect_set(F.struct(F.col("item_id").cast("string").alias("id")))
    return w.groupBy("win").agg(F.array_sort(F.transform(ids, lambda x: x["id"])).alias("item_ids"))


def word_counts(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: occurrences over all documents of the windows' words.  Words are counted in each task before they are shuffled."""
    words = materialise(windows.select(F.explode("win").alias("word")).distinct(), "window-words")
    if (n := words.count()) <= BLOCK_WORDS:
        known = [r.word for r in words.collect()]
        each = docs.select(F.explode(F.filter(words_of(F.col(text_col)), lambda x: x.isin(known))).alias("word"))
    else:
        each = docs.select(F.explode(words_of(F.col(text_col))).alias("word"))
    counted = each.groupBy("word").agg(F.count("*").alias("n"))
    return counted if n <= BLOCK_WORDS else words.join(counted, "word")


def with_pivots(windows: DataFrame, counts: DataFrame, k: int = 1) -> DataFrame:
    """win, item_ids, pivots: its k rarest words (by count, then word) as structs of n, word and first offset.  windows: id, win, item_ids."""
    counts = small_side(materialise(counts, "word-counts"))
    each = windows.select("id", F.posexplode("win").alias("o", "word")).join(counts, "word", "left")
    first = each.groupBy("id", "word").agg(F.min("o").alias("o"), F.first(F.coalesce("n", F.lit(0))).alias("n"))
    picked = first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word", "o"))), 1, k).alias("pivots"))
    return windows.join(picked, "id").select("win", "item_ids", "pivots")


def pivoted(items: DataFrame, docs: DataFrame, n: int, text_col: str, k: int = 1) -> tuple[DataFrame, int]:
    """The windows with their pivots, as a table, and their number."""
    windows = materialise(item_windows(items, n).withColumn("id", F.monotonically_increasing_id()), "windows")
    windows = materialise(with_pivots(windows, word_counts(docs, windows, text_col), k), "pivots")
    return windows, windows.count()


def postings(docs: DataFrame, windows: DataFrame, reach: int, keep: list[str], text_col: str = "text") -> DataFrame:
    """The positional index of the windows' first pivots: keep, n_words, and for each occurrence word, pos and ctx, the words from pos - reach
    to pos + reach.  A document without any has one row with a null word; own marks one row of each document, so that it stays in the
    result.  Written to the shared folder, a block of words at a time."""
    spark = docs.sparkSession
    rare = materialise(windows.select(F.col("pivots")[0]["word"].alias("word")).distinct(), "pivot-words")
    n = max(1, -(-rare.count() // BLOCK_WORDS))
    path = scratch_path(spark, "postings")
    for i in range(n):
        block = sorted(r.word for r in rare.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i).collect())
        w = docs.select(*keep, words_of(F.col(text_col)).alias("__w"))
        at = F.filter(F.transform("__w", lambda x, p: F.when(x.isin(block), p)), lambda p: p.isNotNull())
        hit = F.transform(at, lambda p: F.struct(p.alias("pos"), F.element_at("__w", p + 1).alias("word"), F.slice("__w", F.greatest(p - reach, F.lit(0)) + 1, reach + 1 + F.least(p, F.lit(reach))).alias("ctx")))
        w = w.select(*keep, F.size("__w").cast("long").alias("n_words"), hit.alias("__h"))
        # outer in the first block only: one row at least for each document
        w = w.select(*keep, "n_words", (F.posexplode if i else F.posexplode_outer)("__h").alias("k", "h"))
        out = w.select(*keep, "n_words", F.lit(False).alias("own") if i else F.coalesce(F.col("k") == 0, F.lit(True)).alias("own"), "h.pos", "h.word", "h.ctx")
        out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def phrase_matches(index: DataFrame, windows: DataFrame, reach: int, n_windows: int) -> DataFrame:
    """Rows of the index with found, the windows that stand there: structs of start, len and item_ids.  Of rows without any only own ones stay."""
    key = windows.select(F.col("pivots")[0]["word"].alias("word"), F.struct(F.col("pivots")[0]["o"].alias("o"), "win", "item_ids").alias("x"))

    def stands(x: Column) -> Column:
        # offset-adjusted: the window's words are those of ctx from the shifted position on
        back = F.least(F.col("pos"), F.lit(reach)) - x["o"]
        return (back >= 0) & (F.slice(F.col("ctx"), F.greatest(back, F.lit(0)) + 1, F.size(x["win"])) == x["win"])

    match = lambda x: F.struct((F.col("pos") - x["o"]).alias("start"), F.size(x["win"]).alias("len"), x["item_ids"].alias("item_ids"))
    if n_windows <= BROADCAST_WINDOWS:
        # the windows of a word as one row: a posting meets each of them, and documents without any stay
        both = index.join(F.broadcast(key.groupBy("word").agg(F.collect_list("x").alias("wins"))), "word", "left")
        wins = F.coalesce("wins", F.array().cast(f"array<{key.schema['x'].dataType.simpleString()}>"))
        both = both.withColumn("found", F.transform(F.filter(wins, stands), match))
    else:  # a row for each posting and window: no group is gathered, and Spark splits the rows of a hot word
        both = index.join(key, "word").where(stands(F.col("x"))).withColumn("found", F.array(match(F.col("x"))))
        none = F.array().cast(both.schema["found"].dataType)
        both = both.withColumn("own", F.lit(False)).unionByName(index.where("own").withColumn("found", none).select("*"), allowMissingColumns=True)
    return both.drop("wins", "x", "ctx", "word", "pos").where("own or size(found) > 0")


def covered(spans: Column) -> Column:
    """Number of positions in the union of [start, start + len) structs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(a: Column, x: Column) -> Column:
        end = (x["start"] + x["len"]).cast("long")
        return F.struct((a["n"] + F.greatest(end - F.greatest(a["end"], x["start"].cast("long")), F.lit(0).cast("long"))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return settled(docs.sparkSession, "contamination", lambda: _contamination(docs, items, n, id_col, text_col))


def _contamination(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("__text"))
    windows, n_windows = pivoted(items, base, n, "__text")
    index = postings(base, windows, n - 1, ["__row", "__id"], "__text")
    found = phrase_matches(index, windows, n - 1, n_windows)
    # a row for each occurrence that matched, and one for each document
    hits = found.groupBy("__row").agg(
        F.first("__id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len")))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list(F.transform("found", lambda x: x["item_ids"])))))).alias("ids"),
    )
    n_hit = covered(F.col("spans"))
    out = hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, n: int = WINDOW, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, item_ids: places where the k rarest words of a window stand within slop words of their own distances."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    windows, n_windows = pivoted(items, docs, n, "__text", k)
    reach = n - 1 + slop
    index = postings(docs, windows, reach, ["doc_id"], "__text").where("word is not null")
    key = windows.select("item_ids", "pivots", F.col("pivots")[0]["word"].alias("word"), F.col("pivots")[0]["o"].alias("o"))
    both = index.join(F.broadcast(key) if n_windows <= BROADCAST_WINDOWS else key, "word")
    here = F.least(F.col("pos"), F.lit(reach))  # of the posting's own word in ctx

    def near(p: Column) -> Column:
        at = here + p["o"] - F.col("o")
        low = F.greatest(at - slop, F.lit(0))
        return F.array_contains(F.slice(F.col("ctx"), low + 1, F.greatest(at + slop + 1 - low, F.lit(0))), p["word"])

    return both.where(F.forall("pivots", near)).select("doc_id", (F.col("pos") - F.col("o")).alias("start"), "item_ids")


def keep_clean(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in whose text no window occurs, with all their columns.  Each row is decided by its own text, whatever its id."""
    digest = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    own, bad = unused(docs, "__digest", "__bad")
    found = contamination(docs.select(digest.alias(own), text_col), items, n, own, text_col).where("n_hit > 0").select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(small_side(found), digest == F.col(bad), "left_anti")
