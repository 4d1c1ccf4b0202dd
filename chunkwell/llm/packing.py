"""Lexical retrieval packing into sequences of at most 2048 tokens.

Documents are encoded once, equal units between spaces together (``Encoder.ended``); ids are kept in the shared folder, with each document's leaf: the nearest of at most ``LEAVES`` centres of
ids, fitted on a bounded sample (``SAMPLE_DOCS``, ``SAMPLE_TOKENS``) and put in an order in which similar leaves are neighbours.  Documents are
then sorted by leaf over the partitions (a range partitioning, so a leaf with a third of all rows is split), and a shard is a run of them:
at most ``SHARD_DOCS`` documents and ``SHARD_TOKENS`` tokens, or one longer document.  So every document is indexed, and documents with
like contents meet in a shard.

A shard has an inverted index; its BM25 weights take document frequencies and the mean length over all documents.  Chains fill windows side by side: each has a
seed document, and its window takes the seed's best unused documents of the shard by the score of all ids of the seed.  The document that
crosses the window's end is cut there, and its rest opens the next window and is the next seed.  The ends of chains are joined; only the end of these can be short: it is
cut into powers of two, which need no padding.

Retrieval reaches the shard.  A corpus of at most ``SHARD_DOCS`` documents is one shard, where it is exact; beyond that, neighbours in
other shards are not seen, which keeps time and memory in proportion to the corpus.  README states the recall; ``recall`` measures it.

Texts are not shuffled, ids once.  The driver holds the frequencies of the vocabulary and the centres.  A shard's order comes from leaf, hash and row number, so a
task that runs again gives the same.

Defined cases: null and empty texts are one piece with the end id only; repeated rows are packed
each; a null doc_id passes through; ties of scores go to the document that stands first in the shard; an empty table gives no rows; a long
text spans as many sequences as it needs; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded_batches, hash_share, materialise, release, tidy
from .token_counts import load, unsure

LENGTH, END_ID, SHARD_TOKENS, SHARD_DOCS = 2048, 1, 48_000_000, 12_288
#: Chains side by side in a shard, neighbours that a search brings (a seed asks again for more), the share of a shard's documents from
#: which an id's weights are a row of a matrix, rows of it at most, and documents whose best score is looked at together.
CHAINS, FETCH, DENSE, DENSE_ROWS, GROUP = 64, 16, 0.03, 2048, 64
#: Postings of rare ids that are added at a time.
POSTINGS = 1 << 19
#: Rows and bytes of text that are encoded together (whole batches of the scan, so up to one more), and tokens of which sets are made together.
ENCODE_ROWS, ENCODE_BYTES, SET_TOKENS = 2048, BATCH_BYTES // 2, 1 << 20
#: Units whose ids are made, or gathered, together.
UNITS = 1 << 16
#: Leaves at most, documents of each that there should be, and the sample that the centres are fitted on.
LEAVES, LEAF_DOCS, LEAF_IDS, SAMPLE_DOCS, SAMPLE_TOKENS, CENTRE_STEPS = 256, 1024, 4096, 4096, 2048, 8
K1, B, USED = 1.2, 0.75, -1e9
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LOADED: dict = {}


def joined_by_space(texts: pa.Array) -> pa.Scalar:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), " ")[0]


class Encoder:
    """Ids as the library for the .json file gives them by default: special strings inside texts become their ids.

    The byte-level BPE itself runs on the same vocabulary as ranks, which tests hold equal.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.find = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes = np.zeros(self.size, np.int64)  # of each id but the special ones
        self.bytes[list(ranks.values())] = [len(b) for b in ranks]
        self.json_path = json_path

    def ids(self, text: str) -> np.ndarray:
        if unsure(text):  # characters that the two libraries' Unicode tables may class differently
            return np.array(load(self.json_path).encode(text, add_special_tokens=False).ids, np.uint32)
        if self.find is None or not self.find.search(text):
            return self.plain(text)
        return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else self.plain(p) for p in self.find.split(text)])

    def ended(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and the end id after each, one after the other, in 16 bits where the vocabulary allows; and where each text's
        begin, with the end of all.

        A space after a character that is no white space always begins a pre-token, so the units between such spaces are encoded by themselves,
        equal ones once, and ids are gathered.  Texts with special strings or unsure characters are encoded whole.  Both go a block
        of units at a time: the lists and arrays of the way there are a block's, whatever the batch.
        """
        kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        n = len(texts)
        if not n:
            return np.zeros(0, kind), np.zeros(1, np.int64)
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        count = pc.list_value_length(lists).to_numpy()
        head = np.concatenate([np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)])
        units = lists.flatten().dictionary_encode()
        unit, names = units.indices.to_numpy(), units.dictionary
        del lists, units
        size = pc.binary_length(names).to_numpy() + 1
        odd = pc.or_(pc.equal(pc.binary_length(names), 0), pc.not_equal(pc.utf8_rtrim_whitespace(names), names)).to_numpy(zero_copy_only=False)

        # the space after an odd unit follows white space: the next unit is glued to it
        first, glued = np.zeros(len(unit), bool), np.zeros(len(unit), bool)
        first[head[:-1]] = True
        glued[1:] = odd[unit[:-1]]
        glued &= ~first
        own = first | odd[unit] & ~glued  # encoded from the text: the first unit, which has no space before it, and glued ones
        blocks = range(0, len(names), UNITS)
        doubt = any(unsure(joined_by_space(names.slice(i, UNITS)).as_py()) for i in blocks)
        whole = np.array([bool(self.find and self.find.search(t)) or doubt and unsure(t) for t in (x.as_py() for x in texts)])
        used = np.zeros(len(names), bool)
        used[unit[~(own | glued | np.repeat(whole, count))]] = True
        parts, long = [], np.zeros(len(names), np.int32)
        for i in blocks:
            here, part = used[i : i + UNITS], names.slice(i, UNITS)
            ids = self.plain(" " + joined_by_space(pc.if_else(pa.array(here), part, pa.scalar("x", names.type))).as_py())
            stop = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(np.where(here, size[i : i + UNITS], 2), dtype=np.int64)) + 1
            long[i : i + UNITS] = np.diff(stop, prepend=0)
            parts.append(ids.astype(kind))
        pool = np.concatenate(parts)
        start = np.cumsum(long, dtype=np.int64) - long
        del parts, ids

        out, ends, r = [], [np.zeros(1, np.int64)], 0
        while r < n:  # so many units at a time, or one longer text
            to = max(r + 1, int(np.searchsorted(head, head[r] + UNITS, "right")) - 1)
            at, rows = slice(head[r], head[to]), slice(r, to)
            ids, last = self.laid(texts.slice(r, to - r), unit[at], size, first[at], glued[at], own[at], whole[rows], count[rows], pool, start, long)
            out.append(ids)
            ends.append(ends[-1][-1] + last)
            r = to
        return np.concatenate(out), np.concatenate(ends)

    def laid(self, texts: pa.Array, unit, size, first, glued, own, whole, count, pool, start, long) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and the end id after each, and where each text's end.  unit: the texts' units; pool: the ids of units that are
        encoded once, which begin at start, so many as long says; first, glued, own: of each unit; whole, count: of each text."""
        row, head = np.repeat(np.arange(len(texts), dtype=np.int32), count), np.cumsum(count, dtype=np.int64) - count
        text, end = joined_by_space(texts).as_buffer(), np.cumsum(size[unit], dtype=np.int64)
        many = np.where(glued | whole[row], 0, long[unit])
        begin = start[unit]
        at = np.flatnonzero(own & (first | ~whole[row]))
        opens = np.append(np.flatnonzero(~glued), len(unit))
        to = end[opens[np.searchsorted(opens, at, "right")] - 1] - 1
        view = memoryview(text)
        extra = [
            self.ids(texts[r].as_py()) if w else self.plain(str(view[i:j], "utf-8"))
            for r, w, i, j in zip(row[at].tolist(), whole[row[at]].tolist(), (end[at] - size[unit[at]] - np.where(first[at], 0, 1)).tolist(), to.tolist(), strict=True)
        ]
        more = np.array([len(x) for x in extra], np.int32)
        many[at], begin[at] = more, len(pool) + np.cumsum(more) - more
        pool = np.concatenate([pool, *(x.astype(pool.dtype) for x in extra)])
        last = np.cumsum(np.add.reduceat(many, head), dtype=np.int64)
        place = np.int32 if max(len(pool), last[-1]) < 1 << 31 else np.int64
        source = np.repeat((begin - (np.cumsum(many, dtype=np.int64) - many)).astype(place), many)
        source += np.arange(len(source), dtype=place)
        return np.insert(pool[source], last, END_ID), last + np.arange(1, len(texts) + 1)

    def plain(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self.bpe.encode_ordinary(text)), np.uint32)


def encoder(json_path: str, ranks_path: str) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _LOADED:
        _LOADED[key] = Encoder(*key)
    return _LOADED[key]


def id_kind(json_path: str) -> type:
    with open(json_path, encoding="utf-8") as f:
        t = json.load(f)
    return np.uint16 if max([*t["model"]["vocab"].values(), *(x["id"] for x in t["added_tokens"])]) < 1 << 16 else np.uint32


def sets(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each document, sorted, one document after the other; how often each stands there; and where each document's begin,
    with the end of all."""
    if not docs:
        return np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(1, np.int64)
    ends = np.cumsum([len(d) for d in docs])
    terms, counts, size, first = [], [], [0], 0
    while first < len(docs):  # so many tokens at a time, or one longer document; a document's place and an id share 64 bits, 32 where they fit
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SET_TOKENS, "right")))
        part, n = np.concatenate(docs[first:last]), last - first
        kind, shift = (np.uint32, 16) if part.itemsize == 2 and n <= 1 << 16 else (np.uint64, 32)
        keys = np.repeat(np.arange(n, dtype=kind) << kind(shift), [len(d) for d in docs[first:last]])
        keys |= part
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        counts.append(np.diff(at, append=len(keys)).astype(np.int32))
        keys = keys[at]
        terms.append((keys & kind((1 << shift) - 1)).astype(part.dtype))
        size.extend(np.bincount((keys >> kind(shift)).astype(np.int64), minlength=n).tolist())
        first = last
    return np.concatenate(terms), np.concatenate(counts), np.cumsum(size)


class Leaves:
    """Centres of documents as sets of ids, in an order in which each is followed by the most similar one that is left.  The ids are the
    LEAF_IDS most frequent of the sample, without those of a single document."""

    def __init__(self, docs: list[np.ndarray], wanted: int):
        terms = [np.unique(d) for d in docs]
        seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *terms]))
        known = np.argsort(-seen, kind="stable")[:LEAF_IDS]
        known = np.sort(known[seen[known] > 1])
        self.slot = np.full(len(seen), -1, np.int32)
        self.slot[known] = np.arange(len(known))
        self.weight = np.log1p((len(terms) - seen[known] + 0.5) / (seen[known] + 0.5)).astype(np.float32)
        k = min(wanted, len(terms))
        x = np.zeros((len(terms), len(known)), np.float32)
        for row, t in zip(x, terms, strict=True):
            s = self.slot[t]
            row[s[s >= 0]] = self.weight[s[s >= 0]]
            row /= max(1e-9, float(np.linalg.norm(row)))
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)] if k else x
        for _ in range(CENTRE_STEPS if k > 1 else 0):
            near = (x @ centres.T).argmax(1)
            sums = np.stack([x[near == c].sum(0) for c in range(k)])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        order, left = [], list(range(k))
        while left:
            order.append(left.pop(max(range(len(left)), key=lambda j: float(centres[order[-1]] @ centres[left[j]])) if order else 0))
        self.centres = np.ascontiguousarray(centres[order].T)  # a row for each id

    def of(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each document, a set of ids (as sets gives them): the leaf whose centre has the largest cosine with it."""
        out = []
        for first in range(0, len(bounds) - 1, 256):
            b = bounds[first : first + 257]
            row, t = np.repeat(np.arange(len(b) - 1), np.diff(b)), terms[b[0] : b[-1]]
            s = np.where(t < len(self.slot), self.slot[np.minimum(t, len(self.slot) - 1)], -1)
            x = np.zeros((len(b) - 1, len(self.weight)), np.float32)
            x[row[s >= 0], s[s >= 0]] = self.weight[s[s >= 0]]
            out.append((x @ self.centres).argmax(1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def fitted(df: DataFrame, json_path: str, ranks_path: str, id_col: str, text_col: str) -> Leaves:
    """Leaves for a table, from a sample whose size does not grow with it.  Texts of the sample are cut; all others are read whole."""
    rows = df.count()
    wanted = min(LEAVES, -(-rows // LEAF_DOCS)) if rows > SHARD_DOCS else 1
    if wanted < 2:
        return Leaves([], 0)
    part = F.substring(F.col(text_col), 1, 4 * SAMPLE_TOKENS).alias("text")
    # about SAMPLE_DOCS rows by a hash of the id, whatever the number of rows; many rows of one id don't make it larger than twice that
    texts = [r.text for r in df.where(hash_share(id_col, rows, SAMPLE_DOCS // 2)).select(part).limit(2 * SAMPLE_DOCS).collect()]
    enc = encoder(json_path, ranks_path)
    return Leaves([enc.ids(t)[:SAMPLE_TOKENS].astype(np.int64) for t in texts if t], wanted)


def gathered(batches):
    """Batches joined until they have ENCODE_ROWS rows or ENCODE_BYTES: equal units of texts are encoded once in each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ENCODE_ROWS or sum(x.nbytes for x in held) >= ENCODE_BYTES:
            joined, held = pa.concat_batches(held), []
            del b
            yield joined
            del joined
    if held:
        yield pa.concat_batches(held)


def encoded(df: DataFrame, json_path: str, ranks_path: str, leaves=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit, cut to 16 bits where the vocabulary allows; with the end id.  leaf; row numbers the
    rows: the scan's partition, and a running number in it.  The last row of a task has no ids but seen: how many of its documents
    hold each id; then the number of its documents and of its tokens."""
    bounded_batches(df.sparkSession)
    names = ["doc_id", "ids", "leaf", "row", "seen"]

    def run(batches):
        enc = encoder(json_path, ranks_path)
        row, docs, tokens, seen = TaskContext.get().partitionId() << 33, 0, 0, np.zeros(enc.size + 2, np.int64)
        for b in gathered(batches):
            ids, bounds = enc.ended(b.column(1))
            terms, _, ends = sets(np.split(ids, bounds[1:-1]))
            n = b.num_rows
            seen += np.bincount(terms, minlength=len(seen))
            docs, tokens = docs + n, tokens + len(ids)
            leaf = leaves.value.of(terms, ends) if leaves else np.zeros(n)
            where = pa.array(np.arange(row, row + n))
            row += n
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), kept, pa.array(leaf.astype(np.int32)), where, pa.nulls(n, pa.list_(pa.int64()))], names)
            del b, ids, bounds, terms, ends, leaf, where, kept  # they go before the next batch comes
        seen[-2:] = docs, tokens
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([seen], pa.list_(pa.int64()))], names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, ids binary, leaf int, row long, seen array<long>")


def frequencies(kept: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each id, number of documents, number of tokens: over all rows, summed by Spark."""
    counted = kept.where("leaf < 0").select(F.posexplode("seen").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    size = kept.where("leaf < 0").agg(F.max(F.size("seen"))).first()[0] or 2
    table = np.zeros(size, np.int64)
    for r in counted.collect():
        table[r.id] = r.n
    return table[:-2], int(table[-2]), int(table[-1])


class Index:
    """BM25 inverted index of one shard: postings of each id as slices of two arrays, ids of many documents as rows of a matrix."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        term, counts, bounds = sets(docs)
        self.terms, size = np.split(term, bounds[1:-1]), np.diff(bounds)
        norm = (K1 * (1 - B + B * np.array([len(d) for d in docs]) / mean)).astype(np.float32)
        order = np.argsort(term, kind="stable").astype(np.int32 if len(term) < 1 << 31 else np.int64)
        self.term, self.doc, self.weight = term[order], np.repeat(np.arange(len(docs), dtype=np.int32), size)[order], counts[order].astype(np.float32)
        idf = idf.astype(np.float32)
        for at in self.chunks():  # counts become weights
            w = self.weight[at]
            self.weight[at] = idf[self.term[at]] * w * np.float32(K1 + 1) / (w + norm[self.doc[at]])
        self.size = len(idf)
        self.lay(np.arange(len(docs)))

    def chunks(self):
        return (slice(i, i + POSTINGS) for i in range(0, len(self.term), POSTINGS))

    def lay(self, own: np.ndarray) -> None:
        """Lay out the matrix and the postings for the documents own of the shard."""
        self.own, self.n, self.dense = own, len(own), None  # the old matrix goes before the new one comes
        place = np.full(len(self.terms), -1, np.int32)
        place[own] = np.arange(self.n)
        often = sum(np.bincount(self.term[at][place[self.doc[at]] >= 0], minlength=self.size) for at in self.chunks())
        dense = np.argsort(-often, kind="stable")[:DENSE_ROWS]
        dense = np.sort(dense[often[dense] > DENSE * self.n])
        self.slot = np.full(self.size, -1, np.int32)
        self.slot[dense] = np.arange(len(dense))
        # columns in groups of GROUP; the last row, which every query has, sinks the columns of used documents and those past the last
        self.dense = np.zeros((len(dense) + 1, -(-self.n // GROUP) * GROUP), np.float32)
        self.dense[-1, self.n :] = USED
        rare, weights = [], []
        for at in self.chunks():
            doc, row = place[self.doc[at]], self.slot[self.term[at]]
            here, posted = (doc >= 0) & (row >= 0), (doc >= 0) & (row < 0)
            self.dense[row[here], doc[here]] = self.weight[at][here]
            rare.append(doc[posted])
            weights.append(self.weight[at][posted])
        self.posted, self.posted_weight = np.concatenate(rare), np.concatenate(weights)
        often[dense] = 0
        self.ends = np.cumsum(often)

    def use(self, d: int) -> None:
        """Leave document d of the shard out of later searches."""
        at = int(np.searchsorted(self.own, d))
        if at < self.n and self.own[at] == d:
            self.dense[-1, at] = USED

    def search(self, queries: list[np.ndarray], k: int):
        """For each query, a set of ids that all count: the k best unused documents, best first, and their scores; ties by place."""
        size = np.array([len(q) for q in queries])
        term, row = np.concatenate(queries), np.repeat(np.arange(len(queries)), size)
        slot = self.slot[term]
        wants = np.zeros((len(queries), len(self.dense)), np.float32)
        wants[row[slot >= 0], slot[slot >= 0]] = 1
        wants[:, -1] = 1
        scores = wants @ self.dense
        rare, row = term[slot < 0], row[slot < 0]
        first = np.where(rare > 0, self.ends[rare - 1], 0)
        n = self.ends[rare] - first
        cut = np.searchsorted(np.cumsum(n), np.arange(POSTINGS, n.sum(), POSTINGS))  # so many postings at a time
        for f, m, r in zip(np.split(first, cut), np.split(n, cut), np.split(row, cut), strict=True):
            at = np.repeat(f - (np.cumsum(m) - m), m) + np.arange(m.sum())
            np.add.at(scores.reshape(-1), np.repeat(r * scores.shape[1], m) + self.posted[at], self.posted_weight[at])
        tops = scores.reshape(len(queries), -1, GROUP).max(2)
        for row, top in zip(scores, tops, strict=True):
            # the k best stand in the k groups with the best tops, and in those that tie with them
            least = np.partition(top, len(top) - k)[len(top) - k] if len(top) > k else 0
            groups = np.flatnonzero((top >= least) & (top > 0))
            at = (groups[:, None] * GROUP + np.arange(GROUP)).ravel()
            at = at[row[at] > 0]
            best = at[np.argsort(-row[at], kind="stable")][:k]
            yield self.own[best], row[best]


class Plan:
    """Where each document of a shard stands.  A chain has a seed, whose unused neighbours fill the chain's window; the document that crosses
    the window's end is the next seed."""

    def __init__(self, sizes: np.ndarray, chains: int, length: int = LENGTH):
        self.sizes, self.chains, self.length = sizes, chains, length
        self.used, self.chain, self.at = np.zeros(len(sizes), bool), np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
        self.total: list[int] = []
        self.seed: dict[int, int] = {}

    def place(self, chain: int, d: int) -> None:
        self.used[d], self.chain[d], self.at[d] = True, chain, self.total[chain]
        self.total[chain] += int(self.sizes[d])

    def seeds(self) -> dict[int, int]:
        """Chains and their seeds; new chains, evenly over the unused documents, where none is open."""
        if not self.seed:
            free = np.flatnonzero(~self.used)
            for d in free[:: max(1, -(-len(free) // self.chains))].tolist():
                self.seed[len(self.total)] = d
                self.total.append(0)
                self.place(len(self.total) - 1, d)
        return {} if self.used.all() else dict(self.seed)

    def take(self, found: dict[int, list[int]]) -> list[int]:
        """found: each chain's best unused documents, best first.  A chain that gets a part of its window asks again with the same
        seed; one whose seed has no neighbour left is closed.  Returns the documents that are used now."""
        taken = []
        for c in sorted(self.seed):
            if not found.get(c):
                del self.seed[c]
                continue
            room = self.length - self.total[c] % self.length
            for d in found[c]:
                if not self.used[d]:
                    self.place(c, d)
                    taken.append(d)
                    room -= int(self.sizes[d])
                    if room <= 0:  # it crosses the end: its rest opens the next window
                        self.seed[c] = d
                        break
        return taken


def planned(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int = LENGTH, chains: int = CHAINS) -> Plan:
    """The windows of a shard's documents.  The index is laid out anew when a quarter of its documents are used."""
    plan, index = Plan(np.array([len(d) for d in docs]), max(1, min(chains, sum(map(len, docs)) // length // 8)), length), Index(docs, idf, mean)
    started, left = 0, index.n
    while seeds := plan.seeds():
        if len(plan.total) > started:  # new chains have used their first seeds
            for d in list(seeds.values()):
                index.use(d)
            started, left = len(plan.total), int(np.count_nonzero(~plan.used))
        if 4 * left < 3 * index.n:
            index.lay(np.flatnonzero(~plan.used))
        found = index.search([index.terms[d].astype(np.int64) for d in seeds.values()], FETCH)
        taken = plan.take({c: best.tolist() for c, (best, _) in zip(seeds, found, strict=True)})
        for d in taken:
            index.use(d)
        left -= len(taken)
    return plan


def chain(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int = LENGTH) -> list[int]:
    """The order in which the documents of one shard fill the windows of one chain."""
    plan = planned(docs, idf, mean, length, 1)
    return np.lexsort((plan.at, plan.chain)).tolist()


def cuts(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of sequences for so many tokens: full ones, and powers of two for the rest."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Layout:
    """Sequences of a finished plan: the full windows of each chain, then the rests of all chains joined."""

    def __init__(self, plan: Plan):
        total, n = np.array(plan.total, np.int64), plan.length
        self.length, self.full = n, total // n * n
        self.first = np.cumsum(self.full) - self.full
        rest = total - self.full
        self.rest = np.cumsum(rest) - rest
        self.windows = int(self.full.sum()) // n
        self.starts = np.cumsum([0, *cuts(int(rest.sum()), n)])
        self.count = self.windows + len(self.starts) - 1

    def pieces(self, chain: int, at: int, size: int):
        """start, length, sequence and offset of each piece of a document."""
        start, full = 0, int(self.full[chain])
        while start < size:
            o = at + start
            if o < full:
                place = int(self.first[chain]) + o
                seq, offset, most = place // self.length, place % self.length, self.length - place % self.length
            else:
                place = int(self.rest[chain]) + o - full
                i = int(np.searchsorted(self.starts, place, "right")) - 1
                seq, offset, most = self.windows + i, place - int(self.starts[i]), int(self.starts[i + 1]) - place
            take = min(size - start, most)
            yield start, take, seq, offset
            start += take


def by_content(kept: DataFrame) -> DataFrame:
    """The encoded table sorted by leaf over the partitions; a hash deals the documents of a leaf that is split."""
    spark = kept.sparkSession
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    mixed = F.xxhash64("row")
    if rows <= SHARD_DOCS and size <= 2 * SHARD_TOKENS:
        return kept.coalesce(1).sortWithinPartitions("leaf", mixed, "row")
    # partitions of one shard each, with room for the uneven ends that a range partitioning gives them
    parts = max(-(-8 * rows // (7 * SHARD_DOCS)), -(-8 * size // (14 * SHARD_TOKENS)), spark.sparkContext.defaultParallelism)
    return kept.repartitionByRange(parts, "leaf", mixed).sortWithinPartitions("leaf", mixed, "row")


def shards(batches, kind: type):
    """Ids of the documents and their arrays, a shard at a time: runs of rows within the bounds."""
    names: list = []
    docs: list = []
    size = 0
    for b in batches:
        for i, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
            d = np.frombuffer(x.as_py(), kind)
            if docs and (size + len(d) > SHARD_TOKENS or len(docs) >= SHARD_DOCS):
                yield names, docs
                names, docs, size = [], [], 0
            names.append(i)
            docs.append(d)
            size += len(d)
    if docs:
        yield names, docs


def prepared(df: DataFrame, json_path: str, ranks_path: str, id_col: str, text_col: str):
    """The encoded table, and a broadcast of the weights of ids and the mean length."""
    spark = df.sparkSession
    leaves = fitted(df, json_path, ranks_path, id_col, text_col)
    sent = spark.sparkContext.broadcast(leaves) if leaves.centres.shape[1] else None
    kept = materialise(encoded(df, json_path, ranks_path, sent, id_col, text_col), "token-ids")
    seen, n_docs, n_tokens = frequencies(kept)
    kept = kept.where("leaf >= 0").drop("seen")
    idf = np.log1p((n_docs - seen + 0.5) / (seen + 0.5))
    return kept, spark.sparkContext.broadcast((idf, n_tokens / max(1, n_docs)))


def pack(df: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of sequences; see the module for how they are found."""
    kept, shared = prepared(df, json_path, ranks_path, id_col, text_col)
    kind = id_kind(json_path)

    def run(batches):
        _LOADED.clear()  # the encoder of the tasks before
        release()
        idf, mean = shared.value
        sequence = TaskContext.get().partitionId() << 40
        for names, docs in shards(batches, kind):
            plan = planned(docs, idf, mean, length)
            layout = Layout(plan)
            out: list[tuple] = []
            for r, (i, d) in enumerate(zip(names, docs, strict=True)):
                d = d.astype("<u4")
                for start, n, seq, offset in layout.pieces(int(plan.chain[r]), int(plan.at[r]), len(d)):
                    out.append((i, start, n, zlib.crc32(d[start : start + n].tobytes()), len(d), sequence + seq, offset))
                if len(out) > 8192:
                    yield batch(out)
                    out = []
            yield batch(out)
            sequence += layout.count

    return by_content(kept).select("doc_id", "ids").mapInArrow(tidy(run), PIECES)


def batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def recall(df: DataFrame, json_path: str, ranks_path: str, every: int = 50, k: int = FETCH, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """How the shards' retrieval compares with brute force over all documents, for the documents whose id is divisible by every: the share of the
    true k best that the own shard gives, and the share of their total score.  Each task scores the queries against its shards in
    blocks; the queries' ids are sent to all tasks, so their number should be bounded by every."""
    kept, shared = prepared(df, json_path, ranks_path, id_col, text_col)
    kind = id_kind(json_path)
    queries = sorted((r.doc_id, bytes(r.ids)) for r in kept.where(F.col("doc_id") % every == 0).select("doc_id", "ids").collect())
    sent = kept.sparkSession.sparkContext.broadcast([(i, np.unique(np.frombuffer(x, kind)).astype(np.int64)) for i, x in queries])

    def run(batches):
        idf, mean = shared.value
        for names, docs in shards(batches, kind):
            index, have = Index(docs, idf, mean), set(names)
            for first in range(0, len(sent.value), CHAINS):
                block = sent.value[first : first + CHAINS]
                out = [(q, q in have, names[d], v) for (q, _), (best, scores) in zip(block, index.search([t for _, t in block], k + 1), strict=True) for d, v in zip(best.tolist(), scores.tolist(), strict=True) if names[d] != q]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.float64()), strict=True)], ["q", "own", "d", "score"])

    found: dict[int, list] = {}
    for r in by_content(kept).select("doc_id", "ids").mapInArrow(tidy(run), "q long, own boolean, d long, score double").collect():
        found.setdefault(r.q, []).append((-r.score, r.d, r.own))
    hit = total = got = best = 0.0
    for rows in found.values():
        top = sorted(rows)[:k]
        hit, total = hit + sum(own for _, _, own in top), total + len(top)
        best, got = best - sum(x for x, _, _ in top), got - sum(x for x, _, _ in sorted(r for r in rows if r[2])[:k])
    return {"queries": len(found), "recall": hit / total if total else 1.0, "score": got / best if best else 1.0}
