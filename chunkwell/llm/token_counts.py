"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, with a fixed bound on its
entries.  Tier two is a cache in each Python worker that encodes what tier one misses.  No pre-token
is ever shuffled: counting is one narrow pass over the scan.

Tier one comes from a bounded number of rows (``sample_rows``) of bounded size.  It only decides which lookups are
fast; every length in it and every miss is computed by the same library, so no count depends on it.

Defined cases: null text counts as empty (0 tokens); null ids pass through; repeated rows give one
row each; only the two named columns are read, so extra columns never clash; an empty table gives no rows; a long text is counted
whole by one task.
"""

from __future__ import annotations

import collections
import os
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SAMPLE_ROWS, SAMPLE_BYTES, TIER_ENTRIES, CACHE_ENTRIES, KEY_BYTES = 512, 65_536, 65_536, 400_000, 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Below this every character is classed alike by all Unicode versions in use.
_LATE = re.compile("[԰-\U0010ffff]")
_LOADED: dict = {}


class Lengths(dict):
    """pre-token -> number of tokens.  Misses are encoded and kept until the cache is full."""

    def __init__(self, path: str, tier: dict[str, int]):
        super().__init__(tier)
        self.path, self.tier, self.encoder = path, tier, load(path)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoder.encode(piece, add_special_tokens=False))
        if len(piece) <= KEY_BYTES:
            if len(self) >= len(self.tier) + CACHE_ENTRIES:
                self.clear()
                self.update(self.tier)
            self[piece] = n
        return n


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def splitter(path: str):
    """The compiled pre-token pattern, and a pattern of special strings (None: there are none)."""
    import json

    import public_tokenizers
    import regex

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    return regex.compile(public_tokenizers.PATTERN), re.compile("|".join(map(re.escape, special))) if special else None


def unsure(text: str) -> bool:
    """Whether a character is unassigned here, and so may be classed otherwise by the library's tables."""
    return bool(_LATE.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


def count(text: str, pieces, special, lengths: Lengths) -> int:
    if unsure(text):
        return len(lengths.encoder.encode(text, add_special_tokens=False))
    if special is None or not special.search(text):
        return sum(map(lengths.__getitem__, pieces.findall(text)))
    parts = special.split(text)
    return len(parts) - 1 + sum(sum(map(lengths.__getitem__, pieces.findall(p))) for p in parts)


def frequent_lengths(df: DataFrame, text_col: str, path: str, sample_rows: int = SAMPLE_ROWS, entries: int = TIER_ENTRIES) -> dict[str, int]:
    """The lengths of the most frequent pre-tokens of a few rows of at most SAMPLE_BYTES each: at most ``entries``.  The rows come by
    the incremental limit, which reads as few partitions as it needs."""
    pieces, _ = splitter(path)
    seen: collections.Counter = collections.Counter()
    for r in df.select(F.col(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_rows).collect():
        seen.update(pieces.findall(r.text or ""))
    lengths = Lengths(path, {})
    return {k: lengths[k] for k, _ in seen.most_common(entries) if len(k) <= KEY_BYTES}


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    spark = df.sparkSession
    bounded_batches(spark)
    tier = spark.sparkContext.broadcast(frequent_lengths(df, text_col, tokenizer_path, sample_rows))

    def run(batches):
        pieces, special = splitter(tokenizer_path)
        key = ("lengths", tokenizer_path, tier.id if hasattr(tier, "id") else id(tier))
        if key not in _LOADED:
            for k in [k for k in _LOADED if isinstance(k, tuple)]:
                del _LOADED[k]
            _LOADED[key] = Lengths(tokenizer_path, tier.value)
        lengths = _LOADED[key]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count(t, pieces, special, lengths) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
