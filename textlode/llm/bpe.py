"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

The corpus is taken in blocks (the Arrow batches of a partition). The words of
a block that its worker hasn't seen yet form one array of symbols; an inverted
index from each mergeable pair to the positions where it stands lets every
merge be applied in rank order to all words at once, touching only the
neighbours of the places where it applies. A word is thus replayed once per
worker and block run, however often it occurs, and a document is the
concatenation of its words. No step shuffles: neither text nor vocabulary ever
crosses the network, so a source or group that holds a third of the rows costs
no more than its share, and a lost executor repeats only its own blocks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter everywhere below.
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Words, and as many chunks, that a worker remembers between blocks. A bound on memory alone: others are replayed again.
MEMO_WORDS = 250_000
#: Words longer than this many bytes aren't remembered, so that the memory for words stays bounded too.
MEMO_BYTES = 64

# Fixed value: how byte-level BPE splits a text into words before merging.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and its byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in plain)
    return letters | {chr(256 + n): b for n, b in enumerate(others)}


class MergeTable:
    """The merges of a vocabulary: ``pairs`` maps a pair of ids, packed into one integer, to (rank, id)."""

    SHIFT = 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = [0] * 256
        for letter, b in _byte_letters().items():
            self.byte_ids[b] = vocab[letter]
        self.pairs: dict[int, int] = {}
        self.ids: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << self.SHIFT | vocab[b]] = rank
            self.ids.append(vocab[a + b])
        self.words = regex.compile(WORD_PATTERN)
        self.memo: dict[str, bytes] = {}
        self.chunk_memo: dict[str, bytes] = {}

    def replay(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian int32 bytes; all merges are applied to all words together."""
        pairs, shift, ids = self.pairs, self.SHIFT, self.ids
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sym: list[int] = []
        for b in raw:
            sym.extend(map(self.byte_ids.__getitem__, b))
            sym.append(-1)  # a wall that no pair crosses
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        index: dict[int, list[int]] = {}
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 <= b and (rank := pairs.get(a << shift | b)) is not None:
                index.setdefault(rank, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            merged = ids[rank]
            for p in sorted(index.pop(rank)):  # from the left, as places of one pair may overlap
                a = sym[p]
                if a < 0:
                    continue
                q = right[p]
                if q >= n or sym[q] < 0 or pairs.get(a << shift | sym[q]) != rank:
                    continue
                sym[p], sym[q] = merged, -2
                q = right[p] = right[q]
                if q < n:
                    left[q] = p
                    if sym[q] >= 0 and (r := pairs.get(merged << shift | sym[q])) is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(heap, r)
                        index[r].append(p)
                o = left[p]
                if o >= 0 and sym[o] >= 0 and (r := pairs.get(sym[o] << shift | merged)) is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(o)
        flat = np.array(sym, dtype=np.int32)
        flat = flat[flat != -2]
        walls = np.flatnonzero(flat == -1)
        out, at = [], 0
        body = flat.tobytes()
        for w in walls:
            out.append(body[4 * at : 4 * w])
            at = w + 1
        return out

    def _word_ids(self, words: set[str]) -> dict[str, bytes]:
        memo = self.memo
        new = sorted(words - memo.keys())
        out = dict(zip(new, self.replay(new), strict=True))
        if len(new) != len(words):
            out |= {w: memo[w] for w in words - out.keys()}
        memo.update((w, out[w]) for w in new if len(w) <= MEMO_BYTES)
        return out

    def encode_block(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes; empty for an empty and for a null text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if len(self.chunk_memo) > MEMO_WORDS:
            self.chunk_memo.clear()
        split = [chunks(t) if t else [] for t in texts]
        seen: set[str] = set()
        for c in split:
            seen.update(c)
        memo = self.chunk_memo
        new = {c: self.words.findall(c) for c in seen - memo.keys()}
        ids = self._word_ids({w for words in new.values() for w in words})
        block = {c: b"".join(map(ids.__getitem__, words)) for c, words in new.items()}
        if len(new) != len(seen):
            kept = {c: memo[c] for c in seen - new.keys()}
            memo.update((c, b) for c, b in block.items() if len(c) <= MEMO_BYTES)
            block |= kept
        else:
            memo.update((c, b) for c, b in block.items() if len(c) <= MEMO_BYTES)
        return [b"".join(map(block.__getitem__, c)) for c in split]


def chunks(text: str) -> list[str]:
    """``text`` cut before each blank that a character other than white space follows.

    No word of WORD_PATTERN reaches across such a place and no word left of it
    depends on what follows, so each chunk splits into words by itself.
    """
    parts = text.split(" ")
    if "" not in parts and not any(p[0].isspace() for p in parts[1:]):
        return [parts[0], *[" " + p for p in parts[1:]]]
    groups = [[parts[0]]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            groups.append(["", p])
        else:
            groups[-1].append(p)
    return [c for g in groups if (c := " ".join(g))]


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


#: Characters of text that a block holds at most, one text aside.
BLOCK_CHARS = 4_000_000


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode(df: DataFrame, key: str, text: str, out: str, path: str, count_only: bool) -> DataFrame:
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, `{out}` {'bigint' if count_only else 'array<int>'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                ids = table.encode_block(texts[a:b])
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                if count_only:
                    column = pa.array(sizes)
                else:
                    offsets = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                    column = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", vocabulary: str = f"{TOKENIZER_DIR}/{BYTE_BPE}") -> DataFrame:
    """(key, out): the token ids of each text, without special tokens.

    An empty and a null text give an empty list; a null key is kept; repeated
    rows stay repeated; further columns are left out, whatever their names. The
    vocabulary file must be readable at its path on every executor.
    """
    return _encode(df, key, text, out, vocabulary, False)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "n_tokens", vocabulary: str = f"{TOKENIZER_DIR}/{BYTE_BPE}") -> DataFrame:
    """(key, out): the number of tokens of each text, 0 for an empty and for a null one."""
    return _encode(df, key, text, out, vocabulary, True)
