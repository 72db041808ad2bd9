"""Encoding of texts with a public byte-level byte-pair vocabulary, in two tiers.

Texts are split into pre-tokens.  Tier one resolves every pre-token that is itself a word of
the vocabulary through a minimal perfect hash: as many slots as words, one probe, and a
comparison with the word stored there.  Tier two merges the others with a heap over a linked
list of their bytes, which stays near-linear for a pre-token of any length.  The distinct
pre-tokens of a batch are resolved once, and a bounded number is kept for later batches.

Defined results
  * NULL and empty texts give an empty list of ids;
  * special tokens are ordinary text;
  * texts are processed whole, whatever their length;
  * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from massweave.plans.runtime import ship_package

#: Where the vocabulary files of the public tokenizers lie; a parameter of every entry point.
DEFAULT_FOLDER = os.environ.get("MASSWEAVE_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: white space as the pattern of the vocabulary knows it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Fixed value: the pattern that splits text before the merges, with its white space spelt out.
_SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

#: The same pattern on plain ASCII text, for the faster engine.
_SPLIT_ASCII = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


#: Vocabularies whose texts are split by this pattern.
VOCABULARIES = ("byte_bpe_50k", "byte_bpe_multi_50k")


def split_text(text: str) -> list[str]:
    """The pre-tokens of a text; joined they give the text again."""
    return _SPLIT_ASCII.findall(text) if text.isascii() else _SPLIT.findall(text)


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Keys fall into buckets; the largest buckets first get the smallest displacement that
    sends all their keys to free slots, and buckets of one key are given a free slot outright.
    There are exactly as many slots as keys.
    """

    #: Marks a displacement that is a slot.
    _OUTRIGHT = np.uint64(1 << 63)

    def __init__(self, keys: list[bytes], per_bucket: int = 4, most_tries: int = 1 << 20):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // per_bucket))
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slot_of = np.zeros(self.n, np.int64)
        if not keys:
            return
        h = self._hashes(keys)
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        free = np.ones(self.n, bool)
        for k in np.argsort(-sizes, kind="stable"):
            members = order[starts[k] : starts[k + 1]]
            if len(members) < 2:
                break
            for base in range(0, most_tries, 256):
                tries = np.arange(base, base + 256, dtype=np.uint64)
                slots = self._slot(h[members][:, None], tries[None, :])
                good = free[slots].all(axis=0)
                ordered = np.sort(slots, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                hit = int(np.argmax(good))
                if good[hit]:
                    break
            else:
                raise ValueError("keys of the perfect hash are not distinct")
            self.shift[k] = tries[hit]
            free[slots[:, hit]] = False
            self.slot_of[members] = slots[:, hit]
        alone = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)
        self.shift[alone] = left.astype(np.uint64) | self._OUTRIGHT
        self.slot_of[order[starts[alone]]] = left

    @staticmethod
    def _hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = h + (shift + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The only slot where each key can lie; the caller compares the key."""
        h = self._hashes(keys)
        shift = self.shift[self._bucket(h)]
        return np.where(shift & self._OUTRIGHT, (shift & ~self._OUTRIGHT).astype(np.int64), self._slot(h, shift))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: merge the adjacent pair of least rank, leftmost first, until none is left."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        # Stale unless i still heads a part and its right neighbour still ends at ``stop``.
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            rank = ranks.get(piece[i : end[nxt[j]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[nxt[j]]))
        if prev[i] >= 0:
            rank = ranks.get(piece[prev[i] : stop])
            if rank is not None:
                heapq.heappush(heap, (rank, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class BytePairVocabulary:
    """A rank file with its two tiers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(word): int(rank) for word, rank in pairs}
        words = list(self.ranks)
        self.memo: dict[str, list[int]] = {}
        self.hash = PerfectHash(words)
        self.words: list[bytes] = [b""] * len(words)
        self.ids = np.zeros(len(words), np.int32)
        for word, slot in zip(words, self.hash.slot_of.tolist()):
            self.words[slot] = word
            self.ids[slot] = self.ranks[word]

    def resolve(self, pieces: set[str]) -> dict[str, list[int]]:
        """Ids of pre-tokens, those of ``pieces`` at least; what is resolved is kept for later batches, up to a bound."""
        texts = [t for t in pieces if t not in self.memo]
        if not texts:
            return self.memo
        if len(self.memo) + len(texts) > MEMO_PIECES:
            texts = list(pieces)
            self.memo.clear()
        keys = [t.encode("utf-8", "surrogatepass") for t in texts]
        slots = self.hash.lookup(keys)
        for text, key, slot, one in zip(texts, keys, slots.tolist(), self.ids[slots].tolist()):
            self.memo[text] = [one] if self.words[slot] == key else merge_bytes(key, self.ranks)
        return self.memo


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BytePairVocabulary:
    """The vocabulary of a rank file, built once in each Python process."""
    return BytePairVocabulary(path)


def rank_file(name: str, folder: str | None = None) -> str:
    """Place of the rank file of a named byte-level vocabulary; ``ValueError`` for one that splits texts in another way."""
    if name not in VOCABULARIES:
        raise ValueError(f"{name!r} is none of {VOCABULARIES}")
    return os.path.join(folder or DEFAULT_FOLDER, f"{name}.tiktoken")


def _shipped(spark: SparkSession, name: str, folder: str | None) -> str:
    """Send the rank file to all workers, once a session, and give the name they find it under."""
    path, context = rank_file(name, folder), spark.sparkContext
    shipped = context.__dict__.setdefault("_massweave_files", {})
    base = os.path.basename(path)
    if shipped.setdefault(base, path) != path:
        raise ValueError(f"another {base} was sent before: {shipped[base]}")
    if path not in context.__dict__.setdefault("_massweave_sent", set()):
        context.addFile(path)
        context._massweave_sent.add(path)
    return base


#: Pre-tokens whose ids a Python process keeps.
MEMO_PIECES = 200_000

#: Characters of text whose pre-tokens are resolved together.
CHUNK_CHARS = 4_000_000


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t) > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def encode_batch(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text as ``int32`` arrays, in order."""
    vocab = vocabulary(path)
    for chunk in _chunks([t or "" for t in texts]):
        split = [split_text(t) for t in chunk]
        ids = vocab.resolve(set(chain.from_iterable(split)))
        for pieces in split:
            yield np.fromiter(chain.from_iterable(map(ids.__getitem__, pieces)), np.int32)


def count_batch(texts: list[str | None], path: str) -> Iterator[int]:
    """Number of ids of each text, in order."""
    vocab = vocabulary(path)
    for chunk in _chunks([t or "" for t in texts]):
        split = [split_text(t) for t in chunk]
        ids = vocab.resolve(set(chain.from_iterable(split)))
        for pieces in split:
            yield sum(map(len, map(ids.__getitem__, pieces)))


def encode(documents: DataFrame, identity: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(identity, ids)`` of each row; see the module for NULL and empty texts."""
    file = _shipped(documents.sparkSession, name, folder)
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(encode_batch(batch.column(1).to_pylist(), SparkFiles.get(file)))
            offsets = np.zeros(len(arrays) + 1, np.int32)
            np.cumsum([len(a) for a in arrays], out=offsets[1:])
            values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[identity, "ids"])

    kind = documents.schema[identity].dataType.simpleString()
    return documents.select(identity, text).mapInArrow(run, f"`{identity}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, text: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``documents`` with its text replaced by the number of its tokens, 0 for NULL and empty texts."""
    file = _shipped(documents.sparkSession, name, folder)
    ship_package(documents.sparkSession)
    rest = [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array(list(count_batch(batch.column(len(rest)).to_pylist(), SparkFiles.get(file))), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], sizes], names=[*rest, out])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return documents.select(*rest, text).mapInArrow(run, f"{kinds}, `{out}` bigint")
