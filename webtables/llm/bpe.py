"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm._tables import pieces, raw_texts

MAX_VOCABULARY = 4_000_000
MEMO = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement per bucket of about two keys.

    Buckets are placed from the largest down; a bucket of one key stores its slot itself as a negative number.
    The stored key of a slot is compared, so strings that are no key are told apart.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = len(ranks)
        if n > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {n} tokens is too large to send to every worker")
        self.buckets = max(1, n // 2)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.ranks = [0] * n
        members: list[list] = [[] for _ in range(self.buckets)]
        for key in ranks:
            bucket, a, b = self._parts(key)
            members[bucket].append((key, a, b))
        free = n
        for bucket in sorted(range(self.buckets), key=lambda x: -len(members[x])):
            group = members[bucket]
            if len(group) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(a, b, d) for _, a, b in group]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
                if d > 1 << 22:
                    raise ValueError("two keys share their hash")
            self.shift[bucket] = d
            for (key, _, _), slot in zip(group, slots, strict=True):
                self.keys[slot], self.ranks[slot] = key, ranks[key]
            free -= len(group)
        empty = iter([s for s in range(n) if self.keys[s] is None])
        for bucket, group in enumerate(members):
            if len(group) == 1:
                slot = next(empty)
                self.shift[bucket] = -1 - slot
                self.keys[slot], self.ranks[slot] = group[0][0], ranks[group[0][0]]

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 32 & 0xFFFFFFFFFFFF, h >> 80 | 1

    def _slot(self, a: int, b: int, d: int) -> int:
        return ((a ^ d * 0x9E3779B97F4A7C15) * b >> 24 & 0xFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        bucket, a, b = self._parts(key)
        d = self.shift[bucket]
        slot = -1 - d if d < 0 else self._slot(a, b, d)
        return self.ranks[slot] if self.keys[slot] == key else None


def merge_bytes(token: bytes, rank_of: Callable[[bytes], int | None]) -> list[int]:
    """Ranks of a pre-token that is no whole token: always the lowest-ranked pair next, the leftmost of equals.

    Parts are a doubly linked list over byte positions, candidate pairs a heap with stale entries skipped:
    n log n steps for n bytes. ``rank_of`` is the merge table.
    """
    n = len(token)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(token[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]  # the part after i begins where i ends; a part that was merged away ends at 0
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        before[stop] = i
        if stop < n and (r := rank_of(token[i : end[stop]])) is not None:
            heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := rank_of(token[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        rank = rank_of(token[i : end[i]])
        if rank is None:
            raise ValueError(f"no token for byte {token[i : end[i]]!r}")
        out.append(rank)
        i = end[i]
    return out


class Tokenizer:
    """Encoder and decoder of one vocabulary; small enough to be broadcast (its size is checked)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = PerfectHash(ranks)
        self.pattern = pattern
        self._encoder = None

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        return cls(read_ranks(path), pattern)

    def encoder(self) -> Callable[[str], list[int]]:
        """Text to ranks; one encoder per worker, so that its memo lasts from task to task."""
        if self._encoder:
            return self._encoder
        split, whole_token, merges = regex.compile(self.pattern).findall, self.table.get, self.merges().get

        class Memo(dict):
            """Pre-tokens met lately, in two generations of bounded size: what is met again moves to the new one."""

            older: dict = {}

            def __missing__(self, word: str) -> tuple[int, ...]:
                ids = self.older.get(word)
                if ids is None:
                    raw = word.encode()
                    whole = whole_token(raw)
                    ids = (whole,) if whole is not None else tuple(merge_bytes(raw, merges))
                    if len(raw) > 64:
                        return ids
                if len(self) >= MEMO:
                    self.older = dict(self)
                    self.clear()
                self[word] = ids
                return ids

        memo = Memo()
        self._encoder = lambda text: list(chain.from_iterable(map(memo.__getitem__, split(text))))
        return self._encoder

    def merges(self) -> dict[bytes, int]:
        """Merge table: what two neighbouring parts become, and its rank."""
        return dict(zip(self.table.keys, self.table.ranks, strict=True))

    def decoder(self) -> Callable[[list[int]], bytes]:
        tokens = dict(zip(self.table.ranks, self.table.keys, strict=True))
        return lambda ids: b"".join(map(tokens.__getitem__, ids))


def _shared(df: DataFrame, tokenizer: Tokenizer):
    return df.sparkSession.sparkContext.broadcast(tokenizer)


def _pattern_safe(pattern: str) -> None:
    if regex.compile(pattern).groups:
        raise ValueError("the splitting pattern must not have groups")


def encode(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null and empty texts give no ids. No shuffle."""
    _pattern_safe(tokenizer.pattern)
    shared = _shared(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value.encoder()
        for batch in pieces(batches, limit=1 << 20):
            ids = [ids_of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id and raw (binary) of the ids; null ids give no bytes."""
    shared = _shared(encoded, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value.decoder()
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                raw = [bytes_of(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded in one pass.

    Null and empty texts give no ids and the digests of nothing. Repeated rows come out as often as they come
    in; further columns are not read. A worker holds the ids of one document and a bounded memo at a time.
    """
    _pattern_safe(tokenizer.pattern)
    shared = _shared(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bytes_of = shared.value.encoder(), shared.value.decoder()
        digits = [str(i) for i in range(max(shared.value.table.ranks, default=-1) + 1)]
        for batch in pieces(batches):
            counts, ids_sha, raw_sha = [], [], []
            for raw in raw_texts(batch):
                ids = ids_of(raw.decode())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(bytes_of(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _doc_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
