"""Substring dedup: suffixes dealt by variable-length prefixes to memory-sized groups, one subtree per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch, pieces, raw_texts

BLOCKS = 5  # a window is five blocks of words, the letters of the trees
CHUNK = 1 << 20
GROUP_ROWS = 1 << 21
NO_ID = (1 << 63) - 1
DOC = np.dtype([("did", "<i8"), ("th", "<i8")])
SPOT = np.dtype([("doc", "<u4"), ("at", "<u4")])
ANCHOR = np.dtype([("key", "<u8"), ("doc", "<u4")])
SUFFIX = np.dtype([("head", "<u8"), ("rest", "<u8"), ("doc", "<u4"), ("at", "<u4")])
PART_ROWS = "part int, chunk long, docs binary, rows binary"


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words:
    """The words of some texts in one row of hashes, their blocks, and the windows inside a text."""

    def __init__(self, texts: list[bytes], window: int):
        words = [t.split() for t in texts]  # on bytes: \x09-\x0D and the space part words
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for ws in words for w in ws], np.uint64)
        sizes = np.array([len(w) for w in words], np.int64)
        self.block = window // BLOCKS
        self.n, self.window = len(hashes), window
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.at = np.arange(self.n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.whole = np.arange(self.n) + window <= ends  # windows that end inside their text
        padded = np.concatenate([hashes, np.zeros(window, np.uint64)])
        letters = np.zeros(self.n + window - self.block, np.uint64)
        for j in range(self.block):
            letters = letters * np.uint64(0x9FB21C651E98DF25) + padded[j : j + len(letters)]
        self.letters = mix(letters)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of two blocks at every place, and the smallest of them inside each window."""
        span = self.window - 2 * self.block + 1
        length = self.n + span - 1
        keys = mix(self.letters[:length] * np.uint64(0xC2B2AE3D27D4EB4F) + self.letters[self.block : self.block + length])
        least = keys[: self.n].copy()
        for j in range(1, span):
            np.minimum(least, keys[j : j + self.n], out=least)
        return keys[: self.n], least

    def anchors(self) -> np.ndarray:
        """Places whose key is the smallest of some whole window: about two per span of windows.

        The choice depends on the words of the window alone, so equal windows have their anchor at one offset.
        """
        keys, least = self.grams()
        span = self.window - 2 * self.block + 1
        shown = np.where(self.whole, least, np.uint64(0))
        top = shown.copy()
        for j in range(1, span):
            np.maximum(top[j:], shown[:-j], out=top[j:])
        return np.flatnonzero(top == keys)

    def suffixes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """head (32 bits each of the first and second block) and rest (64 bits of the others) of each suffix."""
        low = np.uint64(0xFFFFFFFF)
        head = self.letters[places] << np.uint64(32) | self.letters[places + self.block] & low
        rest = np.zeros(len(places), np.uint64)
        for j in range(2, BLOCKS):
            rest = mix(rest * np.uint64(0x9FB21C651E98DF25) + self.letters[places + j * self.block])
        return head, rest


class Prefixes:
    """Which prefix length a suffix is grouped by: the shortest whose bin fits in memory.

    Lengths are one block, two blocks and the whole window; a bin is one of ``parts`` per length. ``full`` are
    the bins, by length, that hold too many suffixes. The choice depends on the words alone.
    """

    def __init__(self, parts: int, full: set[int] = frozenset()):
        self.parts = parts
        self.full = np.zeros(2 * parts, bool)
        self.full[list(full)] = True

    def bins(self, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.uint64(self.parts)
        return (mix(head >> np.uint64(32)) % n).astype(np.int64), (mix(head) % n).astype(np.int64) + self.parts

    def part(self, head: np.ndarray, rest: np.ndarray) -> np.ndarray:
        one, two = self.bins(head)
        whole = (mix(head ^ mix(rest)) % np.uint64(self.parts)).astype(np.int64) + 2 * self.parts
        return np.where(~self.full[one], one, np.where(~self.full[two], two, whole)).astype(np.int32)


def _chunk_id(counter: int) -> int:
    return TaskContext.get().partitionId() << 32 | counter


def _dealt(part: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    ids, starts = np.unique(part[order], return_index=True)
    for p, a, b in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        yield p, rows[order[a:b]]


def _batches(rows: list[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        part, chunk, docs, blobs = zip(*rows[i : i + 64], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.array(docs, pa.binary()), pa.array(blobs, pa.binary())],
            ["part", "chunk", "docs", "rows"])


def _doc_table(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, DOC)
    out["did"], out["th"] = batch.column("did").to_numpy(), batch.column("th").to_numpy()
    return out


def _anchor_rows(window: int, parts: int):
    """Anchors dealt by key; per chunk its documents (part -1) and the sizes of all prefix bins (part -2)."""

    def flushed(counter, docs, held, sizes) -> Iterator[pa.RecordBatch]:
        chunk, rows = _chunk_id(counter), np.concatenate(held)
        out = [(p, chunk, b"", r.tobytes()) for p, r in _dealt((rows["key"] % np.uint64(parts)).astype(np.int32), rows)]
        yield from _batches([*out, (-1 - chunk % parts, chunk, np.concatenate(docs).tobytes(), sizes.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, counter = Prefixes(parts), 0
        docs, held, n, first, sizes = [], [], 0, 0, np.zeros(2 * parts, np.int64)
        for batch in pieces(batches):
            words = Words(raw_texts(batch), window)
            keys, _ = words.grams()
            places = words.anchors()
            rows = np.empty(len(places), ANCHOR)
            rows["key"], rows["doc"] = keys[places], words.doc[places] + first
            head, _ = words.suffixes(np.flatnonzero(words.whole))
            for b in prefixes.bins(head):
                sizes += np.bincount(b, minlength=2 * parts)
            docs.append(_doc_table(batch))
            held.append(rows)
            first, n = first + batch.num_rows, n + len(rows)
            if n >= CHUNK:
                yield from flushed(counter, docs, held, sizes)
                counter, docs, held, n, first, sizes = counter + 1, [], [], 0, 0, np.zeros(2 * parts, np.int64)
        if docs:
            yield from flushed(counter, docs, held, sizes)

    return run


def _columns(table: pa.Table) -> list[tuple[int, int, bytes, bytes]]:
    return list(zip(*[table.column(c).to_pylist() for c in ("part", "chunk", "docs", "rows")], strict=True))


def _table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    part, chunk, docs, blobs = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"part": pa.array(part, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "docs": pa.array(docs, pa.binary()), "rows": pa.array(blobs, pa.binary())})


def _together(rows: list[tuple], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a group and the number of the row each comes from."""
    found = [np.frombuffer(r[3], kind) for r in rows]
    return np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """The anchors of a part that occur twice or more, given back to their chunks."""
    rows = _columns(table)
    if rows[0][0] < 0:
        return _table(rows)
    found, source = _together(rows, ANCHOR)
    order = np.argsort(found["key"], kind="stable")
    run = np.cumsum(_starts(found["key"][order])) - 1
    twice = order[np.bincount(run)[run] > 1]
    return _table([(p, rows[s][1], b"", r.tobytes()) for p, (s, r) in ((rows[0][0], x) for x in _dealt(source[twice], found[twice]))])


def _anchors_of_documents(table: pa.Table) -> pa.Table:
    """A chunk put together again: a row per document that has repeated anchors, and the chunk's bin sizes."""
    rows = _columns(table)
    (_, _, docs, sizes), = [r for r in rows if r[0] < 0]
    docs = np.frombuffer(docs, DOC)
    found = [r for r in rows if r[0] >= 0]
    out = []
    if found:
        found, _ = _together(found, ANCHOR)
        out = [(docs[d]["did"].item(), docs[d]["th"].item(), np.unique(r["key"]).tobytes()) for d, r in _dealt(found["doc"], found)]
    out.append((None, None, sizes))
    return pa.table(dict(zip(("did", "th", "rows"), (pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)), strict=True)))


def _suffix_rows(window: int, prefixes: Prefixes):
    """Suffixes of the windows whose anchor is repeated, dealt by prefix.

    Of equal windows in a chunk only the first goes on: the others begin later than it, which already decides
    them, and a passage that a third of all documents share is one row per chunk. Rows come in the order of
    their keys, so a task that runs again forms the same chunks.
    """

    def flushed(counter, docs, held) -> Iterator[pa.RecordBatch]:
        chunk, docs, rows = _chunk_id(counter), np.concatenate(docs), np.concatenate(held)
        order = np.lexsort((np.arange(len(rows)), rows["rest"], rows["head"]))
        rows = rows[order]
        new = _starts(rows["head"], rows["rest"])
        first = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = (docs["did"][rows["doc"]] != docs["did"][first["doc"]]) | (docs["th"][rows["doc"]] != docs["th"][first["doc"]]) | (rows["at"] != first["at"])
        spots = np.empty(int(later.sum()), SPOT)
        spots["doc"], spots["at"] = rows["doc"][later], rows["at"][later]
        kept = rows[new]
        out = []
        for p, r in _dealt(prefixes.part(kept["head"], kept["rest"]), kept):
            out.append((p, chunk, docs[np.unique(r["doc"])].tobytes(), r.tobytes()))
        yield from _batches([*out, (-1 - chunk % prefixes.parts, chunk, docs.tobytes(), spots.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, n, first, counter = [], [], 0, 0, 0
        for batch in pieces(batches):
            words = Words(raw_texts(batch), window)
            known = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in batch.column("rows").to_pylist()]))
            _, least = words.grams()
            at = np.minimum(np.searchsorted(known, least), len(known) - 1)
            places = np.flatnonzero(words.whole & (known[at] == least))
            rows = np.empty(len(places), SUFFIX)
            rows["head"], rows["rest"] = words.suffixes(places)
            rows["doc"], rows["at"] = words.doc[places] + first, words.at[places]
            docs.append(_doc_table(batch))
            held.append(rows)
            first, n = first + batch.num_rows, n + len(rows)
            if n >= CHUNK:
                yield from flushed(counter, docs, held)
                docs, held, n, first, counter = [], [], 0, 0, counter + 1
        if docs:
            yield from flushed(counter, docs, held)

    return run


def _subtree(table: pa.Table) -> pa.Table:
    """The leaves below the deep nodes of one subtree that begin later than another leaf of their node.

    Suffixes in order of their blocks are the leaves from left to right; a run that agrees on all blocks hangs
    below one internal node as deep as the window. Its first start stays.
    """
    rows = _columns(table)
    if rows[0][0] < 0:
        return _table(rows)
    found, source = _together(rows, SUFFIX)
    did, th = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
    for s, row in enumerate(rows):
        own, docs = slice(*np.searchsorted(source, [s, s + 1])), np.frombuffer(row[2], DOC)
        which = np.unique(found["doc"][own], return_inverse=True)[1]
        did[own], th[own] = docs["did"][which], docs["th"][which]
    order = np.lexsort((found["at"], th, did, found["rest"], found["head"]))
    found, source, did, th = found[order], source[order], did[order], th[order]
    new = _starts(found["head"], found["rest"])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else order
    later = (did != did[first]) | (th != th[first]) | (found["at"] != found["at"][first])
    spots = np.empty(int(later.sum()), SPOT)
    spots["doc"], spots["at"] = found["doc"][later], found["at"][later]
    return _table([(rows[0][0], rows[s][1], b"", r.tobytes()) for s, r in _dealt(source[later], spots)])


def _starts_of_documents(table: pa.Table) -> pa.Table:
    """A chunk put together again: per document the window starts to remove."""
    rows = _columns(table)
    docs = np.frombuffer(next(r[2] for r in rows if r[0] < 0), DOC)
    found, _ = _together(rows, SPOT)
    out = [(docs[d]["did"].item(), docs[d]["th"].item(), np.sort(r["at"]).tobytes()) for d, r in _dealt(found["doc"], found)]
    did, th, starts = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"did": pa.array(did, pa.int64()), "th": pa.array(th, pa.int64()), "starts": pa.array(starts, pa.binary())})


def _bin_sums(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for sizes in batch.column("rows").to_pylist():
                total += np.frombuffer(sizes, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    return run


def repeat_starts(docs: DataFrame, scratch: Scratch, window: int = 20, part_bytes: int = 1 << 23, group_rows: int = GROUP_ROWS) -> DataFrame:
    """did, th, starts: per text (doc_id, or the largest long for none, and text hash) the starts of the windows
    whose words also start earlier, as sorted 32-bit numbers. Runs of starts are the maximal repeats."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(max(size // part_bytes, 8), 1 << 16))
    anchors = docs.mapInArrow(_anchor_rows(window, parts), PART_ROWS)
    repeated = scratch.keep("anchors", anchors.groupBy("part").applyInArrow(_repeated_anchors, PART_ROWS).groupBy("chunk").applyInArrow(
        _anchors_of_documents, "did long, th long, rows binary"))
    sums = repeated.filter("did IS NULL").select("rows").mapInArrow(_bin_sums(2 * parts), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    full = {r["bin"] for r in sums.filter(F.col("n") > group_rows).select("bin").collect()}
    known = repeated.filter("did IS NOT NULL").groupBy(F.col("did").alias("d"), F.col("th").alias("t")).agg(F.first("rows").alias("rows"))
    joined = docs.join(known.hint("merge"), (docs["did"] == known["d"]) & (docs["th"] == known["t"])).select("did", "th", "text", "rows")
    suffixes = joined.mapInArrow(_suffix_rows(window, Prefixes(parts, full)), PART_ROWS)
    found = suffixes.groupBy("part").applyInArrow(_subtree, PART_ROWS).groupBy("chunk").applyInArrow(
        _starts_of_documents, "did long, th long, starts binary")
    return scratch.keep("starts", found.groupBy("did", "th").agg(
        F.max(F.struct(F.octet_length("starts"), F.col("starts").alias("starts")))["starts"].alias("starts")))


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, gone, texts = [], [], []
            for text, starts in zip(raw_texts(batch), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                sizes.append(len(words))
                removed = np.zeros(len(words) + 1, np.int32)
                if starts:
                    at = np.frombuffer(starts, np.uint32)
                    np.add.at(removed, at, 1)
                    np.add.at(removed, at + window, -1)
                    removed = np.cumsum(removed) > 0
                    words = [w for w, r in zip(words, removed.tolist(), strict=False) if not r]
                gone.append(sizes[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, part_bytes: int = 1 << 23, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every text.

    A window is ``window`` (a multiple of five) consecutive words of one text, unchanged. Every word covered by a
    window whose words also start earlier (smaller doc_id, or the same text further left) goes; windows are
    judged on the input. Null and empty texts have no words. Texts shorter than a window stay. Rows that repeat
    a doc_id and a text are one document stored more than once: they do not repeat each other. Of several texts
    with one doc_id the order is that of their hashes; a null doc_id comes last. An empty table gives an empty
    result; further columns are not read.

    First, places that equal windows choose alike (the smallest two-block key of a window) are counted: a window
    whose own place is unique cannot repeat, so only the others become suffixes. These are dealt by the shortest
    prefix whose bin fits in memory; hot windows are one row per chunk. Words and windows are compared by hashes
    of 64 and 128 bits. Nothing that grows with the input is broadcast or sent to the driver.
    """
    if window % BLOCKS:
        raise ValueError("a window is a multiple of five words")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")
    starts = repeat_starts(docs.drop("doc_id"), scratch, window, part_bytes, group_rows).select(
        F.col("did").alias("d"), F.col("th").alias("t"), "starts")
    joined = docs.join(starts, (docs["did"] == starts["d"]) & (docs["th"] == starts["t"]), "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")
