"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, probed level by level.

The filter grows with the training texts. Its head, the highest counts within a fixed number of bits, is broadcast; every
segment keeps the levels below, and keys that the head does not settle are sent to their segment, once per chunk of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch, pieces, raw_texts

END = b"\n"  # no word holds a line break
START = np.uint64(0x9E3779B97F4A7C15)
FLUSH = 1_000_000
PROBES = 3
BITS_PER_ENTRY = 8
HEAD_BITS = 1 << 26
MAX_FREQUENT = 1 << 17
CHUNK_BYTES = 2 << 20
#: Training text per segment.
PART_BYTES = 1 << 25
#: Smallest count of each level, and the mean of the whole numbers of a level.
LEVELS = np.ceil(1.5 ** np.arange(100)).astype(np.int64)
MIDDLES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])
#: Weights of the unigrams among which the training texts choose, in tokens.
PRIORS = np.array([4.0, 32.0, 256.0, 2048.0, 16384.0, 131072.0])


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, an end after each text, and the number of tokens of each."""
    words = [[*t.lower().split(), END] for t in texts]
    sizes = np.array([len(w) for w in words])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for ws in words for w in ws], np.uint64), sizes


def pairs(unigrams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; the first of a text follows a start."""
    before = np.empty_like(unigrams)
    before[1:] = unigrams[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + unigrams)


def salted(unigrams: np.ndarray) -> np.ndarray:
    """Keys of the unigrams in the filter they share with the pairs."""
    return mix(unigrams ^ np.uint64(0xD6E8FEB86659FD93))


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1, 2, 3 for those, 4 for 4 and 5, 5 for 6 and 7 ..., half as much again per level."""
    return np.searchsorted(LEVELS, counts, side="right")


def count_of(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for none."""
    return MIDDLES[levels]


@dataclass
class LogBloom:
    """Level j of a key is set with the levels below it; a key is owned by one of ``parts`` equal segments."""

    parts: int
    part_bits: int
    bits: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, level: int, part_bits: int) -> list[np.ndarray]:
        seed = keys + np.uint64(level * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)
        a = mix(seed)
        b = mix(a ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        return [(a + np.uint64(i) * b >> np.uint64(11)) % np.uint64(part_bits) for i in range(PROBES)]

    @classmethod
    def segment(cls, keys: np.ndarray, counts: np.ndarray, part_bits: int) -> tuple[np.ndarray, int]:
        """Bits of one segment and the lowest level it holds.

        The smallest cut is taken that leaves ``BITS_PER_ENTRY`` bits to every entry; lower levels belong elsewhere.
        """
        levels, cut = level_of(counts), 1
        while len(keys) and levels[levels >= cut].sum() * BITS_PER_ENTRY > part_bits:
            cut += 1
        keys, levels = keys[levels >= cut], levels[levels >= cut]
        flags = np.zeros(part_bits, np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for place in cls.places(keys[levels >= level], level, part_bits):
                flags[place] = 1
        return np.packbits(flags, bitorder="little"), cut

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level each key is a member of, found by probing level after level."""
        out, at, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(at):
            level += 1
            own = keys[at]
            base = (own % np.uint64(self.parts)).astype(np.int64) * self.part_bits
            hit = np.ones(len(at), bool)
            for place in self.places(own, level, self.part_bits):
                bit = base + place.astype(np.int64)
                hit &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            at = at[hit]
            out[at] = level
            if level == len(MIDDLES) - 1:
                break
        return out


def _count(parts: int):
    """Sums of every key per task, as sorted arrays per part: one small row instead of one row per n-gram."""

    def flushed(kind: int, held: list[np.ndarray], part_of) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part = part_of(keys)
        order = np.argsort(part, kind="stable")
        ids, starts = np.unique(part[order], return_index=True)
        cut = [*starts.tolist(), len(order)]
        keys, counts = keys[order], counts[order].astype(np.uint32)
        for a in range(0, len(ids), 512):
            spans = list(zip(cut[a : a + 512], cut[a + 1 : a + 513], strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a : a + 512].astype(np.int32)), pa.array([kind] * len(spans), pa.int32()),
                 pa.array([keys[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([counts[x:y].tobytes() for x, y in spans], pa.binary())],
                ["part", "kind", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        n = 0
        for batch in pieces(batches):
            own, sizes = tokens(raw_texts(batch))
            held[0].append(own)
            held[1].append(pairs(own, sizes))
            n += len(own)
            if n >= FLUSH:
                yield from flushed(0, held[0], lambda k: salted(k) % np.uint64(parts))
                yield from flushed(1, held[1], lambda k: k % np.uint64(parts))
                held, n = [[], []], 0
        if n:
            yield from flushed(0, held[0], lambda k: salted(k) % np.uint64(parts))
            yield from flushed(1, held[1], lambda k: k % np.uint64(parts))

    return run


def _merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = np.frombuffer(b"".join(keys), np.uint64)
    c = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(c, starts)


def _built(head_bits: int, bits_per_entry: int):
    """One part: its unigrams with exact counts, its segment of the head, and of the levels below that cut."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        one, pair = ([i for i, k in enumerate(kind) if k == x] for x in (0, 1))
        uk, uc = _merged([keys[i] for i in one], [counts[i] for i in one])
        bk, bc = _merged([keys[i] for i in pair], [counts[i] for i in pair])
        every, all_counts = np.concatenate([salted(uk), bk]), np.concatenate([uc, bc])
        head, cut = LogBloom.segment(every, all_counts, head_bits)
        levels = level_of(all_counts)
        low = levels < cut
        tail, _ = LogBloom.segment(every[low], all_counts[low], max(64, -(-int(levels[low].sum()) * bits_per_entry // 8) * 8))
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "head": [head.tobytes()], "cut": pa.array([cut], pa.int32()),
            "tail": pa.array([tail.tobytes()], pa.binary()), "keys": [uk.tobytes()], "counts": [uc.tobytes()], "n_types": pa.array([len(uk)], pa.int64()),
            "n_tokens": pa.array([int(uc.sum())], pa.int64())})

    return run


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[c >= least].tobytes()], pa.binary()), pa.array([c[c >= least].tobytes()], pa.binary())], ["keys", "counts"])

    return run


def _octaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of unigrams per eighth of a doubling of their count."""
    sums = np.zeros(512, np.int64)
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            steps = np.floor(8 * np.log2(np.frombuffer(counts, np.int64))).astype(np.int64)
            sums += np.bincount(steps, minlength=512)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["step", "n"])


@dataclass
class Head:
    """What is broadcast, of fixed size: the head of the filter, its cut in each part, exact counts of frequent words, the totals."""

    filter: LogBloom
    cuts: np.ndarray
    frequent: np.ndarray
    frequent_counts: np.ndarray
    n: int
    v: int

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys that are frequent, -1 for others."""
        if not len(self.frequent):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        return np.where(self.frequent[at] == keys, self.frequent_counts[at], -1)

    def settled(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels, and whether they are final: at the cut of the key's part or above, or nothing lies below it."""
        levels, cut = self.filter.levels(keys), self.cuts[(keys % np.uint64(self.filter.parts)).astype(np.int64)]
        return levels, (levels >= cut) | (cut == 1)

    def log10_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))


class Chunk:
    """Words and pairs of some texts, each once, and what the head does not know of them."""

    def __init__(self, texts: list[bytes], head: Head):
        own, self.sizes = tokens(texts)
        self.words, self.word_at = np.unique(own, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pairs(own, self.sizes), return_inverse=True)
        self.exact = head.exact(self.words)
        self.word_levels, self.word_settled = head.settled(salted(self.words))
        self.pair_levels, known = head.settled(self.pairs)
        parts = np.uint64(head.filter.parts)
        self.asked = []  # of words, of pairs: places by part, and the part of each
        for places, part in ((np.flatnonzero(~self.word_settled | (self.exact < 0)), salted(self.words) % parts), (np.flatnonzero(~known), self.pairs % parts)):
            part = part[places].astype(np.int64)
            order = np.argsort(part, kind="stable")
            self.asked.append((places[order], part[order]))

    def requests(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Part, words and pairs to ask it for."""
        (words, wp), (joint, jp) = self.asked
        for part in np.union1d(wp, jp).tolist():
            yield part, *(k[a[slice(*np.searchsorted(p, [part, part + 1]))]].tobytes() for k, a, p in ((self.words, words, wp), (self.pairs, joint, jp)))

    def answered(self, counts: bytes, levels: bytes, pair_levels: bytes) -> None:
        """Takes the answers of all parts in their order."""
        (words, _), (joint, _) = self.asked
        self.exact[words] = np.frombuffer(counts, np.int64)
        fresh = np.frombuffer(levels, np.uint8)
        self.word_levels[words] = np.where(self.word_settled[words], self.word_levels[words], fresh)
        self.pair_levels[joint] = np.frombuffer(pair_levels, np.uint8)

    def log10_smoothed(self, head: Head, texts: int, left_out: np.ndarray) -> Iterator[np.ndarray]:
        """For each prior log10 of (pair count + prior x unigram probability) / (count of the word before + prior).

        Counts are quantised. A pair is never taken to be more frequent than either word. ``left_out``: 1 for
        tokens that were learned from and are to be judged as if they had not been.
        """
        word = count_of(self.word_levels)[self.word_at]
        before = np.empty(len(word))
        before[1:] = word[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = texts
        together = np.minimum(count_of(self.pair_levels)[self.pair_at], np.minimum(before, word))
        together, before, word = (np.maximum(x - left_out, 0) for x in (together, before, word))
        unigram = (word + 0.5) / (head.n + 0.5 * (head.v + 1))
        for prior in PRIORS:
            yield np.log10((together + prior * unigram) / (before + prior))


def train(docs: DataFrame, scratch: Scratch, head_bits: int = HEAD_BITS, max_frequent: int = MAX_FREQUENT, part_bytes: int = PART_BYTES,
          bits_per_entry: int = BITS_PER_ENTRY) -> tuple[Head, DataFrame, int]:
    """The head of the model learned from all texts of ``docs``, the table of all segments and the number of texts."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = max((size["b"] or 0) // part_bytes, 16)
    own_bits = max(head_bits // parts // 8 * 8, 64)
    counted = docs.select("text").mapInArrow(_count(parts), "part int, kind int, keys binary, counts binary")
    built = scratch.keep("counts", counted.groupBy("part").applyInArrow(
        _built(own_bits, bits_per_entry), "part int, head binary, cut int, tail binary, keys binary, counts binary, n_types long, n_tokens long"))
    bits, cuts = np.zeros(parts * own_bits // 8, np.uint8), np.ones(parts, np.int64)
    n = v = 0
    for row in built.select("part", "head", "cut", "n_types", "n_tokens").toLocalIterator():  # one head in all, of fixed size
        bits[row["part"] * own_bits // 8 : (row["part"] + 1) * own_bits // 8] = np.frombuffer(row["head"], np.uint8)
        n, v, cuts[row["part"]] = n + row["n_tokens"], v + row["n_types"], row["cut"]
    steps = built.select("counts").mapInArrow(_octaves, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    held, step = 0, 512
    for row in steps:
        held += row["n"]
        if held > max_frequent:
            break
        step = row["step"]
    least = int(np.ceil(2 ** (step / 8))) if step < 512 else 1 << 62
    hot = built.select("keys", "counts").mapInArrow(_frequent(least), "keys binary, counts binary").collect()
    keys = np.frombuffer(b"".join(bytes(r["keys"]) for r in hot), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in hot), np.int64)
    order = np.argsort(keys)
    return Head(LogBloom(parts, own_bits, bits), cuts, keys[order], counts[order], n, v), built, size["n"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of about ``CHUNK_BYTES`` of text in one row."""
    for batch in pieces(batches, limit=CHUNK_BYTES):
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("doc_id", pa.int64()), ("held_out", pa.bool_()))]
            + [pa.array([raw_texts(batch)], pa.list_(pa.binary()))], ["ids", "held", "texts"])


def _ask(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                rows = list(Chunk(texts.as_py(), shared.value).requests())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary())))],
                    ["chunk", "part", "words", "pairs"])

    return run


def _answer(asked: pa.Table, segments: pa.Table) -> pa.Table:
    """Exact counts of the words, levels of words and pairs, for every request to one part."""
    keys, counts, tail = np.empty(0, np.uint64), np.empty(0, np.int64), None
    if segments.num_rows:
        keys, counts = (np.frombuffer(segments.column(c)[0].as_py(), kind) for c, kind in (("keys", np.uint64), ("counts", np.int64)))
        bits = np.frombuffer(segments.column("tail")[0].as_py(), np.uint8)
        tail = LogBloom(1, 8 * len(bits), bits)
    levels = lambda k: tail.levels(k) if tail else np.zeros(len(k), np.int64)
    out: list[list] = [[], [], []]
    for words, joint in zip(asked.column("words").to_pylist(), asked.column("pairs").to_pylist(), strict=True):
        words, joint = np.frombuffer(words, np.uint64), np.frombuffer(joint, np.uint64)
        found = np.zeros(len(words), np.int64)
        if len(keys) and len(words):
            at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
            found = np.where(keys[at] == words, counts[at], 0)
        for column, value in zip(out, (found, levels(salted(words)).astype(np.uint8), levels(joint).astype(np.uint8)), strict=True):
            column.append(value.tobytes())
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), **{c: pa.array(x, pa.binary()) for c, x in zip(("counts", "levels", "pair_levels"), out, strict=True)}})


def _score(shared, texts: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        head: Head = shared.value
        chunk = Chunk(rows.column("texts")[0].as_py(), head)
        answers = answers.sort_by("part")
        chunk.answered(*(b"".join(answers.column(c).to_pylist()) for c in ("counts", "levels", "pair_levels")))
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        held = np.array(rows.column("held")[0].as_py(), bool)
        by_prior = lambda out: np.stack([np.add.reduceat(x, starts) for x in chunk.log10_smoothed(head, texts, out)], 1)
        score, unseen = by_prior(0.0), by_prior(np.repeat(~held, chunk.sizes).astype(float)) * ~held[:, None]
        base = head.log10_unigram(chunk.exact)[chunk.word_at]
        return pa.table({
            "doc_id": pa.array(rows.column("ids")[0].as_py(), pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(chunk.sizes.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((chunk.exact > 0)[chunk.word_at].astype(np.int64), starts)), "base": pa.array(np.add.reduceat(base, starts)),
            "scores": pa.array(list(score), pa.list_(pa.float64())), "unseen": pa.array(list(unseen), pa.list_(pa.float64()))})

    return run


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, **limits: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Tokens are the lower-cased (A-Z) words and one end per text. The model learns from the documents whose
    crc32 of the doc_id as text leaves another remainder by ``folds`` than ``held_fold``. base_score is the
    add-half unigram log10 probability from exact counts; score is the log10 probability under pair counts
    smoothed towards the unigrams, all read from one log-frequency Bloom filter by repeated membership probes.
    The weight of the unigrams is the one of ``PRIORS`` that gives all training texts, each token left out of its
    own counts, the highest probability.

    Null and empty texts are one end token. A null doc_id counts as the empty string. Repeated rows are learned
    and returned as often as they come; an empty table gives an empty result; further columns are not read.

    Counting sums per task before the shuffle, so a word or pair that holds a third of all tokens is one number
    per task. Words are known by 64-bit hashes. The filter has ``bits_per_entry`` bits for every level of every word and
    pair, in one segment per ``part_bytes`` of training text. Broadcast are ``head_bits`` bits of it, of the highest counts, and exact
    counts of at most ``max_frequent`` words (``limits`` of ``train``). A chunk of texts asks the segments, through a shuffle and once
    for each word and pair, what the head leaves open.
    """
    scratch = Scratch(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold == held_fold).alias("held_out"))
    head, segments, texts = train(docs.filter("NOT held_out"), scratch, **limits)
    shared = docs.sparkSession.sparkContext.broadcast(head)
    chunks = docs.mapInArrow(_chunks, "ids array<long>, held array<boolean>, texts array<binary>")
    chunks = scratch.keep("chunks", chunks.select(F.monotonically_increasing_id().alias("chunk"), "*"))
    asked = chunks.select("chunk", "texts").mapInArrow(_ask(shared), "chunk long, part int, words binary, pairs binary")
    answers = scratch.keep("answers", asked.groupBy("part").cogroup(segments.select("part", "tail", "keys", "counts").groupBy("part")).applyInArrow(
        _answer, "chunk long, part int, counts binary, levels binary, pair_levels binary"))
    scored = scratch.keep("scored", chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(shared, texts), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, scores array<double>, unseen array<double>"))
    scratch.drop("chunks", "answers", "counts")
    shared.unpersist()
    fit = scored.agg(*[F.sum(F.col("unseen")[i]).alias(f"p{i}") for i in range(len(PRIORS))]).first()
    best = max(range(len(PRIORS)), key=lambda i: fit[i] or 0.0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(head.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("scores")[best].alias("score"))
