"""SimHash near-dedup: tiles of fingerprints compared exactly with numpy exclusive-or and bit counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch, pieces, raw_texts
from webtables.llm.components import components
from webtables.llm.metric_join import Similarity, group_rows, keyed, metric_labels, texts_of, who
from webtables.llm.ngram_lm import mix

BITS = 64
BLOCK = 512
SEED = 42
THIRD = np.uint64(0x5851F42D4C957F2D)
#: Bits of 192 in which texts of a Jaccard similarity of 0.8 differ at most: 27 on average, with a deviation of 5. Unrelated texts
#: differ in 54 or fewer with a chance of 1e-9, so proposals do not chain them.
ALL = 54


def fingerprint(text: bytes, width: int, seed: int = SEED) -> int:
    """SimHash of one lower-cased text: bits set in over half of its shingles' hashes; no word gives zero."""
    words = text.lower().split()  # on bytes: A-Z lowered, split at \\x09-\\x0D and the space
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -width].tolist()]
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and f (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t, width) for t in raw_texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, f long")


class Tile:
    """Fingerprints sorted by the bit counts of their quarters, with the count ranges of every block of rows."""

    def __init__(self, values: np.ndarray):
        quarters = np.stack([np.bitwise_count(values >> np.uint64(s) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], 1).astype(np.int16)
        order = np.lexsort((values, *quarters.T[::-1]))
        self.order, self.values, quarters = order, values[order], quarters[order]
        self.starts = np.arange(0, len(values), BLOCK)
        self.low = np.minimum.reduceat(quarters, self.starts, axis=0)
        self.high = np.maximum.reduceat(quarters, self.starts, axis=0)

    def near_blocks(self, other: Tile, block: int, radius: int) -> np.ndarray:
        """Blocks of ``other`` whose quarter counts may differ by ``radius`` in all from those of ``block``."""
        gap = np.maximum(0, np.maximum(self.low[block] - other.high, other.low - self.high[block])).sum(axis=1)
        return np.flatnonzero(gap <= radius)


class Forest:
    """Union-find over small integers, whole arrays of links at a time; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        up = self.up
        while len(p):
            a, b = p, q
            while not (np.array_equal(a, c := up[a]) and np.array_equal(b, d := up[b])):
                a, b = c, up[b]
            apart = a != b
            p, q, high, low = p[apart], q[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            if len(p):
                roots, first = np.unique(high, return_index=True)
                up[roots] = low[first]  # every root hooks to one smaller root
                self.kept.append((p[first], q[first]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*self.kept, strict=True)) if self.kept else (np.empty(0, np.int64),) * 2


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, bits: a spanning forest of the links within ``radius`` inside ``a`` (``b`` None) or between ``a`` and ``b``.

    Every pair of blocks that the bit counts cannot tell apart is compared in full.
    """
    left = Tile(a)
    right = left if b is None else Tile(b)
    shift = 0 if b is None else len(a)
    both = a if b is None else np.concatenate([a, b])
    forest = Forest(len(both))
    for i, at in enumerate(left.starts):
        x = left.values[at : at + BLOCK, None]
        for j in left.near_blocks(right, i, radius):
            if b is None and j < i:
                continue
            to = right.starts[j]
            bits = np.bitwise_count(x ^ right.values[None, to : to + BLOCK])
            if b is None and i == j:
                np.fill_diagonal(bits, 255)
            p, q = np.nonzero(bits <= radius)
            if len(p):
                forest.join(left.order[at : at + BLOCK][p], right.order[to : to + BLOCK][q] + shift)
    u, v = forest.links()
    return both[u], both[v], np.bitwise_count(both[u] ^ both[v])


def proposals(nodes: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray | None, radius: int, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places u, v of a spanning forest of the links proposed inside ``first`` (``second`` None) or between ``first`` and ``second``.

    A link is proposed where the prints p differ in ``radius`` bits at most, all three prints in ``most``, and the
    sizes n allow the similarity. Sorted by size, a block meets only what its sizes allow.
    """
    p, q, r, n = (nodes[k] for k in "pqrn")
    left = first[np.argsort(n[first], kind="stable")]
    right = left if second is None else second[np.argsort(n[second], kind="stable")]
    sizes, forest = n[right], Forest(len(n))
    for at in range(0, len(left), BLOCK):
        rows = left[at : at + BLOCK]
        low = np.searchsorted(sizes, n[rows[0]] * similarity - 1e-6)
        high = np.searchsorted(sizes, n[rows[-1]] / similarity + 1e-6, "right")
        for to in range(max(low, at) if second is None else low, high, BLOCK):
            cols = right[to : min(to + BLOCK, high)]
            x, y = np.nonzero(np.bitwise_count(p[rows][:, None] ^ p[cols][None]) <= radius)
            if second is None:
                x, y = x[at + x < to + y], y[at + x < to + y]
            i, j = rows[x], cols[y]
            bits = sum(np.bitwise_count(k[i] ^ k[j]).astype(np.int16) for k in (p, q, r))
            good = (bits <= most) & (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity - 1e-6)
            forest.join(i[good], j[good])
    return forest.links()


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Places of the first and the second tile's rows; no second for a tile with itself."""
    first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
    same = table.column("t1")[0].as_py() == table.column("t2")[0].as_py()
    return np.flatnonzero(first), None if same else np.flatnonzero(~first)


def _pair_links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        values = table.column("f").to_numpy().view(np.uint64)
        a, b = _sides(table)
        u, v, _ = links(values[a], None if b is None else values[b], radius) if len(a) and (b is None or len(b)) else (np.empty(0, np.uint64),) * 3
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def _pair_proposals(radius: int, most: int, similarity: float):
    def run(table: pa.Table) -> pa.Table:
        nodes = {k: table.column(k).to_numpy() for k in "fpqrn"}
        nodes |= {k: nodes[k].view(np.uint64) for k in "pqr"}
        u, v = proposals(nodes, *_sides(table), radius, most, similarity)
        return pa.table({"u": nodes["f"][u], "v": nodes["f"][v]})

    return run


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    parts = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in parts], np.uint64))


def _text_key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def wide_prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th, f (hash of the lower-cased words), n (distinct shingles) and three SimHashes p, q, r of the distinct shingles."""

    def bits(hashes: np.ndarray) -> int:
        counts = np.zeros(BITS, np.int64)
        for i in range(0, len(hashes), 1 << 14):
            counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [t.lower().split() for t in raw_texts(batch)]
            first = [_hashes(w, width) for w in words]
            second = list(map(mix, first))
            third = [mix(x ^ THIRD) for x in second]
            prints = [[_text_key(w) for w in words], *([bits(x) if w else 0 for x, w in zip(part, words, strict=True)] for part in (first, second, third))]
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in prints]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns, pa.array(list(map(len, first)), pa.int64())], ["doc_id", "th", *"fpqrn"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, f long, p long, q long, r long, n long")


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [_hashes(t.lower().split(), width).tobytes() for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("f"), pa.array(sets, pa.binary())], ["f", "shingles"])

    return run


def _beside(placed: DataFrame, reach: int, tile_rows: int) -> DataFrame | None:
    """Rows of ``placed`` (f, k, ...) once per pair of tiles t1, t2 they meet in, ``first`` for those of t1; None without rows.

    Keys k are cut by the hash of f in tiles of about ``tile_rows``; tiles meet whose keys differ by ``reach`` at most.
    """
    slots = {r["k"]: -(-r["n"] // tile_rows) for r in placed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    first_tile, total = {}, 0
    for k in sorted(slots):
        first_tile[k], total = total, total + slots[k]
    beside = {}
    for k in slots:
        beside[k] = [first_tile[x] + s for x in sorted(slots) if abs(x - k) <= reach for s in range(slots[x])]
    if not slots:
        return None

    def per_count(values: dict):
        kind = "array<int>" if isinstance(next(iter(values.values())), list) else "int"
        out = F.lit(None).cast(kind)
        for k, v in values.items():
            out = F.when(F.col("k") == k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).otherwise(out)
        return out

    own = [c for c in placed.columns if c != "k"]
    dealt = placed.select("*", (per_count(first_tile) + F.pmod(F.xxhash64("f"), per_count(slots))).cast("int").alias("tile"))
    pairs = dealt.select(*own, "tile", F.explode(per_count(beside)).alias("other")).select(
        *own, F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), (F.col("tile") <= F.col("other")).alias("first"))
    # comparing costs far more than its few bytes tell, so the number of tasks is set and not merged
    return pairs.repartition(min(2048, max(1, sum(map(len, beside.values())))), "t1", "t2")


def near_groups(docs: DataFrame, radius: int = 4, width: int = 4, tile_rows: int = 1 << 20) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document.

    Texts are lower-cased (A-Z), split into words and ``width``-word shingles; fingerprints link at ``radius`` or
    fewer differing bits. Null and empty texts have fingerprint zero and link like any other. Repeated rows come
    out as often as they come in; a null doc_id names a component only where all its ids are null. An empty table
    gives an empty result; further columns are not read.

    Equal fingerprints are one node, so groups of copies cost nothing. Nodes are dealt to tiles of about ``tile_rows``
    by bit count and, inside it, by hash. Two tiles meet only if their bit counts differ by ``radius`` at most; one group per pair of
    tiles compares all that its blocks' quarter counts do not rule out and returns a spanning forest, never
    all pairs, so a clique of near copies stays linear. No fingerprint goes to the driver; it sees the numbers of
    rows by bit count.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.keep("marked", fingerprints(docs, width))
    nodes = scratch.keep("nodes", marked.groupBy("f").agg(F.min("doc_id").alias("least")))
    print_ = F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint")
    pairs = _beside(nodes.select("f", F.bit_count("f").alias("k")), radius, tile_rows)
    if pairs is None:
        return marked.select("doc_id", print_, F.col("doc_id").alias("component_id"))
    edges = scratch.keep("links", pairs.groupBy("t1", "t2").applyInArrow(_pair_links(radius), "u long, v long"))
    roots = scratch.keep("roots", components(edges, scratch))
    named = roots.join(nodes, roots["node"] == nodes["f"]).groupBy("root").agg(F.min("least").alias("component_id"))
    label = roots.join(named.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("node", "component_id")
    of_node = nodes.join(label, nodes["f"] == label["node"], "left").select(
        F.col("f").alias("g"), F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(of_node, marked["f"] == of_node["g"]).select("doc_id", print_, "component_id")


def near_copies(docs: DataFrame, similarity: Similarity = Similarity(8, 10), radius: int = 22, most: int = ALL, width: int = 5, tile_rows: int = 1 << 20, **limits: int) -> DataFrame:
    """doc_id, th, component_id and ``stays`` of every document; texts link whose ``width``-word shingle sets have ``similarity`` or more (Jaccard).

    th is the hash of the text; doc_id and th together name a document, as a doc_id may be null or stand for several texts. component_id is
    the smallest doc_id reachable by links, null only where all its ids are null. Of a component the document with the smallest
    doc_id stays (known ids first; of one id, the smaller th); rows that repeat it stay with it. Texts with equal words link; null, empty
    and blank texts are alike. An empty table gives an empty result; further columns are not read.

    Fingerprints of the distinct shingles only propose: texts that differ in ``radius`` bits of 64 and ``most`` of 192, and
    whose numbers of shingles allow the similarity. Tiles meet as in ``near_groups`` and return a spanning forest of the
    proposals. What these connect is a cell; no true link leaves a cell but those the fingerprints miss. The cells are joined exactly by
    ``metric_labels``, which holds the shingles in the tasks that compare them and returns forests of verified links, never pairs.
    """
    scratch = Scratch(docs.sparkSession)
    share = similarity.num / similarity.den
    marked = scratch.keep("marked", wide_prints(docs, width))
    nodes = scratch.keep("nodes", marked.groupBy("f").agg(F.min(who()).alias("who"), *[F.first(c).alias(c) for c in "pqrn"]))
    step = math.log(1 / min(share, 0.99))
    pairs = _beside(nodes.select(*"fpqrn", F.floor(F.log("n") / step + 1e-9).cast("int").alias("k")), 1, tile_rows)
    if pairs is None:
        return marked.select("doc_id", "th", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    forest = scratch.keep("forest", pairs.groupBy("t1", "t2").applyInArrow(_pair_proposals(radius, most, share), "u long, v long"))
    cells = scratch.keep("cells", components(forest, scratch).select(F.col("node").alias("x"), F.col("root").alias("cell")))
    wanted = nodes.join(cells, nodes["f"] == cells["x"]).select("f", "who")
    sets = texts_of(docs, wanted).mapInArrow(_shingles(width), "f long, shingles binary")
    members = scratch.keep("sets", sets.join(cells, sets["f"] == cells["x"]).select("cell", "f", "shingles"))
    rows = group_rows(marked, nodes, metric_labels(members, similarity, scratch, **limits), "doc_id", "th", F.col("first").alias("w"))
    stays = F.col("doc_id").eqNullSafe(F.col("w.id")) & (F.col("th") == F.col("w.th"))
    return rows.select("doc_id", "th", "component_id", stays.alias("stays"))
