"""Periodic runs of words: Lyndon arrays under both orders by grouping suffixes, their roots extended to whole runs."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions._cols import bind
from webtables.llm._tables import pieces, raw_texts

MIN_LENGTH = 6
TIMES = 4


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the grouping phase of a suffix sorter.

    Suffixes start in groups of one letter. Groups are taken from the greatest down; the members of the one taken are
    done, and the nearest place before each that is not done has the group's context appended to its own, as often as it is
    named. Those named more often move to a new group above the old one. The context a place ends with is its Lyndon word.
    """
    n = len(word)
    by_letter: dict[int, set[int]] = defaultdict(set)
    for i, x in enumerate(word):
        by_letter[x].add(i)
    letters = sorted(by_letter)
    members = [by_letter[x] for x in letters]  # of each group
    length = [1] * len(letters)  # of its context
    below = list(range(-1, len(letters) - 1))  # the next smaller group
    above = [*range(1, len(letters)), -1]
    group_of = {x: g for g, x in enumerate(letters)}
    group = [group_of[x] for x in word]
    alive = list(range(-1, n))  # alive[i + 1]: i, or a place to the left of it where the search goes on
    out = [0] * n
    top = len(letters) - 1
    while top >= 0:
        own, size = members[top], length[top]
        for i in own:
            alive[i + 1] = i - 1
            out[i] = size
        named: dict[int, int] = {}
        for i in own:
            j = i - 1
            while alive[j + 1] != j:
                alive[j + 1] = alive[alive[j + 1] + 1]  # halves the path
                j = alive[j + 1]
            if j >= 0:
                named[j] = named.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j, k in named.items():
            moves[group[j], k].append(j)
        for old, k in sorted(moves, key=lambda m: -m[1]):
            moved = moves[old, k]
            if len(moved) == len(members[old]):
                length[old] += k * size  # the whole group goes up by itself
                continue
            new = len(members)
            members[old].difference_update(moved)
            members.append(set(moved))
            length.append(length[old] + k * size)
            below.append(old)
            above.append(above[old])
            if above[old] >= 0:
                below[above[old]] = new
            above[old] = new
            for j in moved:
                group[j] = new
        top = below[top]
        if top >= 0:
            above[top] = -1
    return out


def _common(word: np.ndarray, i: int, j: int, step: int) -> int:
    """Length of the longest common extension of places i < j, forwards (step 1) or backwards (step -1)."""
    n, width = 0, 16
    while True:
        room = len(word) - j - n if step > 0 else i - n + 1
        size = min(width, room)
        if size <= 0:
            return n
        if step > 0:
            differ = np.flatnonzero(word[i + n : i + n + size] != word[j + n : j + n + size])
        else:
            differ = np.flatnonzero(word[i - n - size + 1 : i - n + 1][::-1] != word[j - n - size + 1 : j - n + 1][::-1])
        if len(differ):
            return n + int(differ[0])
        n, width = n + size, width * 2


def runs_of(ids: np.ndarray, times: int = TIMES, min_length: int = MIN_LENGTH) -> set[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with at least ``times`` periods and ``min_length`` words.

    The root of a run is the longest Lyndon word at its places under one of the two orders. A run of four periods
    or more holds three roots in a row, whatever its phase; the first of them is extended both ways.
    """
    found: set[tuple[int, int, int]] = set()
    need = times - 1
    n = len(ids)
    for signed in (ids, -ids):
        lengths = np.array(lyndon_array(signed.tolist()), np.int64)
        at = np.arange(n)
        good = at + need * lengths <= n
        first = at[good]
        q = lengths[first]
        for k in range(1, need):
            same = lengths[first + k * q] == q
            first, q = first[same], q[same]
        end: dict[int, int] = {}  # of the last run of each period
        for i, p in zip(first.tolist(), q.tolist(), strict=True):
            if i + p <= end.get(p, 0):  # its root lies in a run already found
                continue
            ahead = _common(ids, i, i + p, 1)
            if ahead < (need - 1) * p:
                continue
            back = _common(ids, i - 1, i + p - 1, -1)
            size = back + p + ahead
            end[p] = i + p + ahead
            if size >= max(min_length, times * p):
                found.add((i - back, size, p))
    return found


def _segments(words: list, times: int, min_length: int) -> list[tuple[int, int]]:
    """Stretches outside of which no run lies: in a run of length L every word comes back within L / times places.

    Words seen less than ``times`` times are cut out first, then, inside each stretch, words whose neighbours of the same kind are too far
    off for a run of that stretch's length, until nothing changes.
    """
    counts = Counter(words)
    if max(counts.values(), default=0) < times:
        return []
    often = np.array([counts[w] >= times for w in words], bool)
    edges = np.flatnonzero(np.diff(np.r_[False, often, False].astype(np.int8)))
    todo = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= min_length]
    out = []
    while todo:
        a, b = todo.pop()
        last: dict = {}
        near = [b - a] * (b - a)
        for i in range(a, b):
            w = words[i]
            j = last.get(w)
            if j is not None:
                d = i - j
                near[i - a] = d
                if d < near[j - a]:
                    near[j - a] = d
            last[w] = i
        most = (b - a) // times
        fits = np.array(near) <= most
        if fits.all():
            out.append((a, b))
            continue
        edges = a + np.flatnonzero(np.diff(np.r_[False, fits, False].astype(np.int8)))
        todo += [(x, y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if y - x >= min_length]
    return out


def find_runs(words: list, times: int = TIMES, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one text's words, by start, then period."""
    found: list[tuple[int, int, int]] = []
    for a, b in _segments(words, times, min_length):
        own: dict = {}
        ids = np.array([own.setdefault(w, len(own)) for w in words[a:b]], np.int64)
        found += [(a + s, size, p) for s, size, p in runs_of(ids, times, min_length)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, times: int = TIMES, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed (text without repetitions) of every document.

    Words are what lies between the bytes \\x20 and \\x09 to \\x0D of the whole text. A run is a stretch with smallest
    period q, of at least ``times`` * q and ``min_length`` words, that no neighbouring word extends. collapsed joins by one space the words
    that no run contains after its first q words.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows and null or equal ids come out as often
    as they come in. An empty table gives an empty result; further columns are not read.

    There is no shuffle: a document is one row, of any length. Work is linear in its words but for the sorting of
    its letters and of named places; only stretches whose words come back often enough are sorted at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in pieces(batches):
            sizes, runs, texts = [], [], []
            for text in raw_texts(batch):
                words = text.split()  # bytes: at \\x09-\\x0D and the space
                own = find_runs(words, times, min_length)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(collapse(words, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a repetition planted in about a tenth of the documents, as crc32 of the doc_id says; words joined by one space there.

    With h the crc32, g = floor(h / 10), n words, a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)), where 10 divides h word i >= a becomes
    word a + (i - a) mod p. A null doc_id counts as empty; texts without words stay.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(w, F.when(i < a, i).otherwise(a + (i - a) % p) + 1)), " ")

    repetition = bind(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.when(F.size(w) > 0, repeated(w)))
    return F.coalesce(F.when(h % 10 == 0, repetition), text)


def summary(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without runs) and digests of runs and collapsed text."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.when(F.size("runs") > 0, best)
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
