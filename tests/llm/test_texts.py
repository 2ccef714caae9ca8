"""Exact, substring, line and near dedup and byte-level BPE against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from webtables.llm import bpe, exact, line_runs, simhash, suffix_tree
from webtables.llm._tables import Scratch
from webtables.llm.components import components
from webtables.llm.queries import VOCABULARY, tokenizer


def norm(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("bits", [128, 3])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(docs, rows, keep, bits):
    groups = defaultdict(set)
    for row in rows:
        groups[norm(row[1])].add(row[0])
    pick = max if keep == "largest" else min
    want = sorted(((i, pick((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t).hexdigest()) for t, ids in groups.items() for i in ids), key=repr)
    got = exact.exact_groups(docs, keep, bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def removed_by_windows(rows, window):
    first, out = {}, []
    texts = sorted({(1 << 63 if r[0] is None else r[0], r[1] or "") for r in rows}, key=lambda x: x[0])
    for i, text in texts:
        words = text.encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if first.setdefault(key, (i, text, s)) != (i, text, s):
                gone.update(range(s, s + window))
        out.append((i, text, [w for k, w in enumerate(words) if k not in gone], len(gone)))
    return {(i, t): (b" ".join(w).decode(), n) for i, t, w, n in out}


@pytest.mark.parametrize("limits", [{}, {"part_bytes": 1 << 12, "group_rows": 20}])
def test_suffix_trees(docs, rows, limits):
    one_text = [r for r in rows if r[0] != 12]  # the order of two texts of one id is that of their hashes
    want = removed_by_windows(one_text, 20)
    got = suffix_tree.remove_repeats(docs.filter("doc_id IS NULL OR doc_id != 12"), 20, **limits).collect()
    assert len(got) == len(one_text)
    by_id = Counter((r.doc_id, r.kept, r.n_removed) for r in got)
    assert by_id == Counter((r[0], *want[1 << 63 if r[0] is None else r[0], r[1] or ""]) for r in one_text)


def test_suffix_trees_on_crossing_repeats(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab") for _ in range(60))) for i in range(12)] + [(20, "a " * 200)]
    want = removed_by_windows(rows, 10)
    got = suffix_tree.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert {r.doc_id: (r.kept, r.n_removed) for r in got} == {i: want[i, t] for i, t in rows}


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_line_runs(docs, rows, min_lines):
    first, want = {}, {}
    for i, text in sorted({(1 << 63 if r[0] is None else r[0], r[1] or "") for r in rows if r[0] != 12}, key=lambda x: x[0]):
        lines = text.split("\n")
        told = [k for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)]
        gone = set()
        for s in range(len(told) - min_lines + 1):
            key = tuple(lines[k] for k in told[s : s + min_lines])
            if first.setdefault(key, (i, text, s)) != (i, text, s):
                gone.update(told[s : s + min_lines])
        for s, k in enumerate(told):
            if len(lines[k].encode().split()) >= 20 and first.setdefault(lines[k], (i, text, s)) != (i, text, s):
                gone.add(k)
        want[i, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    got = line_runs.drop_repeated_runs(docs.filter("doc_id IS NULL OR doc_id != 12"), min_lines).collect()
    expected = Counter()
    for r in rows:
        if r[0] != 12:
            text, n = want[1 << 63 if r[0] is None else r[0], r[1] or ""]
            expected[r[0], None if r[1] is None and not n else text, n, r[3], r[6]] += 1
    assert Counter((r.doc_id, r.text, r._lines.n_removed, r.source, r.f) for r in got) == expected


@pytest.mark.parametrize("ranges", [None, 9])
def test_suffix_order_of_lines(spark, ranges, request):
    if ranges:  # groups go on from one range to the next
        for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", str(ranges))):
            request.addfinalizer(lambda key=key, old=spark.conf.get(key): spark.conf.set(key, old))
            spark.conf.set(key, value)
    r = random.Random(11)
    docs = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(12)] + [[9]] + [list(range(20, 40)) * 2] * 2
    docs += [docs[0], docs[1][:5], docs[2] + [99]]
    places = [
        (d, 0, s, h, line[s - 1] if s else None, len(line) - s) for d, line in enumerate(docs) for s, h in enumerate(line)]
    often = Counter(h for line in docs for h in line)
    suffixes = sorted((line[s:], d, s) for d, line in enumerate(docs) for s, h in enumerate(line) if often[h] > 1)
    shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for (a, *_), (b, *_) in zip(suffixes, suffixes[1:], strict=False)]
    rows = spark.createDataFrame(places + [p for p in places if p[0] == 3], "did long, th long, s int, h long, before long, left int").repartition(5)
    got = line_runs.suffix_order(rows, Scratch(spark)).orderBy("at").collect()
    assert [(x.did, x.s, x.lcp) for x in got] == [(d, s, n) for (_, d, s), n in zip(suffixes, shared, strict=True)]
    assert [x["at"] for x in got] == list(range(1, len(suffixes) + 1)) and max(shared) == 40


def plain_fingerprint(text, width):
    words = norm(text).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(n, linked):
    label = list(range(n))
    while True:
        new = [min(label[j] for j in linked[i]) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize(("radius", "tile_rows"), [(4, 1 << 20), (12, 7)])
def test_simhash(docs, rows, radius, tile_rows):
    prints = [plain_fingerprint(r[1], 4) for r in rows]
    linked = [[j for j, b in enumerate(prints) if (a ^ b).bit_count() <= radius] for a in prints]
    label = closed(len(rows), linked)
    least = defaultdict(list)
    for row, c in zip(rows, label, strict=True):
        if row[0] is not None:
            least[c].append(row[0])
    want = Counter((r[0], f"{p:016x}", min(least[c], default=None)) for r, p, c in zip(rows, prints, label, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs, radius, 4, tile_rows).collect()) == want


def test_simhash_verified(spark):
    r = random.Random(5)
    say = lambda n: [str(r.randrange(5000)) for _ in range(n)]
    bases = [say(200) for _ in range(30)]
    rows = []
    for k, base in enumerate(bases):
        rows.append((3 * k, " ".join(base)))
        near, far = list(base), list(base)
        near[50], far[20:120] = "new", say(100)
        rows += [(3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 3 if i % 3 < 2 else i for i, _ in rows}


def test_simhash_verifies_every_link_that_matters(spark):
    import corpus_pipeline

    r = random.Random(11)
    say = lambda n: [str(r.randrange(50000)) for _ in range(n)]
    texts = []
    for _ in range(60):  # A and B are alike, and so is each to its copy; the copy of one is too far from the other
        a = say(500)
        b = list(a)
        for i in range(10):
            b[25 + 50 * i] = "new" + str(i)
        copies = []
        for own in (a, b):
            copy = list(own)
            copy[r.randrange(3, 12)], copy[r.randrange(480, 490)] = "x", "y"
            copies.append(copy)
        texts += [" ".join(t) for t in (copies[0], a, b, copies[1])]
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    alike = [[j for j in range(i - i % 4, i - i % 4 + 4) if len(x & sets[j]) >= 0.8 * len(x | sets[j])] for i, x in enumerate(sets)]
    want = closed(len(texts), alike)
    assert all(i + 3 not in alike[i] and i + 2 not in alike[i] and i + 2 in alike[i + 1] for i in range(0, len(texts), 4))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.component_id for x in simhash.near_copies(frame, **corpus_pipeline.NEAR).orderBy("doc_id").collect()] == want
    small = {x.doc_id: x.component_id for x in simhash.near_copies(frame, **corpus_pipeline.NEAR, tile_rows=50).collect()}
    assert [small[i] for i in range(len(texts))] == want


def test_near_pairs_are_proposed(spark):
    import corpus_pipeline

    r = random.Random(3)
    texts = []
    while len(texts) < 600:  # J from 0.80 to 0.85
        a = [str(r.randrange(50000)) for _ in range(100)]
        b = list(a)
        for i in (20, 70):
            b[i + r.randrange(-9, 9)] = "new"
        x, y = (set(zip(*[t[k:] for k in range(5)], strict=False)) for t in (a, b))
        assert 0.8 <= len(x & y) / len(x | y) <= 0.85
        texts += [" ".join(a), " ".join(b)]
    got = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **corpus_pipeline.NEAR).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("leaf_rows", [2048, 3])
def test_near_copies_of_odd_rows(docs, rows, leaf_rows):
    words = [norm(r[1]).split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    alike = [[j for j, y in enumerate(sets) if words[i] == words[j] or len(x & y) >= 0.8 * len(x | y)] for i, x in enumerate(sets)]
    least = defaultdict(list)
    label = closed(len(rows), alike)
    for row, c in zip(rows, label, strict=True):
        if row[0] is not None:
            least[c].append(row[0])
    want = Counter((r[0], min(least[c], default=None)) for r, c in zip(rows, label, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in simhash.near_copies(docs, leaf_rows=leaf_rows).collect()) == want


def test_links_form_a_forest_of_all_components():
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 63, 1500, dtype=np.uint64)
    values = np.unique(np.concatenate([values, values[:700] ^ np.uint64(5), values[:700] ^ np.uint64(1 << 40)]))
    u, v, _ = simhash.links(values, None, 3)
    assert len(u) < len(values) and (np.bitwise_count(u ^ v) <= 3).all()
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 3
    label = np.arange(len(values))
    while not np.array_equal(label, new := np.where(near, label[None], len(values)).min(1)):
        label = new
    at = {x: i for i, x in enumerate(values.tolist())}
    joined = closed(len(values), [[i, *x] for i, x in enumerate(_neighbours(at, u.tolist(), v.tolist()))])
    assert joined == label.tolist()


def _neighbours(at, u, v):
    out = [[] for _ in at]
    for a, b in zip(u, v, strict=True):
        out[at[a]].append(at[b])
        out[at[b]].append(at[a])
    return out


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    linked = [[i] for i in range(len(nodes))]
    for a, b in edges:
        if a != b:
            linked[at[a]].append(at[b])
            linked[at[b]].append(at[a])
    want = {n: nodes[c] for n, c in zip(nodes, closed(len(nodes), linked), strict=True)}
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    assert {x.node: x.root for x in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def public():
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, rows, public):
    got = bpe.round_trip(docs, tokenizer()).collect()
    want = Counter()
    for row in rows:
        ids = public.encode_ordinary(row[1] or "")
        want[row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    ids = bpe.encode(docs, tokenizer())
    back = Counter((r.doc_id, bytes(r.raw)) for r in bpe.decode(ids, tokenizer()).collect())
    assert back == Counter((r[0], (r[1] or "").encode()) for r in rows)


def test_bpe_on_odd_characters(public):
    own, r = tokenizer().encoder(), random.Random(1)
    texts = ["a" * 3000, "\x1c a\x1d\x85b\xa0 c\u200b x  \n\n y", "日本語テキスト 123٣٤ ½ ’s don't", "👩‍👩‍👧 \U0001f600x"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), 9, 10, 32])) for _ in range(60)) for _ in range(300)]
    assert all(own(t) == public.encode_ordinary(t) for t in texts)


def test_perfect_hash():
    ranks = {str(i).encode(): i for i in range(1000)}
    table = bpe.PerfectHash(ranks)
    assert len(table.keys) == 1000 and all(table.get(k) == r for k, r in ranks.items()) and table.get(b"x") is None
    assert bpe.PerfectHash({}).get(b"x") is None


def test_empty_tables(empty):
    assert exact.exact_groups(empty).count() == suffix_tree.remove_repeats(empty).count() == line_runs.drop_repeated_runs(empty).count() == 0
    assert simhash.near_groups(empty).count() == bpe.round_trip(empty, tokenizer()).count() == 0
