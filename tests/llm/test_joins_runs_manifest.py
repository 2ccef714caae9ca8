"""Metric join, periodic runs and Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtables.llm import components as C
from webtables.llm import merkle, metric_join, periodic
from webtables.llm._tables import Scratch


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ metric join


def brute_groups(rows, num=9, den=10, width=3):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))

    def top(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                label[top(a)] = top(b)
    ids = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        ids[top(a)].append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((i, len(sets[a]), least[top(a)]) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"leaf_rows": 25, "pivots": 8}, {"leaf_bytes": 20000}])
def test_metric_join(spark, limits):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base, passage = say(150), say(60)
    texts = [say(r.randrange(200)) for _ in range(60)] + [say(20) + passage + say(r.randrange(10)) for _ in range(20)]
    for _ in range(150):  # one group of borderline copies
        words = list(base)
        for _ in range(r.randrange(9)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(words)
    texts += [base[: r.randrange(100, 150)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(None, rows[100][1]), (None, None), (5, ""), (7, rows[110][1]), (7, "another text"), (3000, "one"), (3001, "ONE"), (3002, "one two"), (3003, " one  two"), rows[3]]
    got = metric_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits).collect()
    assert Counter(map(tuple, got)) == brute_groups(rows)


def test_metric_join_of_odd_rows(docs, rows, empty):
    assert Counter(map(tuple, metric_join.jaccard_groups(docs).collect())) == brute_groups([r[:2] for r in rows])
    assert metric_join.jaccard_groups(empty).count() == 0


def test_metric_join_holds_little_on_disk(docs, rows, monkeypatch):
    """Wide tables go before texts are dealt out, and these are dealt out once, however often a row repeats."""
    there, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, name, df: (there.setdefault(name, set(self.paths)), keep(self, name, df))[1])
    assert Counter(map(tuple, metric_join.jaccard_groups(docs).collect())) == brute_groups([r[:2] for r in rows])
    assert not there["sets"] & {"marked", "nodes", "shared"} and "sets" in there["roots"]
    named = docs.selectExpr("h AS f", "struct(doc_id IS NULL AS none, doc_id AS id, xxhash64(coalesce(text, '')) AS th) AS who")
    plan = metric_join.texts_of(docs, named)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_leaf_and_grid_links_connect_the_same():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    like = metric_join.Similarity(6, 10)
    alike = [(i, j) for i in range(60) for j in range(i) if like.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    want = metric_join._trees(60, alike)
    links = metric_join.leaf_links(sets, np.arange(60), like)
    assert metric_join._trees(60, links) == want and len(links) == 60 - len(set(want))
    inside = [(i, j) for i, j in alike if (i < 40) == (j < 40)]
    labels = np.array(metric_join._trees(60, inside))
    across = metric_join.grid_links(sets[:40], sets[40:], labels, like)
    assert metric_join._trees(60, inside + across) == want


@pytest.mark.parametrize("edges", [50_000, 7])
def test_components_after_contraction(spark, monkeypatch, edges):
    monkeypatch.setattr(C, "TASK_EDGES", edges)
    pairs = [(i, i + 1) for i in range(60) if i % 20] + [(100, 3), (101, 100), (5, 5), (100, 3)] + [(200, 300 + i) for i in range(30)]
    got = {x.node: x.root for x in C.components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark)).collect()}
    assert len(got) == 60 + 3 + 30 - 1 + 1
    for n, root in got.items():
        assert root == (1 if n in (100, 101) or n <= 20 else 200 if n >= 200 else (n - 1) // 20 * 20 + 1)


# ------------------------------------------------------------------ periodic runs


def brute_runs(w, times=4, least=6):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, times * q):
                found.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_and_lyndon_arrays():
    r = random.Random(1)
    for _ in range(1500):
        n, letters = r.randrange(60), r.randrange(1, 5)
        w = [r.randrange(letters) for _ in range(n)]
        if n and r.random() < 0.5:
            x = r.randrange(n)
            p = 1 + (n - x) // r.randrange(3, 11)
            w = [w[i] if i < x else w[x + (i - x) % p] for i in range(n)]
            if r.random() < 0.4:
                w[r.randrange(n)] = r.randrange(letters)
        assert periodic.lyndon_array(w) == [next((j for j in range(i + 1, n) if w[j:] < w[i:]), n) - i for i in range(n)]
        assert periodic.find_runs(w) == brute_runs(w)


def test_periodic_runs_of_odd_rows(docs, rows, empty):
    def planted(i, text):
        h, w = zlib.crc32(("" if i is None else str(i)).encode()), (text or "").encode().split()
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        return w

    want = Counter()
    for row in rows:
        w = planted(*row[:2])
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        want[row[0], len(runs), best[0], best[1], best[2], milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)] += 1
    run = lambda d: periodic.summary(periodic.periodic_runs(d.select("doc_id", periodic.planted(d["doc_id"], d["text"]).alias("text"))))
    got = Counter((x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) for x in run(docs).collect())
    assert got == want and run(empty).count() == 0


# ------------------------------------------------------------------ manifest


def brute_manifest(rows, fan=3):
    leaf = lambda v: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, path in enumerate(paths):
                first = at[k] - at[k] % fan
                run = nodes[first : first + fan]
                path.append(("".join(run[: at[k] % fan]), "".join(run[at[k] % fan + 1 :])))
                at[k] //= fan
            nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        return nodes[0], paths

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    subs = []
    for name in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        items = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, leaf(x)))
        subs.append((items, *tree([leaf(x) for x in items])))
    root, over = tree([s[1] for s in subs])
    out = Counter()
    for (items, sub, paths), above in zip(subs, over, strict=True):
        for row, path in zip(items, paths, strict=True):
            text = row[4]
            if text is not None and zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf((*row[:4], text))
            for before, after in path + above:
                now = sha(before + now + after)
            out[row[0], leaf(row), sub, root, sha("".join(b + a for b, a in path + above)), now, now == root] += 1
    return out


def tampered(docs):
    odd = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    return {"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def test_manifest_of_odd_rows(docs, rows, empty):
    got = Counter(map(tuple, merkle.manifest(docs, now=tampered(docs)).collect()))
    assert got == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert merkle.manifest(empty).count() == 0


def test_manifest_over_several_rounds(spark, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(merkle, "DEPTH", 2)
    rows = [(i, r.choice(["hot"] * 3 + [None, "", "é", *map(str, range(30))]), None, i % 3, f"line\n{i}" if i % 5 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert Counter(map(tuple, merkle.manifest(docs, now=tampered(docs)).collect())) == brute_manifest(rows)
    assert merkle.manifest(docs).filter("NOT verified").count() == 0
