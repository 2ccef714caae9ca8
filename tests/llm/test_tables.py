"""Quality, chat, mixing, sharding and language model against brute force, and the registered queries."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.compare import compare, connect
from webtables.llm import chat, kd_shards, mixing, ngram_lm, quality
from webtables.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_statistics(docs, rows):
    want = Counter()
    for row in rows:
        text = row[1] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = Counter(windows)
        covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[row[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)] += 1
    got = quality.statistics(docs.select("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def plain_distances(x, steps):
    """The steps of the estimate in numpy, for one group."""
    p = x.shape[1]
    spread = np.array(quality.SPREAD) ** 2
    core = quality.chi2_quantile(quality.CORE, p)
    factor = quality.CORE / quality.chi2_cdf(core, p + 2)
    q = np.percentile(x, [25, 50, 75], axis=0)
    mean, cov = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2 + spread)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        bins = np.floor(np.log2(d + 1e-6) * quality.BINS)
        end = np.sort(bins)[math.ceil(len(x) * quality.CORE) - 1]
        near = x[bins <= end]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) * factor + np.diag(spread)
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_quality_distances(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = []
    for i in range(150):
        words = ["w" * int(n) for n in r.integers(2, 9, int(r.integers(20, 300)))]
        words = [w + str(k) for k, w in enumerate(words)]
        if i % 15 == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en", "a" if i < 110 else ["b", None][i % 2]))
    monkeypatch.setattr(quality, "MIN_ROWS", 30)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.verdicts(frame).collect()}
    vectors = {x.doc_id: [getattr(x, f"x{i}") / quality.SCALE for i in range(5)] for x in quality.statistics(frame).select("doc_id", *quality.vector()).collect()}
    for ids in (range(110), range(110, 150)):  # the small sources are judged together
        want = plain_distances(np.array([vectors[i] for i in ids]), quality.STEPS)
        assert np.allclose([got[i].distance for i in ids], want, rtol=1e-6, atol=1e-6)
    assert {i for i, x in got.items() if not x.kept} == set(range(0, 150, 15))


def test_quality_of_rare_groups(spark):
    """A language or source with few rows is judged by its whole language, or by all."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(330):
        words = ["w" * int(n) + str(k) for k, n in enumerate(r.integers(2, 9, int(r.integers(60, 300))))]
        if i >= 300 and i % 10 == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en" if i < 310 else "sw", "a" if i < 300 else "b"))
    schema = "doc_id long, text string, lang string, source string"
    got = {x.doc_id: x for x in quality.verdicts(spark.createDataFrame(rows, schema)).collect()}
    frame = spark.createDataFrame(rows, schema)
    vectors = {x.doc_id: [getattr(x, f"x{i}") / quality.SCALE for i in range(5)] for x in quality.statistics(frame).select("doc_id", *quality.vector()).collect()}
    for judged, by in ((range(300), range(300)), (range(300, 310), range(310)), (range(310, 330), range(330))):
        want = dict(zip(by, plain_distances(np.array([vectors[i] for i in by]), quality.STEPS), strict=True))
        assert np.allclose([got[i].distance for i in judged], [want[i] for i in judged], rtol=1e-6, atol=1e-6)
    assert {i for i, x in got.items() if not x.kept} == {300, 310, 320}


def test_quality_of_odd_rows(docs, rows, empty):
    got = quality.verdicts(docs).collect()
    assert len(got) == len(rows) and all(r.base_failed and not r.kept for r in got if r.n_words < 10)
    judged = [r for r in got if not r.base_failed]  # too few rows for an estimate of their own: all documents are one group
    assert all(r.distance is not None for r in judged) and sum(r.kept for r in judged) >= 0.9 * len(judged)
    assert not any(r.kept for r in judged if r.n_words > 20000)
    assert quality.verdicts(empty).count() == 0


def test_chi_square():
    assert quality.chi2_cdf(5.991464547, 2) == pytest.approx(0.95) and quality.chi2_quantile(0.99, 5) == pytest.approx(15.08627247)


def test_chat(spark, empty):
    said = ["a <b> [INST] \\ <image:0> </s>", "", None, "\\[/INST]\n"]
    text = lambda t: {"kind": "text", "text": t, "ref": None, "size": None}
    image = {"kind": "image", "text": None, "ref": "s3://x/1.png", "size": [57.0, 28.0]}
    audio = {"kind": "audio", "text": None, "ref": "a.wav", "size": [2.5]}
    paper = {"kind": "document", "text": None, "ref": "d.pdf", "size": None}
    rows = [(1, 0, "user", [text(said[0]), image, text("b c"), audio]), (1, 1, "assistant", [text(said[3]), paper]), (1, 2, "to[ol]", [text(said[2])]), (1, 2, None, None),
            (None, 0, "user", []), (None, None, "assistant", [text(said[1])]), (2, 5, "assistant", [text("x")]), (2, 5, "assistant", [text("x")])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = sorted(chat.format_turns(frame).collect(), key=lambda r: (r.conv_id or 0, r.position))
    one = [r for r in got if r.conv_id == 1]
    assert one[0].formatted.count("<image:0>") == 2 and "<audio:1>" in one[0].formatted and one[1].attachments[0].placeholder == "<document:2>"
    assert [(a.kind, a.ref, a.tokens) for r in one for a in r.attachments] == [("image", "s3://x/1.png", 3), ("audio", "a.wav", 63), ("document", "d.pdf", 512)]
    assert chat.read_turns("".join(r.formatted for r in one)) == [
        ("user", said[0] + "<image:0>b c<audio:1>"), ("assistant", said[3] + "<document:2>"), ("", ""), ("to[ol]", "")]
    read = {r.conv_id: r for r in chat.digests(chat.format_turns(frame)).collect()}
    assert {k: r.n_turns for k, r in read.items()} == {1: 4, None: 2, 2: 2}
    assert read[2].loss_sha256 == hashlib.sha256(b"xx").hexdigest() and read[2].loss_chars == 2
    nothing = empty.selectExpr("doc_id AS conv_id", "doc_id AS turn", "text AS role", "text")
    assert chat.digests(chat.format_turns(nothing.select("conv_id", "turn", "role", chat.text_parts(nothing["text"]).alias("parts")))).count() == 0


def test_chat_text_escapes():
    for text in ("", "\\", "<", "[", "\\\\<[", "a</s>[INST]", "<\\", "\n"):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read_turns(f"[INST]{chat.escape(text)}[/INST]{chat.escape(text)}</s>") == [("user", text), ("assistant", text)]


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, total = {}, set(names), sum(sizes.values())
    while True:  # share, cap, share the rest
        left = total - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    by_source = defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        by_source[r.source].append(r)
    for s, own in by_source.items():
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(empty).count() == 0


def test_mix_refines_one_bucket(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 3 == 0]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)


@pytest.mark.parametrize("shards", [1, 7])
def test_shards(docs, rows, small, shards):
    for frame in (docs, small):
        source = rows if frame is docs else [(r.doc_id, r.text) for r in small.collect()]
        got = kd_shards.kd_shards(frame, shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in source)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
        if frame is small:
            bytes_of = Counter()
            for r in got:
                bytes_of[r.shard] += r.size
            share = sum(bytes_of.values()) / shards
            assert max(bytes_of.values()) < share + max(r.size for r in got)
            home = defaultdict(set)
            for r in got:
                home[r.size, r.text_crc32].add(r.shard)
            assert all(len(x) == 1 for x in home.values())


def test_shards_cut_a_hot_text(spark, empty):
    rows = [(i, "the same text over and over" if i % 3 else f"text {i} of its own", "en", "s") for i in range(900)]
    got = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.3 * sum(sizes.values()) / 8
    assert kd_shards.kd_shards(empty).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 50])
def test_language_model(docs, rows, limit):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in rows]
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens), key=repr)
    got = ngram_lm.score_documents(docs, max_frequent=limit).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("limits", [{"head_bits": 1 << 26}, {"head_bits": 1 << 10, "max_frequent": 5, "part_bytes": 2000}, {"head_bits": 1 << 19, "max_frequent": 50}])
def test_language_model_scores(docs, rows, limits):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    texts = [(held(r[0]), (r[1] or "").encode().lower().split() + [b"\n"]) for r in rows]
    words = Counter(w for out, ws in texts if not out for w in ws)
    both = Counter(p for out, ws in texts if not out for p in zip([None, *ws], ws, strict=False))
    n, v, trained = sum(words.values()), len(words), sum(not out for out, _ in texts)
    about = lambda c: ngram_lm.MIDDLES[np.searchsorted(ngram_lm.LEVELS, c, side="right")]

    def score(ws, prior, less):
        total = 0.0
        for w0, w1 in zip([None, *ws], ws, strict=False):
            before, word = trained if w0 is None else about(words[w0]), about(words[w1])
            joint = min(about(both[w0, w1]), before, word)
            joint, before, word = (max(x - less, 0) for x in (joint, before, word))
            total += math.log10((joint + prior * (word + 0.5) / (n + 0.5 * (v + 1))) / (before + prior))
        return total

    best = max(ngram_lm.PRIORS, key=lambda p: sum(score(ws, p, 1) for out, ws in texts if not out))
    want = sorted((round(score(ws, best, 0), 6) for _, ws in texts))
    got = sorted(round(r.score, 6) for r in ngram_lm.score_documents(docs, bits_per_entry=400, **limits).collect())
    close = 0.05 if limits["head_bits"] == 1 << 19 else 1e-6  # the head has few bits there, and some probes hit by chance
    assert got == pytest.approx(want, rel=close, abs=2e-6)


@pytest.mark.parametrize("head_bits", [1 << 26, 1 << 21, 1 << 12])
def test_language_model_beats_its_base(spark, head_bits):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    got = ngram_lm.score_documents(docs, head_bits=head_bits).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert got["sum(score)"] / got["sum(n_tokens)"] > got["sum(base_score)"] / got["sum(n_tokens)"] + 0.3


def test_language_model_learns(spark, empty):
    rows = [(i, " ".join(f"{'abcdefgh'[k % 8]}{(i + k) % 40}" for k in range(60))) for i in range(300)]
    got = ngram_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.6 * got["sum(base_score)"]
    assert ngram_lm.score_documents(empty).count() == 0


def test_log_bloom():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 20000, dtype=np.uint64))
    counts = r.integers(1, 3000, len(keys))
    bits, cut = ngram_lm.LogBloom.segment(keys, counts, 1 << 23)
    table = ngram_lm.LogBloom(1, 1 << 23, bits)
    assert cut == 1 and (table.levels(keys) >= ngram_lm.level_of(counts)).all() and (table.levels(keys) == ngram_lm.level_of(counts)).mean() > 0.97
    assert (table.levels(r.integers(0, 1 << 63, 20000, dtype=np.uint64)) > 0).mean() < 0.05
    _, cut = ngram_lm.LogBloom.segment(keys, counts, 1 << 18)
    assert cut > 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    good, note, _ = compare(spark, connect(SF), SF, name, QUERIES[name], SQL.get(name))
    assert good, note


def plain_pipeline(kept):
    """Line dedup, near dedup, mixing and encoding of (doc_id, text, source) by brute force."""
    import public_tokenizers
    import tiktoken

    from webtables.llm.bpe import read_ranks
    from webtables.llm.queries import VOCABULARY

    first, docs = {}, []
    for i, text, source in sorted(kept):
        lines = text.split("\n")
        told = [k for k, line in enumerate(lines) if WORD.search(line)]
        gone = set()
        for s in range(len(told) - 1):
            if first.setdefault((lines[told[s]], lines[told[s + 1]]), (i, s)) != (i, s):
                gone.update(told[s : s + 2])
        for s, k in enumerate(told):
            if len(WORD.findall(lines[k])) >= 20 and first.setdefault(lines[k], (i, s)) != (i, s):
                gone.add(k)
        docs.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), source))
    shingles = []
    for _, text, _ in docs:
        words = text.encode().lower().split()
        shingles.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    stay = [d for k, d in enumerate(docs) if root(k) == k]
    sizes, by_source = {}, defaultdict(list)
    for i, text, source in stay:
        sizes[i] = len(WORD.findall(text))
        by_source[source].append(i)
    total, names = sum(sizes.values()), sorted(by_source)
    own = {s: sum(sizes[i] for i in by_source[s]) for s in names}
    weight, target, left = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * own[s]}
        if not over:
            break
        target |= {s: 3.0 * own[s] for s in over}
        left -= over
    target |= {s: level * weight[s] for s in left}
    place = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in sizes}
    times = {}
    for s in names:
        whole = int(target[s] // own[s]) if own[s] else 0
        need, held = target[s] - whole * own[s], 0
        for i in sorted(by_source[s], key=place.get):
            more = need > 0 and (held + sizes[i] < need or held < need and held + sizes[i] - need <= need - held)
            held += sizes[i]
            times[i] = (whole + more) * (sizes[i] > 0)
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    out = Counter()
    for i, text, _ in stay:
        ids = public.encode_ordinary(text)
        if times[i]:
            out[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] = times[i]
    return out


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    assert 0 < len(rows) < docs.count()
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == plain_pipeline(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_of_odd_rows(spark, docs, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, empty):
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns, name
            assert out.count() <= 3 * frame.count()
