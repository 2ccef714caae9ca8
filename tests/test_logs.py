"""Health, dead hosts, ordering helpers and streams against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webtables.operators import health as H
from webtables.operators import joins as J
from webtables.operators.scan import ordinal, top_k
from webtables.streaming import streams as ST

T0 = datetime(2024, 1, 1)
SCHEMA = "run_id long, source_url string, host string, ts timestamp, seq long, reachable boolean, had_results boolean, ms long, error_class string"
CLASSES = ["java.net.ConnectException", "javax.net.ssl.SSLException", "java.net.UnknownHostException", "java.net.SocketTimeoutException"]


def make_log(seed, n, hot_ms):
    rng, rows, at = random.Random(seed), [], T0
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 20, 90]))
        site = "hot" if rng.random() < 0.8 else f"s{rng.randrange(5)}"
        reachable = rng.random() < 0.9
        ms = hot_ms(rng)
        rows.append((i // 40, site, site, at, i, reachable, rng.random() < 0.9, ms, None if reachable else rng.choice(CLASSES)))
    return rows


def plain_health(rows):
    out = {}
    for _, site, _, ts, _, reachable, good, ms, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        h = out.setdefault(site, [0, 0, None, None, 0])
        h[3] = ts
        if not reachable:
            h[1] += 1
        elif good:
            h[0], h[2] = h[0] + 1, ts
            h[4] = ms if h[4] <= 0 else (3 * h[4] + ms) // 4
    return {k: tuple(v) for k, v in out.items()}


def as_health(df):
    return {r["source_url"]: (r["ok"], r["fail"], r["last_ok"], r["last_try"], r["avg_ms"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["wide", "constant", "zeros"])
def test_health_long_history(spark, kind):
    ms = {"wide": lambda r: r.randrange(180000), "constant": lambda r: 7, "zeros": lambda r: r.choice([0, 0, 0, 1, 5000])}[kind]
    rows = make_log(1, 4000, ms)
    log = spark.createDataFrame(rows, SCHEMA)
    want = plain_health(rows)
    assert as_health(H.fold_health(log)) == want
    assert as_health(H.fold_health(log, seconds=40000)) == want
    assert as_health(H.fold_health(log, seconds=40000, slice_rows=150)) == want
    half = spark.createDataFrame(rows[:1500], SCHEMA)
    rest = spark.createDataFrame(rows[1500:], SCHEMA)
    assert as_health(H.fold_health(rest, H.fold_health(half), seconds=40000)) == want


def plain_dead(rows, ttl, https):
    out, dead, http = {}, {}, {}
    for _, _, host, ts, seq, _, _, _, cls in sorted(rows, key=lambda r: (r[3], r[4])):
        out[seq] = (dead.get(host, T0) > ts, http.get(host, T0) > ts)
        cls = cls or ""
        if "ConnectException" in cls or "SocketTimeout" in cls:
            dead[host] = ts + timedelta(seconds=ttl)
        elif "SSL" in cls:
            http[host] = ts + timedelta(seconds=https)
    return out


def test_dead_hosts(spark):
    rows = make_log(2, 2000, lambda r: 5)
    got = H.flag_dead(spark.createDataFrame(rows, SCHEMA))
    assert {r["seq"]: (r["dead"], r["plain_http"]) for r in got.collect()} == plain_dead(rows, 300, 1800)


def test_dead_expiry_is_exclusive(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    refused, unknown = CLASSES[0], CLASSES[2]
    rows = [(0, "a", "a", at(0), 0, False, False, 0, refused), (0, "a", "a", at(1), 1, True, True, 0, None),
            (0, "a", "a", at(5), 2, True, True, 0, None), (0, "a", "a", at(6), 3, True, True, 0, None),
            (0, "b", "b", at(0), 4, False, False, 0, unknown), (0, "b", "b", at(1), 5, True, True, 0, None)]
    got = {r["seq"]: r["dead"] for r in H.flag_dead(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False}


def test_failure_classes(spark):
    rows = [("e", "java.net.UnknownHostException", 0), ("e", "java.net.ConnectException", 0), ("e", "javax.net.ssl.SSLException", 0),
            ("e", "java.net.SocketTimeoutException", 0), (None, None, 404), (None, None, 200), ("e", "java.io.IOException", -1)]
    df = spark.createDataFrame(rows, "error string, cls string, code int")
    got = [r[0] for r in df.select(H.classify_failure("error", "cls", "code")).collect()]
    assert got == ["unreachable"] * 4 + ["page", "ok", "page"]


def test_ordinal_and_top_k(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else "cold", rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").withColumn("b", F.floor(F.col("v") / 50))
    want = {}
    for key in ("hot", "cold"):
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    assert {r["id"]: r["pos"] for r in ordinal(df, ["k"], ["b"], ["v", "id"]).collect()} == want
    alone = ordinal(df, [], ["b"], ["v", "id"]).orderBy("pos").collect()
    assert [r["id"] for r in alone] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert [r["pos"] for r in alone] == list(range(1, 3001))
    top = top_k(df, ["k"], [F.col("v"), F.col("id")], 7, ["id"])
    assert {r["id"]: r["pos"] for r in top.collect()} == {i: n for i, n in want.items() if n <= 7}


def split_stream(spark, tmp_path, rows, schema, parts):
    folder = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_health_stream_over_batches(spark, tmp_path):
    rows = make_log(8, 900, lambda r: r.randrange(5000))
    stream = split_stream(spark, tmp_path, rows, SCHEMA, 3)
    assert as_health(ST.health_stream(stream, str(tmp_path / "s"))) == plain_health(rows)


def test_dead_stream_over_batches(spark, tmp_path):
    rows = make_log(9, 900, lambda r: 1)
    out = ST.dead_host_stream(split_stream(spark, tmp_path, rows, SCHEMA, 3), str(tmp_path / "s"), 3600)
    assert {r["seq"]: (r["dead"], r["plain_http"]) for r in out.collect()} == plain_dead(rows, 300, 1800)


def test_dead_stream_with_late_rows_and_restart(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    row = lambda seq, m, cls: (0, "a", "a", at(m), seq, cls is None, cls is None, 0, cls)
    rows = [row(0, 10, CLASSES[0]), row(1, 6, None), row(2, 12, None), row(3, 16, None)]
    folder = str(tmp_path / "s")
    stream = split_stream(spark, tmp_path, rows, SCHEMA, 4)
    want = {0: False, 1: False, 2: True, 3: False}
    for _ in range(2):  # the second run has no new data
        assert {r["seq"]: r["dead"] for r in ST.dead_host_stream(stream, folder, 3600).collect()} == want


def test_health_stream_restarts(spark, tmp_path):
    rows = make_log(8, 300, lambda r: r.randrange(5000))
    stream = split_stream(spark, tmp_path, rows, SCHEMA, 3)
    for _ in range(2):
        assert as_health(ST.health_stream(stream, str(tmp_path / "s"))) == plain_health(rows)


def test_deadline_stream_over_batches(spark, tmp_path):
    rows = make_log(10, 300, lambda r: 1)
    out = ST.deadline_stream(split_stream(spark, tmp_path, rows, SCHEMA, 4), str(tmp_path / "s"), 200)
    want = H.apply_deadline(spark.createDataFrame(rows, SCHEMA), 200)
    pick = lambda df: {r["seq"]: r["outcome"] for r in df.collect()}
    assert pick(out) == pick(want) and set(pick(want).values()) == {"run", "timed out"}


def test_merge_stream_over_batches(spark, tmp_path):
    from webtables.operators.merge import merge_hits

    rng = random.Random(4)
    rows = [(i, rng.choice(["Red Hat", "red-hat!", "Blue", "", "!!"]), f"u{i}") for i in range(200)]
    schema = "arrival long, name string, book_url string"
    out = ST.merge_hits_stream(split_stream(spark, tmp_path, rows, schema, 4), str(tmp_path / "s"))
    want = merge_hits(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, out.select("key", "name", "offers").collect())) == sorted(
        map(tuple, want.select("key", "name", "offers").collect()))


def test_progress_stream_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(4), f"i{rng.randrange(9)}", T0 + timedelta(minutes=i), i, True) for i in range(300)]
    schema = "user_id long, item string, updated_at timestamp, chapter_index long, shelf boolean"
    opts = {"user": "user_id", "item": ["item"], "updated": "updated_at"}
    out = ST.progress_stream(split_stream(spark, tmp_path, rows, schema, 3), str(tmp_path / "s"), 3, **opts)
    want = J.recent_items(spark.createDataFrame(rows, schema), 3, **opts)
    key = lambda df: sorted((r["user_id"], r["item"], r["chapter_index"], r["place"]) for r in df.collect())
    assert key(out) == key(want) and len(key(want)) == 12


def test_merge_state_ends_with_the_watermark(spark, tmp_path):
    from webtables.operators.merge import merge_hits

    at = lambda h: T0 + timedelta(hours=h)
    rows = [(at(h), f"Title {h % 7}", f"u{h}") for h in range(0, 400)]
    late = [(at(1), "Title 1", "too late"), (at(405), "Title 0", "u405"), (at(398), "Title 6", "in time"), (at(406), "", "blank")]
    schema = "arrival timestamp, name string, book_url string"
    stream, progress = split_stream(spark, tmp_path, rows, schema, 4), []
    merge = lambda: ST.merge_hits_stream(stream, str(tmp_path / "s"), lateness="2 hours", span="1 day", progress=progress)
    merge()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "f9"))
    for _ in range(2):  # a restart with late rows, and one without data
        out = merge()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    want = merge_hits(spark.createDataFrame(rows + late[1:], schema))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert max(kept) <= 7 * 7 and kept[-1] <= 14  # a row per title and open day, of 17 days


def test_streams_without_data(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda schema: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    folder = lambda n: str(tmp_path / n)
    reads = stream("source_url string, chapters boolean")
    made = [
        ST.health_stream(stream(SCHEMA), folder("a")), ST.health_stream(stream(SCHEMA), folder("b"), reads=reads),
        ST.dead_host_stream(stream(SCHEMA), folder("c"), 60), ST.deadline_stream(stream(SCHEMA), folder("d")),
        ST.merge_hits_stream(stream("arrival timestamp, name string, book_url string"), folder("e"), lateness="1 hour"),
        ST.progress_stream(stream("user_id long, item string, updated_at timestamp"), folder("f"), item=["item"])]
    assert [df.count() for df in made] == [0] * 6


def test_health_and_reads_over_batches(spark, tmp_path):
    rows = make_log(8, 600, lambda r: r.randrange(5000))
    rng = random.Random(2)
    opened = [(rng.choice([rows[0][1], rows[5][1], "only read"]), rng.random() < 0.5) for _ in range(200)]
    stream = split_stream(spark, tmp_path, rows, SCHEMA, 5)
    reads = split_stream(spark, tmp_path / "r", opened, "source_url string, chapters boolean", 3)
    got = {r["source_url"]: r for r in ST.health_stream(stream, str(tmp_path / "s"), reads=reads, every=2).collect()}
    columns = spark.createDataFrame(rows, SCHEMA)
    health = {r["source_url"]: r for r in H.fold_health(columns).collect()}
    read = {r["source_url"]: r for r in H.fold_reads(spark.createDataFrame(opened, "source_url string, chapters boolean")).collect()}
    assert set(got) == set(health) | set(read)
    for site, row in got.items():
        assert (row["read_ok"], row["read_fail"]) == ((read[site]["read_ok"], read[site]["read_fail"]) if site in read else (0, 0))
        assert (row["ok"], row["fail"], row["avg_ms"]) == ((health[site]["ok"], health[site]["fail"], health[site]["avg_ms"]) if site in health else (0, 0, 0))
    kept = sorted(p.name for p in (tmp_path / "s" / "state").iterdir())
    assert len(kept) < 8 and any(n.startswith("full=") for n in kept)


def test_short_lists_answer_every_exclusion(spark):
    from webtables.operators import merge as M

    rng = random.Random(5)
    rows = [(k, f"s{rng.randrange(6)}", f"u{rng.randrange(5)}", rng.randrange(40)) for k in range(12) for _ in range(rng.randrange(1, 25))]
    members = spark.createDataFrame(rows, "key long, source_url string, book_url string, arrival long")
    ranks = spark.createDataFrame([(f"s{i}", i % 3) for i in range(5)], "source_url string, reading_rank int")
    failed = [(k, f"s{s}", f"u{u}", 100 * s + u, 9) for k in range(12) for s in range(6) for u in range(5)]
    lost = spark.createDataFrame(failed, "key long, source_url string, book_url string, chapter_index int, n_chapters int")
    registry = spark.createDataFrame([(f"s{i}",) for i in range(5)], "source_url string")
    got = {(r["key"], r["chapter_index"], r["try"]): (r["source_url"], r["book_url"]) for r in M.fallback_offers(members, ranks, lost, registry, 3, tie=("source_url", "book_url")).collect()}
    want = {}
    for k, s, u, case, _ in failed:
        best = {}
        for key, site, url, at in rows:
            if key == k and site not in (s, "s5") and url != u:
                best[site, url] = min(best.get((site, url), (99, 99)), (int(site[1]) % 3, at))
        for n, (o, offer) in enumerate(sorted((o, offer) for offer, o in best.items())[:3], 1):
            want[k, case, n] = offer
    assert got == want


def test_deadline_stream_counts_from_a_start_long_before_the_batch_ends(spark, tmp_path):
    day = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    row = lambda run, at, seq: (run, "a", "a", at, seq, True, True, 0, None)
    rows = [row(0, day(0), 0), row(1, day(0, 1), 1), row(0, day(0, 3), 2), row(2, day(10), 3)]
    outcomes = lambda df: {r["seq"]: r["outcome"] for r in df.collect()}
    out = ST.deadline_stream(split_stream(spark, tmp_path, rows, SCHEMA, 2), str(tmp_path / "s"), 7200)
    assert outcomes(out) == {0: "run", 1: "run", 2: "timed out", 3: "run"}
    again = rows + [row(0, day(20), 4), row(0, day(20, 3), 5)]
    out = ST.deadline_stream(split_stream(spark, tmp_path / "idle", again, SCHEMA, 3), str(tmp_path / "t"), 7200, idle=86400)
    assert outcomes(out) == {0: "run", 1: "run", 2: "timed out", 3: "run", 4: "run", 5: "timed out"}


def test_state_is_read_and_summed_without_unions(spark, tmp_path, monkeypatch):
    """Adaptive plans broke unions of joins by key: the rows of a key came out of two batches at once."""
    plans, write = [], ST.DeltaLog.write
    monkeypatch.setattr(ST.DeltaLog, "write", lambda self, n, rows: (plans.append(rows._jdf.queryExecution().analyzed().toString()), write(self, n, rows)))
    before = ST.DeltaLog.before
    monkeypatch.setattr(ST.DeltaLog, "before", lambda self, n, touched=None: (found := before(self, n, touched), plans.append(found._jdf.queryExecution().analyzed().toString()))[0])
    rows = make_log(8, 600, lambda r: r.randrange(5000))
    got = ST.health_stream(split_stream(spark, tmp_path, rows, SCHEMA, 4), str(tmp_path / "s"), every=2)
    assert as_health(got) == plain_health(rows)
    ST.deadline_stream(split_stream(spark, tmp_path / "d", rows, SCHEMA, 4), str(tmp_path / "t"), every=2)
    assert len(plans) > 16 and not [p for p in plans if "Union" in p]


def test_delta_log_gives_the_newest_rows_of_a_key(spark, tmp_path):
    log = ST.DeltaLog(spark, str(tmp_path / "full=7" / "log"), ["k"], spark.range(0).selectExpr("id AS k", "id AS v").schema, every=2)
    for n, (low, high) in enumerate([(0, 50), (10, 30), (20, 60), (25, 26)]):
        log.write(n, spark.range(low, high).selectExpr("id AS k", f"explode(array({n}L, {n}L + 100)) AS v"))
        last = {k: max(i for i, (a, b) in enumerate([(0, 50), (10, 30), (20, 60), (25, 26)][: n + 1]) if a <= k < b) for k in range(high if n in (0, 2) else 50 if n < 2 else 60)}
        want = sorted((k, v + more) for k, v in last.items() for more in (0, 100))
        assert sorted(map(tuple, log.now().collect())) == want
        some = log.before(n + 1, spark.range(22, 27).withColumnRenamed("id", "k"))
        assert sorted(map(tuple, some.collect())) == [x for x in want if 22 <= x[0] < 27]


def stream_parts(tmp_path, monkeypatch, spark, df, order):
    """The files of each part that ``read_stream`` made of a table of twelve files, and the rows of each batch."""
    from webtables.plans import streams

    df.repartition(12).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(streams.ST, "stream_folder", lambda spark, name: str(tmp_path / name))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        stream = streams.read_stream(spark, str(tmp_path), "t", order, df.columns)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    batches = []
    ST.run_available(stream, lambda d, n: batches.append(sorted(map(tuple, d.collect()))), str(tmp_path / "run"))
    parts = sorted((tmp_path / "in-t").iterdir())
    return [sorted(p.glob("part-*")) for p in parts], batches


def test_stream_parts_have_as_many_files_as_splits(spark, tmp_path, monkeypatch):
    df = spark.range(400).selectExpr("id", "if(id < 397, id, null) AS at")
    files, batches = stream_parts(tmp_path, monkeypatch, spark, df, "at")
    assert len({len(f) for f in files}) == 1 and len(files[0]) > 1
    assert len(batches) == 4 and sum(map(len, batches)) == 400
    seen = [[r[1] for r in b if r[1] is not None] for b in batches]
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:], strict=False))
    assert {397, 398, 399} <= {r[0] for r in batches[0]}


def test_stream_parts_with_fewer_rows_than_files(spark, tmp_path, monkeypatch):
    df = spark.range(100).selectExpr("id", "if(id < 99, 5, 6) AS at")
    files, batches = stream_parts(tmp_path, monkeypatch, spark, df, "at")
    assert len({len(f) for f in files}) == 1 and len(files[0]) > 1
    assert [len({r[1] for r in b}) <= 1 for b in batches] == [True] * len(batches) and sum(map(len, batches)) == 100


def test_stream_parts_come_in_order_whatever_the_clocks(spark, tmp_path, monkeypatch):
    files, _ = stream_parts(tmp_path, monkeypatch, spark, spark.range(40).selectExpr("id", "id AS at"), "at")
    stamps = [{f.stat().st_mtime for f in part} for part in files]
    assert all(max(a) + 1 < min(b) for a, b in zip(stamps, stamps[1:], strict=False))


def test_first_offers_are_found_without_shuffling_offers(spark):
    import re

    from webtables.operators import merge as M
    from webtables.session import settle

    rows = [(k, f"s{i % 5}", f"u{i % 7}", i) for k in range(3) for i in range(30)]
    members = settle(spark.createDataFrame(rows, "key long, source_url string, book_url string, arrival long"))
    ranks = settle(spark.createDataFrame([(f"s{i}", i % 3) for i in range(5)], "source_url string, reading_rank int"))
    tie = ("source_url", "book_url")
    first = settle(M.primary_offer(members, ranks, ranks.selectExpr("1L AS key", "source_url").filter("source_url = 's3'"), tie=tie))
    following = M.next_alternative(members, ranks, first, ranks.select("source_url"), tie=tie)
    assert {r["key"]: r["source_url"] for r in first.collect()} == {0: "s0", 1: "s3", 2: "s0"}
    assert {r["key"]: r["source_url"] for r in following.collect()} == {0: "s3", 1: "s0", 2: "s3"}
    for df in (M.primary_offer(members, ranks, first, tie=tie), following):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        assert dealt and not [e for e in dealt if "book_url" in e]


def test_ordinal_keeps_columns_named_like_its_own(spark):
    names = ["_", "_part", "_row", "_n", "_first", "_last", "_upto", "_p", "_at", "_off", "_goes_on", "__part"]
    df = spark.range(40).selectExpr("id", "id % 3 AS _n", "id % 2 AS _part", *[f"-id AS {c}" for c in names if c not in ("_part", "_n")]).repartition(5)
    want = sorted(range(40), key=lambda i: (i % 3, i % 2, -i))
    got = {r["id"]: r for r in ordinal(df, ["_n"], ["_part"], ["_first"]).collect()}
    assert {i: (r["_n"], r["_part"], r["_row"], r["_first"], r["_off"]) for i, r in got.items()} == {i: (i % 3, i % 2, -i, -i, -i) for i in range(40)}
    assert [got[i]["pos"] for i in want] == [n for k in range(3) for n in range(1, len(range(k, 40, 3)) + 1)]


def test_ordinal_shuffles_rows_twice(spark, request):
    """Once by ranges, once to be numbered: shifts are one row per range, however many keys there are."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7", "spark.sql.autoBroadcastJoinThreshold": "20000"}
    for key, value in conf.items():
        request.addfinalizer(lambda key=key, old=spark.conf.get(key): spark.conf.set(key, old))
        spark.conf.set(key, value)
    keys = [None, *(f"k{i}" for i in range(3000)), *["k7"] * 5000, *["k2999"] * 3000, None, None]
    df = spark.createDataFrame([(k, i % 5, i) for i, k in enumerate(keys)], "k string, b int, id int").repartition(3)
    found = ordinal(df, ["k"], ["b"], ["id"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the ranges are stored
    seen, want = {}, {}
    for k, _, i in sorted(((k, i % 5, i) for i, k in enumerate(keys)), key=lambda x: x[1:]):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert {r["id"]: r["pos"] for r in found.collect()} == want
