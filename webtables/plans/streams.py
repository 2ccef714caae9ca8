"""Streaming queries over the given tables; each result equals the batch operator's."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.plans import sites, works
from webtables.plans.proxies import Catalog, attempts, reads, table
from webtables.streaming import streams as ST

catalog = Catalog()


PARTS = 4
EVENT = ["event_id", "user_id", "event_type", "value", "ts"]
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


def read_stream(spark, sf, name, order, columns):
    """Columns of a given table as a stream, one part of :data:`PARTS` a batch, in the order of a column.

    A part has as many files as its share of the splits of the table, so no task writes or reads a part alone; a batch takes that number
    of files. The files of a part are stamped two seconds after those of the part before: batches come in order whatever the clocks of
    the executors say. Rows without a value of the column come first.
    """
    given = spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)
    files = -(-given.rdd.getNumPartitions() // PARTS)
    cuts = given.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)]).alias("c")).first()["c"] or []
    folder = ST.stream_folder(spark, f"in-{name}")
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        above = F.lit(True) if low is None else F.col(order) > F.lit(low)
        below = F.lit(True) if high is None else F.col(order) <= F.lit(high)
        part = given.filter(above & (below | F.col(order).isNull() if low is None else below))
        ST.write_part(part, f"{folder}/part={i}", files, i)
    return spark.readStream.schema(given.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/part=*")


@catalog.add("t01_merge_stream", """
SELECT regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g') AS key, arg_min(p_name, (l_shipdate, p_name)) AS name,
       count(*) AS offers, min(l_shipdate) AS first_arrival
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def merge_stream(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    item = read_stream(spark, sf, "lineitem", "l_shipdate", ["l_partkey", "l_shipdate"])
    found = item.join(part, item.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").alias("arrival"), F.col("p_name").alias("name"),
        F.col("l_partkey").cast("string").alias("book_url"),
    )
    return ST.merge_hits_stream(found, ST.stream_folder(spark, "merge"))


@catalog.add("t02_health_stream", sites.catalog.sql["a03_fold_health"])
def health_stream(spark, sf):
    return ST.health_stream(attempts(read_stream(spark, sf, "events", "ts", EVENT)), ST.stream_folder(spark, "health"))


@catalog.add("t02_health_and_reads_stream", f"""
SELECT source_url, coalesce(ok, 0) AS ok, coalesce(fail, 0) AS fail, last_ok, last_try, coalesce(avg_ms, 0) AS avg_ms,
       coalesce(read_ok, 0) AS read_ok, coalesce(read_fail, 0) AS read_fail
FROM ({sites.catalog.sql["a03_fold_health"]}) h FULL JOIN ({sites.catalog.sql["a04_fold_reads"]}) r USING (source_url)""")
def health_and_reads_stream(spark, sf):
    events = read_stream(spark, sf, "events", "ts", EVENT)
    return ST.health_stream(attempts(events), ST.stream_folder(spark, "health"), reads=reads(events), every=2)


@catalog.add("t01_merge_stream_by_day", """
SELECT regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g') AS key, arg_min(p_name, (l_shipdate, p_name)) AS name,
       count(*) AS offers, min(l_shipdate) AS first_arrival
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def merge_stream_by_day(spark, sf):
    """State rows per span of days that end with the watermark; files come in the order of their days, so nothing is late."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    item = read_stream(spark, sf, "lineitem", "l_shipdate", ["l_partkey", "l_shipdate"])
    found = item.join(part, item.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").cast("timestamp").alias("arrival"), F.col("p_name").alias("name"), F.col("l_partkey").cast("string").alias("book_url"))
    return ST.merge_hits_stream(found, ST.stream_folder(spark, "merge"), lateness="1 day", span="30 days")


@catalog.add("t03_dead_host_stream", sites.catalog.sql["j07_dead_intervals"].replace("21600", "300").replace("43200", "1800"))
def dead_host_stream(spark, sf):
    out = ST.dead_host_stream(attempts(read_stream(spark, sf, "events", "ts", EVENT)), ST.stream_folder(spark, "dead"), lateness=3600)
    return out.select("seq", "host", "dead", "plain_http")


@catalog.add("t04_deadline_stream", sites.catalog.sql["t04_search_deadline"])
def deadline_stream(spark, sf):
    out = ST.deadline_stream(attempts(read_stream(spark, sf, "events", "ts", EVENT)), ST.stream_folder(spark, "deadline"), 7200)
    return out.select("run_id", "seq", "outcome")


@catalog.add("t05_progress_stream", works.RECENT_SQL)
def progress_stream(spark, sf):
    log = works.progress_log(read_stream(spark, sf, "orders", "o_orderkey", ORDER))
    return ST.progress_stream(log, ST.stream_folder(spark, "progress"), 3, **works.RECENT)
