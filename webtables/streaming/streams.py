"""Streaming forms of the merge, health, dead-host, deadline and progress operators.

Keyed state lives in Spark's state store (merge), where it ends with the watermark, or in tables written once per
micro-batch. Large states are delta logs: a batch writes the keys it changed, and every few batches the log is compacted. A batch
replayed after a failure reads what was there before it and overwrites its own folder, so it gives the same result. A
batch is reduced with the batch operators, which split hot keys; no per-key Python state is involved. A run that
finds no data gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from webtables.functions.text import title_key
from webtables.operators.health import apply_deadline, flag_dead, fold_health, fold_reads, open_windows
from webtables.operators.joins import recent_items
from webtables.session import ensure_checkpoint_dir

FIRST_STAMP = 1_000_000_000_000  # milliseconds; only the order of the stamps counts


def stream_folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream under the shared checkpoint folder."""
    run = spark.sql("select uuid()").first()[0]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{run}"


def write_part(part: DataFrame, path: str, files: int, number: int) -> None:
    """Write a table as exactly ``files`` files, stamped two seconds after those of the part ``number`` before it."""
    spark = part.sparkSession
    part.repartition(files).write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    made = lambda: [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("part-")]
    for _ in range(files - len(made())):  # fewer rows than files: partitions without rows leave none
        spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(path)
    for file in made():
        fs.setTimes(file, FIRST_STAMP + 2000 * number, -1)


def read_batch(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The table written by one micro-batch, if there is one."""
    if batch < 0:
        return None
    jvm, target = spark._jvm, f"{path}/batch={batch}"
    location = jvm.org.apache.hadoop.fs.Path(target)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(target) if fs.exists(location) else None


def _listed(spark: SparkSession, path: str, kind: str = "batch") -> dict[int, str]:
    """Folders ``kind=n`` under a path that were written to their end, by n; none if there is no such path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    found = {int(n.split("=")[1]): f"{path}/{n}" for n in names if n.startswith(f"{kind}=")}
    return {n: f for n, f in found.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))}


def read_all(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All batches of a table with their number; an empty table before the first."""
    schema = StructType([*schema.fields, *StructType.fromDDL("batch int").fields])
    return spark.read.schema(schema).option("basePath", path).parquet(*_listed(spark, path).values()) if _listed(spark, path) else spark.createDataFrame([], schema)


class DeltaLog:
    """Rows of keys that change batch by batch: a batch writes all rows of the keys it changed, ``delta=n``.

    The rows of a key are those of the newest batch that wrote it. Every ``every`` batches the log is written whole, ``full=n``,
    and what lies before the full table before that one goes.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, every: int = 10):
        self.spark, self.path, self.keys, self.schema, self.every = spark, path, list(keys), schema, every

    def before(self, batch: int, touched: DataFrame | None = None) -> DataFrame:
        """The rows as they were before a batch, of the ``touched`` keys only where these are given."""
        full = {n: f for n, f in _listed(self.spark, self.path, "full").items() if n < batch}
        base = max(full, default=-1)
        deltas = {n: f for n, f in _listed(self.spark, self.path, "delta").items() if base < n < batch}
        used = deltas | ({base: full[base]} if full else {})
        if not used:
            return self.spark.createDataFrame([], self.schema)
        # one scan, never a union of scans: Spark takes a union of joins by key for grouped by that key, which adaptive plans may break
        number = F.regexp_extract(F.col("_metadata.file_path"), "/(?:full|delta)=([0-9]+)/[^/]*$", 1).cast("long")
        rows = self.spark.read.schema(self.schema).parquet(*used.values()).withColumn("_batch", number)
        if touched is not None:
            rows = rows.join(touched, self.keys, "left_semi")
        newest = rows.groupBy(*self.keys).agg(F.max("_batch").alias("_newest"))
        return rows.join(newest, self.keys).filter("_batch = _newest").select(*self.schema.names)

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/delta={batch}")
        if batch % self.every == self.every - 1:
            self.before(batch + 1).write.mode("overwrite").parquet(f"{self.path}/full={batch}")
            older = sorted(n for n in _listed(self.spark, self.path, "full") if n < batch)
            for kind in ("full", "delta"):
                drop_batches(self.spark, self.path, older[-1] if older else 0, kind)

    def written(self, batch: int) -> DataFrame:
        """The rows a batch wrote: all of the keys it changed."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/delta={batch}")

    def now(self) -> DataFrame:
        return self.before(1 << 62)


def drop_batches(spark: SparkSession, path: str, before: int, kind: str = "batch") -> None:
    """Remove snapshots older than batch ``before``; a repeated batch still finds the one it builds on."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(root):
        name = found.getPath().getName()
        if name.startswith(f"{kind}=") and int(name.split("=")[1]) < before:
            fs.delete(found.getPath(), True)


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_available(
    stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str, mode: str = "append", progress: list | None = None
) -> None:
    """Process everything available through ``step``; ``progress`` receives what Spark says of each batch."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)


def merge_hits_stream(
    hits: DataFrame, folder: str, arrival: str = "arrival", name: str = "name", url: str = "book_url",
    by: Sequence[str] = (), lateness: str | None = None, span: str = "1 day", progress: list | None = None,
) -> DataFrame:
    """Works growing as sites report: the name stays that of the first arrival.

    With ``lateness`` a work is kept as one state row per ``span`` of arrivals; the row leaves the state once the watermark, ``lateness`` behind
    the newest arrival, has passed its span, and its last update stays in the table of results. Hits that come later than that are
    left out. Without ``lateness`` the state has a row per work for good, and nothing is late.
    """
    spark = hits.sparkSession
    usable = (F.coalesce(F.col(name), F.lit("")) != "") & (F.coalesce(F.col(url), F.lit("")) != "")
    valid = hits.filter(usable).withColumn("key", title_key(name)).filter("key <> ''")
    spans = []
    if lateness:
        valid = valid.withWatermark(arrival, lateness)
        spans = [F.window(arrival, span).alias("span")]
    grouped = valid.groupBy(*by, "key", *spans).agg(
        F.min_by(F.col(name), F.struct(arrival, name)).alias("name"),
        F.count(F.lit(1)).alias("offers"),
        F.min(arrival).alias("first_arrival"),
    )
    out = f"{folder}/out"
    run_available(grouped, lambda df, n: _write(df, out, n), folder, "update", progress)
    newest = latest(read_all(spark, out, grouped.schema), [*by, "key", *(["span"] if lateness else [])])
    if not lateness:
        return newest
    return newest.groupBy(*by, "key").agg(
        F.min_by("name", F.struct("first_arrival", "name")).alias("name"), F.sum("offers").alias("offers"), F.min("first_arrival").alias("first_arrival"))


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of a table of updates."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
    return newest.select(*keys, "v.*")


HEALTH = StructType([StructField(n, t) for n, t in (
    ("source_url", StringType()), ("ok", LongType()), ("fail", LongType()), ("last_ok", TimestampType()), ("last_try", TimestampType()),
    ("avg_ms", LongType()), ("read_ok", LongType()), ("read_fail", LongType()))])


def health_stream(attempts: DataFrame, folder: str, seconds: int = 3600, reads: DataFrame | None = None, every: int = 10, progress: list | None = None) -> DataFrame:
    """Health of every site kept across batches, from a stream of attempts and, with ``reads(source_url, chapters)``, one of read outcomes.

    Both streams change one state, a row per site: the counts, last times and average of ``fold_health`` and the outcomes of ``fold_reads``. A
    batch reads and writes the sites it has rows of. Attempts of a later batch are taken to be later.
    """
    spark = attempts.sparkSession
    own = ["source_url", "ts", "seq", "reachable", "had_results", "ms"]
    log = DeltaLog(spark, f"{folder}/state", ["source_url"], HEALTH, every)
    rows = attempts.select(*own, F.lit(None).cast("boolean").alias("chapters"))
    if reads is not None:
        rows = rows.unionByName(reads.select("source_url", F.coalesce("chapters", F.lit(False)).alias("chapters")), allowMissingColumns=True)

    def step(df: DataFrame, n: int) -> None:
        touched = df.select("source_url").distinct()
        prior = log.before(n, touched)
        folded = fold_health(df.filter("chapters IS NULL").select(*own), prior.select(*HEALTH.names[:6]), seconds=seconds)
        opened = fold_reads(df.filter("chapters IS NOT NULL").select("source_url", "chapters"))
        counts = ("read_ok", "read_fail")
        kept = prior.select("source_url", *[F.col(c).alias(f"_{c}") for c in counts])
        joined = folded.join(opened, "source_url", "full_outer").join(kept, "source_url", "left")  # folded has all sites of the state before
        joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in counts})
        log.write(n, joined.select("source_url", *[F.coalesce(c, F.lit(0)).alias(c) if c not in ("last_ok", "last_try") else F.col(c) for c in HEALTH.names[1:]]))

    run_available(rows, step, folder, progress=progress)
    now = log.now()
    return now if reads is not None else now.drop("read_ok", "read_fail")


def dead_host_stream(attempts: DataFrame, folder: str, lateness: int) -> DataFrame:
    """Attempts flagged against earlier failures of this and earlier batches.

    The state holds the windows that can still matter to attempts up to ``lateness`` seconds late; a later attempt misses
    those already dropped.
    """
    spark, out, state = attempts.sparkSession, f"{folder}/out", f"{folder}/state"

    def step(df: DataFrame, n: int) -> None:
        session = df.sparkSession
        before = read_batch(session, state, n - 1)
        _write(flag_dead(df, initial=before), out, n)
        now = session.read.parquet(f"{out}/batch={n}")
        newest = now.agg(F.max("ts")).first()[0]
        opened = open_windows(now)
        kept = opened if before is None else opened.unionByName(before)
        if newest is not None:
            ends = F.greatest("opens_dead", "opens_http")
            kept = kept.filter(ends > F.lit(newest) - F.expr(f"interval {int(lateness)} seconds"))
        _write(kept, state, n)
        drop_batches(session, state, n - 1)

    run_available(attempts, step, folder)
    flags = StructType.fromDDL("dead boolean, plain_http boolean, opens_dead timestamp, opens_http timestamp")
    return read_all(spark, out, StructType([*attempts.schema.fields, *flags.fields])).drop("batch", "opens_dead", "opens_http")


def deadline_stream(attempts: DataFrame, folder: str, budget: int = 60, idle: int | None = None, every: int = 10) -> DataFrame:
    """Attempts marked timed out against the start of their run, which may lie in an earlier batch.

    The state has a row per run; a batch reads and writes the runs it has attempts of. A start that comes after attempts of its run were
    marked does not change them. With ``idle`` a run without an attempt for so many seconds beyond its budget has ended: an attempt
    after that starts a new one.
    """
    spark, out = attempts.sparkSession, f"{folder}/out"
    kinds = {f.name: f.dataType for f in attempts.schema.fields}
    schema = StructType([StructField("run_id", kinds["run_id"]), StructField("started", kinds["ts"]), StructField("seen", kinds["ts"])])
    log = DeltaLog(spark, f"{folder}/state", ["run_id"], schema, every)

    def step(df: DataFrame, n: int) -> None:
        own = df.groupBy("run_id").agg(F.min("ts").alias("started"), F.max("ts").alias("seen"))
        prior = log.before(n, own.select("run_id"))
        if idle is not None:
            first = own.select("run_id", F.col("started").alias("_own"))
            prior = prior.join(first, "run_id").filter(F.col("_own") <= F.col("seen") + F.expr(f"interval {int(idle + budget)} seconds")).drop("_own")
        kept = prior.select("run_id", F.col("started").alias("_started"), F.col("seen").alias("_seen"))
        log.write(n, own.join(kept, "run_id", "left").select("run_id", F.least("started", "_started").alias("started"), F.greatest("seen", "_seen").alias("seen")))
        starts = log.written(n).select("run_id", "started")
        _write(apply_deadline(df, budget, starts=starts), out, n)

    run_available(attempts, step, folder)
    first = [f for f in attempts.schema.fields if f.name == "run_id"]
    rest = [f for f in attempts.schema.fields if f.name != "run_id"]
    return read_all(spark, out, StructType([*first, *rest, *StructType.fromDDL("started timestamp, outcome string").fields])).drop("batch")


def progress_stream(log: DataFrame, folder: str, k: int = 200, user: str = "user_id", every: int = 10, progress: list | None = None, **columns) -> DataFrame:
    """Latest position per item, the newest ``k`` per user, kept across batches. A batch reads and writes the users it has rows of."""
    schema = StructType([*log.schema.fields, *StructType.fromDDL("place int").fields])
    state = DeltaLog(log.sparkSession, f"{folder}/state", [user], schema, every)

    def step(df: DataFrame, n: int) -> None:
        prior = state.before(n, df.select(user).distinct())
        state.write(n, recent_items(df.unionByName(prior.select(*df.columns)), k, user=user, **columns))

    run_available(log, step, folder, progress=progress)
    return state.now()
