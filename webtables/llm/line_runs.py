"""Line dedup: suffix order of line ids by distributed prefix doubling, common prefixes, later copies of repeated runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions._cols import once
from webtables.llm._tables import Scratch

NO_ID = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"
#: Words that make a line a run by itself.
LONG_WORDS = 20
KEY = ["did", "th"]
#: What follows the last line: before every line.
NO_LINE = -(1 << 63)
#: A suffix is known by its first line and ``off``, the suffixes from the same line that are smaller; ``bh``, ``boff`` name the suffix ``k`` lines on.
NAME = ["h", "off"]
FULL = [*NAME, "bh", "boff"]
SUFFIX = [*KEY, "s", *NAME, "before", "left"]


def _content(lines: Column, long_words: int = LONG_WORDS) -> Column:
    """Line numbers and ids of the lines that hold a word, in order, and which of them have ``long_words`` words."""
    # only a line of so many characters can have so many words
    wordy = lambda line: F.when(F.length(line) >= 2 * long_words - 1, F.regexp_count(line, F.lit(WORD)) >= long_words).otherwise(F.lit(False))
    all_lines = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.rlike(WORD).alias("told"), F.xxhash64(line).alias("h"), wordy(line).alias("wordy")))
    return F.filter(all_lines, lambda x: x["told"])


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under numbered names, so that no name of theirs clashes, and the keys."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    return numbered.select("*", F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).withColumn(
        "th", F.xxhash64("text"))


def repeated_lines(rows: DataFrame, scratch: Scratch, min_lines: int, long_words: int) -> DataFrame:
    """did, th, s: content lines in a run of ``min_lines`` lines that also starts earlier, or that are long and also stand earlier."""
    places = rows.select(*KEY, once(lines=_content(F.split("text", "\n"), long_words))).select(*KEY, "lines", F.posexplode("lines")).select(
        *KEY, F.col("pos").alias("s"), F.col("col.h").alias("h"), F.get("lines", F.col("pos") - 1)["h"].alias("before"),
        (F.size("lines") - F.col("pos")).alias("left"), F.col("col.wordy").alias("wordy"))
    places = scratch.keep("lines", places)
    starts = run_starts(places.drop("wordy"), scratch, min_lines)
    in_runs = starts.select(*KEY, F.explode(F.sequence(F.col("s"), F.col("s") + (min_lines - 1))).alias("s"))
    alone = _later(places.filter("wordy").select(*KEY, "s", "h"), ["h"])
    return in_runs.unionByName(alone)


def _later(places: DataFrame, by: list[str]) -> DataFrame:
    """Places whose values ``by`` stand at an earlier place too."""
    back = places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "s")).alias("first")).filter("n > 1").select(
        *[F.col(c).alias(f"_{c}") for c in by], "first")
    found = places.join(back, [places[c] == back[f"_{c}"] for c in by])
    return found.filter(F.struct(*KEY, "s") != F.col("first")).select(*KEY, "s").distinct()


def _ranged(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` dealt by ranges of ``order``, written, with the number of its range as ``pid``: equal values may fill many ranges."""
    return scratch.keep(name, df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))


def _ahead(state: DataFrame, k: int) -> DataFrame:
    """``state`` with the names of the suffixes ``k`` lines on, less documents without a suffix in play, but for those just settled."""
    doc = Window.partitionBy(*KEY)
    on = doc.orderBy("s").rangeBetween(k, k)
    named = state.select(
        *SUFFIX, "active", "fresh", F.coalesce(F.first("h").over(on), F.lit(NO_LINE)).alias("bh"), F.coalesce(F.first("off").over(on), F.lit(-1)).cast("long").alias("boff"),
        F.max("active").over(doc).alias("live"))
    return named.filter("live OR fresh")


def _refine(active: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Suffixes ordered by ``k`` lines, ordered by 2k: new ``off``; ``active`` unless it stands alone or has ended.

    Rows are dealt by ranges and numbered inside; a range hands on where its last group began. No group meets in one task.
    """
    ranged = _ranged(active, [*FULL, *KEY, "s"], scratch, f"ranged{k}")
    name, full = F.struct(*NAME), F.struct(*FULL)
    sorted_rows = Window.partitionBy("pid").orderBy(*FULL)
    numbered = ranged.select(
        "pid", *SUFFIX, "bh", "boff", F.rank().over(Window.partitionBy("pid").orderBy(*NAME)).alias("from_name"), F.rank().over(sorted_rows).alias("from_full"),
        (F.coalesce(F.lag(full).over(sorted_rows) == full, F.lit(False)) | F.coalesce(F.lead(full).over(sorted_rows) == full, F.lit(False))).alias("alike"))
    edges = _edges(numbered.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"), F.min(full).alias("first"), F.max(full).alias("last"), F.max("from_name").alias("name_at"), F.max("from_full").alias("full_at")))
    opened = lambda col: F.struct(*[F.col(col)[c] for c in NAME])
    edges = edges.select(
        "p", "shift", "first", "last", F.lag("last").over(Window.orderBy("p")).alias("above"), F.lead("first").over(Window.orderBy("p")).alias("below"),
        F.min(F.col("shift") + F.col("name_at")).over(Window.partitionBy(opened("last"))).alias("name_at"),
        F.min(F.col("shift") + F.col("full_at")).over(Window.partitionBy("last")).alias("full_at"))
    # where the group that goes on in this range began
    edges = edges.select(
        "*", F.when(opened("above") == opened("first"), F.lag("name_at").over(Window.orderBy("p"))).alias("name_from"),
        F.when(F.col("above") == F.col("first"), F.lag("full_at").over(Window.orderBy("p"))).alias("full_from"))
    placed = numbered.join(edges, numbered["pid"] == edges["p"])
    goes_on = lambda begun, first, value, here: F.when((value == first) & begun.isNotNull(), begun).otherwise(F.col("shift") + here)
    name_from = goes_on(F.col("name_from"), opened("first"), name, F.col("from_name"))
    full_from = goes_on(F.col("full_from"), F.col("first"), full, F.col("from_full"))
    crosses = ((full == F.col("first")) & (full == F.col("above"))) | ((full == F.col("last")) & (full == F.col("below")))
    tied = F.col("alike") | F.coalesce(crosses, F.lit(False))
    return placed.select(
        *KEY, "s", "h", (F.col("off") + full_from - name_from).alias("off"), "before", "left", (tied & (F.col("boff") >= 0)).alias("active"), F.lit(True).alias("fresh"))


def _edges(sizes: DataFrame) -> DataFrame:
    """One row per range, as ``p``, with ``shift``, the rows of the ranges before."""
    return sizes.withColumn("shift", F.sum("n").over(Window.orderBy("pid")) - F.col("n")).withColumnRenamed("pid", "p")


def suffix_states(places: DataFrame, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """(k, suffixes ordered by their first k lines) for k = 1, 2, 4, ... until all that share a line with another differ or have ended.

    Round k sorts suffixes by their own name and that of the suffix k lines on. Names count the smaller suffixes of a group, so those of
    settled suffixes stay right; only the others are sorted again, beside the settled ones of their documents. A line that stands
    once has no common prefix with any other: its suffix is looked up, never sorted.
    """
    often = places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("x"))
    named = places.join(often, places["h"] == often["x"], "left").select(
        *KEY, "s", "h", F.lit(0).cast("long").alias("off"), "before", "left", F.col("x").isNotNull().alias("active"), F.lit(False).alias("fresh"))
    # a document stored twice is one
    stored = F.row_number().over(Window.partitionBy(*KEY, "s").orderBy("s"))
    state = scratch.keep("state1", _ahead(named.withColumn("stored", stored).filter("stored = 1").drop("stored"), 1))
    states, k = [(1, state)], 1
    while not state.filter("active").isEmpty():
        refined = _refine(state.filter("active"), scratch, k)
        settled = state.filter("live AND NOT active").select(*SUFFIX, "active", F.lit(False).alias("fresh"))
        k *= 2
        state = scratch.keep(f"state{k}", _ahead(refined.unionByName(settled), k))
        states.append((k, state))
    return states


def suffix_order(places: DataFrame, scratch: Scratch) -> DataFrame:
    """did, th, s, at, lcp: the suffixes that share a line with another, numbered in suffix order, and the lines shared with the one before.

    Where the lines before two neighbours are alike too, the suffixes one line up are neighbours and share one line more, so only the others
    are compared: by descending powers of two, in the states of the rounds. Equal suffixes are in order of their places.
    """
    states = suffix_states(places, scratch)
    ends = [s.filter("fresh AND NOT active").select(*SUFFIX, F.lit(k // 2).alias("top")) for k, s in states[1:]]
    if not ends:
        return places.select(*KEY, "s", F.lit(0).cast("long").alias("at"), F.lit(0).alias("lcp")).limit(0)
    done = ends[0]
    for more in ends[1:]:
        done = done.unionByName(more)
    by = [*NAME, *KEY, "s"]
    ranged = _ranged(done, by, scratch, "order")
    row = F.struct(*by, "before", "top")
    order = Window.partitionBy("pid").orderBy(*by)
    edges = _edges(ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.max(row).alias("last")))
    edges = edges.select("p", "shift", F.lag("last").over(Window.orderBy("p")).alias("above"))
    numbered = ranged.select("*", F.row_number().over(order).alias("row"), F.lag(row).over(order).alias("q"))
    placed = numbered.join(edges, numbered["pid"] == edges["p"]).select(
        *SUFFIX, "top", (F.col("shift") + F.col("row")).alias("at"), F.coalesce("q", "above").alias("q"))
    q, top = F.col("q"), F.least("top", F.col("q")["top"])
    told = (
        F.when(q.isNull() | (q["h"] != F.col("h")), 0).when(q["off"] == F.col("off"), F.col("left")).when(top == 1, 1))
    alike = F.coalesce(F.col("before") == q["before"], F.lit(False))
    pairs = scratch.keep("pairs", placed.select(
        *KEY, "s", "at", told.alias("told"), alike.alias("alike"), top.alias("top"), q["did"].alias("qd"), q["th"].alias("qt"), q["s"].alias("qs")))
    unknown = "told IS NULL AND NOT alike"
    known = pairs.filter(f"NOT ({unknown})").select(*KEY, "s", "at", F.col("told").alias("lcp"))
    compared = _compare(pairs.filter(unknown), states, scratch)
    up = Window.partitionBy(*KEY).orderBy("s")
    lcp = F.last(F.col("lcp") + F.col("s"), ignorenulls=True).over(up) - F.col("s")
    return known.unionByName(compared).select(*KEY, "s", "at", lcp.alias("lcp"))


def _compare(pairs: DataFrame, states: list[tuple[int, DataFrame]], scratch: Scratch) -> DataFrame:
    """did, th, s, at, lcp of neighbours: a power of two is added where the suffixes that far on have one name at that round."""
    tops = {row.top for row in pairs.select("top").distinct().collect()}
    pairs = pairs.select(*KEY, "s", "at", "top", "qd", "qt", "qs", F.lit(0).alias("lcp"))
    for k, state in reversed(states):
        if not tops or k > max(tops):
            continue
        names = [state.select(*[F.col(c).alias(f"{side}{c}") for c in (*KEY, "s", *NAME, "left")]) for side in "xy"]
        now = pairs.filter(F.col("top") >= k)
        for side, names_of, (d, t, s) in zip("xy", names, ((*KEY, "s"), ("qd", "qt", "qs")), strict=True):
            now = now.join(names_of, (now[d] == names_of[f"{side}did"]) & (now[t] == names_of[f"{side}th"]) & (now[s] + now["lcp"] == names_of[f"{side}s"]), "left")
        same = F.coalesce((F.col("xh") == F.col("yh")) & (F.col("xoff") == F.col("yoff")), F.lit(False))
        added = F.when(same, F.least(F.lit(k), "xleft")).otherwise(0)
        now = now.select(*[c for c in pairs.columns if c != "lcp"], (F.col("lcp") + added).alias("lcp"))
        pairs = scratch.keep(f"compared{k}", now.unionByName(pairs.filter(F.col("top") < k)))
    return pairs.select(*KEY, "s", "at", "lcp")


def run_starts(places: DataFrame, scratch: Scratch, min_lines: int) -> DataFrame:
    """did, th, s: content lines at which a run of ``min_lines`` starts that also starts earlier.

    Neighbours in suffix order with that many lines in common form intervals; the first place of each stays. Overlapping starts add
    up to maximal runs.
    """
    order = suffix_order(places, scratch).withColumn("apart", (F.col("lcp") < min_lines).cast("long"))
    ranged = _ranged(order, ["at"], scratch, "intervals")
    edges = _edges(ranged.groupBy("pid").agg(F.sum("apart").alias("n")))
    numbered = ranged.withColumn("number", F.sum("apart").over(Window.partitionBy("pid").orderBy("at")))
    intervals = numbered.join(edges, numbered["pid"] == edges["p"]).select(*KEY, "s", (F.col("number") + F.col("shift")).alias("interval"))
    return _later(intervals, ["interval"])


def drop_repeated_runs(docs: DataFrame, min_lines: int = 2, long_words: int = LONG_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its repeated lines, and n_lines, n_removed beside them as ``_lines``.

    Lines are split at \\n; lines without a word take no part and stay. A run of ``min_lines`` or more content
    lines that also starts earlier (smaller doc_id, or the same text further up) goes, and so does a line of ``long_words`` words or
    more that also stands earlier, whatever its neighbours; runs are judged on the input. Null texts are empty (one line, nothing removed) and come back as null. Rows that repeat a doc_id and
    a text are one document stored twice: they do not repeat each other. Texts of one doc_id are in order of their
    hashes; a null doc_id comes last. An empty table gives an empty result. All other columns pass unchanged.

    Lines are known by 64-bit ids, runs by as many ids as they have lines. Counts are summed per task, so a line in a
    third of all documents is one row per task; joins back to it are skewed joins that Spark may split. Suffixes are sorted by
    ranges that cut through groups of any size.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs)
    starts = scratch.keep("starts", repeated_lines(rows, scratch, min_lines, long_words).groupBy(F.col("did").alias("d"), F.col("th").alias("t")).agg(
        F.array_sort(F.collect_set("s")).alias("starts")))
    # one plan for every size: a table of starts that fits a broadcast today outgrows it with the corpus
    joined = rows.join(starts.hint("merge"), (rows["did"] == starts["d"]) & (rows["th"] == starts["t"]), "left")
    own = [f"c{i}" for i in range(len(docs.columns))]
    lines = joined.select(*own, "starts", once(lines=F.split("text", "\n")))
    gone = F.when(F.col("starts").isNotNull(), F.col("starts"))
    told = F.when(F.col("starts").isNotNull(), _content(F.col("lines"))["i"])
    marked = lines.select(*own, "lines", once(gone=gone, told=told))
    numbers = marked.select(*own, "lines", once(gone=F.transform("gone", lambda s: F.get("told", s))))
    flags = F.flatten(F.transform("gone", lambda i, k: F.concat(
        F.array_repeat(F.lit(False), i - F.coalesce(F.get("gone", k - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    flagged = numbers.select(*own, "lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n"), once(flags=flags))
    told_text = own[docs.columns.index("text")]
    kept = F.when(F.col("n") > 0, F.array_join(F.filter("lines", lambda _, j: ~F.coalesce(F.get("flags", j), F.lit(False))), "\n")).otherwise(F.col(told_text).cast("string"))
    out = flagged.select(
        *[(kept if c == told_text else F.col(c)).alias(c) for c in own],
        F.struct(F.size("lines").cast("long").alias("n_lines"), F.greatest("n", F.lit(0)).cast("long").alias("n_removed")).alias("_lines"))
    return out.toDF(*docs.columns, "_lines")
