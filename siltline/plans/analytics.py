"""Relational queries: aggregates, windows, joins and set operations over events and what the engine keeps of them.

Every query is one declarative plan over whole tables. ``QUERIES`` has them by name, ``ORACLE_SQL`` the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltline.functions import columns as C

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, dealt out to all of them; a larger one as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def ms(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def host(user: str = "user_id") -> Column:
    u = F.col(user)
    return F.concat_ws(".", F.lit("10"), F.floor(u / 65536).cast("string"), (F.floor(u / 256) % 256).cast("string"), (u % 256).cast("string"))


HOST = "concat('10.', user_id // 65536, '.', (user_id // 256) % 256, '.', user_id % 256)"
DAY = "strftime(ts, '%Y%m%d')"


# ---- aggregates


@query(f"SELECT event_type, {DAY} AS event_day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2")
def vendor_day_rollup(spark, sf_dir):
    """Rows and users by event type and day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyyMMdd").alias("event_day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT count(*) AS frames, count(*) FILTER (event_type <> 'error') AS usable, count(*) FILTER (event_type = 'error') AS quarantined, count(*) FILTER (value IS NULL) AS absent FROM events")
def run_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    return e.agg(F.count("*").alias("frames"), F.count_if(~bad).alias("usable"), F.count_if(bad).alias("quarantined"), F.count_if(F.col("value").isNull()).alias("absent"))


@query(f"SELECT * FROM (SELECT {DAY} AS event_day, {HOST} AS source, count(*) AS n, row_number() OVER (PARTITION BY {DAY} ORDER BY count(*) DESC, {HOST}) AS place FROM events WHERE event_type = 'error' GROUP BY 1, 2) WHERE place <= 10")
def top_sources(spark, sf_dir):
    """The ten sources with most denied events of each day."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    n = e.groupBy(F.date_format("ts", "yyyyMMdd").alias("event_day"), host().alias("source")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_day").orderBy(F.desc("n"), "source")
    return n.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")


@query("SELECT user_id, epoch_us(date_trunc('hour', ts)) // 1000 AS window_ms, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 1")
def deny_spike(spark, sf_dir):
    """Sources over a count of denied events in a tumbling window."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    n = e.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    return n.select("user_id", F.unix_millis("w.start").alias("window_ms"), "n")


@query("WITH c AS (SELECT concat(event_type, '|', CAST(floor(value / 20) * 20 AS BIGINT)) AS signature, count(*) AS n FROM events GROUP BY 1) SELECT signature, n, row_number() OVER o AS place, round(n / sum(n) OVER (), 9) AS share, round(sum(n) OVER o / sum(n) OVER (), 9) AS cumulative FROM c WINDOW o AS (ORDER BY n DESC, signature ROWS UNBOUNDED PRECEDING)")
def discovery_ranking(spark, sf_dir):
    """Clusters by signature, ranked, with share and cumulative share. Windows run over the clusters, not the rows."""
    e = table(spark, sf_dir, "events")
    c = e.groupBy(F.concat("event_type", F.lit("|"), C.arity_bucket("value").cast("string")).alias("signature")).agg(F.count("*").alias("n"))
    o = Window.orderBy(F.desc("n"), "signature")
    total = F.sum("n").over(Window.partitionBy())
    return c.select("signature", "n", F.row_number().over(o).cast("long").alias("place"), F.round(F.col("n") / total, 9).alias("share"), F.round(F.sum("n").over(o.rowsBetween(Window.unboundedPreceding, 0)) / total, 9).alias("cumulative"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) SELECT user_id, count(*) AS frames, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 9) AS success, max_by(event_type, p) AS oldest FROM r WHERE p <= 40 GROUP BY 1")
def drift_window(spark, sf_dir):
    """Parse success over each source's last 40 frames."""
    e = table(spark, sf_dir, "events")
    r = e.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("p <= 40")
    return r.groupBy("user_id").agg(F.count("*").alias("frames"), F.round(F.avg((F.col("event_type") != "error").cast("double")), 9).alias("success"), F.max_by("event_type", "p").alias("oldest"))


@query("WITH r AS (SELECT user_id, event_id, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT user_id, event_id, CASE WHEN bad THEN 'fired' WHEN was THEN 'recovered' ELSE 'ok' END AS state FROM r WHERE was IS NULL OR was <> bad")
def drift_edges(spark, sf_dir):
    """A monitor's state, only where it changes."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad")).withColumn("was", F.lag("bad").over(w))
    state = F.when(F.col("bad"), "fired").when(F.col("was"), "recovered").otherwise("ok")
    return e.where("was IS NULL OR was <> bad").select("user_id", "event_id", state.alias("state"))


@query("WITH d AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0) SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_events, count(*) = count(DISTINCT event_id) AS exactly_once FROM d")
def exactly_once(spark, sf_dir):
    """Rows against distinct events, over a lake with redelivered batches."""
    e = table(spark, sf_dir, "events")
    d = e.unionByName(e.where("event_id % 10 = 0"))
    return d.agg(F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_events")).withColumn("exactly_once", F.col("n_rows") == F.col("n_events"))


@query("WITH d AS (SELECT event_id // 100 AS batch, event_id FROM events), hw AS (SELECT max(event_id) AS m FROM events WHERE event_id < (SELECT count(*) // 2 FROM events)) SELECT batch, count(*) AS n FROM d, hw WHERE event_id > m GROUP BY batch")
def dedupe_hwm(spark, sf_dir):
    """What a redelivered range still adds after a high-water mark; the mark is one row."""
    e = table(spark, sf_dir, "events")
    half = F.broadcast(e.agg((F.floor(F.count("*") / 2)).alias("h")))
    mark = F.broadcast(e.join(half, F.col("event_id") < F.col("h")).agg(F.max("event_id").alias("m")))
    return e.join(mark, F.col("event_id") > F.col("m")).groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("batch")).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey AS nation, count(DISTINCT s_suppkey % 7) AS n_families FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 7) = 1")
def anchor_admission(spark, sf_dir):
    """Values that partition families perfectly."""
    s = table(spark, sf_dir, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count_distinct(F.col("s_suppkey") % 7).alias("n_families")).where("n_families = 1")


@query("SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS n_status, count(*) AS n, count(DISTINCT o_orderstatus) = 1 AS admitted FROM orders GROUP BY 1")
def anchor_partition(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("n_status"), F.count("*").alias("n")).withColumn("admitted", F.col("n_status") == 1)


@query("WITH p AS (SELECT CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS label, CASE WHEN d.n_chars > 2000 THEN 'long' ELSE 'short' END AS guess FROM documents d JOIN labels l USING (doc_id)) SELECT label, count(*) FILTER (guess = 'long') AS n_long, count(*) FILTER (guess = 'short') AS n_short FROM p GROUP BY 1")
def agreement_tally(spark, sf_dir):
    """Verdicts of a heuristic against labels, as a pivot with fixed columns."""
    p = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    p = p.select(F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label"), F.when(F.col("n_chars") > 2000, "n_long").otherwise("n_short").alias("guess"))
    return p.groupBy("label").pivot("guess", ["n_long", "n_short"]).count().na.fill(0, ["n_long", "n_short"])


@query("WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), f AS (SELECT event_type, n, 100.0 * n / sum(n) OVER () AS exact FROM s), r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, event_type) AS p, 100 - sum(floor(exact)) OVER () AS rest FROM f) SELECT event_type, CAST(floor(exact) + CASE WHEN p <= rest THEN 1 ELSE 0 END AS BIGINT) AS weight FROM r")
def weight_apportionment(spark, sf_dir):
    """100 seats among event types by largest remainder; windows run over the types."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    exact = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    f = s.select("event_type", exact.alias("exact")).withColumn("whole", F.floor("exact"))
    r = f.withColumn("p", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("whole")), "event_type"))).withColumn("rest", 100 - F.sum("whole").over(Window.partitionBy()))
    return r.select("event_type", (F.col("whole") + (F.col("p") <= F.col("rest")).cast("long")).cast("long").alias("weight"))


@query("SELECT event_type, count(*) AS runs, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1")
def benchmark_medians(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query("WITH s AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1), m AS (SELECT quantile_cont(n, 0.5) AS m FROM s) SELECT count(*) AS slices, bool_and(abs(n - m) <= 0.1 * m) AS sustained FROM s, m")
def sustained_throughput(spark, sf_dir):
    """Whether every day's count is within a tenth of the median day's."""
    s = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))
    m = F.broadcast(s.agg(F.percentile("n", 0.5).alias("m")))
    return s.join(m, F.lit(True)).agg(F.count("*").alias("slices"), F.bool_and(F.abs(F.col("n") - F.col("m")) <= 0.1 * F.col("m")).alias("sustained"))


@query("WITH t AS (SELECT l_linenumber AS slot, l_shipdate, l_returnflag AS v FROM lineitem) SELECT slot, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS most, count(DISTINCT v) = 1 AS constant, bool_or(contains(v, '/')) AS has_slash, array_to_string(list_slice(list_sort(list(DISTINCT v)), 1, 8), ',') AS samples FROM t GROUP BY 1")
def slot_induction(spark, sf_dir):
    """Structure by slot: distinct values, constants, up to eight sorted samples."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("slot"), F.col("l_returnflag").alias("v"))
    # Distinct (slot, value) pairs first: what is then gathered is each slot's set, and eight of it.
    d = t.groupBy("slot", "v").agg(F.count("*").alias("c"))
    d = d.withColumn("p", F.row_number().over(Window.partitionBy("slot").orderBy("v")))
    return d.groupBy("slot").agg(
        F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.min("v").alias("least"), F.max("v").alias("most"), (F.count("*") == 1).alias("constant"), F.bool_or(F.contains("v", F.lit("/"))).alias("has_slash"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("p") <= 8, F.col("v")))), ",").alias("samples"),
    )


@query(r"WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS k FROM documents) SELECT CASE WHEN regexp_matches(k, '^-?[0-9]+$') THEN 'integer' WHEN regexp_matches(k, '^-?[0-9]+\.[0-9]+$') THEN 'float' WHEN regexp_matches(k, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$') THEN 'ipv4' WHEN contains(k, '://') OR regexp_matches(k, '^[A-Za-z0-9.\-]+:[0-9]+$') THEN 'url' WHEN regexp_matches(k, '^[A-Za-z0-9_.:\-]+$') THEN 'word' ELSE 'text' END AS class, count(*) AS n FROM t GROUP BY 1")
def token_class_histogram(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("k")).where("k <> ''")
    return t.groupBy(C.token_class("k").alias("class")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS p, sum(value) OVER (PARTITION BY event_type ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS s, sum(value) OVER (PARTITION BY event_type) AS total FROM events) SELECT event_type, min(p) AS step FROM r WHERE s >= 0.8 * total GROUP BY 1")
def coverage_step(spark, sf_dir):
    """The first step at which the running share reaches 80 %."""
    o = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    r = table(spark, sf_dir, "events").select("event_type", F.row_number().over(o).cast("long").alias("p"), F.sum("value").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.sum("value").over(Window.partitionBy("event_type")).alias("total"))
    return r.where("s >= 0.8 * total").groupBy("event_type").agg(F.min("p").alias("step"))


@query("SELECT o_orderpriority AS source, count(*) AS decisions, round(sum(o_totalprice), 2) AS effort, round(sum(o_totalprice) / count(*), 4) AS ratio FROM orders GROUP BY 1")
def effort_by_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("decisions"), F.round(F.sum("o_totalprice"), 2).alias("effort"), F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("ratio"))


@query("WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT event_type, sum(n) AS t FROM c GROUP BY 1), r AS (SELECT c.*, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS p FROM c) SELECT r.event_type, user_id, n, t FROM r JOIN a USING (event_type) WHERE p <= 5")
def terms_by_terms(spark, sf_dir):
    """Nested terms: the five largest users of every type."""
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    return c.withColumn("t", F.sum("n").over(w)).withColumn("p", F.row_number().over(w.orderBy(F.desc("n"), "user_id"))).where("p <= 5").drop("p")


@query("SELECT max_by(event_type, n) AS dominant, max(n) AS n FROM (SELECT event_type, count(*) * 1000 - min(ascii(event_type)) AS n FROM events GROUP BY 1)")
def dominant_signal(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") * 1000 - F.min(F.ascii("event_type"))).alias("n"))
    return c.agg(F.max_by("event_type", "n").alias("dominant"), F.max("n").alias("n"))


# ---- windows


@query("WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 97 = 1 THEN 1 ELSE event_id END END AS seq FROM events), l AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s) SELECT user_id, event_id, CASE WHEN seq > prev + 1 THEN 'sequence_gap' ELSE 'sequence_reset' END AS kind, prev + 1 AS expected, seq AS observed, CASE WHEN seq > prev + 1 THEN seq - prev - 1 END AS missing FROM l WHERE seq IS NOT NULL AND prev IS NOT NULL AND seq <> prev + 1")
def sequence_gaps(spark, sf_dir):
    """Gaps and resets by source in arrival order; a frame without a sequence leaves the last one as it is."""
    e = table(spark, sf_dir, "events")
    seq = F.when(F.col("event_id") % 5 != 0, F.when(F.col("event_id") % 97 == 1, F.lit(1)).otherwise(F.col("event_id")))
    return continuity_gaps(e.select("user_id", "event_id", seq.alias("seq")), "user_id", "event_id", "seq")


def continuity_gaps(df: DataFrame, peer: str, order: str, seq: str) -> DataFrame:
    w = Window.partitionBy(peer).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("prev", F.last(seq, ignorenulls=True).over(w)).where(F.col(seq).isNotNull() & F.col("prev").isNotNull() & (F.col(seq) != F.col("prev") + 1))
    gap = F.col(seq) > F.col("prev") + 1
    return out.select(peer, order, F.when(gap, "sequence_gap").otherwise("sequence_reset").alias("kind"), (F.col("prev") + 1).alias("expected"), F.col(seq).alias("observed"), F.when(gap, F.col(seq) - F.col("prev") - 1).alias("missing"))


@query("WITH l AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT user_id, event_id AS last_event, t AS last_seen, next - t AS silence_ms FROM l WHERE next - t >= 43200000")
def silence_periods(spark, sf_dir):
    """Sources that were silent for twelve hours or more."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    l = table(spark, sf_dir, "events").select("user_id", "event_id", ms().alias("at")).withColumn("next", F.lead("at").over(w))
    return l.where("next - at >= 43200000").select("user_id", F.col("event_id").alias("last_event"), F.col("at").alias("last_seen"), (F.col("next") - F.col("at")).alias("silence_ms"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of every event, and version 2 of those that a correction changed."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.lit(1).alias("version"))
    return e.unionByName(e.where("event_id % 10 = 0").select("event_id", "event_type", (F.col("value") + 1).alias("value"), F.lit(2).alias("version")))


VERSIONS = "WITH v AS (SELECT event_id, event_type, value, 1 AS version FROM events UNION ALL SELECT event_id, event_type, value + 1, 2 FROM events WHERE event_id % 10 = 0)"


@query(f"{VERSIONS} SELECT event_type, version, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY version DESC) AS p FROM v) WHERE p = 1 GROUP BY 1, 2")
def latest_version(spark, sf_dir):
    """The last version of every event, by aggregation: no sort of the lake."""
    v = versions(spark, sf_dir)
    last = v.groupBy("event_id").agg(F.max(F.struct("version", "event_type", "value")).alias("l")).select("event_id", "l.*")
    return last.groupBy("event_type", "version").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"{VERSIONS} SELECT a.event_id, 'value' AS path, CAST(a.value AS VARCHAR) AS stored, CAST(b.value AS VARCHAR) AS derived FROM (SELECT * FROM v WHERE version = 1) a JOIN (SELECT * FROM v WHERE version = 2) b USING (event_id) WHERE a.value IS DISTINCT FROM b.value AND a.value < 100 AND b.value < 100")
def version_diff(spark, sf_dir):
    """Paths in which two versions of an event differ."""
    v = versions(spark, sf_dir)
    return paths_that_differ(v.where("version = 1").where("value < 100"), v.where("version = 2").where("value < 100"), "event_id", ["event_type", "value"], inner=True)


def paths_that_differ(stored: DataFrame, derived: DataFrame, key: str, columns: list[str], inner: bool = False) -> DataFrame:
    """(key, path, stored, derived): full outer over (key, path), or inner over keys that both have."""
    pairs = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias(name)) for c in columns))).alias("p")).select(key, "p.*")
    both = pairs(stored, "stored").join(pairs(derived, "derived"), [key, "path"], "inner" if inner else "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("derived"))).select(key, "path", "stored", "derived")


@query("WITH s AS (SELECT user_id, event_id, 40 + length(props) AS len, event_id // 1000 AS segment FROM events) SELECT segment, count(*) AS n, max(start + len) AS bytes, sum(start) AS starts FROM (SELECT *, sum(len) OVER (PARTITION BY segment ORDER BY event_id ROWS UNBOUNDED PRECEDING) - len AS start FROM s) GROUP BY 1")
def segment_offsets(spark, sf_dir):
    """Byte offsets within segments as running sums."""
    s = table(spark, sf_dir, "events").select("event_id", (40 + F.length("props")).alias("len"), F.floor(F.col("event_id") / 1000).cast("long").alias("segment"))
    o = Window.partitionBy("segment").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("start", F.sum("len").over(o) - F.col("len"))
    return s.groupBy("segment").agg(F.count("*").alias("n"), F.max(F.col("start") + F.col("len")).alias("bytes"), F.sum("start").alias("starts"))


@query("WITH c AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id, round((i + 0.5) / n, 12) AS place FROM c")
def even_interleave(spark, sf_dir):
    """The place of each row in a deterministic even interleave of the types."""
    w = Window.partitionBy("event_type")
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.row_number().over(w.orderBy("event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return e.select("event_type", "event_id", F.round((F.col("i") + 0.5) / F.col("n"), 12).alias("place"))


# ---- joins, sets, sorts


@query("SELECT e.event_type, n.n_name AS nation, count(*) AS n FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2")
def trace_join(spark, sf_dir):
    """Chained lookups from an event to its source's record."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("c"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    out = e.join(c, F.col("c_custkey") == F.col("user_id")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return out.groupBy("event_type", F.col("n_name").alias("nation")).agg(F.sum("c").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def blocklist_hits(spark, sf_dir):
    """Events of listed sources."""
    listed = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(listed, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def unknown_peers(spark, sf_dir):
    """Known sources that sent nothing: the anti-join behind subset tests."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(e, "c_custkey", "left_anti")


@query("WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT s.k AS a, d.k AS b FROM s FULL OUTER JOIN d ON s.k = d.k) SELECT count(a) AS sent, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS delivered, count(*) FILTER (b IS NULL) AS lost, count(*) FILTER (a IS NULL) AS unexpected, count(*) FILTER (b IS NULL OR a IS NULL) = 0 AS reconciled FROM b")
def count_reconciliation(spark, sf_dir):
    """What was sent against what arrived, from two tables: delivered, lost, and arrived without having been sent."""
    sent = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("s"))
    there = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("d", F.lit(True))
    s, d = F.col("s").isNotNull(), F.col("d").isNotNull()
    out = sent.join(there, "k", "full_outer").agg(F.count_if(s).alias("sent"), F.count_if(s & d).alias("delivered"), F.count_if(s & ~d).alias("lost"), F.count_if(~s).alias("unexpected"))
    return out.withColumn("reconciled", F.col("lost") + F.col("unexpected") == 0)


@query("WITH s AS (SELECT DISTINCT event_id // 40 AS segment FROM events), c AS (SELECT segment, unnest(CASE WHEN segment % 4 = 0 AND segment > 0 THEN [segment // 4, segment // 4 - 1] ELSE [segment // 4] END) AS checkpoint FROM s WHERE segment % 5 <> 0) SELECT s.segment, count(checkpoint) AS checkpoints, min(checkpoint) AS first FROM s LEFT JOIN c ON c.segment = s.segment GROUP BY 1")
def covering_checkpoints(spark, sf_dir):
    """How many checkpoints name each segment; a checkpoint names its own segments and the first of the next, some are named by none."""
    from siltline.operators.provenance import covering

    segments = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 40).cast("long").alias("segment")).distinct()
    own = F.floor(F.col("segment") / 4)
    named = segments.where("segment % 5 <> 0").select("segment", F.explode(F.when((F.col("segment") % 4 == 0) & (F.col("segment") > 0), F.array(own, own - 1)).otherwise(F.array(own))).alias("checkpoint"))
    return covering(segments, named.groupBy("checkpoint").agg(F.collect_list("segment").alias("segments")))


@query("(SELECT event_type, 'activated' AS change FROM (SELECT DISTINCT event_type FROM events WHERE event_id % 2 = 0 EXCEPT SELECT DISTINCT event_type FROM events WHERE value < 0)) UNION ALL (SELECT event_type, 'deactivated' FROM (SELECT DISTINCT event_type FROM events WHERE value < 0 EXCEPT SELECT DISTINCT event_type FROM events WHERE event_id % 2 = 0))")
def pack_changes(spark, sf_dir):
    """What a reload activates and deactivates."""
    e = table(spark, sf_dir, "events")
    now, before = e.where("event_id % 2 = 0").select("event_type").distinct(), e.where("value < 0").select("event_type").distinct()
    return now.exceptAll(before).withColumn("change", F.lit("activated")).unionByName(before.exceptAll(now).withColumn("change", F.lit("deactivated")))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def latest_rows(spark, sf_dir):
    """The newest 25 (the feature is the limit): a top-k without a full sort."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p <= 60")
def source_listing(spark, sf_dir):
    """The last 60 outcomes of every source."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("p", F.row_number().over(w)).where("p <= 60").select("user_id", "event_id")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 10")
def onboarding_trigger(spark, sf_dir):
    """Sources with ten or more failures of one kind."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 10")


# ---- scalar functions over whole tables


@query("SELECT doc_id, concat('sha256:', sha256(text)) AS raw_hash FROM documents")
def sha256_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.evidence_hash("text").alias("raw_hash"))


@query("WITH n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) ELSE epoch_us(ts) * 1000 END AS x, epoch_us(ts) AS us FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'ms' WHEN 2 THEN 'us' ELSE 'ns' END AS unit, CASE WHEN event_id % 4 = 0 THEN us // 1000000 * 1000 ELSE us // 1000 END AS time_ms FROM n")
def epoch_auto(spark, sf_dir):
    """Numbers at four precisions, recognised and brought to milliseconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = lambda by: F.floor(us / F.lit(by).cast("decimal(20,0)")).cast("long")
    k = F.col("event_id") % 4
    n = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, whole(1_000_000)).when(k == 1, whole(1000)).when(k == 2, us).otherwise(us * 1000).alias("x"))
    return n.select("event_id", C.epoch_precision("x").alias("unit"), C.epoch_auto("x").alias("time_ms"))


@query(f"SELECT event_id, {HOST} AS source FROM events WHERE user_id BETWEEN 0 AND 127")
def cidr_filter(spark, sf_dir):
    """Addresses within 10.0.0.0/25."""
    e = table(spark, sf_dir, "events").select("event_id", host().alias("source"))
    return e.where(C.in_cidr("source", "10.0.0.0/25"))


@query(r"""SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CAST(p_retailprice AS DOUBLE) AS x, p_size % 2 = 0 AS b, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type END AS e, concat('aa:bb:cc:', substr(md5(CAST(p_partkey AS VARCHAR)), 1, 2), ':', substr(md5(CAST(p_partkey AS VARCHAR)), 3, 2), ':', substr(md5(CAST(p_partkey AS VARCHAR)), 5, 2)) AS mac, NULL::BIGINT AS refused FROM part""")
def coercions(spark, sf_dir):
    """Texts to typed values; what doesn't fit is null, never a guess."""
    p, h = table(spark, sf_dir, "part"), F.upper(F.md5(F.col("p_partkey").cast("string")))
    mac = F.concat_ws("-", F.lit("AA"), F.lit("BB"), F.lit("CC"), F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2))
    yes = F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("OFF")
    return p.select("p_partkey", C.to_int(F.col("p_size").cast("string")).alias("n"), C.to_float(F.col("p_retailprice").cast("string")).alias("x"), C.to_bool(yes).alias("b"), C.to_enum("p_type", ["SMALL", "LARGE"]).alias("e"), C.to_mac(mac).alias("mac"), C.to_int(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("refused"))


@query("SELECT p_partkey, p_name AS from_base64, p_name AS from_hex, concat(p_name, '+/ &') AS from_url FROM part")
def decoders(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.col("p_name").cast("binary")
    text = lambda c: c.cast("string")
    url = F.replace(F.url_encode(F.concat("p_name", F.lit("+/ &"))), F.lit("+"), F.lit("%20"))
    return p.select("p_partkey", text(C.decode(F.base64(name), "base64")).alias("from_base64"), text(C.decode(F.hex(name), "hex")).alias("from_hex"), text(C.decode(url, "url")).alias("from_url"))


@query(f"SELECT event_id, concat('CEF:0|siltline|siltline|1.0|4001|Network \\| Activity/', event_id % 7, '|', least((event_id % 7) * 2, 10), '|rt=', epoch_us(ts) // 1000, ' src=', {HOST}, ' spt=', user_id, ' msg=a\\=b\\\\c externalId=ev_', lpad(CAST(event_id AS VARCHAR), 26, '0')) AS record FROM events")
def cef_encode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ext = {"rt": ms(), "src": host(), "spt": F.col("user_id"), "msg": F.lit("a=b\\c"), "dst": F.lit(""), "externalId": C.event_id("event_id")}
    k = F.col("event_id") % 7
    return e.select("event_id", C.cef(F.lit(4001), F.lit("Network | Activity"), k, k, ext).alias("record"))


@query(r"""SELECT event_id, concat('<134>1 ', strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0'), 'Z host', user_id, ' siltline - ocsf [siltline@32473 event_id="ev\"', event_id, '\]" class_uid="4001"] ', props) AS frame FROM events""")
def rfc5424_encode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.rfc5424(ms(), F.concat(F.lit("host"), F.col("user_id").cast("string")), {"event_id": F.concat(F.lit('ev"'), F.col("event_id").cast("string"), F.lit("]")), "class_uid": F.lit(4001)}, F.col("props")).alias("frame"))


@query("""SELECT event_id, concat('{"index":{"_index":"events-', 4000 + event_id % 3, '","_id":"', event_id, '"}}', chr(10), props, chr(10)) AS action, length(props) AS n FROM events""")
def bulk_encode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.bulk(F.col("event_id").cast("string"), 4000 + F.col("event_id") % 3, F.col("props")).alias("action"), F.length("props").cast("long").alias("n"))


@query("SELECT c_custkey, regexp_replace(concat(c_name, ':', c_custkey), ':[^:]*$', '') AS host, c_custkey // 20 * 20 AS bucket, strftime(make_timestamp(c_custkey * 86400000000), '%Y%m%d') AS event_day FROM customer")
def labels_of_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.host_of(F.concat("c_name", F.lit(":"), F.col("c_custkey").cast("string"))).alias("host"), C.arity_bucket("c_custkey").alias("bucket"), C.event_day(F.col("c_custkey") * 86_400_000).alias("event_day"))


#: SQL: 32-bit FNV-1a of an ASCII text.
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: CAST(ord(substr({x}, i, 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(f"SELECT p_partkey, {FNV.format(x='p_name')} AS h FROM part")
def fnv1a_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.fnv1a("p_name").alias("h"))


@query(f"SELECT {FNV.format(x='n')} % 8 AS shard, count(*) AS n FROM (SELECT concat('src', c_custkey) AS n FROM customer) GROUP BY 1")
def shard_of_files(spark, sf_dir):
    """Files by shard of their source, which is what stands before the first underscore (FNV-1a)."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("src"), F.col("c_custkey").cast("string"), F.lit("_part_"), "c_mktsegment", F.lit(".log"))
    return c.groupBy(C.shard(name, 8).alias("shard")).agg(F.count("*").alias("n"))
