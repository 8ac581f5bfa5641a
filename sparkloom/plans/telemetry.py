"""Registered queries: counters, latency, budgets, rate limits, streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..streaming import streams
from .registry import register, table
from .support import FOLD, POOL, as_events

_STATUS = "CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 0 THEN 429 WHEN event_id % 20 = 0 THEN 404 ELSE 200 END"


def requests(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 50 == 0, 429).when(F.col("event_id") % 20 == 0, 404).otherwise(200)
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("path"), status.alias("status"), "value", (F.col("value") / 10).alias("seconds"))


REQ = f"(SELECT event_id, ts, user_id, event_type AS path, {_STATUS} AS status, value, value / 10 AS seconds FROM events)"


@register(f"SELECT path, status, count(*) AS n FROM {REQ} GROUP BY 1, 2")
def request_counts(spark, sf):
    return requests(spark, sf).groupBy("path", "status").agg(F.count("*").alias("n"))


_BOUNDS = "[" + ", ".join(f"{b}::DOUBLE" for b in rules.LATENCY_BOUNDS) + ", 'inf'::DOUBLE]"
HIST = f"(SELECT path, b AS le, count(*) FILTER (seconds <= b) AS n FROM {REQ}, (SELECT unnest({_BOUNDS}) AS b) GROUP BY 1, 2)"


def histogram(spark, sf):
    """One aggregate per bound in one pass, then a row per bound."""
    bounds = [*rules.LATENCY_BOUNDS, float("inf")]
    wide = requests(spark, sf).groupBy("path").agg(*(F.count_if(F.col("seconds") <= b).alias(f"b{k}") for k, b in enumerate(bounds)))
    return wide.select("path", F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)))).alias("x")).select("path", "x.le", "x.n")


@register(f"SELECT path, CASE WHEN isinf(le) THEN 1e9 ELSE le END AS le, n FROM {HIST}")
def latency_histogram(spark, sf):
    return histogram(spark, sf).select("path", F.when(F.col("le") == float("inf"), 1e9).otherwise(F.col("le")).alias("le"), "n")


@register(f"""WITH h AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY path) AS total FROM {HIST} WINDOW w AS (PARTITION BY path ORDER BY le)),
q AS (SELECT path, q, min(le) AS le FROM h, (SELECT unnest([0.5, 0.95, 0.99]) AS q) WHERE n >= q * total GROUP BY 1, 2)
SELECT q.path, q.q::DOUBLE AS q, round(CASE WHEN isinf(q.le) THEN h.low ELSE h.low + (h.le - h.low) * (q.q * total - below) / greatest(n - below, 1) END, 6)::DOUBLE AS seconds FROM q JOIN h ON h.path = q.path AND h.le = q.le""")
def histogram_quantile(spark, sf):
    w = Window.partitionBy("path").orderBy("le")
    h = histogram(spark, sf).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("total", F.max("n").over(Window.partitionBy("path")))
    rows = h.withColumn("q", F.explode(F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))).where("n >= q * total")
    first = rows.groupBy("path", "q").agg(F.min_by(F.struct("le", "low", "below", "n", "total"), "le").alias("x"))
    value = F.when(F.col("x.le") == float("inf"), F.col("x.low")).otherwise(F.col("x.low") + (F.col("x.le") - F.col("x.low")) * (F.col("q") * F.col("x.total") - F.col("x.below")) / F.greatest(F.col("x.n") - F.col("x.below"), F.lit(1)))
    return first.select("path", "q", F.round(value, 6).alias("seconds"))


@register(f"SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS start, path, count(*) AS n, round(count(*) / 60.0, 6)::DOUBLE AS rate FROM {REQ} GROUP BY 1, 2")
def request_rate(spark, sf):
    rows = requests(spark, sf).groupBy(F.window("ts", "1 minute").alias("w"), "path").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "path", "n", F.round(F.col("n") / 60.0, 6).alias("rate"))


@register(f"SELECT start, count(*) AS n, count(*) FILTER (status BETWEEN 400 AND 499) AS n4xx, count(*) FILTER (status >= 500) AS n5xx, count(*) FILTER (status = 429) AS n429 FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS start, status FROM {REQ}, (SELECT unnest([0, 1, 2, 3, 4]) AS k)) GROUP BY 1")
def error_rate(spark, sf):
    """Five-minute windows that slide by one."""
    s = F.col("status")
    rows = requests(spark, sf).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.count_if(s.between(400, 499)).alias("n4xx"), F.count_if(s >= 500).alias("n5xx"), F.count_if(s == 429).alias("n429"))
    return rows.select(F.col("w.start").alias("start"), "n", "n4xx", "n5xx", "n429")


@register(f"SELECT path AS task, CASE WHEN event_id % 2 = 0 THEN 'prompt' ELSE 'completion' END AS kind, count(*) AS calls, coalesce(sum(CASE WHEN status = 200 THEN floor(value) ELSE 0 END), 0)::BIGINT AS tokens FROM {REQ} GROUP BY 1, 2")
def token_usage(spark, sf):
    kind = F.when(F.col("event_id") % 2 == 0, "prompt").otherwise("completion")
    return requests(spark, sf).groupBy(F.col("path").alias("task"), kind.alias("kind")).agg(F.count("*").alias("calls"), F.sum(F.when(F.col("status") == 200, F.floor("value")).otherwise(0)).cast("long").alias("tokens"))


@register("SELECT layer, hits, total, round(hits / greatest(total, 1e-9), 6)::DOUBLE AS rate FROM (SELECT CASE WHEN event_type = 'click' THEN 'answer' WHEN event_type = 'view' THEN 'retrieval' ELSE 'other' END AS layer, count(*) FILTER (value > 20) AS hits, count(*) AS total FROM events GROUP BY 1)")
def cache_hit_rate(spark, sf):
    layer = F.when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "view", "retrieval").otherwise("other")
    rows = table(spark, sf, "events").groupBy(layer.alias("layer")).agg(F.count_if(F.col("value") > 20).alias("hits"), F.count("*").alias("total"))
    return rows.withColumn("rate", F.round(F.col("hits") / F.greatest(F.col("total"), F.lit(1e-9)), 6))


@register("SELECT doc_id, length(text) // 3 > 8192 - 2048 AS over_budget FROM documents")
def prompt_budget_check(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.floor(F.length("text") / 3) > 8192 - 2048).alias("over_budget"))


@register("SELECT event_id, used, used + floor(value) > 60 AS over_limit FROM (SELECT event_id, value, coalesce(sum(floor(value)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM events)")
def tenant_budget_window(spark, sf):
    """Tokens of the hour before each request, without what came at the same moment."""
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, -1)
    rows = e.select("event_id", "value", F.coalesce(F.sum(F.floor("value")).over(w), F.lit(0)).cast("long").alias("used"))
    return rows.select("event_id", "used", (F.col("used") + F.floor("value") > 60).alias("over_limit"))


PERIODS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def limit_of(spec: str) -> tuple[int, int]:
    """(number, microseconds) of a limit such as ``3/hour`` or ``200 / minutes``."""
    count, _, period = spec.partition("/")
    period = period.strip().lower().rstrip("s")
    if not count.strip().isdigit() or period not in PERIODS:
        raise ValueError(f"not a limit: {spec!r}")
    return int(count), PERIODS[period] * 1_000_000


def limited(rows, spec: str = "3/hour"):
    """(event_id, allowed, remaining, retry_after): fewer than the limit accepted in the window before, whose first moment counts;
    refused ones do not count. ``retry_after`` is seconds until the oldest leaves the window. Rows stream through, sorted by key."""
    limit, window_us = limit_of(spec)
    rows = rows.repartition("key").sortWithinPartitions("key", "us", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen = object(), deque()
        for pdf in batches:
            out = []
            for k, us in zip(pdf["key"], pdf["us"]):
                if k != key:
                    key, seen = k, deque()
                while seen and seen[0] < us - window_us:
                    seen.popleft()
                if len(seen) >= limit:
                    out.append((False, 0, max(0, seen[0] + window_us - us) / 1e6))
                else:
                    seen.append(us)
                    out.append((True, limit - len(seen), 0.0))
            made = pd.DataFrame(out, columns=["allowed", "remaining", "retry_after"])
            yield pd.concat([pdf[["event_id"]].reset_index(drop=True), made], axis=1)

    return rows.select("key", "us", "event_id").mapInPandas(run, "event_id long, allowed boolean, remaining long, retry_after double")


@register("""WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
f AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS seen, false AS allowed, 0::BIGINT AS remaining, 0::DOUBLE AS retry_after FROM (SELECT DISTINCT key FROM e)
UNION ALL SELECT key, n, event_id, CASE WHEN len(w) < 3 THEN list_append(w, us) ELSE w END, len(w) < 3, greatest(0, 2 - len(w)), CASE WHEN len(w) < 3 THEN 0 ELSE greatest(0, w[1] + 3600000000 - us) / 1e6 END
FROM (SELECT f.key, e.n, e.event_id, e.us, list_filter(f.seen, lambda x: x >= e.us - 3600000000) AS w FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1))
SELECT event_id, allowed, remaining, retry_after FROM f WHERE n > 0""")
def rate_limit_decide(spark, sf):
    e = table(spark, sf, "events")
    return limited(e.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id"))


@register("SELECT date_trunc('minute', ts) AS start, event_type, count(*) AS n, sum((value > 50)::INT)::BIGINT AS n_slow, count(*) / 60.0::DOUBLE AS rate, " + "list_value(" + ", ".join(f"count(*) FILTER (value / 10 <= {b})" for b in rules.LATENCY_BOUNDS) + ", count(*)) AS buckets, round(sum(value / 10), 6) AS seconds FROM events GROUP BY 1, 2")
def metrics_stream(spark, sf):
    """Counts, slow ones, rates and a latency histogram by minute and path from a stream, of all windows: those still open give what they hold so far."""
    e = streams.stream_of(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streams.windowed_counts(e, "ts", "event_type", more=[F.sum((F.col("value") > 50).cast("long")).alias("n_slow"), *streams.histogram(F.col("value") / 10, rules.LATENCY_BOUNDS)])
    return streams.latest(spark, counts, "start", "event_type").withColumn("rate", F.col("n") / 60.0).withColumn("seconds", F.round("seconds", 6))


@register(FOLD)
def complaint_stream(spark, sf):
    """Turns arriving as a stream, classified, and the last that was told of each complaint."""
    from ..streaming.complaints import ROCKS, complaint_states

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = streams.scratch(spark, "complaints")

    def keep(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    states = complaint_states(as_events(streams.stream_of(spark, f"{sf}/conversations.parquet")), POOL)
    streams.finish(states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", streams.scratch(spark, "complaints-check")))
    told = F.struct("status", "escalated", "severity", "assigned_to", "sla_due_at", "n_events")
    return spark.read.parquet(out).groupBy("complaint_id").agg(F.max_by(told, F.struct("batch", "n_events", "overdue")).alias("x")).select("complaint_id", "x.*")


@register("SELECT r.conv_id AS complaint_id, r.turn, c.c_name AS owner FROM conversations r JOIN customer c ON c.c_custkey = r.conv_id % 1000 WHERE r.role = 'assistant'")
def inbox_stream(spark, sf):
    """Replies joined to their owners as they arrive."""
    owners = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("owner"))
    r = streams.stream_of(spark, f"{sf}/conversations.parquet").where("role = 'assistant'").select(F.col("conv_id").alias("complaint_id"), "turn", (F.col("conv_id") % 1000).alias("k"))
    return streams.collected(spark, r.join(owners, F.col("k") == F.col("c_custkey")).select("complaint_id", "turn", "owner"))
