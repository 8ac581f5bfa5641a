"""Support operations over whole tables: orders, returns, complaints, sessions, accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def latest(rows: DataFrame, key: list[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= n)


def return_eligibility(status: Column, placed: Column, as_of: Column) -> tuple[Column, Column, Column]:
    """(reason or null, days left, next action): seven days from the estimated delivery, three days after the order."""
    elapsed = F.floor((as_of.cast("timestamp").cast("double") - placed.cast("timestamp").cast("double") - 3 * 86400) / 86400)
    left = F.lit(7) - elapsed
    reason = (
        F.when(status == "refunded", "already_refunded").when(status == "cancelled", "order_cancelled").when(status.isin("placed", "paid"), "not_yet_shipped")
        .when(status == "shipped", "not_yet_delivered").when(left <= 0, "out_of_no_reason_window")
    )
    action = F.when(reason.isNull(), "self_service_return").when(reason == "not_yet_shipped", "cancel_order").when(reason == "not_yet_delivered", "escalate_intercept").when(reason == "out_of_no_reason_window", "escalate_appeal")
    return reason, F.when(reason.isNull(), F.greatest(left, F.lit(0))).cast("long"), action


def cancel_verdict(status: Column) -> Column:
    """Null if an order may be cancelled; a null status is an unknown order."""
    return F.when(status.isNull(), "order_not_found").when(status == "cancelled", "already_cancelled").when(status == "refunded", "already_refunded").when(~status.isin("placed", "paid"), "not_cancellable_after_shipping")


def timeline(status: Column, placed: Column, carrier: Column) -> Column:
    """Events of a parcel: array of (ts, event), as the status has brought it."""
    at = lambda hours, event, when: F.when(when, F.struct((placed + F.expr(f"INTERVAL {hours} HOURS")).alias("ts"), event.alias("event")))
    return F.array_compact(
        F.array(
            at(0, F.lit("已揽收"), F.lit(True)), at(6, F.concat(F.lit("已发往"), F.coalesce(carrier, F.lit("分拨中心"))), F.lit(True)),
            at(20, F.lit("运输中"), status.isin("shipped", "delivered", "refunded")), at(48, F.lit("已签收"), status == "delivered"), at(72, F.lit("退回仓库,已退款"), status == "refunded"),
        )
    )


def severity(text: Column) -> tuple[Column, Column]:
    """(high, medium or low; the sorted distinct matches that say so)."""
    hits = lambda ps: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + "|".join(ps)), 0)))
    high, medium = hits(rules.SEVERITY_HIGH), hits(rules.SEVERITY_MEDIUM)
    level = F.when(F.size(high) > 0, "high").when(F.size(medium) > 0, "medium").otherwise("low")
    return level, F.when(level == "high", high).when(level == "medium", medium).otherwise(F.array().cast("array<string>"))


def topic(text: Column) -> Column:
    name, pattern = rules.TOPICS[0]
    out = F.when(text.rlike("(?i)" + pattern), name)
    for name, pattern in rules.TOPICS[1:]:
        out = out.when(text.rlike("(?i)" + pattern), name)
    return out.otherwise("other")


def complaint_open(rows: DataFrame, pool: list[str]) -> DataFrame:
    """``rows`` (id, created_at, text) with severity, topic, status, assignee, deadline and a hash for the content."""
    level, _ = severity(F.col("text"))
    hours = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), list(rules.SLA_HOURS.items())[1:], F.when(F.col("severity") == "high", rules.SLA_HOURS["high"]))
    staff = F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.col("id"), F.lit(len(pool))) + 1).cast("int"))
    return rows.withColumn("severity", level).select(
        "id", "created_at", "severity", topic(F.col("text")).alias("topic"), F.when(F.col("severity") == "high", "escalated").otherwise("open").alias("status"),
        F.when(F.col("severity") == "high", staff).alias("assigned_to"), (F.col("created_at") + F.make_interval(hours=hours)).alias("sla_due_at"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"),
    )


def positions(rows: DataFrame, key: str, order: list[str], path: str, size: str | None = None) -> DataFrame:
    """``rows`` whole, with ``position``: the place among the rows of the same ``key``, from 1; with ``size``, ``start`` too: the sizes before.

    Rows are dealt by ranges of key and order and kept in ``path``, so a hot key is spread over tasks: a
    position is a number within a task plus the rows of the key in the tasks before, and so are the sizes.
    """
    rows.repartitionByRange(key, *order).withColumn("task", F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    amounts = {"position": F.lit(1)} | ({"start": F.col(size)} if size else {})
    counts = dealt.groupBy(key, "task").agg(*(F.sum(x).alias(f"sum_{name}") for name, x in amounts.items()))
    before = [F.coalesce(F.sum(f"sum_{name}").over(earlier(key).orderBy("task")), F.lit(0)).alias(f"before_{name}") for name in amounts]
    starts = counts.select(F.col(key).alias("of"), F.col("task").alias("at"), *before)
    placed = dealt.select("*", *(F.coalesce(F.sum(x).over(earlier(key, "task").orderBy(*order)), F.lit(0)).alias(f"within_{name}") for name, x in amounts.items()))
    placed = placed.join(starts, F.col(key).eqNullSafe(F.col("of")) & (F.col("task") == F.col("at")))
    return placed.select(*rows.columns, *((F.col(f"within_{name}") + F.col(f"before_{name}") + int(name == "position")).alias(name) for name in amounts))


def nested(rows: DataFrame, key: str, columns: list[str], order: Column) -> DataFrame:
    """(key, rows array<struct>): the rows of each key in one array, in an order. For keys with few rows by their nature, as an order has requests."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*columns).alias("r"))))
    return rows.groupBy(key).agg(F.transform(listed, lambda x: x["r"]).alias("rows"))


def order_resolve(asked: DataFrame, orders: DataFrame, goods: DataFrame, keywords: list[str], recent: int = 50) -> DataFrame:
    """``asked`` (user_id, remembered, q, ...) with ``order_no`` and ``mode``: the order that an utterance means.

    In this order: one that is remembered, one whose number the text holds, the user's latest, of the ``recent`` ones, with goods that the first
    keyword of the text that has any names, and the user's latest. ``orders`` is (id, no, user_id, placed_at), ``goods`` (id, title).
    A number that no order has is passed over. Repeated utterances keep their own rows.
    """
    spark = asked.sparkSession
    rows = asked.withColumn("_row", F.monotonically_increasing_id()).withColumn("_named", F.upper(F.regexp_extract("q", rules.ORDER_ID, 0)))
    words = F.broadcast(spark.createDataFrame(list(enumerate(keywords)), "_place int, _word string"))  # a fixed list
    own = latest(orders, ["user_id"], recent, F.desc("placed_at"), F.desc("id")).select("id", "no", "user_id", "placed_at")
    held = own.join(goods.select("id", F.lower("title").alias("_title")), "id").join(words, F.col("_title").contains(F.lower("_word")))
    held = held.groupBy("user_id", "_place").agg(F.max_by("no", F.struct("placed_at", "id")).alias("_no"))
    said = rows.select("_row", "user_id", F.lower("q").alias("_q")).join(words, F.col("_q").contains(F.lower("_word"))).join(held, ["user_id", "_place"])
    found = said.groupBy("_row").agg(F.min_by("_no", "_place").alias("_found"))
    newest = own.groupBy("user_id").agg(F.max_by("no", F.struct("placed_at", "id")).alias("_latest"))
    numbers = lambda name: orders.select(F.col("no").alias(name)).distinct()
    rows = rows.join(numbers("_r"), F.col("_r") == F.col("remembered"), "left").join(numbers("_n"), F.col("_n") == F.col("_named"), "left").join(found, "_row", "left").join(newest, "user_id", "left")
    mode = F.when(F.col("_r").isNotNull(), "remembered").when(F.col("_n").isNotNull(), "named").when(F.col("_found").isNotNull(), "keyword").when(F.col("_latest").isNotNull(), "latest").otherwise("none")
    return rows.select(*asked.columns, F.coalesce("_r", "_n", "_found", "_latest").alias("order_no"), mode.alias("mode"))


def invoice_title(text: Column) -> tuple[Column, Column]:
    """(who an invoice is made out to, the tax id): a company named in the text, or personal and without an id."""
    company, tax = F.trim(F.regexp_extract(text, rules.INVOICE_TITLE, 1)), F.regexp_extract(text, rules.TAX_ID, 0)
    return F.when(company != "", company).otherwise(rules.INVOICE_PERSONAL), F.when((company != "") & (tax != ""), tax)


def preference_summary(preferences: DataFrame) -> DataFrame:
    """(user_id, summary): the first six preferences (user_id, key, value, source) of each user by key, by lines, and how many more."""
    rows = latest(preferences, ["user_id"], rules.PREFERENCE_ITEMS, F.col("key"))
    pieces = rules.PREFERENCE_LINE.replace("{key}", "\0key\0").replace("{value}", "\0value\0").replace("{source}", "\0source\0").split("\0")
    text = F.concat(*(F.col(x) if k % 2 else F.lit(x) for k, x in enumerate(pieces)))
    lines = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", text.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    total = preferences.groupBy("user_id").agg((F.count("*") - rules.PREFERENCE_ITEMS).alias("more"))
    before, behind = rules.PREFERENCE_MORE.split("{n}")
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n" + before), F.col("more").cast("string"), F.lit(behind))).otherwise("")
    return lines.join(total, "user_id").select("user_id", F.concat(F.lit(rules.PREFERENCE_HEAD + "\n"), "lines", more).alias("summary"))


def erase(tables: dict[str, tuple[DataFrame, str]], users: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(an audit row for each of a set of users, what survives of each table).

    An audit row is (event_type, user_hash, and how many rows of each table go); the hash is all that is left of the user.
    """
    gone = users.select(F.col(key).alias("_u")).distinct()
    audit, left = gone, {}
    for name, (df, column) in tables.items():
        counts = df.join(gone, F.col(column) == F.col("_u"), "left_semi").groupBy(F.col(column).alias("_of")).agg(F.count("*").alias(name))
        audit = audit.join(counts, F.col("_u") == F.col("_of"), "left").drop("_of")
        left[name] = df.join(gone, F.col(column) == F.col("_u"), "left_anti")
    digest = F.substring(F.sha2(F.col("_u").cast("string"), 256), 1, 16)
    return audit.select(F.lit("gdpr_delete").alias("event_type"), digest.alias("user_hash"), *(F.coalesce(name, F.lit(0)).alias(name) for name in tables)), left


def retention(tables: dict[str, DataFrame], as_of: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """((table_name, expired, kept), what survives of each table): rows older than their table's days go; of returns only those that are over.

    Each table has ``created_at``, ``return_requests`` a ``status`` too. A row without a time stays.
    """
    counts, left = None, {}
    for name, df in tables.items():
        old = F.coalesce(F.col("created_at") < as_of - F.make_interval(days=F.lit(rules.RETENTION_DAYS[name])), F.lit(False))
        if name == "return_requests":
            old &= F.coalesce(F.col("status").isin(rules.RETURN_OVER), F.lit(False))
        row = df.agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept")).select(F.lit(name).alias("table_name"), "expired", "kept")
        counts = row if counts is None else counts.unionByName(row)
        left[name] = df.where(~old)
    return counts, left
