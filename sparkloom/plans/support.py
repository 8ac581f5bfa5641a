"""Registered queries: orders, returns, complaints, sessions, accounts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import complaints as complaints_of
from ..operators import support
from .registry import register, scratch, table
from .retrieval import TURNS, _first_rule_sql, said, turns

ORDERS = "(SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'paid' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS placed_at FROM orders)"
AS_OF = "1998-08-05"


def orders(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "shipped").otherwise("paid")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderdate").alias("placed_at"))


def items(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    return table(spark, sf, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "title", F.col("l_quantity").cast("int").alias("qty"))


@register(f"WITH o AS (SELECT * FROM {ORDERS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, id DESC) <= 5) SELECT o.user_id, o.id, status, cents / 100.0::DOUBLE AS total_yuan, count(l_partkey) AS n_items, string_agg(p_name || ' ×' || l_quantity::INT, ' + ' ORDER BY l_linenumber, l_partkey, p_name || ' ×' || l_quantity::INT) AS items FROM o LEFT JOIN lineitem ON l_orderkey = o.id LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def user_recent_orders(spark, sf):
    """The five latest orders of each user with their items."""
    recent = support.latest(orders(spark, sf), ["user_id"], 5, F.desc("placed_at"), F.desc("id"))
    lines = items(spark, sf).join(recent.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("title", F.lit(" ×"), F.col("qty").cast("string")).alias("t")))).alias("x"))
    rows = recent.join(lines, "id", "left")
    return rows.select("user_id", "id", "status", (F.col("cents") / 100.0).alias("total_yuan"), F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_items"), F.array_join(F.transform("x", lambda e: e["t"]), " + ").alias("items"))


@register(f"WITH o AS (SELECT * FROM {ORDERS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, id DESC) <= 50) SELECT user_id, id FROM o WHERE id IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), 'ring')) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, id DESC) = 1")
def order_keyword_latest(spark, sf):
    """Of each user's last fifty orders, the latest that holds an item with the keyword."""
    recent = support.latest(orders(spark, sf), ["user_id"], 50, F.desc("placed_at"), F.desc("id")).drop("nth")
    hits = items(spark, sf).where(F.lower("title").contains("ring")).select("id")
    return support.latest(recent.join(hits, "id", "left_semi"), ["user_id"], 1, F.desc("placed_at"), F.desc("id")).select("user_id", "id")


#: Words for goods, in the order they are looked for.
KEYWORDS = ["Widget", "Gizmo", "ring", "Bolt", "gear"]
#: First turns as they are said: some name an order by its number, some a kind of goods; every fifth conversation remembers an order.
_ASKED = f"(SELECT conv_id, conv_id % 1500 AS user_id, CASE WHEN conv_id % 5 = 0 THEN 'JD' || lpad((conv_id * 4)::VARCHAR, 10, '0') END AS remembered, q || CASE conv_id % 4 WHEN 1 THEN ' order jd' || lpad((conv_id * 4)::VARCHAR, 10, '0') || '?' WHEN 2 THEN ' where is my ' || {KEYWORDS}[(conv_id % 5)::INT + 1] || ' or the GEAR' ELSE '' END AS q FROM {TURNS} WHERE turn = 0)"


@register(f"""WITH o AS (SELECT *, 'JD' || lpad(id::VARCHAR, 10, '0') AS no FROM {ORDERS}), u AS {_ASKED}, l AS (SELECT user_id, max_by(no, (placed_at, id)) AS latest FROM o GROUP BY 1),
n AS (SELECT u.*, upper(nullif(regexp_extract(q, '(?i){rules.ORDER_ID.replace("(?i)", "")}'), '')) AS named FROM u), recent AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, id DESC) <= 50),
k AS (SELECT unnest({KEYWORDS}) AS word, unnest(range({len(KEYWORDS)})) AS place), g AS (SELECT user_id, place, max_by(no, (placed_at, id)) AS found FROM recent JOIN lineitem ON l_orderkey = id JOIN part ON p_partkey = l_partkey, k WHERE contains(lower(p_name), lower(word)) GROUP BY 1, 2),
w AS (SELECT conv_id, min_by(found, g.place) AS found FROM u JOIN k ON contains(lower(q), lower(word)) JOIN g ON g.user_id = u.user_id AND g.place = k.place GROUP BY 1)
SELECT n.conv_id, coalesce(r.no, e.no, found, latest) AS order_no, CASE WHEN r.no IS NOT NULL THEN 'remembered' WHEN e.no IS NOT NULL THEN 'named' WHEN found IS NOT NULL THEN 'keyword' WHEN latest IS NOT NULL THEN 'latest' ELSE 'none' END AS mode FROM n LEFT JOIN o r ON r.no = remembered LEFT JOIN o e ON e.no = named LEFT JOIN w ON w.conv_id = n.conv_id LEFT JOIN l ON l.user_id = n.user_id""")
def order_resolve(spark, sf):
    """The order that an utterance means: one remembered, one named in it, the latest with goods it names, or the latest; and which of these."""
    c = F.col("conv_id")
    number = lambda x: F.format_string("JD%010d", x)
    o = orders(spark, sf).withColumn("no", number(F.col("id")))
    more = F.when(c % 4 == 1, F.concat(F.lit(" order jd"), F.lpad((c * 4).cast("string"), 10, "0"), F.lit("?"))).when(c % 4 == 2, F.concat(F.lit(" where is my "), F.element_at(F.array(*map(F.lit, KEYWORDS)), (c % 5 + 1).cast("int")), F.lit(" or the GEAR"))).otherwise("")
    u = turns(spark, sf).where("turn = 0").select("conv_id", (c % 1500).alias("user_id"), F.when(c % 5 == 0, number(c * 4)).alias("remembered"), F.concat("q", more).alias("q"))
    goods = items(spark, sf).select("id", "title")
    return support.order_resolve(u, o, goods, KEYWORDS).select("conv_id", "order_no", "mode")


@register("SELECT k AS key, o_orderstatus AS status FROM (SELECT c_custkey * 3 AS k FROM customer) LEFT JOIN orders ON o_orderkey = k")
def key_lookup(spark, sf):
    keys = table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("key"))
    return keys.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), "key", "left")


@register(f"SELECT o.id, string_agg(p_name || ' ×' || l_quantity::INT, ' + ' ORDER BY l_linenumber, l_partkey, p_name || ' ×' || l_quantity::INT) || ' | ' || CASE WHEN status = 'paid' THEN 'not shipped' ELSE 'SF' || o.id END AS card FROM {ORDERS} o JOIN lineitem ON l_orderkey = o.id JOIN part ON p_partkey = l_partkey GROUP BY o.id, status")
def order_card(spark, sf):
    lines = items(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("title", F.lit(" ×"), F.col("qty").cast("string")).alias("t")))).alias("x"))
    track = F.when(F.col("status") == "paid", "not shipped").otherwise(F.concat(F.lit("SF"), F.col("id").cast("string")))
    return orders(spark, sf).join(lines, "id").select("id", F.concat(F.array_join(F.transform("x", lambda e: e["t"]), " + "), F.lit(" | "), track).alias("card"))


@register(f"SELECT id, e.event, placed_at + to_hours(e.h) AS ts FROM (SELECT id, placed_at, unnest(list_filter([{{'h': 0, 'event': '已揽收', 'w': true}}, {{'h': 6, 'event': '已发往分拨中心', 'w': true}}, {{'h': 20, 'event': '运输中', 'w': status IN ('shipped', 'delivered', 'refunded')}}, {{'h': 48, 'event': '已签收', 'w': status = 'delivered'}}, {{'h': 72, 'event': '退回仓库,已退款', 'w': status = 'refunded'}}], lambda x: x.w)) AS e FROM {ORDERS})")
def package_timeline(spark, sf):
    e = support.timeline(F.col("status"), F.col("placed_at"), F.lit(None).cast("string"))
    return orders(spark, sf).select("id", F.explode(e).alias("e")).select("id", "e.event", "e.ts")


_LEFT = f"(7 - floor((epoch(TIMESTAMP '{AS_OF}') - epoch(placed_at) - 259200) / 86400))"
_REASON = f"CASE WHEN status = 'refunded' THEN 'already_refunded' WHEN status = 'cancelled' THEN 'order_cancelled' WHEN status IN ('placed', 'paid') THEN 'not_yet_shipped' WHEN status = 'shipped' THEN 'not_yet_delivered' WHEN {_LEFT} <= 0 THEN 'out_of_no_reason_window' END"


@register(f"SELECT id, reason, CASE WHEN reason IS NULL THEN l::BIGINT END AS days_left, CASE WHEN reason IS NULL THEN 'self_service_return' WHEN reason = 'not_yet_shipped' THEN 'cancel_order' WHEN reason = 'not_yet_delivered' THEN 'escalate_intercept' WHEN reason = 'out_of_no_reason_window' THEN 'escalate_appeal' END AS action FROM (SELECT id, {_REASON} AS reason, {_LEFT} AS l FROM {ORDERS})")
def return_eligibility(spark, sf):
    reason, left, action = support.return_eligibility(F.col("status"), F.col("placed_at"), F.lit(AS_OF))
    return orders(spark, sf).select("id", reason.alias("reason"), left.alias("days_left"), action.alias("action"))


REQUESTS = f"(SELECT c_custkey AS request_id, c_custkey * 3 AS order_id, CASE c_custkey % 5 WHEN 0 THEN 'refund' WHEN 1 THEN 'return' WHEN 2 THEN 'exchange' WHEN 3 THEN 'price_protect' ELSE 'gift' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'late' END AS reason FROM customer)"


def requests(spark, sf):
    c = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("refund", "return", "exchange", "price_protect", "gift"))), (c % 5 + 1).cast("int"))
    return table(spark, sf, "customer").select(c.alias("request_id"), (c * 3).alias("order_id"), kind.alias("kind"), F.when(c % 3 == 0, " ").otherwise("late").alias("reason"))


_APPLIED = f"(SELECT request_id, r.order_id, kind, CASE WHEN kind NOT IN ('refund', 'return', 'exchange', 'price_protect') THEN 'invalid_kind' WHEN o.id IS NULL THEN 'order_not_found' ELSE 'pending' END AS state, CASE WHEN kind IN ('refund', 'return') THEN cents END AS refund_cents, CASE WHEN trim(reason) = '' THEN '用户未提供原因' ELSE trim(reason) END AS reason FROM {REQUESTS} r LEFT JOIN {ORDERS} o ON o.id = r.order_id)"


def applied(spark, sf):
    rows = requests(spark, sf).join(orders(spark, sf).select("id", "cents"), F.col("id") == F.col("order_id"), "left")
    state = F.when(~F.col("kind").isin("refund", "return", "exchange", "price_protect"), "invalid_kind").when(F.col("id").isNull(), "order_not_found").otherwise("pending")
    return rows.select("request_id", "order_id", "kind", state.alias("state"), F.when(F.col("kind").isin("refund", "return"), F.col("cents")).alias("refund_cents"), F.when(F.trim("reason") == "", "用户未提供原因").otherwise(F.trim("reason")).alias("reason"))


@register(f"SELECT * FROM {_APPLIED}")
def return_request_apply(spark, sf):
    return applied(spark, sf)


@register(f"SELECT request_id // 4 * 12 AS order_id, count(*) AS n, count(*) FILTER (state = 'pending') AS n_pending, string_agg(request_id || ':' || kind || ':' || state || ':' || coalesce(refund_cents::VARCHAR, '-'), ';' ORDER BY request_id DESC) AS requests FROM {_APPLIED} GROUP BY 1")
def return_requests_by_order(spark, sf):
    """All requests of each order, here four in a row, nested, the newest first."""
    rows = applied(spark, sf).withColumn("order_id", (F.floor(F.col("request_id") / 4) * 12).cast("long"))
    nested = support.nested(rows, "order_id", ["request_id", "kind", "state", "refund_cents"], F.col("request_id").cast("long") * -1)
    line = lambda r: F.concat_ws(":", r["request_id"].cast("string"), r["kind"], r["state"], F.coalesce(r["refund_cents"].cast("string"), F.lit("-")))
    return nested.select("order_id", F.size("rows").cast("long").alias("n"), F.size(F.filter("rows", lambda r: r["state"] == "pending")).cast("long").alias("n_pending"), F.array_join(F.transform("rows", line), ";").alias("requests"))


@register(f"SELECT request_id, CASE WHEN request_id % 2 = 0 THEN CASE WHEN s IN ('cancelled', 'completed', 'rejected') THEN s ELSE 'cancelled' END ELSE CASE WHEN s = 'cancelled' THEN 'pending' ELSE s END END AS status FROM (SELECT request_id, CASE request_id % 7 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'completed' WHEN 2 THEN 'rejected' ELSE 'pending' END AS s FROM {REQUESTS})")
def return_state_apply(spark, sf):
    """Even requests are to be cancelled, odd ones reopened; what may not be stays."""
    k = F.col("request_id") % 7
    s = F.when(k == 0, "cancelled").when(k == 1, "completed").when(k == 2, "rejected").otherwise("pending")
    new = F.when(F.col("request_id") % 2 == 0, F.when(s.isin("cancelled", "completed", "rejected"), s).otherwise("cancelled")).otherwise(F.when(s == "cancelled", "pending").otherwise(s))
    return requests(spark, sf).select("request_id", new.alias("status"))


@register(f"SELECT request_id, a.order_id, CASE WHEN status IS NULL THEN 'order_not_found' WHEN status NOT IN ('placed', 'paid') THEN 'not_cancellable_after_shipping' END AS refusal, CASE WHEN status IN ('placed', 'paid') THEN cents END AS refunded_cents FROM {REQUESTS} a LEFT JOIN {ORDERS} o ON o.id = a.order_id")
def order_cancel_apply(spark, sf):
    rows = requests(spark, sf).join(orders(spark, sf), F.col("id") == F.col("order_id"), "left").withColumn("refusal", support.cancel_verdict(F.col("status")))
    return rows.select("request_id", "order_id", "refusal", F.when(F.col("refusal").isNull(), F.col("cents")).alias("refunded_cents"))


INVOICES = f"(SELECT id AS order_id, user_id, cents, CASE WHEN id % 3 = 0 THEN 'issued' WHEN id % 3 = 1 THEN 'requested' ELSE 'cancelled' END AS state, placed_at AS requested_at FROM {ORDERS} WHERE id % 4 = 0)"


def invoices(spark, sf):
    state = F.when(F.col("id") % 3 == 0, "issued").when(F.col("id") % 3 == 1, "requested").otherwise("cancelled")
    return orders(spark, sf).where("id % 4 = 0").select(F.col("id").alias("order_id"), "user_id", "cents", state.alias("state"), F.col("placed_at").alias("requested_at"))


@register(f"SELECT request_id, r.order_id, CASE WHEN o.id IS NULL THEN 'order_not_found' WHEN i.order_id IS NOT NULL THEN 'duplicate' WHEN o.status NOT IN ('delivered', 'shipped') THEN 'not_eligible' ELSE 'requested' END AS verdict, o.cents AS amount_cents FROM {REQUESTS} r LEFT JOIN {ORDERS} o ON o.id = r.order_id LEFT JOIN {INVOICES} i ON i.order_id = r.order_id AND i.state <> 'cancelled'")
def invoice_request_apply(spark, sf):
    open_ = invoices(spark, sf).where("state <> 'cancelled'").select(F.col("order_id").alias("iid"))
    rows = requests(spark, sf).join(orders(spark, sf), F.col("id") == F.col("order_id"), "left").join(open_, F.col("iid") == F.col("order_id"), "left")
    verdict = F.when(F.col("id").isNull(), "order_not_found").when(F.col("iid").isNotNull(), "duplicate").when(~F.col("status").isin("delivered", "shipped"), "not_eligible").otherwise("requested")
    return rows.select("request_id", "order_id", verdict.alias("verdict"), F.col("cents").alias("amount_cents"))


#: An order whose invoice was cancelled, and every eighth, asked for another later.
_REISSUED = f"(SELECT order_id * 2 AS invoice_id, order_id, state, requested_at FROM {INVOICES} UNION ALL SELECT order_id * 2 + 1, order_id, CASE WHEN order_id % 5 = 0 THEN 'requested' ELSE 'issued' END, requested_at + to_days((order_id % 3)::INT) FROM {INVOICES} WHERE state = 'cancelled' OR order_id % 8 = 0)"


@register(f"SELECT order_id, max_by(invoice_id, (requested_at, invoice_id)) AS invoice_id, max_by(state, (requested_at, invoice_id)) AS state, CASE WHEN max_by(state, (requested_at, invoice_id)) = 'issued' THEN '/invoices/' || max_by(invoice_id, (requested_at, invoice_id)) || '.pdf' END AS url FROM {_REISSUED} GROUP BY 1")
def invoice_latest(spark, sf):
    """The latest invoice of each order that has any, with the address to fetch it from once it is issued."""
    first = invoices(spark, sf)
    later = first.where("state = 'cancelled' OR order_id % 8 = 0").select((F.col("order_id") * 2 + 1).alias("invoice_id"), "order_id", F.when(F.col("order_id") % 5 == 0, "requested").otherwise("issued").alias("state"), (F.col("requested_at") + F.make_interval(days=(F.col("order_id") % 3).cast("int"))).alias("requested_at"))
    rows = first.select((F.col("order_id") * 2).alias("invoice_id"), "order_id", "state", "requested_at").unionByName(later)
    rows = rows.groupBy("order_id").agg(F.max_by(F.struct("invoice_id", "state"), F.struct("requested_at", "invoice_id")).alias("x"))
    return rows.select("order_id", "x.invoice_id", "x.state", F.when(F.col("x.state") == "issued", F.concat(F.lit("/invoices/"), F.col("x.invoice_id").cast("string"), F.lit(".pdf"))).alias("url"))


@register(f"SELECT user_id, order_id, state FROM {INVOICES} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY requested_at DESC, order_id) <= 10")
def invoices_by_user(spark, sf):
    return support.latest(invoices(spark, sf), ["user_id"], 10, F.desc("requested_at"), F.col("order_id")).select("user_id", "order_id", "state")


_OID = rules.ORDER_ID.replace("(?i)", "")


#: What is said, in every third conversation with a company to bill and its tax id.
_SAID = f"(SELECT conv_id, turn, q || CASE WHEN conv_id % 3 = 1 THEN '，抬头 上海' || conv_id || ' (East) 科技集团 91310000MA1K3' || lpad((conv_id % 1000)::VARCHAR, 3, '0') || 'XY' ELSE '' END AS q FROM {TURNS})"


@register(f"SELECT conv_id, turn, nullif(regexp_extract(q, '(?i){_OID}'), '') AS order_id, coalesce({_first_rule_sql('lower(q)', rules.RETURN_KINDS)}, 'return') AS kind, coalesce(nullif(trim(regexp_extract(q, '{rules.INVOICE_TITLE}', 1)), ''), '{rules.INVOICE_PERSONAL}') AS invoice_title, CASE WHEN regexp_matches(q, '{rules.INVOICE_TITLE}') THEN nullif(regexp_extract(q, '{rules.TAX_ID}'), '') END AS tax_id, coalesce({_first_rule_sql('lower(q)', rules.ACCOUNT_INTENTS)}, 'profile') AS account FROM {_SAID}")
def utterance_extract(spark, sf):
    """Order id, kind of return, invoice title, tax id and account intent of each utterance; without a company an invoice is personal and has no tax id."""
    c = F.col("conv_id")
    company = F.concat(F.lit("，抬头 上海"), c.cast("string"), F.lit(" (East) 科技集团 91310000MA1K3"), F.lpad((c % 1000).cast("string"), 3, "0"), F.lit("XY"))
    rows = turns(spark, sf).select("conv_id", "turn", F.concat("q", F.when(c % 3 == 1, company).otherwise("")).alias("q"))
    q, low = F.col("q"), F.lower("q")
    none = lambda c: F.when(c != "", c)
    title, tax = support.invoice_title(q)
    return rows.select("conv_id", "turn", none(F.regexp_extract(q, rules.ORDER_ID, 0)).alias("order_id"), T.first_rule(low, rules.RETURN_KINDS, "return").alias("kind"), title.alias("invoice_title"), tax.alias("tax_id"), T.first_rule(low, rules.ACCOUNT_INTENTS, "profile").alias("account"))


_HI, _ME = ("(?i)" + "|".join(p) for p in (rules.SEVERITY_HIGH, rules.SEVERITY_MEDIUM))
_SEV = f"CASE WHEN regexp_matches(q, '{_HI}') THEN 'high' WHEN regexp_matches(q, '{_ME}') THEN 'medium' ELSE 'low' END"
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(q, '(?i){p}') THEN '{n}'" for n, p in rules.TOPICS) + " ELSE 'other' END"


@register(f"SELECT conv_id, turn, {_SEV} AS severity, {_TOPIC} AS topic, array_to_string(CASE {_SEV} WHEN 'high' THEN list_sort(list_distinct(regexp_extract_all(q, '{_HI}'))) WHEN 'medium' THEN list_sort(list_distinct(regexp_extract_all(q, '{_ME}'))) ELSE [] END, ',') AS matched FROM {TURNS}")
def complaint_classify(spark, sf):
    level, matched = support.severity(F.col("q"))
    return turns(spark, sf).select("conv_id", "turn", level.alias("severity"), support.topic(F.col("q")).alias("topic"), F.array_join(matched, ",").alias("matched"))


_C0 = f"(SELECT conv_id AS id, TIMESTAMP '2024-05-01' + to_minutes((conv_id % 10000)::INT) AS created_at, q AS text, {_SEV} AS severity, {_TOPIC} AS topic FROM {TURNS} WHERE turn = 0)"
POOL = ["ann", "bo", "cy"]
COMPLAINTS = f"(SELECT id, created_at, severity, topic, CASE WHEN severity = 'high' THEN 'escalated' ELSE 'open' END AS status, CASE WHEN severity = 'high' THEN ['ann', 'bo', 'cy'][(id % 3)::INT + 1] END AS assigned_to, created_at + to_hours(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 4 ELSE 24 END) AS sla_due_at, substr(sha256(text), 1, 16) AS content_hash FROM {_C0})"


def complaints(spark, sf):
    minutes = F.make_interval(mins=F.pmod("conv_id", F.lit(10000)).cast("int"))
    rows = turns(spark, sf).where("turn = 0").select(F.col("conv_id").alias("id"), (F.lit("2024-05-01").cast("timestamp_ntz") + minutes).alias("created_at"), F.col("q").alias("text"))
    return support.complaint_open(rows, POOL)


@register(f"SELECT * FROM {COMPLAINTS}")
def complaint_open(spark, sf):
    return complaints(spark, sf)


@register(f"SELECT id, 'conv-' || id AS thread_id, 'linked' AS event, NULL AS content_hash FROM {COMPLAINTS} WHERE topic <> 'price' UNION ALL SELECT id, 'conv-' || id, 'audit', content_hash FROM {COMPLAINTS} WHERE topic <> 'price' AND severity = 'high'")
def complaint_thread_link(spark, sf):
    """Complaints of allowed topics get their session's id; serious ones an audit row too."""
    c = complaints(spark, sf).where("topic <> 'price'").withColumn("thread_id", F.concat(F.lit("conv-"), F.col("id").cast("string")))
    linked = c.select("id", "thread_id", F.lit("linked").alias("event"), F.lit(None).cast("string").alias("content_hash"))
    return linked.unionByName(c.where("severity = 'high'").select("id", "thread_id", F.lit("audit").alias("event"), "content_hash"))


def as_events(rows):
    """Turns (conv_id, turn, text) as events of complaints: the first opens, by the severity of its text, the rest act in turn."""
    kind = F.when(F.col("turn") == 0, "open").otherwise(F.element_at(F.array(*map(F.lit, ("claim", "escalate", "cancel", "reopen"))), (F.pmod(F.col("conv_id") + F.col("turn") * 3, F.lit(4)) + 1).cast("int")))
    at = F.lit("2024-05-01").cast("timestamp") + F.make_interval(mins=F.pmod("conv_id", F.lit(10000)).cast("int"), hours=F.col("turn").cast("int"))
    level, _ = support.severity(said(F.col("text")))
    return rows.select(F.col("conv_id").alias("complaint_id"), F.col("turn").alias("seq"), kind.alias("kind"), F.when(F.col("turn") == 0, level).alias("severity"), at.alias("at"), F.when(F.col("turn") % 5 != 4, F.concat(F.lit("agent"), F.col("turn").cast("string"))).alias("actor"))


def complaint_events(spark, sf):
    return as_events(table(spark, sf, "conversations"))


#: The walk over the events of each complaint, one state after another, by the rules for creating, claiming, escalating, cancelling and reopening.
FOLD = f"""WITH RECURSIVE e AS (SELECT conv_id AS complaint_id, turn AS seq, CASE WHEN turn = 0 THEN 'open' ELSE ['claim', 'escalate', 'cancel', 'reopen'][((conv_id + turn * 3) % 4)::INT + 1] END AS kind, CASE WHEN turn = 0 THEN {_SEV} END AS sev,
 TIMESTAMP '2024-05-01' + to_minutes((conv_id % 10000)::INT) + to_hours(turn::INT) AS ts, CASE WHEN turn % 5 <> 4 THEN 'agent' || turn END AS actor, ['ann', 'bo', 'cy'][((conv_id + turn) % 3)::INT + 1] AS pick FROM {TURNS}),
o AS (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY complaint_id) AS total FROM e),
f AS (SELECT complaint_id, 0::BIGINT AS n, NULL::VARCHAR AS status, false AS escalated, NULL::VARCHAR AS severity, NULL::VARCHAR AS assigned_to, NULL::TIMESTAMP AS sla_due_at FROM (SELECT DISTINCT complaint_id FROM e)
UNION ALL SELECT complaint_id, n,
 CASE WHEN starts THEN CASE WHEN own = 'high' THEN 'escalated' ELSE 'open' END WHEN status IS NULL THEN NULL WHEN kind = 'claim' AND status = 'open' OR kind = 'escalate' THEN 'escalated' WHEN kind = 'cancel' THEN 'closed' ELSE status END,
 CASE WHEN starts THEN own = 'high' WHEN status IS NULL THEN escalated WHEN kind IN ('claim', 'escalate') THEN true WHEN kind = 'cancel' THEN false ELSE escalated END,
 CASE WHEN starts THEN own ELSE severity END,
 CASE WHEN starts AND own = 'high' THEN pick WHEN status IS NULL OR starts THEN assigned_to WHEN kind = 'claim' THEN coalesce(actor, assigned_to) WHEN kind = 'escalate' THEN coalesce(actor, pick) ELSE assigned_to END,
 CASE WHEN starts THEN ts + to_hours(CASE own WHEN 'high' THEN 1 WHEN 'medium' THEN 4 ELSE 24 END) ELSE sla_due_at END
FROM (SELECT f.complaint_id, o.n, f.status, f.escalated, f.severity, f.assigned_to, f.sla_due_at, kind, actor, pick, ts, (kind = 'open' AND status IS NULL) OR coalesce(kind = 'reopen' AND status = 'closed', false) AS starts, coalesce(f.severity, sev) AS own FROM f JOIN o ON o.complaint_id = f.complaint_id AND o.n = f.n + 1))
SELECT f.complaint_id, status, escalated, severity, assigned_to, sla_due_at, total AS n_events FROM f JOIN o ON o.complaint_id = f.complaint_id AND o.n = f.n AND o.n = total"""


@register(FOLD)
def complaint_fold(spark, sf):
    return complaints_of.complaint_fold(complaint_events(spark, sf), POOL)


@register(f"SELECT id, severity, created_at FROM {COMPLAINTS} WHERE status = 'escalated' ORDER BY created_at DESC, id LIMIT 200")
def complaint_queue(spark, sf):
    return complaints(spark, sf).where("status = 'escalated'").orderBy(F.desc("created_at"), "id").limit(200).select("id", "severity", "created_at")


@register("SELECT conv_id AS complaint_id, turn, role, md5(text) AS text_hash, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM conversations WHERE turn >= 1")
def complaint_thread(spark, sf):
    """Every reply to a complaint in the order of the thread, its whole text by hash."""
    rows = complaint_thread_replies(spark, sf)
    return rows.select("complaint_id", "turn", "role", F.md5("text").alias("text_hash"), F.col("position").cast("long").alias("position"))


@register()
def complaint_thread_replies(spark, sf):
    """Every reply to a complaint, whole, one row each in the order of the thread."""
    rows = table(spark, sf, "conversations").where("turn >= 1").select(F.col("conv_id").alias("complaint_id"), "turn", "role", "text")
    return support.positions(rows, "complaint_id", ["turn", "role", "text"], scratch(spark, "thread"))


@register(f"SELECT conv_id, turn, CASE WHEN trim(r.text) = '' THEN 'empty' WHEN c.id IS NULL THEN 'not_found' WHEN c.id % 5 = 0 THEN 'closed' WHEN c.id % 7 = 0 THEN 'other_tenant' ELSE 'accepted' END AS verdict, CASE WHEN trim(r.text) <> '' AND c.id IS NOT NULL AND c.id % 5 <> 0 AND c.id % 7 <> 0 THEN substr(sha256(r.text), 1, 16) END AS audit_hash FROM (SELECT conv_id, turn, CASE WHEN turn = 2 THEN ' ' ELSE text END AS text, conv_id + CASE WHEN turn = 3 THEN 100000000 ELSE 0 END AS cid FROM conversations WHERE role = 'assistant') r LEFT JOIN {COMPLAINTS} c ON c.id = cid")
def reply_apply(spark, sf):
    """Replies of staff: refused if empty, unknown, closed or another tenant's; accepted ones leave a hash for audit."""
    r = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("turn") == 2, " ").otherwise(F.col("text")).alias("text"), (F.col("conv_id") + F.when(F.col("turn") == 3, 100_000_000).otherwise(0)).alias("cid"))
    rows = r.join(complaints(spark, sf).select("id"), F.col("id") == F.col("cid"), "left")
    verdict = F.when(F.trim("text") == "", "empty").when(F.col("id").isNull(), "not_found").when(F.col("id") % 5 == 0, "closed").when(F.col("id") % 7 == 0, "other_tenant").otherwise("accepted")
    return rows.withColumn("verdict", verdict).select("conv_id", "turn", "verdict", F.when(F.col("verdict") == "accepted", F.substring(F.sha2("text", 256), 1, 16)).alias("audit_hash"))


@register(f"SELECT conv_id, turn, CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.id % 3 <> 0 AND c.id % 10 <> r.conv_id % 11 THEN 'not_owner' WHEN trim(r.text) = '' THEN 'empty' ELSE 'accepted' END AS verdict FROM conversations r LEFT JOIN {COMPLAINTS} c ON c.id = r.conv_id WHERE role = 'user'")
def user_reply_apply(spark, sf):
    """Replies of users: complaints without an owner take any; closed ones are not asked about."""
    rows = table(spark, sf, "conversations").where("role = 'user'").join(complaints(spark, sf).select("id"), F.col("id") == F.col("conv_id"), "left")
    verdict = F.when(F.col("id").isNull(), "not_found").when((F.col("id") % 3 != 0) & (F.col("id") % 10 != F.col("conv_id") % 11), "not_owner").when(F.trim("text") == "", "empty").otherwise("accepted")
    return rows.select("conv_id", "turn", verdict.alias("verdict"))


@register(f"""WITH r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND turn >= 3), u AS (SELECT id, id % 50 AS user_id, created_at FROM {COMPLAINTS} WHERE id IN (SELECT conv_id FROM r)),
n AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 20) SELECT user_id, id, turn, md5(text) AS text_hash, row_number() OVER (PARTITION BY id ORDER BY turn, text) AS position FROM n JOIN r ON conv_id = id""")
def user_inbox(spark, sf):
    """The latest complaints of each user with all replies since a turn, their whole texts by hash; those without replies drop out."""
    rows = user_inbox_replies(spark, sf)
    return rows.select("user_id", "id", "turn", F.md5("text").alias("text_hash"), F.col("position").cast("long").alias("position"))


@register()
def user_inbox_replies(spark, sf):
    """The latest complaints of each user that have replies since a turn, with all of these, whole, one row each."""
    r = table(spark, sf, "conversations").where("role = 'assistant' AND turn >= 3").select(F.col("conv_id").alias("id"), "turn", "text")
    rows = complaints(spark, sf).join(r, "id", "left_semi").withColumn("user_id", F.col("id") % 50)
    newest = support.latest(rows, ["user_id"], 20, F.desc("created_at"), F.col("id")).select("user_id", "id")
    return support.positions(newest.join(r, "id").select("user_id", "id", "turn", "text"), "id", ["turn", "text"], scratch(spark, "inbox"))


@register("SELECT conv_id, CASE WHEN min_by(text, turn) = '' THEN 'New chat' ELSE substr(min_by(text, (turn, role, text)), 1, 40) END AS title, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def session_rollup(spark, sf):
    first = F.min_by("text", F.struct("turn", "role", "text"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.when(first == "", "New chat").otherwise(F.substring(first, 1, 40)).alias("title"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@register("SELECT conv_id, substr(max_by(trim(text), (turn, text)), 1, 80) AS title FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def session_rename_apply(spark, sf):
    return table(spark, sf, "conversations").where(F.trim("text") != "").groupBy("conv_id").agg(F.substring(F.max_by(F.trim("text"), F.struct("turn", "text")), 1, 80).alias("title"))


@register(f"SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE 'conv-' || id END AS thread_id FROM {COMPLAINTS}")
def session_delete(spark, sf):
    """Complaints after every sixth session is deleted: their thread is gone, they stay."""
    gone = table(spark, sf, "conversations").where("conv_id % 6 = 0").select(F.col("conv_id").alias("g")).distinct()
    rows = complaints(spark, sf).select("id").join(gone, F.col("g") == F.col("id"), "left")
    return rows.select("id", F.when(F.col("g").isNull(), F.concat(F.lit("conv-"), F.col("id").cast("string"))).alias("thread_id"))


PREFS = "(SELECT user_id, lower(trim(substr(event_type, 1, 64))) AS key, max_by(CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'v' || event_id END, (ts, event_id)) FILTER (true) AS value, max_by(event_id % 10 = 0, (ts, event_id)) AS gone, max_by(event_id, (ts, event_id)) AS last FROM events GROUP BY 1, 2)"


def preferences(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.lower(F.trim(F.substring("event_type", 1, 64))).alias("key"), "event_id", "ts")
    last = e.groupBy("user_id", "key").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return last.where(F.col("x.event_id") % 10 != 0).select("user_id", "key", F.concat(F.lit("v"), F.col("x.event_id").cast("string")).alias("value"))


@register(f"SELECT user_id, key, 'v' || last AS value FROM {PREFS} WHERE NOT gone")
def preference_upsert(spark, sf):
    """The latest value by user and key; a tombstone removes it."""
    return preferences(spark, sf)


_PREF_SQL = rules.PREFERENCE_LINE.replace("{key}", "' || key || '").replace("{value}", "' || value || '").replace("{source}", "' || source || '")
_MORE_SQL = rules.PREFERENCE_MORE.replace("{n}", "' || (any_value(total) - 6) || '")


@register(f"WITH e AS (SELECT user_id, event_type || '-' || event_id % 4 AS key, max(event_id) AS last FROM events GROUP BY 1, 2), p AS (SELECT user_id, key, 'v' || last AS value, CASE WHEN last % 2 = 0 THEN 'agent' ELSE 'user' END AS source, row_number() OVER (PARTITION BY user_id ORDER BY key) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM e) SELECT user_id, '{rules.PREFERENCE_HEAD}' || chr(10) || string_agg('{_PREF_SQL}', chr(10) ORDER BY key) || CASE WHEN any_value(total) > 6 THEN chr(10) || '{_MORE_SQL}' ELSE '' END AS summary FROM p WHERE n <= 6 GROUP BY 1")
def preference_summary(spark, sf):
    """The first six preferences of each user by key, as a planner is told them, and how many more there are."""
    e = table(spark, sf, "events").groupBy("user_id", F.concat("event_type", F.lit("-"), (F.col("event_id") % 4).cast("string")).alias("key")).agg(F.max("event_id").alias("last"))
    rows = e.select("user_id", "key", F.concat(F.lit("v"), F.col("last").cast("string")).alias("value"), F.when(F.col("last") % 2 == 0, "agent").otherwise("user").alias("source"))
    return support.preference_summary(rows)


@register("SELECT user_id, id, n = 1 AS is_default FROM (SELECT o_custkey AS user_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority LIKE '1%') DESC, o_orderdate DESC, o_orderkey) AS n FROM orders)")
def address_default(spark, sf):
    """One default per user: the last that was set, or any."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderpriority").startswith("1").desc(), F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), (F.row_number().over(w) == 1).alias("is_default"))


@register("SELECT o_orderkey, coalesce(c_mktsegment, 'anonymous') AS tenant FROM orders LEFT JOIN customer ON sha256('key-' || o_custkey) = sha256('key-' || c_custkey) AND c_custkey % 9 <> 0")
def tenant_scope(spark, sf):
    """Requests by the hash of their key; unknown and disabled keys are anonymous."""
    keyed = lambda c: F.sha2(F.concat(F.lit("key-"), F.col(c).cast("string")), 256)
    keys = table(spark, sf, "customer").where("c_custkey % 9 <> 0").select(keyed("c_custkey").alias("h"), "c_mktsegment")
    return table(spark, sf, "orders").select("o_orderkey", keyed("o_custkey").alias("h")).join(keys, "h", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("anonymous")).alias("tenant"))


@register("SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, substr(sha256(props), 1, 16) AS query_hash, CASE WHEN event_type = 'error' THEN substr(props, 1, 500) END AS error FROM events WHERE event_type <> 'view'")
def audit_rows(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'view'")
    err = F.col("event_type") == "error"
    return e.select("event_id", "user_id", "event_type", F.when(err, 500).otherwise(200).alias("status"), F.substring(F.sha2("props", 256), 1, 16).alias("query_hash"), F.when(err, F.substring("props", 1, 500)).alias("error"))


@register("SELECT event_id, ts FROM events WHERE event_type = 'error' AND user_id BETWEEN 10 AND 90 AND value > 5 ORDER BY ts DESC, event_id LIMIT 500")
def audit_search(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error' AND user_id BETWEEN 10 AND 90 AND value > 5").orderBy(F.desc("ts"), "event_id").limit(500).select("event_id", "ts")


#: Requests to return goods, by whoever ordered them; feedback and audit rows are events of a user.
_RETURNS = "(SELECT o_orderkey * 2 + n AS id, o_orderkey AS order_id, ['completed', 'rejected', 'pending', 'cancelled', 'approved'][(o_orderkey % 5)::INT + 1] AS status, o_orderdate + to_days(n::INT * 3) AS created_at FROM (SELECT *, unnest(range(1 + (o_orderkey % 2)::INT)) AS n FROM orders WHERE o_orderkey % 3 = 0))"


def returns(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").where(k % 3 == 0).select(k, "o_orderdate", F.explode(F.sequence(F.lit(0), (k % 2).cast("int"))).alias("n"))
    status = F.element_at(F.array(*map(F.lit, ("completed", "rejected", "pending", "cancelled", "approved"))), (k % 5 + 1).cast("int"))
    return rows.select((k * 2 + F.col("n")).alias("id"), k.alias("order_id"), status.alias("status"), (F.col("o_orderdate") + F.make_interval(days=F.col("n") * 3)).alias("created_at"))


_ERASED = f"""WITH u AS (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 7), o AS (SELECT o_custkey AS u, count(*) AS n FROM orders WHERE o_custkey IN (FROM u) GROUP BY 1), i AS (SELECT o_custkey AS u, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IN (FROM u) GROUP BY 1),
r AS (SELECT o_custkey AS u, count(*) AS n FROM {_RETURNS} JOIN orders ON o_orderkey = order_id WHERE o_custkey IN (FROM u) GROUP BY 1), f AS (SELECT user_id AS u, count(*) FILTER (event_type = 'click') AS n, count(*) FILTER (event_type = 'error') AS m FROM events WHERE user_id IN (FROM u) GROUP BY 1),
c AS (SELECT substr(sha256(c_custkey::VARCHAR), 1, 16) AS user_hash, coalesce(o.n, 0) AS orders, coalesce(i.n, 0) AS items, coalesce(r.n, 0) AS returns, coalesce(f.n, 0) AS feedback, coalesce(f.m, 0) AS audit_logs FROM u LEFT JOIN o ON o.u = c_custkey LEFT JOIN i ON i.u = c_custkey LEFT JOIN r ON r.u = c_custkey LEFT JOIN f ON f.u = c_custkey)
SELECT 'gdpr_delete' AS event_type, user_hash, orders, items, returns, feedback, audit_logs, 1::BIGINT AS users, NULL::BIGINT AS n_left FROM c UNION ALL SELECT 'left', NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM {_RETURNS} JOIN orders ON o_orderkey = order_id WHERE o_custkey NOT IN (FROM u)"""


@register(_ERASED)
def erase_user(spark, sf):
    """A set of users erased, with what hangs on their orders: an audit row for each that holds only a hash of the user, and the returns that are left."""
    c, o, e = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "events")
    of = lambda rows, key: rows.join(o.select(F.col("o_orderkey").alias(key), "o_custkey"), key)
    tables = {"orders": (o, "o_custkey"), "items": (of(table(spark, sf, "lineitem"), "l_orderkey"), "o_custkey"), "returns": (of(returns(spark, sf), "order_id"), "o_custkey"), "feedback": (e.where("event_type = 'click'"), "user_id"), "audit_logs": (e.where("event_type = 'error'"), "user_id"), "users": (c, "c_custkey")}
    audit, left = support.erase(tables, c.where("c_custkey % 50 = 7").select("c_custkey"), "c_custkey")
    return audit.withColumn("n_left", F.lit(None).cast("long")).unionByName(left["returns"].agg(F.count("*").alias("n_left")).withColumn("event_type", F.lit("left")), allowMissingColumns=True)


#: The moment of the sweep; audit rows are the events, moved before it, feedback the shipped goods.
SWEPT = "1998-08-05"
_SWEPT = f"""WITH m AS (SELECT max(ts) AS m FROM events), a AS (SELECT 'audit_logs' AS table_name, TIMESTAMP '{SWEPT}' - (m.m - ts) * 9 AS created_at, NULL AS status, 180 AS days FROM events, m),
x AS (SELECT * FROM a UNION ALL SELECT 'feedback', o_orderdate, NULL, 365 FROM orders UNION ALL SELECT 'return_requests', created_at, status, 365 FROM {_RETURNS})
SELECT table_name, count(*) FILTER (gone) AS expired, count(*) FILTER (NOT gone) AS kept FROM (SELECT table_name, created_at < TIMESTAMP '{SWEPT}' - to_days(days) AND (table_name <> 'return_requests' OR status IN ('completed', 'rejected', 'cancelled')) AS gone FROM x) GROUP BY 1"""


@register(_SWEPT)
def retention_sweep(spark, sf):
    """What a sweep takes out of three tables: old audit rows, old feedback, and old returns that are over."""
    e, at = table(spark, sf, "events"), F.lit(SWEPT).cast("timestamp_ntz")
    last = e.agg(F.max("ts").alias("last"))  # one row
    audit = e.crossJoin(F.broadcast(last)).select((at - (F.col("last") - F.col("ts")) * 9).alias("created_at"))
    tables = {"audit_logs": audit, "feedback": table(spark, sf, "orders").select(F.col("o_orderdate").alias("created_at")), "return_requests": returns(spark, sf)}
    counts, _ = support.retention(tables, at)
    return counts
