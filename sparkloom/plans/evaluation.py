"""Registered queries: evaluation, replies of models, prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich, evaluate, search
from ..sources.shared import stored
from .registry import register, table
from .retrieval import BM25, bm25, indexed

#: A passage's relevant documents are those that hold it word for word.
EVAL = f"""{BM25}, rel AS (SELECT item_id, list(doc_id ORDER BY doc_id) AS relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
eq AS (SELECT b.item_id AS query_id, CASE WHEN r.relevant IS NULL THEN 'out_of_domain' WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, coalesce(r.relevant, []) AS relevant FROM benchmark b LEFT JOIN rel r USING (item_id)),
es AS (SELECT query_id, chunk_id AS source_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM bm),
ef AS (SELECT eq.query_id, min(place) AS first_rank FROM eq JOIN es ON es.query_id = eq.query_id AND list_contains(relevant, source_id) GROUP BY 1),
er AS (SELECT eq.query_id, category, category <> 'out_of_domain' AND len(relevant) > 0 AS scored, first_rank, relevant FROM eq LEFT JOIN ef USING (query_id)),
ev AS (SELECT query_id, category, scored, first_rank, CASE WHEN scored THEN (coalesce(first_rank, 1000000) <= 1)::INT END AS hit1, CASE WHEN scored THEN (coalesce(first_rank, 1000000) <= 3)::INT END AS hit3, CASE WHEN scored THEN (coalesce(first_rank, 1000000) <= 5)::INT END AS hit5, CASE WHEN scored THEN coalesce(1.0 / first_rank, 0)::DOUBLE END AS rr FROM er)"""
MEANS = ", ".join(f"round(coalesce(avg({m}), 0), 6)::DOUBLE AS {m}" for m in evaluate.METRICS)


def eval_rows(spark, sf):
    b, d, index = table(spark, sf, "benchmark"), table(spark, sf, "documents"), indexed(spark, sf)
    # a document that holds a passage holds its words, but for the first and the last, as they are: the longest of them proposes documents by the index
    words = T.index_tokens(F.col("text"))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    key = F.get(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    q = stored(b.select("item_id", F.col("text").alias("passage"), key.alias("term")), "passages")
    proposed = stored(search.holders(q.select("term").where("term IS NOT NULL"), index).join(q, "term").select("item_id", F.col("chunk_id").alias("doc_id")), "proposed")
    found = proposed.join(d.select("doc_id", "text"), "doc_id").join(q, "item_id").where(F.contains("text", F.col("passage")))
    short = d.select("doc_id", "text").join(F.broadcast(q.where("term IS NULL")), F.contains("text", F.col("passage")))  # a passage of one or two words proposes nothing
    relevant = found.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id")).groupBy("item_id").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant"))
    queries = b.join(relevant, "item_id", "left").select(F.col("item_id").alias("query_id"), F.when(F.col("relevant").isNull(), "out_of_domain").when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.coalesce("relevant", F.array().cast("array<long>")).alias("relevant"))
    return evaluate.retrieval_rows(bm25(spark, sf).select("query_id", F.col("chunk_id").alias("source_id"), "rank"), queries)


@register(f"WITH {EVAL} SELECT * FROM ev")
def eval_retrieval_rows(spark, sf):
    return eval_rows(spark, sf)


@register(f"WITH {EVAL} SELECT count(*) FILTER (scored) AS n, count(*) FILTER (NOT scored) AS n_skipped, {MEANS} FROM ev")
def eval_retrieval_metrics(spark, sf):
    return evaluate.retrieval_metrics(eval_rows(spark, sf))


@register(f"WITH {EVAL} SELECT category, count(*) FILTER (scored) AS n, count(*) FILTER (NOT scored) AS n_skipped, {MEANS} FROM ev GROUP BY 1")
def eval_by_category(spark, sf):
    return evaluate.retrieval_metrics(eval_rows(spark, sf), "category")


BASELINE = [("hit1", 0.754, 0.02), ("hit3", 0.942, 0.02), ("hit5", 0.942, 0.02)]
_BASE = "(VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in BASELINE) + ") AS b(metric, base, tolerance)"


@register(f"WITH {EVAL}, mm AS (SELECT {MEANS} FROM ev), ll AS (UNPIVOT mm ON hit1, hit3, hit5, rr INTO NAME metric VALUE value) SELECT l.metric, value, base::DOUBLE AS base, round(value - base, 6)::DOUBLE AS delta, CASE WHEN base IS NULL THEN 'no-baseline' WHEN round(value - base, 6) >= 0 THEN 'ok' WHEN round(value - base, 6) >= -tolerance THEN 'within_tol' ELSE 'REGRESSED' END AS verdict FROM ll l LEFT JOIN {_BASE} ON b.metric = l.metric")
def regression_gate(spark, sf):
    base = spark.createDataFrame(BASELINE, "metric string, base double, tolerance double")
    return evaluate.regression_gate(evaluate.retrieval_metrics(eval_rows(spark, sf)).select(*evaluate.METRICS), base)


REPLY = "CASE WHEN doc_id % 3 = 0 THEN 'no json' ELSE 'Verdict: {\"faithful\": ' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || ', \"cites\": true, \"answers\": ' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || '} ok' END"


def replies(spark, sf):
    flag = lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    reply = F.when(F.col("doc_id") % 3 == 0, "no json").otherwise(F.concat(F.lit('Verdict: {"faithful": '), flag("quality"), F.lit(', "cites": true, "answers": '), flag("toxic"), F.lit("} ok")))
    return table(spark, sf, "labels").select("doc_id", reply.alias("reply"))


@register("SELECT doc_id, doc_id % 3 <> 0 AND quality = 1 AS faithful, doc_id % 3 <> 0 AS cites, doc_id % 3 <> 0 AND toxic = 1 AS answers, false AS abstains FROM labels")
def judge_parse(spark, sf):
    return replies(spark, sf).select("doc_id", *enrich.judge_flags(F.col("reply")))


@register("SELECT count(*) AS n, round(avg((doc_id % 3 <> 0 AND quality = 1)::INT), 6) AS faithful, round(avg((doc_id % 3 <> 0)::INT), 6) AS cites, round(avg((doc_id % 3 <> 0 AND toxic = 1)::INT), 6) AS answers, 0.0::DOUBLE AS abstains, round(avg(doc_id % 1000), 6) AS latency_ms FROM labels")
def eval_answer_metrics(spark, sf):
    rows = replies(spark, sf).select(*enrich.judge_flags(F.col("reply")), (F.col("doc_id") % 1000).alias("latency"))
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in ("faithful", "cites", "answers", "abstains")), F.round(F.avg("latency"), 6).alias("latency_ms"))


@register("SELECT item_id FROM benchmark WHERE item_id % 5 <> 0 ORDER BY item_id LIMIT 20")
def answer_subset(spark, sf):
    """The first twenty queries that are in the domain."""
    return table(spark, sf, "benchmark").where("item_id % 5 <> 0").orderBy("item_id").limit(20).select("item_id")


@register("SELECT event_id, event_type AS kb_id, ts, count(*) OVER (PARTITION BY event_type) AS kb_total FROM (SELECT * FROM events WHERE event_type IN ('error', 'click') AND value < 20) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 50")
def feedback_candidates(spark, sf):
    """Down votes by knowledge base, the newest fifty of each with the number of all."""
    down = table(spark, sf, "events").where("event_type IN ('error', 'click') AND value < 20")
    totals = down.groupBy("event_type").agg(F.count("*").alias("kb_total"))
    newest = down.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id"))).where("n <= 50")
    return newest.join(F.broadcast(totals), "event_type").select("event_id", F.col("event_type").alias("kb_id"), "ts", "kb_total")


@register("SELECT event_id, CASE WHEN v IN ('up', 'down') THEN 'accepted' ELSE 'rejected' END AS state FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE event_type END AS v FROM events)")
def feedback_validate(spark, sf):
    v = F.when(F.col("event_type") == "click", "up").when(F.col("event_type") == "error", "down").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.when(v.isin("up", "down"), "accepted").otherwise("rejected").alias("state"))


# around a model call


@register("SELECT sha256(coalesce(text, '')) AS key, count(*) AS uses FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def inference_cache_plan(spark, sf):
    """Texts that a cache, filled by every third document, does not hold: once each."""
    d = table(spark, sf, "documents").withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    return enrich.cache_misses(d, d.where("doc_id % 3 = 0"), "key").groupBy("key").agg(F.count("*").alias("uses"))


@register("SELECT DISTINCT sha256(html) AS pixel_hash, CASE WHEN page_id % 2 = 0 THEN 'caption' ELSE 'layout' END AS task FROM pages WHERE (sha256(html), CASE WHEN page_id % 2 = 0 THEN 'caption' ELSE 'layout' END) NOT IN (SELECT (sha256(html), 'caption') FROM pages WHERE page_id % 4 = 0)")
def vision_cache_plan(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("pixel_hash"), F.when(F.col("page_id") % 2 == 0, "caption").otherwise("layout").alias("task"))
    return enrich.cache_misses(p, p.where("page_id % 4 = 0"), "pixel_hash", "task").select("pixel_hash", "task").distinct()


_CONTEXT = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  About ' || source || '. ' || chr(10) || 'more' ELSE ' ' || chr(10) END"


@register(f"""WITH l AS (SELECT d.doc_id, d.source AS title, CASE WHEN d.doc_id % 7 <> 0 THEN d.lang || ' / part ' || d.doc_id % 5 ELSE '(top level)' END AS section, d.text, p.text AS parent, {_CONTEXT.replace('doc_id', 'd.doc_id').replace('source', 'd.source')} AS reply FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id // 10 * 10 AND d.doc_id % 4 <> 0)
SELECT doc_id, md5('Document title: ' || title || chr(10) || 'Section: ' || section || chr(10) || CASE WHEN coalesce(parent, '') = '' OR trim(parent, E' \\t\\n\\r') = trim(text, E' \\t\\n\\r') THEN '' ELSE chr(10) || 'Parent section text:' || chr(10) || CASE WHEN length(parent) <= 1500 THEN parent ELSE substr(parent, 1, 1500) || ' ...' END || chr(10) END || chr(10) || 'Chunk to situate:' || chr(10) || text || chr(10) || chr(10) || 'Write the 1-2 sentence contextual summary.') AS prompt_md5,
 CASE WHEN doc_id % 3 = 1 THEN 'About ' || title || '.' || chr(10) || chr(10) || text ELSE text END AS text, length(text) + CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS token_count, CASE WHEN doc_id % 3 = 1 THEN 'About ' || title || '.' ELSE '' END AS contextual_prefix FROM l""")
def contextual_prefix(spark, sf):
    """The request for each leaf's context, its parent's text in it, and the leaf behind the first line of the reply; every tenth document is a parent."""
    d = table(spark, sf, "documents")
    parents = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("pid"), F.col("text").alias("parent"))
    rows = d.join(parents, (F.floor(F.col("doc_id") / 10) * 10 == F.col("pid")) & (F.col("doc_id") % 4 != 0), "left")
    section = F.when(F.col("doc_id") % 7 != 0, F.array("lang", F.concat(F.lit("part "), (F.col("doc_id") % 5).cast("string"))))
    reply = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  About "), "source", F.lit(". \nmore"))).when(F.col("doc_id") % 3 == 2, " \n")
    prompt = enrich.context_prompt(F.col("source"), section, F.col("text"), F.col("parent"))
    told = enrich.with_context(F.col("text"), F.length("text"), reply)
    return rows.select("doc_id", F.md5(prompt).alias("prompt_md5"), *told[:3])


@register("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['Ada', 'Bob', lang] WHEN 1 THEN [source] WHEN 2 THEN ['e1', 'e2', 'e3', 'e4', 'e5', 'e6'] ELSE [] END AS entities,
CASE doc_id % 4 WHEN 0 THEN ['release_notes', 'how-to'] WHEN 1 THEN ['a_b-c'] WHEN 2 THEN ['t1', 't1'] ELSE [] END AS topics, CASE doc_id % 4 WHEN 0 THEN '2024-05-01' WHEN 2 THEN '2023-12-31' END AS date FROM documents""")
def metadata_normalise(spark, sf):
    """Loose JSON replies, fenced, with prose around, over-long, or no JSON: distinct entities, the first three topics in lower case, dates of the right shape."""
    fenced = F.concat(F.lit('```json\n{"entities": ["Ada", "ada", " Bob ", "'), "lang", F.lit('"], "topics": ["Release  Notes", "how-to"], "date": "2024-05-01"}\n```'))
    prose = F.concat(F.lit('Here it is: {"entities": ["'), "source", F.lit('", "'), F.repeat(F.lit("x"), F.lit(41)), F.lit('"], "topics": ["A b-C", "'), F.repeat(F.lit("y"), F.lit(41)), F.lit('"], "date": "May"} as asked'))
    many = F.lit('{"date": "2023-12-31", "entities": ["e1", "e2", "E1", "e3", "e4", "e5", "e6", "e7"], "topics": ["t1", "T1", " ", "t3", "t4"]}')
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, fenced).when(k == 1, prose).when(k == 2, many).otherwise("I cannot do that.")
    return table(spark, sf, "documents").select("doc_id", *enrich.metadata(reply))


@register("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [lang] END AS entities, CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN '2024-05-01' END AS date FROM documents")
def metadata_merge(spark, sf):
    """Replies joined to leaves; parents (every fifth) keep what they have."""
    d = table(spark, sf, "documents")
    replies_ = d.select("doc_id", F.array("lang").alias("new_entities"), F.when(F.col("doc_id") % 2 == 0, "2024-05-01").alias("new_date"))
    leaf = F.col("doc_id") % 5 != 0
    return d.join(replies_, "doc_id", "left").select("doc_id", F.when(leaf, F.col("new_entities")).otherwise(F.array().cast("array<string>")).alias("entities"), F.when(leaf, F.col("new_date")).alias("date"))


@register("SELECT item_id, CASE item_id % 4 WHEN 0 THEN ['a ' || item_id, 'b'] WHEN 1 THEN ['v1', 'v2', 'v3', 'v4'] WHEN 2 THEN ['x'] ELSE [] END AS variants FROM benchmark")
def parse_llm_array(spark, sf):
    """The first array of a reply, without what repeats itself or the query, four at most; none where there is no array."""
    k = F.col("item_id") % 4
    loose = F.concat(F.lit('Sure: ["a '), F.col("item_id").cast("string"), F.lit('", "b", "B", " the query ", ""] done'))
    reply = F.when(k == 0, loose).when(k == 1, '["v1", "v2", "V2", "v3", "v4", "v5"]').when(k == 2, '```\n["THE QUERY", " x "]\n```\n["y"]').otherwise("no list: [broken")
    return table(spark, sf, "benchmark").select("item_id", enrich.variants(reply, F.lit("the query")).alias("variants"))


@register("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(text, 1, 300), chr(10) ORDER BY turn, role, text) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 4 GROUP BY 1")
def prompt_history_tail(spark, sf):
    """The last four turns of each conversation, 300 characters of each."""
    said = table(spark, sf, "conversations").where("role IN ('user', 'assistant')")
    return enrich.history_tail(said, 4, 300)


@register("SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' new ' || item_id WHEN 2 THEN 'new ' || item_id ELSE text END AS query FROM benchmark")
def rewrite_merge(spark, sf):
    """The first line of a rewrite after the query, alone if there was a conversation; the query if it is empty or missing."""
    k = F.col("item_id") % 4
    reply = F.when(k == 0, "  \nsecond line").when(k < 3, F.concat(F.lit(" new "), F.col("item_id").cast("string"), F.lit(" \nsecond line")))
    return table(spark, sf, "benchmark").select("item_id", enrich.merge_rewrite(F.col("text"), reply, k == 2).alias("query"))


@register()
def embed_batch(spark, sf):
    """Unit vectors of documents by the default embedder."""
    return enrich.embed(table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", "source", "text").alias("payload")), "doc_id", "payload")
