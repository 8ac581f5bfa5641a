"""Registered queries: index, search, answer assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import enrich, filters, grounding, search
from ..sources.shared import kept, stored
from .registry import register, table

STOP = "'" + "','".join(rules.STOPWORDS) + "'"
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
QTERMS = f"SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) WHERE length(term) > 1 AND term NOT IN ({STOP})"
#: Matching terms: prefixes, and the group of CJK characters.
QKINDS = f"SELECT query_id, term, 'prefix' AS kind FROM ({QTERMS}) UNION ALL SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[{rules.CJK}]')), 'cjk' FROM benchmark"
POST = f"SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2"
BM25 = f"""q AS ({QTERMS}), p AS MATERIALIZED ({POST}), l AS (SELECT chunk_id, sum(tf) AS len FROM p GROUP BY 1), v AS (SELECT DISTINCT term AS word FROM p),
m AS (SELECT t.term, v.word FROM (SELECT DISTINCT term FROM q) t JOIN v ON starts_with(v.word, t.term)),
h AS (SELECT m.term, p.chunk_id, sum(p.tf) AS tf FROM m JOIN p ON p.term = m.word GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) AS total),
s AS (SELECT q.query_id, h.chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * len / (total / n)))), 6) AS score FROM q JOIN h USING (term) JOIN d USING (term) JOIN l ON l.chunk_id = h.chunk_id, n GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 40)"""
OVERLAP = """ov AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.query_id, p.chunk_id, count(*)::DOUBLE AS score FROM q JOIN p USING (term) GROUP BY 1, 2)) WHERE rank <= 40)"""
FUSED = """f0 AS (SELECT query_id, chunk_id, rank AS r, 0 AS list, 'bm25' AS source FROM bm UNION ALL SELECT query_id, chunk_id, rank, 1, 'overlap' FROM ov),
f1 AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS score, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources, min(list * 1000 + r) AS first FROM f0 GROUP BY 1, 2),
fu AS (SELECT query_id, chunk_id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM f1)"""


def indexed(spark, sf):
    """The index of the documents, written by the first query that asks for it."""
    return search.build_index(table(spark, sf, "documents"), "doc_id", "text", keep=kept)


def bm25(spark, sf, k: int = 40):
    return search.bm25_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), k, index=indexed(spark, sf))


def fused(spark, sf):
    overlap = search.overlap_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), index=indexed(spark, sf))
    return search.rrf_fuse([("bm25", bm25(spark, sf)), ("overlap", overlap)])


def vectors_of(rows, ident: str):
    """(ident, kb, vector): texts through the default embedder."""
    return enrich.embed(rows, ident, "text").withColumn("kb", F.lit(0))


def vector_hits(queries, documents, k: int):
    """(query_id, chunk_id, score, rank) by vectors: ``queries`` is (query_id, text), ``documents`` (chunk_id, kb, vector), stored."""
    hits = search.vector_topk(vectors_of(queries, "query_id"), documents.withColumnRenamed("chunk_id", "id"), k)
    return hits.withColumnRenamed("id", "chunk_id")


@register(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_terms FROM documents")
def tokenize_index(spark, sf):
    t = T.index_tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


@register(QKINDS)
def query_terms(spark, sf):
    return search.query_terms(table(spark, sf, "benchmark"), "item_id", "text")


@register(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM ({POST}) GROUP BY 1")
def inverted_index(spark, sf):
    return search.postings(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@register(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_topk(spark, sf):
    return bm25(spark, sf)


@register(f"WITH {BM25}, {OVERLAP}, {FUSED} SELECT * FROM fu")
def rrf_fuse(spark, sf):
    return fused(spark, sf)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kb"), F.col("embedding").alias("vector"))


DOT = "round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 6)"
VEC = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _topk(k: int, pairs: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({pairs})) WHERE rank <= {k}"


@register(_topk(10, f"SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS score FROM {VEC} a JOIN {VEC} b ON a.label = b.label WHERE a.vec_id % 20 = 0"))
def vector_topk_exact(spark, sf):
    v = _vectors(spark, sf)
    return search.vector_topk(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v)


@register()
def vector_topk_ann(spark, sf):
    v = _vectors(spark, sf)
    return search.vector_topk_ann(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v)


@register(_topk(5, f"SELECT a.s AS query_id, b.s AS id, {DOT} AS score FROM u a, u b WHERE a.s % 20 = 0").replace("SELECT * FROM (", "WITH l AS (SELECT vec_id // 2 AS s, arg_max(embedding::DOUBLE[], vec_id) AS w FROM embeddings GROUP BY 1), u AS (SELECT s, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v FROM l) SELECT * FROM (", 1))
def image_index_search(spark, sf):
    """The last vector of each source counts, a source has two; best five of every source whose number is divisible by 20."""
    v = _vectors(spark, sf).withColumn("source", F.floor(F.col("id") / 2))
    last = v.groupBy("source").agg(F.max_by("vector", "id").alias("vector")).select(F.col("source").alias("id"), F.lit(0).alias("kb"), search.unit(F.col("vector")).alias("vector"))
    return search.vector_topk(last.where("id % 20 = 0 AND vector IS NOT NULL").withColumnRenamed("id", "query_id"), search.or_zero(last), 5)


@register(_topk(6, f"SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS score FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"))
def similar_products(spark, sf):
    v = _vectors(spark, sf)
    return search.vector_topk(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 6, exclude_self=True)


@register(f"SELECT query_id, id AS entry_id, score FROM ({_topk(1, f'SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS score FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0')}) WHERE score >= 0.25")
def semantic_cache_probe(spark, sf):
    """Every twentieth vector against a cache of all others of its base; the best entry, if it is near enough."""
    v = _vectors(spark, sf)
    best = search.vector_topk(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 1, exclude_self=True)
    return best.where("score >= 0.25").select("query_id", F.col("id").alias("entry_id"), "score")


@register()
def semantic_cache_lookup(spark, sf):
    return search.semantic_cache(_vectors(spark, sf).withColumnRenamed("id", "seq"), threshold=0.6)


@register("SELECT p_partkey AS sku, arg_max(p_name, length(p_name)) AS title, round(avg(l_extendedprice / l_quantity), 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def catalogue_build(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 2).alias("price"))
    titles = table(spark, sf, "part").groupBy(F.col("p_partkey").alias("sku")).agg(F.max_by("p_name", F.length("p_name")).alias("title"))
    return titles.join(items, F.col("sku") == F.col("l_partkey")).select("sku", "title", "price")


UTTERANCES = ["How do I set up the device", "what's new in v 2", "error: cannot start", "你好", "what did you just say", "translate the above", "thanks!", "我要退货", "运费多少", "plus 会员", "JD1234567890 换货", "Order TB99887766 refund please", "换绑手机", "设为默认", "物流太慢了, 我要投诉12315", "质量差, 不满意", "个人抬头发票", "北京测试公司 91310000MA1K4AAA1X"]
_U = "'" + "','".join(x.replace("'", "''") for x in UTTERANCES) + "'"
TURNS = f"(SELECT conv_id, turn, CASE WHEN turn = 0 THEN [{_U}][(conv_id % {len(UTTERANCES)})::INT + 1] ELSE text END AS q FROM conversations)"


def said(text):
    """The text of a turn; the first of each conversation is one of a few utterances."""
    first = F.element_at(F.array(*map(F.lit, UTTERANCES)), (F.pmod("conv_id", F.lit(len(UTTERANCES))) + 1).cast("int"))
    return F.when(F.col("turn") == 0, first).otherwise(text)


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", said(F.col("text")).alias("q"))


@register(rf"SELECT conv_id, turn, regexp_replace(regexp_replace(q, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS q, CASE WHEN regexp_matches(q, '[一-鿿㐀-䶿豈-﫿]') THEN 'zh' ELSE 'en' END AS lang FROM {TURNS}")
def normalize_query(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", T.normalize_query(F.col("q")).alias("q"), T.query_language(F.col("q")).alias("lang"))


_META = "|".join(p.replace("(?!一?下)", "").replace("'", "''") for p in rules.META)
_CHAT = "|".join(p.replace("'", "''") for p in rules.CHITCHAT)


@register(rf"WITH t AS (SELECT conv_id, turn, regexp_replace(q, '^\s+|\s+$', '', 'g') AS q FROM {TURNS}) SELECT conv_id, turn, CASE WHEN q = '' THEN 'kb' WHEN regexp_matches(q, '(?i){_CHAT}') THEN 'chitchat' WHEN length(q) <= 40 AND regexp_matches(q, '(?i){_META}') THEN 'meta' ELSE 'kb' END AS intent FROM t")
def intent_route(spark, sf):
    route, matched = T.intent_route(F.col("q"))
    return turns(spark, sf).select("conv_id", "turn", route.alias("intent"))


_REL, _TRO, _HOW = (p.replace("'", "''") for p in (rules.RELEASE, rules.TROUBLE, rules.HOWTO))
INTENT = f"CASE WHEN regexp_matches(q, '{_REL}') THEN 'release' WHEN regexp_matches(q, '{_TRO}') THEN 'trouble' WHEN regexp_matches(q, '{_HOW}') THEN 'howto' ELSE 'neutral' END"


@register(f"SELECT conv_id, turn, {INTENT} AS intent FROM {TURNS}")
def query_intent(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", T.query_intent(F.col("q")).alias("intent"))


PATHS = "(SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN url || '/release-notes' WHEN 1 THEN url || '/FAQ' WHEN 2 THEN url || '/quickstart' WHEN 3 THEN url || '/issues/7' WHEN 4 THEN url || '/v2' ELSE url END AS path FROM pages)"
STYPE = r"CASE WHEN contains(lower(path), 'release') OR regexp_matches(lower(path), '/v[-_.]?\d') THEN 'release' WHEN contains(lower(path), 'faq') OR contains(lower(path), 'troubleshoot') THEN 'faq' WHEN contains(lower(path), 'getting-started') OR contains(lower(path), 'quickstart') OR contains(lower(path), 'getting_started') THEN 'getting_started' WHEN contains(lower(path), 'issue') OR contains(lower(path), 'github.com') THEN 'issue' ELSE 'doc' END"


def paths(spark, sf):
    tails = F.array(*map(F.lit, ("/release-notes", "/FAQ", "/quickstart", "/issues/7", "/v2", "")))
    return table(spark, sf, "pages").select("page_id", F.concat("url", F.element_at(tails, (F.pmod("page_id", F.lit(6)) + 1).cast("int"))).alias("path"))


@register(f"SELECT page_id, {STYPE} AS source_type FROM {PATHS}")
def infer_source_type(spark, sf):
    return paths(spark, sf).select("page_id", T.source_type(F.col("path")).alias("source_type"))


def priors(spark):
    return spark.createDataFrame([(a, b, x) for (a, b), x in rules.PRIORS.items()], "intent string, source_type string, prior double")


_PRIORS = "(VALUES " + ", ".join(f"('{a}', '{b}', {x})" for (a, b), x in rules.PRIORS.items()) + ") AS pr(intent, source_type, prior)"


@register(f"WITH t AS (SELECT conv_id, {INTENT} AS intent FROM {TURNS} WHERE turn = 0), p AS (SELECT page_id, {STYPE} AS source_type FROM {PATHS}) SELECT conv_id, t.intent, page_id, p.source_type, coalesce(prior, 0)::DOUBLE AS prior FROM t JOIN p ON page_id = conv_id LEFT JOIN {_PRIORS} ON pr.intent = t.intent AND pr.source_type = p.source_type")
def score_prior(spark, sf):
    t = turns(spark, sf).where("turn = 0").select("conv_id", T.query_intent(F.col("q")).alias("intent"))
    p = paths(spark, sf).select("page_id", T.source_type(F.col("path")).alias("source_type"))
    rows = t.join(p, F.col("page_id") == F.col("conv_id")).join(F.broadcast(priors(spark)), ["intent", "source_type"], "left")
    return rows.select("conv_id", "intent", "page_id", "source_type", F.coalesce("prior", F.lit(0.0)).alias("prior"))


def _first_rule_sql(col: str, entries) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in entries) + " END"


@register(f"SELECT conv_id, turn, {_first_rule_sql('lower(q)', rules.POLICY_FAMILIES)} AS family FROM {TURNS}")
def policy_filter_pick(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", T.first_rule(F.lower("q"), rules.POLICY_FAMILIES, None).alias("family"))


#: Every document as a chunk with metadata, and a filter for every benchmark item; each asks for one to four of the keys.
_MD = """(SELECT doc_id AS chunk_id, 'https://KB.example/' || source || ['/release-notes', '/FAQ', '/quickstart', '/issues/7', ''][(doc_id % 5)::INT + 1] AS path, 'Doc ' || doc_id AS title, upper(coalesce(lang, '')) || ' / Part ' || (doc_id % 7) AS section, [source, lang] AS entities, CASE WHEN doc_id % 4 <> 0 THEN ['topic_' || (doc_id % 6), 'how-to'] END AS topics, CASE WHEN doc_id % 13 <> 0 THEN '2024-0' || (1 + doc_id % 9) || '-15' END AS d FROM documents)"""
_FILTERS = """(SELECT item_id AS filter_id, CASE WHEN item_id % 3 = 0 THEN 'SRC1' || item_id % 2 END AS p, CASE WHEN item_id % 5 = 1 THEN 'c ' || item_id % 10 END AS t, CASE WHEN item_id % 7 = 2 THEN 'part ' || item_id % 9 END AS s, CASE WHEN item_id % 4 = 1 THEN ['faq', 'issue'] END AS y,
 CASE WHEN item_id % 5 = 3 THEN ['src' || item_id % 20 || 'x', 'zz'] END AS e, CASE WHEN item_id % 6 = 4 THEN ['pic_' || item_id % 6, 'none'] END AS o, CASE WHEN item_id % 4 = 2 THEN '2024-03' END AS a, CASE WHEN item_id % 8 < 6 THEN '2024-08-15' END AS b FROM benchmark)"""
_EITHER = "len(list_filter(coalesce({have}, []), lambda h: len(list_filter({want}, lambda w: contains(h, w) OR contains(w, h))) > 0)) > 0"


@register(f"""SELECT filter_id, chunk_id FROM (SELECT *, {STYPE} AS stype FROM {_MD}) c, {_FILTERS} f WHERE (p IS NULL OR contains(lower(path), lower(p))) AND (t IS NULL OR contains(lower(title), t)) AND (s IS NULL OR contains(lower(section), s)) AND (y IS NULL OR list_contains(y, stype))
AND (e IS NULL OR {_EITHER.format(have='entities', want='e')}) AND (o IS NULL OR {_EITHER.format(have='topics', want='o')}) AND (a IS NULL OR coalesce(d >= a, false)) AND (b IS NULL OR coalesce(d <= b, false))""")
def metadata_filter(spark, sf):
    """Every filter over all documents: substrings of path, title and section, source types, overlaps, date ranges; all of a filter's keys at once."""
    k = lambda n: F.pmod("doc_id", F.lit(n)).cast("int")
    text = lambda *xs: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in xs))
    tail = F.element_at(F.array(*map(F.lit, ("/release-notes", "/FAQ", "/quickstart", "/issues/7", ""))), k(5) + 1)
    chunks = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), text("https://KB.example/", F.col("source"), tail).alias("source_path"), text("Doc ", F.col("doc_id").cast("string")).alias("title"), F.array(F.upper(F.coalesce("lang", F.lit(""))), text("Part ", k(7).cast("string"))).alias("section_path"),
        F.array("source", "lang").alias("entities"), F.when(k(4) != 0, F.array(text("topic_", k(6).cast("string")), F.lit("how-to"))).alias("topics"), F.when(k(13) != 0, text("2024-0", (1 + k(9)).cast("string"), "-15")).alias("date"),
    )
    i = lambda n: F.pmod("item_id", F.lit(n))
    number = lambda n: i(n).cast("string")
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("filter_id"), F.when(i(3) == 0, text("SRC1", number(2))).alias("source_path_contains"), F.when(i(5) == 1, text("c ", number(10))).alias("title_contains"), F.when(i(7) == 2, text("part ", number(9))).alias("section_contains"),
        F.when(i(4) == 1, F.array(F.lit("faq"), F.lit("issue"))).alias("source_type"), F.when(i(5) == 3, F.array(text("src", number(20), "x"), F.lit("zz"))).alias("entities_contains"), F.when(i(6) == 4, F.array(text("pic_", number(6)), F.lit("none"))).alias("topics_contains"),
        F.when(i(4) == 2, "2024-03").alias("date_after"), F.when(i(8) < 6, "2024-08-15").alias("date_before"),
    )
    return filters.filter_chunks(chunks, asked)


#: Chunks as a reranker sees them: with a title and a path, from which the source type comes. The first eight fused hits are scored by the share of the query's words they hold.
_CHUNKS = """(SELECT doc_id AS chunk_id, 'Doc ' || doc_id AS title, coalesce(text, '') AS text, 'https://kb.example/' || source || ['/release-notes', '/FAQ', '/quickstart', '/issues/7', ''][(doc_id % 5)::INT + 1] AS path FROM documents)"""
_WORDS = r"list_distinct(regexp_extract_all(regexp_replace(lower({}), '([CJK])', ' \\1 ', 'g'), '[\p{{L}}\p{{N}}]+'))".replace("CJK", rules.CJK)
RERANK = f"""rw AS (SELECT fu.query_id, fu.chunk_id, {INTENT} AS intent, {STYPE} AS source_type, {_WORDS.format("q")} AS qw, {_WORDS.format("title || chr(10) || text")} AS cw FROM fu JOIN (SELECT item_id AS query_id, text AS q FROM benchmark) b ON b.query_id = fu.query_id JOIN {_CHUNKS} c ON c.chunk_id = fu.chunk_id WHERE fu.rank <= 8),
rr AS (SELECT query_id, chunk_id, intent, source_type, 8 * CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, cw))::DOUBLE / len(qw) END - 4 AS raw FROM rw),
rs AS (SELECT rr.*, coalesce(prior, 0) AS prior, round(greatest(0, least(1, 1 / (1 + exp(-raw)) + coalesce(prior, 0))), 6) AS score FROM rr LEFT JOIN {_PRIORS} ON pr.intent = rr.intent AND pr.source_type = rr.source_type),
rk AS (SELECT * FROM (SELECT query_id, chunk_id, score, prior, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rs) WHERE rank <= 8)"""


def as_chunks(spark, sf):
    """Documents as chunks with a title and a path."""
    tail = F.element_at(F.array(*map(F.lit, ("/release-notes", "/FAQ", "/quickstart", "/issues/7", ""))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("https://kb.example/"), "source", tail).alias("source_path"), "lang")


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def reranked(spark, sf):
    return search.rerank(asked(spark, sf), fused(spark, sf).where("rank <= 8"), as_chunks(spark, sf), priors(spark)).select("query_id", "chunk_id", "score", "prior", "rank")


@register(f"WITH {BM25}, {OVERLAP}, {FUSED}, {RERANK} SELECT query_id, chunk_id, score, prior::DOUBLE AS prior, rank FROM rk")
def rerank_adjust(spark, sf):
    return reranked(spark, sf)


@register()
def mmr_select(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return search.mmr_select(stored(reranked(spark, sf), "reranked").join(docs, "chunk_id"))


@register()
def hybrid_retrieve(spark, sf):
    """BM25 and vectors, three times forty of each because a filter on the language follows; the first eight are scored again as pairs, five diverse ones stay."""
    chunks = as_chunks(spark, sf)
    vectors = stored(vectors_of(chunks.select("chunk_id", "text"), "chunk_id"), "vectors")
    hits = stored(search.rrf_fuse([("bm25", bm25(spark, sf, k=120)), ("vector", vector_hits(asked(spark, sf), vectors, 120))]), "fused")
    first = search.top(hits.join(chunks.where("lang IN ('en', 'de', 'fr')").select("chunk_id"), "chunk_id").drop("rank"), "query_id", 8, F.desc("score"), F.col("chunk_id"))
    best = stored(search.rerank(asked(spark, sf), first, chunks, priors(spark)).select("query_id", "chunk_id", "score", "rank"), "best")
    return search.mmr_select(best.join(chunks.select("chunk_id", "text"), "chunk_id"))


@register()
def multi_query_fuse(spark, sf):
    """Each query and a variant of its second half, by BM25 and vectors, fused and made diverse per variant, fused again, and scored once against the query itself.

    Every candidate of the lists is scored and returned; ``fused`` is its place in the second fusion, of which the survey's source takes the first eight.
    """
    chunks, index = as_chunks(spark, sf), indexed(spark, sf)
    vectors = stored(vectors_of(chunks.select("chunk_id", "text"), "chunk_id"), "vectors")
    lists = []
    for name, text in (("whole", F.col("text")), ("half", F.expr("substr(text, cast(length(text) / 2 as int))"))):
        q = asked(spark, sf).select("query_id", text.alias("text"))
        own = stored(search.rrf_fuse([("bm25", search.bm25_topk(q, chunks, query_id="query_id", chunk_id="chunk_id", index=index)), ("vector", vector_hits(q, vectors, 40))]), "fused")
        lists.append((name, search.mmr_select(own.join(chunks.select("chunk_id", "text"), "chunk_id"), 40, rest=True).withColumnRenamed("position", "rank")))
    hits = stored(search.rrf_fuse(lists, depth=40).select("query_id", "chunk_id", F.col("rank").alias("fused")), "candidates")
    return search.rerank(asked(spark, sf), hits, chunks, priors(spark), None).select("query_id", "chunk_id", "score", "rank").join(hits, ["query_id", "chunk_id"])


@register(f"WITH {BM25}, hx AS (SELECT bm.*, CASE WHEN chunk_id % 4 = 0 THEN NULL ELSE 1000000 + chunk_id // 10 END AS parent_id FROM bm), b AS (SELECT query_id, coalesce(parent_id, chunk_id) AS target, arg_max({{'c': chunk_id, 'e': parent_id IS NOT NULL}}, {{'s': score, 'r': -rank}}) AS b, max(score) AS score FROM hx GROUP BY 1, 2) SELECT query_id, target AS chunk_id, b.c AS best_leaf, score, b.e AS expanded, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS rank FROM b")
def parent_expand(spark, sf):
    parents = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 4 != 0, F.floor(F.col("doc_id") / 10) + 1_000_000).alias("parent_id"))
    return search.parent_expand(bm25(spark, sf), parents)


@register(f"WITH {BM25}, {OVERLAP}, {FUSED}, {RERANK}, t AS (SELECT query_id, max(score) AS top FROM rk GROUP BY 1) SELECT item_id AS query_id, coalesce(top, 0) < 0.15 AS abstain, CASE WHEN top IS NULL THEN 'no_retrieval_hits' WHEN top < 0.15 THEN printf('top_score_below_threshold (%.3f)', top::DOUBLE) ELSE '' END AS reason FROM benchmark LEFT JOIN t ON query_id = item_id")
def abstain_decide(spark, sf):
    """Without hits, or with a best score below 0.15, a query gets no answer, for a reason that is told."""
    best = reranked(spark, sf).groupBy("query_id").agg(F.max("score").alias("top"))
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(best, "query_id", "left")
    reason = F.when(F.col("top").isNull(), F.lit(rules.ABSTAIN_NONE)).when(F.col("top") < 0.15, F.format_string(rules.ABSTAIN_LOW, "top")).otherwise("")
    return rows.select("query_id", (reason != "").alias("abstain"), reason.alias("reason"))


@register("SELECT conv_id, turn, starts_with(x, 'I cannot answer that') OR starts_with(x, 'I do not know the answer') AS abstained FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'I cannot answer that. ' ELSE '' END || text AS x FROM conversations WHERE role = 'assistant')")
def abstain_reply_detect(spark, sf):
    x = F.concat(F.when(F.col("conv_id") % 3 == 0, "I cannot answer that. ").otherwise(""), "text")
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", (F.startswith(x, F.lit("I cannot answer that")) | F.startswith(x, F.lit("I do not know the answer"))).alias("abstained"))


_ANS = "(SELECT item_id, substr(text, 1, 30) || ' [2] and [1], again [2] and [9]. ' || text || ' [' || (item_id % 5) || ']' AS a FROM benchmark)"


@register(f"WITH {BM25}, r AS (SELECT item_id, unnest(regexp_extract_all(a, '\\[(\\d+)\\]', 1)) AS n, generate_subscripts(regexp_extract_all(a, '\\[(\\d+)\\]', 1), 1) AS pos FROM {_ANS}), f AS (SELECT item_id, n::INT AS n, min(pos) AS pos FROM r GROUP BY 1, 2) SELECT f.item_id AS query_id, f.n, row_number() OVER (PARTITION BY f.item_id ORDER BY pos) AS nth, bm.chunk_id, substr(d.text, 1, 240) AS snippet FROM f JOIN bm ON bm.query_id = f.item_id AND bm.rank = f.n AND bm.rank <= 5 JOIN documents d ON d.doc_id = bm.chunk_id")
def citation_parse(spark, sf):
    """Markers of an answer in the order of their first place, those in range, with the hit they point to."""
    from pyspark.sql import Window

    a = F.concat(F.substring("text", 1, 30), F.lit(" [2] and [1], again [2] and [9]. "), "text", F.lit(" ["), (F.col("item_id") % 5).cast("string"), F.lit("]"))
    marks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.regexp_extract_all(a, F.lit(r"\[(\d+)\]"), 1)).alias("pos", "n")).groupBy("query_id", F.col("n").cast("int").alias("rank")).agg(F.min("pos").alias("pos"))
    hits = bm25(spark, sf).where("rank <= 5").join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 240).alias("snippet")), "chunk_id")
    return marks.join(hits, ["query_id", "rank"]).select("query_id", F.col("rank").alias("n"), F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("nth"), "chunk_id", "snippet")


@register(f"WITH {BM25}, c AS (SELECT query_id, rank, '[' || rank || '] doc-' || chunk_id || chr(10) || substr(text, 1, greatest(400, 6000 // count(*) OVER (PARTITION BY query_id))::INT) AS b FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 5) SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM c GROUP BY 1")
def context_assemble(spark, sf):
    """Numbered blocks of the first five hits, each cut to its share of 6,000 characters, 400 at least."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = bm25(spark, sf).where("rank <= 5").join(docs, "chunk_id").withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    cut = F.col("text").substr(F.lit(1), F.greatest(F.lit(400), F.floor(6000 / F.col("n")).cast("int")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] doc-"), F.col("chunk_id").cast("string"), F.lit("\n"), cut)
    return hits.select("query_id", F.struct("rank", block.alias("b")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context"))


@register()
def extractive_answer(spark, sf):
    """The leading sentences of the first three hits of each query, in their frame."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), "text")
    return search.extractive_answers(queries, bm25(spark, sf).where("rank <= 3").join(docs, "chunk_id"))


#: A verifier's reply to each answer: some sentences are not supported, some replies are cut short or hold no JSON, some numbers are of no sentence.
@register(rf"""WITH s AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。!?.])', E'\\1\x01', 'g'), E'\x01|\n+'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS xs FROM (SELECT conv_id, turn, text || ' See [2] and [10].' AS text FROM conversations WHERE role = 'assistant')),
v AS (SELECT *, conv_id % 11 <> 0 AND conv_id % 7 <> 0 AS told, list_transform(range(1, len(xs) + 1), lambda k: conv_id % 11 = 0 OR conv_id % 7 = 0 OR ((conv_id + turn + k) % 3 <> 0 AND (conv_id + turn + k) % 5 <> 0)) AS ok FROM s),
r AS (SELECT conv_id, turn, told, text, xs, ok, len(list_filter(ok, lambda b: NOT b)) AS unsupported, CASE WHEN told THEN array_to_string(list_transform(range(1, len(xs) + 1), lambda k: CASE WHEN ok[k] THEN xs[k] ELSE '⚠ ' || xs[k] END), ' ') ELSE text END AS flagged FROM v)
SELECT conv_id, turn, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS sentence, unnest(ok) AS supported, unnest(list_transform(xs, lambda x: array_to_string(regexp_extract_all(x, '\[(\d+)\]', 1), ','))) AS cited, unsupported, md5(flagged) AS flagged_md5 FROM r""")
def grounding_report(spark, sf):
    """Every sentence of every answer with its verdict and citations, and with its answer's number of unsupported ones and flagged text."""
    answers = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" See [2] and [10].")).alias("text"))
    some = answers.withColumn("n", F.size(T.verifier_sentences(F.col("text"))))
    at = lambda k: F.col("conv_id") + F.col("turn") + k
    one = lambda k: F.concat(F.lit('{"i": '), k.cast("string"), F.when(at(k) % 3 == 0, ', "supported": false, "reasoning": " not said "}').when(at(k) % 5 == 0, ', "supported": null}').when(k % 4 == 1, "}").otherwise(', "supported": true}'))
    whole = F.concat(F.lit("Verdict: ["), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") + 1), one), ", "), F.lit("] done"))
    reply = F.when(F.col("conv_id") % 11 == 0, "all fine").when(F.col("conv_id") % 7 == 0, '[{"i": 1, "supported": false}, {"i": 2, "supp]').otherwise(whole)
    told = grounding.ground(some.withColumn("reply", reply))
    rows = told.select("conv_id", "turn", "unsupported", F.md5("flagged").alias("flagged_md5"), F.explode("sentences").alias("s"))
    return rows.select("conv_id", "turn", F.col("s.i").alias("i"), F.col("s.text").alias("sentence"), F.col("s.supported").alias("supported"), F.array_join(F.transform("s.cited", lambda n: n.cast("string")), ",").alias("cited"), "unsupported", "flagged_md5")


@register("SELECT query_id, step, pos, row_number() OVER (PARTITION BY query_id ORDER BY step, pos) AS n FROM (SELECT conv_id AS query_id, turn // 2 AS step, turn % 2 AS pos FROM conversations GROUP BY ALL)")
def citation_renumber(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.floor(F.col("turn") / 2).alias("step"), (F.col("turn") % 2).alias("pos")).distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("step", "pos")))
