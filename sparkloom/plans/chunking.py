"""Registered queries: sections, packing, parents and leaves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk
from .registry import register, scratch, table

#: Documents have no headings: the first two lines of text get some.
HEADED = "(SELECT doc_id, 'intro ' || doc_id || chr(10) || '# A' || doc_id || chr(10) || substr(text, 1, 100) || chr(10) || '## B' || chr(10) || substr(text, 101, 200) || chr(10) || '# C' || chr(10) || substr(text, 301) AS text FROM (SELECT doc_id, replace(text, '#', '') AS text FROM documents))"


def headed(spark, sf):
    n = F.lit("\n")
    docs = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("#"), F.lit("")))
    t = F.concat(F.lit("intro "), F.col("doc_id").cast("string"), n, F.lit("# A"), F.col("doc_id").cast("string"), n, F.substring("text", 1, 100), n, F.lit("## B"), n, F.substring("text", 101, 200), n, F.lit("# C"), n, F.expr("substr(text, 301)"))
    return docs.select("doc_id", t.alias("text"))


SECTIONS = rf"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {HEADED}),
s AS (SELECT *, sum((regexp_matches(line, '^#{{1,6}}\s+\S'))::INT) OVER (PARTITION BY id ORDER BY n) AS section FROM l),
b AS (SELECT id, section, trim(string_agg(line, chr(10) ORDER BY n) FILTER (NOT regexp_matches(line, '^#{{1,6}}\s+\S')), E' \n\t\r') AS body FROM s GROUP BY 1, 2)
SELECT id, section::BIGINT AS section, CASE section WHEN 0 THEN '' WHEN 1 THEN 'A' || id WHEN 2 THEN 'A' || id || '/B' ELSE 'C' END AS path, body FROM b WHERE body <> ''"""


@register(SECTIONS)
def split_sections(spark, sf):
    rows = chunk.split_sections(headed(spark, sf))
    return rows.select("id", F.col("section").cast("long").alias("section"), F.array_join("path", "/").alias("path"), "body")


#: Blank lines after every second sentence end of every other document, so that there are paragraphs of many sizes.
def blocks(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"([.!?] [^.!?]*[.!?]) ", "$1\n\n")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


_COUNT = "len(regexp_extract_all({x}, '[A-Za-z0-9_]+')) + len(regexp_extract_all({x}, '[一-鿿]'))"
_CUT = r"unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([.!?。])\s+', E'\\1\x01', 'g'), E'\x01|\n+'), lambda y: trim(y, E' \t\r\n')), lambda y: y <> ''))"


#: Paragraphs, the long ones as sentences, by number; a running fill that starts anew at both ends of a long one.
@register(rf"""WITH RECURSIVE b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '([.!?] [^.!?]*[.!?]) ', E'\\1\n\n', 'g') ELSE text END AS text FROM documents),
p AS (SELECT doc_id, trim(unnest(x), E' \t\r\n') AS p, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS x FROM b)),
q AS (SELECT doc_id, k, p, {_COUNT.format(x="p")} >= 675 AS big FROM p WHERE p <> ''),
u AS (SELECT doc_id, k, p, big, 0 AS j FROM q WHERE NOT big UNION ALL SELECT doc_id, k, s, true, row_number() OVER (PARTITION BY doc_id, k) FROM (SELECT doc_id, k, {_CUT.format(x="p")} AS s FROM q WHERE big)),
l AS (SELECT doc_id, k, p, big, {_COUNT.format(x="p")} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS n FROM u),
f AS (SELECT doc_id, 0::BIGINT AS n, -1::BIGINT AS part, 0::BIGINT AS total, NULL::BIGINT AS k, NULL::BOOLEAN AS big FROM (SELECT DISTINCT doc_id FROM l)
UNION ALL SELECT doc_id, n, CASE WHEN fits THEN part ELSE part + 1 END, CASE WHEN fits THEN total + t ELSE t END, k, big FROM
(SELECT f.doc_id, l.n, f.part, f.total, l.t, l.k, l.big, coalesce(l.big = f.big AND (NOT l.big OR l.k = f.k) AND f.total + l.t <= 450, false) AS fits FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1))
SELECT f.doc_id, part, CASE WHEN any_value(l.big) THEN string_agg(p, ' ' ORDER BY f.n) ELSE string_agg(p, chr(10) || chr(10) ORDER BY f.n) END AS chunk FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n GROUP BY 1, 2""")
def pack_paragraphs(spark, sf):
    rows = blocks(spark, sf).select("doc_id", F.posexplode(chunk.pack_paragraphs(F.col("text"), 450)).alias("part", "chunk"))
    return rows.withColumn("part", F.col("part").cast("long"))


#: Sentences and lines by number, then a running fill.
@register(rf"""WITH RECURSIVE p AS (SELECT doc_id, trim(unnest(x), E' \t\r\n') AS p, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?。])\s+', E'\\1\x01', 'g'), E'\x01|\n+') AS x FROM documents)),
l AS (SELECT doc_id, p, {_COUNT.format(x="p")} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM p WHERE p <> ''),
f AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS part, 0::BIGINT AS total FROM (SELECT DISTINCT doc_id FROM l)
UNION ALL SELECT f.doc_id, l.n, CASE WHEN f.n = 0 OR total + t <= 450 THEN part ELSE part + 1 END, CASE WHEN f.n = 0 OR total + t <= 450 THEN total + t ELSE t END FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT f.doc_id, part, string_agg(p, ' ' ORDER BY f.n) AS chunk FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n GROUP BY 1, 2""")
def split_long(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.split_long(F.col("text"), 450)).alias("part", "chunk"))
    return rows.withColumn("part", F.col("part").cast("long"))


@register(rf"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS p, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS n FROM documents),
r AS (SELECT *, sum(greatest(1, {_COUNT.format(x="p")})) OVER (PARTITION BY doc_id ORDER BY n DESC) AS so_far FROM w WHERE p <> ''), t AS (SELECT doc_id, string_agg(p, ' ' ORDER BY n) AS tail FROM r WHERE so_far <= 80 GROUP BY 1)
SELECT doc_id, CASE WHEN {_COUNT.format(x="text")} <= 80 THEN text ELSE coalesce(tail, '') END AS tail FROM documents LEFT JOIN t USING (doc_id)""")
def tail_overlap(spark, sf):
    """What the chunk after each document would begin with."""
    return table(spark, sf, "documents").select("doc_id", chunk.tail_overlap(F.col("text"), 80).alias("tail"))


@register()
def parent_leaf_chunks(spark, sf):
    """Sections with blank lines in their bodies, so that long ones have several parents and leaves."""
    rows = headed(spark, sf).withColumn("text", F.regexp_replace("text", r"([.!?] [^.!?]*[.!?]) ", "$1\n\n"))
    return chunk.parent_leaf_chunks(rows).withColumn("section_path", F.array_join("section_path", "/"))


@register()
def parentify_whole(spark, sf, name="parents"):
    """One parent per source, of the whole texts of all its documents, as ordered pieces."""
    return chunk.parentify(table(spark, sf, "documents").select("source", F.col("doc_id").alias("leaf_id"), "text"), scratch(spark, name))


#: Of each piece its place, and its text without the white space at both ends, by hash.
@register(r"""SELECT coalesce(source, '') || '::parent' AS parent_id, doc_id AS leaf_id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS position, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS piece FROM documents""")
def parentify(spark, sf):
    """Every leaf, its parent, and its piece of the parent's text."""
    rows = parentify_whole(spark, sf, "parentify")
    return rows.select("parent_id", "leaf_id", F.col("position").cast("long").alias("position"), F.md5(T.trimmed(F.col("text"))).alias("piece"))


@register(r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([。!?;])', E'\\1\x01', 'g'), '\.\s+', E'.\x01', 'g'), E'\x01|\n{2,}'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')) AS x FROM documents) SELECT doc_id, count(*) AS n, sum(length(x))::BIGINT AS chars FROM s GROUP BY 1""")
def split_sentences(spark, sf):
    s = T.sentences(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(s).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("chars"))


#: Vectors stand for sentences; sixteen that follow each other are a document.
DIST = "SELECT vec_id // 16 AS doc, vec_id, round(1 - least(1, greatest(-1, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w[i])))), 6) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) AS w FROM embeddings) WHERE w IS NOT NULL"


def distances(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 16))
    rows = rows.withColumn("before", F.lag("embedding").over(Window.partitionBy("doc").orderBy("vec_id"))).where("before IS NOT NULL")
    dot = T.cosine(F.col("embedding"), F.col("before"))
    return rows.select("doc", "vec_id", F.round(1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)), 6).alias("distance"))


@register(DIST)
def adjacent_distance(spark, sf):
    """One minus the inner product of a vector and the one before it, as of a document's sentences."""
    return distances(spark, sf)


#: The sentences of documents in order, as ``split_sentences`` cuts them.
SENTENCES = r"""SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '([。!?;])', E'\\1\x01', 'g'), '\.\s+', E'.\x01', 'g'), E'\x01|\n{2,}'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS xs FROM documents)"""
#: Hashed trigrams, distances, the percentile of each document; then a walk over its sentences with what is gathered (n), whether a chunk is open, and the tokens of a piece of an oversized group (h).
SEMANTIC = rf"""WITH RECURSIVE s AS ({SENTENCES}), b AS (SELECT doc_id, i, x, hex(encode(lower(x))) AS h FROM s),
bytes AS (SELECT doc_id, i, list_transform(range(len(h) // 2), lambda k: instr('123456789ABCDEF', substr(h, 2 * k + 1, 1)) * 16 + instr('123456789ABCDEF', substr(h, 2 * k + 2, 1))) AS y FROM b),
grams AS (SELECT doc_id, i, unnest(CASE WHEN len(y) >= 3 THEN list_transform(range(1, len(y) - 1), lambda k: (((y[k] * 65599 + y[k + 1] * 257 + y[k + 2]) * 2654435761) & 4294967295) >> 26) ELSE [(list_sum(y) % 64)::BIGINT] END) AS g FROM bytes),
counts AS (SELECT doc_id, i, g, count(*) AS c FROM grams GROUP BY ALL), norms AS (SELECT doc_id, i, sqrt(sum(c * c)) AS w FROM counts GROUP BY ALL),
dots AS (SELECT a.doc_id, a.i, sum(a.c * b.c) AS dot FROM counts a JOIN counts b ON a.doc_id = b.doc_id AND b.i = a.i - 1 AND a.g = b.g GROUP BY ALL),
d AS (SELECT n.doc_id, n.i, round(1 - least(1, coalesce(dot, 0) / (n.w * m.w)), 6) AS distance FROM norms n JOIN norms m ON m.doc_id = n.doc_id AND m.i = n.i - 1 LEFT JOIN dots ON dots.doc_id = n.doc_id AND dots.i = n.i),
p AS (SELECT doc_id, quantile_cont(distance, 0.95) AS cut FROM d GROUP BY 1),
t AS (SELECT s.doc_id, s.i, x, len(regexp_extract_all(x, '[A-Za-z0-9_]+')) + len(regexp_extract_all(x, '[一-鿿]')) AS n, s.i = 0 OR coalesce(distance >= cut, false) AS starts FROM s LEFT JOIN d ON d.doc_id = s.doc_id AND d.i = s.i LEFT JOIN p ON p.doc_id = s.doc_id),
g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM t), q AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, grp)::BIGINT AS whole FROM g),
walk AS (SELECT doc_id, -1::BIGINT AS i, -1::BIGINT AS ord, 0::BIGINT AS n, false AS open, false AS hard, 0::BIGINT AS h FROM q WHERE i = 0
UNION ALL SELECT doc_id, i,
 CASE WHEN starts AND joins THEN CASE WHEN open THEN ord ELSE ord + 1 END WHEN starts THEN ord + 1 WHEN hard AND h + own > 800 THEN ord + 1 ELSE ord END,
 CASE WHEN starts AND joins THEN n + whole WHEN starts AND whole > 800 THEN 0 WHEN starts THEN whole ELSE n END,
 CASE WHEN starts THEN joins OR whole <= 800 ELSE open END, CASE WHEN starts THEN NOT joins AND whole > 800 ELSE hard END,
 CASE WHEN starts OR h + own > 800 THEN own ELSE h + own END
FROM (SELECT w.doc_id, q.i, w.ord, w.n, w.open, w.hard, w.h, q.n AS own, q.whole, q.starts, w.n < 150 AND w.n + q.whole <= 800 AS joins FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i + 1))"""


@register(SEMANTIC + " SELECT w.doc_id, ord, md5(string_agg(x, ' ' ORDER BY w.i)) AS text_md5, count(*) AS n_sentences, sum(q.n)::BIGINT AS token_count FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i GROUP BY 1, 2")
def semantic_split(spark, sf):
    """Chunks of all documents that end where neighbouring sentences differ most, each whole text by hash."""
    rows = chunk.semantic_split(table(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "ord", F.md5("text").alias("text_md5"), "n_sentences", "token_count")
