"""Registered queries: listings, registry, sync, knowledge bases, file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, kb, support, sync
from ..sources import files
from ..streaming import streams
from .registry import register, scratch, table

_SIDE = "SELECT 'd' || doc_id AS source_id, {cheap} AS cheap_hash, sha256({text}) AS content_hash, {title} AS title FROM documents WHERE {where}"
LISTING = "(" + _SIDE.format(cheap="CASE WHEN doc_id % 4 = 0 THEN 'old' || doc_id WHEN doc_id % 11 = 0 THEN NULL ELSE 'new' || doc_id END", text="CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END", title="CASE WHEN doc_id % 2 = 0 THEN source END", where="doc_id % 10 <> 9") + ")"
REGISTRY = "(" + _SIDE.format(cheap="'old' || doc_id", text="text", title="lang", where="doc_id % 10 <> 8").replace(" AS title FROM", " AS title, 2::BIGINT AS chunk_count FROM") + ")"
DIFF = f"(SELECT coalesce(l.source_id, r.source_id) AS source_id, CASE WHEN r.source_id IS NULL THEN 'add' WHEN l.source_id IS NULL THEN 'delete' WHEN l.cheap_hash = r.cheap_hash THEN 'skip' WHEN l.content_hash = r.content_hash THEN 'skip' ELSE 'update' END AS action, r.source_id IS NOT NULL AND l.source_id IS NOT NULL AND NOT coalesce(l.cheap_hash = r.cheap_hash, false) AND l.content_hash = r.content_hash AS refresh FROM {LISTING} l FULL JOIN {REGISTRY} r ON l.source_id = r.source_id)"


def _id(prefix: str):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"))


def listing(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 10 <> 9")
    cheap = F.when(F.col("doc_id") % 4 == 0, _id("old")).when(F.col("doc_id") % 11 == 0, None).otherwise(_id("new"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select(_id("d").alias("source_id"), cheap.alias("cheap_hash"), F.sha2(text, 256).alias("content_hash"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"))


def registry_(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 10 <> 8")
    return d.select(_id("d").alias("source_id"), _id("old").alias("cheap_hash"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("title"), F.lit(2).cast("long").alias("chunk_count"))


def changes(spark, sf):
    return sync.diff(listing(spark, sf), registry_(spark, sf))


@register(f"SELECT source_id, action, coalesce(refresh, false) AS refresh FROM {DIFF}")
def sync_diff(spark, sf):
    return changes(spark, sf)


#: What cleaning counted for each document that was read, and the documents that could not be.
_CLEANED = "(SELECT 'd' || doc_id AS source_id, doc_id % 37 = 5 AS failed, length(text) % 4 AS pii_redactions, length(text) % 3 AS low_info_dropped, doc_id % 2 AS dedup_dropped FROM documents)"


@register(f"WITH d AS (SELECT d.*, failed AND action IN ('add', 'update') AS bad, action IN ('add', 'update') AND NOT failed AS done, pii_redactions, low_info_dropped, dedup_dropped FROM {DIFF} d JOIN {_CLEANED} USING (source_id)) SELECT count(*) FILTER (action = 'add' AND NOT bad) AS added, count(*) FILTER (action = 'update' AND NOT bad) AS updated, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (bad) AS errors, sum(pii_redactions) FILTER (done)::BIGINT AS pii_redactions, sum(low_info_dropped) FILTER (done)::BIGINT AS low_info_dropped, sum(dedup_dropped) FILTER (done)::BIGINT AS dedup_dropped FROM d")
def sync_summary(spark, sf):
    """One row for a sync: what became of the documents, how many failed, and what cleaning took out of those that were read."""
    n = F.length("text")
    cleaned = table(spark, sf, "documents").select(_id("d").alias("source_id"), F.when(F.col("doc_id") % 37 == 5, "unreadable").alias("error"), (n % 4).alias("pii_redactions"), (n % 3).alias("low_info_dropped"), (F.col("doc_id") % 2).alias("dedup_dropped"))
    return sync.summary(changes(spark, sf), cleaned)


@register(f"SELECT source_id, part, false AS fresh FROM (SELECT source_id, unnest([0, 1]) AS part FROM {REGISTRY}) WHERE source_id NOT IN (SELECT source_id FROM {DIFF} WHERE action IN ('update', 'delete')) UNION ALL SELECT source_id, part, true FROM (SELECT source_id, unnest([0, 1, 2]) AS part FROM {DIFF} WHERE action IN ('add', 'update'))")
def sync_apply_chunks(spark, sf):
    old = registry_(spark, sf).select("source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), F.lit(False).alias("fresh"))
    change = changes(spark, sf)
    new = change.where("action IN ('add', 'update')").select("source_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part"), F.lit(True).alias("fresh"))
    return sync.apply_chunks(old, change, new)


#: Old rows keep a note; listed ones bring their suffix, and every fifth a note of its own.
_EXTRA_SQL = "CASE WHEN r.source_id IS NULL THEN CASE WHEN substr(d.source_id, 2)::BIGINT % 5 = 0 THEN 'note=new,suffix=md' ELSE 'suffix=md' END WHEN action = 'skip' AND NOT coalesce(refresh, false) THEN 'note=old' WHEN substr(d.source_id, 2)::BIGINT % 5 = 0 THEN 'note=new,suffix=md' ELSE 'note=old,suffix=md' END"


@register(f"SELECT d.source_id, l.cheap_hash, l.content_hash, coalesce(l.title, r.title) AS title, CASE WHEN action IN ('add', 'update') THEN 3 ELSE coalesce(r.chunk_count, 0) END AS chunk_count, {_EXTRA_SQL} AS extra FROM {DIFF} d JOIN {LISTING} l ON l.source_id = d.source_id LEFT JOIN {REGISTRY} r ON r.source_id = d.source_id WHERE action <> 'delete'")
def registry_upsert(spark, sf):
    change = changes(spark, sf)
    counts = change.where("action IN ('add', 'update')").select("source_id", F.lit(3).cast("long").alias("chunk_count"))
    note = F.expr("substr(source_id, 2)").cast("long") % 5 == 0
    listed = listing(spark, sf).withColumn("extra", F.when(note, F.create_map(F.lit("suffix"), F.lit("md"), F.lit("note"), F.lit("new"))).otherwise(F.create_map(F.lit("suffix"), F.lit("md"))))
    held = registry_(spark, sf).withColumn("extra", F.create_map(F.lit("note"), F.lit("old")))
    rows = sync.upsert_registry(held, listed, change, counts)
    pairs = F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.withColumn("extra", F.array_join(pairs, ","))


@register("SELECT source AS kb_id, count(*) AS chunk_count, count(*) FILTER (doc_id % 5 <> 0) AS leaves FROM documents GROUP BY 1")
def kb_manifest(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("kb_id")).agg(F.count("*").alias("chunk_count"), F.count_if(F.col("doc_id") % 5 != 0).alias("leaves"))


_KB_CHUNKS = "(SELECT 'kb::' || source AS source_id, doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://kb.example/' || source || '/' || lang || '/page-' || doc_id || '.md' END AS source_path, source || ' in ' || lang AS title, coalesce(text, '') AS text FROM documents)"


@register(f"SELECT source_id, min_by(title, ord) AS title, min_by(CASE WHEN source_path = '' THEN source_id ELSE string_split(source_path, '/')[-1] END, ord) AS file_name, count(*) AS section_count, sum(length(text))::BIGINT AS char_count FROM {_KB_CHUNKS} GROUP BY 1")
def kb_documents_listing(spark, sf):
    """The sources of a knowledge base: title and file name of the first chunk, the number of chunks and of characters."""
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://kb.example/"), "source", F.lit("/"), "lang", F.lit("/page-"), F.col("doc_id").cast("string"), F.lit(".md")))
    chunks = d.select(F.concat(F.lit("kb::"), "source").alias("source_id"), F.col("doc_id").alias("ord"), path.alias("source_path"), F.concat("source", F.lit(" in "), "lang").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return sync.documents_listing(chunks)


@register("SELECT doc_id AS chunk_id, source AS source_id, text FROM documents")
def chunks_jsonl_io(spark, sf):
    """Chunks written as JSON lines and read again with their schema."""
    from .registry import scratch

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), "text")
    path = scratch(spark, "chunks")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@register("SELECT text AS query, 'kb' AS kb_id, 'd' || item_id AS relevant FROM benchmark WHERE item_id % 4 <> 0")
def eval_jsonl_scan(spark, sf):
    """Evaluation rows as lines: comments and blanks are skipped, the rest is JSON."""
    from .registry import scratch

    line = F.to_json(F.struct(F.col("text").alias("query"), F.lit("kb").alias("kb_id"), F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("relevant")))
    path = scratch(spark, "eval")
    table(spark, sf, "benchmark").select(F.when(F.col("item_id") % 8 == 0, "# comment").when(F.col("item_id") % 4 == 0, "  ").otherwise(line).alias("value")).write.text(path)
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(F.from_json("value", "query string, kb_id string, relevant string").alias("r")).select("r.*")


@register("""WITH f AS (SELECT source, doc_id % 16 AS bucket, string_agg(doc_id || ' ' || replace(coalesce(text, ''), chr(10), ' ') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1, 2)
SELECT source, bucket, strlen(body) AS bytes, bucket % 4 <> 0 AS opened, CASE WHEN bucket % 4 <> 0 THEN sha256(body) END AS content_hash FROM f""")
def scan_files(spark, sf):
    """A folder of files listed without opening any; then the contents of those whose cheap hash the registry does not have, here three quarters."""
    path = scratch(spark, "files")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = table(spark, sf, "documents").select("source", F.pmod("doc_id", F.lit(16)).alias("bucket"), "doc_id", line.alias("value"))
    rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id").drop("doc_id").write.partitionBy("source", "bucket").text(path)
    found = files.listing(spark, path, "kb").withColumn("source", F.regexp_extract("uri", "source=([^/]+)/", 1)).withColumn("bucket", F.regexp_extract("uri", "bucket=([0-9]+)/", 1).cast("long"))
    changed = found.where("bucket % 4 <> 0")
    hashes = files.contents(changed).select("uri", F.sha2("content", 256).alias("content_hash"))
    return found.join(hashes, "uri", "left").select("source", "bucket", "bytes", F.col("content_hash").isNotNull().alias("opened"), "content_hash")


KINDS = ["heading_1", "paragraph", "bulleted_list_item", "numbered_list_item", "to_do", "quote", "callout", "code", "divider", "toggle", "image", "bookmark", "child_page", "heading_2", "heading_3", "table"]


def as_blocks(docs):
    """The lines of documents as flat blocks of all types, nested five deep: of every six lines the second to fifth stand below each other, the sixth beside the fourth."""
    rows = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "t"))
    k, n = F.col("n") % 6, F.col("n")
    up = F.when(k.between(1, 4), n - 1).when(k == 5, n - 3)
    mark = lambda m, r: ((F.col("page_id") + n) % m == r)
    run = F.struct(F.col("t").alias("plain_text"), mark(7, 0).alias("code"), mark(5, 1).alias("bold"), mark(5, 2).alias("italic"), mark(9, 3).alias("strikethrough"), F.when(mark(8, 4), "https://l.example").alias("link"))
    tail = F.struct(F.lit(" end").alias("plain_text"), *(F.lit(None).cast("boolean").alias(c) for c in ("code", "bold", "italic", "strikethrough")), F.lit(None).cast("string").alias("link"))
    return rows.select("page_id", n.cast("long").alias("block_id"), up.cast("long").alias("parent_id"), n.alias("pos"), F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("page_id") + n) % len(KINDS) + 1).cast("int")).alias("type"), F.when(mark(10, 9), F.array().cast(blocks.RICH)).otherwise(F.array(run, tail)).alias("rich_text"),
                       F.when(mark(3, 0), F.array(run)).alias("caption"), mark(2, 0).alias("checked"), F.when(mark(4, 1), "py").alias("language"), F.when(mark(3, 1), "https://u.example/x").alias("url"), F.when(mark(3, 2), F.col("t")).alias("title"))


def _run_sql() -> str:
    x = "t"
    for m, r, mark in ((7, 0, "`"), (5, 1, "**"), (5, 2, "*"), (9, 3, "~~")):
        x = f"CASE WHEN (page_id + n) % {m} = {r} THEN '{mark}' || {x} || '{mark}' ELSE {x} END"
    return f"CASE WHEN t = '' THEN '' WHEN (page_id + n) % 8 = 4 THEN '[' || {x} || '](https://l.example)' ELSE {x} END"


@register(rf"""WITH RECURSIVE l AS (SELECT doc_id AS page_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
b AS (SELECT *, CASE WHEN n % 6 BETWEEN 1 AND 4 THEN n - 1 WHEN n % 6 = 5 THEN n - 3 END AS up, {KINDS}[((page_id + n) % {len(KINDS)})::INT + 1] AS kind, CASE WHEN (page_id + n) % 10 = 9 THEN '' ELSE ({_run_sql()}) || ' end' END AS x, CASE WHEN (page_id + n) % 3 = 0 THEN {_run_sql()} ELSE '' END AS c, CASE WHEN (page_id + n) % 3 = 1 THEN 'https://u.example/x' ELSE '' END AS u FROM l),
w AS (SELECT page_id, n, 0 AS depth, [n] AS path FROM b WHERE up IS NULL UNION ALL SELECT b.page_id, b.n, depth + 1, list_append(path, b.n) FROM w JOIN b ON b.page_id = w.page_id AND b.up = w.n WHERE depth < 3),
m AS (SELECT page_id, n, depth, path, CASE kind WHEN 'heading_1' THEN '# ' || x WHEN 'heading_2' THEN '## ' || x WHEN 'heading_3' THEN '### ' || x WHEN 'paragraph' THEN x WHEN 'toggle' THEN x WHEN 'bulleted_list_item' THEN repeat('  ', depth) || '- ' || x WHEN 'numbered_list_item' THEN repeat('  ', depth) || '1. ' || x
 WHEN 'to_do' THEN repeat('  ', depth) || CASE WHEN (page_id + n) % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END || x WHEN 'quote' THEN '> ' || x WHEN 'callout' THEN '> ' || x WHEN 'code' THEN '```' || CASE WHEN (page_id + n) % 4 = 1 THEN 'py' ELSE '' END || chr(10) || x || chr(10) || '```' WHEN 'divider' THEN '---'
 WHEN 'image' THEN CASE WHEN u <> '' THEN '![' || c || '](' || u || ')' ELSE '*[Image]* ' || c END WHEN 'bookmark' THEN '[' || CASE WHEN c <> '' THEN c ELSE u END || '](' || u || ')' WHEN 'child_page' THEN '### ' || CASE WHEN (page_id + n) % 3 = 2 AND t <> '' THEN t ELSE 'Untitled page' END ELSE '<!-- unsupported block: ' || kind || ' -->' END AS text FROM w JOIN b USING (page_id, n))
SELECT page_id, n AS block_id, depth, row_number() OVER (PARTITION BY page_id ORDER BY path) AS position, text FROM m WHERE text <> ''""")
def block_tree_render(spark, sf):
    """Blocks in a flat table, here the lines of all documents, as the pieces of their pages' Markdown in order."""
    rows = blocks.render(as_blocks(table(spark, sf, "documents")), scratch(spark, "blocks"))
    return rows.select("page_id", "block_id", "depth", F.col("position").cast("long").alias("position"), "text")


@register("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END, 'legacy') AS source_id, CASE WHEN lang = 'en' THEN lang ELSE 'Parent/' || lang END AS section, row_number() OVER (PARTITION BY coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END, 'legacy') ORDER BY doc_id) - 1 AS ord FROM documents")
def legacy_chunk_migrate(spark, sf):
    """Old chunks: a missing source id is filled in, equal section titles collapse, and each gets its place among all of its source.

    A source is numbered over ranges, so that one may hold any share of the chunks.
    """
    d = table(spark, sf, "documents")
    source = F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.lit("legacy"))
    parent = F.when(F.col("lang") == "en", F.col("lang")).otherwise("Parent")
    section = F.array_join(F.array_distinct(F.array(parent, "lang")), "/")
    rows = support.positions(d.select("doc_id", source.alias("source_id"), section.alias("section")), "source_id", ["doc_id"], scratch(spark, "legacy"))
    return rows.select("doc_id", "source_id", "section", (F.col("position") - 1).cast("long").alias("ord"))


#: Regions of each page, as a layout model replies: a title, tables, figures, code, text, empty ones, and as many of them as the page's number tells.
_REGION_TYPES = ["title", "table", "figure", "code", "text", "Figure", "table", None]


@register(rf"""WITH r AS (SELECT page_id, url, unnest(range(3 + page_id % 9)) AS i FROM pages), t AS (SELECT *, coalesce(lower({_REGION_TYPES}[((page_id + i) % 8)::INT + 1]), 'text') AS kind, CASE WHEN (page_id + i) % 5 <> 4 THEN url || ' #' || i END AS x FROM r),
b AS (SELECT page_id, i, kind, trim(CASE kind WHEN 'table' THEN CASE WHEN (page_id + i) % 16 < 8 THEN '| a | ' || page_id || ' |' ELSE coalesce(x, '') END WHEN 'figure' THEN '[Figure] ' || coalesce(x, '') WHEN 'code' THEN '[Code:' || CASE WHEN i % 2 = 0 THEN 'py' ELSE '' END || ']' || chr(10) || coalesce(x, '') WHEN 'title' THEN '# ' || coalesce(x, '') ELSE coalesce(x, '') END, ' ' || chr(10)) AS body FROM t),
k AS (SELECT * FROM b WHERE body <> '') SELECT page_id, kind AS region_type, body, i AS ord FROM k UNION ALL SELECT page_id, 'image_page', string_agg(body, chr(10) || chr(10) ORDER BY i), -1 FROM k GROUP BY 1""".replace("None", "NULL"))
def region_chunks(spark, sf):
    """Layout regions as JSON to typed chunks, each by the rule of its type, those without a body left out, and one parent of them all."""
    k = F.col("page_id") + F.col("i")
    some = table(spark, sf, "pages").select("page_id", "url", F.explode(F.sequence(F.lit(0), (2 + F.col("page_id") % 9).cast("int"))).alias("i"))
    region = F.struct(F.element_at(F.array(*map(F.lit, _REGION_TYPES)), (k % 8 + 1).cast("int")).alias("type"), F.when(k % 5 != 4, F.concat("url", F.lit(" #"), F.col("i").cast("string"))).alias("text"), F.when(k % 16 < 8, F.concat(F.lit("| a | "), F.col("page_id").cast("string"), F.lit(" |"))).alias("markdown"), F.when(F.col("i") % 2 == 0, "py").alias("language"))
    replies = some.groupBy("page_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("i", region.alias("r")))), lambda x: x["r"]).alias("regions"))).alias("reply"))
    return sync.region_chunks(replies, "page_id", "reply")


#: Listed documents as they arrive, those that are gone too; every 37th is no UTF-8. What has the old cheap hash is never looked at.
_ARRIVED = f"(SELECT l.*, CASE WHEN action IN ('add', 'update') AND doc_id % 37 = 5 THEN 'error' ELSE action END AS did FROM (SELECT d.*, substr(source_id, 2)::BIGINT AS doc_id FROM {DIFF} d) l)"


@register(f"""WITH a AS {_ARRIVED}, p AS (SELECT 'd' || doc_id AS source_id, list_filter(list_transform(regexp_split_to_array(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END, '\\n\\s*\\n'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS xs FROM documents)
SELECT a.source_id, coalesce(did, 'skip') AS action, CASE WHEN did IN ('add', 'update') THEN len(xs) WHEN did = 'error' AND a.action = 'add' THEN NULL ELSE 2 END AS chunk_count, CASE WHEN did IN ('add', 'update') THEN md5(array_to_string(xs, chr(10))) WHEN did = 'error' AND a.action = 'add' THEN NULL ELSE md5('0' || chr(10) || '1') END AS chunks_md5
FROM a JOIN p USING (source_id) WHERE did <> 'delete' UNION ALL SELECT source_id, 'delete', NULL, NULL FROM a WHERE did = 'delete'""")
def sync_stream(spark, sf):
    """Documents arriving as a stream, compared with the registry batch by batch: what became of each, and the chunks it has then."""
    store = kb.Store(spark, scratch(spark, "kb")).create()
    none = F.create_map().cast("map<string,string>")
    old = registry_(spark, sf)
    store.write("registry", old.select("source_id", "cheap_hash", "content_hash", "title", "chunk_count", none.alias("extra"), F.lit(-1).cast("long").alias("chunk_batch"), F.lit("add").alias("action"), F.lit(False).alias("gone")), -1)
    store.write("chunks", old.select("source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).withColumn("text", F.col("part").cast("string")), -1)
    docs = streams.stream_of(spark, f"{sf}/documents.parquet")
    cheap = F.when(F.col("doc_id") % 4 == 0, _id("old")).when(F.col("doc_id") % 11 == 0, None).otherwise(_id("new"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    same = (F.col("doc_id") % 10 != 8) & (F.col("doc_id") % 3 != 0)  # those keep their bytes, or they would be updates
    content = F.when((F.col("doc_id") % 37 == 5) & ~same, F.concat(F.unhex(F.lit("FF")), text.cast("binary"))).otherwise(text.cast("binary"))
    streams.sync_stream(store, docs.select(_id("d").alias("source_id"), cheap.alias("cheap_hash"), title.alias("title"), none.alias("extra"), (F.col("doc_id") % 10 == 9).alias("gone"), content.alias("content")))
    did = store.rows("registry").where("batch >= 0").select("source_id", "action").unionByName(store.rows("errors").select("source_id", F.lit("error").alias("action")))
    now = store.registry().select("source_id", "chunk_count")
    texts = store.chunks().groupBy("source_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n")).alias("chunks_md5"))
    rows = now.join(did, "source_id", "full").join(texts, "source_id", "left")
    return rows.select("source_id", F.coalesce("action", F.lit("skip")).alias("action"), "chunk_count", F.coalesce("chunks_md5", F.when(F.col("chunk_count") == 0, F.md5(F.lit("")))).alias("chunks_md5"))
