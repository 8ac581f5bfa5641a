"""Lexical and vector search for whole tables of queries."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..sources.shared import stored

K1, B, BLOCK = 1.2, 0.75, 512


def top(rows: DataFrame, key: str | list[str], k: int | None, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in an order (None: all), numbered from 1; Spark drops what cannot be among them before the shuffle."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    rows = rows.withColumn(rank, F.row_number().over(w))
    return rows if k is None else rows.where(F.col(rank) <= k)


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk_id, term, tf); counts are combined before the shuffle."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(T.index_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    return words.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, kind): ASCII terms are prefixes, any of which may match; CJK characters are one group that must all be there."""
    rows = queries.select(F.col(id_col).alias("query_id"), T.query_tokens(F.col(text_col)).alias("prefix"), T.query_cjk(F.col(text_col)).alias("cjk"))
    parts = [rows.select("query_id", F.explode(kind).alias("term"), F.lit(kind).alias("kind")) for kind in ("prefix", "cjk")]
    return parts[0].unionByName(parts[1])


def prefix_matches(terms: DataFrame, post: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(query_id, term, chunk_id, tf): a query term stands for all index terms that begin with it.

    Index terms that begin with the first two letters of some query term are exploded to their prefixes and joined by equality.
    """
    wanted = terms.select("term").distinct()
    head = lambda c: F.substring(c, 1, 2)
    vocabulary = (post.select(F.col("term").alias("word")).distinct() if words is None else words).where(F.length("word") > 1)
    vocabulary = vocabulary.withColumn("head", head("word")).join(wanted.select(head("term").alias("head")).distinct(), "head", "left_semi")
    prefixes = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(2), F.length("word")), lambda n: F.col("word").substr(F.lit(1), n))).alias("term"))
    pairs = wanted.join(prefixes, "term")
    hits = pairs.join(post.withColumnRenamed("term", "word"), "word").groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))
    return terms.join(hits, "term").select("query_id", "term", "chunk_id", "tf")


class Index(NamedTuple):
    """A lexical index: ``blocks`` as ``blocks_of`` makes them, what they hold row by row as ``post`` (chunk_id, term, tf, len), ``lengths`` (chunk_id, len) and ``words`` (word), and the number of chunks."""

    blocks: DataFrame
    post: DataFrame
    lengths: DataFrame
    words: DataFrame
    corpus: DataFrame


CHUNKS = 512


def blocks_of(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ids, lens, words, at, who, tf): the postings of up to 512 chunks in a row, made where the chunks are, so nothing is shuffled.

    ``words`` are sorted, one a line; the postings of word k are the places at[k] to at[k + 1] of ``who``, a chunk's number in its block, and ``tf``, all
    three as bytes. A chunk's length is the number of its terms. Rows of one id are one chunk; null ids are left out.
    """
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("chunk_id IS NOT NULL")
    again = rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")
    if again.limit(1).count():
        joined = rows.join(again, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
        rows = rows.join(again, "chunk_id", "left_anti").unionByName(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, CHUNKS):
                part = rows.slice(start, CHUNKS)
                lists = pc.split_pattern(part.column(1), " ")
                coded = lists.flatten().dictionary_encode()
                if pc.any(pc.match_substring_regex(coded.dictionary, f"[{rules.CJK}]")).as_py():
                    lists = pc.split_pattern(pc.replace_substring_regex(part.column(1), f"([{rules.CJK}])", r" \1 "), " ")
                    coded = lists.flatten().dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()  # by bytes, which is by code points
                words = coded.dictionary.take(pa.array(order))
                empty = int(len(words) > 0 and words[0].as_py() == "")
                words = words.slice(empty)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - empty
                term = place[coded.indices.to_numpy(zero_copy_only=False)]
                who = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[term >= 0]
                lens = np.bincount(who, minlength=part.num_rows)
                keys, tf = np.unique(term[term >= 0] * CHUNKS + who, return_counts=True)
                at = np.searchsorted(keys, np.arange(len(words) + 1) * CHUNKS)
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), (keys % CHUNKS).astype(np.uint16), tf.astype(np.int32))]
                ids = pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), pa.concat_arrays([part.column(0)]))
                lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")
                yield pa.RecordBatch.from_arrays([ids, pa.array([lens.tolist()], pa.list_(pa.int64())), lines, *packed], names=["ids", "lens", "words", "at", "who", "tf"])

    kind = rows.schema["chunk_id"].dataType.simpleString()
    return rows.select("chunk_id", T.index_runs(F.col("text")).alias("text")).mapInArrow(run, f"ids array<{kind}>, lens array<long>, words string, at binary, who binary, tf binary")


def unpacked(blocks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, len) of all postings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, lens, words, at, who, tf in pdf.itertuples(index=False):
                who = np.frombuffer(who, np.uint16)
                yield pd.DataFrame({"chunk_id": np.asarray(ids)[who], "term": np.repeat(np.array(words.split("\n") if words else [], object), np.diff(np.frombuffer(at, np.int32))), "tf": np.frombuffer(tf, np.int32), "len": np.asarray(lens)[who]})

    return blocks.mapInPandas(run, f"chunk_id {blocks.schema['ids'].dataType.elementType.simpleString()}, term string, tf long, len long")


def build_index(chunks: DataFrame, id_col: str, text_col: str, keep: Callable[[DataFrame, str, Callable], DataFrame] | None = None) -> Index:
    """The index of ``chunks``; ``keep`` (``shared.kept``) lets later queries read what the first has written."""
    keep = keep or (lambda source, name, build: stored(build(source), name))
    source = chunks.select(id_col, text_col)
    blocks = keep(source, "blocks", lambda rows: blocks_of(rows, id_col, text_col))
    lengths = blocks.select(F.explode(F.arrays_zip("ids", "lens")).alias("x")).select(F.col("x.ids").alias("chunk_id"), F.col("x.lens").alias("len"))
    words = blocks.select(F.explode(F.split("words", "\n")).alias("word")).where("word <> ''").distinct()
    return Index(blocks, unpacked(blocks), lengths, words, keep(source, "corpus", lambda rows: rows.agg(F.count("*").alias("n"))))


def scored_terms(terms: DataFrame, index: Index) -> DataFrame:
    """(term, chunk_id, part): what each prefix term of the queries adds to the score of each chunk."""
    hits = prefix_matches(terms.select("term").distinct().withColumn("query_id", F.lit(0)), index.post, index.words).select("term", "chunk_id", "tf")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return parts_of(hits.join(df, "term"), index).select("term", "chunk_id", "part")


def parts_of(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (..., chunk_id, tf, df) with ``part``, the BM25 weight of a term in a chunk."""
    corpus = index.corpus.crossJoin(index.lengths.agg(F.sum("len").alias("total")))  # one row
    rows = rows.join(index.lengths, "chunk_id").crossJoin(F.broadcast(corpus))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return rows.withColumn("part", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("n")))))


#: Terms of a query that are scored first, to find a score that its last hit must reach; sums may differ by less than MARGIN.
SEEDS, MARGIN = 6, 1e-5


def bounded(terms: DataFrame, parts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(terms with ``essential`` and ``rest``, floors): upper bounds of terms against a lower bound of each query's k-th score.

    A term's bound is its largest part. The first terms by bound are scored, and the k-th best of these partial scores is the query's
    floor. Terms whose bounds, with all smaller ones, do not reach the floor are not essential: a chunk that holds no other
    cannot be among the first k. ``rest`` is the sum of the bounds of a query's terms that are not essential.
    """
    bounds = parts.groupBy("term").agg(F.max("part").alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    ranked = terms.join(bounds, "term").withColumn("nth", F.row_number().over(order)).withColumn("left", F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)))
    ranked = stored(ranked, "bounds")
    first = ranked.where(F.col("nth") <= SEEDS).join(parts, "term").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    floors = top(first, "query_id", k, F.desc("score"), F.col("chunk_id")).where(F.col("rank") == k).select("query_id", (F.col("score") - MARGIN).alias("floor"))
    ranked = ranked.join(floors, "query_id", "left").withColumn("essential", F.col("floor").isNull() | (F.col("left") >= F.col("floor")))
    rest = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).over(Window.partitionBy("query_id"))
    return stored(ranked.select("query_id", "term", "essential", "floor", rest.alias("rest")), "essential"), floors


#: Queries, or terms, whose work on a block of chunks is done together.
SHARE = 512


def shares(rows: DataFrame, key: str, *columns: str, size: int = SHARE) -> DataFrame:
    """(share, asked, n, total): ``rows`` as arrays of structs, up to about ``size`` keys together."""
    parts = rows.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct(key) / size)).cast("long").alias("parts"))
    return rows.crossJoin(F.broadcast(parts)).groupBy(F.pmod(F.xxhash64(key), "parts").alias("share")).agg(F.collect_list(F.struct(*columns)).alias("asked"))


def ranges(words: list[str], terms: list[str], exact: list[bool]) -> Iterator[tuple[int, int, int]]:
    """(number of the term, first, end) of the sorted words that each term stands for, of terms that any do: itself if ``exact``, else those it begins."""
    for k, (term, whole) in enumerate(zip(terms, exact)):
        lo = bisect.bisect_left(words, term)
        if lo < len(words) and (words[lo] == term if whole else words[lo].startswith(term)):
            yield k, lo, lo + 1 if whole else bisect.bisect_left(words, term + chr(0x10FFFF), lo)


def counted(words: str, at: bytes, who: bytes, tf: bytes, terms: list[str], exact: np.ndarray, chunks: int) -> np.ndarray:
    """How often each of a block's chunks holds each term, or words that begin with it where the term is not ``exact``."""
    at, who, tf = np.frombuffer(at, np.int32), np.frombuffer(who, np.uint16), np.frombuffer(tf, np.int32)
    out = np.zeros((len(terms), chunks))
    for k, lo, hi in ranges(words.split("\n") if words else [], terms, exact.tolist()):
        out[k] = np.bincount(who[at[lo] : at[hi]], tf[at[lo] : at[hi]], chunks)
    return out


#: Terms that are looked up in a block together; for a lookup nothing is held but a number for each.
LOOKUPS = 16_384


def over_blocks(terms: DataFrame, index: Index, schema: str, found: Callable, ended: Callable) -> DataFrame:
    """``terms`` (term, kind) looked up in every block; kind ``prefix`` stands for the words that begin with the term, another for the word.

    ``found`` (terms, kinds, state, ids, at, who, hits) is given the ``ranges`` of a share's terms in a block, ``ended`` (terms, kinds, state) what
    it has made of ``state``, a zero for each term, by the end of a task. Both yield batches of ``schema``.
    """
    asked = stored(shares(terms.select("term", "kind").distinct(), "term", "term", "kind", size=LOOKUPS), "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                share, rows, ids, words, at, who = (batch.column(k)[row] for k in range(6))
                if share.as_py() not in known:
                    told = rows.as_py()
                    known[share.as_py()] = [x["term"] for x in told], [x["kind"] for x in told], np.zeros(len(told), np.int64)
                own, words = known[share.as_py()], words.as_py()
                hits = ranges(words.split("\n") if words else [], own[0], [kind != "prefix" for kind in own[1]])
                yield from found(*own, ids, np.frombuffer(at.as_py(), np.int32), np.frombuffer(who.as_py(), np.uint16), hits)
        for own in known.values():
            yield from ended(*own)

    return asked.crossJoin(index.blocks).select("share", "asked", "ids", "words", "at", "who").mapInArrow(run, schema)


def document_counts(terms: DataFrame, index: Index) -> DataFrame:
    """(term, kind, df): in how many chunks each term (term, kind) is; kind ``prefix`` counts words that begin with it, another the word."""

    def found(terms, kinds, state, ids, at, who, hits) -> Iterator[pa.RecordBatch]:
        for k, lo, hi in hits:  # a word has one posting for each chunk that holds it
            state[k] += at[hi] - at[lo] if hi == lo + 1 else np.count_nonzero(np.bincount(who[at[lo] : at[hi]]))
        return iter(())

    def ended(terms, kinds, state) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(kinds, pa.string()), pa.array(state)], names=["term", "kind", "df"])

    return over_blocks(terms, index, "term string, kind string, df long", found, ended).groupBy("term", "kind").agg(F.sum("df").alias("df"))


def holders(terms: DataFrame, index: Index) -> DataFrame:
    """(term, chunk_id): the chunks that hold each term (term) as a word."""

    def found(terms, kinds, state, ids, at, who, hits) -> Iterator[pa.RecordBatch]:
        for k, lo, hi in hits:
            chunks = ids.values.take(pa.array(who[at[lo] : at[hi]]))
            yield pa.RecordBatch.from_arrays([pa.array([terms[k]] * len(chunks), pa.string()), chunks], names=["term", "chunk_id"])

    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    return over_blocks(terms.select("term", F.lit("word").alias("kind")), index, f"term string, chunk_id {kind}", found, lambda *_: iter(()))


def best_chunks(asked: DataFrame, index: Index, k: int, score: Callable[[np.ndarray, np.ndarray, pd.DataFrame, float, float], np.ndarray], exact: Callable[[pd.DataFrame], np.ndarray], held: int = 64) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best of all chunks for every query, a block of chunks and a share of queries at a time.

    ``asked`` is (query_id, term, kind, df). ``score`` turns the counts of a block's terms, its lengths, the share's rows (query and term as
    numbers, sorted by query), the number of chunks and their length in all into scores of queries by chunks, zero for none. A
    task keeps the best of each query over its blocks, so that only those leave it.
    """
    sizes = index.corpus.crossJoin(index.blocks.agg(F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("total")))  # one row
    asked = stored(shares(asked, "query_id", "query_id", "term", "kind", "df").crossJoin(F.broadcast(sizes)), "asked")
    kinds = asked.schema["asked"].dataType.elementType["query_id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()

    def told(rows: list[dict]) -> tuple:
        rows = pd.DataFrame(rows)
        rows["t"], terms = pd.factorize(rows["kind"] + " " + rows["term"])
        rows["q"], queries = pd.factorize(rows["query_id"], sort=True)
        one = rows.drop_duplicates("t").sort_values("t")
        return rows.sort_values("q", kind="stable"), one["term"].tolist(), exact(one), queries

    def out(best: dict) -> Iterator[pd.DataFrame]:
        for (_, _, _, queries), ids, scores in best.values():
            pdf = pd.DataFrame({"query_id": np.repeat(np.asarray(queries), scores.shape[1]), "chunk_id": ids.ravel(), "score": scores.ravel()})
            yield pdf[np.isfinite(pdf["score"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                share, rows, n, total, ids, lens, words, at, who, tf = (batch.column(c)[row] for c in range(10))
                if share.as_py() not in best:
                    if len(best) >= held:
                        yield from sent(out(best), batch.schema)
                        best = {}
                    best[share.as_py()] = [told(rows.as_py()), None, None]
                own = best[share.as_py()]
                (rows, terms, whole, queries), ids = own[0], np.asarray(ids.as_py())
                counts = counted(*(x.as_py() for x in (words, at, who, tf)), terms, whole, len(ids))
                s = score(counts, np.asarray(lens.as_py(), float), rows, n.as_py(), total.as_py())
                s = np.where(s > 0, np.round(s, 6), -np.inf)
                ids = np.broadcast_to(ids, s.shape)
                if own[1] is not None:
                    s, ids = np.concatenate([own[2], s], axis=1), np.concatenate([own[1], ids], axis=1)
                order = np.lexsort((ids, -s))[:, :k]
                own[1:] = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
        if best:
            yield from sent(out(best), batch.schema)

    def sent(parts: Iterator[pd.DataFrame], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        types = schema.field("asked").type.value_type.field("query_id").type, schema.field("ids").type.value_type, pa.float64()
        for pdf in parts:
            yield pa.RecordBatch.from_arrays([pa.array(pdf[c].tolist(), kind) for c, kind in zip(pdf, types)], names=list(pdf))

    pairs = asked.crossJoin(index.blocks).select("share", "asked", "n", "total", "ids", "lens", "words", "at", "who", "tf")
    found = pairs.mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return stored(top(found, "query_id", k, F.desc("score"), F.col("chunk_id")), "hits")  # stored, so that joins know how few they are


def bm25_scores(counts: np.ndarray, lens: np.ndarray, rows: pd.DataFrame, n: float, total: float) -> np.ndarray:
    """Sums of a query's parts; CJK characters count for the chunks that hold all of the query's."""
    one = rows.drop_duplicates("t").sort_values("t")
    df = one["df"].to_numpy(float)
    idf = np.maximum(1e-6, np.log((n - df + 0.5) / (df + 0.5)))
    parts = idf[:, None] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lens / max(total / n, 1e-9)))
    cjk = rows["kind"].to_numpy() == "cjk"
    out = np.zeros((int(rows["q"].max()) + 1, len(lens)))
    for own, group in ((rows[~cjk], False), (rows[cjk], True)):
        if len(own):
            q, t = own["q"].to_numpy(), own["t"].to_numpy()
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            sums = np.add.reduceat(parts[t], starts, axis=0)
            out[q[starts]] += sums * np.logical_and.reduceat(counts[t] > 0, starts, axis=0) if group else sums
    return out


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 40, query_id: str = "item_id", chunk_id: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25 with prefix terms and CJK groups; scores to six digits, ties by id.

    Without ``index`` one of ``chunks`` is built here. Two passes over its blocks: in how many chunks each term is, then the scores.
    """
    index = index or build_index(chunks, chunk_id, text_col)
    terms = stored(query_terms(queries, query_id, text_col).distinct(), "queries")
    asked = terms.join(document_counts(terms, index), ["term", "kind"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return best_chunks(asked, index, k, bm25_scores, lambda terms: (terms["kind"] == "cjk").to_numpy())


def overlap_scores(counts: np.ndarray, lens: np.ndarray, rows: pd.DataFrame, n: float, total: float) -> np.ndarray:
    q = rows["q"].to_numpy()
    return np.add.reduceat((counts > 0).astype(float)[rows["t"].to_numpy()], np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), axis=0)


def overlap_topk(queries: DataFrame, chunks: DataFrame, k: int = 40, query_id: str = "item_id", chunk_id: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """A second ranking: how many distinct terms of the query the chunk holds."""
    asked = query_terms(queries, query_id, text_col).where("kind = 'prefix'").distinct().withColumn("df", F.lit(0).cast("long"))
    return best_chunks(asked, index or build_index(chunks, chunk_id, text_col), k, overlap_scores, lambda terms: np.ones(len(terms), bool))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, kb: str = "kb", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the largest inner products within a knowledge base, exactly.

    ``queries`` is (query_id, kb, vector), ``vectors`` (id, kb, vector). Both are cut into blocks of at most a
    few hundred rows by hash; a pair of blocks is one matrix product, which keeps the best of each query. Null is a base too.
    """

    def blocks(df: DataFrame, ident: str, name: str) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy(F.col(kb).alias("of")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
        rows = df.join(n, F.col(kb).eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64(ident), "parts"))
        return rows.groupBy(kb, "block").agg(F.collect_list(ident).alias(f"{name}_ids"), F.collect_list("vector").alias(f"{name}_vecs")), n

    # a query block goes to each vector block of its base, so that the pairs of one base are many keys
    (q, _), (v, parts) = blocks(queries, "query_id", "q"), blocks(vectors, "id", "v")
    q = q.drop("block").join(parts, F.col(kb).eqNullSafe(F.col("of"))).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop(kb)
    pairs = q.join(v, F.col("of").eqNullSafe(F.col(kb)) & (F.col("at") == F.col("block"))).select("q_ids", "q_vecs", "v_ids", "v_vecs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qi, qv, vi, vv in zip(pdf["q_ids"], pdf["q_vecs"], pdf["v_ids"], pdf["v_vecs"]):
                qi, vi = np.asarray(qi), np.asarray(vi)
                s = np.round(np.stack([np.asarray(v, float) for v in qv]) @ np.stack([np.asarray(v, float) for v in vv]).T, 6)
                if exclude_self:
                    s[qi[:, None] == vi[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(vi, s.shape), -s))[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(qi, order.shape[1]), "id": vi[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                yield out[np.isfinite(out["score"])]

    types = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    best = pairs.mapInPandas(run, f"query_id {types[0]}, id {types[1]}, score double")
    return top(best, "query_id", k, F.desc("score"), F.col("id"))


def codebooks(vectors: DataFrame, parts: int = 16, words: int = 256, sample: int = 16_384, rounds: int = 8, seed: int = 5) -> list[np.ndarray]:
    """For each of ``parts`` slices of the dimensions the code words that k-means finds on at most ``sample`` vectors, picked by hash."""
    some = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    data = np.array([r["vector"] for r in some], float)
    if not len(data):
        return []
    rng, books = np.random.default_rng(seed), []
    for own in np.array_split(data, min(parts, data.shape[1]), axis=1):
        centres = own[rng.permutation(len(own))[: min(words, len(own))]]
        for _ in range(rounds):
            near = (own @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
            np.add.at(sums, near, own)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books.append(centres)
    return books


def vector_topk_ann(queries: DataFrame, vectors: DataFrame, k: int = 10, kb: str = "kb", parts: int = 16, candidates: int = 100, sample: int = 16_384, block: int = 8192) -> DataFrame:
    """(query_id, id, score, rank) by product quantisation within a knowledge base: inner products to six digits, ties by id.

    Each vector is ``parts`` bytes, the numbers of the nearest code words of its slices. A query makes a table of its inner products with
    all code words and adds up the entries that a vector's bytes name; the best ``candidates`` by these sums are scored again from
    the vectors themselves. So the scan reads compressed codes, in blocks whose pairs are keys of their own, and full
    vectors are read for the candidates only. A base of no more vectors than candidates is searched exactly.
    """
    books = codebooks(vectors, parts, sample=sample)
    splits = np.cumsum([b.shape[1] for b in books])[:-1]
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", kb)} | {"query_id": queries.schema["query_id"].dataType.simpleString()}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack([np.asarray(v, float) for v in pdf["vector"]])
                code = np.stack([(own @ b.T - (b**2).sum(axis=1) / 2).argmax(axis=1) for own, b in zip(np.split(m, splits, axis=1), books)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"id": pdf["id"], kb: pdf[kb], "code": [c.tobytes() for c in code]})

    codes = stored(vectors.where("vector IS NOT NULL").select("id", kb, "vector").mapInPandas(encode, f"id {kinds['id']}, {kb} {kinds[kb]}, code binary"), "codes")
    sizes = codes.groupBy(F.col(kb).alias("of")).agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    blocks = codes.join(sizes, F.col(kb).eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("id"), "parts")).groupBy(kb, "block").agg(F.collect_list("id").alias("ids"), F.collect_list("code").alias("codes"))
    asked = queries.where("vector IS NOT NULL").join(sizes, F.col(kb).eqNullSafe(F.col("of")))
    asked = asked.groupBy("of", "parts", F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("share")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    asked = asked.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = asked.join(blocks, F.col("of").eqNullSafe(F.col(kb)) & (F.col("at") == F.col("block"))).select("asked", "ids", "codes")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asked, ids, codes in zip(pdf["asked"], pdf["ids"], pdf["codes"]):
                ids, code = np.asarray(ids), np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1)
                found = []
                for row in asked:
                    own = np.split(np.asarray(row["vector"], float), splits)
                    sums = sum((b @ q)[code[:, j]] for j, (b, q) in enumerate(zip(books, own)))
                    best = np.lexsort((ids, -np.round(sums, 6)))[:candidates]
                    found.append(pd.DataFrame({"query_id": row["query_id"], "id": ids[best], "score": sums[best]}))
                yield pd.concat(found)

    near = pairs.mapInPandas(scan, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    near = top(near, "query_id", candidates, F.desc("score"), F.col("id")).select("query_id", "id")
    full = near.join(vectors.select("id", F.col("vector").alias("b")), "id").join(queries.select("query_id", F.col("vector").alias("a")), "query_id")
    return top(full.select("query_id", "id", F.round(T.cosine(F.col("a"), F.col("b")), 6).alias("score")), "query_id", k, F.desc("score"), F.col("id"))


def rrf_fuse(rankings: list[tuple[str, DataFrame]], k: int = 60, depth: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, sources, rank): sums of 1 / (k + rank) over ranked lists; ties by list, rank and id.

    Ranks beyond ``depth`` add nothing to a score; what has no other follows all that have one, and none is dropped.
    """
    rows = None
    for no, (name, df) in enumerate(rankings):
        part = df.select("query_id", "chunk_id", F.col("rank").alias("r"), F.lit(no).alias("list"), F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("r")) if depth is None else F.when(F.col("r") <= depth, 1.0 / (k + F.col("r"))).otherwise(0.0)), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.min(F.struct("list", "r")).alias("first")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.r", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).drop("first")


def mmr_select(candidates: DataFrame, k: int = 5, weight: float = 0.7, rest: bool = False) -> DataFrame:
    """(query_id, chunk_id, position) chosen greedily for relevance against likeness to what is chosen.

    ``candidates`` has query_id, chunk_id, score, text, rank, and at most a few hundred rows per query. No
    more candidates than ``k`` stay in their order. With ``rest`` what is not chosen follows in its order.
    """
    kinds = [candidates.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        chosen = list(range(len(pdf)))
        if len(pdf) > k:
            grams = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} if (t := (x or "").strip()) else set() for x in pdf["text"]]
            number: dict[str, int] = {}
            own = [np.fromiter((number.setdefault(g, len(number)) for g in x), np.int64, len(x)) for x in grams]
            sizes = np.array([len(x) for x in own])
            flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
            s = pdf["score"].to_numpy(float)
            rel = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
            near, chosen, left, held = np.zeros(len(s)), [], np.ones(len(s), bool), np.zeros(len(number), bool)
            while left.any() and len(chosen) < k:
                best = int(np.argmax(np.where(left, weight * rel - (1 - weight) * near, -np.inf)))
                chosen.append(best)
                left[best] = False
                held[own[best]] = True
                shared = np.bincount(of[held[flat]], minlength=len(s))
                held[own[best]] = False
                near = np.maximum(near, shared / np.maximum(sizes + sizes[best] - shared, 1))
            if rest:
                chosen += np.flatnonzero(left).tolist()
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[chosen], "chunk_id": pdf["chunk_id"].iloc[chosen], "position": range(1, len(chosen) + 1)})

    return candidates.select("query_id", "chunk_id", "score", "text", "rank").groupBy("query_id").applyInPandas(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, position long")


def parent_expand(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Leaves become their parents, the best leaf of each; leaves without a parent stay. (query_id, chunk_id, best_leaf, score, expanded, rank)."""
    rows = hits.join(parents.select(F.col("chunk_id").alias("leaf"), "parent_id"), hits["chunk_id"] == F.col("leaf"), "left").drop("leaf")
    target = F.coalesce("parent_id", "chunk_id")
    best = rows.groupBy("query_id", target.alias("target")).agg(F.max_by(F.struct(F.col("chunk_id"), F.col("parent_id").isNotNull().alias("expanded")), F.struct("score", -F.col("rank"))).alias("b"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "target")
    return best.select("query_id", F.col("target").alias("chunk_id"), F.col("b.chunk_id").alias("best_leaf"), "score", F.col("b.expanded").alias("expanded"), F.row_number().over(w).alias("rank"))


def word_overlap(queries: list[str], passages: list[str]) -> np.ndarray:
    """The default scorer of pairs: the share of a query's different words that the passage holds, from -4 to 4."""
    words = lambda t: set(re.findall(r"[^\W_]+", re.sub(f"([{rules.CJK}])", r" \1 ", t.lower())))
    return np.array([8 * (len(q & words(p)) / len(q) if (q := words(query)) else 0.0) - 4 for query, p in zip(queries, passages)], float)


def score_pairs(pairs: DataFrame, model: Callable[[list[str], list[str]], np.ndarray] = word_overlap, batch: int = 256) -> DataFrame:
    """``pairs`` (query_id, chunk_id, query, passage, ...) without its texts and with ``raw``, what a model of pairs says of each, batch by batch."""
    rest = [c for c in pairs.columns if c not in ("query", "passage")]
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield part[rest].assign(raw=np.asarray(model(part["query"].fillna("").tolist(), part["passage"].fillna("").tolist()), float))

    return pairs.mapInPandas(run, f"{kinds}, raw double")


def rerank(queries: DataFrame, hits: DataFrame, chunks: DataFrame, priors: DataFrame, k: int | None = 8, model: Callable[[list[str], list[str]], np.ndarray] = word_overlap) -> DataFrame:
    """(query_id, chunk_id, score, prior, raw, sigmoid, rank): hits scored anew by a model of query and passage, with the prior of intent and source.

    ``queries`` is (query_id, text), ``hits`` (query_id, chunk_id), ``chunks`` (chunk_id, title, text, source_path). A passage is title and text.
    """
    passage = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    hits = stored(hits.select("query_id", "chunk_id"), "pairs")  # so that the join knows how few they are, and moves no texts
    rows = hits.join(chunks.select("chunk_id", passage.alias("passage"), T.source_type(F.coalesce("source_path", F.lit(""))).alias("source_type")), "chunk_id")
    rows = rows.join(queries.select("query_id", F.col("text").alias("query"), T.query_intent(F.col("text")).alias("intent")), "query_id")
    return rerank_adjust(score_pairs(rows, model), priors, k)


def rerank_adjust(hits: DataFrame, priors: DataFrame, k: int | None = 8) -> DataFrame:
    """sigmoid(raw) plus the prior of (intent, source type), within 0 and 1; the first ``k`` (None: all). Keeps raw, sigmoid and prior."""
    rows = hits.join(F.broadcast(priors), ["intent", "source_type"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0))).withColumn("sigmoid", 1 / (1 + F.exp(-F.col("raw"))))
    rows = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sigmoid") + F.col("prior"))), 6))
    return top(rows, "query_id", k, F.desc("score"), F.col("chunk_id"))


def semantic_cache(requests: DataFrame, threshold: float = 0.95, entries: int = 500) -> DataFrame:
    """(kb, seq, hit_seq, similarity): each request, in order, finds the most similar of the last entries of its base, or becomes one.

    What is stored depends on what was found before, so a base is one sequence; rows stream through, and only
    the last ``entries`` vectors are held.
    """
    rows = requests.select("kb", "seq", "vector").repartition("kb").sortWithinPartitions("kb", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, ids, ring, held = object(), np.zeros(entries, np.int64), None, 0
        for pdf in batches:
            found = []
            for kb, seq, v in zip(pdf["kb"], pdf["seq"], pdf["vector"]):
                v = np.asarray(v, float)
                if kb != base:
                    base, ring, held = kb, np.zeros((entries, len(v))), 0
                n = min(held, entries)
                sims = ring[:n] @ v
                best = int(np.argmax(sims)) if n else -1
                if best >= 0 and sims[best] >= threshold:
                    found.append((kb, seq, ids[best], float(sims[best])))
                else:
                    found.append((kb, seq, None, None))
                    ring[held % entries], ids[held % entries] = v, seq  # the oldest goes
                    held += 1
            yield pd.DataFrame(found, columns=["kb", "seq", "hit_seq", "similarity"]).astype({"hit_seq": "Int64"})

    return rows.mapInPandas(run, f"kb {rows.schema['kb'].dataType.simpleString()}, seq long, hit_seq long, similarity double")


def unit(vector: Column) -> Column:
    """The vector at length one; null for the zero vector, which finds nothing."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def or_zero(rows: DataFrame) -> DataFrame:
    """``rows`` without those that have no direction: a zero vector is like nothing."""
    return rows.where(F.col("vector").isNotNull())


def leading_sentences(text: Column, chars: int = 240) -> Column:
    """Whole sentences from the start while they stay within so many characters, the first in any case; else so many characters."""
    start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(0).alias("n"), F.lit(True).alias("go"))

    def add(acc: Column, x: Column) -> Column:
        go = acc["go"] & ((acc["n"] + F.length(x) <= chars) | (F.size(acc["s"]) == 0))
        return F.struct(F.when(go, F.concat(acc["s"], F.array(x))).otherwise(acc["s"]).alias("s"), F.when(go, acc["n"] + F.length(x)).otherwise(acc["n"]).alias("n"), go.alias("go"))

    lead = F.aggregate(T.sentences(text), start, add, lambda acc: F.trim(F.array_join(acc["s"], " ")))
    return F.when(lead == "", F.substring(T.trimmed(text), 1, chars)).otherwise(lead)


def extractive_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer) of every query (query_id, query): numbered titles and leading sentences of its hits (query_id, rank, title, text), three at most."""
    head, mid = rules.EXTRACT_QUERY.split("{}")
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\n"), leading_sentences(F.coalesce("text", F.lit(""))), F.lit("\n\n"))
    parts = hits.where("rank <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "").alias("parts"))
    asked = F.concat(F.lit(rules.EXTRACT_HEAD + "\n\n" + head), F.substring(T.trimmed(F.col("query")), 1, 80), F.lit(mid + "\n\n"), "parts", F.lit(rules.EXTRACT_TAIL))
    return queries.join(parts, "query_id", "left").select("query_id", F.when(F.col("parts").isNull(), F.lit(rules.EXTRACT_NONE)).otherwise(asked).alias("answer"))
