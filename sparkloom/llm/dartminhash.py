"""Near-duplicates by DartMinHash: darts thrown into weighted shingle regions, banded joins, verified links.

Signatures. A document is a set of five-word shingles, each of weight one however often it occurs, as in the
similarity that links need; so bands miss no more pairs where passages are repeated. Darts are a hashed Poisson process: each
shingle has, per unit of weight, a fixed sequence of darts with growing rank, each dart in one of
``coordinates`` coordinates; those within the shingle's weight hit it. Only darts up to a rank that fills
all coordinates are thrown, so a signature costs a fixed number of darts, whatever the length. The earliest dart per
coordinate is kept; two documents share it with the probability of their weighted Jaccard similarity.

Classes. Texts of equal words are one class member each (its smallest id). Members that share a band of
coordinates meet in a bucket. In each round a bucket has a few leaders, which are compared with the
members of other classes; a link needs the exact Jaccard similarity of the shingle sets. The classes that
links join are merged at once, so a bucket whose members all belong together is done after one round, however
many they are. Where classes remain, a member can only be linked with others through shingles that another
has too, so a member with too many of its own is ruled out, and pairs are only made within the sizes that the
shared ones allow. A pair is also left out where its bitmaps tell that it cannot be similar: every shingle flips one of 512
bits, so two sets differ in at least as many shingles as their bitmaps in bits. Rounds take ever more leaders per bucket until every member that is not ruled out and
outside its bucket's largest class has been a leader: then every pair in a bucket is linked, in one class
already, or known to differ, and no pair was left out.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored, text_or_empty, unused

WORD = re.compile(r"[^\W_]+")


@dataclasses.dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    leaders: int = 64  # of a bucket in the second round; sixteen times as many in each round after

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def ratio(self) -> tuple[int, int]:
        """The similarity as a fraction of integers, so that pairs that just reach it are not lost by rounding."""
        return Fraction(str(self.similarity)).as_integer_ratio()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words; fewer words are one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = mix(h * GOLDEN + words[k : len(words) - width + 1 + k] + np.uint64(k + 1))
    return np.unique(h)


def darts(hashes: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature: per coordinate a hash of its earliest dart.

    Weight is laid out in cells of one unit; a dart of a cell has a place in it and hits if the weight reaches
    that place. Ranks within a cell are sums of exponential steps, each from the hash of shingle, cell and step.
    """
    cells = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(hashes)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mix(hashes[at] + GOLDEN * (cell + 1).astype(np.uint64))
    share = np.minimum(1.0, weights[at] - cell)
    limit = (np.log(coordinates) + 4) / weights.sum()
    while True:
        best, sign = np.full(coordinates, np.inf), np.zeros(coordinates, np.uint64)
        key, part, rank, step = seed, share, np.zeros(len(seed)), 0
        width = int(limit * coordinates) + 1  # about so many darts per cell: throw that many at a time
        while len(key):
            steps = np.arange(step + 1, step + width + 1, dtype=np.uint64)
            h = mix(key[:, None] + steps[None, :] * GOLDEN)
            rise = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / coordinates
            ranks = rank[:, None] + np.cumsum(rise, axis=1)
            second = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
            hit = (ranks <= limit) & ((second >> np.uint64(40)).astype(np.float64) * 2.0**-24 < part[:, None])
            r, s, j = ranks[hit], second[hit], (second[hit] % np.uint64(coordinates)).astype(np.int64)
            order = np.argsort(-r, kind="stable")  # the earliest comes last and stays
            r, s, j = r[order], s[order], j[order]
            new, sig = np.full(coordinates, np.inf), np.zeros(coordinates, np.uint64)
            new[j], sig[j] = r, s
            sign, best = np.where(new < best, sig, sign), np.minimum(best, new)
            going = ranks[:, -1] <= limit
            key, part, rank, step = key[going], part[going], ranks[going, -1], step + width
        if np.isfinite(best).all():
            return sign
        limit *= 2


@functools.lru_cache(maxsize=1)
def word_hashes() -> dict[str, int]:
    return {}


def hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    known = word_hashes()
    if len(known) > 200_000:
        known.clear()
    out = list(map(known.get, words))
    if None in out:
        for k, h in enumerate(out):
            if h is None:
                out[k] = h = xxhash.xxh3_64_intdigest(words[k])
                known[words[k]] = h
    return np.array(out, np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """512 bits as eight integers; each hash flips one of them, so equal hashes of two sets cancel out in an exclusive or."""
    flips = np.bincount((hashes % np.uint32(512)).astype(np.int64), minlength=512) % 2
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_hash, words_hash, n_words, bands array<long>, shingles array<int>, bits array<long>) of every whole text.

    ``words_hash`` is equal for texts of equal words, case, punctuation and white space aside; ``text_hash`` is that of the
    text itself. Shingles are kept as 32-bit hashes. A text without words has no bands.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        with np.errstate(over="ignore"):
            for batch in parts(batches, 2):
                hashes, counts, bands, sets, bits = [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    words = WORD.findall(text.lower())
                    hashes.append(xxhash.xxh3_128_hexdigest(" ".join(words)))
                    counts.append(len(words))
                    distinct = shingles(hash_words(words), settings.words)
                    if len(distinct):
                        sign = darts(distinct, np.ones(len(distinct)), settings.coordinates).reshape(settings.bands, settings.rows)
                        key = np.arange(settings.bands, dtype=np.uint64)
                        for k in range(settings.rows):
                            key = mix(key * GOLDEN + sign[:, k])
                        bands.append(key.view(np.int64))
                    else:
                        bands.append(np.empty(0, np.int64))
                    short = np.unique((distinct >> np.uint64(32)).astype(np.uint32))
                    sets.append(short.view(np.int32))
                    bits.append(bitmap(short))
                made = [pa.array(hashes, pa.string()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_hash", "words_hash", "n_words", "bands", "shingles", "bits"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, words_hash string, n_words long, bands array<long>, shingles array<int>, bits array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of ``links`` (a, b) is connected with.

    In each round every id goes to its smallest neighbour, and to that one's, three times over; links between ids that went to the
    same one are gone, and the others lead on between those. So the links left are fewer each time, whatever the
    chains. Every round is written to the shared folder; the steps are put together at the end.
    """
    left = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    steps = []
    while not steps or left.limit(1).count():
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("to")))
        step = stored(ends.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("to")), "step")
        for _ in range(2):
            step = stored(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "step")
        steps.append(step)
        at = step.withColumnRenamed("to", "near")
        left = left.join(at.withColumnRenamed("id", "a"), "a").select(F.col("near").alias("a"), "b").join(at.withColumnRenamed("id", "b"), "b").select(F.least("a", "near").alias("a"), F.greatest("a", "near").alias("b"))
        left = stored(left.where("a <> b").distinct(), "links")
    labels = steps.pop().withColumnRenamed("to", "label")
    while steps:
        later = labels.select(F.col("id").alias("to"), "label")
        labels = steps.pop().join(later, "to", "left").select("id", F.coalesce("label", "to").alias("label"))
    return stored(labels, "labels")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) with the classes merged that further ``links`` (a, b) connect; ids that are new come in."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    known = stored(labels.join(ends, "id", "full").select("id", F.coalesce("label", "id").alias("label")), "known")
    at = known.withColumnRenamed("label", "own")
    between = links.join(at.withColumnRenamed("id", "a"), "a").select(F.col("own").alias("a"), "b").join(at.withColumnRenamed("id", "b"), "b").select("a", F.col("own").alias("b"))
    merged = components(between).withColumnRenamed("id", "own")
    return stored(at.join(merged, "own", "left").select("id", F.coalesce("label", "own").alias("label")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, class_size, kept, n_links, words_hash, class_hash, text_hash): one row for each of ``docs``.

    Texts of equal words, and texts whose sets of five-word shingles have a Jaccard similarity of
    ``similarity`` or more, are in one class, and so is who is linked through others; its id is its
    smallest doc_id, whose rows stay. Texts without words are one class. A text of fewer than five words is one shingle.
    ``n_links`` counts the verified links of the row's word sequence to others that the rounds needed.
    Null texts are empty; a null id is never the smallest, texts that only null ids have keep all their rows.
    Repeated rows share a class and are kept alike. One id may bear different texts: each is a member of its own class.
    ``class_hash`` is the words_hash of the row that stays and tells classes of one smallest id apart; of an id's
    different texts in one class, the one of the smallest words_hash stays.
    Candidates come from bands, which miss a pair of similarity 0.8 with probability (1 - 0.8^5)^24, 7 in
    100,000, and nearer pairs less, however often their shingles are repeated. Shingles are compared as 32-bit hashes.
    """
    part, whole = settings.ratio
    base = stored(sketch(docs, id_col, text_col, settings), "sketch")
    members = base.groupBy("words_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max_by("bands", "n_words").alias("bands"))
    # a member's key is a number of its own, fixed when it is written; ids may bear several texts
    members = stored(members.where(F.col("rep").isNotNull()).withColumn("key", F.monotonically_increasing_id()), "members")
    # buckets with two members or more; the bucket of a hot band is grouped by counts and minima only
    entries = members.where("size(bands) > 0").select("key", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    entries = stored(entries.join(shared, "bucket"), "entries")
    wanted = members.select("key", "rep", "words_hash").join(entries.select("key").distinct(), "key", "left_semi")
    sets = base.select(F.col("doc_id").alias("rep"), "words_hash", "shingles", "bits").join(wanted, ["rep", "words_hash"]).select("key", "shingles", "bits").dropDuplicates(["key"])
    sets = stored(sets, "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of the distinct pairs that are similar."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        with_b = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
        both = with_b.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
        low, high = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
        both = both.where(whole * low >= part * high)
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where((part + whole) * common >= part * (low + high)).select("a", "b")

    first = entries.groupBy("bucket").agg(F.min("key").alias("a"))
    pairs = entries.join(first, "bucket").where("key <> a").select("a", F.col("key").alias("b"))
    links = stored(verified(pairs), "star")
    labels = components(links)
    done = first.withColumnRenamed("a", "key")  # (bucket, key) that were leaders

    def open_buckets() -> DataFrame:
        """(bucket, key, label, largest) of the buckets whose members are in several classes."""
        at = entries.join(labels.withColumnRenamed("id", "key"), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
        groups = at.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        spread = groups.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", F.col("label"))).alias("most")).where("classes > 1").select("bucket", F.col("most.label").alias("largest"))
        return at.join(spread, "bucket")

    # What a member could share with others at most: its shingles that another member of an open bucket has too.
    # A link needs (|a| + |b|) t / (1 + t) common ones, which bounds the partner's size, or rules out any partner.
    own = sets.join(open_buckets().select("key").distinct(), "key", "left_semi")
    once = own.select("key", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count("*").alias("alone"))
    reach = own.select("key", "bits", F.size("shingles").alias("size")).join(once, "key", "left").select("key", "bits", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))
    reach = stored(reach.where(whole * F.col("common") >= part * F.col("size")), "reach")
    leaders = settings.leaders
    while True:
        able = open_buckets().join(reach, "key")
        waiting = able.where("label <> largest").join(done, ["bucket", "key"], "left_anti")
        turn = Window.partitionBy("bucket").orderBy("key")
        now = stored(waiting.withColumn("nth", F.row_number().over(turn)).where(F.col("nth") <= leaders).select("bucket", F.col("key").alias("a"), F.col("label").alias("la"), F.col("size").alias("size_a"), F.col("common").alias("common_a"), F.col("bits").alias("bits_a")), "leaders")
        if not now.limit(1).count():
            break
        fits = (F.col("label") != F.col("la")) & ((part + whole) * F.least("common", "common_a") >= part * (F.col("size") + F.col("size_a")))
        # of all shingles of both, at most (1 - t) / (1 + t) are not common
        unlike = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_a")[k])) for k in range(8)), F.lit(0))
        fits &= (part + whole) * unlike <= (whole - part) * (F.col("size") + F.col("size_a"))
        pairs = able.alias("m").join(now.alias("l"), (F.col("m.bucket") == F.col("l.bucket")) & fits).select("a", F.col("key").alias("b"))
        new = stored(verified(pairs), "new")
        labels = joined(labels, new)
        links = links.unionByName(new)
        done = stored(done.unionByName(now.select("bucket", F.col("a").alias("key"))), "done")
        leaders *= 16

    links = links.distinct()
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "key")
    by_words = members.select("key", "rep", "words_hash", "copies").join(labels.withColumnRenamed("id", "key"), "key", "left").join(ends, "key", "left").select("rep", "words_hash", "copies", F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classes = by_words.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min(F.struct("rep", "words_hash")).alias("stays"))
    known = by_words.select("words_hash", "copies", "n_links", "label").join(classes, "label").where("class_size > 1").select("words_hash", "copies", "n_links", "class_size", F.col("stays.rep").alias("class_id"), F.col("stays.words_hash").alias("class_hash"))
    total = max(1, base.count())
    heavy, light = known.where(F.col("copies") >= max(2.0, total / 500)), known.where(F.col("copies") < max(2.0, total / 500))
    rows = base.select("doc_id", "words_hash", "text_hash")
    cols = ["doc_id", "words_hash", "text_hash", "class_id", "class_hash", "class_size", "n_links"]
    hot = rows.join(F.broadcast(heavy), "words_hash").select(cols)
    rest = rows.join(F.broadcast(heavy.select("words_hash")), "words_hash", "left_anti").join(light, "words_hash", "left")
    single = F.col("class_size").isNull()
    rest = rest.select("doc_id", "words_hash", "text_hash", F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(single, F.col("words_hash")).otherwise(F.col("class_hash")).alias("class_hash"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("words_hash") == F.col("class_hash"))
    return hot.unionByName(rest).select("doc_id", "class_id", "class_size", kept.alias("kept"), "n_links", "words_hash", "class_hash", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their own columns; joined by id and text, as dropped rows may be many."""
    names = [unused(docs, n) for n in ("dropped_id", "dropped_hash")]
    dropped = near_duplicates(docs, id_col, text_col, settings).where("NOT kept").select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    return docs.join(dropped, docs[id_col].eqNullSafe(F.col(names[0])) & (F.xxhash64(text_or_empty(docs[text_col])) == F.col(names[1])), "left_anti")
