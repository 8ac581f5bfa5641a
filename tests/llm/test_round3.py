"""SimHash classes, periodic runs and conversation repair against brute force over whole tables, with nulls, ties, repeats and clashing names."""

import hashlib
import random
import zlib

import compare
import numpy as np
import pytest
import xxhash

from sparkloom.llm import periods, queries, simhash, structure

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, fp long, key long, list_no long, n_words long, runs long, component_id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(rows):
    """(doc_id, fingerprint, smallest doc_id reachable) by comparing all pairs of fingerprints."""
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            if (a ^ distinct[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for (d, _), f in zip(rows, prints):
        r = root(distinct.index(f))
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(root(distinct.index(f)))) for (d, _), f in zip(rows, prints)), key=repr)


def test_simhash_query(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_simhash(spark, SF).collect()), key=repr)
    assert got == plain_classes(rows)
    assert len({r[2] for r in got}) < len(got)


def test_simhash_odd_rows(spark):
    rows = [(3, None), (1, ""), (9, " \x0b\n"), (4, "One"), (5, "oNE two"), (6, "one two three"), (2, "one two three"), (2, "one two three"), (None, "é É a"), (None, "É É a"), (7, "x y z w"), (8, "a b c " * 3000)]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], CLASH)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr) == plain_classes(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_by_both_kinds_of_lists(spark, monkeypatch):
    """Lists that are tallied and lists split by six positions give the links of all pairs, however crowded."""
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(150)}
    prints |= {(base[0] & ~0xFF0000FF) | rnd.getrandbits(8) | rnd.getrandbits(8) << 24 for _ in range(400)}
    signed = [(k, int(np.array([p], np.uint64).view(np.int64)[0])) for k, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    label = list(range(len(signed)))
    values = np.array([f for _, f in signed]).view(np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    label = np.arange(len(values))
    while (new := np.where(near, label[None, :], len(values)).min(1)).tolist() != label.tolist():
        label = new
    want = {f: int(label[k]) for k, f in signed}
    for long in (4, 256):
        monkeypatch.setattr(simhash, "LONG", long)
        assert {r["fp"]: r["component_id"] for r in simhash.classes(df).collect()} == want


def test_word_lists_cut_at_white_space():
    text = b"alpha beta\tgamma\n\ndelta " * 50
    assert [w for some in simhash.word_lists(text, 7) for w in some] == text.split()
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text.decode())


# Periodic runs


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    out = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, sha(" ".join(x for k, x in enumerate(w) if k not in out)))


def test_periods_query(spark, docs):
    short = docs.where("n_chars < 8000")
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in short.select("doc_id", "text").collect()), key=repr)
    ids = {r[0] for r in want}
    got = sorted((tuple(r) for r in queries.op12_periods(spark, SF).collect() if r["doc_id"] in ids), key=repr)
    assert got == want and sum(r[1] > 0 for r in got) > 5
    assert queries.op12_periods(spark, SF).count() == docs.count()


def test_periods_odd_rows(spark):
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x y z " * 9 + "x y", "é É " * 8, "tail\x0btail\x0ctail\rtail tail tail", "p q " * 7, ("a b " * 20 + "c ") * 6, "w " * 30000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, texts[4])] * 2 + [(None, "a b c " * 9)]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], CLASH)
    small = sorted((plain_row(d, t) for d, t in rows if not t or len(t) < 1000), key=repr)
    got = sorted((tuple(r) for r in periods.run_digests(df).collect() if r["doc_id"] != 13), key=repr)
    assert got == small
    assert periods.run_digests(df.limit(0)).count() == 0
    one = periods.periodic_runs(df.where("doc_id = 13")).first()
    assert [tuple(r) for r in one["runs"]] == [(0, 30000, 1)] and one["collapsed"] == "w"


def test_runs_of_random_words():
    """Several texts in one step, small alphabets, planted loops: every run with its smallest period, none across a border."""
    rnd = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(rnd.choice([1, 2, 5])):
            n, letters = rnd.choice([0, 1, 5, 6, 8, 20, 60]), rnd.choice([1, 2, 3, 10])
            w = [rnd.randrange(letters) for _ in range(n)]
            if n and rnd.random() < 0.6:
                s, p = rnd.randrange(n), rnd.randrange(1, max(2, n // 3))
                w = [x if i < s else w[s + (i - s) % p] for i, x in enumerate(w)]
            texts.append(w)
        want, start = [], 0
        for w in texts:
            want += [(s + start, n, q) for s, n, q in plain_runs(w)]
            start += len(w)
        symbols = np.array([k * 100 + x for k, w in enumerate(texts) for x in w], np.int64)
        assert periods.runs_of(symbols, max(map(len, texts))) == want


def test_wavelet_matrix():
    rnd = np.random.default_rng(2)
    values = rnd.permutation(100)
    tree = periods.WaveletMatrix(values, 100)
    lo = rnd.integers(0, 100, 300)
    hi, x = np.minimum(100, lo + rnd.integers(0, 40, 300)), rnd.integers(0, 101, 300)
    there, found = tree.successor(lo, hi, x)
    want = [min((v for v in values[a:b] if v >= c), default=None) for a, b, c in zip(lo, hi, x)]
    assert [w is not None for w in want] == there.tolist() and [w for w in want if w is not None] == found.tolist()


# Conversations


def plain_repair(letters, found):
    """(cost, audit): all edits tried, state by state of the grammar."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    to = step.get((state, role))
                    if to and (to not in best or (cost + 2, audit + "I") < best[to]):
                        best[to] = (cost + 2, audit + "I")
        return best

    best = inserted({"0": (0, "")})
    for letter, fault in zip(letters, found):
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                ways += [(step.get((state, letter)), cost + more, "K")] + [(step.get((state, r)), cost + 2 + more, "R") for r in "ua" if r != letter]
            for to, c, op in ways:
                if to and (to not in new or (c, audit + op) < new[to]):
                    new[to] = (c, audit + op)
        best = inserted(new)
    return min(best[s] for s in ("0", "a") if s in best)


def test_cheapest_edits_in_blocks_of_any_size():
    rnd = random.Random(3)
    for _ in range(1500):
        letters = [rnd.choice(rnd.choice(["sua", "ua", "suax", "s", "uuuua"])) for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 25]))]
        found = [rnd.choice(["", "", "", "", "blank", "duplicate", "truncated"]) for _ in letters]
        want = plain_repair(letters, found)
        assert all(structure.cheapest(letters, found, block) == want for block in (512, 1, 4))


def test_long_conversation_in_linear_work():
    rnd = random.Random(4)
    letters = ["ua"[(i % 2) ^ (rnd.random() < 0.1)] for i in range(6000)]
    found = [rnd.choice([""] * 8 + ["blank", "truncated"]) for _ in letters]
    assert structure.cheapest(letters, found) == plain_repair(letters, found)


def plain_conversation(rows):
    """The contract, row by row, for the (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found, seen = [], set()
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        found.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    letters = [r[1][:1] for r in rows]
    cost, audit = plain_repair(letters, found)
    out, at, expected = [], 0, "s" if sum(op != "D" for op in audit) % 2 else "u"
    for op in audit:
        if op != "D":
            out.append(f"{rows[at][1] if op == 'K' else {'u': 'user', 'a': 'assistant'}[expected]}:{'' if op == 'I' else rows[at][2]}")
            expected = "a" if expected == "u" else "u"
        at += op != "I"
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(out))


def plain_damage(rows):
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if h == 4 else " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def test_structure_query(spark):
    assert compare.compare(spark, SF, ["op13_structure"]) == []
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((conv, *plain_conversation(own)) for conv, own in plain_damage(rows).items())
    assert sorted(tuple(r) for r in queries.op13_structure(spark, SF).collect()) == want


def test_structure_odd_rows(spark):
    rnd = random.Random(8)
    rows = [(c, rnd.choice([None, *range(6)]), rnd.choice([None, "", "user", "user", "assistant", "assistant", "system", "tool"]), rnd.choice([None, "", " \x0b", "Yes.", "Yes.", "No", "Well! ", "so…"])) for c in [None, *range(60)] for _ in range(rnd.randrange(1, 9))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gaps long")
    want = sorted(((conv, *plain_conversation(own)) for conv, own in plain_damage(rows).items()), key=repr)
    assert sorted((tuple(r) for r in structure.repair_digests(df).collect()), key=repr) == want
    assert structure.repair_digests(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho")], "conv_id long, turn long, role string, text string")
    assert tuple(structure.repair(alone).first()) == (1, 0, 0, 0, 1, 0, 1, "KK", "user:Hi.\nassistant:Ho")
