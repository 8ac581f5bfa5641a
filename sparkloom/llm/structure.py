"""Repair of conversations: turns are aligned with the strings of the grammar ``(s?(ua)+)?``, and the cheapest edits are told.

Wagner and Fischer's table of turns against a target. All targets end alike, as the last r letters of a longer one
are those of a shorter one; so one table, filled from the last turn on, holds the alignment with each feasible length as a column,
and a system turn in front is one row more that leads into it. Per turn: keep, rerole, delete, and insert before it.

Ukkonen's bands. From the end, a greedy alignment gives for each turn an incumbent cost of what follows, from
which any other end of the grammar is four at most away. A column whose difference in length alone costs more is in no
cheapest alignment, so each row holds a band of columns only.

Audits. Each column of the cheapest cost is traced back, at each cell by the first in ASCII order of the steps
that keep its cost; the audits of the columns are compared. Two different audits of one cost are never one the beginning of
the other, as the letters and the faults give the cost.

Long conversations are aligned in blocks of turns, from the last block on. What a block needs of those after it is the
cheapest cost and the least audit for each of four ends: nothing left, ``a`` next, ``u`` next, ``s`` next.
So work and memory grow with the turns, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable

WHITE, STOPS = " \t\n\v\f\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED, BLOCK = 2, 3, 2, 1, 512
FAR = np.int64(1) << 40
ROLES = {"u": "user", "a": "assistant"}
#: Pairs of initials that may stand together.
LEGAL = {"su", "ua", "au"}


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """For each (role, text) its first fault: blank, duplicate, truncated, or none."""
    seen, out = set(), []
    for row in rows:
        said = row[1].rstrip(WHITE)
        out.append("blank" if not said else "duplicate" if row in seen else "" if said[-1] in STOPS else "truncated")
        seen.add(row)
    return out


class Block:
    """The table of some turns, given how many letters, modulo two, are to be left of the target behind them."""

    def __init__(self, letters: list[str], found: list[str], odd: int):
        n = len(letters)
        self.letters, self.odd, self.n = letters, odd, n
        self.forced = [f in ("blank", "duplicate") for f in found]
        self.extra = [TRUNCATED if f == "truncated" else 0 for f in found]
        lows, highs = self.bands()
        self.low = lows
        self.rows = [np.empty(0, np.int64)] * n + [INSERT * np.arange(highs[n] + 1, dtype=np.int64)]
        for i in range(n - 1, -1, -1):
            columns = np.arange(lows[i], highs[i] + 1)
            best = self.at(i + 1, columns) + DELETE
            if not self.forced[i]:
                own = np.where((columns + odd) % 2 == 1, "a", "u") == letters[i]
                best = np.minimum(best, self.at(i + 1, columns - 1) + np.where(own, 0, REROLE) + self.extra[i])
            self.rows[i] = np.minimum.accumulate(best - INSERT * columns) + INSERT * columns  # letters inserted before this turn

    def bands(self) -> tuple[list[int], list[int]]:
        """First and last column of each row, from the greedy alignment of what follows."""
        cost, base, live, taken = 0, 0, 0, 0
        low, high = [0], [4]
        for i in range(self.n - 1, -1, -1):
            if self.forced[i]:
                cost, base = cost + DELETE, base + DELETE
            else:
                expected = "a" if (taken + self.odd) % 2 == 0 else "u"
                other = self.letters[i] in ROLES and self.letters[i] != expected
                cost += self.extra[i] + (0 if self.letters[i] == expected else INSERT if other else REROLE)
                taken += 2 if other else 1
                base, live = base + self.extra[i], live + 1
            slack = cost + 2 * INSERT - base  # of which each turn deleted takes two at least, and each letter inserted two
            low.append(max(0, live - slack // 2))
            high.append(live + slack // 2)
        return low[::-1], high[::-1]

    def at(self, i: int, columns: np.ndarray) -> np.ndarray:
        """Costs of some columns of a row; beyond the band, far."""
        row, place = self.rows[i], columns - self.low[i]
        inside = (place >= 0) & (place < len(row))
        return np.where(inside, row[np.clip(place, 0, len(row) - 1)], FAR)

    def cost(self, i: int, r: int) -> int:
        place = r - self.low[i]
        return int(self.rows[i][place]) if 0 <= place < len(self.rows[i]) else int(FAR)

    def audit(self, i: int, r: int) -> str:
        """The least audit of the cheapest alignment from turn ``i`` on with ``r`` letters."""
        out = []
        while i < self.n or r:
            now = self.cost(i, r)
            if i < self.n and self.cost(i + 1, r) + DELETE == now:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.letters[i] == ("a" if (r + self.odd) % 2 else "u") else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def columns(self, i: int) -> range:
        return range(self.low[i], self.low[i] + len(self.rows[i]))


def before(letters: list[str], found: list[str], after: dict[str, tuple[int, str]]) -> dict[str, tuple[int, str]]:
    """(cost, audit) of a block and all behind it, by what is left of the target in front of it: "", "a", "u" or "s"."""
    options: dict[str, list[tuple[int, callable]]] = {}
    for end, (cost, audit) in after.items():
        if end == "s":
            options.setdefault("s", []).append((cost + DELETE * len(letters), lambda audit=audit: "D" * len(letters) + audit))
            continue
        block = Block(letters, found, int(end == "a"))
        for r in block.columns(0):
            left = end if r == 0 else "a" if (r + block.odd) % 2 else "u"
            options.setdefault(left, []).append((cost + block.cost(0, r), lambda block=block, r=r, audit=audit: block.audit(0, r) + audit))
        for i, letter in enumerate(letters):  # the system turn that a target begins with
            if letter == "s" and not block.forced[i]:
                for r in block.columns(i + 1):
                    if (end == "u" if r == 0 else (r + block.odd) % 2 == 0):
                        options.setdefault("s", []).append((cost + DELETE * i + block.extra[i] + block.cost(i + 1, r), lambda block=block, i=i, r=r, audit=audit: "D" * i + "K" + block.audit(i + 1, r) + audit))
    out = {}
    for left, some in options.items():
        least = min(map(itemgetter(0), some))
        if least < FAR:
            out[left] = (least, min(trace() for cost, trace in some if cost == least))
    return out


def cheapest(letters: list[str], found: list[str], block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of those the least in ASCII order."""
    best = {"": (0, "")}
    for start in range((len(letters) - 1) // block * block, -1, -block) if letters else ():
        best = before(letters[start : start + block], found[start : start + block], best)
    return min(best[left] for left in ("", "u", "s") if left in best)


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) that an audit makes of the rows."""
    kept = [op for op in audit if op != "D"]
    place = -1 if len(kept) % 2 else 0  # an odd number of letters begins with a system turn
    at, out = 0, []
    for op in audit:
        role = ("user", "assistant")[place % 2]
        if op == "K":
            out.append(rows[at])
        elif op != "D":
            out.append((role, "" if op == "I" else rows[at][1]))
        place += op != "D"
        at += op != "I"
    return out


COLUMNS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string())]


def mended(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The values of ``COLUMNS`` for one conversation."""
    found, letters = faults(rows), [role[:1] for role, _ in rows]
    known = {t for t in turns if t is not None}
    cost, audit = cheapest(letters, found)
    illegal = sum(a + b not in LEGAL for a, b in zip(letters, letters[1:]))
    text = "\n".join(f"{role}:{said}" for role, said in repaired(rows, audit))
    return (max(known) - min(known) + 1 - len(known) if known else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, text)


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation of (conv_id, turn, role, text).

    Turns are taken by number, nulls first, then by role and text; null roles and texts count as one space, and a null conv_id
    is a conversation of its own. Each turn's first fault counts: blank, duplicate (role and text seen earlier) or truncated (the
    last character is no stop). Keep costs 0, Rerole 2, Delete 3, which blank and duplicate turns need, Insert 2, and a truncated
    turn that stays 1; what is left must be initials ``(s?(ua)+)?``. ``audit`` holds the edits' initials; ``repaired`` the
    turns ``role:text`` by lines. Roles with other initials are reroled or go. No rows, no conversation. Rows
    stream through tasks in order; one conversation, which is one value of the result, is held at a time.
    """
    importable(turns.sparkSession)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, numbers, said, kind = None, [], [], None

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), *(pa.array([d[k + 1] for d in done], t) for k, (_, t) in enumerate(COLUMNS))], names=["conv_id", *(c for c, _ in COLUMNS)])

        for batch in batches:
            kind, done = batch.column(0).type, []
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if said and conv != of:
                    done.append((of, *mended(numbers, said)))
                    numbers, said = [], []
                of = conv
                numbers.append(turn)
                said.append((role, text))
            yield out(done)
        if said:
            yield out([(of, *mended(numbers, said))])

    kinds = ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in COLUMNS)
    return rows.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {kinds}")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that the query plants, by a hash of conversation and turn; nulls are one space in it."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def repair_digests(turns: DataFrame) -> DataFrame:
    """The repair of damaged conversations, each one of ``turns`` named, with the repaired turns' hash in place of their text."""
    done = repair(damaged(turns))
    names = turns.select(F.col("conv_id").alias("of")).distinct()
    rows = names.join(done, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c, t in COLUMNS if t == pa.int64()]
    return rows.select(F.col("of").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


def oracle() -> str:
    """``repair_digests`` in DuckDB's SQL: a walk over the turns that keeps, for each state of the grammar, the cheapest edits so far."""
    null = "NULL::STRUCT(c BIGINT, w VARCHAR, t VARCHAR)"

    def add(x: str, cost: str, letter: str, piece: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN {null} ELSE {{'c': ({x}.c + {cost})::BIGINT, 'w': {x}.w || '{letter}', 't': {x}.t || {piece}}} END"

    def least(*xs: str) -> str:
        return f"list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))[1]"

    def put(state: str, letter: str, role: str) -> str:
        keep, change = add(state, "tr", "K", "role || ':' || text || chr(10)"), add(state, "2 + tr", "R", f"'{role}:' || text || chr(10)")
        return f"CASE WHEN NOT ok THEN {null} WHEN l = '{letter}' THEN {keep} ELSE {change} END"

    gone = lambda state: add(state, "3", "D", "''")
    new = lambda state, role: add(state, "2", "I", f"'{role}:' || chr(10)")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE poly AS (SELECT list(v ORDER BY i) AS p FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) AS x(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
hashed AS (SELECT named.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, p[(xor(c, b) & 255) + 1]))) % 20 AS k FROM named, poly),
made AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed),
placed AS (SELECT conv_id, turn, role, text, rtrim(text, {white}) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM made),
judged AS (SELECT *, left(role, 1) AS l, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM placed),
told AS (SELECT conv_id, n, role, text, l, fault NOT IN ('blank', 'duplicate') AS ok, (fault = 'truncated')::INT AS tr FROM judged),
walk AS (SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'w': '', 't': ''}} AS z, {null} AS s, {{'c': 2::BIGINT, 'w': 'I', 't': 'user:' || chr(10)}} AS u, {{'c': 4::BIGINT, 'w': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS a FROM (SELECT DISTINCT conv_id FROM told)
 UNION ALL SELECT conv_id, n, z, s, u, {least('a', new('u', 'assistant'))} AS a FROM (SELECT conv_id, n, z, s, a, {least('u', new('z', 'user'), new('s', 'user'), new('a', 'user'))} AS u FROM (
 SELECT w.conv_id, t.n, {gone('z')} AS z, {least(gone('s'), f"CASE WHEN ok AND l = 's' THEN {add('z', 'tr', 'K', "role || ':' || text || chr(10)")} END")} AS s, {least(gone('u'), put('z', 'u', 'user'), put('s', 'u', 'user'), put('a', 'u', 'user'))} AS u, {least(gone('a'), put('u', 'a', 'assistant'))} AS a
 FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1))),
ended AS (SELECT conv_id, {least('z', 'a')} AS e FROM walk WHERE (conv_id, n) IN (SELECT (conv_id, max(n)) FROM told GROUP BY conv_id) OR conv_id IS NULL AND n = (SELECT max(n) FROM told WHERE conv_id IS NULL)),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.w, '') AS audit, sha256(coalesce(CASE WHEN e.t = '' THEN '' ELSE left(e.t, len(e.t) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""
