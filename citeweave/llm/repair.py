"""Conversation structure repair by layers of cost.

A repaired conversation's roles start with the initials ``(s?(ua)+)?``. Keep, Rerole, Delete and Insert turn a conversation into such a one at a cost. From the last turn back to the first, a word holds a bitset of grammar states for each
cost: those from which the rest can be repaired at that cost. A turn's word follows from the next one's by shifts, masks and ors, all costs at once; costs count from the lowest that any state needs there, as no state ever needs more than
WIDTH - 1 more than another (two inserts, or deletes of what it can't keep, lead from any state to any other that still matters). The first layer that holds the start state gives the cost; the trace then runs forward over the bits
and takes, at each step, the smallest letter that stays on a cheapest way: each letter leads to one state, so the trace is the least audit of all cheapest ones.

Facts of turns (role, fault, a digest of the text) and texts travel apart: one pass over sorted facts finds audits and holds a byte and a short word a turn; texts are read in order beside the audit and never held. Order within a conversation is
its turn (null first), then role, then SHA-256 of the text. A conversation is one task's, as its audit is one string.

A row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation, by 128 bits of the text's SHA-256), truncated (the last visible character is none of ``.!?``).

Defined results: null conv_id, role and text stand for one space in keys, roles and texts; a null conv_id is a conversation; repeated rows are turns (and duplicates); a conversation whose rows all go has zeros and an empty audit; an empty
table gives an empty table; extra columns are ignored; gaps beyond 64 bits are held at 2^63 - 1; very long texts are scanned by Spark, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, staged

#: Costs of edits; what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: nothing yet, after a system turn, after a user's, after an assistant's. The first and last may end.
_STATES, _START, _ENDS = 4, 0, 0b1001
_ALL = 0b1111
#: The state that a user or assistant turn leads to, and what initials lead where.
_ONWARD = (2, 2, 3, 2)
_BY_INITIAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLE = {2: "user", 3: "assistant"}
#: Layers of cost in a word.
WIDTH = 16
_WORD = (1 << (_STATES * WIDTH)) - 1
_GRAMMAR = {"su", "ua", "au"}

BLANK_MARK, DUPLICATE, TRUNCATION = "blank", "duplicate", "truncated"
_FAULTS = ("", BLANK_MARK, DUPLICATE, TRUNCATION)
_INITIALS = ("s", "u", "a", "")


def _layers(states: int) -> int:
    """states (a bitset) in every layer."""
    return sum(states << (_STATES * d) for d in range(WIDTH))


def _back(word: int, arcs: tuple[tuple[int, int], ...]) -> int:
    """In every layer, the states from which an arc leads to a state of the word."""
    out = 0
    for state, after in arcs:
        hit = word & _layers(1 << after)
        out |= hit >> (after - state) if after >= state else hit << (state - after)
    return out


_FORWARD = tuple(enumerate(_ONWARD))


def _inserted(word: int) -> int:
    """The word with what inserts add; more than two in a row lead to no new state."""
    for _ in range(2):
        word |= (_back(word, _FORWARD) << (_STATES * INSERT)) & _WORD
    return word


def _rebased(word: int) -> tuple[int, int]:
    """The word counted from its lowest layer that has a state, and that layer."""
    low = ((word & -word).bit_length() - 1) // _STATES
    return word >> (_STATES * low), low


@cache
def _before(word: int, kind: int) -> tuple[int, int]:
    """The word before a turn of a kind (see turn_kind()), and by how much its lowest cost is higher."""
    initial, fault = _INITIALS[kind >> 2], _FAULTS[kind & 3]
    out = word << (_STATES * DELETE)
    if fault not in (BLANK_MARK, DUPLICATE):
        more = TRUNCATED if fault == TRUNCATION else 0
        keeps = tuple((s, after) for (s, i), after in _BY_INITIAL.items() if i == initial)
        out |= _back(word, keeps) << (_STATES * (KEEP + more)) | _back(word, _FORWARD) << (_STATES * (REROLE + more))
    return _rebased(_inserted(out & _WORD))


def turn_kind(initial: str, fault: str) -> int:
    """A turn as a number below 16: initial of its role (s, u, a or another) and its fault."""
    return (_INITIALS.index(initial) if initial in _INITIALS else 3) << 2 | _FAULTS.index(fault)


def _cost(word: int, state: int) -> int | None:
    """The lowest layer of the word that has the state."""
    hit = word & _layers(1 << state)
    return ((hit & -hit).bit_length() - 1) // _STATES if hit else None


def least_edits(kinds: bytes) -> tuple[int, str]:
    """Cost and audit: the initials of the cheapest edits, least in ASCII among the cheapest. kinds: turn_kind() of each turn."""
    words, bases = [_inserted(_ENDS)], [0]
    for kind in reversed(kinds):
        word, more = _before(words[-1], kind)
        words.append(word)
        bases.append(bases[-1] + more)
    words.reverse()
    bases.reverse()
    total = left = bases[0] + _cost(words[0], _START)
    at, state, audit = 0, _START, []
    while at < len(kinds) or left or not _ENDS >> state & 1:
        for letter, cost, to, after in _edits(state, kinds[at] if at < len(kinds) else None):
            layer = left - cost - bases[at + to]
            if layer >= 0 and words[at + to] >> (_STATES * layer + after) & 1:
                audit.append(letter)
                at, state, left = at + to, after, left - cost
                break
        else:
            raise AssertionError("no edit keeps to the cost")
    return total, "".join(audit)


@cache
def _edits(state: int, kind: int | None) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, cost, turns taken, state after) of every edit, in ASCII order. kind: None behind the last turn."""
    out = [("I", INSERT, 0, _ONWARD[state])]
    if kind is not None:
        initial, fault = _INITIALS[kind >> 2], _FAULTS[kind & 3]
        out.append(("D", DELETE, 1, state))
        if fault not in (BLANK_MARK, DUPLICATE):
            more = TRUNCATED if fault == TRUNCATION else 0
            out.append(("R", REROLE + more, 1, _ONWARD[state]))
            if (state, initial) in _BY_INITIAL:
                out.append(("K", KEEP + more, 1, _BY_INITIAL[state, initial]))
    return tuple(sorted(out))


def filled(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (long), role, text, with a space for null roles and texts."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def _digest():
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest")


_ORDER = ("turn", "role", "digest")
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _facts(turns: DataFrame) -> DataFrame:
    """What audits need of each turn. Visible characters are all but the six of white space."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = F.when(last == "", F.lit(1)).when(last.isin(".", "!", "?"), F.lit(0)).otherwise(F.lit(3))
    return turns.select("conv_id", "turn", "role", _digest(), own.cast("int").alias("fault"))


class _Conversation:
    """Facts of one conversation's turns, as they come in order."""

    def __init__(self):
        self.kinds, self.seen, self.faults = bytearray(), set(), [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.first, self.last, self.distinct = None, None, 0

    def add(self, turn: int | None, role: str, digest: bytes, fault: int) -> None:
        if fault != 1:
            key = hashlib.blake2b(role.encode("utf-8", "surrogatepass") + digest, digest_size=16).digest()
            fault = 2 if key in self.seen else fault
            self.seen.add(key)
        initial = role[:1]
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in _GRAMMAR
        self.before = initial
        self.kinds.append(turn_kind(initial, _FAULTS[fault]))
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn

    def row(self, conv: int | None) -> tuple:
        cost, audit = least_edits(bytes(self.kinds))
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, 2**63 - 1)
        return conv, gaps, *self.faults[1:], self.illegal, cost, audit


def audits(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row a conversation, as AUDIT says: faults and gaps of its turns, and the cheapest repair. turns: as filled() makes them. convs: conv_id of conversations that are to have a row even without turns."""
    facts = _facts(turns).withColumn("turns", F.lit(True))
    if convs is not None:
        facts = facts.unionByName(convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("turns", F.lit(False)), allowMissingColumns=True)
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = [x.split()[0] for x in AUDIT.split(", ")]

    def run(batches):
        rows, conv, now = [], None, None
        for batch in batches:
            for c, turn, role, digest, fault, real in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != conv:
                    if now:
                        rows.append(now.row(conv))
                    conv, now = c, _Conversation()
                if real:
                    now.add(turn, role, digest, fault)
            if len(rows) >= 1000:
                yield _batch(rows, kinds, names)
                rows = []
        if now:
            rows.append(now.row(conv))
        if rows:
            yield _batch(rows, kinds, names)

    columns = ("conv_id", "turn", "role", "digest", "fault", "turns")
    return facts.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).mapInArrow(run, AUDIT)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


REPAIRED = "conv_id long, turn_no long, edit string, role string, text string"


def _edited(conv: int | None, audit: str, ready: list[tuple]) -> Iterator:
    """Is sent (role, text) of one turn after another, and puts rows of REPAIRED into ready. Roles follow from the audit: a system turn leads if the number of turns is odd."""
    size, n = len(audit) - audit.count("D"), 0
    for letter in audit:
        turn = (yield) if letter != "I" else ("", "")
        if letter == "D":
            continue
        role = turn[0] if letter == "K" else _ROLE[2 + (n - size % 2) % 2]
        ready.append((conv, n, letter, role, turn[1]))
        n += 1


def repaired(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The turns of the repaired conversations in order, a row each: its number from 0 on, its edit (K, R or I), role and text. A partition has whole conversations, one after another. audited: what audits() found for these turns."""
    texts = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(), "text")
    plans = audited.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    rows = plans.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in REPAIRED.split(", ")]

    def run(batches):
        feed, held, ready = None, 0, []
        for batch in batches:
            for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                try:
                    if kind == 0:
                        feed = _edited(conv, text, ready)
                        next(feed)
                    else:
                        feed.send((role, text))
                except StopIteration:
                    pass
                held += len(text)
                if len(ready) >= 1000 or held >= 1 << 22:
                    if ready:
                        yield _batch(ready, kinds, names)
                    ready.clear()
                    held = 0
        if ready:
            yield _batch(ready, kinds, names)

    return rows.select("conv_id", "kind", "turn", "role", "digest", "text").mapInArrow(run, REPAIRED)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` of the turns, joined by line breaks. turns: straight from repaired(), whose order it reads."""

    def run(batches):
        conv, now, out = None, None, []
        for batch in batches:
            for c, n, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn_no", "role", "text")), strict=True):
                if n == 0:
                    if now:
                        out.append((conv, now.hexdigest()))
                    conv, now = c, hashlib.sha256()
                now.update(f"{chr(10) if n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            if len(out) >= 1000:
                yield _batch(out, [pa.int64(), pa.string()], ["conv_id", "repaired_sha256"])
                out = []
        if now:
            out.append((conv, now.hexdigest()))
            yield _batch(out, [pa.int64(), pa.string()], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """filled() with some rows dropped, emptied, robbed of ``.!?``, repeated or given to the user, by a hash of conv_id and turn. The query's own test damage."""
    rows = filled(conversations)
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("harm", F.crc32(key) % 20).where("harm <> 0")
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = damaged(rows)
    found = staged(audits(turns, rows))
    hashes = digests(repaired(turns, found)).withColumnRenamed("conv_id", "h_conv")
    out = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("h_conv")), "left")
    return out.select(*found.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """Backward over turns; for each grammar state the least {cost, audit, lines} of the rest, so that ties fall to the least audit."""
    onward, names = _ONWARD, {2: "user", 3: "assistant"}
    none = "{'c': 1000000000::BIGINT, 'a': '', 'x': NULL::VARCHAR[]}"

    def step(cost: str, letter: str, rest: str, line: str | None) -> str:
        lines = f"{rest}.x" if line is None else f"list_prepend({line}, {rest}.x)"
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'x': {lines}}}"

    def inserts(name: str) -> str:
        one = ", ".join(f"list_min([{name}{s}, " + step("2", "I", f"{name}{onward[s]}", f"'{names[onward[s]]}:'") + f"]) AS {name}i{s}" for s in range(4))
        two = ", ".join(f"list_min([{name}i{s}, " + step("2", "I", f"{name}i{onward[s]}", f"'{names[onward[s]]}:'") + f"]) AS g{s}" for s in range(4))
        return one, two

    legal = {s: [(i, after) for (state, i), after in _BY_INITIAL.items() if state == s] for s in range(4)}
    turn = []
    for s in range(4):
        keep = " ".join(f"WHEN f NOT IN (1, 2) AND left(role, 1) = '{i}' THEN " + step("(f = 3)::INT", "K", f"g{after}", "role || ':' || text") for i, after in legal[s])
        rerole = f"CASE WHEN f NOT IN (1, 2) THEN " + step("2 + (f = 3)::INT", "R", f"g{onward[s]}", f"'{names[onward[s]]}:' || text") + f" ELSE {none} END"
        turn.append(f"list_min([{step('3', 'D', f'g{s}', None)}, {rerole}, CASE {keep} ELSE {none} END]) AS h{s}")
    ends = f"SELECT {{'c': 0::BIGINT, 'a': '', 'x': []::VARCHAR[]}} AS e0, {none} AS e1, {none} AS e2, {{'c': 0::BIGINT, 'a': '', 'x': []::VARCHAR[]}} AS e3"
    e1, e2 = inserts("e")
    h1, h2 = inserts("h")
    return rf"""
WITH RECURSIVE b AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS harm FROM k, b),
r AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE harm <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM r),
f AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN tail IN ('.', '!', '?') THEN 0 ELSE 3 END AS f,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM o),
a AS (SELECT conv_id, count(*) AS turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 1)::BIGINT AS blank, count(*) FILTER (f = 2)::BIGINT AS duplicate,
  count(*) FILTER (f = 3)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM f GROUP BY conv_id),
e AS ({ends}), ei AS (SELECT *, {e1} FROM e), eg AS (SELECT {e2} FROM ei),
w AS (SELECT conv_id, turns AS i, g0, g1, g2, g3 FROM a, eg
  UNION ALL SELECT conv_id, i - 1, {h2} FROM (SELECT *, {h1} FROM (SELECT w.conv_id, i, {", ".join(turn)} FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.i))),
z AS (SELECT conv_id, g0.c AS cost, g0.a AS audit, sha256(array_to_string(g0.x, chr(10))) AS repaired_sha256 FROM w WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""


SQL = _sql()
