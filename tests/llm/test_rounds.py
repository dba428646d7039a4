"""SimHash, conversation repair and centroid clustering, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from compare import same

from citeweave.llm import centroids, repair, simhash

# -- op11 ---------------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    lines = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """prints: (doc_id, fingerprint) rows."""
    place = list(range(len(prints)))

    def root(k):
        while place[k] != k:
            k = place[k]
        return k

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
            place[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(prints):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return [(d, p, least.get(root(k))) for k, (d, p) in enumerate(prints)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_fingerprints_agree_with_sparks_own_hash(spark, table):
    texts = ["one two three four", "ONE two  three\tfour", "a", "a b", "ünï cödé 😀 X"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    from pyspark.sql import functions as F

    assert spark.createDataFrame([("one two three",)], "x string").select(F.xxhash64("x")).first()[0] % 2**64 == simhash.fingerprint("one two three")


def test_fingerprints_of_odd_rows(table, odd_rows):
    got = [(r["doc_id"], r["print"] % 2**64) for r in simhash.fingerprints(table(odd_rows)).collect()]
    assert ordered(got) == ordered([(d, brute_print(t)) for d, t in odd_rows])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_close_pairs_are_those_of_counted_bits(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64, endpoint=False)
    prints = base[rng.integers(0, 6, 300)]
    for k in range(300):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            prints[k] ^= np.uint64(1) << np.uint64(b)
    first, stop = rng.integers(0, 300, 300), rng.integers(0, 301, 300)
    got = sorted(p for a, b in simhash.close_pairs(prints, first, stop, radius) for p in zip(a.tolist(), b.tolist(), strict=True))
    assert got == [(a, b) for a in range(300) for b in range(first[a], stop[a]) if int(prints[a] ^ prints[b]).bit_count() <= radius]
    assert any(a != b for a, b in got)


def near_prints(seed, n=700):
    """Clumps around a few fingerprints, and others."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(5)] + [0]
    out = []
    for d in range(n):
        p = rng.choice(bases) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            p ^= 1 << rng.randrange(64)
        out.append((d, p))
    return out


@pytest.mark.parametrize("sizes", [(4096, 3, 4096), (20, 3, 30), (10, 1, 7), (3, 2, 500)])
def test_components_however_buckets_are_dealt(spark, monkeypatch, sizes):
    prints = near_prints(sizes[0])
    prints += [(None, prints[3][1]), (None, 12345), (5, prints[9][1]), (5, prints[5][1])]
    rows = spark.createDataFrame([(d, p - (p >> 63 << 64)) for d, p in prints], "doc_id long, print long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text: docs)
    bucket, levels, tile = sizes
    got = [(r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in simhash.clustered(rows, bucket=bucket, levels=levels, tile=tile).collect()]
    assert ordered(got) == ordered(brute_components(prints))


def test_a_group_sends_a_forest_not_its_pairs(spark):
    nodes = [(k, k) for k in range(8)]  # all within three bits of each other
    rows = spark.createDataFrame([("0.", 0, 8, n, p) for n, p in nodes], "way string, own long, size long, node long, print long")
    assert simhash._linked(rows, 3, 4096).count() == 7
    assert simhash._linked(rows, 3, 3).count() < 28


def test_simhash_of_odd_and_empty_tables(table, odd_rows):
    got = [(r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in simhash.clustered(table(odd_rows)).collect()]
    assert ordered(got) == ordered(brute_components([(d, brute_print(t)) for d, t in odd_rows]))
    assert simhash.clustered(table([])).collect() == []


def test_op11_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(r["doc_id"], brute_print(r["text"])) for r in docs])
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.query(spark, sf_dir).collect()]
    assert ordered(got) == ordered(want)
    assert any(d != c for d, _, c in want)


# -- op12 ---------------------------------------------------------------------------------------------------------------


def brute_edits(kinds):
    """Least (cost, audit) by trying every script with at most two inserts in a row."""
    import functools

    kinds = [(repair._INITIALS[k >> 2], repair._FAULTS[k & 3]) for k in kinds]

    @functools.cache
    def rest(at, roles):
        """Least (cost, audit) from a turn on, with the last two roles' state as a string of what counts."""
        found = []
        if at == len(kinds) and roles in ("", "a"):
            found.append((0, ""))
        if at < len(kinds):
            initial, fault = kinds[at]
            c, s = rest(at + 1, roles)
            found.append((c + 3, "D" + s))
            if fault not in ("blank", "duplicate"):
                add = fault == "truncated"
                ways = {"": "su", "s": "u", "u": "a", "a": "u"}[roles]
                for i in ways:
                    if i == initial:
                        c, s = rest(at + 1, i)
                        found.append((c + add, "K" + s))
                    if i != "s":
                        c, s = rest(at + 1, i)
                        found.append((c + add + 2, "R" + s))
        return min(found + inserted(at, roles, 2))

    @functools.cache
    def inserted(at, roles, left):
        i = {"": "u", "s": "u", "u": "a", "a": "u"}[roles]
        out = []
        if left:
            below = plain(at, i) + inserted(at, i, left - 1)
            out = [(c + 2, "I" + s) for c, s in below]
        return out

    @functools.cache
    def plain(at, roles):
        found = []
        if at == len(kinds) and roles in ("", "a"):
            found.append((0, ""))
        if at < len(kinds):
            initial, fault = kinds[at]
            for c, s in [rest(at + 1, roles)]:
                found.append((c + 3, "D" + s))
            if fault not in ("blank", "duplicate"):
                add = fault == "truncated"
                for i in {"": "su", "s": "u", "u": "a", "a": "u"}[roles]:
                    c, s = rest(at + 1, i)
                    if i == initial:
                        found.append((c + add, "K" + s))
                    if i != "s":
                        found.append((c + add + 2, "R" + s))
        return found

    return rest(0, "")


def test_least_edits_of_all_short_conversations():
    assert repair.least_edits(b"") == (0, "")
    for n in (1, 2, 3):
        for kinds in itertools.product(range(16), repeat=n):
            assert repair.least_edits(bytes(kinds)) == brute_edits(kinds)


def test_least_edits_of_long_conversations():
    rng = random.Random(4)
    for n in (7, 40, 150):
        for _ in range(60):
            weights = rng.choice([[1] * 16, [3, 1, 1, 1, 9, 1, 1, 1, 9, 1, 1, 1, 0, 0, 0, 0], [9, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0]])
            kinds = bytes(rng.choices(range(16), weights, k=n))
            assert repair.least_edits(kinds) == brute_edits(kinds)
    deep = bytes(rng.choices(range(16), k=200_000))
    cost, audit = repair.least_edits(deep)
    assert len(audit) - audit.count("I") == len(deep) and cost < 3 * len(deep)


SCHEMA = "conv_id long, turn long, role string, text string, digest string, kind int"

TALK = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello there"), (1, 2, "assistant", "Hi!"), (1, 2, "assistant", "Hi!"), (1, 9, "user", " \n"),
    (2, None, "user", "No turn."), (2, 3, "tool", "Sum."), (2, 3, "user", "Again?"), (2, 4, None, None),
    (None, 1, "user", "No conversation."), (None, 2, "assistant", "None at all."),
    (3, 1, "", ""), (4, -(2**63), "user", "First."), (4, 2**63 - 1, "assistant", "Last 　"),
    (5, 1, "user", "w " * 200_000 + "."), (5, 2, "assistant", "𝒜."),
]


def brute_audit(rows):
    """AUDIT and the repaired turns of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, kinds, faults = set(), [], []
    for _, _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        kinds.append(repair.turn_kind(role[:1], fault))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = brute_edits(kinds)
    size, out, feed = len(audit) - audit.count("D"), [], iter(rows)
    roles = (["system"] if size % 2 else []) + ["user", "assistant"] * (size // 2)
    for letter in audit:
        row = next(feed) if letter != "I" else None
        if letter != "D":
            out.append(((row[2] if letter == "K" else roles[len(out)]), row[3] if row else ""))
    assert "".join(r[:1] for r, _ in out) == "".join(r[0] for r in roles)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), "\n".join(f"{r}:{t}" for r, t in out)


def test_repair_of_odd_rows(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in TALK], SCHEMA)
    gone = spark.createDataFrame([(77,), (1,), (None,)], "conv_id long")
    turns = repair.filled(rows)
    found = repair.audits(turns, gone)
    by_conv: dict = {}
    for c, t, role, text in TALK:
        by_conv.setdefault(c, []).append((c, t, " " if role is None else role, " " if text is None else text))
    want = {c: brute_audit(v) for c, v in by_conv.items()} | {77: ((0, 0, 0, 0, 0, 0, ""), "")}
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {c: v[0] for c, v in want.items()}
    lines: dict = {}
    for r in sorted(repair.repaired(turns, found).collect(), key=lambda r: r["turn_no"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: "\n".join(v) for c, v in lines.items()} == {c: v[1] for c, v in want.items() if v[1]}
    hashes = {r[0]: r[1] for r in repair.digests(repair.repaired(turns, found)).collect()}
    assert hashes == {c: hashlib.sha256(v[1].encode()).hexdigest() for c, v in want.items() if v[1]}
    assert repair.audits(turns.limit(0)).collect() == []


def test_op12_query_with_nulls_and_repeats(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(12)]), rng.choice([None, "user", "assistant", "system", "tool", ""]), rng.choice([None, "", " ", "One.", "Two", "Three?", "a b. "])) for _ in range(600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    file = next((tmp_path / "c").glob("part-*"))
    file.rename(tmp_path / "conversations.parquet")
    same(repair.query(spark, str(tmp_path)), repair.SQL, str(tmp_path))


# -- op13 ---------------------------------------------------------------------------------------------------------------


def brute_lloyd(rows, k, rounds, dims, scale=64):
    import math

    kept = [(d, [math.floor(scale * x) for x in v]) for d, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    place = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(place))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == n] for n in range(len(place))]
        place = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else place[n] for n, g in enumerate(groups)]
    return place, [(d, near(v)[1], min(near(v)[0], 2**63 - 1)) for d, v in kept]


@pytest.mark.parametrize("width", [1.0, 1e7, 1e30, 1e300])
def test_lloyd(spark, width):
    rng = random.Random(8)
    rows = [(d, [round(rng.gauss(0, 1), 1) * (width if rng.random() < 0.1 else 1) for _ in range(5)]) for d in range(200)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (201, None), (202, [1.0] * 4), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5), (205, [float("inf")] * 5), (206, [1e308] * 5), (207, [])]
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    whole = centroids.whole_vectors(df, dims=5)
    place = centroids.fitted(whole, k=9, rounds=3)
    want, near = brute_lloyd(rows, 9, 3, 5)
    assert place == want
    assert ordered(map(tuple, centroids.assigned(whole, place).collect())) == ordered(near)


def test_lloyd_with_ties_few_and_no_vectors(spark):
    rows = [(d, [0.5, float(d % 2)]) for d in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = centroids.whole_vectors(df, dims=2)
    want, near = brute_lloyd(rows, 16, 2, 2)
    assert centroids.fitted(whole, k=16, rounds=2) == want and len(want) == 6
    assert ordered(map(tuple, centroids.assigned(whole, want).collect())) == ordered(near)
    assert centroids.fitted(whole.limit(0)) == []


def test_parts_of_wide_sums():
    for value in (0, -1, 2**61, -(2**62), 2**62, 3**200, -(3**200)):
        parts = centroids._in_parts(value)
        assert sum(p << (centroids._PART * k) for k, p in enumerate(parts)) == value
        assert all(-(2**62) <= p < 2**62 for p in parts)
