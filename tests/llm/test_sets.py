"""Near duplicates, repeated strings, top-k, packing, token files and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import pathlib
import random
import re
import zlib

import numpy as np
import pytest

from citeweave.llm import neardup, packing, substrings, tokenfile, tokens, topk


def brute_classes(rows, percent=85):
    sets = [(d, neardup.shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def near_rows(seed, groups=6, copies=12, length=120):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(length * (1 if g % 2 else 4))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 9 if g % 2 else 30)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(table, seed):
    rows = near_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.clustered(table(rows)).collect()}
    assert got == brute_classes(rows)


def test_deduplicated_takes_links_from_80_percent_on(table):
    words = [f"w{i}" for i in range(404)]
    rows = []
    for k, changed in enumerate([9, 9, 8, 10]):  # each change breaks five shingles of 400: 355 of 445, 360 of 440, 350 of 450
        base = [f"{k}{w}" for w in words]
        own = list(base)
        for j in range(changed):
            own[20 + 30 * j] = f"{k}n{j}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    shared = [len(neardup.shingles(rows[2 * k][1]) & neardup.shingles(rows[2 * k + 1][1])) / len(neardup.shingles(rows[2 * k][1]) | neardup.shingles(rows[2 * k + 1][1])) for k in range(4)]
    assert shared == [355 / 445, 355 / 445, 360 / 440, 350 / 450]
    assert 0.80 <= 360 / 440 < 0.85
    kept = sorted(r["doc_id"] for r in neardup.deduplicated(table(rows)).collect())
    assert kept == [0, 1, 2, 3, 4, 6, 7]
    rows = near_rows(3)
    assert sorted(r["doc_id"] for r in neardup.deduplicated(table(rows)).collect()) == sorted({c for _, c in brute_classes(rows, 80).values()})


def test_deduplicated_keeps_the_same_row_in_any_order(spark):
    rows = [(1, "b text of six words here", "en"), (1, "a text of six words here", "fr"), (1, "a text of six words here", "de"), (2, "other words stand in this row", None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, {"k": 1}) for r in order], "doc_id long, text string, lang string, m map<string,int>")
        assert sorted((r["doc_id"], r["text"], r["lang"]) for r in neardup.deduplicated(df).collect()) == [(1, "a text of six words here", "de"), (2, "other words stand in this row", None)]


def test_fragments_of_one_hash_are_compared_by_their_bytes():
    rng = np.random.default_rng(3)
    data = np.tile(rng.integers(97, 123, 400, dtype=np.uint8), 3)
    data[450] ^= 1  # the second of three equal stretches differs in one byte
    start = np.array([0, 400, 800, 10, 410, 810, 20, 20])
    end = start + np.array([60, 60, 60, 55, 55, 55, 77, 78])
    place = start + np.array([5, 5, 5, 5, 5, 6, 5, 5])
    other = np.array([0, 0, 0, 3, 3, 3, 6, 6])
    got = substrings.unlike(data, place, start, end, other)
    want = [data[a:b].tobytes() != data[start[o] : end[o]].tobytes() or p - a != place[o] - start[o] for a, b, p, o in zip(start, end, place, other, strict=True)]
    assert got.tolist() == want == [False, True, False, False, True, True, False, True]


def test_words_that_collide_in_polynomial_hashes_stay_apart(table):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word), (4, f"{word} x y z w v"), (5, f"{word.translate(str.maketrans('ab', 'ba'))} x y z w v")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.clustered(table(rows)).collect()}
    assert got == brute_classes(rows) == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (2, 4), 5: (2, 5)}


def test_equal_sets_in_another_order_are_linked(table):
    part = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{part} {part} {part}"), (2, f"{part} {part}"), (3, f"{part}  {part} {part.upper()} {part}")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.clustered(table(rows)).collect()}
    assert got == brute_classes(rows)
    assert {c for _, c in got.values()} == {1}


def test_recall_of_links_at_the_threshold(table):
    rng = random.Random(11)
    rows = []
    for g in range(600):
        n = rng.choice([110, 150, 400, 900])
        base = [f"g{g}w{i}" for i in range(n)]
        own = list(base)
        changed = next(c for c in range(n, 0, -1) if (n - 4 - 5 * c) >= 0.85 * (n - 4 + 5 * c))
        for k in range(changed):
            own[5 + k * ((n - 10) // changed)] = f"g{g}n{k}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
    want = brute_classes_of_pairs(rows)
    assert sum(want.values()) > 500
    got = {r["doc_id"]: r["component_id"] for r in neardup.clustered(table(rows)).collect()}
    assert sum(got[d] == d - 1 for d, linked in want.items() if linked) == sum(want.values())
    assert all(got[d] == d for d, linked in want.items() if not linked)


def brute_classes_of_pairs(rows, percent=85):
    """Whether each row with an odd id is linked with the one before it."""
    sets = [neardup.shingles(t) for _, t in rows]
    return {rows[k + 1][0]: 100 * len(sets[k] & sets[k + 1]) >= percent * len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 2)}


def test_near_duplicates_leave_one_table_behind(spark, table):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: {p.name for p in shared.iterdir() if any(p.rglob("*.parquet"))}
    before = held()
    neardup.clustered(table(near_rows(4)))
    assert len(held() - before) == 1


def test_near_duplicates_of_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    got = {(r["doc_id"], r["component_id"]) for r in neardup.clustered(docs).collect()}
    assert {(1, 1), (2, 2), (6, 6), (7, 6), (None, None), (9, 9)} <= got
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert neardup.clustered(table([])).count() == 0


def test_estimates_are_near_the_index():
    rng = np.random.default_rng(0)
    for n in (200, 3000):
        for share in (0.5, 0.85):
            common = round(2 * n * share / (1 + share))
            h = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(h[:n]), np.sort(h[n - common :])
            got = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([n]))[0]
            assert abs(got - share) < 0.12
            assert neardup.finely_alike(0, np.array([1]), np.array([n, n]), [neardup.fine_sketch(a), neardup.fine_sketch(b)], share - 0.01)[0]
            assert not neardup.finely_alike(0, np.array([1]), np.array([n, n]), [neardup.fine_sketch(a), neardup.fine_sketch(b)], min(share + 0.13, 0.99))[0]


def brute_removed(rows, length=substrings.LENGTH):
    first = {}
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - length + 1):
            k = t[i : i + length]
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[False], gone, [False]]).astype(int))
        kept = bytes(b for b, g in zip(t, gone.tolist(), strict=True) if not g)
        out[d] = (len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk_bytes", [2_000, 1 << 20])
def test_repeated_strings(spark, table, monkeypatch, chunk_bytes):
    monkeypatch.setattr(substrings, "chunks", lambda docs, text="text", own=substrings.chunks: own(docs, chunk_bytes, text))
    rng = random.Random(7)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randrange(45, 140))) for _ in range(12)]
    rows = [(d, "".join(rng.choice([*passages, *("".join(rng.choice("xyz ü") for _ in range(rng.randrange(1, 60))) for _ in range(6))]) for _ in range(rng.randrange(0, 9)))) for d in range(150)]
    rows += [(1000 + k, passages[0] * 3) for k in range(40)] + [(2000, None), (2001, ""), (2002, "a" * 500), (2003, "a" * 49), (2004, "a" * 50)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.cleaned(table(rows)).collect()}
    assert got == brute_removed(rows)


def test_repeated_strings_of_the_sample(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.query(spark, sf_dir).collect()}
    assert got == brute_removed(rows)


def test_repeated_strings_of_odd_rows(table, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (None, 4)] + [(10, "x" * 60), (3, "again " * 30), (3, "again " * 30)]
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.cleaned(table(rows)).collect()}
    want = {(d, n): tuple(x) for d, (n, *x) in brute_removed([r for r in rows if r[0] != 3]).items()}
    assert {k: v for k, v in got.items() if k[0] != 3} == want
    assert got[3, 180] == (0, 0, hashlib.sha256(b"again " * 30).hexdigest())  # rows of one doc_id don't remove from each other
    assert substrings.cleaned(table(odd_rows)).count() == len(odd_rows)
    assert substrings.cleaned(table([])).count() == 0


@pytest.mark.parametrize(("candidates", "queries"), [(topk.CANDIDATES, topk.QUERIES), (64, 2), (3, 1)])
def test_nearest(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)  # several blocks: bounds from the first pair of each
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 3.0]) * 10 ** rng.choice([0, 0, 0, 18]) for _ in range(40)] if i % 9 else [rng.random() for _ in range(40)]) for i in range(300)]
    rows += [(400, None), (401, [float("nan")] * 40), (402, [None] * 40), (50, rows[50][1]), (None, rows[1][1]), (403, [])]
    df = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.nearest(df, df.where("vec_id % 50 = 0")).collect())
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows[:300]}
    want = []
    for q in range(0, 300, 50):
        near = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert got == want


def test_nearest_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, q string, c int, x string, dims int"
    df = spark.createDataFrame([(0, [1.0, 2.0], "a", 1, "b", 3), (50, [2.0, 1.0], "a", 1, "b", 3), (7, [0.0, 1.0], "a", 1, "b", 3), (7, [0.0, 1.0], "a", 1, "b", 3), (9, [1.0], "a", 1, "b", 3)], schema)
    whole = topk.whole_numbers(df)
    got = sorted(map(tuple, topk.nearest(whole, whole.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 50, 4 << 16), (0, 2, 7, 2 << 16), (50, 1, 0, 4 << 16), (50, 2, 7, 1 << 16)]
    none = topk.whole_numbers(df.limit(0))
    assert topk.nearest(none, none).count() == 0


def test_packing_query_against_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = {d: [*x, 0] for d, x in zip(rows, plain_ids(list(rows.values())), strict=True)}
    got = packing.query(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = got.collect()
    seen, fill = dict.fromkeys(ids, 0), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert (p["start"], p["doc_tokens"]) == (seen[p["doc_id"]], len(own))
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        seen[p["doc_id"]] += p["length"]
        fill.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert seen == {d: len(x) for d, x in ids.items()}
    slots = 0
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        slots += at if at & (at - 1) == 0 else 1024
    assert slots <= 1.01 * sum(seen.values())


def unpacked(rows, ids):
    """Checks that rows hold each document's ids once; gives the pieces by sequence."""
    at = dict.fromkeys(ids, 0)
    by: dict = {}
    for d, start, length, crc, n, sequence, offset, total, raw in sorted(rows, key=lambda r: (r[0], r[1])):
        assert start == at[d] and n == len(ids[d]) // 4 and raw == ids[d][4 * start : 4 * (start + length)] and crc == zlib.crc32(raw)
        at[d] += length
        by.setdefault(sequence, []).append((offset, length, total, d))
    assert at == {d: len(x) // 4 for d, x in ids.items()}
    for own in by.values():
        own.sort()
        assert [o for o, *_ in own] == [sum(p[1] for p in own[:k]) for k in range(len(own))] and {p[2] for p in own} == {sum(p[1] for p in own)}
    return by


@pytest.mark.parametrize("spread", [(1, 3000), (1, 40), (500, 1100), (1008, 1040), (1, 1)])
def test_classes_hold_a_fixed_count(spread):
    rng = random.Random(spread[1])
    ids = {d: rng.randbytes(4 * rng.randint(*spread)) for d in range(3000)}
    bins = packing.Bins(0)
    full = [r for d, x in ids.items() for r in bins.put(d, x)]
    last = bins.rest()
    by = unpacked(full + last, ids)
    held = {r[5] for r in full}
    for sequence, own in by.items():
        total = own[0][2]
        if sequence in held:
            assert 1024 - total < packing.LEAST
            k = 1024 // own[0][1]
            if k > 1:  # the class's documents come first, and as many as fit
                assert [1024 // p[1] for p in own[:k]] == [k] * k
        else:
            assert total & (total - 1) == 0
    slots = 1024 * len(held) + sum(r[0][2] for s, r in by.items() if s not in held)
    assert slots <= 1.01 * sum(len(x) // 4 for x in ids.values())
    scraps = sum(r[2] < packing.LEAST and r[4] != r[2] for r in full)
    assert scraps == 0
    assert sum(r[2] < packing.LEAST and r[4] != r[2] for r in last) <= 2 * (len(by) - len(held))  # two ends of each of a worker's last sequences


def test_documents_are_cut_for_room_alone():
    rng = random.Random(1)
    ids = {d: rng.randbytes(4 * max(1, min(1024, int(rng.lognormvariate(5, 1))))) for d in range(4000)}
    bins = packing.Bins(0)
    full = [r for d, x in ids.items() for r in bins.put(d, x)]
    rows = full + bins.rest()
    by = unpacked(rows, ids)
    assert len(rows) - len(ids) <= 1.1 * len(by)  # a cut for each sequence
    assert all(r[2] == r[4] for r in full if r[2] < packing.LEAST)
    cut = [r for r in rows if r[2] < packing.LEAST and r[2] < r[4]]
    assert len(cut) <= 2 * (len(by) - len({r[5] for r in full}))


def test_token_file_query_against_brute_force(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = tokenfile.query(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    at, want = 0, []
    for (d, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        want.append((d, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        at += len(ids) + 1
    assert sorted(map(tuple, got.collect())) == want


def test_token_files_with_many_blocks_are_joined(table, monkeypatch):
    monkeypatch.setattr(tokenfile, "BROADCAST_BLOCKS", 1)
    blocks, code = tokenfile.write(table([(i, f"word{i} " * 50) for i in range(40)]), block_ids=100)
    got = sorted(map(tuple, tokenfile.read(blocks, code, with_ids=False).select("doc_id", "start", "n_tokens").collect()))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(40)]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_whole_texts(spark, sf_dir, odd_rows):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\n\n", ".", ",", "...", "a", "Hello", "'s", "12", "é", " ", "<|endoftext|>", "\t", "\r\n", "!?", "\x01", "😀", "-", ".\n", ",.", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(4000)] + [t for _, t in odd_rows]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = tokens.encoder(tokens.vocabulary_path()).encode(texts)
    wrong = [t for t, a, b in zip(texts, got, plain_ids(texts), strict=True) if a.tolist() != b]
    assert not wrong, wrong[0]


def test_packing(table, odd_rows):
    rows = [*odd_rows, *((100 + i, f"word{i} " * (i * 13 % 700)) for i in range(60))]
    pieces = packing.packed(table(rows)).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append(p)
    slots = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        slots += at if at & (at - 1) == 0 else 1024
    assert slots <= 1.01 * sum(p["length"] for p in pieces)
    for (doc_id, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        if doc_id in (4, None):
            continue
        own = sorted(by_doc[doc_id], key=lambda p: p["start"])
        raw = b"".join(p["ids"] for p in own)
        assert np.frombuffer(raw, "<u4").tolist() == [*ids, 0]
        assert all(p["doc_tokens"] == len(ids) + 1 and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in own)
    assert packing.packed(table([])).count() == 0


def test_sequences_are_padded(table):
    whole = packing.sequences(packing.packed(table([(1, "a b c d e"), (2, "f g " * 900)]))).collect()
    assert all((n := len(r["ids"]) // 4) == 1024 or n & (n - 1) == 0 for r in whole)


def test_token_files(table, odd_rows):
    rows = [*odd_rows, *((100 + i, f"word{i} " * (i * 13 % 700)) for i in range(60))]
    blocks, code = tokenfile.write(table(rows), block_ids=3000)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read(blocks, code).collect()), key=lambda r: r[0])
    want = sorted(((d, [*ids, 2]) for (d, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True)), key=lambda r: (r[0] is not None, r[0]))
    at = 0
    for (start, d, n, crc), (want_d, ids) in zip(got, want, strict=True):
        assert (start, d, n, crc) == (at, want_d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    blocks, code = tokenfile.write(table([]))
    assert tokenfile.read(blocks, code).count() == 0


@pytest.mark.parametrize("longest", [9, 20])
def test_codes_are_prefix_free_and_short(longest):
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711])
    bits = tokenfile.code_lengths(counts, longest)
    assert bits.max() <= longest
    assert (bits > 0).tolist() == (counts > 0).tolist()
    assert sum(2.0 ** -int(b) for b in bits if b) == 1
    if longest == 20:
        entropy = -(counts[1:] / counts.sum() * np.log2(counts[1:] / counts.sum())).sum()
        assert (bits * counts).sum() / counts.sum() < entropy + 0.2


def test_pipeline_stages_take_odd_rows(spark, table, odd_rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    prose = " ".join(f"the {chr(97 + i % 26)}{chr(97 + i // 26)}ort" for i in range(60)) + " "
    rows = [*odd_rows, (20, prose), (21, prose + "mail jane at example dot com now"), (21, prose), (None, prose), (None, prose), (22, prose, None)]
    docs = table(rows).withColumnRenamed("q_words", "mix_size").withColumnRenamed("size", "_stay")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            assert out.dtypes == docs.dtypes
        assert out.count() > 0
        if name == "near_duplicates":
            assert sum(r["doc_id"] is None for r in out.collect()) == sum(r[0] is None for r in rows)
        if name == "personal_data":
            assert out.count() == docs.count()


def test_pipeline_loses_no_clean_document(spark, table):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    words = "the of and to in that is was for with as it on by from at this have are an river stone market window garden letter number summer winter people".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(80, 200))) + ".") for i in range(200)]
    docs = table(rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.count() == 200, name
    assert sorted(r["text"] for r in docs.collect()) == sorted(t for _, t in rows)


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = []
    from citeweave.llm.common import staged

    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            docs = staged(docs)
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2]
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert got == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))


def brute_rates(sizes):
    """Rate of each source from {source: size}: weights 3, 1, 2 share 150 % of all sizes, targets stop at twice a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return {s: target[s] / sizes[s] for s in order}


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    words = "the of and to in that is was for with as it on by from at this have are an river stone market window garden letter number summer winter people mountain teacher paper music station village doctor history language science".split()
    texts = {}
    for d in range(120):
        texts[d] = " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly"]) for _ in range(rng.randrange(60, 260))) + "."
    for d in range(120, 150):  # near copies: one word differs
        own = texts[d - 120].split(" ")
        own[len(own) // 2] = f"changed{d}"
        texts[d] = " ".join(own)
    texts |= {150: texts[3], 151: texts[3], 152: "far too short to stay", 153: None, 154: " ".join(["again and again"] * 60)}
    for d in range(0, 100, 7):
        texts[d] = f"Write to name{d}@mail{d}.example.org now. " + texts[d]
    source = {d: ["web", "book", "news", None][d % 7 % 4] for d in texts}
    rows = [(d, t, "en", source[d], len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def repeated(ws):
        threes = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        often = {x for x in threes if threes.count(x) > 1}
        return len({k + j for k, x in enumerate(threes) if x in often for j in range(3)})

    good = {d: t for d, t in texts.items() if len((t or "").split()) >= 50 and 2 * repeated(t.split()) <= len(t.split())}
    assert set(texts) - set(good) == {152, 153, 154}
    kept = {c for _, c in brute_classes(sorted(good.items()), 80).values()}
    assert len(kept) < 125
    clean = {d: re.sub(r"name\d+@mail\d+\.example\.org", "[EMAIL]", good[d]) for d in kept}
    sizes: dict = {}
    for d, t in clean.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(t.split())
    rates = brute_rates(sizes)
    want = {}
    for d in clean:
        rate = rates[source[d]]
        draw = int(hashlib.md5(f"0:{d}".encode()).hexdigest()[:12], 16) / 2**48
        want[d] = int(rate) + (draw < rate - int(rate))
    ids = {d: [*x, 0] for d, x in zip(clean, plain_ids(list(clean.values())), strict=True)}
    got: dict = {}
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        got.setdefault(p["doc_id"], []).extend(range(p["start"], p["start"] + p["length"]))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted([*range(len(ids[d]))] * n) for d, n in want.items() if n}
    assert len({n for n in want.values()}) > 1
