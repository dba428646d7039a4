"""Near duplicates by HyperMinHash.

A document's set is its distinct shingles of five lower-cased words. Its sketch has REGISTERS buckets; each keeps the smallest hash that falls into it as a leading-zero count and MANTISSA bits (16 bits in all),
and an empty bucket borrows a full one's by a fixed random order. Bands of ROWS registers are hashed; documents that share a band are candidates. Pairs whose estimate of the Jaccard index, corrected for
registers that collide by chance, is far too low are dropped, the others are compared on full sets of words.

Documents with equal sequences of words (by a 128-bit digest of the words themselves) are one class from the start; every other link is confirmed on full sets. No band's pairs are listed: each band's members are first compared with one hub, the member that shares most bands with others. Then components are built, and only
members of a band whose components still differ are compared with each other, by these and by finer sketches. A link of Jaccard index 0.85 shares no band with probability 2e-9, one of 0.80 with 3e-6; an estimate falls 4.5 standard errors short of the true index with probability 3e-6 or so. So the
expected recall of links is above 0.9999 (tests measure it on planted pairs at the threshold).

Defined results: texts with fewer than five words have their whole sequence as one shingle; null, empty and blank texts have none, are linked with nothing and are kept; rows that share a doc_id count as one document;
rows without doc_id take part in no link and are kept; the smallest doc_id of a component is kept; other columns are ignored (deduplicated() keeps them); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, groups, lowered, mixed, narrowed, staged, text_slices, word_bounds, word_hashes
from .components import components

WORDS = 5
REGISTERS, ROWS, MANTISSA = 256, 6, 10
BANDS = REGISTERS // ROWS
#: Members of a band that one task compares with as many others.
BLOCK = 2048
#: Finer sketches, for what hubs leave apart: so many one-byte registers, or all hashes of a set of at most SMALL.
FINE, SMALL = 1024, 256
_STEPS = [np.uint64(x) for x in mixed(np.arange(WORDS, dtype=np.uint64), 99).tolist()]
#: For each bucket, the order in which it looks for a full one.
_ORDER = np.stack([np.argsort(mixed(np.arange(REGISTERS, dtype=np.uint64), 1000 + b), kind="stable") for b in range(REGISTERS)])


def shingle_hashes(column: pa.Array):
    """(row, sorted distinct 64-bit hashes of its shingles, its lower-cased bytes)."""
    for row, data, starts in text_slices(column):
        low = lowered(data)
        first, stop, at = word_bounds(low, starts)
        words = word_hashes(low, first, stop)
        n = len(words)
        five = np.zeros(max(n - WORDS + 1, 0), dtype=np.uint64)
        for k in range(WORDS):
            five += mixed(words[k : n - WORDS + 1 + k] if n >= WORDS else words[:0]) * (_STEPS[k] | np.uint64(1))
        five = mixed(five)
        for k in range(len(at) - 1):
            a, b = int(at[k]), int(at[k + 1])
            own = low[starts[k] : starts[k + 1]]
            if b - a >= WORDS:
                yield row + k, np.unique(five[a : b - WORDS + 1]), own
            elif b > a:
                yield row + k, mixed(np.array([int((mixed(words[a:b]) * (np.array(_STEPS[: b - a]) | np.uint64(1))).sum(dtype=np.uint64))], dtype=np.uint64), b - a), own
            else:
                yield row + k, five[:0], own


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set (sorted distinct hashes, one at least)."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the smallest of each bucket
    full = bucket[first]
    rest = (hashes[first] << np.uint64(8)) | np.uint64(128)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.where(rest >> (np.uint64(63) - np.clip(zeros, 0, 63).astype(np.uint64)) == 0, zeros + 1, zeros)  # log2 may round up
    head = rest << np.clip(zeros, 0, 63).astype(np.uint64)
    mantissa = (head << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[full] = ((zeros.astype(np.uint64) + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(out == 0)
    if len(empty):
        filled = out > 0
        lender = _ORDER[empty, filled[_ORDER[empty]].argmax(axis=1)]
        out[empty] = out[lender]
    return out


def chance(n: np.ndarray) -> np.ndarray:
    """Probability that registers of two unrelated sets of n shingles agree."""
    load = np.maximum(np.asarray(n, dtype=np.float64) / REGISTERS, 1)[:, None]
    at_least = 1 - (1 - 0.5 ** np.arange(0, 50)[None, :]) ** load
    return ((at_least[:, :-1] - at_least[:, 1:]) ** 2).sum(axis=1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard index of pairs of sketches (rows), corrected for chance."""
    c = chance(n)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the words in order; null without words), sketch."""

    def run(batches):
        for batch in batches:
            n, keys, sketches = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for row, hashes, low in shingle_hashes(batch.column(1)):
                if len(hashes):
                    n[row], keys[row], sketches[row] = len(hashes), hashlib.blake2b(b" ".join(low.tobytes().split()), digest_size=16).digest(), sketch(hashes).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """band (hash of a band's registers, its number in the lowest six bits), node: a row for each band of each class."""

    def run(batches):
        seeds = mixed(np.arange(BANDS, dtype=np.uint64), 5)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                band = np.broadcast_to(seeds, regs.shape[:2]).copy()
                for r in range(ROWS):
                    band = mixed(band ^ regs[:, :, r].astype(np.uint64))
                band = band & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(band.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["band", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "band long, node long")


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose set sizes allow the threshold and whose estimate isn't 4.5 standard errors below it."""
    floor = least - 4.5 * (least * (1 - least) / REGISTERS) ** 0.5

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                near = estimate(a, b, np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())) >= floor
                keep = pa.array(near)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    percent = round(100 * least)
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def fine_sketch(hashes: np.ndarray) -> bytes:
    """The upper halves of a small set's hashes, sorted; else FINE registers of a byte, each a hash of the smallest hash in it (0: empty)."""
    if len(hashes) <= SMALL:
        return (hashes >> np.uint64(32)).astype("<u4").tobytes()
    bucket = (hashes >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = np.zeros(FINE, np.uint8)
    out[bucket[first]] = mixed(hashes[first], 3) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def detailed(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """node, fine: fine_sketch() of the documents that nodes names; null where several rows share the id."""

    def run(batches):
        for batch in batches:
            fine = [None] * batch.num_rows
            for row, hashes, _ in shingle_hashes(batch.column(1)):
                fine[row] = fine_sketch(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], names=["node", "fine"])

    few = narrowed(docs.select(F.col("doc_id").cast("long").alias("node"), F.col(text).alias("text")), nodes, "node")
    found = few.mapInArrow(run, "node long, fine binary")
    return found.groupBy("node").agg(F.when(F.count("*") == 1, F.first("fine")).alias("fine"))


def finely_alike(own: int, others: np.ndarray, size: np.ndarray, fine: list, least: float) -> np.ndarray:
    """Which of the others (places in size and fine) may reach the threshold with own. Both sets small: exact, but for hashes that collide, which only let more through; both large: by registers; else true."""
    out = np.ones(len(others), bool)
    if fine[own] is None:
        return out
    known = np.array([fine[k] is not None for k in others.tolist()], bool)
    if size[own] <= SMALL:
        both = np.flatnonzero(known & (size[others] <= SMALL))
        if len(both):
            mine = np.frombuffer(fine[own], "<u4")
            parts = [np.frombuffer(fine[k], "<u4") for k in others[both].tolist()]
            theirs = np.concatenate(parts)
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]))
            common = np.minimum(common + len(mine) - len(np.unique(mine)), np.minimum(size[own], size[others[both]]))
            out[both] = common >= least * (size[own] + size[others[both]] - common) - 1e-6
    else:
        both = np.flatnonzero(known & (size[others] > SMALL))
        if len(both):
            mine = np.frombuffer(fine[own], np.uint8)
            theirs = np.frombuffer(b"".join(fine[k] for k in others[both].tolist()), np.uint8).reshape(-1, FINE)
            full = (theirs > 0) | (mine > 0)
            share = ((theirs == mine) & full).sum(axis=1) / full.sum(axis=1)
            out[both] = share >= least - 4.5 * (least * (1 - least) / FINE) ** 0.5
    return out


def apart(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of one band whose components (c) differ, that likely() and finely_alike() would let through. rows: band, node, c, n (members of the band), n_shingles, sketch, fine.

    A pair is reported by the first band that it shares. A band's members are compared in blocks; a larger band is dealt into several, and each pair of blocks is a group of its own, so no task holds more than two.
    """
    floor = least - 4.5 * (least * (1 - least) / REGISTERS) ** 0.5
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def run(batches):
        for part in groups(batches, ("band", "x", "y")):
            node, c, size = (np.array(part[n], dtype=np.int64) for n in ("node", "c", "n_shingles"))
            own, regs = np.array(part["own"]), np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(-1, REGISTERS)
            left, right = (np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max()))
            alike = chance(np.array([size.min()]))[0]
            need = (floor * (1 - alike) + alike) * REGISTERS
            a, b = [], []
            for i in left.tolist():
                ok = right[(node[right] < node[i]) if own.min() == own.max() else slice(None)]
                ok = ok[(c[ok] != c[i]) & (100 * np.minimum(size[ok], size[i]) >= round(100 * least) * np.maximum(size[ok], size[i]))]
                same = regs[ok] == regs[i]
                near = same.sum(axis=1) >= need
                near[near] = finely_alike(i, ok[near], size, part["fine"], least)
                shared = same[near][:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2)
                ok = ok[near][shared.argmax(axis=1) == part["band"][0] & 63]
                a.append(np.maximum(node[ok], node[i]))
                b.append(np.minimum(node[ok], node[i]))
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = ["band", "x", "y"]
    return dealt.select(*keys, "own", "node", "c", "n_shingles", "sketch", "fine").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def shingles(text: str | None) -> set:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else {tuple(words)} if words else set()


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, text: str = "text") -> DataFrame:
    """The pairs (a, b) whose sets, from their whole texts, reach the threshold."""

    def run(batches):
        last, own = object(), set()
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if b != last:  # a hub's pairs come one after another
                    last, own = b, shingles(y.as_py())
                other = shingles(x.as_py())
                both = len(own & other)
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    side = lambda x: docs.select(F.col("doc_id").cast("long").alias(x), F.col(text).alias(f"t{x}"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    docs = narrowed(docs, wanted, "doc_id")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def clustered(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, as a staged table."""
    docs = docs.select("doc_id", text)
    rows = staged(sketched(docs, text))
    ok = rows.where("set_key is not null and doc_id is not null")
    classes = staged(ok.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    bands = banded(classes)
    shared = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = staged(bands.join(shared, "band"))
    degree = members.groupBy("node").agg(F.sum("members").alias("degree"))
    members_d = members.join(degree, "node").select("band", "node", F.struct("degree", (-F.col("node")).alias("first"), "node").alias("order"))
    hubs = members_d.groupBy("band").agg(F.max("order")["node"].alias("b"))
    tried = staged(members.join(hubs, "band").select(F.col("node").alias("a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    near = staged(likely(tried, classes, percent / 100))
    links = staged(confirmed(near, docs, percent, text))
    dropped(near)
    found = components(links)
    # what the hubs left apart: pairs of one band whose components differ
    placed = members.join(found.withColumnRenamed("component", "c"), "node", "left").select("band", "node", F.coalesce("c", "node").alias("c"))
    several = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").drop("lo", "hi")
    left = staged(placed.join(several, "band"))
    nodes = staged(left.select("node").distinct())
    both = left.join(classes.select("node", "n_shingles", "sketch").join(detailed(docs, nodes, text), "node"), "node")
    new = staged(apart(both, percent / 100).join(tried, ["a", "b"], "left_anti"))
    more = staged(confirmed(new, docs, percent, text))
    dropped(members, tried, left, nodes, new)
    if not more.isEmpty():
        before, found = found, components(links.union(more))
        dropped(before)
    place = classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    joined = rows.select("doc_id", "n_shingles", "set_key").join(place, "set_key", "left")
    out = staged(joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id")).alias("component_id")))
    dropped(rows, classes, links, more, found)
    return out


def deduplicated(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest doc_id.

    Rows that share it are cut to the one with the least text (null first), then with the least other columns as JSON, so reruns agree. Rows without doc_id stay; null, empty and blank texts are linked with nothing and stay; very long texts count whole; an empty table gives an empty table.
    """
    stay = clustered(docs, percent, text).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    known = docs.join(stay, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("nd_id")).agg(F.min_by(row, F.struct(F.col(f"`{text}`"), F.to_json(row))).alias("nd_row"))
    return known.select(*[F.col("nd_row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS lo FROM s UNION SELECT u.b, r.lo FROM r JOIN u ON r.node = u.a WHERE r.lo < u.b),
c AS (SELECT node, min(lo) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.node
"""
