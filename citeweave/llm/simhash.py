"""SimHash near duplicates by bit-sliced comparison.

A text's fingerprint has a bit where over half of its shingles' XXH64 have it (three lower-cased words a shingle, repeats count). Fingerprints within RADIUS bits of each other are linked; components are built over distinct fingerprints.

Of 64 bits in RADIUS + 1 bands, two linked fingerprints share one band at least, so each band's value is a bucket's key. A bucket of more than BUCKET members is dealt again by what its keys leave of the bits: the rest is cut into RADIUS + 1
bands as well, of which linked fingerprints again share one, and so on for LEVELS levels. What is still larger (fingerprints that hardly differ) is dealt into tiles, each pair of tiles a group of its own. So no task holds more than two tiles,
and no member is left out.

Within a group, candidates stand vertically: a bit plane is a row of words, 64 candidates to a word. A query's distances to 64 candidates grow in carry-save counters, one plane a step: two words of sums and one of overflows, which start so
that they overflow past the radius. After every few planes, blocks whose 64 candidates have all overflowed are abandoned. Of the links that a group finds, only a spanning forest leaves the task: the components are the same, and a clump of near copies
sends a row for each member rather than for each pair.

Defined results: null, empty and blank texts have fingerprint 0, which links like any other; one or two words are one shingle; repeated rows and rows that share a doc_id are rows of their own, linked by their fingerprints alone; a row
without doc_id takes part in links and shows its component's smallest doc_id (null if it has none); very long texts are hashed in steps; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, groups, sent, staged
from .components import components

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Members of a bucket that are compared as they are, levels of bands, and members of a tile beyond the last level.
BUCKET, LEVELS, TILE = 4096, 3, 4096
#: Shingles hashed at once; blocks (a query beside 64 candidates) compared at once; planes between two looks at what may be abandoned.
_STEP, _BLOCKS, _PLANES = 1 << 16, 1 << 15, 8
#: Up to so many linked fingerprints (some 40 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_LINKED = 1 << 19
_ONE, _FULL = np.uint64(1), np.uint64(2**64 - 1)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # these split and lower exactly the characters that the contract names
    if not words:
        return 0
    n = max(len(words) - WORDS + 1, 1)
    line = b" ".join(words)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    first, last = start[:n].tolist(), stop[min(WORDS, len(words)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _STEP):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[k : k + _STEP], last[k : k + _STEP], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, print (64 bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, print long")


def planes(prints: np.ndarray) -> np.ndarray:
    """Row b has bit b of every fingerprint (uint64), 64 to a word, the first in the lowest bit."""
    padded = np.concatenate([prints, np.zeros(-len(prints) % 64, np.uint64)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number as often as its range is long, and the ranges' numbers."""
    size = np.maximum(stop - first, 0)
    own = np.repeat(np.arange(len(size)), size)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own]


def close_pairs(prints: np.ndarray, first: np.ndarray, stop: np.ndarray, radius: int = RADIUS):
    """(query, candidate) row numbers, in arrays a step, of all pairs within the radius: row i is compared with rows first[i] to stop[i]."""
    table = planes(prints)
    varied = [b for b in range(BITS) if int(np.bitwise_or.reduce(prints) & ~np.bitwise_and.reduce(prints)) >> b & 1]  # a bit that all share adds nothing
    high = [_FULL * (prints >> np.uint64(b) & _ONE) for b in range(BITS)]
    counters = max(radius.bit_length(), 1)
    begin = 2**counters - 1 - radius  # so that a count overflows as it passes the radius
    some = stop > first
    query, word = _ranges(np.where(some, first // 64, 0), np.where(some, (stop + 63) // 64, 0))
    for k in range(0, len(query), _BLOCKS):
        q, w = query[k : k + _BLOCKS], word[k : k + _BLOCKS]
        low, up = np.clip(first[q] - 64 * w, 0, 63).astype(np.uint64), np.clip(64 * (w + 1) - stop[q], 0, 63).astype(np.uint64)
        over = ~((_FULL << low) & (_FULL >> up))  # what lies outside the range has failed from the start
        sums = [np.full(len(q), _FULL if begin >> c & 1 else 0, np.uint64) for c in range(counters)]
        for n, b in enumerate(varied):
            carry = table[b][w] ^ high[b][q]
            for c in range(counters):
                sums[c], carry = sums[c] ^ carry, sums[c] & carry
            over |= carry
            if n % _PLANES == _PLANES - 1:
                live = np.flatnonzero(over != _FULL)
                if len(live) < 0.8 * len(q):
                    q, w, over, sums = q[live], w[live], over[live], [s[live] for s in sums]
        live = np.flatnonzero(over != _FULL)
        near = np.unpackbits((~over[live]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        block, bit = np.nonzero(near)
        yield q[live][block], 64 * w[live][block] + bit


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each row's lowest row of its component) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := label[label]) != label).any():
            label = up


def _bands(bits: tuple[int, ...], radius: int) -> list[tuple[int, ...]]:
    """The bits cut into radius + 1 bands of nearly the same size."""
    return [tuple(int(x) for x in part) for part in np.array_split(np.array(bits, int), radius + 1)]


def _taken(column, bits: tuple[int, ...]):
    mask = sum(1 << b for b in bits)
    return column.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _buckets(nodes: DataFrame, radius: int, most: int, levels: int) -> list[DataFrame]:
    """Tables of way (the bands' numbers), own (the bits in them), size, node, print: every linked pair is in a bucket of one of them at least. Buckets of one member link nothing and are left out."""
    out: list[DataFrame] = []
    rows, rests = nodes.withColumn("way", F.lit("")).withColumn("own", F.lit(0).cast("long")), {"": tuple(range(BITS))}
    for level in range(levels):
        parts, after = [], {}
        for way, rest in rests.items():
            for n, band in enumerate(_bands(rest, radius)):
                after[f"{way}{n}."] = tuple(b for b in rest if b not in band)
                parts.append(F.when(F.col("way") == way, F.struct(F.lit(f"{way}{n}.").alias("way"), F.col("own").bitwiseOR(_taken(F.col("print"), band)).alias("own"))))
        dealt = rows.select("node", "print", F.explode(F.array_compact(F.array(*parts))).alias("to")).select("node", "print", "to.*")
        size = dealt.groupBy("way", "own").agg(F.count("*").alias("size")).where("size > 1")
        sized = staged(dealt.join(size, ["way", "own"]))
        out.append(sized)
        large = sized.where(F.col("size") > most)
        if level == levels - 1 or large.isEmpty():
            break
        out[-1] = sized.where(F.col("size") <= most)
        rows, rests = large.select("node", "print", "way", "own"), after
    return out


def _linked(buckets: DataFrame, radius: int, tile: int) -> DataFrame:
    """Links (a, b) between nodes, a spanning forest of each group's. buckets: way, own, size, node, print."""
    tiles = F.ceil(F.col("size") / tile).cast("int")
    rows = buckets.withColumn("side", F.pmod(F.xxhash64("node", F.lit(11)), tiles).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))).withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other"))
    keys = ["way", "own", "x", "y"]

    def links(prints, nodes, first, stop):
        label = np.arange(len(prints))
        for a, b in close_pairs(prints, first, stop, radius):
            label = joined(label, a, b)
        rest = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[label[rest]])], names=["a", "b"])

    def run(batches):
        prints, nodes, first, stop, n = [], [], [], [], 0
        for group in groups(batches, ("way", "own", "x", "y")):
            size, side = len(group["node"]), np.array(group["side"])
            own = np.arange(n, n + size)
            cut = n + int((side == group["x"][0]).sum())
            if group["x"][0] == group["y"][0]:
                first.append(own + 1)
                stop.append(np.full(size, n + size))
            else:  # rows come by side: those of x are compared with those of y
                first.append(np.full(size, cut))
                stop.append(np.where(own < cut, n + size, cut))
            prints.append(np.array(group["print"], np.int64).view(np.uint64))
            nodes.append(np.array(group["node"], np.int64))
            n += size
            if n >= 2 * tile:
                yield links(*(np.concatenate(v) for v in (prints, nodes, first, stop)))
                prints, nodes, first, stop, n = [], [], [], [], 0
        if n:
            yield links(*(np.concatenate(v) for v in (prints, nodes, first, stop)))

    return rows.select("way", "own", "x", "y", "side", "node", "print").repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "a long, b long")


def clustered(docs: DataFrame, radius: int = RADIUS, text: str = "text", bucket: int = BUCKET, levels: int = LEVELS, tile: int = TILE) -> DataFrame:
    """doc_id, print, component_id, as a staged table."""
    rows = staged(fingerprints(docs, text))
    classes = staged(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    nodes = classes.select(F.col("print").alias("node"), "print")
    tables = _buckets(nodes, radius, bucket, levels)
    links = staged(reduce(DataFrame.union, [_linked(t, radius, tile) for t in tables]))
    dropped(*tables)
    found = components(links)  # of fingerprints that have links
    named = classes.join(sent(found, BROADCAST_LINKED).withColumnRenamed("node", "print"), "print")
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    linked = staged(named.select("print", "component").join(lowest, "component").select("print", "lowest"))
    # a row alone with its fingerprint, which has no links, needs no join to know its component
    place = classes.join(linked, "print", "left").where("rows > 1 or lowest is not null or first is null").select("print", F.coalesce("lowest", "first").alias("place"))
    out = rows.join(sent(place, BROADCAST_LINKED), "print", "left").select("doc_id", "print", F.coalesce("place", "doc_id").alias("component_id"))
    out = staged(out)
    dropped(rows, classes, links, found, linked)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
