"""Harmonic packing of token ids into sequences, without a shuffle.

A document's whole sequences stand alone. What is left, or a document that is shorter from the start, is of the harmonic class k if its length lies in (capacity / (k + 1), capacity / k], so k of a class always fit into a sequence. Each worker fills its own: a class's sequence
is closed once it has its k documents, and the room that these leave is filled from a reserve, which is the only place where documents are cut but for whole sequences: a few of the worker's documents of any class, a sequence's worth of ids at least, taken from the front.
No cut leaves a piece of fewer than LEAST ids, so a sequence may miss as many less one. What a worker holds when its documents end is strung together, cut into whole sequences, and the rest at powers of two, which need no padding.

Defined results: null and empty texts still have the end id and so one piece; repeated rows are packed each on its own; a null doc_id stays null; very long texts are encoded whole and cut into whole sequences;
extra columns are ignored; an empty table gives an empty table. The capacity must be a power of two.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder, vocabulary_path

CAPACITY = 1024
#: No cut leaves fewer ids, but for a worker's last ones.
LEAST = 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


def powers(n: int) -> list[int]:
    """n as powers of two, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


#: doc_id, the place of the piece's first id in its document, the document's length, ids (4 bytes each).
Piece = tuple[int | None, int, int, bytes]


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    d, start, total, ids = piece
    return (d, start, total, ids[: 4 * n]), (d, start + n, total, ids[4 * n :])


class Bins:
    """The open sequences of one worker. put() gives back the rows of sequences that are full, rest() those that are left."""

    def __init__(self, worker: int, capacity: int = CAPACITY, with_ids: bool = True, least: int = LEAST):
        self.capacity, self.with_ids, self.least = capacity, with_ids, min(least, capacity // 4)
        self.next = worker << 36
        self.open: dict[int, list[Piece]] = {}
        self.reserve: deque[Piece] = deque()
        self.reserved = 0

    def _closed(self, pieces: list[Piece]) -> list[tuple]:
        self.next += 1
        total, at, out = sum(len(p[3]) // 4 for p in pieces), 0, []
        for d, start, n, ids in pieces:
            length = len(ids) // 4
            out.append((d, start, length, zlib.crc32(ids), n, self.next - 1, at, total, ids if self.with_ids else None))
            at += length
        return out

    def put(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """Takes a document's ids."""
        out, left = [], (doc_id, 0, len(ids) // 4, ids)
        while (n := len(left[3]) // 4) >= self.capacity:
            if self.capacity < n < self.capacity + self.least:  # a whole sequence would leave a scrap
                half, left = _cut(left, self.capacity // 2)
                out += self._placed(half)
            else:
                whole, left = _cut(left, self.capacity)
                out += self._closed([whole])
        return out + self._placed(left) if left[3] else out

    def _placed(self, piece: Piece) -> list[tuple]:
        n = len(piece[3]) // 4
        if self.reserved < self.capacity:
            self.reserve.append(piece)
            self.reserved += n
            return []
        k = self.capacity // n
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) < k:
            return []
        del self.open[k]
        room = self.capacity - sum(len(p[3]) // 4 for p in pieces)
        return self._closed(pieces + self._filling(room))

    def _filling(self, room: int) -> list[Piece]:
        """Pieces of the reserve for the room that a sequence has. Each piece of the reserve is looked at once."""
        out = []
        for _ in range(len(self.reserve)):
            if room < self.least:
                break
            piece = self.reserve.popleft()
            n = len(piece[3]) // 4
            take = n if n <= room else min(room, n - self.least)
            if take == n:
                out.append(piece)
            elif take >= self.least:
                own, left = _cut(piece, take)
                out.append(own)
                self.reserve.appendleft(left)
            else:  # too short to cut
                self.reserve.append(piece)
                continue
            room -= take
            self.reserved -= take
        return out

    def rest(self) -> list[tuple]:
        """What is left, longest pieces first, cut into whole sequences and then at powers of two."""
        pieces = sorted([*self.reserve, *(p for held in self.open.values() for p in held)], key=lambda p: -len(p[3]))
        total = sum(len(p[3]) for p in pieces) // 4
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        self.open, self.reserve, self.reserved = {}, deque(), 0
        out, feed = [], deque(pieces)
        for size in sizes:
            own: list[Piece] = []
            while size:
                piece = feed.popleft()
                if len(piece[3]) // 4 > size:
                    piece, left = _cut(piece, size)
                    feed.appendleft(left)
                own.append(piece)
                size -= len(piece[3]) // 4
            out += self._closed(own)
        return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds, strict=True)], names=_NAMES)


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = True, text: str = "text") -> DataFrame:
    """One row a piece, as PIECE says. sequence_length is the sequence's ids without padding; ids are little-endian unsigned 32-bit, null unless with_ids."""
    vocabulary = vocabulary or vocabulary_path()
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def pack(batches):
        from pyspark import TaskContext

        bins, encode = Bins(TaskContext.get().partitionId(), capacity, with_ids), encoder(vocabulary).encode
        rows: list[tuple] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    rows += bins.put(doc_id, np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4").tobytes())
                if len(rows) >= 4096:
                    yield _table(rows)
                    rows = []
        rows += bins.rest()
        if rows:
            yield _table(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, PIECE)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (binary): whole sequences from packed(with_ids=True), padded to the capacity unless their length is a power of two. A group is one sequence."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.octet_length("joined") / 4
    padding = F.unhex(F.repeat(F.lit(np.uint32(pad_id).astype("<u4").tobytes().hex()), (capacity - n).cast("int")))
    power = F.log2(n) == F.floor(F.log2(n))
    return whole.select("sequence_id", joined.alias("joined")).select("sequence_id", F.when(power, F.col("joined")).otherwise(F.concat("joined", padding)).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
