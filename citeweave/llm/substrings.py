"""Removal of repeated byte strings, by column-wise construction of a multi-document suffix order.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Work happens in chunks of documents, written once:

1. Every string of LENGTH bytes has an anchor, the SEED bytes in it with the smallest hash (leftmost of equals), so equal strings have equal anchors at equal places. Chunks send fingerprints of their anchors;
   what comes back says which anchors other chunks have too, which are in many (hot), and which documents are whole copies.
2. Around each shared anchor, the bytes of the strings that it anchors are a fragment. Equal fragments of a chunk are sent once (later documents of that chunk lose theirs at once). A hot anchor's strings are sent
   one by one and dealt by their own hash, so that no key gathers more than a fragment from each chunk.
3. In each bucket the fragments, aligned at their anchors, are the documents of a column-wise construction: every round adds one symbol to each, from the right, and updates the order of all suffixes (a stable counting
   sort, as the last-to-first mapping of the Burrows-Wheeler transform gives it) and the common prefixes of neighbours. Neighbours with LENGTH bytes in common hold equal strings; all but those of the
   smallest doc_id are reported to their chunks.
4. Chunks take the reported spans out.

Defined results: null and empty texts stay empty; rows that share a doc_id don't remove from each other; a null doc_id counts as larger than any other; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, prefix_hashes, range_hashes, staged

LENGTH, SEED = 50, 20
SPAN = LENGTH - SEED  # an anchor starts at most so far into its string
CHUNK_BYTES = 1 << 20
#: A bucket holds what repeats of so many bytes of text at most, whatever the input: there are the more of them.
BUCKET_BYTES = 1 << 23
#: An anchor in so many chunks is hot.
HOT = 128
_LAST = np.iinfo(np.int64).max
_NONE = np.uint64(2**64 - 1)


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, text: str = "text") -> DataFrame:
    """chunk, n_bytes, ids, nulls, ends, payload: documents side by side, in order of doc_id, their bytes compressed."""

    def run(batches):
        from pyspark import TaskContext

        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        pack = zstandard.ZstdCompressor(level=3)

        def close():
            held.sort(key=lambda r: r[0])
            ends = np.cumsum([len(r[2]) for r in held], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + number], pa.int64()), pa.array([size], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array([r[0] for r in held], np.int64).tobytes(), np.array([r[1] for r in held], np.uint8).tobytes(), ends.tobytes(), pack.compress(b"".join(r[2] for r in held))))],
                names=["chunk", "n_bytes", "ids", "nulls", "ends", "payload"],
            )

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                held.append((_LAST if doc_id is None else doc_id, doc_id is None, data))
                size += len(data)
                if size >= chunk_bytes or len(held) >= 20_000:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data")).mapInArrow(run, "chunk long, n_bytes long, ids binary, nulls binary, ends binary, payload binary")


class Chunk:
    """A chunk's documents, unpacked."""

    def __init__(self, ids: bytes, ends: bytes, payload: bytes):
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)

    def digests(self) -> list[bytes]:
        return [hashlib.blake2b(self.data[a:b], digest_size=16).digest() if b - a >= LENGTH else b"" for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def anchors(self):
        """Place and hash of each anchor, and its first and last string's start. Anchors are in order of place."""
        n = len(self.data)
        empty = np.zeros(0, np.int64)
        if n < LENGTH:
            return empty, empty.astype(np.uint64), empty, empty
        self.prefix = prefix_hashes(self.data)
        at = np.arange(n - SEED + 1)
        value = range_hashes(self.prefix, at, at + SEED)
        place = at.astype(np.int64)
        value, place, width = value.copy(), place, 1
        seeds = value
        for step in (1, 2, 4, 8, SPAN + 1 - 16):  # smallest of 1, 2, 4, 8, 16 and then SPAN + 1 neighbours
            left, right = value[: len(value) - step], value[step:]
            other = right < left
            place = np.where(other, place[step:], place[: len(place) - step])
            value = np.where(other, right, left)
            width += step
        string = np.flatnonzero(self._inside(len(value)))
        place = place[string]
        first = np.flatnonzero(np.diff(place, prepend=-1) | (np.diff(string, prepend=-2) != 1))
        last = np.append(first[1:], len(string)) - 1
        return place[first], seeds[place[first]], string[first], string[last]

    def _inside(self, n: int) -> np.ndarray:
        """Which of the first n places start a string within one document."""
        whole = np.zeros(n + 1, np.int8)
        long = self.ends - self.starts >= LENGTH
        np.add.at(whole, self.starts[long], 1)
        np.add.at(whole, self.ends[long] - LENGTH + 1, -1)
        return np.cumsum(whole)[:n] > 0


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _sections(order_key: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of runs of equal values in a sorted array."""
    if not len(order_key):
        return []
    cut = np.flatnonzero(np.diff(order_key)) + 1
    edges = [0, *cut.tolist(), len(order_key)]
    return [(int(order_key[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)


_ASK = ["bucket", "chunk", "marks", "digests", "owners"]


def asked(chunked: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of each chunk's anchors and digests of its documents, by bucket."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for chunk, ids, ends, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "ends", "payload")), strict=True):
                own = Chunk(ids, ends, payload)
                marks = _distinct(own.anchors()[1])
                marks = marks[np.lexsort((marks, _bucket(marks, buckets)))]
                rows = {b: (marks[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for b, i, j in _sections(_bucket(marks, buckets))}
                first: dict[bytes, int] = {}
                for digest, doc_id in zip(own.digests(), own.ids.tolist(), strict=True):
                    if digest and digest not in first:  # documents are in order: the smallest doc_id
                        first[digest] = doc_id
                by: dict[int, list[bytes]] = {}
                for digest in first:
                    by.setdefault(int.from_bytes(digest[:4], "little") % buckets, []).append(digest)
                out = [(b, chunk, rows.get(b, b""), b"".join(by.get(b, [])), np.array([first[d] for d in by.get(b, [])], np.int64).tobytes()) for b in sorted(set(rows) | set(by))]
                if out:
                    yield _batch(out, _ASK, kinds)

    return chunked.select("chunk", "ids", "ends", "payload").mapInArrow(run, "bucket long, chunk long, marks binary, digests binary, owners binary")


def _grouped(batches, key: str = "bucket"):
    """Lists of rows (dicts of columns) of one key each; rows come sorted by it."""
    last, rows = None, []
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for i, k in enumerate(columns[key].to_pylist()):
            if k != last and rows:
                yield rows
                rows = []
            last = k
            rows.append({n: c[i].as_py() for n, c in columns.items()})
    if rows:
        yield rows


def answered(asks: DataFrame) -> DataFrame:
    """chunk, bucket, flags (a byte for each mark: 1 in other chunks too, 2 hot), copies (digests of documents that a smaller doc_id has)."""

    def run(batches):
        for rows in _grouped(batches):
            marks = [np.frombuffer(r["marks"], np.uint32) for r in rows]
            every = np.concatenate(marks)
            _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
            flags = ((counts > 1).astype(np.uint8) + (counts >= HOT))[inverse].astype(np.uint8) if len(every) else np.zeros(0, np.uint8)
            least: dict[bytes, int] = {}
            digests = [[r["digests"][i : i + 16] for i in range(0, len(r["digests"]), 16)] for r in rows]
            owners = [np.frombuffer(r["owners"], np.int64).tolist() for r in rows]
            for ds, os in zip(digests, owners, strict=True):
                for d, o in zip(ds, os, strict=True):
                    least[d] = min(o, least.get(d, _LAST))
            out, at = [], 0
            for r, m, ds, os in zip(rows, marks, digests, owners, strict=True):
                own = flags[at : at + len(m)]
                at += len(m)
                copies = b"".join(d for d, o in zip(ds, os, strict=True) if least[d] < o)
                if own.any() or copies:
                    out.append((r["chunk"], r["bucket"], own.tobytes(), copies))
            if out:
                yield _batch(out, ["chunk", "bucket", "flags", "copies"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket long, flags binary, copies binary")


_SENT = ["bucket", "chunk", "fragments", "starts", "ends"]
_SENT_SCHEMA = "bucket long, chunk long, fragments binary, starts binary, ends binary"
#: What a message of fragments holds: for each its document's doc_id (by number in ids), first and last string's column and number of places; all places; all bytes.
_PARTS = (("ids", "<i8"), ("docs", "<u4"), ("first", "u1"), ("last", "u1"), ("n_places", "<u4"), ("places", "<u4"), ("bytes", "u1"))


def _packed(**parts: np.ndarray) -> bytes:
    """One compressed message; numbers lie by byte (all lowest bytes first), which compresses better."""
    raw = [parts[n].astype(k) for n, k in _PARTS]
    body = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in raw)
    return np.array([len(x) for x in raw], "<u4").tobytes() + zstandard.ZstdCompressor(level=3).compress(body)


def _unpacked(message: bytes) -> dict[str, np.ndarray]:
    sizes = np.frombuffer(message, "<u4", len(_PARTS)).tolist()
    body, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(message[4 * len(_PARTS) :]), np.uint8), 0, {}
    for (name, kind), n in zip(_PARTS, sizes, strict=True):
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(kind).reshape(-1)
        at += n * width
    return out


def _pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of all, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def unlike(data: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each fragment data[start:end] differs in its bytes, or in where its anchor (place) lies, from the fragment that other names. Fragments have eight bytes at least."""
    size = end - start
    out = (size != size[other]) | (place - start != (place - start)[other])
    open_ = np.flatnonzero(~out & (other != np.arange(len(other))))
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    for k in range(0, int(size.max(initial=0)), 8):
        at = np.minimum(k, size[open_] - 8)  # the last eight bytes overlap those before
        differ = words[start[open_] + at] != words[start[other[open_]] + at]
        out[open_[differ]] = True
        open_ = open_[~differ & (size[open_] > k + 8)]
        if not len(open_):
            break
    return out


def fragments(chunked: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Rows of _SENT: fragments by bucket, and spans that the chunk itself settles."""
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"), F.collect_list("copies").alias("copies"))

    def run(batches):
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 3
        for batch in batches:
            for chunk, ids, ends, payload, flags, copies in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "ends", "payload", "flags", "copies")), strict=True):
                own = Chunk(ids, ends, payload)
                lost = {c[i : i + 16] for c in copies or [] for i in range(0, len(c), 16)}
                seen: dict[bytes, int] = {}
                gone = np.zeros(len(own.ids), bool)
                for k, (digest, doc_id) in enumerate(zip(own.digests(), own.ids.tolist(), strict=True)):
                    if digest:
                        gone[k] = digest in lost and doc_id >= seen.setdefault(digest, doc_id) or doc_id > seen.setdefault(digest, doc_id)
                starts, stops = [own.starts[gone]], [own.ends[gone]]
                place, seed, first, last = own.anchors()
                marks = _distinct(seed)
                marks = marks[np.lexsort((marks, _bucket(marks, buckets)))]
                flag = np.zeros(len(marks), np.uint8)
                has = {f["bucket"]: f["flags"] for f in flags or []}
                for b, i, j in _sections(_bucket(marks, buckets)):
                    if has.get(b):
                        flag[i:j] = np.frombuffer(has[b], np.uint8)
                sorter = np.argsort(marks)
                flag = flag[sorter][np.searchsorted(marks[sorter], seed)]
                doc = np.searchsorted(own.ends, place, side="right")
                # anchors of several documents of this chunk matter too
                _, inverse = np.unique(seed, return_inverse=True)
                low, high = np.full(len(marks), _LAST), np.full(len(marks), -1)
                np.minimum.at(low, inverse, doc)
                np.maximum.at(high, inverse, doc)
                flag = np.maximum(flag, (low < high)[inverse])
                keep = (flag > 0) & ~gone[doc]
                place, seed, first, last, flag, doc = (x[keep] for x in (place, seed, first, last, flag, doc))
                hot = np.flatnonzero(flag == 2)
                n = (last - first + 1)[hot]
                each = np.repeat(hot, n)
                string = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cold = np.flatnonzero(flag == 1)
                at = np.concatenate([cold, each])
                a, b = np.concatenate([first[cold], string]), np.concatenate([last[cold], string])
                key = range_hashes(own.prefix, a, b + LENGTH) ^ mixed((a - place[at]).astype(np.uint64) * np.uint64(64) + (b - a).astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
                deal = np.concatenate([_bucket(seed[cold], buckets), _bucket(key[len(cold) :], buckets)])
                place, owner = place[at], own.ids[doc[at]]
                odd, tries = np.ones(1, bool), 0
                while odd.any():  # a group has equal bytes, not only equal hashes
                    order = np.lexsort((place, owner, key, deal))
                    key, deal, place, owner, a, b = (x[order] for x in (key, deal, place, owner, a, b))
                    fresh = np.flatnonzero(np.diff(key, prepend=~key[:1]) | (np.diff(deal, prepend=-1) != 0)) if len(key) else np.zeros(0, np.int64)
                    group = np.zeros(len(key), np.int64)
                    group[fresh] = 1
                    group = np.cumsum(group) - 1
                    odd, tries = unlike(own.data, place, a, b + LENGTH, fresh[group]), tries + 1
                    key[odd] = mixed(key[odd], tries)
                later = owner > owner[fresh][group] if len(key) else np.zeros(0, bool)
                starts.append(a[later])
                stops.append(b[later] + LENGTH)
                rest = np.flatnonzero(~later)
                count = np.bincount(group[rest], minlength=len(fresh))
                out = []
                cuts = np.concatenate([[0], np.cumsum(count)])
                for bucket, i, j in _sections(deal[fresh]):
                    f = fresh[i:j]
                    ids, docs = np.unique(owner[f], return_inverse=True)
                    message = _packed(ids=ids, docs=docs, first=a[f] - place[f] + SPAN, last=b[f] - place[f] + SPAN, n_places=count[i:j], places=place[rest[cuts[i] : cuts[j]]], bytes=_pieces(own.data, a[f], b[f] - a[f] + LENGTH))
                    out.append((bucket, chunk, message, None, None))
                s, e = np.concatenate(starts), np.concatenate(stops)
                if len(s):
                    s, e = _merged(s, e)
                    out.append((chunk % buckets, chunk, None, s.astype(np.uint32).tobytes(), e.astype(np.uint32).tobytes()))
                if out:
                    yield _batch(out, _SENT, kinds)

    # all columns, as cleaned() takes them: so both joins read one exchange of the chunks
    return chunked.join(by_chunk, "chunk", "left").select(*chunked.columns, "flags", "copies").mapInArrow(run, _SENT_SCHEMA)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, in order. Spans that only touch stay apart."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] >= end[:-1]]))
    return start[fresh], end[np.append(fresh[1:], len(end)) - 1]


_WIDTH = LENGTH + SPAN
_PADDED = _WIDTH + LENGTH + 8


def _shared(words: np.ndarray, a: np.ndarray, b: np.ndarray, column: int) -> np.ndarray:
    """Bytes that rows a and b have in common from the column on, LENGTH at most."""
    out = np.full(len(a), LENGTH, np.int64)
    open_ = np.arange(len(a))
    for k in range(0, LENGTH, 8):
        x = words[a[open_], column + k] ^ words[b[open_], column + k]
        differ = np.flatnonzero(x)
        if len(differ):
            low = x[differ]
            low = (low & (~low + np.uint64(1))) - np.uint64(1)
            out[open_[differ]] = np.minimum(LENGTH, k + np.bitwise_count(low) // 8)
            open_ = open_[x == 0]
        if not len(open_):
            break
    return out


def equal_strings(docs: np.ndarray, first: np.ndarray, last: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fragment, the first and last column (-1: none) at which it has a string that a fragment of a smaller doc_id has too.

    Fragments lie in rows, the anchor at column SPAN. Round by round, from the right, each gets one more symbol; order holds the suffixes' order, common the common prefixes of neighbours.
    """
    n = len(docs)
    frame = np.zeros((n, _PADDED), np.uint8)
    size = (last - first).astype(np.int64) + LENGTH
    ends = np.cumsum(size)
    within = np.arange(ends[-1]) - np.repeat(ends - size, size)
    frame[np.repeat(np.arange(n), size), np.repeat(first.astype(np.int64), size) + within] = data
    words = np.ndarray((n, _PADDED - 7), "<u8", frame, strides=(_PADDED, 1))
    order, common = np.arange(n), np.full(n, LENGTH, np.int64)
    common[:1] = 0
    lo, hi = np.full(n, -1), np.full(n, -1)
    for column in range(_WIDTH - 1, -1, -1):
        symbol = frame[order, column]
        moved = np.argsort(symbol, kind="stable")
        symbol, order = symbol[moved], order[moved]
        same = np.concatenate([[False], symbol[1:] == symbol[:-1]])
        beside = np.concatenate([[False], np.diff(moved) == 1])
        now = np.zeros(n, np.int64)
        kept = same & beside
        now[kept] = np.minimum(common[moved[kept]] + 1, LENGTH)
        ask = np.flatnonzero(same & ~beside)
        now[ask] = _shared(words, order[ask - 1], order[ask], column)
        common = now
        if column <= SPAN:
            begins = np.flatnonzero(common < LENGTH)
            if len(begins) < n:
                own = order
                valid = (first[own] <= column) & (column <= last[own])
                owner = np.where(valid, docs[own], _LAST)
                least = np.minimum.reduceat(owner, begins)
                least = np.repeat(least, np.diff(np.append(begins, n)))
                hit = own[valid & (docs[own] > least)]
                hi[hit] = np.where(hi[hit] < 0, column, hi[hit])
                lo[hit] = column
    return lo, hi


def settled(sent: DataFrame) -> DataFrame:
    """chunk, starts, ends: spans to remove."""

    def run(batches):
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        for rows in _grouped(batches):
            out = [(r["chunk"], r["starts"], r["ends"]) for r in rows if r["starts"] is not None]
            sent = [(r["chunk"], _unpacked(r["fragments"])) for r in rows if r["fragments"]]
            if sent:
                docs = np.concatenate([m["ids"][m["docs"]] for _, m in sent])
                first, last, data = (np.concatenate([m[c] for _, m in sent]) for c in ("first", "last", "bytes"))
                lo, hi = equal_strings(docs, first, last, data)
                at = 0
                for chunk, m in sent:
                    count, places = m["n_places"], m["places"].astype(np.int64)
                    a, b = np.repeat(lo[at : at + len(count)], count), np.repeat(hi[at : at + len(count)], count)
                    at += len(count)
                    hit = np.flatnonzero(a >= 0)
                    if len(hit):
                        s, e = _merged(places[hit] - SPAN + a[hit], places[hit] - SPAN + b[hit] + LENGTH)
                        out.append((chunk, s.astype(np.uint32).tobytes(), e.astype(np.uint32).tobytes()))
            if out:
                yield _batch(out, ["chunk", "starts", "ends"], kinds)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, starts binary, ends binary")


def cleaned(docs: DataFrame, text: str = "text", with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null unless with_bytes)."""
    chunked = staged(chunks(docs, text=text))
    size = chunked.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    spans = settled(fragments(chunked, answered(asked(chunked, buckets)), buckets))
    by_chunk = spans.groupBy("chunk").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("stops"))

    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            for ids, nulls, ends, payload, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("ids", "nulls", "ends", "payload", "starts", "stops")), strict=True):
                own = Chunk(ids, ends, payload)
                depth = np.zeros(len(own.data) + 1, np.int32)
                for s, e in zip(starts or [], stops or [], strict=True):
                    np.add.at(depth, np.frombuffer(s, np.uint32).astype(np.int64), 1)
                    np.add.at(depth, np.frombuffer(e, np.uint32).astype(np.int64), -1)
                gone = np.cumsum(depth)[:-1] > 0
                rows = []
                for doc_id, null, a, b in zip(own.ids.tolist(), nulls, own.starts.tolist(), own.ends.tolist(), strict=True):
                    lost = gone[a:b]
                    n = int(lost.sum())
                    kept = own.data[a:b][~lost].tobytes() if n else own.data[a:b].tobytes()
                    runs = int(np.count_nonzero(lost[1:] & ~lost[:-1])) + int(lost[0]) if n else 0
                    rows.append((None if null else doc_id, b - a, n, runs, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
                yield _batch(rows, names, kinds)

    joined = chunked.join(by_chunk, "chunk", "left").select(*chunked.columns, "starts", "stops")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False).drop("kept")
