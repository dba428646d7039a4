"""Token ids as canonical length-limited Huffman codes, in files of independent blocks with bit-offset checkpoints.

The format: a Parquet table whose rows are blocks in ascending doc_id order (columns part, block, first_id, n_ids, payload), beside a table ``code`` that holds
the one code of all blocks as (id, bits). A payload is, little-endian: documents, ids, ids between checkpoints (3 x u4); doc_ids (i8 each, with
a null mask of u1 each); ids of each document (u8 each); bit offset of every checkpoint (u8 each); the bit stream, most significant bit first.
Blocks decode on their own, and so does each run of ids between two checkpoints: the decoder steps through all runs of a block side by side with one table look-up an id.

Defined results: null and empty texts are documents of just the end id; rows that share a doc_id lie side by side in an unspecified order, their starts apart; null doc_ids come
first; extra columns are ignored; an empty table gives empty files. Counts come from all documents; only counts by id, no more than the vocabulary has, reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, sent, staged
from .tokens import encoder, vocabulary_path

LONGEST = 20
EVERY = 256
BLOCK_IDS = 1 << 19
#: Places of so many blocks (24 bytes each, BLOCK_IDS ids behind each) are sent to every executor; of more, they are joined.
BROADCAST_BLOCKS = 1 << 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits for each symbol of an optimal code of at most ``longest`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("too many symbols for the longest code")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    n = len(used)
    # from the rarest level up: a list of leaves and packages of two in order of weight; leaf[k] counts leaves among the first k
    weights, leaves = coins, []
    leaves.append(np.ones(n, dtype=bool))
    for _ in range(longest - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        order = np.argsort(both, kind="stable")
        weights = both[order]
        leaves.append(order < n)
    bits = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    out[used] = bits
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (bits, symbol)."""
    codes = np.zeros(len(bits), dtype=np.uint64)
    used = np.flatnonzero(bits)
    used = used[np.argsort(bits[used], kind="stable")]
    if len(used):
        top = int(bits.max())
        steps = np.uint64(1) << (np.uint64(top) - bits[used].astype(np.uint64))
        start = np.concatenate([[0], np.cumsum(steps)[:-1]]).astype(np.uint64)
        codes[used] = start >> (np.uint64(top) - bits[used].astype(np.uint64))
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next ``top`` bits: symbol << 6 | bits."""
    top = max(1, int(bits.max(initial=1)))
    used = np.flatnonzero(bits)
    used = used[np.argsort(bits[used], kind="stable")]
    table = np.zeros(1 << top, dtype=np.int64)
    full = np.repeat(used.astype(np.int64) << 6 | bits[used], 1 << (top - bits[used].astype(np.int64)))
    table[: len(full)] = full
    return table, top


def pack_bits(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offset of each id, and the stream."""
    size = bits[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 1, dtype=np.uint64)
    if len(ids):
        word, shift = at >> 6, 64 - (at & 63) - size
        code = codes[ids]
        here = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat(here, first)  # bits of different ids don't overlap
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return at, words.astype(">u8").tobytes()[: (int(ends[-1]) + 7 >> 3) if len(ids) else 0]


def unpack_bits(stream: bytes, marks: np.ndarray, n: int, every: int, table: np.ndarray, top: int) -> np.ndarray:
    """n ids, all runs between checkpoints side by side."""
    data = np.frombuffer(stream + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
    # the 32 bits from every byte on
    window = data[:-3] << np.uint64(24) | data[1:-2] << np.uint64(16) | data[2:-1] << np.uint64(8) | data[3:]
    out = np.zeros((every, len(marks)), dtype=np.uint32)
    at, live = marks.astype(np.int64), len(marks)
    mask = (1 << top) - 1
    for k in range(every):
        if k == n - (len(marks) - 1) * every:  # the last run may be shorter
            live -= 1
            at = at[:live]
        if not live:
            break
        found = table[(window[at >> 3].astype(np.int64) >> (32 - top - (at & 7))) & mask]
        out[k, :live] = found >> 6
        at = at + (found & 63)
    return out.T.reshape(-1)[:n]


def pack_block(doc_ids: list, arrays: list[np.ndarray], codes: np.ndarray, bits: np.ndarray, every: int = EVERY) -> bytes:
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    at, stream = pack_bits(ids, codes, bits)
    head = np.array([len(doc_ids), len(ids), every], dtype="<u4").tobytes()
    own = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype="u1").tobytes()
    return head + own + np.array([len(a) for a in arrays], dtype="<u8").tobytes() + at[::every].astype("<u8").tobytes() + stream


def unpack_block(payload: bytes, table: np.ndarray, top: int) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    docs, n, every = np.frombuffer(payload, "<u4", 3).tolist()
    at = 12
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    null = np.frombuffer(payload, "u1", docs, at := at + 8 * docs)
    sizes = np.frombuffer(payload, "<u8", docs, at := at + docs)
    marks = np.frombuffer(payload, "<u8", -(-n // every), at := at + 8 * docs)
    ids = unpack_bits(payload[at + 8 * len(marks) :], marks, n, every, table, top)
    return [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], sizes, ids


def tokenized(docs: DataFrame, vocabulary: str | None = None, end_id: int | None = 2, text: str = "text") -> DataFrame:
    """doc_id, ids (binary, of u2 or u4 as the vocabulary needs)."""
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches):
        own = encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], own.kind).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() + end for x in own.encode(part.column(1).to_pylist())], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def counted(tokens: DataFrame, kind: str) -> DataFrame:
    """id, n over all documents; each partition sends one row for each id it has."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(k, 512).to_pylist()), kind))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Writes the files under spark.checkpoint.dir; gives back the blocks and the code, read from there."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    kind = encoder(vocabulary).kind.str
    tokens = staged(tokenized(docs, vocabulary, end_id))
    counts = counted(tokens, kind).toPandas()  # at most as many rows as the vocabulary has ids
    by_id = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.int64)
    by_id[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    bits = code_lengths(by_id)
    code = staged(spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id long, bits int"))

    def blocks(batches):
        from pyspark import TaskContext

        codes, part, number = canonical(bits), TaskContext.get().partitionId(), 0
        doc_ids, arrays, held = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array(doc_ids[:1], pa.int64()), pa.array([held], pa.int64()), pa.array([pack_block(doc_ids, arrays, codes, bits)], pa.large_binary()).cast(pa.binary())], names=["part", "block", "first_id", "n_ids", "payload"])

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), kind)
                if held and held + len(ids) > block_ids:
                    yield block()
                    number, doc_ids, arrays, held = number + 1, [], [], 0
                doc_ids.append(doc_id)
                arrays.append(ids)
                held += len(ids)
        if doc_ids:
            yield block()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    out = staged(ordered.mapInArrow(blocks, "part long, block long, first_id long, n_ids long, payload binary"))
    dropped(tokens)
    return out, code


def read(blocks: DataFrame, code: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (binary u4, null unless with_ids), from the files alone."""
    rows = code.toPandas()  # bounded by the vocabulary
    bits = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.uint8)
    bits[rows["id"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy()
    # starts: sums over partitions (a row each), then over the blocks of one
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = blocks.select("part", "block", inside.alias("inside")).join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))
    starts = sent(starts, BROADCAST_BLOCKS)  # so that payloads needn't be shuffled

    def decode(batches):
        table, top = decode_table(bits)
        for batch in batches:
            for payload, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                doc_ids, sizes, ids = unpack_block(payload.as_py(), table, top)
                ends = np.cumsum(sizes.astype(np.int64))
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - sizes.astype(np.int64)).tolist(), ends.tolist(), strict=True)]
                begin = start + ends - sizes.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.join(starts, ["part", "block"]).select("payload", "start").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, code = write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read(blocks, code, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
