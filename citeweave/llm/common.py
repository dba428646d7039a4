"""What the operators of this subpackage share: staging tables and views of text as bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import dropped, few, sent, staged, work_dir

__all__ = ["BROADCAST_IDS", "WORD_GAP", "WORD_GAP_CHARS", "dropped", "few", "groups", "lowered", "mixed", "narrowed", "prefix_hashes", "range_hashes", "runs", "sent", "staged", "text_slices", "word_bounds", "word_hashes", "words", "work_dir"]

#: ``[^\x20\x09-\x0D]+`` is a word; this is what lies between words, for Java's regexes.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: The same six characters, for translate().
WORD_GAP_CHARS = " \t\n\x0b\f\r"


#: So many ids (some 20 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1 << 18


def narrowed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among ids. Few ids are broadcast, so that the rows that go aren't shuffled first; ids should be cheap to count."""
    return df.join(sent(ids, BROADCAST_IDS), key, "left_semi")


def words(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def groups(batches, keys: tuple[str, ...]):
    """Columns (as lists) of the rows of one key after another; rows come sorted by keys, and batches may cut a group."""
    last, held = None, {}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        key = list(zip(*(columns[k] for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)] if key else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if key[a] != last:
                if held:
                    yield held
                last, held = key[a], {n: [] for n in columns}
            for n, values in columns.items():
                held[n] += values[a:b]
    if held:
        yield held


def text_slices(column: pa.Array, most: int = 1 << 21):
    """(first row, UTF-8 bytes, starts) of runs of rows, each of some ``most`` bytes or a single row; null counts as empty.

    starts has one entry more than the run has rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


#: Words of more bytes are hashed one by one.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[first:stop], eight bytes a round, each round a bijective mix of what came before with them: no pattern of bytes collides by construction."""
    size = (stop - first).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mixed(size.astype(np.uint64), 11)
    long = size > _LONG_WORD
    for k in np.flatnonzero(long).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[first[k] : stop[k]], digest_size=8).digest(), "little")
    live, at = np.flatnonzero(~long & (size > 0)), 0
    while len(live):
        left = size[live] - at
        chunk = eight[first[live] + at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        out[live] = mixed(out[live] ^ chunk, 12)
        live, at = live[left > 8], at + 8
    return out


#: A random-looking number for each byte, and an odd base with its inverse for hashes of ranges of bytes.
_BYTE = mixed(np.arange(256, dtype=np.uint64), 7)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, kind: str) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base % 2**64, dtype=np.uint64)
        have[0] = 1
        _POWERS[kind] = have = np.multiply.accumulate(have)
        if size > 1 << 23:
            del _POWERS[kind]
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] standing for data[i:j], up to a power of the base (see range_hashes)."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data), "base"), out=out[1:], dtype=np.uint64)
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop]; equal bytes give equal hashes anywhere."""
    inverse = _powers(_INVERSE, len(prefix), "inverse")
    return mixed((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64))


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each run of bytes inside, none across texts, and how many runs lie before each text that starts has."""
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edge = starts[1:-1]  # a text ends a run though no byte does
    edge = edge[(edge > 0) & (edge < len(inside))]
    both = edge[inside[edge] & inside[edge - 1]]
    opens[both] = True
    closes[both - 1] = True
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) + 1, np.searchsorted(first, starts)


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """runs() of words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~((data == 32) | ((data >= 9) & (data <= 13))), starts)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
