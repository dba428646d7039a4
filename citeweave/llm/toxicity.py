"""Toxicity by class-conditional Kneser-Ney models of words and of their stems.

Each class has counts of whole words, and of stems (a word's first STEM characters, so that compounds and inflections share evidence), from which Kneser-Ney's discount is taken, estimated from how many occur once and twice.
What the discounts take goes to one back-off distribution that both classes share: the continuation count, in how many different contexts (texts, of either class) a word or stem occurs. So rare expressions are judged alike in both classes.
A word's evidence is the difference of its toxic and ordinary log-likelihoods. A text's evidence, by words and by stems, is that difference, length-normalised, over the text, over its worst window
and over its most telling words; a logistic curve, fitted on labelled texts by counts that leave out the fold of the text, turns it into a score.

Counts cover every labelled text to learn from, in Spark tables that grow with the corpus: a word is one of as many 64-bit hashes as there are words. Up to BROADCAST_KEYS words and stems are sent to tasks, more are joined to chunks of texts.
The curve is fitted on at most ``max_curve_rows`` rows or a little more, drawn by a hash of doc_id.

Defined results: null and empty texts get the score of no evidence; several labels of one document count as toxic if any does; null labels and null doc_ids in labels aren't learned from;
without toxic or without ordinary labels to fit the curve on, all scores are near 1 or near 0; repeated rows are scored each on its own; other columns are no inputs, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, few, lowered, mixed, runs, sent, staged, text_slices, word_hashes

STEM = 4
#: Keys of what no text has: a word, a stem.
UNSEEN = (0, 1)
LEVELS = range(2)
WINDOW = 24
#: A difference of log-likelihoods from which a word counts as telling, and how many of the most telling ones are averaged.
TELLING, MOST = 2.0, 3
MEASURES = ("mean", "worst", "dense", "top", "share")
EVIDENCE = (*MEASURES, *(f"stem_{m}" for m in MEASURES))
MAX_CURVE_ROWS = 20_000
#: Parts of the counted rows; the curve sees each part by the counts of the others.
FOLDS = 4
EVERY = range(1 + FOLDS)
#: So many words and stems (12 bytes each, or 28 for the folds of the curve) are sent to every executor; of more, each chunk of texts gets its own by a join.
BROADCAST_KEYS = 1 << 21
#: Bytes of text that are joined to a model at a time.
_CHUNK = 1 << 22


def word_slices(column: pa.Array):
    """(first row, bytes, starts and ends of words, where each text's words start) for runs of rows. Words are runs of letters (lower-cased A-Z), digits and bytes from 128 on."""
    for row, data, starts in text_slices(column):
        low = lowered(data)
        first, stop, at = runs(((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128), starts)
        yield row, low, first, stop, at


def keys(low: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the key of the whole and that of its stem."""
    begins = np.flatnonzero((low & 0xC0) != 0x80)  # characters
    k = np.searchsorted(begins, first) + STEM
    cut = np.where(k < len(begins), begins[np.minimum(k, len(begins) - 1)], len(low)) if len(first) else first
    return word_hashes(low, first, stop).view(np.int64), mixed(word_hashes(low, first, np.minimum(stop, cut)), 21).view(np.int64)


def counted(rows: DataFrame) -> DataFrame:
    """level, key, n0, n1 (occurrences by class), texts (that have it) of rows (toxic, fold, text); arrays of 1 + FOLDS: in all rows, then in all but those of each fold."""

    def occurrences(batches):
        for batch in batches:
            group = np.array(batch.column(0).to_pylist(), np.int64) * FOLDS + np.array(batch.column(1).to_pylist(), np.int64)
            for row, low, first, stop, at in word_slices(batch.column(2)):
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                own = group[row + text]
                for level, key in enumerate(keys(low, first, stop)):
                    order = np.lexsort((text, key, own))
                    g, k, t = own[order], key[order], text[order]
                    fresh = np.flatnonzero(np.diff(k, prepend=~k[:1]) | np.diff(g, prepend=-1))
                    if len(fresh):
                        other = (np.diff(t, prepend=-1) != 0).astype(np.int64)
                        other[fresh] = 1
                        n, texts = np.diff(np.append(fresh, len(k))), np.add.reduceat(other, fresh)
                        numbers = (np.full(len(fresh), level), g[fresh] // FOLDS, g[fresh] % FOLDS)
                        yield pa.RecordBatch.from_arrays([pa.array(k[fresh]), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(n.astype(np.int64)), pa.array(texts)], names=["key", "level", "toxic", "fold", "n", "texts"])

    others = [F.lit(True), *(F.col("fold") != f for f in range(FOLDS))]
    total = lambda c, where: F.array(*[F.coalesce(F.sum(F.when(where & o, F.col(c))), F.lit(0)) for o in others])
    found = rows.select("toxic", "fold", "text").mapInArrow(occurrences, "key long, level int, toxic int, fold int, n long, texts long")
    return found.groupBy("level", "key").agg(*[total("n", F.col("toxic") == c).alias(f"n{c}") for c in (0, 1)], total("texts", F.lit(True)).alias("texts"))


def discounts(counts: DataFrame) -> dict:
    """By (level, class, variant) Kneser-Ney's discount n1 / (n1 + 2 n2), from how many words or stems occur once and twice."""
    cell = lambda c, k: F.struct(F.count_if(F.col(f"n{c}")[k] == 1).alias("one"), F.count_if(F.col(f"n{c}")[k] == 2).alias("two"))
    out = {(level, c, k): 0.5 for level in LEVELS for c in (0, 1) for k in EVERY}
    for row in counts.groupBy("level").agg(*[cell(c, k).alias(f"{c}{k}") for c in (0, 1) for k in EVERY]).collect():  # two rows
        for c in (0, 1):
            for k in EVERY:
                one, two = row[f"{c}{k}"]
                if one and two:
                    out[row["level"], c, k] = one / (one + 2 * two)
    return out


def differences(counts: DataFrame) -> DataFrame:
    """key, difference: toxic minus ordinary log-likelihood of every word and stem, and of those that no text has (UNSEEN); an array as in counted()."""
    held = discounts(counts)
    out = None
    for level in LEVELS:
        own = counts.where(F.col("level") == level)
        kept = lambda c, k: F.greatest(F.col(f"n{c}")[k] - held[level, c, k], F.lit(0.0))  # noqa: B023, E731
        cell = lambda k: F.struct(F.count_if(F.col("n0")[k] + F.col("n1")[k] > 0), F.sum(F.col("texts")[k]), *[f(c) for c in (0, 1) for f in (lambda c: F.sum(F.col(f"n{c}")[k]), lambda c: F.sum(kept(c, k)))])  # noqa: B023, E731
        sums = [[x or 0 for x in r] for r in own.agg(*[cell(k) for k in EVERY]).first()]

        def difference(k):
            kinds, texts, *by_class = sums[k]  # noqa: B023
            shared = (F.col("texts")[k] + 0.5) / (texts + 0.5 * (kinds + 1))
            log = []
            for c in (0, 1):
                total = max(by_class[2 * c], 1)
                log.append(F.log((kept(c, k) + (total - by_class[2 * c + 1]) * shared) / total))  # noqa: B023
            return (log[1] - log[0]).cast("float")

        none = counts.sparkSession.range(1).select(F.lit(UNSEEN[level]).cast("long").alias("key"), *[F.array(*[F.lit(0).cast("long")] * len(EVERY)).alias(n) for n in ("n0", "n1", "texts")])
        rows = own.select("key", "n0", "n1", "texts").unionByName(none).select("key", F.array(*map(difference, EVERY)).alias("difference"))
        out = rows if out is None else out.union(rows)
    return staged(out)


class Model:
    """Differences of some words and stems (rows as in counted()'s arrays), found by the key; the others are UNSEEN. Each text is measured by the row that its ``by`` names."""

    def __init__(self, key: np.ndarray, difference: np.ndarray):
        order = np.argsort(key)
        self.key, self.difference = key[order].astype(np.int64), difference[:, order].astype(np.float32)

    def words(self, low: np.ndarray, first: np.ndarray, stop: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The difference of each word, by the row that ``by`` names, as a whole and by its stem."""
        out = np.zeros((len(LEVELS), len(first)))
        for level, key in enumerate(keys(low, first, stop)):
            one, inverse = np.unique(key, return_inverse=True)
            k = np.minimum(np.searchsorted(self.key, one), len(self.key) - 1)
            k = np.where(self.key[k] == one, k, np.searchsorted(self.key, UNSEEN[level]))
            out[level] = self.difference[by, k[inverse]]
        return out

    def measures(self, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of MEASURES for each text, from its words' differences; zeros if it has no words."""
        out = np.zeros((len(at) - 1, len(MEASURES)))
        sums = np.concatenate([[0.0], np.cumsum(d)])
        telling = np.concatenate([[0], np.cumsum(d > TELLING)])
        for k in range(len(at) - 1):
            a, b = int(at[k]), int(at[k + 1])
            if n := b - a:
                w, most = min(WINDOW, n), min(MOST, n)
                worst = (sums[a + w : b + 1] - sums[a : b + 1 - w]).max() / w
                hits = telling[b] - telling[a]
                out[k] = (sums[b] - sums[a]) / n, worst, hits / np.sqrt(n), np.partition(d[a:b], n - most)[n - most :].mean(), hits / n
        return out

    def evidence(self, column: pa.Array, by: np.ndarray) -> np.ndarray:
        """A row of EVIDENCE for each text."""
        out = np.zeros((len(column), len(EVIDENCE)))
        for row, low, first, stop, at in word_slices(column):
            levels = self.words(low, first, stop, np.repeat(by[row : row + len(at) - 1], np.diff(at)))
            out[row : row + len(at) - 1] = np.concatenate([self.measures(d, at) for d in levels], axis=1)
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with an intercept (Newton's method), on centred and scaled columns; weights for the raw columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty @ w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
        move = np.linalg.solve(h, g)
        w = w - move / max(1.0, np.abs(move).max() / 3)
    raw = w[1:] / scale
    return np.concatenate([[w[0] - raw @ mean], raw])


def residue(doc_id, of: int = 3):
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def fold():
    """The fold of a row, from 0 on."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, learn, curve, max_curve_rows: int = MAX_CURVE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Model and curve. learn, curve: conditions on doc_id, for the rows that are counted and for those that the curve is fitted on. These are measured by the counts of the other folds, so a row may be both."""
    docs = docs.select("doc_id", "text")
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # labels that are few are sent to the texts, so that texts aren't shuffled
    to_learn = sent(marked.where(learn), BROADCAST_IDS)
    counts = staged(counted(docs.where(learn).join(to_learn, "doc_id").select("toxic", fold().alias("fold"), F.col("text").cast("string").alias("text"))))
    model = differences(counts)
    dropped(counts)
    ready = marked.where(curve)
    share = max_curve_rows / max(ready.count(), 1)
    if share < 1:
        ready = ready.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    once = docs.where(curve).join(F.broadcast(ready), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.col("text").cast("string")).alias("text"))  # one row an id, however often it occurs
    seen = evidence(once.select("doc_id", "text", "toxic", (fold() + 1).alias("by")), model, "toxic", "by").toPandas()  # max_curve_rows or a little more
    y = seen["toxic"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return model, np.array([-20.0 if not len(y) or y.max() == 0 else 20.0, *[0] * len(EVIDENCE)])
    return model, fit_curve(seen[list(EVIDENCE)].to_numpy(dtype=float), y)


def evidence(docs: DataFrame, model: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named in more, those of EVIDENCE, by the counts of all rows or those that a column ``by`` among more names (as in counted())."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    fields = [f for f in kept.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{e} double" for e in EVIDENCE)])
    names = [*(f.name for f in fields), *EVIDENCE]
    by = names.index("by") if "by" in more else None
    wanted = [F.col("difference")[k].alias(f"d{k}") for k in (EVERY if by is not None else range(1))]
    if not few(model, BROADCAST_KEYS):
        return _joined_evidence(kept, model.select("key", *wanted), schema, names)
    table = model.select("key", *wanted).toArrow()  # BROADCAST_KEYS rows at most
    own_model = docs.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), _rows(table)))

    def measure(batches):
        own = Model(*own_model.value)
        for batch in batches:
            rest = [c for k, c in enumerate(batch.columns) if k != 1]
            x = own.evidence(batch.column(1), np.zeros(batch.num_rows, np.int64) if by is None else rest[by].to_numpy())
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x[:, k]) for k in range(len(EVIDENCE)))], names=names)

    return kept.mapInArrow(measure, schema)


def _rows(table: pa.Table) -> np.ndarray:
    return np.stack([table[n].to_numpy() for n in table.column_names if re.fullmatch("d[0-9]+", n)])


def _joined_evidence(kept: DataFrame, model: DataFrame, schema: str, names: list[str]) -> DataFrame:
    """evidence() by joins: texts are dealt into chunks, each asks for every word and stem once, so one has as many rows as chunks however often it occurs, and gets a model of its own."""
    fields = names[: -len(EVIDENCE)]
    folds = "by" in names

    def chunks(batches):
        part, n, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            chunk = []
            for x in batch.column(1):
                length = len(x.as_buffer()) if x.is_valid else 0
                if size and size + length > _CHUNK:
                    n, size = n + 1, 0
                size += length + 64
                chunk.append(part << 32 | n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int64())], names=[*batch.schema.names, "chunk"])

    def asked(batches):
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                found = [np.unique(x) for _, low, first, stop, _ in word_slices(batch.column(1).slice(a, b - a)) for x in keys(low, first, stop)]
                key = reduce(np.union1d, found, np.array(UNSEEN, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk[a])), pa.array(key)], names=["chunk", "key"])

    def measure(left, right):
        own = Model(right["key"].to_numpy(), _rows(right))
        by = left["by"].to_numpy() if folds else np.zeros(left.num_rows, np.int64)
        x = own.evidence(left["text"], by) if left.num_rows else np.zeros((0, len(EVIDENCE)))
        return pa.table([*(left[n] for n in fields), *(pa.array(x[:, k]) for k in range(len(EVIDENCE)))], names=names)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    rows = staged(kept.mapInArrow(chunks, f"{own}, chunk long"))
    wanted = rows.select("chunk", "text").mapInArrow(asked, "chunk long, key long").distinct()
    answers = wanted.join(model, "key").select("chunk", *model.columns)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(measure, schema)


def scored(docs: DataFrame, model: DataFrame, curve: np.ndarray) -> DataFrame:
    """doc_id, score from 0 to 1."""
    x = F.lit(float(curve[0]))
    for name, weight in zip(EVIDENCE, curve[1:], strict=True):
        x = x + F.col(name) * float(weight)
    return evidence(docs, model).select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    known = residue(F.col("doc_id")) != 1
    model, curve = fit(docs, labels, known, known)
    held = (residue(F.col("doc_id")) == 1).alias("held_out")
    return scored(docs, model, curve).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
