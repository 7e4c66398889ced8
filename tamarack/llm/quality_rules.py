"""Quality rules: base counts, and a calibrated n-gram classifier against fixed thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import BLOCK_CHARS, Scratch, fit_in_task, free_names, labelled_texts, map_arrow, pieces, sample_labels, strings, up_to

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: What separates words: the characters at which bytes.split() splits.
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
#: Fixed thresholds of the rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_PROBABILITY = 0.5

#: Hash buckets of word and of character n-grams (a power of two each), and the orders.
BUCKET_BITS = 16
WORD_ORDERS = (1, 2)
CHAR_ORDERS = (2, 3, 4)
#: Weights are whole multiples of 1 / SCALE, so that sums do not depend on their order.
SCALE = 1 << 20

#: At most so many labelled rows are fitted on: those of the smallest hashes of their ids, as far as they have so many
#: different n-grams together (each counted in its row), which bounds the memory of the task that fits to about 300 MB.
TRAIN_ROWS = 2000
TRAIN_NGRAMS = 6_000_000

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_ODD64 = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def word_hashes(text: str, step: int = BLOCK_CHARS) -> np.ndarray:
    """A 64-bit hash of each word; of a long text, the words of one stretch at a time are held."""
    data, found, at = text.encode(), [], 0
    while at < len(data):
        stretch = data[at : at + step]
        if at + step < len(data):  # up to the last white space, unless a word is longer than the stretch
            kept = stretch[: max(map(stretch.rfind, SPACES)) + 1]
            while not kept and at + len(stretch) < len(data):
                stretch = data[at : at + 2 * len(stretch)]
                kept = stretch[: max(map(stretch.rfind, SPACES)) + 1] if at + len(stretch) < len(data) else stretch
            stretch = kept or stretch
        words = stretch.split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at += len(stretch)
    return found[0] if len(found) == 1 else np.concatenate([*found, np.zeros(0, np.uint64)])


def windows_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the windows of n consecutive word hashes."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + size]) * _ODD64[k % 3]
        out ^= out >> np.uint64(29)
    return out


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    windows = windows_hash(hashes, 3)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def base_counts(text: str, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode()
    lines = [x for x in data.split(b"\n") if x.strip()]
    spaces = sum(map(data.count, SPACES))
    return len(hashes), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(hashes)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([(windows_hash(hashes, n) * _ODD64[0]) >> shift for n in WORD_ORDERS]).astype(np.int64)


def char_buckets(text: str, step: int = BLOCK_CHARS) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams, for the n-grams that start in each stretch of ``step`` characters."""
    reach = max(CHAR_ORDERS) - 1
    for at in range(0, len(text), step):
        codes = np.frombuffer(text[at : at + step + reach].encode("utf-32-le"), "<u4")
        found = []
        for n in CHAR_ORDERS:
            size = max(0, min(step, len(codes) - n + 1))
            out = np.full(size, n, np.uint32)
            for k in range(n):
                out = (out ^ codes[k : k + size]) * _ODD[k]
                out ^= out >> np.uint32(15)
            found.append((out * _ODD[0]) >> np.uint32(32 - BUCKET_BITS))
        yield np.concatenate(found)


@dataclass
class Model:
    """z = bias + mean word weight + mean character weight; probability = sigmoid(slope * z + offset)."""

    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, words: np.ndarray, chars: Iterator[np.ndarray]) -> float:
        a = int(self.words[words].sum()) / SCALE / len(words) if len(words) else 0.0
        n = total = 0
        for stretch in chars:
            n, total = n + len(stretch), total + int(self.chars[stretch].sum())
        return self.bias + a + (total / SCALE / n if n else 0.0)

    def probability(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * raw + self.offset))))


def _gather(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Hash h of the id, label, and n-gram buckets with shares (n of them) of the sampled rows."""
    sample = sample_labels(labels, id_col, label_col, rows)
    joined = labelled_texts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, y, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):  # one row at a time
                text, parts, n = text.as_py() or "", [], 0
                for stretches in ((word_buckets(word_hashes(text)),), char_buckets(text)):
                    count = sum((np.bincount(b, minlength=1 << BUCKET_BITS) for b in stretches), np.zeros(1 << BUCKET_BITS, np.int64))
                    at = np.flatnonzero(count)
                    count, n = count[at], n + len(at)
                    parts += [at.astype("<u4").tobytes(), (count / max(1, count.sum())).astype("<f4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()], pa.int64()), pa.array([y.as_py()], pa.int32()), pa.array([n], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], names=["h", "y", "n", "wi", "wv", "ci", "cv"])

    return map_arrow(joined, run, "h long, y int, n long, wi binary, wv binary, ci binary, cv binary")


def _fit(table: pa.Table, rate: float = 0.2, steps: int = 120, ridge: float = 1e-5) -> Model | None:
    """Logistic regression by full-batch Adam; every fourth row calibrates slope and offset instead."""
    table = table.sort_by([("h", "ascending"), ("y", "ascending"), ("n", "ascending")])
    y, rows, size = table["y"].to_numpy().astype(np.float64), range(table.num_rows), 1 << BUCKET_BITS
    if len(set(y)) < 2:
        return None
    idx, val, ptr = [], [], [0]
    for k in rows:
        idx += [np.frombuffer(table["wi"][k].as_buffer(), "<u4").astype(np.int32), np.frombuffer(table["ci"][k].as_buffer(), "<u4").astype(np.int32) + np.int32(size)]
        val += [np.frombuffer(table[c][k].as_buffer(), "<f4") for c in ("wv", "cv")]
        ptr.append(ptr[-1] + len(idx[-1]) + len(idx[-2]))
    idx, val, ptr = np.concatenate(idx), np.concatenate(val).astype(np.float32), np.array(ptr)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(ptr))
    held = np.arange(len(rows)) % 4 == 3
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    used = ~held[row]
    idx_t, val_t, row_t = idx[used], val[used], row[used]
    share = y[~held].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * ~held / max(1, (~held).sum())
    w, bias = np.zeros(2 * size, np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row_t, w[idx_t] * val_t, len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        g = np.bincount(idx_t, val_t * err[row_t], 2 * size).astype(np.float32) + ridge * w / len(rows)
        gb = float(err.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * 5 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (math.sqrt(vb / b) + 1e-8)
    whole = np.round(w * SCALE).astype(np.int64)
    model = Model(whole[:size], whole[size:], float(bias))
    z = np.bincount(row, (whole / SCALE)[idx] * val, len(rows)) + bias
    on = held if held.any() else ~held
    model.slope, model.offset = _calibrate(z[on], y[on])
    return model


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton steps, with his smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, np.abs(z).max())
    x = np.stack([z / scale, np.ones_like(z)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-3 * beta), -3, 3)
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents with TRAIN_NGRAMS n-grams; None if they do not show both labels.

    The n-grams are written and fitted on in one task; the driver only gets the weights. Of ids that
    repeat, the smallest text is taken; null and empty texts have no n-gram; empty tables give None.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    grams = scratch.cut(_gather(docs, labels, id_col, text_col, label_col, rows), "n-grams")
    last = up_to(grams, TRAIN_NGRAMS)
    model = None if last is None else fit_in_task(grams.where(F.col("h") <= last), _fit)
    scratch.drop(grams)
    return model


#: What apply() adds to the documents' columns.
ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def apply(docs: DataFrame, model: Model | None, *, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (only ``columns``, if given) with the counts, the probability of good quality and the verdict.

    kept is false where the base rules fail, else probability >= LEAST_PROBABILITY; without a
    model (no labels, or one kind only) the base rules alone decide and probability is null.
    Null texts count as empty: no words, so base_failed. A very long text is scored whole, a
    stretch at a time. Repeated rows get equal verdicts; an empty table gives no row. An added name
    that exists gets an underscore.
    """
    columns = docs.columns if columns is None else columns
    kinds = [f.split()[1] for f in ADDED.split(", ")]
    names = free_names(columns, [f.split()[0] for f in ADDED.split(", ")])
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).cast("string").alias("\x01text"))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # of fixed size: two tables of 2 ** BUCKET_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in pieces(batches):
            texts, out = strings(batch.column(batch.num_columns - 1)), []
            for text in texts:
                hashes = word_hashes(text)
                counts = base_counts(text, hashes)
                failed = base_failed(counts[0], counts[4])
                p = fitted.probability(fitted.raw(word_buckets(hashes), char_buckets(text))) if fitted else None
                out.append((*counts, failed, p, not failed and (p is None or p >= LEAST_PROBABILITY)))
            arrays = [pa.array([r[k] for r in out], kind) for k, kind in enumerate([pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*columns, *names])

    from pyspark.sql.types import StructType

    schema = StructType([source.schema[k] for k in range(len(columns))] + StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))).fields)
    return map_arrow(source, run, schema)
