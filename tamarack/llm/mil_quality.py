"""Document quality by attention over passages (gated multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamarack.llm.common import Scratch, fit_in_task, free_names, labelled_texts, map_arrow, sample_labels, strings, up_to

#: Code points of a passage, and how many passages are encoded at once.
PASSAGE = 512
PASSAGES_AT_ONCE = 2048
#: Hash buckets of character trigrams; trigrams of CLASSES character classes are counted exactly.
BUCKETS = 256
CLASSES = 8
INPUTS = CLASSES**3 + BUCKETS + 5
#: A trigram found again within so many characters counts as an echo.
ECHO = 24
HIDDEN, GATE = 32, 16

#: At most so many labelled rows are fitted on: those of the smallest hashes of their ids.
TRAIN_ROWS = 2000
#: They have at most so many passages together, and texts of more than MOST_PASSAGES are not fitted on (they are scored whole).
TRAIN_PASSAGES, MOST_PASSAGES = 60_000, 2_000
FOLDS = 5
POSITIVE_FROM = 0.3


def _class_table() -> np.ndarray:
    """Class of each code point below 256: other letters 0, lower, upper, digit, space, line end, mark, symbol."""
    table = np.zeros(256, np.uint8)
    for k in range(256):
        c = chr(k)
        table[k] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 if c in ".,;:!?'\"()-" else 7 if not c.isalpha() else 0
    return table


_TABLE = _class_table()


def passages(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the whole text in rows of PASSAGE, and each row's length; an empty text is one empty passage."""
    step = PASSAGE * PASSAGES_AT_ONCE
    for at in range(0, max(1, len(text)), step):
        codes = np.frombuffer(text[at : at + step].encode("utf-32-le"), "<u4")
        rows = max(1, -(-len(codes) // PASSAGE))
        block = np.zeros((rows, PASSAGE), np.uint32)
        block.ravel()[: len(codes)] = codes
        length = np.full(rows, PASSAGE)
        length[-1] = len(codes) - (rows - 1) * PASSAGE
        yield block, length


def features(block: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Square roots of the shares of class trigrams and hashed trigrams, the share of echoes and four shape figures, by passage."""
    rows = len(block)
    classes = np.where(block < 256, _TABLE[np.minimum(block, 255)], np.where(block > 0xFFFF, 7, 0)).astype(np.int64)
    a, b, c = block[:, :-2], block[:, 1:-1], block[:, 2:]
    valid = np.arange(PASSAGE - 2) < (length - 2)[:, None]
    kind = (classes[:, :-2] * CLASSES + classes[:, 1:-1]) * CLASSES + classes[:, 2:]
    mixed = (((a * np.uint32(0x9E3779B1)) ^ b) * np.uint32(0x85EBCA77) ^ c) * np.uint32(0xC2B2AE3D)
    hashed = mixed >> np.uint32(24)
    echo = np.zeros(mixed.shape, bool)
    for lag in range(2, ECHO + 1):
        echo[:, lag:] |= mixed[:, lag:] == mixed[:, :-lag]
    row = np.arange(rows)[:, None]
    counts = []
    for at, size in ((kind, CLASSES**3), (hashed.astype(np.int64), BUCKETS)):
        counts.append(np.bincount((at + row * size)[valid], minlength=rows * size).reshape(rows, size))
    total = np.maximum(length - 2, 1)[:, None]
    shares = [(n / total).astype(np.float32) for n in counts]
    shape = np.stack([(shares[1] ** 2).sum(1) * 10, shares[1].max(1) * 4, (counts[1] > 0).mean(1), np.log1p(length) / 8, 2 * (echo & valid).sum(1) / total[:, 0]], 1).astype(np.float32)
    return np.concatenate([np.sqrt(shares[0]), np.sqrt(shares[1]), shape], 1)


@dataclass
class Model:
    """h = tanh(x W + b); a = softmax(g . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum(a h) + d)."""

    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        gate = np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))
        return h, gate @ w["g"]

    def score(self, text: str) -> tuple[float, int, float]:
        """Score, number of passages, and the largest attention weight; keeps HIDDEN + 1 numbers a passage."""
        parts = [self.encode(features(*p)) for p in passages(text)]
        h, logit = (np.concatenate(x) for x in zip(*parts, strict=True))
        attention = np.exp(logit - logit.max())
        attention /= attention.sum()
        z = float((attention @ h) @ self.weights["c"] + self.weights["d"][0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), len(h), float(attention.max())


def fold(row_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out. Null ids are in fold 0: they have no label."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, epochs: int = 12, seed: int = 7) -> Model | None:
    """Fit on at most ``rows`` labelled documents outside fold 0, with TRAIN_PASSAGES passages; None if they do not show both labels.

    The passages are written and fitted on in one task; the driver only gets the weights. Of ids that
    repeat, the smallest text is taken; null and empty texts are one empty passage; empty tables give None.
    """
    sample = sample_labels(labels.where(fold(F.col(id_col)) != 0), id_col, label_col, rows)
    joined = labelled_texts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, y, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):  # one row at a time
                text = text.as_py() or ""
                if len(text) > PASSAGE * MOST_PASSAGES:
                    continue
                bag = np.concatenate([features(*p) for p in passages(text)]).astype("<f2")
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()], pa.int64()), pa.array([y.as_py()], pa.int32()), pa.array([len(bag)], pa.int64()), pa.array([bag.tobytes()], pa.binary())], names=["h", "y", "n", "bag"])

    def fit(table: pa.Table) -> Model | None:
        table = table.sort_by([("h", "ascending"), ("y", "ascending"), ("n", "ascending")])
        y = table["y"].to_numpy().astype(np.float32)
        return _fit([np.frombuffer(x.as_buffer(), "<f2").reshape(-1, INPUTS) for x in table["bag"]], y, epochs, seed) if len(set(y)) > 1 else None

    scratch = Scratch(docs.sparkSession, "mil-quality")
    bags = scratch.cut(map_arrow(joined, run, "h long, y int, n long, bag binary"), "passages")
    last = up_to(bags, TRAIN_PASSAGES)
    model = None if last is None else fit_in_task(bags.where(F.col("h") <= last), fit)
    scratch.drop(bags)
    return model


def _fit(bags: list[np.ndarray], y: np.ndarray, epochs: int, seed: int, rate: float = 3e-3, size: int = 32) -> Model:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {"W": normal(INPUTS, HIDDEN, scale=0.3), "b": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, GATE, scale=0.2), "U": normal(HIDDEN, GATE, scale=0.2), "g": normal(GATE, scale=0.2), "c": normal(HIDDEN, scale=0.2), "d": np.zeros(1, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            grads = _gradients(w, [bags[k] for k in chosen], y[chosen])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) - rate * 1e-3 * w[k]
    return Model(w)


def _gradients(w: dict, bags: list[np.ndarray], y: np.ndarray) -> dict:
    """Of the mean cross entropy of a batch of bags."""
    x = np.concatenate(bags).astype(np.float32)
    starts = np.cumsum([0, *map(len, bags)])[:-1]
    bag = np.repeat(np.arange(len(bags)), list(map(len, bags)))
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    gated = t * s
    logit = gated @ w["g"]
    a = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    pooled = np.add.reduceat(a[:, None] * h, starts)
    z = pooled @ w["c"] + w["d"][0]
    dz = (1 / (1 + np.exp(-z)) - y) / len(bags)
    dpool = dz[:, None] * w["c"]
    da = (h * dpool[bag]).sum(1)
    dlogit = a * (da - np.add.reduceat(a * da, starts)[bag])
    dgated = dlogit[:, None] * w["g"]
    dt, ds = dgated * s * (1 - t * t), dgated * t * s * (1 - s)
    dh = a[:, None] * dpool[bag] + dt @ w["V"].T + ds @ w["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ ds, "g": gated.T @ dlogit, "c": pooled.T @ dz, "d": dz.sum(keepdims=True)}


#: What apply() adds to the documents' columns.
ADDED = "held_out boolean, score double, predicted int, passages long, top_attention double"


def apply(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (only ``columns``, if given) with fold, score, prediction and attention.

    score (0 to 1) is that label 1 is likelier; predicted is 1 from POSITIVE_FROM. Null and
    empty texts are one empty passage and get its score. Without a model every score is 0.5.
    Every passage of a very long text counts. Repeated rows get equal scores; the id is only used
    for held_out; an empty table gives no row. An added name that exists gets an underscore.
    """
    columns = docs.columns if columns is None else columns
    kinds = [f.split()[1] for f in ADDED.split(", ")]
    names = free_names(columns, [f.split()[0] for f in ADDED.split(", ")])
    source = docs.select(*[F.col(f"`{c}`") for c in columns], (fold(F.col(id_col)) == 0).alias("\x01held"), F.col(text_col).cast("string").alias("\x01text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: INPUTS x HIDDEN weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            out = [fitted.score(t) if fitted else (0.5, 0, 0.0) for t in strings(batch.column(batch.num_columns - 1))]
            scores = [float(r[0]) for r in out]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(x >= POSITIVE_FROM) for x in scores], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())],
                names=[*columns, *names],
            )

    schema = StructType([source.schema[k] for k in range(len(columns))] + StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))).fields)
    return map_arrow(source, run, schema)
