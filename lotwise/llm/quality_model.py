"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (counts of character classes and words,
then a learned layer); learned gated attention weights, softmax(w . (tanh(V h) * sigmoid(U h))), say how much each
passage counts, and the weighted passage representation gives the score. Only document labels are learned from. The
model is fitted with numpy on a bounded sample: FIT_DOCS labelled documents, of each up to FIT_PASSAGES passages dealt
evenly over its whole text. Every passage of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import BATCH_ROWS, batches_of, column, shape, table, texts

PASSAGE, FIT_DOCS, FIT_PASSAGES, FOLDS, THRESHOLD = 64, 4000, 256, 5, 0.3
HIDDEN, ATTENTION = 16, 8
CLASSES = ("\n", "\t\x0b\x0c\r ", "#*$%&|<>", "!", ".", ",;:?", "\"'()[]{}", "-_/\\=+@~^`")


def _classes() -> np.ndarray:
    """byte -> class: those of CLASSES, then digits, capitals, small letters, other ASCII, first and later bytes of
    other characters."""
    n = len(CLASSES)
    out = np.full(256, n + 3, np.int64)
    for i, chars in enumerate(CLASSES):
        out[list(chars.encode())] = i
    out[48:58], out[65:91], out[97:123], out[128:192], out[192:] = n, n + 1, n + 2, n + 5, n + 4
    return out


CLASS_OF = _classes()
N_CLASSES = int(CLASS_OF.max()) + 1
N_FEATURES = N_CLASSES + 7


def features(text: str) -> np.ndarray:
    """One row for each passage of the text (one for a text without words)."""
    data = text.encode()
    words = data.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    raw = np.frombuffer(data, np.uint8)
    kinds = CLASS_OF[raw]
    blank = kinds < 2
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    n = -(-len(words) // PASSAGE)
    of_word = np.arange(len(words)) // PASSAGE
    starts = begins[::PASSAGE].copy()
    starts[0] = 0
    lengths = np.diff(np.append(starts, len(raw)))
    of_byte = np.repeat(np.arange(n) * N_CLASSES, lengths)
    counts = np.bincount(of_byte + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = np.fromiter(map(len, words), np.int64, len(words))
    key = np.fromiter(map(hash, words), np.int64, len(words))
    in_passage = np.bincount(of_word, minlength=n)
    order = np.lexsort((key, of_word))
    new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])))
    distinct = np.bincount(of_word[order][new], minlength=n)
    again = np.bincount(of_word[1:][key[1:] == key[:-1]], minlength=n)
    mean = np.bincount(of_word, size, n) / in_passage
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, size.astype(float) ** 2, n) / in_passage - mean**2))
    more = (np.log1p(in_passage), distinct / in_passage, again / in_passage, mean / 10, spread / 10, np.bincount(of_word, size > 20, n) / in_passage, np.full(n, 1.0))
    return np.column_stack((np.sqrt(counts / lengths[:, None]), *more)).astype(np.float32)


def spread(passages: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    """All passages, or ``most`` of them at even distances."""
    return passages if len(passages) <= most else passages[np.linspace(0, len(passages) - 1, most).astype(int)]


class Model(NamedTuple):
    """Standardization of the features and the weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(f: np.ndarray, starts: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All that is computed for bags whose passages begin at ``starts``."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
    h = np.tanh(f @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    e = (t * s) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "p": sigmoid(z @ w["c"] + w["d"])}


def gradients(f: np.ndarray, starts: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray], decay: float) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy with weight decay."""
    x = forward(f, starts, w)
    h, t, s, a, bag = (x[k] for k in ("h", "t", "s", "a", "bag"))
    miss = (x["p"] - y) / len(y)
    to = (miss[:, None] * w["c"])[bag]
    da = (h * to).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    gate = de[:, None] * w["w"]
    dt, ds = gate * s * (1 - t**2), gate * t * s * (1 - s)
    back = (a[:, None] * to + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    out = {"W": f.T @ back, "b": back.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": x["z"].T @ miss, "d": miss.sum()}
    return {k: v + decay * w[k] for k, v in out.items()}


def train(bags: list[np.ndarray], y: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam over whole batches."""
    f = np.concatenate(bags).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    mean, scale = f.mean(0), f.std(0) + 1e-3
    f = (f - mean) / scale
    rng = np.random.default_rng(seed)
    shape = {"W": (N_FEATURES, HIDDEN), "b": HIDDEN, "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": ATTENTION, "c": HIDDEN}
    w = {k: rng.normal(0, 0.3, n) for k, n in shape.items()} | {"d": np.array(0.0)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        for k, g in gradients(f, starts, y, w, decay).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
    return Model(mean, scale, w)


def scores(model: Model, bags: list[np.ndarray]) -> np.ndarray:
    if not bags:
        return np.empty(0)
    f = (np.concatenate(bags) - model.mean) / model.scale
    return forward(f, np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])), model.weights)["p"]


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS (0: held out); a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(column(id_col).cast("string")), F.lit(FOLDS)), F.lit(0).cast("bigint"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = FIT_DOCS) -> Model:
    """A model of the labelled documents that are not held out: all of them, or ``most``, taken by a hash of the id.

    Rows of ``labels`` with a null id or label are left out, as are labels without a document; a document that is
    labelled twice, or stands in ``docs`` twice, counts twice. At most ``most`` rows of at most FIT_PASSAGES passages
    reach the driver, however often ids repeat. Without any labelled document the model scores everything alike.
    """
    known = labels.filter(column(label_col).isNotNull() & column(id_col).isNotNull() & (fold(id_col) != 0))
    order = [F.xxhash64(F.lit("fit"), column(id_col)), column(id_col), column(label_col)]
    chosen = known.orderBy(*order).limit(most).select(column(id_col).alias("__id"), column(label_col).cast("double").alias("__y"))
    rows = docs.select(column(id_col).alias("__id"), column(text_col).alias("text")).join(F.broadcast(chosen), "__id")  # ``most`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [spread(features(t)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__y"), pa.array([x.tobytes() for x in f], pa.binary())], names=["id", "y", "f"])

    made = rows.mapInArrow(run, shape(("id", docs.schema[id_col].dataType), ("y", "double"), ("f", "binary")))
    one = made.orderBy(F.xxhash64(F.lit("fit"), "id"), "id", "y", F.xxhash64("f")).limit(most)
    sample = sorted((r["id"], r["y"], bytes(r["f"])) for r in one.collect())
    if not sample:
        sample = [(0, 1.0, features("").tobytes())]
    return train([np.frombuffer(f, np.float32).reshape(-1, N_FEATURES) for _, _, f in sample], np.array([y for _, y, _ in sample]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, score, *keep) for every row. Only the text is looked at; a null text is empty and gets the score of an
    empty text. Null and repeated ids stay. No rows: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, BATCH_ROWS):
                p = scores(model, [features(t) for t in texts(batch, "__text")])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), *batch.columns[2:]], names=["doc", "score", *(f"__{i}" for i in range(len(keep)))])

    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("__text"), *(column(c).alias(f"__{i}") for i, c in enumerate(keep)))
    out = rows.mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("score", "double"), *((f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep))))
    return out.select("doc", "score", *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("doc").alias("doc_id"), (fold("doc") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
