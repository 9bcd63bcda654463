"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (``PASSAGE`` bytes of its UTF-8 text each, the whole text).  Every
passage is encoded: square roots of its shares of character-class pairs (letters by case, digits,
spaces, lines, kinds of punctuation, bytes of other scripts) and of words that repeat one of the two
words before them, then one learned tanh layer ``h``.  Gated
attention weighs the passages, ``a = softmax(w . (tanh(V h) * sigmoid(U h)))``, and the document's score
is the logistic score of the weighted representation ``sum a h``.  Only document labels are used.

Fitting takes a bounded sample of whole documents, all passages of each: at most ``SAMPLE_DOCS`` different
labelled texts with at most ``SAMPLE_BYTES`` in all.  Scoring reads every passage of every text in one
column function (no shuffle); the model is a few thousand numbers.  Passages are told apart by the shapes of
their characters and by repetition, not by their words: the model knows junk, lists and broken text from prose,
not good prose from bad.

Defined results: null or empty text is one empty passage and gets a score like any other; without
usable labels, or with labels of one kind only, every score is that share of good labels (0.5 without
any); an empty table gives an empty result; rows are scored one by one, repeated rows alike; texts of any length
are scored whole; other columns, however called, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_bytes
from .labelled import labelled_rows

PASSAGE = 512
SAMPLE_DOCS = 8000
SAMPLE_BYTES = 16 << 20
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE = 12, 64, 0.01
MIN_STEPS = 1200
CLASSES = 16
FEATURES = CLASSES * CLASSES + 2


def _byte_classes() -> np.ndarray:
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!?",
              "|", "#$%&*+<>=@^~\\`{}[]", "\"'()", "-_/", ":;"]
    table = np.full(256, 13, np.uint8)
    for i, chars in enumerate(groups):
        table[[ord(c) for c in chars]] = i
    table[0x80:0xC0] = 14
    table[0xC0:] = 15
    return table


_CLASS = _byte_classes()


def encode_passages(text: bytes) -> np.ndarray:
    """One row per passage: square roots of the shares of neighbouring character classes, and of words
    equal to the word one and two before (a word belongs to the passage of its share of the words)."""
    classes = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int64)
    if len(classes) < 2:
        return np.zeros((1, FEATURES), np.float32)
    pairs = classes[:-1] * CLASSES + classes[1:]
    passage = np.arange(len(pairs)) // PASSAGE
    n, width = int(passage[-1]) + 1, CLASSES * CLASSES
    counts = np.bincount(passage * width + pairs, minlength=n * width).reshape(n, -1)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :width] = counts / counts.sum(axis=1, keepdims=True)
    words = text.lower().split()
    home = np.arange(len(words)) * n // max(1, len(words))
    per_passage = np.maximum(1, np.bincount(home, minlength=n))
    for lag in (1, 2):
        same = np.fromiter(map(eq, words[lag:], words), bool, max(0, len(words) - lag))
        out[:, width + lag - 1] = np.bincount(home[lag:][same], minlength=n) / per_passage
    return np.sqrt(out)


@dataclass
class GatedAttention:
    """The fitted model; ``params`` is None when there was nothing to tell apart (``share`` is the score)."""

    share: float
    params: dict[str, np.ndarray] | None = None

    def bags(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of bags of consecutive rows that begin at ``starts``, and what gradients need."""
        p = self.params
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        energy = (t * s) @ p["w"]
        counts = np.diff(np.append(starts, len(x)))
        e = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return z @ p["c"] + p["c0"], {"h": h, "t": t, "s": s, "a": a, "z": z, "counts": counts}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        logit, f = self.bags(x, starts)
        error = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = np.repeat(error[:, None] * p["c"], f["counts"], axis=0)
        da = (dz * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, starts), f["counts"])
        de = f["a"] * (da - mean)
        gate = de[:, None] * p["w"]
        dt = gate * f["s"] * (1 - f["t"] ** 2)
        ds = gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
                "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ error, "c0": np.array([error.sum()])}

    def score(self, text: bytes) -> float:
        if self.params is None:
            return self.share
        logit = self.bags(encode_passages(text), np.array([0]))[0]
        return float(1 / (1 + np.exp(-logit[0])))


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> GatedAttention:
    """Adam on the document log loss, with batches of whole bags."""
    if not len(y) or y.min() == y.max():
        return GatedAttention(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)

    def start(*shape):
        return rng.normal(0, shape[0] ** -0.5, shape)

    model = GatedAttention(float(y.mean()), {
        "W": start(FEATURES, HIDDEN) * 4, "b": np.zeros(HIDDEN), "V": start(HIDDEN, ATTENTION), "U": start(HIDDEN, ATTENTION),
        "w": start(ATTENTION), "c": start(HIDDEN), "c0": np.zeros(1)})
    first = {k: np.zeros_like(v) for k, v in model.params.items()}
    second = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = 0
    for _ in range(max(EPOCHS, MIN_STEPS * BATCH // len(y))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            picked = order[at:at + BATCH]
            chosen = [bags[i] for i in picked]
            starts = np.cumsum([0] + [len(b) for b in chosen[:-1]])
            step += 1
            for k, g in model.gradients(np.concatenate(chosen).astype(np.float64), starts, y[picked]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _training_bag(text: Column) -> Column:
    @F.pandas_udf("binary")
    def bag(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_passages(t).astype(np.float16).tobytes() for t in texts])

    return bag(text_bytes(text))


def train_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "quality",
                  id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
                  sample_bytes: int = SAMPLE_BYTES) -> GatedAttention:
    """Fit on at most ``sample_docs`` labelled texts of at most ``sample_bytes`` together (a passage is about as
    many bytes as its features, so this bounds what the driver holds); ``learn_from`` is a condition on doc_id."""
    text_batches(docs.sparkSession)
    sample = labelled_rows(docs, labels, label_col, learn_from, sample_docs, sample_bytes, id_col, text_col)
    sample = sample.select("doc_id", "label", _training_bag(F.col("text")).alias("bag"))
    rows = sorted(((str(r["doc_id"]), bytes(r["bag"]), r["label"]) for r in sample.collect()), key=lambda r: r[:2])
    bags = [np.frombuffer(bag, np.float16).reshape(-1, FEATURES) for _, bag, _ in rows]
    return fit(bags, np.array([label for *_, label in rows]))


def quality_score(text: Column, model: GatedAttention) -> Column:
    """Probability (0 to 1) that the text is labelled good, from all its passages."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return score(text_bytes(text))


def keep_good(docs: DataFrame, model: GatedAttention, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input rows that score ``threshold`` or more, columns as they came."""
    text_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         quality_score(F.col(f"`{text_col}`"), model).alias("quality_score"))
    return packed.where(F.col("quality_score") >= threshold).select("row.*")
