"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. *Lexicons* are learned from a bounded sample of labelled documents: words and word beginnings (4 to
   6 characters, which carries a root over to endings never seen) that occur in several toxic documents
   and nearly never elsewhere.  Counting is one Spark aggregation; a lexicon keeps its ``LEXICON`` best
   units, a size fit to broadcast.
2. *Features* per document (``FEATURES``), one column function over the whole text: lexicon hits and
   densities (words, beginnings, and words after undoing look-alike characters), nearness of hits to
   second-person words, capitals, punctuation, and rates of obfuscated words.
3. *Trees*: Spark ML's gradient-boosted classifier on part of the sample; *calibration*: isotonic
   regression of the labels on the trees' score over the other part, so that scores are probabilities.

Defined results: null or empty text has all-zero features and gets the score of such texts; without
labels of both kinds the score is the share of toxic labels (0.0 without any); rows are scored one by
one, repeated rows alike; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_remainder, text_batches, text_bytes
from .labelled import labelled_sample

SAMPLE_DOCS = 16000
LEXICON = 2000
MIN_TOXIC_DOCS = 4
#: A unit's share among toxic documents over its (smoothed) share among the others, at least.
MIN_RATIO = 8.0
TREES, DEPTH = 20, 4
NEAR = 5
#: Tokens a worker remembers before it starts anew.
MEMORY_TOKENS = 400_000
BEGINNINGS = (4, 5, 6)

#: Second-person words, and look-alike characters with the letters they stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur thou thee tu te ti tus usted vous toi ton ta tes votre vos du dich dir dein deine ihr euch sie ihnen".split())
LOOK_ALIKE = str.maketrans("013457@$!|+", "oieastasilt")

FEATURES = ("word_hits", "word_density", "stem_hits", "stem_density", "plain_hits", "plain_density", "best_weight",
            "mean_weight", "near_you", "you_rate", "capital_rate", "capital_words", "mark_rate", "punctuation_rate",
            "mixed_rate", "gap_rate", "long_run_rate", "log_words")

_SPLIT = re.compile(r"[^\w]+|_+")
_MIXED = re.compile(r"(?=\w*[^\W\d])(?=.*[0-9@$!|+*])[\w@$!|+*'.\-]+$")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")


def units_of(text: str) -> set[str]:
    """Words ("w:") and beginnings ("4:", "5:", "6:") of a text."""
    words = {w for w in _SPLIT.split(text.lower()) if w}
    return {f"w:{w}" for w in words} | {f"{n}:{w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def stem_weight(self, word: str) -> float:
        return max((self.stems.get(word[:n], 0.0) for n in BEGINNINGS if len(word) > n), default=0.0)


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> Lexicon:
    """The ``size`` best units by log ratio of document shares, from (doc_id, text, label)."""

    @F.pandas_udf("array<string>")
    def units(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(units_of(t or "")) for t in texts])

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)
    if not toxic or not clean:
        return Lexicon({}, {})
    least = min(MIN_TOXIC_DOCS, max(2, toxic // 20))
    counted = (sample.select("label", F.explode(units(F.col("text"))).alias("unit")).groupBy("unit")
               .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(F.col("t") >= least))
    ratio = (F.col("t") / toxic) / ((F.col("c") + 0.5) / clean)
    best = (counted.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
            .orderBy(F.desc(F.col("t") * F.log("ratio")), "unit").limit(size).collect())
    words = {r["unit"][2:]: float(np.log(r["ratio"])) for r in best if r["unit"][0] == "w"}
    stems = {r["unit"][2:]: float(np.log(r["ratio"])) for r in best if r["unit"][0] != "w"}
    return Lexicon(words, stems)


#: What is known of one blank-separated token; tokens that are one plain word share row 0.
_INFO = ("words", "word_hit", "stem_hit", "plain_hit", "weight", "weight_sum", "you", "shouted", "mixed", "gap", "long_run")


class _Tokens(dict):
    """Token -> row of ``rows`` (as in _INFO); remembers a task's tokens, texts repeat them a lot."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.rows = [[1.0] + [0.0] * (len(_INFO) - 1)]

    def __missing__(self, token: str) -> int:
        row = self.describe(token)
        code = 0
        if row != self.rows[0]:
            code = len(self.rows)
            self.rows.append(row)
        self[token] = code
        return code

    def describe(self, token: str) -> list[float]:
        known = self.lexicon.words
        lowered = token.lower()
        words = [lowered] if lowered.isalpha() else [w for w in _SPLIT.split(lowered) if w]
        weights, word_hit, stem_hit, plain = [], 0, 0, 0
        for w in words:
            weight = known.get(w, 0.0)
            word_hit += weight > 0
            if not weight and (weight := self.lexicon.stem_weight(w)):
                stem_hit += 1
            if weight:
                weights.append(weight)
        core = lowered.strip(".,;:!?\"'()")
        mixed = gap = False
        if not core.isalpha():
            mixed = bool(_MIXED.match(core))
            if mixed:
                plain = re.sub(r"[*.\-]", "", core.translate(LOOK_ALIKE)) in known
            else:
                parts = re.split(r"[-.*]", core)
                gap = len(parts) > 2 and all(len(x) == 1 for x in parts)
                plain = len(parts) > 1 and "".join(parts) in known
        return [float(len(words)), float(word_hit), float(stem_hit), float(plain), max(weights, default=0.0), float(sum(weights)),
                float(any(w in SECOND_PERSON for w in words)), float(len(core) > 2 and token.isupper()), float(mixed),
                float(gap), float(bool(_LONG_RUN.search(lowered)))]


_MARKS = np.zeros(256, np.uint8)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_MARKS[[ord("!"), ord("?")]] = 2
_MARKS[ord("A"):ord("Z") + 1] = 3


def features_of(text: bytes, tokens: _Tokens) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    split = text.decode("utf-8", "replace").split()
    codes = np.fromiter(map(tokens.__getitem__, split), np.int64, len(split))
    odd = np.flatnonzero(codes)
    info = np.array([tokens.rows[c] for c in codes[odd]]).reshape(len(odd), len(_INFO))
    of = {name: info[:, i] for i, name in enumerate(_INFO)}
    n = max(1.0, len(split) - len(odd) + of["words"].sum())
    hits, you = odd[of["weight"] > 0], odd[of["you"] > 0]
    near = 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        after, before = you[np.minimum(at, len(you) - 1)], you[np.maximum(at - 1, 0)]
        near = int(((np.abs(after - hits) <= NEAR) | (np.abs(before - hits) <= NEAR)).sum())
    kinds = np.bincount(_MARKS[np.frombuffer(text, np.uint8)], minlength=4) / len(text)
    word_hits, stem_hits, plain_hits = of["word_hit"].sum(), of["stem_hit"].sum(), of["plain_hit"].sum()
    return [word_hits, word_hits / n, stem_hits, stem_hits / n, plain_hits, plain_hits / n, of["weight"].max(initial=0.0),
            of["weight_sum"].sum() / max(1.0, word_hits + stem_hits), near / n, len(you) / n, kinds[3], of["shouted"].sum() / n,
            kinds[2], kinds[1] + kinds[2], of["mixed"].sum() / n, of["gap"].sum() / n, of["long_run"].sum() / n, float(np.log1p(n))]


def feature_column(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _Tokens(lexicon)
        for texts in batches:
            out = []
            for t in texts:
                if len(tokens) > MEMORY_TOKENS:
                    tokens = _Tokens(lexicon)
                out.append([float(x) for x in features_of(t, tokens)])
            yield pd.Series(out, dtype=object)

    return features(text_bytes(text))


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without trees ``share`` is every score."""

    share: float
    lexicon: Lexicon | None = None
    trees: object = None
    bounds: tuple[float, ...] = ()
    values: tuple[float, ...] = ()

    def score(self, docs: DataFrame, text_col: str = "text", into: str = "score") -> DataFrame:
        """The input rows and columns plus the calibrated probability."""
        columns = [c for c in docs.columns if c.lower() != into.lower()]
        if self.trees is None:
            return docs.select(*[f"`{c}`" for c in columns], F.lit(self.share).alias(into))
        text_batches(docs.sparkSession)
        row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row") if columns else F.lit(None).alias("row")
        rows = docs.select(row, array_to_vector(feature_column(F.col(f"`{text_col}`"), self.lexicon)).alias("features"))
        scored = self.trees.transform(rows).select("row", vector_to_array("probability")[1].alias("raw"))
        return scored.select("row.*", self._calibrated(F.col("raw")).alias(into))

    def _calibrated(self, raw: Column) -> Column:
        """Isotonic curve: linear between its bounds, level outside."""
        bounds, values = np.array(self.bounds), np.array(self.values)

        @F.pandas_udf("double")
        def calibrated(scores: pd.Series) -> pd.Series:
            return pd.Series(np.interp(scores.to_numpy(float), bounds, values))

        return calibrated(raw)


def train_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "toxic",
                   id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Fit on at most ``sample_docs`` labelled documents; ``learn_from`` is a condition on doc_id.

    Parts by a hash of the id: two fifths teach the lexicon, two the trees over its features and one their
    calibration, so that trees and curve see hits as rare as on new documents."""
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, label_col, learn_from, sample_docs, id_col, text_col)
    part = crc_remainder(F.concat(F.lit("part:"), F.col("doc_id").cast("string")), 5)
    sample = scratch.save(sample.withColumn("part", part), "sample")
    share = sample.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return ToxicityModel(float(share or 0.0))
    lexicon = learn_lexicon(sample.where("part < 2"))
    rows = scratch.save(sample.select("label", "part", feature_column(F.col("text"), lexicon).alias("f")).repartition(4), "features")
    rows = rows.select("label", "part", array_to_vector("f").alias("features"))
    held = rows.where("part >= 2")
    if held.select("label").distinct().count() < 2:
        return ToxicityModel(float(share))
    fit_on, tune_on = rows.where("part between 2 and 3"), rows.where("part = 4")
    if any(x.select("label").distinct().count() < 2 for x in (fit_on, tune_on)):
        fit_on = tune_on = held
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(fit_on)
    tuned = trees.transform(tune_on).select("label", vector_to_array("probability")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label").fit(tuned)
    return ToxicityModel(float(share), lexicon, trees, tuple(curve.boundaries.toArray()), tuple(curve.predictions.toArray()))
