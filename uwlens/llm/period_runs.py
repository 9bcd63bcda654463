"""Periodic runs of words: multi-scale minimizers seed them, exact extension settles them.

A run is a maximal stretch of consecutive words that repeats with a smallest period q (words q apart are
identical) over at least ``max(LEAST_WORDS, LEAST_TURNS * q)`` words.

* Periods below ``DIRECT`` are found by direct lag scans: words are compared with those q places on.
* At scale W = DIRECT, 2 DIRECT, 4 DIRECT, ... (periods W to 2W - 1) each place is hashed with the 2W words
  that begin there, by doubling, and the least hash of every W consecutive places is selected (ties too).  In a
  run of such a period, both a window and the one a period later lie inside the run, so their minima are
  selected, have equal hashes and lie exactly q apart; no equal hash lies between them, since 2W words that
  repeat at less than q would give the whole run a smaller period (Fine and Wilf).  Consecutive equal minima
  that are W to 2W - 1 apart are therefore the seeds, and none is missed.
* A seed is extended to both sides on the words themselves, so a hash only proposes.  Of stretches with the same
  ends the least period counts (the others are its multiples).

Rows are worked on in batches, all texts of a batch laid end to end with a unique word between them and long
texts first, so that a scale only reads the texts that are long enough for it: work per word grows with the
logarithm of the longest text, not with the number of lags.  Texts are independent; nothing is shuffled.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, compared byte for byte; null, empty and blank texts have no
words, no runs and an empty collapsed text; texts of any length are taken whole; each of repeated rows has its
result; an empty table gives an empty one; an input column called ``n_words``, ``runs`` or ``collapsed`` gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_batches, text_bytes, whole_text

LEAST_WORDS = 6
LEAST_TURNS = 4
DIRECT = 16
BATCH_ROWS, BATCH_BYTES = 250, 1 << 20  # a text is many times its size while its runs are found
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_U64 = np.uint64


# ---- runs of one long array of word numbers -------------------------------------------------------

def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` (a power of two) words from each place on, by doubling."""
    h, span = _scrambled(words.astype(_U64) + _U64(0x9E3779B97F4A7C15)), 1
    while span < size:
        h = _scrambled(h[:-span] * _U64(0x9E3779B97F4A7C15) + (h[span:] ^ _U64(span)))
        span *= 2
    return h


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The extreme of each ``width`` (a power of two) consecutive values, by doubling."""
    span = 1
    while span < width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return values


def _selected(grams: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of some window of ``width`` places."""
    least = _extreme(grams, width, np.minimum)
    edge = np.zeros(width - 1, _U64)  # a place belongs to the windows that begin up to width - 1 before it
    return np.flatnonzero(_extreme(np.concatenate([edge, least, edge]), width, np.maximum) == grams)


def _seeds(words: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of consecutive equal minimizers that are ``scale`` to 2 ``scale`` - 1 apart."""
    if len(words) < 3 * scale:
        return np.empty(0, int), np.empty(0, int)
    grams = _grams(words, 2 * scale)
    places = _selected(grams, scale)
    order = places[np.lexsort((places, grams[places]))]
    lag = np.diff(order)
    good = (grams[order[:-1]] == grams[order[1:]]) & (lag >= scale) & (lag < 2 * scale)
    at, lag = order[:-1][good], lag[good]
    by = np.lexsort((at, lag))
    return at[by], lag[by]


def _reach(same: Callable[[int, int], np.ndarray], room: int) -> int:
    """How many of the next ``room`` comparisons hold before the first that does not."""
    done, step = 0, 64
    while done < room:
        got = same(done, min(room, done + step))
        if not got.all():
            return done + int(got.argmin())
        done += len(got)
        step *= 4
    return done


def _extended(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` in which words ``lag`` apart are identical: its start and end."""
    ahead = _reach(lambda i, j: words[at + i:at + j] == words[at + lag + i:at + lag + j], len(words) - lag - at)
    back = _reach(lambda i, j: words[at - j:at - i][::-1] == words[at + lag - j:at + lag - i][::-1], at)
    return at - back, at + lag + ahead


def find_runs(words: np.ndarray, reach: Callable[[int], int] | None = None) -> np.ndarray:
    """(start, length, period) of all runs, by start and period.

    ``reach`` tells up to which place stretches of at least so many words can lie (all, if not given)."""
    reach = reach or (lambda least: len(words))
    found = []
    for lag in range(1, DIRECT):
        part = words[:reach(max(LEAST_WORDS, LEAST_TURNS * lag))]
        same = np.concatenate([[False], part[lag:] == part[:-lag], [False]]) if len(part) > lag else np.zeros(2, bool)
        turn = np.flatnonzero(same[1:] != same[:-1])
        start, end = turn[::2], turn[1::2] + lag
        long = end - start >= max(LEAST_WORDS, LEAST_TURNS * lag)
        found.append(np.column_stack([start[long], end[long], np.full(long.sum(), lag)]))
    scale = DIRECT
    while (stop := reach(LEAST_TURNS * scale)) >= LEAST_TURNS * scale:
        part, ends = words[:stop], {}
        runs = []
        for at, lag in zip(*(s.tolist() for s in _seeds(part, scale)), strict=True):
            if at + lag < ends.get(lag, 0):  # inside the stretch that this lag has reached already
                continue
            start, ends[lag] = _extended(part, at, lag)
            if ends[lag] - start >= LEAST_TURNS * lag:
                runs.append((start, ends[lag], lag))
        found.append(np.array(runs, int).reshape(-1, 3))
        scale *= 2
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    least = np.ones(len(runs), bool)
    least[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[least]
    runs[:, 1] -= runs[:, 0]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


# ---- texts ------------------------------------------------------------------------------------------

def _batch_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, found in one array of all texts, the longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    ids, starts, lengths = [], [], []
    for i in order:
        starts.append(len(ids))
        lengths.append(len(texts[i]))
        ids += [numbers.setdefault(w, len(numbers)) for w in texts[i]]
        ids.append(-1 - len(starts))  # a word of its own between two texts
    words, ends = np.array(ids, np.int64), np.array(starts) + np.array(lengths) + 1
    longest_first = -np.array(lengths)

    def reach(least: int) -> int:
        texts_so_long = int(np.searchsorted(longest_first, -least, side="right"))
        return int(ends[texts_so_long - 1]) if texts_so_long else 0

    runs = find_runs(words, reach) if len(words) else np.empty((0, 3), int)
    cut = np.searchsorted(runs[:, 0], [*starts, len(words)])
    out: list[np.ndarray] = [np.empty((0, 3), int)] * len(texts)
    for k, i in enumerate(order):
        own = runs[cut[k]:cut[k + 1]].copy()
        own[:, 0] -= starts[k]
        out[i] = own
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The text without what a run repeats: words that no run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period:start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t.split() for t in batch]
        runs = _batch_runs(texts)
        yield pd.DataFrame({"n_words": [len(t) for t in texts],
                            "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()] for own in runs],
                            "collapsed": [_collapsed(t, own).decode() for t, own in zip(texts, runs, strict=True)]})


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, runs (array of start, length, period by start and period) and collapsed (the text
    without repetitions, words joined by one space)."""
    text_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    detect = F.pandas_udf(_detect, f"n_words bigint, runs array<{_RUN}>, collapsed string")
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    found = docs.select(*[F.col(f"`{c}`") for c in kept], detect(text_bytes(F.col(f"`{text_col}`"))).alias("found_runs"))
    return found.select(*[F.col(f"`{c}`") for c in kept], "found_runs.n_words", "found_runs.runs", "found_runs.collapsed")


def longest_run(runs: str) -> Column:
    """The run of greatest length (ties: smallest start, then period); null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("minus_start"),
                                                            (-r["period"]).alias("minus_period"))))


def looped(text: Column, first: Column, period: Column) -> Column:
    """The text whose words from number ``first`` on go round in its own words ``first`` to ``first + period - 1``."""
    words = F.filter(F.split(whole_text(text), SPACES), lambda w: w != "")
    tail = F.size(words) - first
    turns = F.array_repeat(F.slice(words, (first + 1).cast("int"), period.cast("int")), F.ceil(tail / period).cast("int"))
    return F.array_join(F.concat(F.slice(words, F.lit(1), first.cast("int")), F.slice(F.flatten(turns), F.lit(1), tail.cast("int"))), " ")
