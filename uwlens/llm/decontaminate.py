"""Benchmark decontamination with a generalised suffix automaton of the test items.

Test items are normalised to words (A-Z lowered; a word is a run of letters, digits and non-ASCII
characters) and put into one generalised suffix automaton.  Training texts stream through it: after
every word the automaton knows the longest suffix of the text so far that occurs in some item.  Where
that length reaches the window (13 words, or a whole shorter item), the matched words are marked as a
span.  ``spans`` can be removed from the text when they exceed the length limit, and a document whose
marked share reaches the coverage limit is contaminated.

The items are taken in blocks of at most ``block_words`` words; each block's words are broadcast (a
bounded size), every task builds the block's automaton once per Python worker, and the documents pass
through as one column function per block, so nothing shuffles and rows keep all their columns.

Defined results: null or empty text has no words, no hits, and is not contaminated; an item without
words has no window; equal items (or windows that several items share) all count as occurring; items
with a null id match (their words count as hit) but are not named; an item is never split over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_batches, text_bytes, with_results

WINDOW = 13
BLOCK_WORDS = 100_000
#: A document is contaminated when COVERAGE * n_hit >= n_words.
COVERAGE = 20
#: Bytes 0-2F, 3A-60 and 7B-7F separate words (upper-case letters were lowered before).
_SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SEPARATORS).split()


class ItemAutomaton:
    """Generalised suffix automaton over words, with the windows of its items marked on states."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # marks[state]: {window length: ids of the items it belongs to}
        self.marks: dict[int, dict[int, set]] = {}
        for item_id, words in items:
            if words:
                self._mark(item_id, words, min(window, len(words)))
        # marked_above[state]: nearest state on the suffix path, itself included, with marks
        self.marked_above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.marked_above[state] = state if state in self.marks else self.marked_above[self.link[state]]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, source: int, word: bytes, target: int) -> int:
        """The state for ``source + word`` alone, parted from ``target``, which also has longer strings."""
        part = self._state(self.length[source] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = part
        while source >= 0 and self.step[source].get(word) == target:
            self.step[source][word] = part
            source = self.link[source]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _mark(self, item_id: str | None, words: list[bytes], size: int) -> None:
        state, matched = 0, 0
        for w in words:
            state, matched = self.step[state][w], matched + 1
            if matched >= size:
                home = state
                while self.length[self.link[home]] >= size:
                    home = self.link[home]
                self.marks.setdefault(home, {}).setdefault(size, set()).add(item_id)

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(index, state, matched length) after each word whose suffix reaches a marked state."""
        state, matched = 0, 0
        step, link, length, marked = self.step, self.link, self.length, self.marked_above
        root = step[0]
        for i, w in enumerate(words):
            if state == 0:
                if w not in root:
                    continue
                state, matched = root[w], 1
            else:
                after = step[state].get(w)
                while after is None and state:
                    state = link[state]
                    matched = length[state]
                    after = step[state].get(w)
                if after is None:
                    continue
                state, matched = after, matched + 1
            if marked[state] >= 0:
                yield i, state, matched

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [start, end) word spans of all window occurrences, and the items they belong to."""
        spans: list[list[int]] = []
        items: set = set()
        for i, state, matched in self.stream(words):
            widest, at = 0, self.marked_above[state]
            while at >= 0:
                for size, ids in self.marks[at].items():
                    if size <= matched:
                        widest = max(widest, size)
                        items |= ids
                at = self.marked_above[self.link[at]] if self.link[at] >= 0 else -1
            if widest:
                start = i + 1 - widest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        items.discard(None)
        return spans, items


_BUILT: dict[tuple[int, int], ItemAutomaton] = {}


def _automaton(block: Broadcast, window: int) -> ItemAutomaton:
    """The block's automaton, built once in each Python worker (only the latest few are held)."""
    key = (block.value["stamp"], window)
    if key not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[key] = ItemAutomaton([(i, words_of(t)) for i, t in block.value["items"]], window)
    return _BUILT[key]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> list[Broadcast]:
    """The items with words, distinct, as broadcast blocks of at most ``block_words`` words (a longer
    item is a block of its own)."""
    spark = benchmark.sparkSession
    items = pick(benchmark, item_id=id_col, text=text_col).select(
        F.col("item_id").cast("string").alias("item_id"), text_bytes(F.col("text")).alias("text")).distinct()
    blocks, block, size = [], [], 0

    def close():
        if block:
            stamp = hash((len(blocks), tuple(block)))
            blocks.append(spark.sparkContext.broadcast({"stamp": stamp, "items": list(block)}))
            block.clear()

    for row in items.orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(bytes(row["text"])))
        if not n:
            continue
        if size and size + n > block_words:
            close()
            size = 0
        block.append((row["item_id"], bytes(row["text"])))
        size += n
    close()
    return blocks


_HITS = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>,clean:string>"


def _scan(blocks: list[Broadcast], window: int, max_span: int | None = None):
    """Column function of text bytes: word count, merged spans and items over the given blocks, and
    with ``max_span`` the text without longer spans.  Marked as not deterministic only so that Spark
    evaluates it once where several columns and filters use its result."""

    @F.pandas_udf(_HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        automata = [_automaton(b, window) for b in blocks]
        out = []
        for text in texts:
            words = words_of(text)
            spans, items = [], set()
            for a in automata:
                more, named = a.hits(words)
                spans += more
                items |= named
            if len(automata) > 1:
                spans = _merged(spans)
            clean = cut_text(text, spans, max_span) if max_span is not None else None
            out.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items), clean))
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items", "clean"])

    return scan.asNondeterministic()


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


#: Automata that one column function holds; further blocks are further column functions.
BLOCKS_AT_ONCE = 3


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, coverage: int = COVERAGE,
                  block_words: int = BLOCK_WORDS, max_span: int | None = None) -> DataFrame:
    """The input rows and columns plus n_words, n_hit, items (ids, sorted), hit_spans (array of
    [start, end) word positions) and contaminated; with ``max_span`` also clean_text, the text without
    longer spans."""
    text_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, item_id_col, item_text_col, block_words)
    text = text_bytes(F.col(f"`{text_col}`"))
    groups = [blocks[i:i + BLOCKS_AT_ONCE] for i in range(0, len(blocks), BLOCKS_AT_ONCE)] or [[]]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("body"))
    names = [f"h{i}" for i in range(len(groups))]
    scanned = packed.select("row", *[_scan(g, window, max_span if len(groups) == 1 else None)("body").alias(n) for g, n in zip(groups, names, strict=True)])
    first = F.col("h0")
    if len(names) == 1:
        spans = F.arrays_zip(first["starts"].alias("start"), first["ends"].alias("end"))
        items = first["items"]
    else:
        spans = _merge_columns(names)
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n)["items"] for n in names]))))
    found = scanned.select("row.*", first["n_words"].alias("n_words"), items.alias("items"), spans.alias("hit_spans"),
                           first["clean"].alias("found_clean"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    clean = {}
    if max_span is not None:
        clean = {"clean_text": F.col("found_clean") if len(groups) == 1 else remove_spans(F.col(f"`{text_col}`"), F.col("hit_spans"), max_span)}
    return with_results(
        found, **clean, n_words=F.col("n_words"), n_hit=n_hit, items=F.col("items"), hit_spans=F.col("hit_spans"),
        contaminated=(n_hit > 0) & (coverage * n_hit >= F.col("n_words"))).drop("found_clean")


def _merge_columns(names: list[str]) -> Column:
    """Merged spans of several passes, as an array of (start, end)."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def merge(*passes: pd.DataFrame) -> pd.Series:
        out = []
        for i in range(len(passes[0])):
            spans = [[s, e] for p in passes for s, e in zip(p["starts"].iloc[i], p["ends"].iloc[i], strict=True)]
            out.append([{"start": s, "end": e} for s, e in _merged(spans)])
        return pd.Series(out)

    return merge(*[F.col(n) for n in names])


def cut_text(raw: bytes, spans: list, longer_than: int) -> str:
    """The text without its spans of more than ``longer_than`` words: each cut runs from its first word's
    first character to its last word's last, what lies between words elsewhere stays as it was."""
    spans = [(s, e) for s, e in spans if e - s > longer_than]
    if not spans:
        return raw.decode()
    norm, at, bounds = raw.lower().translate(_SEPARATORS), 0, []
    for w in norm.split():
        at = norm.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    kept, done = [], 0
    for s, e in spans:
        kept.append(raw[done:bounds[s][0]])
        done = bounds[e - 1][1]
    return b"".join([*kept, raw[done:]]).decode()


def remove_spans(texts: Column, spans: Column, longer_than: int) -> Column:
    """``cut_text`` as a column function of texts and their (start, end) spans."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, hit: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, [(s["start"], s["end"]) for s in found], longer_than)
                          for t, found in zip(text, hit, strict=True)])

    return cut(text_bytes(texts), spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, coverage: int = COVERAGE,
                  max_span: int = WINDOW - 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents at or over the coverage limit go; the others lose their spans of more than
    ``max_span`` words.  Columns as they came."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                         F.col(f"`{text_col}`").cast("string").alias("body"))
    judged = contamination(packed, benchmark, "body", item_id_col, item_text_col, window, coverage, block_words, max_span)
    longest = F.array_max(F.transform("hit_spans", lambda s: s["end"] - s["start"]))
    body = F.when(longest > max_span, F.col("clean_text")).otherwise(F.col("body"))
    judged = judged.where(~F.col("contaminated")).select("row", body.alias("cut_body"))
    return judged.select(*[(F.col("cut_body").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)) for c in columns])
