"""Language-model scoring with a hierarchical Pitman-Yor model, its seating sampled by Gibbs.

Restaurants.  A token's context is the token before it (the text's start for the first): each preceding
token has a restaurant of its own, and the parent of all of them is the root.  Dishes are the tokens
(words and one end per text).  The root's base is uniform over the ``V`` training tokens and one unseen
token.  Restaurants, dishes and their counts all grow with the corpus and are never brought together.

Counting.  Texts are tokenised in chunks; each chunk sends its (token, context, count) triples, packed,
to the part that owns the token (a 64-bit hash).  A part holds every restaurant's customers for its
tokens, one row per part, and the contexts in which any text has its tokens.

Sampling.  A sweep reseats, in every part at once, all customers of each (restaurant, dish) by the
Chinese-restaurant process given the parent's predictive probability and the restaurant's totals of the
last sweep; the tables opened are the parent's customers.  A restaurant's customers lie in many parts:
after each sweep the parts send what they hold of it to its owner (by the context's hash), which returns
the sums to the parts that asked.  Only the totals of the root and of the texts' start pass the driver.
Runs of customers beyond the 64th sit down in blocks of a sixteenth of those seated, with one binomial
draw each.  Draws depend only on the seed, part and sweep, so a lost task is recomputed alike; a part's
row carries its last seating and those that the prediction averages.  Discounts are estimated from the counts of counts.

Scoring.  Chunks send (token, context, document, count) entries, packed, to the tokens' parts, which
average the predictive probability over the sweeps after ``BURN_IN`` and return sums per document.

Defined results: null and empty texts consist of the end token; equal tokens are those with equal bytes
after lower-casing A-Z; repeated rows are scored (and learned from) one by one; without training texts
every token has probability 1 / (V + 1) = 1; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed_at_once, partitions, pick, text_batches, text_bytes

SWEEPS, BURN_IN = 3, 1
CONCENTRATION = 1.0
SEED = 11
CHUNK_TOKENS = 1 << 20
FREQUENT = 1 << 18  # contexts with more than this share of all customers have numbers in requests, the others hashes
EXACT_SEATS = 64
START = 0x2020  # stands for the hash of the token before a text's first
END = b"\n"  # the end token: no token holds a line end

_PACKED = "part int, kind int, chunk string, body binary, ids array<string>"
_SHARED = ("root_customers", "root_tables", "start_customers", "start_tables")
_PART, _TOTALS, _ENTRIES, _DOCUMENTS = range(4)  # kinds of rows, in the order in which a part reads them


# ---- packed arrays ------------------------------------------------------------------------------

def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{1 + len(arrays)}q", len(arrays), *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(body: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays; those beyond the given kinds are of the last."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    count, = struct.unpack_from("<q", raw)
    sizes = struct.unpack_from(f"<{count}q", raw, 8)
    out, at = [], 8 + 8 * count
    for i, size in enumerate(sizes):
        kind = kinds[min(i, len(kinds) - 1)]
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


# ---- chunks of tokenised texts ------------------------------------------------------------------

class _Vocabulary(dict):
    """Token -> number in this chunk; hashes by number, number 0 being the start of a text."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = [START]

    def __missing__(self, token: bytes) -> int:
        n = self[token] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(token))
        return n


@dataclass
class _Chunk:
    """Entries (token, context, document, count) of some whole texts, sorted by token, context, document.

    Tokens and contexts are places in ``hashes``, which are sorted by their part and in it by value."""

    ids: list
    held: list[bool]
    lengths: list[int]
    hashes: np.ndarray
    token: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    count: np.ndarray


def _entries(ids: list, held: list[bool], lengths: list[int], vocabulary: _Vocabulary, numbers: list[np.ndarray], parts: int) -> _Chunk:
    hashes = np.array(vocabulary.hashes, np.uint64)
    order = np.lexsort((hashes, hashes % np.uint64(parts)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    flat = place[np.concatenate(numbers)]
    before = np.empty(len(flat), np.int64)
    before[1:] = flat[:-1]
    before[np.cumsum([0, *lengths[:-1]])] = place[0]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if len(hashes) ** 2 * len(lengths) < 1 << 63:
        key = np.sort((flat * len(hashes) + before) * len(lengths) + doc)
        pair, doc = np.divmod(key, len(lengths))
    else:
        pair = flat * len(hashes) + before
        by = np.argsort(pair, kind="stable")  # documents stay in order
        pair, doc = pair[by], doc[by]
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])
    token, context = np.divmod(pair[first], len(hashes))
    small = [x.astype(np.int32) for x in (token, context, doc[first], np.diff(np.r_[first, len(pair)]))]
    return _Chunk(ids, held, lengths, hashes[order], *small)


def _chunks(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[_Chunk]:
    """Chunks of about ``CHUNK_TOKENS`` tokens; a text is never divided."""
    vocabulary, ids, held, lengths, numbers, size = _Vocabulary(), [], [], [], [], 0
    for rows in batches:
        for doc_id, text, out in zip(rows["doc_id"], rows["text"], rows["held_out"], strict=True):
            tokens = text.lower().split()
            tokens.append(END)
            numbers.append(np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens)))
            ids.append(doc_id)
            held.append(bool(out))
            lengths.append(len(tokens))
            size += len(tokens)
            if size >= CHUNK_TOKENS or len(ids) == 1 << 20:
                yield _entries(ids, held, lengths, vocabulary, numbers, parts)
                vocabulary, ids, held, lengths, numbers, size = _Vocabulary(), [], [], [], [], 0
    if ids:
        yield _entries(ids, held, lengths, vocabulary, numbers, parts)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def _by_part(chunk: _Chunk, parts: int) -> Iterator[tuple[int, slice, np.ndarray, tuple[np.ndarray, ...]]]:
    """Each part's entries: the part, where they are, the first entry of each (token, context) among them, and
    these pairs as token hashes, contexts per token, the hashes of all contexts and each pair's place in those."""
    tokens = np.searchsorted(chunk.hashes % np.uint64(parts), np.arange(parts + 1, dtype=np.uint64))
    cuts = np.searchsorted(chunk.token, tokens)
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[part], cuts[part + 1])
        token, context = chunk.token[at], chunk.context[at]
        pairs = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (context[1:] != context[:-1])])
        first, contexts = _runs(token[pairs])
        asked, place = np.unique(context[pairs], return_inverse=True)
        yield part, at, pairs, (chunk.hashes[token[pairs][first]], contexts.astype(np.uint32), chunk.hashes[asked], place.astype(np.uint32))


def _training_counts(parts: int):
    """Packed pairs of each part (``_by_part``) and their counts in training texts, 0 if only other texts have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, parts):
            trained = np.where(np.array(chunk.held)[chunk.doc], 0, chunk.count)
            for part, at, pairs, packed in _by_part(chunk, parts):
                body = _pack(*packed, np.add.reduceat(trained[at], pairs).astype(np.uint32))
                yield pd.DataFrame({"part": [part], "kind": [_PART], "chunk": [""], "body": [body], "ids": [[]]})

    return run


def _summed_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per part from its chunks' rows, which arrive sorted by part."""
    part, pieces, size = None, [], 0

    def add_up() -> tuple[np.ndarray, ...]:
        """Distinct words, pairs per word, distinct contexts, each pair's place in them, counts."""
        words, word = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
        contexts, context = np.unique(np.concatenate([p[2] for p in pieces]), return_inverse=True)
        word = np.repeat(word, np.concatenate([p[1] for p in pieces]))
        at = np.cumsum([0, *[len(p[2]) for p in pieces]])
        key = np.concatenate([context[i:][p[3]] for i, p in zip(at, pieces)])
        key += word * len(contexts)
        order = np.argsort(key)
        key, count = key[order], np.concatenate([p[4] for p in pieces])[order]
        starts, _ = _runs(key)
        word, place = np.divmod(key[starts], len(contexts))
        return words, np.bincount(word, minlength=len(words)), contexts, place, np.add.reduceat(count, starts, dtype=np.int64)

    def row() -> pd.DataFrame:
        words, pairs, contexts, place, count = add_up()
        if not (contexts == START).any():
            before = np.searchsorted(contexts, np.uint64(START))
            contexts = np.insert(contexts, before, np.uint64(START))
            place = place + (place >= before)
        trained = count > 0
        word = np.repeat(np.arange(len(words)), pairs)[trained]
        first, cells = _runs(word)
        body = _pack(words[word[first]], cells.astype(np.uint32), contexts, place[trained].astype(np.uint32), count[trained])
        return pd.DataFrame({"part": [part], "kind": [_PART], "chunk": [""], "body": [body], "ids": [[]]})

    for rows in batches:
        for p, body in zip(rows["part"], rows["body"], strict=True):
            if part is not None and p != part:
                yield row()
                pieces, size = [], 0
            part = p
            pieces.append(tuple(_unpack(body, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)))
            size += len(pieces[-1][3])
            if size > 2 * max(1 << 19, len(pieces[0][3])):
                pieces = [add_up()]
                size = len(pieces[0][3])
    if part is not None:
        yield row()


# ---- restaurants of one part --------------------------------------------------------------------

@dataclass
class Model:
    """What all parts need: discounts of the contexts' restaurants and of the root, sizes, and after each sweep
    the customers and tables of the root and of the text start's restaurant (``_SHARED``)."""

    discounts: tuple[float, float]
    tokens: int
    vocabulary: int
    totals: list[dict[str, int]]
    frequent: np.ndarray  # hashes of the contexts with the most customers, for shorter requests only


def reseat(customers: np.ndarray, strength: np.ndarray, discount: float, parent: np.ndarray, rng) -> np.ndarray:
    """Tables after the customers of each dish sit down one by one.

    strength: concentration + discount * the restaurant's other tables.  A customer after k others at t
    tables opens a new one with probability (strength + discount t) parent / (k - discount t + that)."""
    tables = (customers > 0).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        t = tables[active]
        fresh = (strength[active] + discount * t) * parent[active]
        chance = fresh / (seated - discount * t + fresh)
        if seated < EXACT_SEATS:
            tables[active] += rng.random(len(active)) < chance
            seated += 1
        else:
            block = seated // 16
            tables[active] += rng.binomial(np.minimum(block, customers[active] - seated), chance)
            seated += block
        active = active[customers[active] > seated]
    return tables


@dataclass
class Seating:
    """Tables of a part's cells and words after a sweep, and of each of its contexts' restaurants as a whole."""

    cells: np.ndarray
    words: np.ndarray
    contexts: np.ndarray  # empty until the owners have answered


class Part:
    """The dishes of one part: cells (dish, context) and, in the root, words; and the seatings still needed."""

    def __init__(self, number: int, body: bytes):
        self.number = number
        self.words, self.sizes, self.contexts, self.place, self.count, *more = _unpack(
            body, np.uint64, np.uint32, np.uint64, np.uint32, np.int64)
        self.word = np.repeat(np.arange(len(self.words), dtype=np.int32), self.sizes)
        self.key = self.word * np.int64(len(self.contexts)) + self.place
        self.word_count = self.of_words(self.count)
        none = np.empty(0, np.int64)
        #: customers of each context's restaurant as a whole, then the seatings
        self.seats, *seatings = more or [none, np.ones(len(self.key), np.int64), np.ones(len(self.words), np.int64), none]
        self.seatings = [Seating(*seatings[i:i + 3]) for i in range(0, len(seatings), 3)]

    def row(self) -> pd.DataFrame:
        body = _pack(self.words, self.sizes, self.contexts, self.place, self.count, self.seats,
                     *[a for s in self.seatings for a in (s.cells, s.words, s.contexts)])
        return pd.DataFrame({"part": [self.number], "kind": [_PART], "chunk": [""], "body": [body], "ids": [[]]})

    def forget_counts(self) -> None:
        """Keep only what finds words, contexts and cells (the others are views of one large buffer)."""
        self.words, self.contexts = self.words.copy(), self.contexts.copy()
        self.sizes = self.place = self.count = self.word = self.seats = self.seatings = None

    def of_words(self, cells: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, cells, len(self.words)).astype(np.int64)

    def of_contexts(self, cells: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, cells, len(self.contexts)).astype(np.int64)

    def by_owner(self, parts: int) -> list[np.ndarray]:
        """The places of the contexts that each part owns."""
        owner = (self.contexts % np.uint64(parts)).astype(np.int64)
        return np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=parts))[:-1])

    def asked(self, parts: int) -> pd.DataFrame:
        """One row per owner of contexts: their hashes, what the part holds of their tables, and first of their customers."""
        now = self.seatings[-1]
        held = [self.of_contexts(now.cells)] + ([] if len(self.seats) else [self.of_contexts(self.count)])
        sent = [(o, _pack(self.contexts[at], *[h[at] for h in held])) for o, at in enumerate(self.by_owner(parts)) if len(at)]
        start = self.place == np.searchsorted(self.contexts, np.uint64(START))
        shared = (now.cells.sum(), now.words.sum(), self.count[start].sum(), now.cells[start].sum())
        return pd.DataFrame({"part": [o for o, _ in sent], "source": self.number, "body": [b for _, b in sent],
                             **{n: [int(v)] + [0] * (len(sent) - 1) for n, v in zip(_SHARED, shared, strict=True)}})

    def told(self, answers: dict[int, bytes], parts: int) -> None:
        """Take the owners' sums over all parts."""
        for owner, at in enumerate(self.by_owner(parts)):
            if not len(at):
                continue
            sums = _unpack(answers[owner], np.int64)
            for i, total in enumerate(sums):
                known = self.seats if i else self.seatings[-1].contexts
                if not len(known):
                    known = np.zeros(len(self.contexts), np.int64)
                    if i:
                        self.seats = known
                    else:
                        self.seatings[-1].contexts = known
                known[at] = total

    def shares(self, seating: Seating, model: Model, totals: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What cells' own customers give their dish, each context's back-off weight, each word's probability in the root."""
        d, d_root = model.discounts
        own = (self.count - d * seating.cells) / (CONCENTRATION + self.seats[self.place])
        back = (CONCENTRATION + d * seating.contexts) / (CONCENTRATION + self.seats)
        root = (self.of_words(seating.cells) - d_root * seating.words) / (CONCENTRATION + totals["root_customers"])
        return own, back, root + unseen(model, totals)

    def sweep(self, model: Model, number: int) -> None:
        """Reseat cells, then words, given the totals of the sweep before; forget seatings that no prediction needs."""
        last, totals, (d, d_root) = self.seatings[-1], model.totals[number - 1], model.discounts
        rng = np.random.default_rng((SEED, self.number, number))
        _, _, root = self.shares(last, model, totals)
        cells = reseat(self.count, CONCENTRATION + d * (last.contexts[self.place] - last.cells), d, root[self.word], rng)
        words = reseat(self.of_words(cells), CONCENTRATION + d_root * (totals["root_tables"] - last.words), d_root,
                       np.full(len(self.words), 1 / (model.vocabulary + 1)), rng)
        if number - 1 <= BURN_IN:
            self.seatings = []
        self.seatings.append(Seating(cells, words, np.empty(0, np.int64)))


def unseen(model: Model, totals: dict[str, int]) -> float:
    """Probability in the root of one token without customers there."""
    back = (CONCENTRATION + model.discounts[1] * totals["root_tables"]) / (CONCENTRATION + totals["root_customers"])
    return back / (model.vocabulary + 1)


def _count_statistics(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sizes, and cells and words with one and with two customers, when all have one table."""
    for batch in rows:
        for number, body in zip(batch["part"], batch["body"], strict=True):
            part = Part(number, body)
            levels = part.count, part.of_words(part.seatings[-1].cells)
            out = {"tokens": int(part.count.sum()), "words": len(part.words)}
            out |= {f"{name}{level}": int((c == n).sum()) for level, c in enumerate(levels) for n, name in ((1, "one"), (2, "two"))}
            yield pd.DataFrame({k: [v] for k, v in out.items()})


def _questions(parts: int):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for number, body in zip(batch["part"], batch["body"], strict=True):
                yield Part(number, body).asked(parts)

    return run


def _answers(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by owner: each owner's contexts summed over all parts, one row per part that asked."""

    def summed(owner: int, asked: list[tuple]) -> pd.DataFrame:
        unpacked = [_unpack(body, np.uint64, np.int64) for _, body, *_ in asked]
        _, place = np.unique(np.concatenate([u[0] for u in unpacked]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate(h)).astype(np.int64)[place] for h in zip(*[u[1:] for u in unpacked], strict=True)]
        ends = np.cumsum([0, *[len(u[0]) for u in unpacked]])
        return pd.DataFrame({"part": [a[0] for a in asked], "kind": _TOTALS, "chunk": str(owner),
                             "body": [_pack(*[x[i:j] for x in sums]) for i, j in zip(ends[:-1], ends[1:], strict=True)],
                             "ids": [[] for _ in asked], **{n: [a[2 + k] for a in asked] for k, n in enumerate(_SHARED)}})

    now, asked = None, []
    for batch in rows:
        for owner, *question in zip(batch["part"], batch["source"], batch["body"], *[batch[n] for n in _SHARED], strict=True):
            if owner != now and asked:
                yield summed(now, asked)
                asked = []
            now = owner
            asked.append(question)
    if asked:
        yield summed(now, asked)


def _next_seatings(model: Broadcast, number: int, parts: int):
    """Rows arrive sorted by (part, kind): parts told the last totals, and reseated unless ``number`` is past the last sweep."""

    def finished(part: Part, answers: dict[int, bytes]) -> pd.DataFrame:
        part.told(answers, parts)
        if number <= SWEEPS:
            part.sweep(model.value, number)
        return part.row()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, answers = None, {}
        for batch in rows:
            for at, kind, chunk, body in zip(batch["part"], batch["kind"], batch["chunk"], batch["body"], strict=True):
                if kind == _PART:
                    if part is not None:
                        yield finished(part, answers)
                    part, answers = Part(at, body), {}
                else:
                    answers[int(chunk)] = body
        if part is not None:
            yield finished(part, answers)

    return run


def _often_asked(tokens: int):
    """Contexts with more than one in ``FREQUENT`` of all customers: fewer than that, whatever the corpus."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for number, body in zip(batch["part"], batch["body"], strict=True):
                part = Part(number, body)
                at = np.flatnonzero(part.seats * FREQUENT > tokens)
                yield pd.DataFrame({"context": part.contexts[at].view(np.int64), "customers": part.seats[at]})

    return run


def fit(docs: DataFrame, scratch: Scratch, parts: int) -> tuple[DataFrame, Model]:
    """The parts' table (one row each) and the model, from rows (doc_id, text, held_out)."""
    spark = docs.sparkSession
    counted = docs.mapInPandas(_training_counts(parts), _PACKED)
    dealt = counted.repartitionById(parts, "part").sortWithinPartitions("part")
    table = scratch.save_only(dealt.mapInPandas(_summed_parts, _PACKED), "parts0")
    names = ["tokens", "words", *[f"{n}{level}" for level in range(2) for n in ("one", "two")]]
    facts = (table.mapInPandas(_count_statistics, ", ".join(f"{n} bigint" for n in names))
             .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first())
    discounts = tuple(min(0.95, max(0.05, (facts[f"one{i}"] + 1) / (facts[f"one{i}"] + 2 * facts[f"two{i}"] + 2))) for i in range(2))
    model = Model(discounts, facts["tokens"], facts["words"], [], np.empty(0, np.uint64))
    shared = ", ".join(f"{n} bigint" for n in _SHARED)
    for number in range(1, SWEEPS + 2):
        questions = table.mapInPandas(_questions(parts), f"part int, source int, body binary, {shared}")
        answers = scratch.save_only(questions.repartitionById(parts, "part").sortWithinPartitions("part", "source")
                               .mapInPandas(_answers, f"{_PACKED}, {shared}"), f"totals{number}")
        totals = answers.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _SHARED]).first().asDict()
        model = Model(discounts, model.tokens, model.vocabulary, [*model.totals, totals], model.frequent)
        told = table.unionByName(answers.drop(*_SHARED)).repartitionById(parts, "part").sortWithinPartitions("part", "kind")
        table = scratch.save_only(told.mapInPandas(_next_seatings(spark.sparkContext.broadcast(model), number, parts), _PACKED), f"parts{number}")
        scratch.drop(f"totals{number}")
        scratch.drop(f"parts{number - 1}")
    often = table.mapInPandas(_often_asked(model.tokens), "context bigint, customers bigint").distinct().collect()
    often.sort(key=lambda r: (-r["customers"], r["context"]))
    model.frequent = np.array([r["context"] for r in often], np.int64).view(np.uint64)
    return table, model


# ---- scoring ------------------------------------------------------------------------------------

def _scoring_requests(parts: int, model: Broadcast):
    """Per chunk: a row of its documents, and per part a row of packed entries of all texts, their contexts
    numbered through the model's frequent ones and then the row's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        frequent = model.value.frequent
        by_hash = np.argsort(frequent)
        in_order = frequent[by_hash]
        for number, chunk in enumerate(_chunks(batches, parts)):
            name = f"{task}-{number}"
            about = _pack(np.array(chunk.held, np.uint8), np.array(chunk.lengths, np.int64))
            home = xxhash.xxh3_64_intdigest(name) % parts
            yield pd.DataFrame({"part": [home], "kind": [_DOCUMENTS], "chunk": [name], "body": [about], "ids": [chunk.ids]})
            for part, at, pairs, (words, sizes, contexts, place) in _by_part(chunk, parts):
                entries = np.diff(np.r_[pairs, at.stop - at.start])
                there, known = _find(in_order, contexts)
                numbers = len(frequent) + np.cumsum(~known) - 1
                numbers[known] = by_hash[there[known]]
                body = _pack(words, sizes, contexts[~known], numbers[place].astype(np.uint32), entries.astype(np.uint32), chunk.doc[at].astype(np.uint32), chunk.count[at].astype(np.uint32))
                yield pd.DataFrame({"part": [part], "kind": [_ENTRIES], "chunk": [name], "body": [body], "ids": [[]]})

    return run


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted values in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Samples:
    """A part's predictive probabilities, averaged over the kept sweeps."""

    def __init__(self, part: Part | None, model: Model):
        self.part, self.model = part or self._untrained(model), model
        self.frequent = _find(self.part.contexts, model.frequent)
        kept = model.totals[BURN_IN + 1:]
        self.kept = [(*self.part.shares(s, model, t), unseen(model, t)) for s, t in zip(self.part.seatings, kept, strict=True)]
        self.part.forget_counts()

    @staticmethod
    def _untrained(model: Model) -> Part:
        """A part without training tokens; of the contexts it only knows the start of a text."""
        none = np.empty(0, np.int64)
        seatings = [(none, none, np.array([t["start_tables"]])) for t in model.totals[BURN_IN + 1:]]
        return Part(-1, _pack(none, none.astype(np.uint32), np.array([START], np.uint64), none.astype(np.uint32), none,
                              np.array([model.totals[0]["start_customers"]]), *[a for s in seatings for a in s]))

    @staticmethod
    def _picked(values: np.ndarray, at: np.ndarray, there: np.ndarray, otherwise: float) -> np.ndarray:
        return np.where(there, values[at], otherwise) if len(values) else np.full(len(at), otherwise)

    def entries(self, words: np.ndarray, sizes: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities and training counts of entries (a word's entries are consecutive); contexts are
        hashes, and one that no training text has leaves all to the root."""
        return self._predicted(words, sizes, *_find(self.part.contexts, context.astype(np.uint64)))

    def requested(self, words: np.ndarray, sizes: np.ndarray, contexts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``entries`` whose contexts are places in the model's frequent contexts followed by ``contexts``."""
        where, there = (np.concatenate(x)[place] for x in zip(self.frequent, _find(self.part.contexts, contexts), strict=True))
        return self._predicted(words, sizes, where, there)

    def _predicted(self, words: np.ndarray, sizes: np.ndarray, where: np.ndarray, has_context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, known = _find(self.part.words, words)
        trained = self._picked(self.part.word_count, at, known, 0).astype(np.int64)
        at, known = np.repeat(at, sizes), np.repeat(known, sizes)
        cell, has_cell = _find(self.part.key, at * len(self.part.contexts) + where)
        has_cell &= known & has_context
        total = np.zeros(len(where))
        for own, back, root, other in self.kept:
            total += (self._picked(own, cell, has_cell, 0.0)
                      + self._picked(back, where, has_context, 1.0) * self._picked(root, at, known, other))
        return np.log10(total / len(self.kept)), np.repeat(trained, sizes)


def _score_entries(model: Broadcast):
    """Rows arrive sorted by (part, kind): a part's counts, then its entries, which leave as sums per
    document; the chunks' own rows pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        samples, of = None, None
        for rows in batches:
            out = {"chunk": [], "kind": [], "body": [], "ids": []}
            for part, kind, chunk, body, ids in zip(rows["part"], rows["kind"], rows["chunk"], rows["body"], rows["ids"], strict=True):
                if kind == _PART:
                    samples, of = _Samples(Part(part, body), m), part
                    continue
                if kind == _ENTRIES:
                    if of != part:
                        samples, of = _Samples(None, m), part
                    words, sizes, contexts, place, entries, doc, count = _unpack(body, np.uint64, np.uint32, np.uint64, np.uint32)
                    log_p, trained = samples.requested(words, sizes, contexts, place)
                    base = np.log10((trained + 1) / (m.tokens + m.vocabulary + 1))
                    log_p, base, known = (np.repeat(x, entries) for x in (log_p, base, trained > 0))
                    n = np.bincount(doc)
                    at = np.flatnonzero(n)
                    body = _pack(at.astype(np.uint32), np.bincount(doc, log_p * count)[at].astype(np.float32),
                                 np.bincount(doc, base * count)[at], np.bincount(doc, count * known)[at].astype(np.uint32))
                    ids = []
                for k, v in (("chunk", chunk), ("kind", _ENTRIES + _DOCUMENTS - kind), ("body", body), ("ids", ids)):
                    out[k].append(v)
            if out["chunk"]:
                yield pd.DataFrame(out)

    return run


def _document_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (chunk, kind): a chunk's documents, then its parts' sums."""
    now, docs, sums = None, None, None

    def finished() -> pd.DataFrame:
        ids, held, lengths = docs
        return pd.DataFrame({"doc_id": ids, "held_out": held.astype(bool), "n_tokens": lengths, "n_known": sums[2].astype(np.int64),
                             "base_score": sums[1], "score": sums[0]})

    for rows in batches:
        for chunk, kind, body, ids in zip(rows["chunk"], rows["kind"], rows["body"], rows["ids"], strict=True):
            if kind == _ENTRIES:  # the kinds have changed places
                if now is not None:
                    yield finished()
                held, lengths = _unpack(body, np.uint8, np.int64)
                now, docs, sums = chunk, (list(ids), held, lengths), np.zeros((3, len(lengths)))
            else:
                at, score, base, known = _unpack(body, np.uint32, np.float32, np.float64, np.uint32)
                for total, more in zip(sums, (score, base, known), strict=True):
                    total[at] += more
    if now is not None:
        yield finished()


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    perplexity.  The model learns from the rows where ``held_out`` (a condition on doc_id) is false."""
    spark = docs.sparkSession
    text_batches(spark)
    freed_at_once(spark)
    scratch = Scratch(spark, "pitman-yor")
    parts = partitions(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), text_bytes(F.col("text")).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table, model = fit(rows, scratch, parts)
    shared = spark.sparkContext.broadcast(model)
    requests = rows.mapInPandas(_scoring_requests(parts, shared), _PACKED).unionByName(table)
    scored = (requests.repartitionById(parts, "part").sortWithinPartitions("part", "kind")
              .mapInPandas(_score_entries(shared), "chunk string, kind int, body binary, ids array<string>"))
    summed = (scored.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
              .mapInPandas(_document_sums, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"))
    return summed.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known",
                         F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
