"""Near-duplicate detection: MinHash banding with sequential Bayesian verification.

A document's set is its distinct ``k``-word shingles (64-bit hashes of the whole text).  Equal sets
collapse to one node.  Each node has a MinHash signature, cut into bands (``band_rows`` chooses their
width from the threshold); nodes with an equal band share a bucket.  Candidates are verified in signature batches: after each batch the posterior
probability that the similarity reaches the threshold (Beta posterior of the matches so far, uniform
prior) is bounded, and a pair is pruned as soon as that probability falls below ``miss``.  Survivors
are compared exactly on their full sets.

No bucket is expanded into all pairs, and none is capped:

1. *Stars.*  Each bucket proposes links from its members to one hub, the member that meets most others
   over all its buckets (for copies of one original that is the original): pairs grow with the rows.
2. *Rest.*  Members that their buckets' stars left in different components are joined by an exact
   prefix filter over their shingles, rarest first: two sets at the threshold share one of their first
   ``n - ceil(threshold n) + 1`` shingles, and what follows the shared one still has to suffice for the
   overlap the threshold asks.  A shingle nobody else has takes its place but joins nothing, so far
   copies of one text, which differ in many places, drop out.  Only pairs across components are made.

Links form components (``components``).  Defined results: null or empty text has no shingles, is its
own component and links with nothing; rows without an id are linked like others; a text of fewer than
``k`` words is one shingle; equal sets are always linked; ``component_id`` is the smallest id of the
component, null only if all its ids are null, and ``kept`` marks the rows with that id.  An id may have
several texts: rows are told apart by id and text (``row_key``).  ``drop_near_duplicates`` keeps exactly
one row of each component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import keyed, split_join
from .common import Scratch, bitmap_of, flagged_by, pick, text_batches, text_bytes
from .components import components

SHINGLE = 5
THRESHOLD = (85, 100)
HASHES = 120
BATCH = 24
MISS = 1e-7
#: Bound on the probability that a pair at the threshold shares at most one band (see ``band_rows``).
BAND_MISS = 2e-5
ID_FILTER_BITS = 1 << 26

_U64 = np.uint64
_STEP = _U64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


# ---- signatures ---------------------------------------------------------------------------------

class _WordHashes(dict):
    """64-bit hashes of words, remembered for the words of one batch."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingle_set(text: bytes, hashes: dict, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles (one for a shorter text)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, _U64)
    ids = np.fromiter(map(hashes.__getitem__, words), _U64, len(words))
    n = max(1, len(ids) - k + 1)
    acc = np.full(n, min(k, len(ids)), _U64)
    for j in range(min(k, len(ids))):
        acc = _scramble(acc + _STEP) + ids[j:j + n]
    return np.unique(_scramble(acc))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (uint32) of non-empty sets, computed for runs of sets that fit in cache."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        flat = (np.concatenate(sets[at:end]) >> _U64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        for i in range(HASHES):
            h = flat * _MUL[i] + _ADD[i]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[at:end, i] = np.minimum.reduceat(h, starts)
        at = end
    return out


def _node(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Smaller frames, so that a worker holds the sets of few texts at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _slices(batches):
        hashes = _WordHashes()
        sets = [shingle_set(t, hashes) for t in rows["text"]]
        full = [s for s in sets if len(s)]
        signed = iter(_signatures(full)) if full else iter(())
        node, sig = [], []
        for s in sets:
            node.append(_node(s))
            sig.append(next(signed).tobytes() if len(s) else None)
        yield pd.DataFrame({"doc_id": rows["doc_id"], "row_key": rows["row_key"], "n_shingles": [len(s) for s in sets], "node": node, "sig": sig})


def _row_key(doc_id: Column, text: Column) -> Column:
    """Id and text of a row in one string (a null id leaves the text's digest alone)."""
    return F.concat_ws(":", doc_id.cast("string"), F.md5(text_bytes(text)))


def signed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.select(F.col("doc_id").cast("string").alias("doc_id"), _row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
                        text_bytes(F.col("text")).alias("text"))
            .mapInPandas(_sign, "doc_id string, row_key string, n_shingles bigint, node binary, sig binary")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


def _band(j: Column, rows: int) -> Column:
    return F.xxhash64(j, F.col("sig").substr((j * (4 * rows) + 1).cast("int"), F.lit(4 * rows)))


# ---- sequential Bayesian verification -----------------------------------------------------------

def _binomial_at_most(n: int, p: float, m: int) -> float:
    """P(Binomial(n, p) <= m); also the posterior P(similarity >= p | m of n - 1 matches)."""
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m + 1))


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Smallest number of matches among n that keeps a pair: with fewer, the posterior probability
    of reaching the threshold is below ``miss``."""
    return next(m for m in range(n + 1) if _binomial_at_most(n + 1, threshold, m) >= miss)


def band_rows(threshold: float) -> int:
    """Hashes per band: the most with which a pair at the threshold shares at most one of the
    ``HASHES / rows`` bands with a probability below ``BAND_MISS``."""
    fits = [r for r in range(1, HASHES + 1) if HASHES % r == 0 and _binomial_at_most(HASHES // r, threshold**r, 1) < BAND_MISS]
    if not fits:
        raise ValueError(f"no banding of {HASHES} hashes finds pairs of similarity {threshold} with a miss below {BAND_MISS}")
    return max(fits)


def _plausible(threshold: float, miss: float):
    bounds = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, HASHES + 1, BATCH)]

    @F.pandas_udf("boolean")
    def plausible(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=bool)
        a = np.frombuffer(b"".join(left), np.uint32).reshape(-1, HASHES)
        b = np.frombuffer(b"".join(right), np.uint32).reshape(-1, HASHES)
        alive = np.arange(len(a))
        matches = np.zeros(len(a), int)
        for n, least in bounds:
            batch = slice(n - BATCH, n)
            matches[alive] += (a[alive, batch] == b[alive, batch]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        kept = np.zeros(len(a), bool)
        kept[alive] = True
        return pd.Series(kept)

    return plausible


def _confirm(ratio: tuple[int, int]):
    """Exact test on full sets (the second text of consecutive rows is usually the same)."""
    num, den = ratio

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_text, last_set, last_node = None, None, None
        for rows in _slices(batches):
            hashes = _WordHashes()
            linked = []
            for a, b, mine, other in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
                if other != last_text:
                    last_text, last_set = other, shingle_set(other, hashes)
                    last_node = _node(last_set)
                own = shingle_set(mine, hashes)
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                linked.append(den * both >= num * (len(own) + len(last_set) - both)
                              and last_node == b and _node(own) == a)
            yield rows.loc[np.array(linked, bool), ["a", "b"]]

    return run


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, text) of the wanted nodes; a bounded bitmap of their row keys keeps other texts from shuffling."""
    ends = scratch.save(wanted.join(nodes.select("node", "row_key"), "node"), f"{name}-needed")
    slot = F.pmod(F.xxhash64("row_key"), F.lit(ID_FILTER_BITS))
    marked = bitmap_of(ends.select(slot.alias("slot")).distinct(), "slot")
    near = flagged_by(texts.withColumn("slot", slot), marked, "slot", "wanted").where("wanted").drop("slot", "wanted")
    # rows that repeat id and text have one row key: one of them is enough (the join deals by the same key)
    return ends.join(near.dropDuplicates(["row_key"]), "row_key").select("node", "text")


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, ratio: tuple[int, int], miss: float,
           scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the ratio: signature batches first, then full sets."""
    sig = nodes.select("node", "sig")
    judged = (pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a")
              .join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
              .where(_plausible(ratio[0] / ratio[1], miss)("sig_a", "sig_b")).select("a", "b"))
    judged = scratch.save(judged, f"{name}-survivors")
    wanted = judged.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    body = scratch.save(_texts_of(wanted, nodes, texts, scratch, name), f"{name}-texts")
    both = (judged.join(body.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
            .join(body.withColumnsRenamed({"node": "b", "text": "text_b"}), "b"))
    links = scratch.save(both.mapInPandas(_confirm(ratio), "a binary, b binary").distinct(), f"{name}-links")
    scratch.drop(f"{name}-texts")
    return links


# ---- candidates ---------------------------------------------------------------------------------

def _memberships(nodes: DataFrame, per_band: int) -> DataFrame:
    """(bucket, node, members) of buckets with two or more nodes."""
    rows = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(HASHES // per_band - 1))).alias("j"), "sig")
    rows = rows.select(_band(F.col("j"), per_band).alias("bucket"), "node")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(shared, "bucket")


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each bucket's members against its hub, the node that meets most others."""
    reach = members.groupBy("node").agg(F.sum("members").alias("reach"))
    ranked = members.join(reach, "node").groupBy("bucket").agg(F.max(F.struct("reach", "node")).alias("hub"))
    return (members.join(ranked, "bucket").select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
            .where("a <> b").distinct())


def _open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with two or more buckets of over two nodes that still hold several components.

    (A pair at the threshold shares at most one band with probability below ``BAND_MISS``; a bucket of
    two nodes was compared by its star.)"""
    placed = members.where("members > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = (placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("bucket"))
    return (placed.join(split, "bucket").groupBy("node").agg(F.count(F.lit(1)).alias("open"), F.first("root").alias("root"))
            .where("open > 1").select("node", "root"))


def _shingle_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _slices(batches):
        hashes = _WordHashes()
        sets = [shingle_set(t, hashes) for t in rows["text"]]
        mine = [_node(x) == node for x, node in zip(sets, rows["node"], strict=True)]
        out = pd.DataFrame({"node": rows["node"], "root": rows["root"], "shingles": [x.view(np.int64) for x in sets]})
        yield out[mine]


def _rest_pairs(open_nodes: DataFrame, nodes: DataFrame, texts: DataFrame, tested: DataFrame, ratio: tuple[int, int],
                scratch: Scratch) -> DataFrame:
    """Pairs of open nodes in different components that a prefix filter over their shingles leaves."""
    num, den = ratio
    body = _texts_of(open_nodes.select("node"), nodes, texts, scratch, "open").join(open_nodes, "node")
    sets = body.select("node", "text", "root").mapInPandas(_shingle_lists, "node binary, root binary, shingles array<bigint>")
    sets = scratch.save(sets.dropDuplicates(["node"]).withColumn("n", F.size("shingles")), "open-sets")
    values = sets.select("node", "root", "n", F.explode("shingles").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = (values.join(common, "value").groupBy("node", "root", "n")
               .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
               .withColumn("alone", F.col("n") - F.size("own")))
    places = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1 - F.col("alone")
    # a passage that many texts share makes some values hot: their rows are dealt over a grid of cells
    prefixes = keyed(ordered.where(places > 0)
                     .select("node", "root", "n", "alone", F.posexplode(F.slice("own", F.lit(1), places)).alias("i", "v"))
                     .select("node", "root", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("v.value").alias("value")),
                     ["value"], "place")
    rare = prefixes.frame
    # per value, every node outside the value's largest component meets the nodes of other components
    sizes = rare.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("value").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    main = main.select("value", F.col("top.root").alias("main"))
    placed = scratch.save(split_join(rare, main, ["value"], "inner", left_hot=prefixes), "placed")
    left = placed.where(F.col("root") != F.col("main")).select(
        "value", "place", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("left").alias("la"))
    right = placed.select("value", F.col("place").alias("place_b"), "main", F.col("node").alias("b"), F.col("root").alias("rb"),
                          F.col("n").alias("nb"), F.col("left").alias("lb"))
    # from the shared value on, the shorter rest bounds the overlap
    enough = F.least("la", "lb") * (num + den) >= num * (F.col("na") + F.col("nb"))
    once = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
    met = split_join(left, right, ["value"], "inner", left_hot=prefixes, right_hot=replace(prefixes, mark="place_b")).where(enough & once)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def _labelled(docs: DataFrame, id_col: str, text_col: str, ratio: tuple[int, int], miss: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (node, root, component_id) of the nodes of several rows or with links."""
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    signed = scratch.save(signed_documents(docs, id_col, text_col), "signed")
    nodes = scratch.save(signed.where(F.col("node").isNotNull()).groupBy("node")
                         .agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("sig").alias("sig"),
                              F.count(F.lit(1)).alias("copies")), "nodes")
    rows = pick(docs, doc_id=id_col, text=text_col)
    texts = rows.select(_row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
                        text_bytes(F.col("text")).alias("text"))
    members = scratch.save(_memberships(nodes, band_rows(ratio[0] / ratio[1])), "members")
    stars = scratch.save(_star_pairs(members), "stars")
    links = _links(stars, nodes, texts, ratio, miss, scratch, "star")
    roots = scratch.save(components(links, scratch, "star-cc"), "star-roots")
    open_nodes = scratch.save(_open_nodes(members, roots), "open")
    rest = scratch.save(_rest_pairs(open_nodes, nodes, texts, stars, ratio, scratch), "rest")
    links = links.union(_links(rest, nodes, texts, ratio, miss, scratch, "rest"))
    roots = scratch.save(components(links, scratch, "cc"), "roots")

    grouped = nodes.where("copies > 1").select("node").union(roots.select("node")).distinct().join(roots, "node", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "node")).join(nodes.select("node", "doc_id"), "node")
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return signed, scratch.save(grouped.select("node", "root").join(least, "root").select("node", "root", "component_id"), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    ratio: tuple[int, int] = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    signed, labels = _labelled(docs, id_col, text_col, ratio, miss)
    out = signed.select("doc_id", "n_shingles", "node").join(labels.select("node", "component_id"), "node", "left")
    component = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         ratio: tuple[int, int] = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The input rows that stay (of each component one row with the smallest id), all columns as they came.

    The row keys to drop are marked in a bounded bitmap; rows it clears never shuffle."""
    scratch = Scratch(docs.sparkSession, "near-dedup-drop")
    signed, labels = _labelled(docs, id_col, text_col, ratio, miss)
    grouped = scratch.save(signed.select("node", "doc_id", "row_key").join(labels.select("node", "root"), "node")
                           .groupBy("root", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    heads = grouped.groupBy("root").agg(first.alias("head")).select(F.col("head.row_key").alias("row_key"), F.lit(True).alias("head"))
    # a head that several equal rows share stays once
    marks = scratch.save(grouped.join(heads, "row_key", "left").select(F.col("row_key").alias("marked_key"), F.col("head").isNull().alias("lost"), "n")
                         .where("lost or n > 1").select("marked_key", "lost"), "marks")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_FILTER_BITS))
    marked = scratch.save(bitmap_of(marks.select(slot("marked_key").alias("slot")).distinct(), "slot"), "marked")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select("row", _row_key(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")).alias("row_key"))
    rows = flagged_by(rows.withColumn("row_slot", slot("row_key")), marked, "row_slot", "maybe_marked")
    clear = rows.where(~F.col("maybe_marked")).select("row.*")
    checked = rows.where("maybe_marked").join(marks, F.col("row_key") == F.col("marked_key"), "left")
    stay = checked.where("lost is null").select("row.*")
    once = checked.where("not lost").select("row", "row_key").dropDuplicates(["row_key"]).select("row.*")
    return clear.unionByName(stay).unionByName(once)
