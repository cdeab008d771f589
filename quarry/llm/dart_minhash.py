"""Operator 10: near-duplicate documents by DartMinHash and banding.

A document is the weighted set of its shingles of five words (weight 1, or the number of occurrences with
``counted``). Every shingle owns a random scatter of darts over the plane of weight and rank, the same in every
document, drawn cell by cell from hashes. A document throws the darts that land below its shingles' weights and below a
rank chosen so that some ``K ln K`` darts are expected, each marked with one of ``K`` coordinates; the lowest dart of each coordinate
is the signature, and two documents agree in a coordinate with a probability that is their weighted similarity. The work is in proportion to the set plus
``K ln K``, not to their product. Bands of the signature are joined.

Documents with equal sets are one class before any joining. Twice, one class of every bucket of a band asks all others there, and the links
found are contracted to components at once: a group of near copies, however large, is one component after that, for pairs in proportion
to its members. It is the class whose buckets are the fullest: of near copies those that lie in the middle are near to most others, and few are apart after they have asked.
What is left are buckets whose classes are of several components. Of those classes, all that are still apart are compared
by prefixes: among sets ordered from the rarest element on, two of similarity ``t`` share one of the first ``n - ceil(t n) + 1`` elements of each. So classes
meet by the elements of their prefixes; within an element's list those outside its largest component ask all others, and two that share several elements
meet in the list of the least of them alone. Members that are unlike
all others have rare elements of their own there, and do not meet: no link of two classes that share a band is lost.
A row of a list carries, of the lists its class is in, those up to its own alone; lists whose classes are all of one component are left out before, and elements
are known there by half their bits: two that are taken for one share a list, so that more classes meet, and none is missed.

Pairs are compared by their whole sets, but for those that the sizes or the parity maps of the sets rule out (both bounds are exact).

Edge cases: null and empty texts, and texts without a word, have no shingle and are groups of their own; a text of fewer than five
words has one shingle, all of it; repeated rows and copies share a class; a null key never names a group unless all keys in it
are null; texts of any length are shingled whole; columns other than key and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, broadcast_if_small, discard, table, text_of, written

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**24 > 0.9999.
BANDS, ROWS = 24, 5
#: Ranks below 2**-LOW are one cell; a set of more than K ln K * 2**LOW elements would throw a few darts too many.
LOW = 16

#: Bits of the parity map: of each of so many cells, whether the number of elements in it is odd.
PARITY = 1024
#: Members of one bucket or list that one task compares with those that ask.
SALTED = 2000

_WORD = re.compile(r"\w+")
U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


class Shingler:
    """Shingles of texts as 64-bit hashes; hashes of words are kept, at most ``cache_words`` of them."""

    def __init__(self, size: int = SHINGLE, cache_words: int = 500_000) -> None:
        self.size, self.cache_words = size, cache_words
        self.cache: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The different shingles, sorted, and how often each occurs."""
        found = _WORD.findall(text.lower())
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        cache = self.cache
        if new := set(found).difference(cache):
            if len(cache) + len(new) > self.cache_words:
                cache.clear()
                new = set(found)
            for w in new:
                cache[w] = xxhash.xxh64_intdigest(w)
        h = np.array([cache[w] for w in found], np.uint64)
        n = min(self.size, len(h))
        with np.errstate(over="ignore"):
            s = np.full(len(h) - n + 1, U64(n), np.uint64)
            for k in range(n):
                s = mix(s * _GOLD + h[k : len(h) - n + 1 + k])
        return np.unique(s, return_counts=True)


def _cells(top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of rank up to ``2**top``: number, lower end and width; none is wider than one."""
    low, width = [0.0], [2.0**-LOW]
    for p in range(-LOW, top):
        parts = max(1, int(2.0**p))
        low += [2.0**p + k * (2.0**p / parts) for k in range(parts)]
        width += [2.0**p / parts] * parts
    with np.errstate(over="ignore"):
        number = mix(np.arange(1, len(low) + 1, dtype=np.uint64) * _GOLD)
    return number, np.array(low), np.array(width)


class DartMinHash:
    def __init__(self, k: int = BANDS * ROWS) -> None:
        self.k, self.darts = k, k * math.log(k) + 2 * k
        self.cells: dict[int, tuple] = {}

    def _of(self, top: int) -> tuple:
        if top not in self.cells:
            number, low, width = _cells(top)
            tail, term = [], np.exp(-width)
            below = term.copy()
            scale, n = float(2**53), 1
            while not tail or (tail[-1] < U64(2**53)).any():  # the distribution of the number of darts in a cell, to its end
                tail.append((below * scale).astype(np.uint64) if n < 64 else np.full(len(width), U64(2**53)))
                term = term * width / n
                below = np.minimum(below + term, 1.0)
                n += 1
            self.cells[top] = number, low, width, tail
        return self.cells[top]

    def signature(self, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The identity of the lowest dart of each coordinate. ``weights``: positive; 1 for each by default."""
        limit = np.ones(len(elements))
        if weights is not None:  # a region of weight w is floor(w) whole squares and a part of one
            whole = np.ceil(weights).astype(np.int64)
            at = np.repeat(np.arange(len(elements)), whole)
            level = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
            limit = np.minimum(1.0, weights[at] - level)
            with np.errstate(over="ignore"):
                elements = np.where(level == 0, elements[at], mix(elements[at] + level.astype(np.uint64) * _M2))
        top = max(-LOW, math.ceil(math.log2(self.darts / max(limit.sum(), 1e-9))))
        while True:
            out, found = self._throw(elements, limit, top)
            if found.all():
                return out
            top += 1

    def _throw(self, elements: np.ndarray, limit: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        number, low, width, tails = self._of(top)
        ranks, marks, names = [], [], []
        step = max(1, 2_000_000 // len(number))
        for a in range(0, len(elements), step):
            with np.errstate(over="ignore"):
                u = mix(elements[a : a + step, None] + number[None])
            draw = u >> U64(11)
            at = np.flatnonzero(draw.ravel() >= np.broadcast_to(tails[0], draw.shape).ravel())
            for n, tail in enumerate(tails):
                cell = at % len(number)
                if n:
                    keep = draw.ravel()[at] >= tail[cell]
                    at, cell = at[keep], cell[keep]
                if not len(at):
                    break
                with np.errstate(over="ignore"):
                    dart = mix(u.ravel()[at] + U64(n + 1) * _M1)
                    other = mix(dart + _GOLD)
                inside = (mix(other) >> U64(11)).astype(np.float64) / 2.0**53 <= limit[a + at // len(number)]
                rank = low[cell] + width[cell] * ((other >> U64(11)).astype(np.float64) / 2.0**53)
                ranks.append(rank[inside])
                marks.append((dart % U64(self.k)).astype(np.int64)[inside])
                names.append(dart[inside])
        out, found = np.zeros(self.k, np.uint64), np.zeros(self.k, bool)
        if ranks:
            rank, mark, name = map(np.concatenate, (ranks, marks, names))
            order = np.lexsort((name, rank))[::-1]  # the lowest is written last
            out[mark[order]] = name[order]
            found[mark] = True
        return out, found


def bands(signature: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(n_bands, -1)
    with np.errstate(over="ignore"):
        h = mix(np.arange(1, n_bands + 1, dtype=np.uint64) * _M2)
        for k in range(rows.shape[1]):
            h = mix(h * _GOLD + rows[:, k])
    return h.view(np.int64)


def multiset(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set whose similarities are the weighted ones of ``elements`` with ``counts``: an element that occurs n times is n elements."""
    times = counts.astype(np.int64)
    level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        of = np.repeat(elements, times)
        return np.unique(np.where(level == 0, of, mix(of + level.astype(np.uint64) * _M2)))


def parity(elements: np.ndarray) -> np.ndarray:
    """The parity map of a set, and its size as the last word."""
    cells = np.bincount((elements >> U64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.append(np.packbits(cells.astype(np.uint8)).view(np.int64), len(elements))


def may_be_near(a: str, b: str, threshold: float) -> Column:
    """Whether two columns of parity maps leave it open that the sets are near.

    The smaller of two sets at similarity ``s`` has at least ``s`` of the elements of the larger. Elements that only one of them
    has are at most ``(1 - s) / (1 + s)`` of both sizes together, and each turns one bit of the map. Both bounds are exact.
    """
    words = PARITY // 64
    m, n = F.col(a)[words], F.col(b)[words]
    bits = F.lit(0)
    for w in range(words):
        bits = bits + F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w]))
    return (F.least(m, n) >= threshold * F.greatest(m, n) - 1e-6) & (bits * (1 + threshold) <= (m + n) * (1 - threshold) + 1e-6)


def sign_documents(docs: DataFrame, key: str, text: str, counted: bool) -> DataFrame:
    """``k, f, class, bands, parity``: class is a digest of the document's set (null without words), f a hash of its text."""

    def make():
        shingler, darts = Shingler(), DartMinHash()
        last: dict[bytes, list] = {}

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            classes, rows, maps = [], [], []
            for t in b.column(2).to_pylist():
                s, n = shingler(t)
                if not len(s):
                    classes.append(None)
                    rows.append(None)
                    maps.append(None)
                    continue
                c = xxhash.xxh3_128_digest(s.tobytes() + (n.tobytes() if counted else b""))
                if c not in last:
                    if len(last) > 2000:
                        last.clear()
                    signature = darts.signature(s, n.astype(float) if counted else None)
                    last[c] = bands(signature).tolist(), parity(multiset(s, n) if counted else s).tolist()
                classes.append(c)
                rows.append(last[c][0])
                maps.append(last[c][1])
            lists = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(classes, pa.binary()), pa.array(rows, lists), pa.array(maps, lists)], ["k", "f", "class", "bands", "parity"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("f"), text_of(text).alias("t")), make, f"k {kind}, f long, class binary, bands array<long>, parity array<long>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets given as sorted elements."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("eb"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            part = lambda name: [x.values.to_numpy() for x in batch.column(name)]
            near = [similarity(ea, eb) >= threshold for ea, eb in zip(part("ea"), part("eb"), strict=True)]
            return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        return each

    return arrow_map(pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "eb"), make, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of each connected component of ``links`` (``a``, ``b``); nodes without links are absent.

    Each round hooks the root of every node onto the least root among its neighbours' and then shortcuts; rounds end when nothing
    changes. Labels are written between rounds, so that neither lineage nor a lost executor makes them start again.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(edges, "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        seen = edges.join(labels.withColumnsRenamed({"node": "b", "root": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "other").alias("root"))
        # The root itself learns of the least label that any of its nodes has met.
        roots = hooked.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("best"))
        hooked = hooked.join(roots, "node", "left").select("node", "old", F.least("root", F.coalesce("best", "root")).alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = written(hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        changed = after.where(F.col("old") != F.col("root")).limit(1).count()
        discard(labels)
        path, labels = after._written_to, after.select("node", "root")
        labels._written_to = path
        if not changed:
            discard(edges)
            return labels


def _pairs(members: DataFrame, asking: DataFrame, by: str, threshold: float, once: bool = False) -> DataFrame:
    """``a, b``: each class that asks (``by, b, root_b, parity_b, n``) with all members (``by, class, root, parity, n``) of its list that are of
    another component and may be near. A list is dealt out over one task for each ``SALTED`` of its ``n`` members.

    ``once``: members and those that ask hold the ``prefix`` of lists they are in, as far as this one, and all outside the largest component (``outside``) ask. Two then meet in the first of
    their lists alone; of two that both ask, the lesser class is asked.
    """
    parts = F.ceil(F.col("n") / SALTED).cast("int")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("class"), parts).cast("int")).drop("n")
    asks = asking.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    near = (F.col("root") != F.col("root_b")) & may_be_near("parity", "parity_b", threshold)
    if once:
        near = (~F.col("outside") | (F.col("class") < F.col("b"))) & near & (F.array_min(F.array_intersect("prefix", "prefix_b")) == F.col(by))
    met = dealt.join(asks, [by, "salt"]).where(near)
    pairs = met.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b"))
    return pairs if once else pairs.distinct()


def _mains(placed: DataFrame, by: str, turn: int = 0) -> DataFrame:
    """``by, n, main, first``: of each list with classes of several components its size, its largest component, and a class that shares much with others: the one of
    most ``weight``, from the second turn on with up to a quarter more by a hash, so that another one has its turn."""
    key = F.col("weight") * (1 + F.pmod(F.xxhash64("class", F.lit(turn)), 1024) / 4096) if turn else F.col("weight").cast("double")
    parts = placed.groupBy(by, "root").agg(F.count("*").alias("n"), F.max(F.struct(key.alias("w"), "class")).alias("top"))
    out = parts.groupBy(by).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.max("top")["class"].alias("first"))
    return out.where(F.col("n") > F.col("main.n")).select(by, "n", F.col("main.root").alias("main"), "first")


def _prefixes(apart: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``no, prefix``: of each set of ``apart`` (written: ``no, class, parity`` and more) its prefix, without elements that one set alone has.

    An element is known by its upper 32 bits. The order is one of those numbers, and sets that share an element of their prefixes share its number.
    """
    number = F.transform("elements", lambda e: F.shiftright(e, 32).cast("int"))
    held = sets.join(broadcast_if_small(apart.select("class", "no")), "class").select("no", F.explode(number).alias("e"))
    often = held.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(often, "e").join(apart.select("no", F.col("parity")[PARITY // 64].alias("size")), "no")
    own = Window.partitionBy("no")
    # Elements of one set alone stand first in its order; they are counted, not listed.
    alone = F.col("size") - F.count("*").over(own)
    prefix = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-6) + 1
    ranked = ranked.withColumns({"rank": F.row_number().over(own.orderBy("df", "e")), "room": prefix - alone}).where(F.col("rank") <= F.col("room"))
    return ranked.groupBy("no").agg(F.collect_set("e").alias("prefix"))


def _lists(prefixes: DataFrame, apart: DataFrame) -> DataFrame:
    """``class, root, parity, lists``: of each set of ``apart`` the elements of its prefix whose lists hold several components, in order (``e, n, outside``): the
    size of the list, and whether the set is outside its largest component."""
    placed = prefixes.join(apart, "no").select(F.explode("prefix").alias("e"), F.col("no").alias("class"), "root", "weight")
    in_list = placed.join(_mains(placed, "e").select("e", "n", "main"), "e").select(F.col("class").alias("no"), F.struct("e", "n", (F.col("root") != F.col("main")).alias("outside")).alias("list"))
    return in_list.groupBy("no").agg(F.sort_array(F.collect_list("list")).alias("lists")).join(apart, "no").select("class", "root", "parity", "lists")


def _dealt(lists: DataFrame) -> DataFrame:
    """``e, n, outside, class, root, parity, prefix``: a row for each list of each set; ``prefix`` goes no further than its own list, as it is asked for the first one shared."""
    rows = lists.select("class", "root", "parity", F.col("lists.e").alias("all"), F.posexplode("lists").alias("at", "list"))
    return rows.select("list.*", "class", "root", "parity", F.slice("all", F.lit(1), F.col("at") + 1).alias("prefix"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """``key, fingerprint, class_id, first_fingerprint``: for each row the least key of its group of near copies.

    The group's first document is the one with that key and, among rows with the same key, the ``first_fingerprint`` of its text.
    """
    signs = written(sign_documents(docs, key, text, counted), "signs")
    first = F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("f").alias("f")))
    classes = written(signs.where(F.col("class").isNotNull()).groupBy("class").agg(first.alias("first"), F.any_value("bands").alias("bands"), F.any_value("parity").alias("parity")), "classes")
    signed = written(signs.select("k", "f", "class"), "signed")
    discard(signs)
    keys = classes.select("class", F.explode("bands").alias("band"))
    # Only buckets with two classes or more go on.
    shared = written(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = written(keys.join(broadcast_if_small(shared), "band"), "members")
    fullest = members.groupBy("class").agg(F.sum("n").alias("weight"))
    asked = written(fullest.join(classes, "class").select("class", "weight", "parity", F.col("first.k").alias("k1"), F.col("first.f").alias("f1")), "asked")
    firsts = written(classes.select("class", "first"), "firsts")
    discard(shared, classes)

    def make():
        shingler = Shingler()

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingler(t) for t in b.column("t").to_pylist()]
            elements = [(multiset(s, n) if counted else s).view(np.int64) for s, n in found]
            return pa.RecordBatch.from_arrays([b.column("class"), pa.array(elements, pa.list_(pa.int64()))], ["class", "elements"])

        return each

    texts = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).withColumn("f", F.xxhash64("t"))
    asked_texts = texts.join(broadcast_if_small(asked.select("class", "k1", "f1")), F.col("k").eqNullSafe(F.col("k1")) & (F.col("f") == F.col("f1"))).select("class", "t").dropDuplicates(["class"])
    sets = written(arrow_map(asked_texts, make, "class binary, elements array<long>"), "sets")
    roots = written(asked.select("class", F.col("class").alias("root"), "parity", "weight"), "roots")
    discard(asked)
    waiting, compared = members, None

    def contracted(pairs: DataFrame, roots: DataFrame, compared: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Components after the links among pairs that were not compared before, and all pairs compared."""
        pairs = written(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        # Sets are long and few of them are in pairs: the others are left out before any is shuffled.
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ends")
        links = _links(pairs, sets.join(broadcast_if_small(ends), "class", "left_semi"), threshold)
        of_a, of_b = roots.select(F.col("class").alias("a"), F.col("root").alias("ra")), roots.select(F.col("class").alias("b"), F.col("root").alias("rb"))
        merged = components(links.join(of_a, "a").join(of_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        now = written(roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("class", F.coalesce("now", "root").alias("root"), "parity", "weight"), "roots")
        discard(merged, roots, ends)
        return now, pairs if compared is None else compared.unionByName(pairs)

    def apart(waiting: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
        """Members of buckets with several components: ``band, class, root, parity, weight, n, main, first``."""
        placed = waiting.select("band", "class").join(roots, "class")
        return placed.join(_mains(placed, "band", turn), "band")

    for turn in range(2):
        placed = written(apart(waiting, roots, turn), "placed")
        discard(waiting)
        asking = placed.where(F.col("class") == F.col("first")).select("band", F.col("class").alias("b"), F.col("root").alias("root_b"), F.col("parity").alias("parity_b"), "n")
        roots, compared = contracted(_pairs(placed.select("band", "class", "root", "parity", "n"), asking, "band", threshold), roots, compared)
        waiting = placed
    left = written(apart(waiting, roots, 2).select("class", "root", "parity", "weight").dropDuplicates(["class"]).withColumn("no", F.monotonically_increasing_id()), "apart")
    discard(waiting)
    prefixes = written(_prefixes(left, sets, threshold), "prefixes")
    lists = written(_lists(prefixes, left), "lists")
    discard(prefixes, left)
    listed = _dealt(lists)
    asking = listed.where("outside").select("e", F.col("class").alias("b"), F.col("root").alias("root_b"), F.col("parity").alias("parity_b"), F.col("prefix").alias("prefix_b"), "n")
    roots, _ = contracted(_pairs(listed, asking, "e", threshold, once=True), roots, compared)
    discard(lists, sets)
    named = firsts.select("class", "first").join(roots.select("class", "root"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "first")
    group = named.groupBy("root").agg(F.min("first").alias("group"))
    named = named.join(group, "root").select("class", F.col("group.k").alias("class_id"), F.col("group.f").alias("first_fingerprint"))
    out = signed.select("k", "f", "class").join(named, "class", "left")
    alone = F.col("class").isNull()
    return out.select(F.col("k").alias(key), F.col("f").alias("fingerprint"), F.when(alone, F.col("k")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("f")).otherwise(F.col("first_fingerprint")).alias("first_fingerprint"))


def first_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The first document of each group of near copies, with its own columns; of repeated rows one; texts without words all stay."""
    found = near_duplicates(docs, key, text, threshold)
    same = F.col("class_id").eqNullSafe(F.col(key)) & (F.col("first_fingerprint") == F.col("fingerprint"))
    firsts = found.where(same).select(F.col(key).alias("first_k"), F.col("fingerprint").alias("first_f")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("f"), text_of(text).rlike(r"(?U)\w").alias("worded"))
    kept = whole.where("worded").join(firsts, F.col("k").eqNullSafe(F.col("first_k")) & (F.col("f") == F.col("first_f")), "left_semi").dropDuplicates(["k", "f"])
    return kept.select("row.*").unionAll(whole.where("NOT worded").select("row.*"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
