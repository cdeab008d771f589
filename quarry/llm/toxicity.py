"""Operator 2: toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings sums, over the subsequences of three and four characters that both contain, the product of
their weights; a subsequence loses the factor ``DECAY`` for every character it skips. An insult with characters put in
between or taken apart so still shares most of its weight with the plain one. Strings are words (folded to base letters,
digits and signs that stand for letters read as such), cut into windows of ``WINDOW`` characters.

Landmarks are a subset of the training windows. A linear machine over the Nyström features of a word is, written out, a
weighted sum of its kernel values with the landmarks, and that is one weight for each subsequence of the landmarks: the
trained machine is a table over subsequences, and scoring a word sums its entries, with no landmark left to compare with.

The machine is trained on labelled sentences, as bags of windows. A sentence has the label of its document. All windows of clean
sentences are negative. Of a toxic document most sentences are harmless, so that each sentence puts forward one word, its witness: at first the
one whose beginning only toxic documents hold (by a likelihood ratio over the documents that hold such a beginning), afterwards
the one that the last machine finds worst. Sentences without a witness on the positive side are left out. Negatives are mined again with each
machine. A sentence scores as its worst word and a document as its worst sentence, calibrated by a logistic curve, in which both labels
count as often as they occur, on a fifth of the documents that is kept from training.

Training uses a bounded sample (:class:`Training`) and runs in one task of an executor; everything else covers all rows.

Edge cases: null and empty texts, and texts without a word, score as a text without a toxic word; with fewer than two documents of
either label every score is 0; rows with repeated keys get a row each; labels that are null count for nothing, and of several
labels of one key the largest counts; texts and words of any length are scored whole, in batches of windows; columns other than key and text are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import in_blocks
from quarry.llm.common import arrow_map, crc_fold, in_one_task, sampled, table, text_of

DECAY, WINDOW, SPARE = 0.6, 14, 2
#: Windows that are worked on together.
BATCH = 8192
#: Codes: 0 beyond the end, 1-26 letters, 27 either end of a word, 28 other letters, 29 other signs.
BASE = 30
#: Fixed: signs read as the letters that they stand for in disguised words.
STAND_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: For subsequences of each length: offsets behind the first character and the weight of the skips.
PATTERNS = [((0, *rest), DECAY ** (rest[-1] - n + 1)) for n in (3, 4) for rest in combinations(range(1, n + SPARE), n - 1)]
SPAN = max(p[-1] for p, _ in PATTERNS) + 1
#: Where sentences end.
STOP = re.compile(r"(?<=[.!?])\s+|\n+")
#: Words written as single characters apart from each other.
SPACED = re.compile(r"(?<!\S)(?:\S[ ._*-]){3,}\S(?!\S)")


def _code(c: str) -> int:
    c = STAND_FOR.get(c, c)
    if not ("a" <= c <= "z"):
        c = unicodedata.normalize("NFKD", c)[:1]
    return ord(c) - 96 if "a" <= c <= "z" else 28 if c.isalpha() else 29


class _Codes(dict):
    def __missing__(self, c: str) -> str:
        self[c] = out = chr(_code(chr(c)))
        return out


_CODES = _Codes()


def words(text: str) -> set[str]:
    """The different words of a text, lower-cased; spaced-out ones also put together."""
    low = text.lower()
    found = set(low.split())
    if (m := SPACED.search(low)) is not None:
        found.update(re.sub(r"[ ._*-]", "", m[0]) for m in SPACED.finditer(low, m.start()))
    return found


def sentences(text: str) -> list[set[str]]:
    """The different words of each sentence of a text; sentences without a word are left out."""
    return [found for part in STOP.split(text) if (found := words(part))]


def _plain(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}#*%&|<>")


def _windows(word: str, first: bool) -> Iterator[str]:
    s = "\x1b" + _plain(word).translate(_CODES) + "\x1b"
    for at in range(0, 1 if first else max(1, len(s) - WINDOW + 1), 2):
        yield s[at : at + WINDOW] if len(s) - at > WINDOW + 1 else s[at : at + WINDOW + 1]


def windows(batch: Iterable[str], first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of all windows of words, or of the first of each (one row each, padded for the patterns), and the number of the word each is
    from, in parts of ``BATCH`` windows: a word of any length takes no more room than others."""
    rows: list[str] = []
    of: list[int] = []

    def part() -> tuple[np.ndarray, np.ndarray]:
        flat = "".join([r.ljust(WINDOW + 1 + SPAN, "\0") for r in rows]).encode("latin-1")
        return np.frombuffer(flat, np.uint8).reshape(len(rows), -1).astype(np.int32), np.array(of, np.int64)

    for k, word in enumerate(batch):
        for row in _windows(word, first):
            rows.append(row)
            of.append(k)
            if len(rows) == BATCH:
                yield part()
                rows, of = [], []
    if rows:
        yield part()


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subsequences in each window, ``[windows, places]`` (0: none), and their weights, ``[places]``."""
    columns, weights = [], []
    width = codes.shape[1] - SPAN
    for pattern, weight in PATTERNS:
        index = np.zeros((len(codes), width), np.int32)
        there = np.ones((len(codes), width), bool)
        for o in pattern:
            part = codes[:, o : o + width]
            index = index * BASE + part
            there &= part > 0
        columns.append(np.where(there, index + (BASE**4 if len(pattern) == 3 else 0), 0))
        weights += [weight] * width
    return np.concatenate(columns, axis=1), np.array(weights, np.float32)


SIZE = BASE**4 + BASE**3


class SubsequenceMachine:
    def __init__(self, weights: np.ndarray, constant: float, slope: float = 1.0, offset: float = 0.0, floor: float = 0.0) -> None:
        self.weights, self.constant = weights.astype(np.float32), constant
        self.slope, self.offset, self.floor = slope, offset, floor

    def margins(self, batch: list[str]) -> np.ndarray:
        """The worst window of each word."""
        out = np.full(len(batch), -np.inf, np.float32)
        for codes, of in windows(batch):
            index, weight = subsequences(codes)
            np.maximum.at(out, of, (self.weights[index] @ weight) / norms(codes))
        return out + np.float32(self.constant)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return self.floor + (1 - self.floor) / (1.0 + np.exp(-np.clip(self.slope * np.clip(margin, -3, 3) + self.offset, -60, 60)))


def _by_length() -> np.ndarray:
    codes = np.zeros((WINDOW + 2, WINDOW + 1 + SPAN), np.int32)
    for n in range(WINDOW + 2):
        codes[n, :n] = 1
    index, weight = subsequences(codes)
    return np.sqrt(np.maximum(((index > 0) * weight**2).sum(1), 1.0)).astype(np.float32)


_NORMS = _by_length()


def norms(codes: np.ndarray) -> np.ndarray:
    """What scales the kernel: the length of the feature vector of a window of so many different characters."""
    return _NORMS[(codes > 0).sum(1)]


def _rows(batch: list[str], all_windows: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse kernel features of the windows of words, or of the first window of each."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for codes, _ in windows(batch, not all_windows):
        index, weight = subsequences(codes)
        for row, norm in zip(index, norms(codes), strict=True):
            hit = row > 0
            u, inverse = np.unique(row[hit], return_inverse=True)
            out.append((u, np.bincount(inverse, weight[hit], minlength=len(u)).astype(np.float32) / norm))
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 40) -> np.ndarray:
    """Linear L2-loss machine by Newton steps on the rows inside the margin; the last feature is the constant one."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        slack = np.maximum(1 - y * (x @ w.astype(x.dtype)), 0.0)
        return float(0.5 * w @ w + (cost * slack * slack).sum()), slack > 0

    now, inside = loss(w)
    for _ in range(steps):
        matrix, aim = np.eye(len(w)), np.zeros(len(w))
        for at in range(0, len(x), 4096):  # in parts, so that no second copy of all rows is made
            part = x[at : at + 4096][inside[at : at + 4096]].astype(np.float64)
            c = 2 * cost[at : at + 4096][inside[at : at + 4096]]
            matrix += (part * c[:, None]).T @ part
            aim += part.T @ (c * y[at : at + 4096][inside[at : at + 4096]])
        step, size = np.linalg.solve(matrix, aim) - w, 1.0
        while size > 1e-3:
            then, there = loss(w + size * step)
            if then < now:
                break
            size /= 2
        else:
            break
        done = now - then < 1e-6 * now
        w, now, inside = w + size * step, then, there
        if done:
            break
    return w


def _platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and floor of the logistic curve with the least weighted log loss, on a grid of slopes, turning points and floors.

    The floor is the share of documents that are labelled although nothing in them says so: without it a few of them would flatten the curve.
    """
    best = (np.inf, 1.0, 0.0, 0.0)
    for floor in (0.0, 0.003, 0.01, 0.02, 0.05, 0.1):
        for slope in np.geomspace(1, 40, 24):
            for turn in np.linspace(-1.5, 1.5, 61):
                p = floor + (1 - floor) / (1 + np.exp(-np.clip(slope * (margin - turn), -30, 30)))
                p = np.clip(np.where(label == 1, p, 1 - p), 1e-9, 1)
                best = min(best, (-float((weight * np.log(p)).sum()), float(slope), float(-slope * turn), floor))
    return best[1:]


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and of the machine."""

    #: Documents of each label, and characters of them in all.
    per_class: int = 3000
    chars: int = 40_000_000
    #: Words put forward by sentences, at most, the strongest.
    witnesses: int = 2500
    #: Of them, those that are also shown disguised: taken apart, or with a sign put in.
    disguised: int = 80
    #: Windows that the Nyström features compare with; negative words; machines trained one after the other.
    landmarks: int = 500
    negatives: int = 12_000
    rounds: int = 3
    #: Every so many-th document is kept from training, for the curve.
    kept: int = 5
    #: The likelihood ratio statistic from which a beginning speaks for the label.
    least: float = 10.0
    seed: int = 5


#: The sentences of a document, each as its different words, and the document's label.
Labelled = tuple[list[list[str]], int]


def without_copies(docs: list[Labelled]) -> list[Labelled]:
    """One document of each group of near copies: in copies of a toxic document any word looks like a witness.

    Documents of a label that share the least of three hashes of their words, and half of the words that either has, are copies.
    """
    crc: dict[str, int] = {}
    for factor in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35):
        first: dict[tuple[int, int], set[str]] = {}
        left = []
        for parts, label in docs:
            own = {w for part in parts for w in part}
            if own:
                for w in own.difference(crc):
                    crc[w] = zlib.crc32(w.encode())
                known = first.setdefault((label, min([crc[w] * factor & 0xFFFFFFFF for w in own])), own)
                if known is not own and 2 * len(own & known) >= len(own | known):
                    continue
            left.append((parts, label))
        docs = left
    return docs


def strong_beginnings(toxic: list[set[str]], clean: list[set[str]], least: float) -> dict[str, float]:
    """Beginnings of words, of four characters or more, that speak for the label, and how strongly: by the
    likelihood ratio statistic of the documents of either label that hold a beginning."""
    in_toxic: dict[str, int] = {}
    in_clean: dict[str, int] = {}
    for counts, group in ((in_toxic, toxic), (in_clean, clean)):
        for d in group:
            starts = {w[:k] for w in map(_plain, d) for k in range(4, min(len(w), 12) + 1)}
            if counts is in_clean:
                starts = {x for x in starts if x in in_toxic}
            for x in starts:
                counts[x] = counts.get(x, 0) + 1
    n1, n0 = len(toxic), len(clean)

    def strength(x: str) -> float:
        k1, k0 = in_toxic[x], in_clean.get(x, 0)
        if k1 < 2 or k1 * n0 <= 12 * k0 * n1:
            return 0.0
        p = (k1 + k0) / (n1 + n0)
        part = lambda k, n: (k * np.log(k / (n * p)) if k else 0.0) + ((n - k) * np.log((n - k) / (n * (1 - p))) if n > k else 0.0)
        return 2.0 * (part(k1, n1) + part(k0, n0))

    return {x: v for x in in_toxic if (v := strength(x)) > least}


def put_forward(sentences: list[list[str]], worth: dict[str, float], most: int) -> list[tuple[str, int]]:
    """The witnesses of sentences, each the word of its sentence that is worth most (and more than nothing), with the number of sentences
    that put it forward: the worthiest ``most`` of them, in the order of that number."""
    held: dict[str, int] = {}
    for part in sentences:
        best = max(((worth[w], w) for w in map(_plain, part) if worth.get(w, 0.0) > 0), default=None)
        if best is not None:
            held[best[1]] = held.get(best[1], 0) + 1
    chosen = sorted(held, key=lambda w: (-worth[w], w))[:most]
    return sorted([(w, held[w]) for w in chosen], key=lambda x: (-x[1], x[0]))


def _nystroem(features: list[tuple[np.ndarray, np.ndarray]], marks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nyström features of all rows (and a constant one); the landmarks' subsequences, their weights, and the root of the kernel matrix."""
    own = np.unique(np.concatenate([features[i][0] for i in marks]))
    dense = np.zeros((len(marks), len(own)), np.float32)
    for k, i in enumerate(marks):
        dense[k, np.searchsorted(own, features[i][0])] = features[i][1]
    values, vectors = np.linalg.eigh((dense @ dense.T).astype(np.float64))
    good = values > 1e-5 * values.max()
    root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    by_subsequence = np.ascontiguousarray(dense.T)
    x = np.ones((len(features), root.shape[1] + 1), np.float32)
    for k, (u, value) in enumerate(features):
        at = np.minimum(np.searchsorted(own, u), len(own) - 1)
        hit = own[at] == u
        x[k, :-1] = (value[hit] @ by_subsequence[at[hit]]) @ root
    return x, own, dense, root


def train(docs: list[Labelled], share: float | None = None, bounds: Training = Training()) -> SubsequenceMachine | None:
    """A machine from labelled sentences; None without two documents of either label or without a witness.

    ``share``: of toxic documents where the machine is used; that of ``docs`` by default.
    """
    draw, docs = np.random.default_rng(bounds.seed), without_copies(docs)
    groups = [[d for d, y in docs if y == label] for label in (1, 0)]
    if min(map(len, groups)) < 2:
        return None
    share = len(groups[0]) / len(docs) if share is None else share
    kept = [g[:: bounds.kept] for g in groups]
    toxic, clean = ([d for k, d in enumerate(g) if k % bounds.kept] for g in groups)
    words_of = lambda d: {w for part in d for w in part}
    ordinary = sorted(set().union(*map(words_of, clean)))
    harmless = {_plain(w) for w in ordinary}
    beginnings = strong_beginnings(list(map(words_of, toxic)), list(map(words_of, clean)), bounds.least)
    suspects = sorted({p for d in toxic for p in map(_plain, words_of(d))} - harmless)
    bags = [part for d in toxic for part in d]
    worth = {p: v for p in suspects if (v := max((beginnings.get(p[:k], 0.0) for k in range(4, min(len(p), 12) + 1)), default=0.0)) > 0}
    found = put_forward(bags, worth, bounds.witnesses)
    if not found:
        return None
    mined: set[str] = set()
    machine = None
    for _ in range(bounds.rounds):
        if machine is not None:
            worth = dict(zip(suspects, machine.margins(suspects).tolist(), strict=True))
            found = put_forward(bags, worth, bounds.witnesses) or found
            margin = machine.margins(ordinary)
            mined.update(ordinary[i] for i in np.argsort(-margin, kind="stable")[: bounds.negatives // 3] if margin[i] > -1)
        else:  # words that begin or end like a witness, and any
            near = {w[:2] for w, _ in found} | {w[-3:] for w, _ in found}
            close = [w for w in ordinary if w[:2] in near or w[-3:] in near]
            for those in (close, ordinary):
                mined.update(those[i] for i in draw.choice(len(those), min(len(those), bounds.negatives // 2), replace=False))
        frequent = found[: bounds.disguised]
        apart = [("-".join(w), n / 4) for w, n in frequent] + [(f"{w[:k]}*{w[k:]}", n / 4) for w, n in frequent for k in (2, len(w) // 2)]
        shown = frequent + apart + found[bounds.disguised :]
        features = _rows([w for w, _ in shown], False)
        n_pos = len(features)
        features += _rows(sorted(mined), True)
        # Landmarks: the most frequent witnesses and some of the rest, and negatives to hold against them.
        third = bounds.landmarks // 3
        strong = min(n_pos, third)
        marks = [*range(strong), *draw.choice(np.arange(strong, n_pos), min(n_pos - strong, third), replace=False).tolist()]
        marks += draw.choice(np.arange(n_pos, len(features)), min(third, len(features) - n_pos), replace=False).tolist()
        x, own, dense, root = _nystroem(features, marks)
        y = np.where(np.arange(len(features)) < n_pos, 1.0, -1.0)
        w = _svm(x, y, np.concatenate([4.0 * np.array([n for _, n in shown]), np.full(len(features) - n_pos, 4.0)]))
        del x, features  # no round's arrays stay while the next one's are made
        weights = np.zeros(SIZE, np.float32)
        weights[own] = dense.T @ (root @ w[:-1]).astype(np.float32)
        machine = SubsequenceMachine(weights, float(w[-1]))
        del dense
    worst = np.array([machine.margins(sorted(words_of(d))).max(initial=-2.0) for g in kept for d in g], np.float64)
    label = np.array([1.0] * len(kept[0]) + [0.0] * len(kept[1]))
    machine.slope, machine.offset, machine.floor = _platt(np.clip(worst, -3, 3), label, np.where(label == 1, share / len(kept[0]), (1 - share) / len(kept[1])))
    return machine


def train_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bounds: Training = Training()) -> SubsequenceMachine | None:
    """A machine from the labelled documents among ``docs``: a bounded sample of each label, as sentences, goes to one task."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("group_key")).agg(F.max(label).cast("int").alias("g"))
    share = marked.agg(F.avg("g")).first()[0]
    rows = sampled(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", "toxicity", bounds.per_class, bounds.chars, groups=marked)

    def cut():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[sorted(part) for part in sentences(t)] for t in b.column(2).to_pylist()], pa.list_(pa.list_(pa.string())))], ["h", "label", "sentences"])

    def make(sample: pa.Table) -> pa.RecordBatch:
        intern: dict[str, str] = {}  # one copy of each word
        docs = [([[intern.setdefault(w, w) for w in part] for part in d], y) for d, y in zip(sample["sentences"].to_pylist(), sample["label"].to_pylist(), strict=True)]
        machine = train(docs, share, bounds) or SubsequenceMachine(np.zeros(SIZE), 0.0, 0.0, -60.0)
        at = np.flatnonzero(machine.weights)
        parts = [pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([machine.weights[at].tobytes()], pa.binary()), *(pa.array([float(v)], pa.float64()) for v in (machine.constant, machine.slope, machine.offset, machine.floor))]
        return pa.RecordBatch.from_arrays(parts, ["place", "weight", "constant", "slope", "offset", "floor"])

    split = arrow_map(rows.select("h", "g", "t"), cut, "h long, label int, sentences array<array<string>>")
    found = in_one_task(split, "h", make, "place binary, weight binary, constant double, slope double, offset double, floor double").first()
    if found is None or not found["place"]:
        return None
    weights = np.zeros(SIZE, np.float32)
    weights[np.frombuffer(found["place"], "<i4")] = np.frombuffer(found["weight"], np.float32)
    return SubsequenceMachine(weights, found["constant"], found["slope"], found["offset"], found["floor"])


def score_toxicity(docs: DataFrame, machine: SubsequenceMachine | None, key: str = "doc_id", text: str = "text", cut: float = 0.7, cache_words: int = 400_000) -> DataFrame:
    """``key, score, predicted`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own, cache = sent.value, {}

        def worst(texts: list[str]) -> list[float]:
            """Of texts that are worked on together: new words of all of them go to the machine at once."""
            nonlocal cache
            found = [words(t) for t in texts]
            met = set().union(*found)
            if len(cache) + len(met) > cache_words:
                cache = {w: cache[w] for w in met if w in cache}
            if new := list(met.difference(cache)):
                cache.update(zip(new, own.margins(new).tolist(), strict=True))
            return [max(map(cache.__getitem__, f), default=-2.0) for f in found]

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            score = own.probability(np.array([m for block in in_blocks(texts) for m in worst(block)])) if own else np.zeros(len(texts))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], ["key", "score", "predicted"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), text_of(text).alias("text")), make, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_fold("doc_id", 3) != 1)
    held_out = crc_fold("doc_id", 3) == 1
    machine = train_on(docs.where(~held_out), labels)
    return score_toxicity(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")
