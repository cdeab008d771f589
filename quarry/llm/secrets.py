"""Operator 8: secret scans by character Markov models.

Two second-order Markov models over characters, one of random strings and one of ordinary words and identifiers, are
trained from labelled samples. A run of key characters is a secret if its log-likelihood ratio exceeds a threshold that
one in ``1 / FALSE_POSITIVES`` held-out ordinary runs may pass. Three fixed patterns (assignments, access keys, hex runs) find what is sure; the models
add spans that overlap none of those.

Runs without a letter are numbers (of cards, parts, telephones) and no secrets: the models do not judge them.

Labelled samples: ordinary ones are the runs of letters, digits and underscores of at most ``sample_docs`` documents with ``sample_chars``
characters in all (the first by a hash of key and text) outside the fixed patterns, without the runs that could be keys and look random to models of the words that are
too short for keys, whatever the alphabet (numbers stay); random ones are what the fixed patterns find there, and strings drawn
from a generator with a fixed seed over the usual alphabets of keys. The models are trained in one task of an executor.

Edge cases: a null or empty text has no spans, and the digests of the empty string; positions count code points; texts of any length are
scanned whole, in time that is linear in their length and number of spans; repeated rows give a row each; columns other than key and text are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, in_one_task, sampled, table, text_of

# The base patterns, in the order of their kinds, with the least length of a match's value.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: Key words in either case, spelled out: case folding of whole Unicode would let in letters beyond A-Z.
_KEYS = re.compile(re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", r"password|passwd|secret|token|api_?key"))
_ASSIGN = re.compile(f"({_KEYS.pattern})" + ASSIGN.partition(")")[2])
_ACCESS = re.compile(ACCESS)
#: A run of hex digits begins where the last one ended, so the first long match is a whole run.
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
#: What the models judge.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z0-9_]{4,}")
_LETTER = re.compile(r"[A-Za-z]")

#: Share of held-out ordinary runs that may score above the threshold.
FALSE_POSITIVES = 0.001

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(128, np.int64)
for _i, _c in enumerate(ALPHABET, 1):
    _CODE[ord(_c)] = _i
SIZE = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns."""
    out = []
    if "=" in text or ":" in text:
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _codes(run: str) -> np.ndarray:
    """Codes of a run, led by two zeros that stand for its beginning."""
    return np.concatenate([[0, 0], _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]])


class MarkovPair:
    """Log-likelihood ratios, random against ordinary, of every step from two characters to a third."""

    def __init__(self, random_runs: list[str], ordinary: list[str], seed: int = 7) -> None:
        held = [w for k, w in enumerate(ordinary) if k % 5 == 0]
        self.steps = np.log(self._model(random_runs) / self._model([w for k, w in enumerate(ordinary) if k % 5])).astype(np.float32)
        #: A share of FALSE_POSITIVES of held-out ordinary runs scores higher at most; the margin is that of a few characters.
        longer = [a + b for a, b in zip(held[::2], held[1::2], strict=False)] + held
        scores = [self.score(w) for w in longer if len(w) >= 12]
        self.threshold = max(8.0, float(np.quantile(scores, 1 - FALSE_POSITIVES, method="higher")) + 3.0 if scores else 0.0)

    @staticmethod
    def _model(runs: list[str]) -> np.ndarray:
        """P(third | two), backed off to P(third | one) and to the frequency of the character."""
        three = np.zeros(SIZE**3)
        for run in runs:
            c = _codes(run)
            np.add.at(three, (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], 1.0)
        three = three.reshape(SIZE, SIZE, SIZE)
        two = three.sum(0)
        one = two.sum(0)
        p1 = (one + 0.1) / (one.sum() + 0.1 * SIZE)
        p2 = (two + 10.0 * p1[None]) / (two.sum(1, keepdims=True) + 10.0)
        return (three + 4.0 * p2[None]) / (three.sum(2, keepdims=True) + 4.0)

    def score(self, run: str) -> float:
        c = _codes(run)
        return float(self.steps[c[:-2], c[1:-1], c[2:]].sum())


def train(sample: list[str], seed: int = 7) -> MarkovPair:
    draw = random.Random(seed)
    sets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + "0123456789", ALPHABET[26:62]]
    found, short, long = [], [], set()
    for text in sample:
        spans, at, rest = base_spans(text), 0, []
        for start, _, end in spans:
            found += [w for w in _RUN.findall(text[start:end])]
            rest.append(text[at : max(at, start)])
            at = max(at, end)
        rest = " ".join([*rest, text[at:]])
        long.update(_RUN.findall(rest))
        short += _WORD.findall(_RUN.sub(" ", rest))
    made = ["".join(draw.choices(draw.choice(sets), k=draw.randint(16, 64))) for _ in range(4000)]
    short = sorted(set(short))
    # Runs that could be keys are judged by models of what could not: those that look random are no ordinary samples. Plain numbers are.
    judge = MarkovPair(made, short) if short else None
    ordinary = sorted({*short, *(w for run in long if judge is None or not _LETTER.search(run) or judge.score(run) <= 0 for w in _WORD.findall(run))})
    ordinary += [a + b for a, b in zip(ordinary[::3], ordinary[1::3], strict=False)] + [f"{a}_{b}" for a, b in zip(ordinary[::4], ordinary[2::4], strict=False)]
    draw.shuffle(ordinary)
    return MarkovPair(made + found, ordinary or ["ordinary_identifier", "another_name"])


def spans(text: str, models: MarkovPair) -> list[tuple[int, int, int]]:
    """Fixed and modelled spans; a modelled one overlaps no fixed one. Both kinds come in order and are walked together."""
    base = base_spans(text)
    out, k, reach = list(base), 0, 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start and _LETTER.search(m[0]) and models.score(m[0]) > models.threshold:
            out.append((start, 3, end))
    return sorted(out)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in found])


def train_on(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 1000, sample_chars: int = 8_000_000) -> MarkovPair:
    """The models of a bounded sample of the documents."""
    rows = sampled(docs, key, text, "secrets", sample_docs, sample_chars, F.lit(0))

    def make(sample: pa.Table) -> pa.RecordBatch:
        models = train(sample["t"].to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([models.steps.tobytes()], pa.binary()), pa.array([models.threshold], pa.float64())], ["steps", "threshold"])

    found = in_one_task(rows.select("h", "t"), "h", make, "steps binary, threshold double").first()
    if found is None:
        return train([])
    models = MarkovPair.__new__(MarkovPair)
    models.steps, models.threshold = np.frombuffer(found["steps"], np.float32).reshape(SIZE, SIZE, SIZE), found["threshold"]
    return models


def find_secrets(docs: DataFrame, models: MarkovPair, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        own = sent.value

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, all_spans = [], [], []
            for t in b.column(1).to_pylist():
                found = spans(t, own)
                base = [s for s in found if s[1] < 3]
                counts.append([sum(s[1] == k for s in base) for k in range(3)])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                all_spans.append(_joined(found))
            n = list(zip(*counts, strict=True))
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), text_of(text).alias("text")), make, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", key)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, train_on(docs))
