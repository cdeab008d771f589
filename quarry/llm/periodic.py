"""Operator 11: periodic runs of words, found by probing harmonic grids.

For a period p the words at the places 0, p, 2p and so on are compared with their successors on that grid. A run of at least three periods
holds three grid points in a row, so that two equal pairs in a row survive the probing wherever a run is. Survivors are extended in both directions
by comparing chunks of the array with itself p words on, the chunks growing as long as they agree. Grid points within what was just
extended, or within a run already found whose period divides p, are skipped; the first run found over a stretch has its smallest period, as periods come in ascending order.

Up to ``FLAT`` words the grids of all periods are one table, sorted by their last place, whose beginning serves every shorter text: about n ln n
comparisons in one call. Longer texts take one strided comparison a period, in the same number of steps, with no table.

Edge cases: a null text is empty; a text without words has no run; equal rows have equal results, each its row; a null key is kept; an empty table gives an
empty result; texts of any length are read whole, one at a time; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, table, text_of

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
FLAT = 1 << 14
#: Words in the first chunk of an extension.
CHUNK = 16


@lru_cache(maxsize=1)
def _grids(n: int = FLAT) -> tuple[np.ndarray, np.ndarray]:
    """``last, period``: the third of three neighbouring grid points, for all periods, sorted by it."""
    last = np.concatenate([np.arange(2 * p, n, p) for p in range(1, n // 2)] or [np.zeros(0, int)])
    period = np.concatenate([np.full(len(range(2 * p, n, p)), p) for p in range(1, n // 2)] or [np.zeros(0, int)])
    order = np.argsort(last, kind="stable")
    return last[order].astype(np.int32), period[order].astype(np.int32)


def _survivors(ids: np.ndarray, flat: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each period, ascending, with the places ``a`` of its grid where the words at a, a + p and a + 2p are equal."""
    n = len(ids)
    if n <= flat:
        last, period = _grids(flat)
        upto = int(np.searchsorted(last, n))
        last, period = last[:upto], period[:upto]
        at = np.flatnonzero(ids[last] == ids[last - period])
        at = at[ids[last[at] - period[at]] == ids[last[at] - 2 * period[at]]]
        at = at[LEAST_PERIODS * period[at] <= n]
        last, period = last[at].astype(np.int64), period[at].astype(np.int64)
        order = np.lexsort((last, period))
        last, period = last[order], period[order]
        if not len(last):
            return
        begin = np.flatnonzero(np.diff(period, prepend=0))
        for b, e in zip(begin, [*begin[1:], len(period)], strict=True):
            yield int(period[b]), last[b:e] - 2 * period[b]
        return
    for p in range(1, n // LEAST_PERIODS + 1):
        grid = ids[::p]
        same = grid[1:] == grid[:-1]
        found = np.flatnonzero(same[1:] & same[:-1])
        if len(found):
            yield p, found * p


def _agree(x: np.ndarray, y: np.ndarray, backward: bool = False) -> int:
    """How many words agree from the beginning (or the end), chunk by chunk."""
    n, done, size = min(len(x), len(y)), 0, CHUNK
    while done < n:
        m = min(size, n - done)
        other = x[len(x) - done - m : len(x) - done] != y[len(y) - done - m : len(y) - done] if backward else x[done : done + m] != y[done : done + m]
        if backward:
            other = other[::-1]
        if (k := int(other.argmax())) or other[0]:
            return done + k
        done, size = done + m, size * 2
    return n


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, flat: int = FLAT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``ids`` with ``max(least, 3 * period)`` words, by start and period."""
    n, out = len(ids), []
    if n < least:
        return out
    # Runs found so far that are still long enough to hold a triple of later periods, by start; of those whose periods divide p no two contain one another.
    # Two stretches of period p share fewer than p words, so that a grid point whose successor lies within one belongs to no other.
    known = np.zeros((0, 3), np.int64)
    for p, places in _survivors(ids, flat):
        known = known[known[:, 1] - known[:, 0] > 2 * p]
        inside = known[p % known[:, 2] == 0]
        if len(inside):
            i = np.searchsorted(inside[:, 0], places, "right") - 1
            places = places[(i < 0) | (inside[np.maximum(i, 0), 1] <= places + p)]
        new, k = [], 0
        while k < len(places):
            a = int(places[k])
            start = a - _agree(ids[:a], ids[p : a + p], backward=True)
            end = a + p + _agree(ids[a:], ids[a + p :])
            if end - start >= max(least, LEAST_PERIODS * p):
                new.append((start, end, p))
            k = max(k + 1, int(np.searchsorted(places, end - p)))
        if new:
            out += new
            known = np.concatenate([known, np.array(new, np.int64)])
            known = known[np.argsort(known[:, 0], kind="stable")]
    return sorted((s, e - s, p) for s, e, p in out)


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stand in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        edge[s + p] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length in periods, exactly; ties go to the smallest start, then period."""
    best = None
    for s, length, p in runs:
        if best is None or (length * best[2], -s, -p) > (best[1] * p, -best[0], -best[2]):
            best = s, length, p
    return best


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _run(r: tuple[int, int, int] | None) -> dict | None:
    return r and dict(zip(("start", "length", "period"), r, strict=True))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``key, n_words, runs array<struct<start, length, period>>, best struct, collapsed``: all runs of the words of every whole text.

    ``collapsed``: the words that stand in no run behind its first period, joined by spaces. ``rewrite(key, words)`` gives the words to read instead.
    """

    def make():
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            n, runs, best, kept = [], [], [], []
            for k, t in zip(b.column(0), b.column(1), strict=True):
                words = t.as_buffer().to_pybytes().split()  # at space and 9 to 13, as bytes are split
                if rewrite:
                    words = rewrite(k.as_py(), words)
                number = defaultdict(count().__next__)
                found = find_runs(np.fromiter(map(number.__getitem__, words), np.int32, len(words)), least)
                n.append(len(words))
                runs.append([_run(r) for r in found])
                best.append(_run(best_run(found)))
                kept.append(b" ".join([w for w, gone in zip(words, repeats(len(words), found), strict=True) if not gone] if found else words).decode())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.string())], ["key", "n_words", "runs", "best", "collapsed"])

        return each

    run = "struct<start:long,length:long,period:long>"
    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(docs.select(F.col(key).alias("key"), text_of(text).alias("text")), make, f"key {kind}, n_words long, runs array<{run}>, best {run}, collapsed string")
    return out.withColumnRenamed("key", key)


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all documents repeat from a place on, by rule of the query: place and period follow from the key's crc32."""
    h, n = zlib.crc32(b"" if key is None else str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
