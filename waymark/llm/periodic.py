"""Detection and removal of periodic runs of words by harmonic grid probing.

A run of period p and at least three periods holds two neighbouring multiples of p, each equal to the word one period on.
So for each period only the words at its multiples are compared, n/p of them: n log n comparisons in all periods. Grid
points that survive are extended to both sides by comparing arrays in chunks; grid points within a run already found are
skipped, since there only multiples of its period can match, and they give the same run.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Least length of a run in words and in periods.
WORDS, PERIODS = 24, 3
#: Words compared at once while a run is extended: from the first to the second, doubling.
CHUNK = (64, 1 << 16)

Run = tuple[int, int, int]


def word_numbers(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and a number for each that equal words share."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the ASCII white space only
    known: dict[bytes, int] = {}
    return words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements the two have in common from the start."""
    at, size = 0, CHUNK[0]
    while at < len(a):
        wrong = np.flatnonzero(a[at : at + size] != b[at : at + size])
        if len(wrong):
            return at + int(wrong[0])
        at, size = at + size, min(2 * size, CHUNK[1])
    return len(a)


def _grid(ids: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, grid point jp) for periods low to high - 1 where the words at jp, (j+1)p and (j+2)p are equal."""
    n, periods, points = len(ids), [], []
    if high - low <= n // low:
        for p in range(low, high):
            word = ids[::p]
            same = word[:-1] == word[1:]
            j = np.flatnonzero(same[:-1] & same[1:])
            periods.append(np.full(len(j), p))
            points.append(j * p)
    else:
        # Few grid points and many periods: one array per j instead, over all periods whose (j+2)p lies in the text.
        for j in range(n // low):
            top = min(high, (n - 1) // (j + 2) + 1)
            if top <= low:
                break
            first, second, third = (ids[low * k : (top - 1) * k + 1 : k] if k else np.full(top - low, ids[0]) for k in (j, j + 1, j + 2))
            p = np.flatnonzero((first == second) & (second == third)) + low
            periods.append(p)
            points.append(j * p)
    return (np.concatenate([np.zeros(0, np.int64), *x]) for x in (periods, points))


def find_runs(ids: np.ndarray, words: int = WORDS, periods: int = PERIODS) -> list[Run]:
    """(start, length, smallest period) of every maximal run of at least so many words and periods, by start and period.

    periods is 3 at least: shorter runs need not hold two grid points.
    """
    n, found = len(ids), []
    # cover[i] is the furthest end of the runs found so far that hold word i.
    cover = np.zeros(n, np.int64)
    low = 1
    while low * periods <= n and words <= n:
        high = min(2 * low, n // periods + 1)
        p, g = _grid(ids, low, high)
        # Words between the two grid points match as well; runs found in earlier octaves are not probed again.
        keep = cover[g] < g + 2 * p
        p, g = p[keep], g[keep]
        for part in (2, 3, 5):
            between = g + p // part
            keep = ids[between] == ids[between + p]
            p, g = p[keep], g[keep]
        order = np.lexsort((g, p))
        last, end = 0, 0
        for period, at in zip(p[order].tolist(), g[order].tolist()):
            if period == last and at < end:
                continue
            right = at + _equal(ids[at : n - period], ids[at + period :])
            if right - at <= period:
                continue
            left = at - _equal(ids[:at][::-1], ids[period : at + period][::-1])
            size = right + period - left
            last, end = period, right
            if size >= max(words, periods * period):
                found.append((left, size, period))
                cover[left : left + size] = np.maximum(cover[left : left + size], left + size)
        low *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def keep_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: those that no run repeats, that is holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, size, period in runs:
        change[start + period] += 1
        change[start + size] -= 1
    return np.cumsum(change[:-1]) == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, words: int = WORDS, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), longest (the run of the greatest exact length / period,
    ties to the smallest start, then period) and collapsed, the words that stay joined by one space, for every row.

    A null or empty text has no words, no runs and an empty collapsed text; without runs longest is null. Repeated rows
    and null doc_ids give a row each; further columns are not read. A document is one row, so a task holds its words.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods can't be found on the grid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, every, longest, texts = [], [], [], []
            for text in batch.column(1):
                all_words, ids = word_numbers(text.as_py() or "")
                runs = find_runs(ids, words, periods)
                counts.append(len(ids))
                every.append([dict(zip(RUN.names, r)) for r in runs])
                longest.append(dict(zip(RUN.names, max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])))) if runs else None)
                if runs:
                    all_words = [all_words[i] for i in np.flatnonzero(keep_words(len(ids), runs))]
                texts.append(b" ".join(all_words).decode("utf-8", "surrogatepass"))
            columns = {"doc_id": batch.column(0), "n_words": pa.array(counts, pa.int64()), "runs": pa.array(every, pa.list_(RUN)), "longest": pa.array(longest, RUN), "collapsed": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    id_type, kind = docs.schema["doc_id"].dataType.simpleString(), "struct<start: long, length: long, period: long>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<{kind}>, longest {kind}, collapsed string")


def plant_runs(docs: DataFrame) -> DataFrame:
    """docs, where every tenth document, chosen by the checksum h of its id, repeats a part up to its end: with
    g = h / 10, a = g % n and p = 1 + (n - a) / (3 + g % 8), word i >= a becomes word a + (i - a) % p. Its white space
    becomes one space. Documents of null ids and those without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"), F.size(words).cast("long").alias("n"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeat = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeat).otherwise(F.col("text")).alias("text"))
