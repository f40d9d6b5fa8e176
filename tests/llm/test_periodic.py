"""Periodic runs against a brute-force search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import SMALL
from waymark.llm import periodic
from waymark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=periodic.WORDS, times=periodic.PERIODS):
    n, out = len(w), set()
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, times * p) and not any(w[i : i + size - q] == w[i + q : i + size] for q in range(1, p)):
                out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(0, 150), st.integers(3, 30))
def test_runs_equal_brute_force(seed, kinds, n, least):
    rng = random.Random(seed)
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 9:
            a, p = rng.randrange(n), rng.randint(1, n // 3)
            for i in range(a, min(n, a + p * rng.randint(2, 9) + rng.randint(0, p))):
                w[i] = w[a + (i - a) % p]
    assert periodic.find_runs(np.array(w, np.int64), least) == brute(w, least)


@pytest.mark.parametrize("period", [1, 7, 999, 70_000])
def test_one_run_of_a_million_words(period):
    words = np.tile(np.arange(period), 1_000_000 // period + 1)[:1_000_000]
    assert periodic.find_runs(words) == [(0, 1_000_000, period)]


def test_a_million_words_without_runs():
    words = np.minimum(np.random.default_rng(0).zipf(1.3, 1_000_000), 50_000)
    assert periodic.find_runs(words) == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(None, "a b " * 20), (7, None), (17, ""), (47, " \n "), (9, "a  b\t" * 12 + "c"), (9, "a  b\t" * 12 + "c"), (20, "x " * 100), (28, "\x1c q" * 40)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    expected = []
    for doc_id, text in docs.collect():
        w = WORD.findall(text or "")
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute(w)
        gone = {i for s, size, p in runs for i in range(s + p, s + size)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        expected.append((doc_id, len(runs), *facts, digest("".join(f"{s},{size},{p}\n" for s, size, p in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/periodic"
    docs.withColumn("runs", F.lit("clash")).withColumn("n", F.lit("clash")).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in got) > 5


def test_empty_table_and_few_periods(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(none, periods=2)
