"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each in a node of a tree of 255; every node has its own context tree over the bytes
before. A context's estimate is Krichevsky-Trofimov; weighting mixes a context with its longer ones, all depths from 0
to DEPTH, half and half at every step. Trained on counts, the mixture gives each byte after each context one
probability. Contexts of up to SPLIT bytes are one small table, worked on level by level in Spark; the longer ones
that end in the same SPLIT bytes lie in one task, which works on distinct strings only. A text is the bytes of its lower-cased words, one space between two and a line feed at the end.

Documents are dealt to blocks of bounded size. A block sends its distinct byte strings of DEPTH + 1 and its distinct
words, with their training counts, to buckets by their hash, as compressed arrays; gets back the model's value of each
string and the count of each word; and scores its documents. The model is never held whole anywhere, and what is
gathered grows with the input.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, stored

DEPTH = 5
#: Bytes that contexts share which are worked on together.
SPLIT = 2
#: Bytes of text in a block, on average, and bytes whose strings are sorted at once.
BLOCK_BYTES, AT_ONCE = 20_000_000, 2_000_000
END = b"\n"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def _strings(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings that end at each byte of the texts, as numbers, and how many each text has.

    Before a text's first byte stand `depth` line feeds.
    """
    whole = [END * depth + b" ".join(words) + END for words in texts]
    data = np.frombuffer(b"".join(whole), np.uint8)
    sizes = np.array([len(x) - depth for x in whole], np.int64)
    keys = np.zeros(max(len(data) - depth, 0), np.int64)
    for k in range(depth + 1):
        keys = (keys << 8) | data[k : len(data) - depth + k]
    # The last `depth` positions before each further text would span two texts.
    inside = np.ones(len(keys), bool)
    starts = np.cumsum(sizes + depth)[:-1]
    for k in range(1, depth + 1):
        inside[starts - k] = False
    return keys[inside], sizes


def _groups(texts: list[list[bytes]]) -> Iterator[slice]:
    """Runs of texts of about AT_ONCE bytes."""
    first, size = 0, 0
    for k, words in enumerate(texts):
        size += sum(map(len, words)) + len(words)
        if size >= AT_ONCE:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _tally(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings, sorted, and their counts."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _groups(texts):
        more, n = np.unique(_strings(texts[part], depth)[0], return_counts=True)
        keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    return keys, counts


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences."""
    return zstandard.compress(np.diff(values.astype(np.int64), prepend=0).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _count_block(table: pa.Table, depth: int, buckets: int) -> pa.Table:
    """block, bucket, grams, gram_n, words, word_n: how often training texts hold each string and word of the block."""
    block = table.column("block")[0].as_py()
    sides: dict[bool, list[list[bytes]]] = {True: [], False: []}
    for held, text in zip(table.column("held_out").to_pylist(), table.column("text")):
        sides[held].append(_words(text.as_py()))
    known, n = _tally(sides[False], depth)
    other = np.setdiff1d(_tally(sides[True], depth)[0], known, assume_unique=True)
    grams, counts = np.concatenate([known, other]), np.concatenate([n, np.zeros(len(other), np.int64)])
    order = np.lexsort((grams, _spread(grams, buckets)))
    grams, counts = grams[order], counts[order]
    cuts = np.searchsorted(_spread(grams, buckets), np.arange(buckets + 1))
    words: Counter[bytes] = Counter()
    for text in sides[False]:
        words.update(text)
    for text in sides[True]:
        for w in text:
            words.setdefault(w, 0)
    spelled: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in words:
        spelled[zlib.crc32(w) % buckets].append(w)
    rows = []
    for k in range(buckets):
        mine, cut = sorted(spelled[k]), slice(cuts[k], cuts[k + 1])
        if mine or cut.stop > cut.start:
            rows.append((block, k, _pack(grams[cut]), zstandard.compress(counts[cut].tobytes(), 3), zstandard.compress(b" ".join(mine), 3), zstandard.compress(np.array([words[w] for w in mine], np.int64).tobytes(), 3)))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), COUNTED.values())] if rows else [pa.array([], t) for t in COUNTED.values()], names=list(COUNTED))


COUNTED = {"block": pa.int64(), "bucket": pa.int64(), "grams": pa.binary(), "gram_n": pa.binary(), "words": pa.binary(), "word_n": pa.binary()}


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int64)


def _merge(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    return keys, total


def _word_counts(table: pa.Table) -> Counter[bytes]:
    total: Counter[bytes] = Counter()
    for words, n in zip(table.column("words").to_pylist(), table.column("word_n").to_pylist()):
        for w, c in zip(zstandard.decompress(words).split(), _counts(n).tolist()):
            total[w] += c
    return total


def _sum_bucket(table: pa.Table, split: int, parts: int) -> pa.Table:
    """A bucket's distinct strings and training counts, by the part that their context's last bytes belong to.

    part -1 has the words' total and their number instead (in gram_n).
    """
    grams, n = _merge([_unpack(x) for x in table.column("grams").to_pylist()], [_counts(x) for x in table.column("gram_n").to_pylist()])
    words = _word_counts(table)
    part = _spread((grams >> 8) & (256**split - 1), parts)
    rows = [(-1, b"", zstandard.compress(np.array([sum(words.values()), sum(c > 0 for c in words.values())], np.int64).tobytes()))]
    for k in np.unique(part).tolist():
        rows.append((k, _pack(grams[part == k]), zstandard.compress(n[part == k].tobytes(), 3)))
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array([bucket] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int64()), "grams": pa.array([r[1] for r in rows], pa.binary()), "gram_n": pa.array([r[2] for r in rows], pa.binary())})


def _log_gamma(x: np.ndarray) -> np.ndarray:
    z, product = x + 7.0, x.copy()
    for k in range(1, 7):
        product *= x + k
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


class _Long:
    """The context trees of the strings of one part, for contexts of `split` to `depth` bytes, from the longest up."""

    def __init__(self, table: pa.Table, depth: int, split: int):
        self.grams, n = _merge([_unpack(x) for x in table.column("grams").to_pylist()], [_counts(x) for x in table.column("gram_n").to_pylist()])
        self.part = table.column("part")[0].as_py()
        byte = self.grams & 255
        self.bits = np.stack([(byte >> (7 - i)) & 1 for i in range(8)], axis=1).ravel()
        node = np.stack([(1 << i) | (byte >> (8 - i)) for i in range(8)], axis=1).ravel()
        keys, self.leaf = np.unique((np.repeat(self.grams >> 8, 8) << 8) | node, return_inverse=True)
        ones = np.bincount(self.leaf, np.repeat(n, 8) * self.bits, len(keys))
        zeros = np.bincount(self.leaf, np.repeat(n, 8), len(keys)) - ones
        longer = np.zeros(len(keys))
        self.levels = []
        for d in range(depth, split - 1, -1):
            own = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)
            weighted = own if d == depth else math.log(0.5) + np.logaddexp(own, longer)
            level = {"keys": keys, "zeros": zeros, "ones": ones, "own": own, "weighted": weighted, "longer": longer}
            self.levels.append(level)
            if d > split:
                up, level["up"] = np.unique((((keys >> 8) & (256 ** (d - 1) - 1)) << 8) | (keys & 255), return_inverse=True)
                zeros, ones, longer = (np.bincount(level["up"], x, len(up)) for x in (zeros, ones, weighted))
                keys = up

    def top(self) -> pa.Table:
        level = self.levels[-1]
        return pa.table({"part": np.full(len(level["keys"]), self.part), "ctx": level["keys"] >> 8, "node": (level["keys"] & 255).astype(np.int32), "n0": level["zeros"].astype(np.int64), "n1": level["ones"].astype(np.int64), "longer": level["longer"]})

    def values(self, state: pa.Table) -> np.ndarray:
        """log10 probability of each string's last byte, from the state of the contexts of `split` bytes."""
        keys = (state.column("ctx").to_numpy() << 8) | state.column("node").to_numpy()
        order = np.argsort(keys)
        at = order[np.searchsorted(keys[order], self.levels[-1]["keys"])]
        weight, mixed, p = (state.column(c).to_numpy(zero_copy_only=False).astype(float)[at] for c in ("weight", "mixed", "p"))
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            one = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1.0)
            if k == 0:
                p = np.where(np.isnan(p), mixed + weight * one, p)
                break
            stay, leave = np.exp(math.log(0.5) + level["own"] - level["weighted"]), np.exp(math.log(0.5) + level["longer"] - level["weighted"])
            last, below = mixed + weight * one, self.levels[k - 1]
            mixed, weight, up = mixed + weight * stay * one, weight * leave, below["up"]
            seen = below["zeros"] + below["ones"] > 0
            mixed, weight, p = mixed[up], weight[up], np.where(np.isnan(p[up]) & ~seen, last[up], p[up])
        chance = np.where(self.bits == 1, p[self.leaf], 1.0 - p[self.leaf])
        return np.log10(chance).reshape(-1, 8).sum(axis=1)


def _value_part(left: pa.Table, state: pa.Table, depth: int, split: int, buckets: int) -> pa.Table:
    """bucket, grams, value of a part's strings, back by their bucket."""
    trees = _Long(left, depth, split)
    values, bucket = trees.values(state), _spread(trees.grams, buckets)
    ids = np.unique(bucket)
    return pa.table({"bucket": pa.array(ids, pa.int64()), "grams": pa.array([_pack(trees.grams[bucket == k]) for k in ids], pa.binary()), "value": pa.array([values[bucket == k].tobytes() for k in ids], pa.binary())})


def _answer_bucket(counted: pa.Table, valued: pa.Table) -> pa.Table:
    """What each block asked of a bucket: its strings with their values, its words with their counts."""
    keys = np.concatenate([np.zeros(0, np.int64), *[_unpack(x) for x in valued.column("grams").to_pylist()]])
    values = np.concatenate([np.zeros(0), *[np.frombuffer(x, np.float64) for x in valued.column("value").to_pylist()]])
    order = np.argsort(keys)
    keys, values, words = keys[order], values[order], _word_counts(counted)
    out = []
    for grams, spelled in zip(counted.column("grams").to_pylist(), counted.column("words").to_pylist()):
        mine = zstandard.decompress(spelled).split()
        out.append((grams, values[np.searchsorted(keys, _unpack(grams))].tobytes(), spelled, zstandard.compress(np.array([words[w] for w in mine], np.int64).tobytes(), 3)))
    columns = [pa.array([r[k] for r in out], pa.binary()) for k in range(4)]
    return pa.table([counted.column("block"), *columns], names=["block", "grams", "value", "words", "word_n"])


def _score_block(docs: pa.Table, answers: pa.Table, depth: int, below: float, ends: int) -> pa.Table:
    """Score a block's documents by its strings' values and its words' counts in training."""
    count: dict[bytes, int] = {}
    for words, n in zip(answers.column("words").to_pylist(), answers.column("word_n").to_pylist()):
        count.update(zip(zstandard.decompress(words).split(), _counts(n).tolist()))
    keys = np.concatenate([_unpack(x) for x in answers.column("grams").to_pylist()])
    logs = np.concatenate([np.frombuffer(x, np.float64) for x in answers.column("value").to_pylist()])
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order]
    value = {c: math.log10((c + 0.5) / below) for c in {ends, *count.values()}}
    texts = [_words(x.as_py()) for x in docs.column("text")]
    tokens, known, bases, scores, sizes = [], [], [], [], []
    for words in texts:
        found = [count[w] for w in words]
        tokens.append(len(words) + 1)
        known.append(len(found) - found.count(0) + (ends > 0))
        bases.append(math.fsum([value[c] for c in found]) + value[ends])
    for part in _groups(texts):
        strings, each = _strings(texts[part], depth)
        stop = np.cumsum(each)
        scores += np.add.reduceat(logs[np.searchsorted(keys, strings)], stop - each).tolist()
        sizes += each.tolist()
    return pa.table(
        {
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "n_bytes": pa.array(sizes, pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64()),
        }
    )


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1/2 by Stirling's series, seven steps further on."""
    z = x + 7.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for k in range(1, 7):
        product = product * (x + float(k))
    return series - F.ln(product)


def kt(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def short_states(level: DataFrame, split: int) -> DataFrame:
    """State of the contexts of `split` bytes after all shorter ones, from their part, ctx, node, n0, n1 and longer.

    A context that training has not seen says nothing: the longest seen one below it takes its weight. A context has
    at most 256 longer ones, so no group or join key here grows.
    """
    half = math.log(0.5)
    levels: dict[int, DataFrame] = {}
    for d in range(split, -1, -1):
        top = F.greatest("own", "longer")
        level = level.withColumn("own", kt(F.col("n0"), F.col("n1")))
        level = level.withColumn("weighted", half + top + F.log1p(F.exp(F.least("own", "longer") - top)))
        levels[d] = level = stored(level, f"level{d}")
        if d:
            above = F.col("ctx").bitwiseAND(256 ** (d - 1) - 1)
            level = level.groupBy(above.alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("longer"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    stay = F.exp(half + F.col("own") - F.col("weighted"))
    leave = F.exp(half + F.col("longer") - F.col("weighted"))
    seen = F.col("n0") + F.col("n1") > 0
    # weight: what no shorter context has taken; mixed: their share of the probability of a one; p: it, if decided.
    state = levels[0].withColumn("weight", F.lit(1.0)).withColumn("mixed", F.lit(0.0)).withColumn("p", F.when(~seen, 0.5))
    for d in range(1, split + 1):
        above = state.select(
            F.col("ctx").alias("up"), F.col("node").alias("up_node"), F.col("p").alias("up_p"), (F.col("weight") * leave).alias("weight"),
            (F.col("mixed") + F.col("weight") * stay * one).alias("mixed"), (F.col("mixed") + F.col("weight") * one).alias("if_last"),
        )
        key = (F.col("ctx").bitwiseAND(256 ** (d - 1) - 1) == F.col("up")) & (F.col("node") == F.col("up_node"))
        state = levels[d].join(above, key).withColumn("p", F.coalesce("up_p", F.when(~seen, F.col("if_last"))))
        state = state.drop("up", "up_node", "up_p", "if_last")
    return state.select("part", "ctx", "node", "weight", "mixed", "p")


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row of docs.

    held_out marks rows that are scored and not learned from. A null text is empty: one end, and its byte. base_score
    is the log10 probability by smoothed word counts, score that of the mixture. Repeated rows and null doc_ids are
    documents of their own; an empty table gives an empty result. depth is 1 at least.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    total, ends = rows.select(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    blocks = max(1, -(-(total or 0) // block_bytes))
    buckets, parts, split = 2 * blocks + 6, blocks + 12, min(SPLIT, depth - 1)
    if split < 0:
        raise ValueError("depth must be at least 1")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    packed = "grams binary, gram_n binary"
    counted = stored(rows.groupBy("block").applyInArrow(lambda table: _count_block(table, depth, buckets), f"block long, bucket long, {packed}, words binary, word_n binary"), "counted")
    summed = stored(counted.groupBy("bucket").applyInArrow(lambda table: _sum_bucket(table, split, parts), f"bucket long, part long, {packed}"), "summed")
    tokens = distinct = 0
    for r in summed.where("part = -1").select("gram_n").toLocalIterator():
        more = _counts(bytes(r[0])).tolist()
        tokens, distinct = tokens + more[0], distinct + more[1]
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    below = tokens + 0.5 * (distinct + 1)
    by_part = summed.where("part >= 0")
    top = by_part.groupBy("part").applyInArrow(lambda table: _Long(table, depth, split).top(), "part long, ctx long, node int, n0 long, n1 long, longer double")
    states = short_states(top, split)
    valued = by_part.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(lambda left, right: _value_part(left, right, depth, split, buckets), "bucket long, grams binary, value binary")
    answers = counted.groupBy("bucket").cogroup(valued.groupBy("bucket")).applyInArrow(_answer_bucket, "block long, grams binary, value binary, words binary, word_n binary")
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda left, right: _score_block(left, right, depth, below, ends),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double",
    )
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
