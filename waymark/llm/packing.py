"""Best-fit packing: few-document length patterns fitted to the length histogram by non-negative least squares.

Tokenised documents are cut into pieces of at most `capacity` tokens and the pieces are put into as few sequences as
possible. Only the histogram of piece lengths (at most `capacity` rows, whatever the corpus size) reaches the driver.
There, patterns of up to DEPTH length bins that fill a sequence are enumerated, repeat counts are fitted to the binned
histogram by non-negative least squares and rounded down, each repeat takes pieces of its bins that fill a sequence
exactly, and what remains is packed best-fit by decreasing length. The plan says "ranks a to b of length l go to sequences s, s+1, ... at
offset o"; a rank within its length turns each piece into its place without any further shuffle of tokens.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, stored

CAPACITY = 4096
END_ID = 1
#: Length bins of the patterns, and documents in a pattern at most.
BINS, DEPTH = 128, 4
#: Shares of the fitted repeats that are tried, best fit alone (0) last: bins are coarser than lengths, so the last few
#: repeats of a pattern can take pieces that best fit would need. The plan of the fewest sequences counts.
SHARES = (1.0, 0.5, 0.0)
#: Words that a worker keeps the ids of; the table is emptied when full, which costs time and changes no result.
MEMO = 1_200_000
#: Pieces of a length that are ranked together in a task.
RANKED = 500


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file whose pre-tokenizer never joins across white space.

    Texts are cut at ASCII white space and each distinct word is encoded once per worker. Lower-casing A-Z first is
    part of the tokenizer's own normalisation. Words that hold an added token's string are encoded as they were written,
    since the library looks for these strings before it lower-cases.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.memo: dict[bytes, bytes] = {}

    def word(self, w: bytes) -> bytes:
        if w[-1:] in (b",", b".") and w[:-1].isalnum():
            head, tail = w[:-1], w[-1:]
            return (self.memo.get(head) or self.keep(head)) + (self.memo.get(tail) or self.keep(tail))
        if w.isalpha():  # a-z only: one pre-token, which the normaliser leaves as it is
            return np.array([t.id for t in self.model.tokenize(w.decode())], "<u4").tobytes()
        return np.array(self.whole.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def keep(self, w: bytes) -> bytes:
        ids = self.memo[w] = self.word(w)
        return ids

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        raw = text.encode()
        lower = raw.translate(LOWER)
        words = lower.split()
        if any(s in lower for s in self.special):
            words = [a if any(s in b for s in self.special) else b for a, b in zip(raw.split(), words)]
        get, keep = self.memo.get, self.keep
        return b"".join([get(w) or keep(w) for w in words])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and uid, a number unique to the row.

    Each document's ids end with END_ID; a null or empty text is END_ID alone. Only documents of more than `capacity`
    ids are cut. Repeated rows and null doc_ids are documents of their own.
    """
    id_type = docs.schema["doc_id"].dataType
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, n = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[] for _ in range(6)]
            for doc_id, text in zip(ids, batch.column(1)):
                packed = own.packed(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    piece = packed[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), part + n)):
                        column.append(value)
                    n += 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long, uid long")


def patterns(usable: list[int], whole: int, depth: int) -> np.ndarray:
    """All non-increasing rows of 1 to depth of the usable bins that sum to whole, filled up with zeros."""
    found: list[tuple[int, ...]] = []
    bins = sorted(usable)
    last = set(bins)

    def grow(head: tuple[int, ...], rest: int, most: int) -> None:
        if rest <= most and rest in last:
            found.append((*head, rest))
        if len(head) + 1 < depth:
            for b in bins[bisect_right(bins, (rest - 1) // (depth - len(head))) : bisect_right(bins, min(rest - 1, most))]:
                grow((*head, b), rest - b, b)

    grow((), whole, whole)
    return np.array([(*p, *[0] * (depth - len(p))) for p in found], np.int64).reshape(len(found), depth)


def fit_nnls(columns: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by an active set: the patterns that repeat and their repeat counts.

    Repeats bring the patterns' bins as near to target as they can: no pattern that is left out would come nearer.
    Never more patterns repeat than there are bins.
    """
    size = len(target)
    used, x, rest = np.zeros(0, np.int64), np.zeros(0), target.astype(float).copy()
    rest[0] = 0.0  # the filling
    near = 1e-9 * max(target.max(initial=0.0), 1.0)
    banned: set[int] = set()

    def matrix(chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((size, len(chosen)))
        for k in range(columns.shape[1]):
            np.add.at(out, (columns[chosen, k], np.arange(len(chosen))), 1.0)
        out[0] = 0.0
        return out

    while True:
        gain = rest[columns].sum(axis=1)
        gain[used] = 0.0
        gain[list(banned)] = 0.0
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= near:
            return used, x
        used, x = np.append(used, best), np.append(x, 0.0)
        while True:
            own = matrix(used)
            fitted = np.linalg.lstsq(own, target * (np.arange(size) > 0), rcond=None)[0]
            if (fitted > near).all():
                break
            # Go towards the fit until the first pattern reaches zero, and leave that one out.
            low = fitted <= near
            step = np.min(x[low] / np.maximum(x[low] - fitted[low], 1e-300))
            x = x + step * (fitted - x)
            stay = ~(low & (x <= near))
            if stay.all():
                stay[np.flatnonzero(low)[0]] = False
            if not stay[-1]:
                banned.add(best)  # of no use to this set of patterns: rounding would offer it for ever
            used, x = used[stay], x[stay]
            if not len(used):
                fitted = x
                break
        if best in used:
            banned.clear()
        x = fitted
        rest = target - (matrix(used) @ x if len(used) else 0.0)
        rest[0] = 0.0


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): a place for every piece of the histogram.

    Never more sequences than best fit by itself. An empty histogram has an empty plan. The number of rows depends on the number of lengths
    and patterns, not on the counts.
    """
    width = -(-capacity // min(bins, capacity))
    whole = capacity // width
    target = np.zeros(whole + 2)
    for n, count in histogram.items():
        target[min(-(-n // width), whole + 1)] += count
    target[whole + 1] = 0
    usable = patterns(np.flatnonzero(target).tolist(), whole, depth)
    used, counts = fit_nnls(usable, target)
    order = np.argsort(-counts, kind="stable")
    fitted = [([b for b in usable[used[k]].tolist() if b], float(counts[k])) for k in order]
    best: list[tuple[int, int, int, int, int]] = []
    for share in SHARES:
        places = _placed(histogram, capacity, width, [(pattern, int(count * share)) for pattern, count in fitted])
        if not best or _sequences(places) < _sequences(best):
            best = places
    return best


def _sequences(places: list[tuple[int, int, int, int, int]]) -> int:
    return max((s + last - first for _, first, last, s, _ in places), default=0)


def _placed(histogram: dict[int, int], capacity: int, width: int, repeated: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """The plan by patterns of bins with their repeats, as far as they fill sequences exactly, and best fit for the rest."""
    taken: dict[int, int] = defaultdict(int)
    left = {n: c for n, c in histogram.items() if c}
    by_bin: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        by_bin[-(-n // width)].append(n)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    sequences = 0

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        places.append((length, taken[length], taken[length] + count, sequence, offset))
        taken[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((sequence, count))

    lengths_left = sorted(left)
    for pattern, repeats in repeated:
        while repeats > 0:
            # Alternate the long and the short end of the bins; the last place takes the longest piece that fits.
            chosen = []
            for nth, b in enumerate(pattern[:-1]):
                free = [n for n in by_bin[b] if left[n] > chosen.count(n)]
                if not free:
                    break
                chosen.append(free[-1] if nth % 2 == 0 else free[0])
            if len(chosen) < len(pattern) - 1:
                break
            room = capacity - sum(chosen)
            at = bisect_right(lengths_left, room) - 1
            while at >= 0 and left[lengths_left[at]] <= chosen.count(lengths_left[at]):
                if not left[lengths_left[at]]:
                    lengths_left.pop(at)
                at -= 1
            if at < 0 or lengths_left[at] < room:
                break
            chosen.append(lengths_left[at])
            run = min(repeats, *(left[n] // chosen.count(n) for n in chosen))
            offset = 0
            for n in chosen:
                put(n, run, sequences, offset)
                offset += n
            sequences += run
            repeats -= run
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at < len(sizes):
                gap = sizes[at]
                sequence, count = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
                run = min(count, left[n])
                put(n, run, sequence, capacity - gap)
                leave(gap - n, sequence, run)
                leave(gap, sequence + run, count - run)
                continue
            times = capacity // n
            for each in (times, left[n] % times):
                run = left[n] // each if each else 0
                for k in range(each if run else 0):
                    put(n, run, sequences, k * n)
                if run:
                    leave(capacity - each * n, sequences, run)
                    sequences += run
    return places


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with the columns length and uid.

    `cut` must be stored: it is read for the histogram, for the ranks and for the result. Pieces of one length are
    ranked in groups of about RANKED, so a length that holds most rows is spread over many tasks. The plan is
    broadcast: it has a few rows per length and pattern, so at most some tens of thousands whatever the input.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = [(n, max(1, -(-c // RANKED))) for n, c in histogram.items()]
    places = plan(histogram, capacity)
    split = F.broadcast(spark.createDataFrame(groups, "length long, groups long"))
    where = F.broadcast(spark.createDataFrame(places, "length long, first long, last long, sequence long, offset long"))
    salted = cut.join(split, "length").withColumn("salt", F.pmod("uid", "groups")).drop("groups")
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    ranked = (
        salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
        .drop("before", "nth", "salt")
    )
    placed = ranked.join(where, "length").where("rank >= first and rank < last")
    return placed.withColumn("sequence_id", F.expr("sequence + rank - first")).drop("first", "last", "sequence", "rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    An empty table gives an empty result; further columns of docs are not read.
    """
    packed = pack(stored(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
