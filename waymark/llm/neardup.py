"""MinHash near-dedup with odd sketches.

A document is the set of its distinct word shingles. Documents with equal sets form a class and are represented once.
MinHash samples of each class give bands (equal bands make candidates) and an odd sketch: a bitmap in which each
sample flips one bit, so that the XOR of two sketches counts the samples in which two classes differ. That estimate
rules out candidates far below the threshold; all others are confirmed on the full sets.

Inside a bucket of equal bands not all pairs are formed. Each bucket links its members to one of them, chosen at random
per bucket; the nearest of these pairs are confirmed first and joined to components. Members of one bucket that are
still in different components are then compared with each other, in blocks of bounded size that return the links they
confirm and no pairs. So a large group of near copies costs a few rows per member and block, and no link between
different texts is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hot_keys, salted_join, stored, whole, wide_hash
from .graph import connected_components

#: Words in a shingle and the least similarity in per cent.
WORDS, PERCENT = 5, 80
#: Bands of so many samples each: a pair of similarity 0.8 shares a band but in 5 of 10**8 cases, one of 0.85 but in 1 of 10**10.
BANDS, ROWS = 32, 4
#: Samples folded into a sketch, its bits, and how far below the threshold an estimate must lie to rule a pair out
#: without confirmation: about six standard errors.
SAMPLES, BITS, SLACK = 256, 1024, 0.15
#: Members of a bucket that are compared with each other in one block.
BLOCK = 256
#: Documents to look at again whose keys are broadcast, at 24 bytes each, after their number has been counted.
HELD = 500_000
#: Words that a worker keeps the hash of; emptied when full.
MEMO = 1_000_000

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RANDOM.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash(word: bytes) -> int:
    h = _HASHES[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of so many words; of fewer words one shingle, of none none."""
    if len(_HASHES) > MEMO:
        _HASHES.clear()
    get = _HASHES.get
    found = np.array([get(w) or _hash(w) for w in (text or "").encode().translate(LOWER).split()], np.uint64)
    n = len(found)
    if not n:
        return found
    size = min(words, n)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total = _mix(total * _PLACES[k] + found[k : n - size + 1 + k])
    return np.unique(total)


def signature(found: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The set's own 64-bit id, its bands and its odd sketch (as signed 64-bit words)."""
    own = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        least = np.minimum(least, np.array([(part * f).min() for f in _FACTORS]) if len(part) > 512 else (part[None, :] * _FACTORS[:, None]).min(axis=1))
    least = _mix(least ^ _SALTS)
    bands = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        bands = _mix(bands * _PLACES[k] + least[np.arange(BANDS) * ROWS + k])
    flips = np.bincount((least % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    sketch = np.packbits(flips.astype(np.uint8)).view(np.int64)
    return own, bands.view(np.int64), sketch


def estimate(differing: np.ndarray | float) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    share = np.minimum(2 * np.asarray(differing, float) / BITS, 1 - 1e-9)
    return 1 + BITS * np.log1p(-share) / (4 * SAMPLES)


def most_differing(percent: int) -> int:
    """Differing bits up to which a pair is confirmed on the full sets."""
    return int(np.flatnonzero(estimate(np.arange(BITS + 1)) >= percent / 100 - SLACK)[-1])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_key, n_shingles, set_id, bands, sketch; the last three null for a document without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rest = [], [[], [], []]
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                sizes.append(len(found))
                for column, value in zip(rest, signature(found) if len(found) else (None, None, None)):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *[pa.array(c, t) for c, t in zip(rest, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "n_shingles", "set_id", "bands", "sketch"])

    rows = docs.select("doc_id", wide_hash("doc_id", "text").alias("row_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row_key struct<a:long,b:long>, n_shingles long, set_id long, bands array<long>, sketch array<long>")


def _differing(pairs: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """pairs (a, b and further columns) with the number of differing bits; hot are the set_ids of very many pairs."""
    kept = pairs.columns
    for side in "ab":
        pairs = salted_join(pairs, classes.select(F.col("set_id").alias(side), F.col("sketch").alias(f"sketch_{side}")), side, hot)
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.select(*kept, bits.alias("differ"))


def _full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """set_id and shingles (array<long>) of the wanted set_ids, made anew from one text of each class."""
    ends = stored(wanted.join(classes.select("set_id", "row_key"), "set_id"), "ends")
    held = F.broadcast(ends) if ends.count() <= HELD else ends  # beyond that the texts are shuffled
    rows = docs.select(wide_hash("doc_id", "text").alias("row_key"), "text").join(held, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["set_id", "shingles"])

    return stored(rows.select("set_id", "text").mapInArrow(run, "set_id long, shingles array<long>").dropDuplicates(["set_id"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    for side in "ab":
        pairs = salted_join(pairs, sets.select(F.col("set_id").alias(side), F.col("shingles").alias(f"set_{side}")), side, hot)
    both = pairs.select("a", "b", F.size("set_a").alias("m"), F.size("set_b").alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
    return both.where(100 * F.col("shared") >= percent * (F.col("m") + F.col("n") - F.col("shared"))).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """rows with comp_<column> for each column of set_ids: its component so far."""
    for c in columns:
        known = labels.select(F.col("node").alias(c), F.col("component").alias("_c"))
        rows = rows.join(known, c, "left").withColumn(f"comp_{c}", F.coalesce("_c", c)).drop("_c")
    return rows


def _by_block(rows: DataFrame, f, schema: str) -> DataFrame:
    """f on the rows of each (bucket, first, second), which lie together in one partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for frame in frames:
            for block, part in frame.groupby(["bucket", "first", "second"], sort=False):
                if block != key and held:
                    yield f(pd.concat(held, ignore_index=True))
                    held = []
                key = block
                held.append(part)
        if held:
            yield f(pd.concat(held, ignore_index=True))

    place = ["bucket", "first", "second"]
    return rows.repartition(*place).sortWithinPartitions(*place).mapInPandas(run, schema)


def _near(block: pd.DataFrame, limit: int) -> np.ndarray:
    """Pairs of rows (i, j) of a block that are in different components, have at most `limit` differing bits and share
    no band before the block's own: each pair of a bucket counts once in all its buckets.

    side tells the halves of a pair of blocks apart: 0 first, 1 second, 2 a block with itself.
    """
    side, comps, band = block["side"].to_numpy(), block["comp"].to_numpy(), int(block["band"].iloc[0])
    words, bands = np.stack(block["sketch"].to_numpy()).view(np.uint64), np.stack(block["bands"].to_numpy())
    out = []
    for i in np.flatnonzero(side != 1):
        other = np.flatnonzero((side != 0) & (comps != comps[i]))
        other = other[other > i] if side[i] == 2 else other
        other = other[~(bands[other, :band] == bands[i, :band]).any(axis=1)]
        other = other[np.bitwise_count(words[other] ^ words[i]).sum(axis=1, dtype=np.int64) <= limit]
        out.append(np.stack([np.full(len(other), i), other], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def _shared(sets: list[np.ndarray], pairs: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by products of membership matrices over slices of their elements: a
    slice's counts are small enough for single precision, their sums are kept in double."""
    elements, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    counts = np.zeros((len(sets), len(sets)))
    for low in range(0, len(elements), columns):
        cut = slice(*np.searchsorted(place, [low, low + columns]))
        held = np.zeros((len(sets), columns), np.float32)
        held[row[cut], place[cut] - low] = 1
        counts += held @ held.T
    return counts[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _block_links(block: pd.DataFrame, limit: int, percent: int) -> pd.DataFrame:
    """Confirmed links of a block, as few as connect what they connect."""
    pairs, ids = _near(block, limit), block["set_id"].to_numpy()
    links = []
    if len(pairs):
        used = np.unique(pairs)
        pairs = np.searchsorted(used, pairs)
        sets = [np.asarray(x, np.int64) for x in block["shingles"].iloc[used]]
        sizes, shared = np.array([len(x) for x in sets]), _shared(sets, pairs)
        pairs = pairs[100 * shared >= percent * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - shared)]
        root = list(range(len(used)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in pairs.tolist():
            if (x := find(i)) != (y := find(j)):
                root[x] = y
                links.append((ids[used[i]], ids[used[j]]))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _inside_buckets(members: DataFrame, sets_of, limit: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members of one bucket in different components.

    members has bucket, band, blocks, set_id, comp, sketch, bands; sets_of gives the full sets of stored set_ids. First
    only the members with a near partner are kept, then their sets join them; pairs are never rows.
    """
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    spread = spread.select("bucket", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "band", "set_id", "comp", "sketch", "bands", side)
    schema = "bucket long, first int, second int, band int, set_id long, comp long, sketch array<long>, bands array<long>, side int"
    partnered = stored(_by_block(spread, lambda block: block.iloc[np.unique(_near(block, limit))], schema), "partnered")
    sets = sets_of(partnered.select("set_id").distinct())
    full = partnered.join(sets, "set_id").select(*partnered.columns, "shingles")
    return _by_block(full, lambda block: _block_links(block, limit, percent), "a long, b long").distinct()


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and kept for every row of docs.

    component_id is the smallest doc_id that links lead to, the row's own included; a row is kept if that is its own.
    Texts without words (null included) are linked with nothing. Rows with null doc_ids link others but name no
    component unless all of it is null; then component_id is null and kept is true. Rows of one doc_id count as one
    document's, each with its own text. An empty table gives an empty result; further columns are not read.
    """
    rows = stored(signatures(docs, words), "signatures")
    classes = stored(
        rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes"
    )
    limit = most_differing(percent)
    # The bucket's key holds the band's number; its random member is the least of set_id XOR key.
    buckets = classes.select("set_id", F.posexplode("bands").alias("band", "value")).select("set_id", "band", F.xxhash64("band", "value").alias("bucket"))
    crowded = stored(
        buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.col("set_id").bitwiseXOR(F.col("bucket"))).alias("head")).where("size > 1")
        .select("bucket", "size", F.col("head").bitwiseXOR(F.col("bucket")).alias("head")), "buckets"
    )
    hot = hot_keys(crowded, "bucket", "size")
    members = stored(salted_join(buckets, crowded, "bucket", hot), "members")
    heads = crowded.join(F.broadcast(hot), "bucket", "left_semi").select("head")
    stars = members.where(F.col("set_id") != F.col("head")).groupBy(F.least("set_id", "head").alias("a"), F.greatest("set_id", "head").alias("b")).agg(F.min("size").alias("size"))
    stars = stored(_differing(stars, classes, heads).where(F.col("differ") <= limit), "pairs")
    sets_of = lambda wanted: _full_sets(wanted, docs, classes, words)

    def confirmed(pairs: DataFrame) -> DataFrame:
        fresh = stored(pairs.select("a", "b").distinct(), "pairs")
        ends = fresh.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        return stored(_confirmed(fresh, sets_of(ends), percent, heads), "links")

    # First each member's nearest star pair.
    ends = stars.select("a", "b", "differ", F.explode(F.array("a", "b")).alias("end"))
    links = confirmed(ends.groupBy("end").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b"))
    labels = stored(connected_components(links), "components")
    # What is left: pairs alone in a bucket, and inside larger buckets all members still in different components.
    links = confirmed(_labelled(stars.where("size = 2"), labels, "a", "b").where("comp_a != comp_b"))
    larger = _labelled(members.where("size > 2"), labels, "set_id").withColumnRenamed("comp_set_id", "comp")
    mixed = larger.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low != high")
    inside = larger.join(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket").join(classes.select("set_id", "sketch", "bands"), "set_id")
    inside = _inside_buckets(inside.select("bucket", "band", "blocks", "set_id", "comp", "sketch", "bands"), sets_of, limit, percent)
    # These links join the components found so far, not single documents.
    between = _labelled(links.unionByName(inside), labels, "a", "b").select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b"))
    joined = stored(connected_components(stored(between.where("a != b").distinct(), "between")), "joined")

    named = _labelled(classes.select("set_id", "doc_id"), labels, "set_id").withColumnRenamed("comp_set_id", "comp")
    named = _labelled(named, joined, "comp").withColumnRenamed("comp_comp", "component")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.select("set_id", "component").join(smallest, "component").select("set_id", "component_id"), "named")
    out = rows.select("doc_id", "row_key", "n_shingles", "set_id").join(named, "set_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "row_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that components() does not keep; all columns and other rows as they were."""
    kept = components(docs, words, percent).where("kept").select("row_key").distinct()
    return docs.select(whole(docs).alias("doc"), wide_hash("doc_id", "text").alias("row_key")).join(kept, "row_key", "left_semi").select("doc.*")
