"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over all tokens finds, for each position of a
pre-token, the longest token that starts there. The encoder takes longest matches and steps back to shorter prefixes
whenever two neighbours would not both survive the merges; whether they do is decided by undoing merges across their
border and is memoised per pair. Each position is given up at most once, so the work is linear in the length, and the
result is that of the merges themselves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pre-tokens and chunks that a worker keeps the ids of; emptied when full, which costs time and changes no result.
MEMO = 1_000_000
#: A chunk is a run without white space, with the space before it; PATTERN's matches never cross chunks. Where the
#: engines disagree on white space (U+001C to U+001F) texts are split by PATTERN alone.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.rank = {token.decode("latin-1"): n for token, n in ranks.items()}
        self.token = {n: s for s, n in self.rank.items()}
        self.bytes = {n: b for b, n in ranks.items()}
        self.find = ahocorasick.Automaton()
        for s, n in self.rank.items():
            self.find.add_word(s, (n, len(s)))
        self.find.make_automaton()
        self.pattern = regex.compile(pattern)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(n) for token, n in map(bytes.split, f)}, pattern)

    def split(self, n: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of token n joins; None for a single byte or a token no merges make."""
        if n not in self.parts:
            s, rank = self.token[n], self.rank
            parts = list(s)
            while len(parts) > 2:
                best = min((r, k) for k in range(len(parts) - 1) if (r := rank.get(parts[k] + parts[k + 1], n)) <= n)
                if best[0] >= n:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self.parts[n] = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else None
        return self.parts[n]

    def prefix(self, n: int) -> int | None:
        """The longest token that is a proper prefix of token n."""
        if n not in self.shorter:
            s = self.token[n]
            self.shorter[n] = next((self.rank[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.rank), None)
        return self.shorter[n]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a followed by b ends in exactly these two tokens."""
        key = (a, b)
        if key not in self.fits:
            self.fits[key] = self.undo(a, b)
        return self.fits[key]

    def undo(self, a: int, b: int) -> bool:
        """Take back the later of the merges on either side of the border; no earlier pair there may have merged."""
        rank, token = self.rank, self.token
        done = len(token) + 1  # merges of this rank and above are undone
        while True:
            joined = rank.get(token[a] + token[b])
            if joined is not None and joined < done:
                return False
            left, right = self.split(a), self.split(b)
            # Equal ranks on both sides merge from the left, so the right one is the later.
            if left and (a > b or not right):
                done, a = a, left[1]
            elif right:
                done, b = b + 1, right[0]
            else:
                return True

    def encode(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        longest: dict[int, int] = {}
        for end, (n, size) in self.find.iter(piece):
            longest[end - size + 1] = n
        ids: list[int] = []
        at, size, closed, token = 0, len(piece), set(), self.token
        n: int | None = longest[0]
        while at < size:
            last = ids[-1] if ids else None
            while n is not None and (at + len(token[n]) in closed or (last is not None and not self.compatible(last, n))):
                n = self.prefix(n)
            if n is None:
                closed.add(at)
                n = ids.pop()
                at -= len(token[n])
            else:
                ids.append(n)
                at += len(token[n])
                n = longest.get(at)
        return ids

    def chunk(self, chunk: str) -> bytes:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        found = []
        for match in self.pattern.findall(chunk):
            ids = memo.get(match)
            if ids is None:
                ids = memo[match] = np.array(self.encode(match.encode().decode("latin-1")), "<u4").tobytes()
            found.append(ids)
        ids = memo[chunk] = b"".join(found)
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        get, chunk = self.memo.get, self.chunk
        matches = self.pattern.findall(text) if ODD_SPACE.search(text) else CHUNK.findall(text)
        return b"".join([get(m) or chunk(m) for m in matches])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe.from_file(path, pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, if keep_ids), ids_sha256, decoded_sha256 for every row of docs.

    A null text counts as empty: no tokens and the digests of nothing. Repeated rows and null doc_ids give a row each;
    further columns are not read. The digests are of the ids as little-endian unsigned 32-bit integers and of the
    bytes that the ids decode to.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in batches:
            ids, counts, hashes, back = [], [], [], []
            for text in batch.column(1):
                packed = own.packed(text.as_py() or "")
                counts.append(len(packed) // 4)
                hashes.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(own.decode(packed)).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype("i4"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64())}
            columns |= {"ids": pa.array(ids, pa.list_(pa.int32()))} if keep_ids else {}
            columns |= {"ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, {'ids array<int>, ' * keep_ids}ids_sha256 string, decoded_sha256 string")
