"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Merges of a pre-token are taken from a rank queue: every adjacent pair that the vocabulary holds is
filed in the bucket of its rank, as the position of its left token in a linked list. A bitmap marks
the buckets that hold something and a second bitmap the words of the first that aren't zero, so the
lowest rank is found by two find-first-set steps whatever the length. A merge relinks the list and
files the two pairs that it makes; entries of pairs that are gone stay and are skipped when met.
Within a bucket the leftmost position goes first. A pre-token of n bytes takes O(n log n) steps at most.

Texts are split by the vocabulary's pattern; a pre-token that is itself a token is taken whole.
Pre-tokens recur, so each is encoded once per worker as long as its generation of the memory lasts.
Null and empty texts have no ids, repeated rows are encoded one by one, ids that the vocabulary
doesn't hold raise an error when decoded. No shuffle; memory follows the Arrow batch.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import with_struct

TOKENS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

#: A cut before a space that follows a visible character is always one of the pattern's own, so chunks split alone as they do in the text.
_CHUNK = regex.compile(r"[^ ]?\S*(?:[^\S ]\s*\S*)*| \s*\S*(?:[^\S ]\s*\S*)*")


class RankQueue:
    """Positions by rank; the lowest rank first, of equal ranks the lowest position.

    A bucket that holds one position is that position, one that holds more is a heap. `push` and `pop` are
    closures over the bitmaps, as they run some twenty times for every new pre-token.
    """

    def __init__(self, n_ranks: int) -> None:
        shift = max(1, (max(n_ranks - 1, 1).bit_length() + 1) // 2)
        bits = [1 << i for i in range(1 << shift)]
        low = len(bits) - 1
        words, buckets, top = [0] * ((n_ranks >> shift) + 1), [None] * n_ranks, 0

        def push(rank: int, position: int) -> None:
            nonlocal top
            bucket = buckets[rank]
            if bucket is None:
                buckets[rank] = position
                word = rank >> shift
                held = words[word]
                if not held:
                    top |= bits[word]
                words[word] = held | bits[rank & low]
            elif type(bucket) is int:
                buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
            else:
                heappush(bucket, position)

        def pop() -> tuple[int, int] | None:
            """The next (rank, position), None when the queue is empty."""
            nonlocal top
            if not top:
                return None
            word = (top & -top).bit_length() - 1
            held = words[word]
            bit = held & -held
            rank = (word << shift) + bit.bit_length() - 1
            position = buckets[rank]
            if type(position) is not int:
                bucket, position = position, heappop(position)
                if bucket:
                    return rank, position
            buckets[rank] = None
            held ^= bit
            words[word] = held
            if not held:
                top ^= bits[word]
            return rank, position

        self.push, self.pop = push, pop


class BytePairCodec:
    """The tokens of a rank file (a base64 token and its rank per line), with a splitting pattern."""

    def __init__(self, path: str, pattern: str, held: int = 400_000) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(len(self.tokens))
        self.pieces = _Generations(self._piece, held)
        self.chunks = _Generations(self._chunk, held)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        # a token starts at i and ends where the next starts: after[i]; before[i] is the start of the one on its left
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * n
        push, pop, find = self.queue.push, self.queue.pop, ranks.get
        for i in range(n - 1):
            rank = find(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        while (entry := pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                made = find(piece[i : after[end]])
                if made is not None:
                    pair[i] = made
                    push(made, i)
            left = before[i]
            if left >= 0:
                made = find(piece[left:end])
                if made is None:
                    pair[left] = -1
                else:
                    pair[left] = made
                    push(made, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode()), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        held = self.pieces
        return b"".join([held[p] for p in self.pattern.findall(chunk)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        parts = text.split(" ")
        # a part that is empty or ends in white space has its space, or the next, in a longer run: cut with care
        if all(parts) and not any(p[-1].isspace() for p in parts):
            chunks = self.chunks
            return chunks[parts[0]] + b"".join([chunks[f" {p}"] for p in parts[1:]])
        return b"".join([self.chunks[c] for c in _CHUNK.findall(text) if c])

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        try:
            found = [tokens[i] for i in ids]
        except IndexError:
            raise ValueError("an id lies outside the vocabulary") from None
        if ids and (min(ids) < 0 or not all(found)):
            raise ValueError("an id lies outside the vocabulary")
        return b"".join(found)


class _Generations(dict):
    """Values by text, made when first asked for. When `held` are kept, they become the old generation, from
    which those still in use come back; what is older is forgotten. Texts over 200 characters aren't kept."""

    def __init__(self, make, held: int) -> None:
        super().__init__()
        self.make, self.held, self.old = make, held, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 200:
            if len(self) >= self.held:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_LOADED: dict[tuple, BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One per Python worker."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = BytePairCodec(path, pattern)
    return _LOADED[key]


def encoded_column(column: pa.Array, ranks: str, pattern: str) -> pa.Array:
    """(n_tokens, ids) of each text of an Arrow column."""
    encode = codec(ranks, pattern).encode
    sizes, parts = [], []
    for lo in range(0, len(column), 500):
        held = [encode(t) if t else b"" for t in column.slice(lo, 500).to_pylist()]
        sizes += [len(p) // 4 for p in held]
        parts.append(b"".join(held))
    n = np.array(sizes, np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(parts), "<i4"))
    return pa.StructArray.from_arrays([pa.array(n), lists], names=["n_tokens", "ids"])


def decoded_column(column: pa.Array, ranks: str, pattern: str) -> pa.Array:
    """The bytes that each list of ids of an Arrow column stands for."""
    decode = codec(ranks, pattern).decode
    return pa.array([decode(v.values.to_numpy().tolist()) if v.is_valid else b"" for v in column], pa.binary())


def packed_column(column: pa.Array) -> pa.Array:
    """The ids of each list of an Arrow column as little-endian unsigned 32-bit integers."""
    if column.null_count:
        column = pa.array([v or [] for v in column.to_pylist()], pa.list_(pa.int32()))
    values = column.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    offsets = (4 * (offsets - offsets[0])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def encode_texts(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """df with a struct column of n_tokens and ids of each text."""
    return with_struct(df, text, out, TOKENS, lambda column: encoded_column(column, ranks, pattern))


def decode_ids(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the ids of each row stand for; a null list is empty."""
    return with_struct(df, ids, out, T.BinaryType(), lambda column: decoded_column(column, ranks, pattern))


def packed_ids(df: DataFrame, ids: str = "ids", out: str = "packed") -> DataFrame:
    """df with the ids of each row as little-endian unsigned 32-bit integers; a null list is empty."""
    return with_struct(df, ids, out, T.BinaryType(), packed_column)


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "coded") -> DataFrame:
    """df with a struct column of n_tokens, ids_sha256 and decoded_sha256: the digests of what packed_ids and
    decode_ids give for the ids of encode_texts, in one pass."""
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    digests = lambda column: pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in column], pa.string())

    def both(column: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, max(len(column), 1), 500):
            n, ids = encoded_column(column.slice(lo, 500), ranks, pattern).flatten()
            parts.append(pa.StructArray.from_arrays([n, digests(packed_column(ids)), digests(decoded_column(ids, ranks, pattern))], names=fields.names))
        return pa.concat_arrays(parts)

    return with_struct(df, text, out, fields, both)
