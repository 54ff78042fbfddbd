"""Alignment of two tokenizers' tokens over the bytes that they share.

Tokenizer A is a byte-level BPE, B a sentence piece model. Each text, with a space before it, gives two
incidence matrices of tokens by bytes in compressed rows. Gustavson's row product of A with B transposed
holds, for every pair of tokens, the bytes that both cover: its entries are the overlap links. Offsets
where tokens of both end cut the text into groups; the product of the two token-by-group matrices links
the tokens that share a group. It is kept as its factors (a range of A and of B tokens for each group)
with the exact number of its entries, as a group of n and m tokens has n * m of them.

A space after a visible character starts a new token in both, so the matrices are block diagonal over
the chunks between such spaces. Chunks recur: each block is multiplied once per worker, for as long as
it is remembered, and the rows of a text are its blocks in order.

Texts are encoded once; each row's distinct linked id pairs are written as a table. The counts of pairs
cover the whole corpus: they are summed in each task and then by Spark. Scores need the counts again:
the `heavy` most frequent pairs, a bounded number, are broadcast, and the links of all other pairs are
joined by pair.

Texts that are null, empty, or that a tokenizer doesn't reproduce byte by byte have no tokens: zeros and
empty lists. Repeated rows count as documents of their own; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import discard, free_name, with_struct, written
from .wordhash import row_sums


@dataclass(frozen=True)
class AlignSettings:
    a_path: str
    b_path: str
    heavy: int = 400_000  # id pairs whose counts are sent to every task
    held_chunks: int = 200_000
    piece_chars: int = 1 << 19  # text handled at once


@dataclass(frozen=True)
class Csr:
    """A matrix in compressed rows: row r has ones, or `value`, in the columns column[start[r]:start[r+1]]."""

    start: np.ndarray
    column: np.ndarray
    n_columns: int
    value: np.ndarray | None = None

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def transposed(self) -> Csr:
        order = np.argsort(self.column, kind="stable")
        return Csr(np.searchsorted(self.column[order], np.arange(self.n_columns + 1)), self.row_of()[order], len(self.start) - 1)


def spans_matrix(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens of these lengths that follow one another."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(start, np.arange(start[-1]), int(start[-1]))


def product(a: Csr, b: Csr) -> Csr:
    """a times b by rows: row r of the product gathers the rows of b that row r of a names and sums equal columns."""
    sizes = np.diff(b.start)[a.column]
    rows = np.repeat(a.row_of(), sizes)
    first = np.cumsum(sizes) - sizes
    columns = b.column[np.repeat(b.start[a.column] - first, sizes) + np.arange(len(rows))]
    keys = rows * b.n_columns + columns
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
        keys = np.sort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    rows, columns = np.divmod(keys[at], max(b.n_columns, 1))
    return Csr(np.searchsorted(rows, np.arange(len(a.start))), columns, b.n_columns, np.diff(np.append(at, len(keys))))


def product_row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """The entries of each row of a times b where no two rows of b share a column."""
    return row_sums(np.diff(b.start)[a.column], a.start)


def byte_level_bytes() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: visible Latin-1 characters stand for
    themselves, the other bytes in order for the characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: A chunk runs from a space to the next space that follows a visible character.
_CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


class Blocks:
    """The chunks met so far with their tokens, links and groups, in flat arrays."""

    def __init__(self, settings: AlignSettings) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.settings = settings
        self.a = Tokenizer.from_file(settings.a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=settings.b_path)
        byte_of = byte_level_bytes()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of the second tokenizer hold spaces inside, so texts can't be cut at spaces")
        self.space = self.b.piece_to_id("▁")
        self.n_b = len(pieces)
        self.a_length, self.b_length = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.numerals = pa.array([str(i) for i in range(max(len(self.a_bytes), self.n_b))])
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.index: dict[str, int] = {}
        self.valid: list[bool] = []
        self.text: list[bytes] = []
        #: By chunk: tokens of A and B, groups, overlap links, entries of the shared-group product.
        self.sizes = np.zeros((0, 5), np.int64)
        self.pair_at = np.zeros(1, np.int64)
        self.pairs = none  # a id * n_b + b id of every link
        self.bytes = none  # bytes that the link's tokens share
        self.used = none  # how often each chunk was met

    def keep_used(self) -> None:
        """Forgets the chunks met once, and beyond half of what may be held the least used ones."""
        most = self.settings.held_chunks // 2
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[:most]])
        chunks, order = list(self.index), kept.tolist()  # the index holds them in order
        self.index = {chunks[i]: k for k, i in enumerate(order)}
        self.valid, self.text = [self.valid[i] for i in order], [self.text[i] for i in order]
        self.sizes, self.used = self.sizes[kept], self.used[kept] // 2
        of, at = _ranges(self.pair_at, kept)
        self.pairs, self.bytes, self.pair_at = self.pairs[at], self.bytes[at], np.searchsorted(of, np.arange(len(kept) + 1))

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, first, valid): the chunks of row r are chunk[first[r]:first[r+1]], none where it isn't valid."""
        if len(self.index) > self.settings.held_chunks:
            self.keep_used()
        found = [_CHUNK.findall(f" {t}") if t else [] for t in texts]
        index = self.index
        fresh = list({c for row in found for c in row if c not in index})
        for lo in range(0, len(fresh), 20_000):
            self.learn(fresh[lo : lo + 20_000])
        every = np.fromiter(map(index.__getitem__, chain.from_iterable(found)), np.int64)
        self.used += np.bincount(every, minlength=len(self.used))
        first = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int64)
        n = np.diff(first)
        broken = row_sums(~np.array(self.valid, bool)[every], first) if len(every) else np.zeros(len(n), np.int64)
        valid = (n > 0) & (broken == 0)
        if not valid.all():
            every = every[np.repeat(valid, n)]
            first = np.concatenate([[0], np.cumsum(np.where(valid, n, 0))])
        return every, first, valid

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """(A ids, their ends by chunk, B ids, theirs, valid). Chunks that end in a visible character are encoded as one text:
        where they meet is a cut of the kind that makes chunks. If bytes differ there, or for other chunks, each alone."""
        ids: tuple[list[int], list[int]] = ([], [])
        at: tuple[list[int], list[int]] = ([0], [0])
        valid: list[bool] = []
        tables = (self.a_bytes, self.b_bytes)

        def add(part: list[str]) -> None:
            text = "".join(part)
            data = text.encode()
            # B writes a space before what it is given; it gives nothing for nothing, where the chunk is that space
            both = (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]) if text != " " else [self.space])
            pieces = [[t[i] for i in side] for t, side in zip(tables, both, strict=True)]
            if b"".join(pieces[0]) == data == b"".join(pieces[1]):
                ends = np.cumsum([len(c.encode()) for c in part])
                for side, own, held, starts in zip(both, pieces, ids, at, strict=True):
                    starts += (np.searchsorted(np.cumsum([len(t) for t in own]), ends) + 1 + len(held)).tolist()
                    held += side
                valid.extend([True] * len(part))
            elif len(part) == 1:
                for held, starts in zip(ids, at, strict=True):
                    starts.append(len(held))
                valid.append(False)
            else:
                for c in part:
                    add([c])

        lo = 0
        while lo < len(chunks):
            hi = lo + 1
            if not chunks[lo][-1].isspace():
                while hi < len(chunks) and hi < lo + 500 and not chunks[hi][-1].isspace():
                    hi += 1
            add(chunks[lo:hi])
            lo = hi
        return np.array(ids[0], np.int64), np.array(at[0], np.int64), np.array(ids[1], np.int64), np.array(at[1], np.int64), valid

    def learn(self, chunks: list[str]) -> None:
        a_ids, a_at, b_ids, b_at, valid = self.encode(chunks)
        a_spans, b_spans = spans_matrix(self.a_length[a_ids]), spans_matrix(self.b_length[b_ids])
        links = product(a_spans, b_spans.transposed())
        shared_ends = np.intersect1d(a_spans.start[1:], b_spans.start[1:], assume_unique=True)
        a_groups, b_groups = (Csr(np.arange(len(s.start)), np.searchsorted(shared_ends, s.start[1:]), len(shared_ends)) for s in (a_spans, b_spans))
        shared = product_row_sizes(a_groups, b_groups.transposed())
        every = np.arange(len(chunks) + 1)
        a_row = np.repeat(every[:-1], np.diff(a_at))
        group_at = np.searchsorted(a_row[np.searchsorted(a_spans.start[1:], shared_ends)], every)
        link_token = links.row_of()
        link_at = links.start[a_at]
        pairs = a_ids[link_token] * self.n_b + b_ids[links.column]
        sizes = np.stack([np.diff(a_at), np.diff(b_at), np.diff(group_at), np.diff(link_at), row_sums(shared, a_at)], 1)

        base = len(self.valid)
        self.index.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.valid += valid
        self.text += self._group_texts(a_ids, a_groups.column, b_ids, b_groups.column, group_at)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + link_at[1:]])
        self.pairs, self.bytes = np.concatenate([self.pairs, pairs]), np.concatenate([self.bytes, links.value])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])

    def _group_texts(self, a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, group_at: np.ndarray) -> list[bytes]:
        """a1,a2|b1;a3|b2 for each chunk."""

        def joined(rows: np.ndarray, parts: pa.Array, sep: str) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(rows.astype(np.int32), parts), sep)

        every = np.arange(int(group_at[-1]) + 1)
        sides = [joined(np.searchsorted(g, every), self.numerals.take(pa.array(ids)), ",") for ids, g in ((a_ids, a_group), (b_ids, b_group))]
        groups = pc.binary_join_element_wise(*sides, "|")
        return joined(group_at, groups, ";").cast(pa.binary()).to_pylist()


_LOADED: dict[AlignSettings, Blocks] = {}


def blocks(settings: AlignSettings) -> Blocks:
    """One per Python worker."""
    if settings not in _LOADED:
        _LOADED[settings] = Blocks(settings)
    return _LOADED[settings]


def _pieces(texts: list[str | None], limit: int):
    """Ranges of rows with at most limit characters each; a longer row stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _ranges(start: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of, at): for each entry of index in turn, the positions from start[i] to start[i+1]."""
    n = start[index + 1] - start[index]
    of = np.repeat(np.arange(len(index)), n)
    return of, np.arange(len(of)) + np.repeat(start[index] - (np.cumsum(n) - n), n)


LINK = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a_token", "b_token", "n_bytes")])
GROUP = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a_end", "b_end")])
ALIGNED = T.StructType([T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType())), T.StructField("links", T.ArrayType(LINK)), T.StructField("groups", T.ArrayType(GROUP))])


def align_texts(df: DataFrame, settings: AlignSettings, text: str = "text", out: str = "alignment") -> DataFrame:
    """df with a struct column: the ids of A and B, the overlap links as positions in those lists with the bytes
    shared, and for each group the positions where its tokens of A and B end."""

    def lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32), values)

    def aligned(column: pa.Array) -> pa.Array:
        held, texts, parts = blocks(settings), column.to_pylist(), []
        for lo, hi in _pieces(texts, settings.piece_chars):
            index, first, _ = held.rows(texts[lo:hi])
            n = hi - lo
            row = np.repeat(np.arange(n), np.diff(first))
            sizes = held.sizes[index]
            # a token of A starts a run of links, one of B starts where the link before has another B
            of, at = _ranges(held.pair_at, index)
            a, b = np.divmod(held.pairs[at], held.n_b)
            names = [held.text[i] for i in index.tolist()]
            groups = [tuple(len(s.split(b",")) for s in g.split(b"|")) for t in names for g in t.split(b";")]
            counts = np.array(groups, np.int64).reshape(-1, 2)
            group_row = np.repeat(row, sizes[:, 2])
            ids = [np.array([int(v) for t in names for g in t.split(b";") for v in g.split(b"|")[side].split(b",")], np.int64) for side in (0, 1)]
            a_row, b_row = np.repeat(row, sizes[:, 0]), np.repeat(row, sizes[:, 1])
            # the links of a block walk both token lists in step: each link opens a new token of A, of B or of both
            n_bytes = held.bytes[at]
            ends = np.cumsum(n_bytes)
            a_len, b_len = (np.array([len(table[i]) for i in ids[side]], np.int64) for side, table in ((0, held.a_bytes), (1, held.b_bytes)))
            a_token, b_token = np.searchsorted(np.cumsum(a_len), ends), np.searchsorted(np.cumsum(b_len), ends)
            link_row = row[of]
            a_first, b_first = np.searchsorted(a_row, np.arange(n)), np.searchsorted(b_row, np.arange(n))
            i32 = lambda v: pa.array(v.astype(np.int32))
            links = pa.StructArray.from_arrays([i32(a_token - a_first[link_row]), i32(b_token - b_first[link_row]), i32(n_bytes)], names=LINK.names)
            closed = [np.cumsum(counts[:, s]) - f[group_row] for s, f in ((0, a_first), (1, b_first))]
            ends = pa.StructArray.from_arrays([i32(v) for v in closed], names=GROUP.names)
            parts.append(pa.StructArray.from_arrays([lists(a_row, i32(ids[0]), n), lists(b_row, i32(ids[1]), n), lists(link_row, links, n), lists(group_row, ends, n)], names=ALIGNED.names))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(f.name, pa.list_(pa.int32())) for f in ALIGNED]))

    return with_struct(df, text, out, ALIGNED, aligned)


SIZES = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
LINKED = T.StructType([*[T.StructField(c, T.LongType()) for c in SIZES], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


def linked_pairs(df: DataFrame, settings: AlignSettings, text: str = "text", out: str = "linked") -> DataFrame:
    """df with a struct column: the sizes of each text's matrices, the digest of its groups, and its distinct linked id
    pairs (A's id in the upper 32 bits, B's in the lower) with the number of their links."""

    def linked(column: pa.Array) -> pa.Array:
        held, texts, parts = blocks(settings), column.to_pylist(), []
        for lo, hi in _pieces(texts, settings.piece_chars):
            n = hi - lo
            index, first, valid = held.rows(texts[lo:hi])
            sums = [pa.array(row_sums(c, first)) for c in held.sizes[index].T]
            groups, at, chunks = held.text, first.tolist(), index.tolist()
            shas = [hashlib.sha256(b";".join([groups[i] for i in chunks[x:y]])).hexdigest() if ok else "" for x, y, ok in zip(at[:-1], at[1:], valid.tolist(), strict=True)]
            # each chunk of a row once, with its number; then their pairs, local to the piece
            row = np.repeat(np.arange(n), np.diff(first))
            once, again = np.unique(row * max(len(held.valid), 1) + index, return_counts=True)
            row, index = np.divmod(once, max(len(held.valid), 1))
            of, spot = _ranges(held.pair_at, index)
            names, local = np.unique(held.pairs[spot], return_inverse=True)
            keys = row[of] * max(len(names), 1) + local
            order = np.argsort(keys)
            keys = keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            begins = np.flatnonzero(new)
            times = np.add.reduceat(again[of][order], begins) if len(begins) else np.zeros(0, np.int64)
            row, local = np.divmod(keys[begins], max(len(names), 1))
            a, b = np.divmod(names[local], held.n_b)
            offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((a << 32) | b, times)]
            parts.append(pa.StructArray.from_arrays([*sums, pa.array(shas, pa.string()), *lists], names=LINKED.names))
        kinds = [*[pa.int64()] * len(SIZES), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(LINKED.names, kinds, strict=True))))

    return with_struct(df, text, out, LINKED, linked)


def link_counts(linked: DataFrame, pairs: str = "linked.pairs") -> DataFrame:
    """(pair, n_docs): in how many rows each id pair is linked; `linked` has the rows of linked_pairs."""

    def counted(batches):
        names, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for last, batch in _with_last(batches):
            if batch is not None:
                keys, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
                names, inverse = np.unique(np.concatenate([names, keys]), return_inverse=True)
                sums = np.bincount(inverse, weights=np.concatenate([sums, n]), minlength=len(names)).astype(np.int64)
            if len(names) and (last or len(names) > 2_000_000):
                for lo in range(0, len(names), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 100_000]), pa.array(sums[lo : lo + 100_000])], names=["pair", "n_docs"])
                names, sums = names[:0], sums[:0]

    return linked.select(F.col(pairs).alias("pairs")).mapInArrow(counted, "pair long, n_docs long").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))


def _with_last(batches):
    """(whether it is the end, batch): every batch, then None."""
    for b in batches:
        yield False, b
    yield True, None


def _heavy(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, n_docs, is_best) of the most frequent pairs in ascending order, at most `most` of them. From which count on they
    all fit is found in a histogram of eighths of powers of two, so no ordering of all pairs is needed."""
    level = F.floor(F.log2("n_docs") * 8)
    histogram = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("n_docs").alias("least")).collect(), reverse=True)
    total, least = 0, None
    for r in histogram:
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    t = counts.where(F.col("n_docs") >= least if least is not None else F.lit(False)).select("pair", "n_docs", "is_best").toArrow()
    pair, n, best = (t.column(c).to_numpy() for c in ("pair", "n_docs", "is_best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


SCORED = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")], T.StructField("rest", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())])))])


def alignment_scores(df: DataFrame, settings: AlignSettings, text: str = "text") -> DataFrame:
    """df without its text, and per row n_a, n_b, n_groups, n_links, n_shared (pairs of tokens that share a group),
    n_best (links whose pair is among the most counted of its A id), count_sum (of the pairs' counts over
    links) and groups_sha256. Columns of those names that df has are replaced."""
    spark = df.sparkSession
    given = df.drop(*SIZES, "n_best", "count_sum", "groups_sha256")
    out, row = free_name(given, "linked"), free_name(given, "row")
    kept = [c for c in given.columns if c.lower() != text.lower()]
    # texts are encoded once: what follows reads their pairs
    linked = written(linked_pairs(given, settings, text, out).drop(text), "linked")
    pairs = written(link_counts(linked, f"{out}.pairs"), "pairs")
    a_id = F.shiftright("pair", 32)
    best = pairs.groupBy(a_id.alias("a_id")).agg(F.max("n_docs").alias("best"))  # a row for each id of A's vocabulary at most
    counts = pairs.withColumn("a_id", a_id).join(F.broadcast(best), "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("best")).alias("is_best"))
    heavy = spark.sparkContext.broadcast(_heavy(counts, settings.heavy))

    def scored(column: pa.Array) -> pa.Array:
        keys, n_docs, is_best = heavy.value
        lists, times = column.field("pairs"), column.field("times").flatten().to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, pair = offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False)
        spot = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        known = keys[spot] == pair if len(keys) else np.zeros(len(pair), bool)
        n, top = (np.where(known, v[spot] if len(keys) else 0, 0) for v in (n_docs, is_best))
        left = np.flatnonzero(~known)
        rest = pa.StructArray.from_arrays([pa.array(pair[left]), pa.array(times[left])], names=["pair", "times"])
        rest = pa.ListArray.from_arrays(np.searchsorted(left, offsets).astype(np.int32), rest)
        return pa.StructArray.from_arrays([pa.array(row_sums(top * times, offsets)), pa.array(row_sums(n * times, offsets)), rest], names=SCORED.names)

    slim = linked.withColumn(row, F.monotonically_increasing_id())
    found = free_name(slim, "scored")
    slim = with_struct(slim, out, found, SCORED, scored)
    slim = written(slim.select(*kept, row, found, *[F.col(f"{out}.{c}").alias(c) for c in (*SIZES, "groups_sha256")]), "scored")
    discard(linked)
    # the links of all other pairs, by pair
    open_links = slim.select(F.col(row).alias("row"), F.explode(f"{found}.rest").alias("link")).select("row", "link.*")
    more = open_links.join(counts, "pair").groupBy("row").agg(F.sum(F.col("n_docs") * F.col("times")).alias("more_sum"), F.sum(F.col("is_best").cast("long") * F.col("times")).alias("more_best"))
    extra = free_name(slim, "more")
    both = slim.join(more.select(F.col("row").alias(row), F.struct("more_sum", "more_best").alias(extra)), row, "left")
    add = lambda own, other: (F.col(f"{found}.{own}") + F.coalesce(F.col(f"{extra}.{other}"), F.lit(0))).alias(own)
    return both.select(*kept, *SIZES, add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")
