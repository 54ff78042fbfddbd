"""Token ids as Parquet list columns.

Layout of a token folder: `tokens/` holds one file per shard in ascending document order with the
columns doc_id, shard, local_start, n_tokens (delta encoded) and ids (dictionary encoded list of
integers); `shards/` holds one row per shard with its document range and the number of ids before
it. Row groups and pages have set sizes and pages have indexes, so a reader that wants only the
metadata skips the ids, and one that wants a range of documents reads only the pages that hold it.

Documents are range-partitioned by id (ties by a hash of the text), so no shard depends on how many
rows share a source; encoding is one pass per shard. Null texts are encoded as empty, and every
document ends with `end_id`. Repeated ids are kept as rows of their own.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .wordhash import RAW, SPACE, row_ranges, span_hashes, utf8

_LOADED: dict[str, ChunkEncoder] = {}


@dataclass(frozen=True)
class TokenLayout:
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression, "parquet.writer.version": "v2", "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes), "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
        }


class ChunkEncoder:
    """Encodes texts with a tokenizer, chunk by chunk.

    The splitting of a plain byte-level tokenizer always starts a new piece at a space before a non-space, between
    a letter and a full stop, comma or the like, and around a single line end. So the ids of a text
    are those of its chunks cut there, in order. Chunks recur: each is encoded once and found again
    by its 64-bit hash, up to `held` chunks.
    """

    def __init__(self, path: str, held: int = 500_000, fresh: int = 50_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.held, self.fresh = Tokenizer.from_file(path), held, fresh
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        # with any other splitting a text is encoded as one chunk
        self.cuts = told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]  # hashes, index: all but the latest, and these
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1, np.int64)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each chunk, or -1."""
        out = np.full(len(hashes), -1)
        for keys, index in self.levels:
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[spot] == hashes
                out[hit] = index[spot[hit]]
        return out

    def learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        begin = len(self.at) - 1
        for lo in range(0, len(chunks), 5_000):
            parts = [e.ids for e in self.tokenizer.encode_batch_fast(chunks[lo : lo + 5_000], add_special_tokens=False)]
            ends = self.at[-1] + np.cumsum([len(x) for x in parts])
            while len(self.ids) < ends[-1]:
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.at[-1] : ends[-1]] = np.fromiter(chain.from_iterable(parts), np.int32, int(ends[-1] - self.at[-1]))
            self.at = np.concatenate([self.at, ends])
        old, new = self.levels
        new = _merged(new, (hashes, np.arange(begin, begin + len(hashes))))
        self.levels = [_merged(old, new), (hashes[:0], self.at[:0])] if len(new[0]) > self.fresh else [old, new]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of row d, end_id last, are ids[first[d]:first[d+1]]."""
        if len(self.at) > self.held:
            self.clear()
        starts = np.flatnonzero(_cuts(data, offsets)) if self.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
        ends = np.append(starts[1:], len(data))
        hashes, back = np.unique(span_hashes(data, starts, ends, RAW), return_inverse=True)
        index = self.known(hashes)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            example = np.zeros(len(hashes), np.int64)
            example[back] = np.arange(len(starts))
            text = data.tobytes()
            self.learn(hashes[missing], [text[a:b].decode() for a, b in zip(starts[example[missing]].tolist(), ends[example[missing]].tolist(), strict=True)])
            index = self.known(hashes)
        index = index[back]
        lengths = self.at[index + 1] - self.at[index]
        n = np.concatenate([[0], np.cumsum(lengths)])
        held = self.ids[np.repeat(self.at[index] - n[:-1], lengths) + np.arange(n[-1])]
        first = n[np.searchsorted(starts, offsets)] + np.arange(len(offsets))  # with an end id for each row before
        out = np.full(int(first[-1]), end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[first[1:] - 1] = False
        out[inner] = held
        return out, first


def _merged(a: tuple, b: tuple) -> tuple:
    keys, index = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys)
    return keys[order], index[order]


_WHITE = SPACE.copy()
_WHITE[[0x1C, 0x1D, 0x1E, 0x1F]] = True
_MAYBE_WHITE = _WHITE.copy()  # also the first bytes of other white space
_MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a chunk starts."""
    n = len(data)
    out = np.zeros(n, bool)
    if not n:
        return out
    before, after = np.empty_like(data), np.empty_like(data)
    before[0], before[1:], after[-1], after[:-1] = 0x20, data[:-1], 0x20, data[1:]
    two = np.empty_like(data)
    two[:2], two[2:] = 0, data[:-2]
    accented = (two == 0xC3) & (before != 0x97) & (before != 0xB7)  # the letters of U+00C0 to U+00FF
    solid = _PLAIN[before] | accented
    line = (data == 10) & solid  # a line end after a visible character
    out |= (data == 0x20) & ~_MAYBE_WHITE[after]
    out |= _STOP[data] & (_LETTER[before] | accented)
    out |= line
    out[1:] |= line[:-1] & ~_MAYBE_WHITE[data[1:]]
    edge = offsets[(offsets > 0) & (offsets < n)]
    # rules that look across the end of a row: undone, then the row's first byte starts a chunk
    out[edge - 1] &= ~((data[edge - 1] == 0x20))
    out[0] = True
    out[edge] = True
    return out


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def write_token_files(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, layout: TokenLayout | None = None) -> None:
    """Encodes the documents of df and writes them in ascending order of key below path."""
    spark, layout = df.sparkSession, layout or TokenLayout()
    ordered = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def encoded(batches):
        shard, at = TaskContext.get().partitionId(), 0
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in row_ranges(offsets):
                ids, first = encoder(tokenizer).encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                n = hi - lo
                lists = pa.ListArray.from_arrays(first.astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(np.full(n, shard, np.int32)), pa.array(at + first[:-1]), pa.array(np.diff(first)), lists], names=["doc_id", "shard", "local_start", "n_tokens", "ids"]
                )
                at += int(first[-1])

    rows = ordered.mapInArrow(encoded, "doc_id long, shard int, local_start long, n_tokens long, ids array<int>")
    rows.write.options(**layout.options()).parquet(f"{path}/tokens")
    sums = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
    # one row per file: a file holds many thousand documents, so this ordering stays small
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/shards")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; the ids aren't read."""
    return read_tokens(spark, path).drop("ids")


def read_tokens(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids, of documents first_doc to last_doc if given (pushed to the files)."""
    rows = spark.read.parquet(f"{path}/tokens")
    if first_doc is not None:
        rows = rows.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        rows = rows.where(F.col("doc_id") <= last_doc)
    starts = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_checksum(tokens: DataFrame, out: str = "ids_crc32") -> DataFrame:
    """tokens with the unsigned crc32 of the little-endian 32-bit ids in place of the ids."""
    kept = [c for c in tokens.columns if c not in ("ids", out)]
    schema = tokens.select(*kept).schema.add(out, "long")

    def summed(batches):
        for b in batches:
            lists = b.column(len(kept))
            at = lists.offsets.to_numpy()
            held = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(held[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.int64())], names=[*kept, out])

    return tokens.select(*kept, "ids").mapInArrow(summed, schema)
