"""Bringing together the nodes of a similarity join that may be linked: by shared keys, then in groups
of a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .frames import discard, written
from .wordhash import U, mix

Keyed = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
#: Gives for each row the index of the first of its component: link(rows), or link(rows, starts) of several groups.
Link = Callable[..., np.ndarray]
LISTS = "root long, node long, pivot long, several boolean"


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by a and then b."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    tied = np.zeros(len(a) + 1, bool)
    tied[1:-1] = a[1:] == a[:-1]
    some = np.flatnonzero(tied[1:] | tied[:-1])  # most a stand once
    b[some] = b[some][np.lexsort((b[some], a[some]))]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


class BucketLists:
    """Lists of the owners that share a key, as (root, node, pivot, several): root names the list, pivot
    is one of its nodes, several tells lists of three or more. Keys of one bucket come in packs. A list
    that ends within the memory limit is named by its owners, so that equal lists are one; beyond the
    limit, owners of a repeated key are passed on under the key's name as they come."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.packs = limit, 0, []
        self.seen, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: bytes, owners: bytes) -> pa.RecordBatch | None:
        self.packs.append((np.frombuffer(keys, np.uint64), np.frombuffer(owners, np.int64)))
        self.held += len(keys)
        return self.passed_on() if self.held > self.limit else None

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k, s = distinct_pairs(*(np.concatenate(x) for x in zip(*self.packs, strict=True)))
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
        return k, s, at, np.diff(np.append(at, len(k)))

    def passed_on(self, last: bool = False) -> pa.RecordBatch:
        k, s, at, sizes = self.merged()
        known = np.isin(k[at], self.seen)
        new = ~known & (sizes > 1)
        order = np.argsort(seen := np.concatenate([self.seen, k[at][new]]))
        self.seen, self.first = seen[order], np.concatenate([self.first, s[at][new]])[order]
        out = np.repeat(known | new, sizes)
        self.packs = [] if last else [(k[~out], s[~out])]
        self.held = 0 if last else 8 * int((~out).sum())
        self.limit = max(self.limit, 2 * self.held)  # keys that are still alone stay
        pivot = self.first[np.searchsorted(self.seen, k[out])]
        return _lists(mix(k[out] + U(1)).view(np.int64), s[out], pivot, np.ones(len(pivot), bool))

    def end(self) -> pa.RecordBatch:
        if len(self.seen):
            return self.passed_on(last=True)
        k, s, at, sizes = self.merged()
        own = np.repeat(sizes > 1, sizes)
        s, sizes = s[own], sizes[sizes > 1]
        at = np.cumsum(sizes) - sizes
        name = mix(np.add.reduceat(mix(s.view(np.uint64)), at) + sizes.astype(np.uint64)).view(np.int64) if len(at) else s[:0]
        _, one = np.unique(name, return_index=True)
        n = sizes[one]
        spot = np.repeat(at[one] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return _lists(np.repeat(name[one], n), s[spot], np.repeat(s[at[one]], n), np.repeat(n > 2, n))


def _lists(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["root", "node", "pivot", "several"])


def lists_by_key(df: DataFrame, keyed: Keyed, n_buckets: int, limit: int = 16 << 20) -> DataFrame:
    """The lists of owners that share a key. keyed gives the keys of a batch and their owners; each
    travels once a batch, packed with the others of its bucket. Buckets are sorted, not gathered."""

    def packed(batches):
        for batch in (whole.slice(lo, 2048) for whole in batches for lo in range(0, whole.num_rows, 2048)):
            k, s = distinct_pairs(*keyed(batch))
            bucket = ((k >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), bucket[1:] != bucket[:-1]]))
            for lo in range(0, len(at), 1024):
                x = at[lo : lo + 1024].tolist()
                y = [*x[1:], int(at[lo + 1024]) if lo + 1024 < len(at) else len(k)]
                rows = [[k[i:j].tobytes() for i, j in zip(x, y, strict=True)], [s[i:j].tobytes() for i, j in zip(x, y, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[x]), *(pa.array(r, pa.binary()) for r in rows)], names=["bucket", "keys", "owners"])

    def listed(batches):
        now, held = None, None
        for b in batches:
            for bucket, keys, owners in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    if held is not None:
                        yield held.end()
                    now, held = bucket, BucketLists(limit)
                if (out := held.add(keys, owners)) is not None:
                    yield out
        if held is not None:
            yield held.end()

    packs = df.mapInArrow(packed, "bucket long, keys binary, owners binary")
    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(listed, LISTS).distinct()


def candidate_forest(lists: DataFrame, near: DataFrame, data: DataFrame, link: Link, tile_nodes: int, together: int = 0) -> DataFrame:
    """(a, b): links that join the nodes that share a list and may be linked. near (written) holds the edges (a, b) between
    the lists' nodes and their pivots; lists that still span several components of it are searched by link, see linked_members."""
    stars = connected_components(near)
    found = stars.withColumnRenamed("root", "part")
    part = F.coalesce("part", "node")
    spans = lists.where("several").join(found, "node", "left").groupBy("root").agg(F.min(part).alias("lo"), F.max(part).alias("hi"))
    still = written(lists.join(spans.where("lo < hi").select("root"), "root", "left_semi").select("root", "node", F.lit(1).alias("weight")), "open-lists")
    rest = written(linked_members(still, data, link, tile_nodes, tile_nodes, together), "open-links")
    discard(still)
    return stars.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)


def hash_filter(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for pmod(xxhash64(column), bits): a filter of bounded size (bits / 8 bytes) ahead of an exact join."""
    spot = F.pmod(F.xxhash64(column), F.lit(bits))
    held = ids.select((spot / 32).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), {bits}) % 32 as int))").alias("x"))
    found = held.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found.column("w").to_numpy()] = found.column("x").to_numpy().astype(np.uint32)
    return out


def passes(held: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return ((held[spots // 32] >> (spots % 32).astype(np.uint32)) & 1).astype(bool)


def linked_members(members: DataFrame, data: DataFrame, link: Link, tile_nodes: int, tile_weight: int, together: int = 0) -> DataFrame:
    """(a, b): links that join, within each root, the nodes that are linked directly or through others.

    members has root, node and weight, data has node and what link needs; link gives for each row of a
    group the index of the first row of its component. With `together` it gets the rows of several groups at once, of so many
    rows until a group ends, and where each group begins, so that small groups cost no calls of their own. A root that is too large for a task is cut into
    tiles, each with the root's smallest node; nodes that don't end up in the component of that node are
    then compared with every tile, so the rows sent follow the members, times the blocks of such nodes.
    """
    per = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("weight").alias("total"), F.min("node").alias("pivot"))
    tiles = F.greatest(F.ceil(F.col("m") / tile_nodes), F.ceil(F.col("total") / tile_weight)).cast("int")
    per = written(per.select("root", "pivot", tiles.alias("tiles")), "group-tiles")
    large = per.where("tiles > 1")
    tile = F.pmod(F.xxhash64("node", F.lit(1)), "tiles").cast("int")
    if large.isEmpty():
        return linked_in_groups(members.select(F.col("root").alias("grp"), "node"), data, link, together)
    placed = members.join(per, "root").select("root", "node", "pivot", "tiles", tile.alias("tile"))
    grp = F.when(F.col("tiles") == 1, F.col("root")).otherwise(F.xxhash64("root", "tile"))
    pivots = large.select(F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "root", F.col("pivot").alias("node")).select(F.xxhash64("root", "tile").alias("grp"), "node")
    found = written(linked_in_groups(placed.select(grp.alias("grp"), "node").unionByName(pivots).distinct(), data, link, together), "tile-links")
    part = connected_components(found).withColumnsRenamed({"root": "part"})
    own = placed.where("tiles > 1").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    main = own.where("node = pivot").select("root", F.col("part").alias("main"))
    apart = own.join(main, "root").where("part != main").select("root", "node", "tiles")
    blocks = apart.groupBy("root").agg(F.ceil(F.count("*") / tile_nodes).cast("int").alias("blocks"))
    apart = apart.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int"))
    key = F.xxhash64("root", "tile", "block").alias("grp")
    asked = apart.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(key, "node")
    there = placed.join(blocks, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(key, "node")
    return found.unionByName(linked_in_groups(asked.unionByName(there).distinct(), data, link, together))


def linked_in_groups(groups: DataFrame, data: DataFrame, link: Link, together: int = 0, most_held: int = 8 << 20) -> DataFrame:
    """(a, b): the links that link finds in each grp of (grp, node), joined with data by node. Groups go to link together until they have
    `together` rows or `most_held` characters or bytes of texts."""
    columns = [c for c in data.columns if c != "node"]

    def flush(rows: list[tuple], starts: list[int]) -> pa.RecordBatch:
        held = [r[1:] for r in rows]
        root, ids = link(held, starts) if together else link(held), np.array([r[0] for r in rows], np.int64)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[root[tied]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, rows, starts, held = None, [], [], 0
        for b in batches:
            for g, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if g != grp:
                    if starts and len(rows) == starts[-1] + 1:  # nothing to link with
                        rows.pop()
                        starts.pop()
                    if len(rows) > together or held > most_held:
                        yield flush(rows, starts)
                        rows, starts, held = [], [], 0
                    grp = g
                    starts.append(len(rows))
                rows.append(row)
                held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(rows) > 1:
            yield flush(rows, starts)

    ordered = groups.join(data, "node").select("grp", "node", *columns).repartition("grp").sortWithinPartitions("grp", "node")
    return ordered.mapInArrow(run, T.StructType().add("a", "long").add("b", "long"))
