"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct n-word shingles (lower-cased A-Z). Shingles are hashed into
groups; the counts of the groups make the document a point, and the overlap of two documents is at
most the sum of the coordinate minima of their points. A point has about one coordinate for every one
or two shingles, so the bound is as sharp for long documents as for short ones. An R-tree over the
points bounds the overlap of a query with a whole node by the node's largest coordinates, so only
nodes that can still reach the threshold are opened, and the pairs that survive are verified on the
shingles themselves.

How the work is spread: over a whole corpus the upper nodes of such a tree cover nearly the mean of
every coordinate and prune nothing but sizes, so documents are first routed to the trees that can
hold a partner. Within a band of set sizes two linked sets differ in at most d shingles; with the
hash range cut into more than d groups, they agree in the whole content of at least one group. Sets
that share a group's content make a list. The points of a list's sets are first bounded against one
of them, by short points and then by whole ones; lists that this doesn't settle form trees. Sets that
the bound connects are then verified on their shingles, in a tree again.

Equal sets are one node, so exact copies cost one row each. Within a tree, points that already belong
to a component leave it, so a thousand near copies need a thousand searches and not a million pairs.
A group that is too large for one task is cut into tiles that share one of its sets; only sets that
stay apart from that one meet all tiles. Components are exact; links inside a component aren't enumerated.

Nulls and empties: a text without words has an empty set and is linked with nothing; rows without an
id are passed on unlinked (their component is null). Rows that share an id are one document: it has
the links of each of its texts, and each row has the size of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import discard, free_name, written
from .routing import candidate_forest, hash_filter, linked_members, lists_by_key, passes
from .wordhash import LOWERED, U, mix, row_ranges, utf8, windows, words

EMPTY_GROUP = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class JaccardSettings:
    """Linked: 100 * intersection >= percent * union, over n-word shingles."""

    n: int = 5
    percent: int = 80
    band_ratio: float = 1.5
    least_coordinates: int = 64
    short_coordinates: int = 256
    leaf: int = 16
    tile_sets: int = 4096
    tile_shingles: int = 2 << 20
    bucket_keys: int = 1 << 18
    filter_bits: int = 1 << 26


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; with fewer than n words, the sequence is one."""
    hashes, _, _, first = words(data, offsets, LOWERED)
    _, rows, h = windows(hashes, first, n)
    at = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for d in range(len(offsets) - 1):
        if at[d + 1] > at[d]:
            out.append(np.unique(h[at[d] : at[d + 1]]))
        elif first[d + 1] > first[d]:
            out.append(windows(hashes[first[d] : first[d + 1]], np.array([0, first[d + 1] - first[d]]), int(first[d + 1] - first[d]))[2])
        else:
            out.append(h[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """One 64-bit value of a set, as a signed number."""
    return mix(np.array([np.sum(mix(s), dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0]


class Bands:
    """Size bands, and for each the number of groups that guarantees an agreeing one."""

    def __init__(self, settings: JaccardSettings, largest: int = 1 << 40) -> None:
        p, self.percent = settings.percent, settings.percent
        if not 1 <= p <= 100:
            raise ValueError("percent is from 1 to 100")
        tops = [(p - 1) // (100 - p) if p < 100 else largest]  # up to here only equal sets are linked
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, int(tops[-1] * settings.band_ratio)))
        self.tops = np.array(tops)

    def of(self, size: int) -> range:
        """The bands of the smaller partner that a set of this size can have."""
        low = -(-size * self.percent // 100)
        return range(int(np.searchsorted(self.tops, low)), int(np.searchsorted(self.tops, size)) + 1)

    def groups(self, band: int) -> tuple[int, int]:
        """(groups, spare): partners agree in more than `spare` of the groups."""
        differ = int(self.tops[band]) * (100 - self.percent) // self.percent
        spare = (differ + 1) // 8
        return differ + 1 + spare, spare

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The group contents of a sorted set: partners share one at least."""
        out, parts = [], mix(s ^ U(0x94D049BB133111EB))
        for band in self.of(len(s)):
            if band == 0:
                continue
            n, spare = self.groups(band)
            group = ((s >> U(32)) * U(n)) >> U(32)
            at = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
            salt = U((band * 0x9E3779B97F4A7C15) % 2**64)
            out.append(mix(np.add.reduceat(parts, at) + mix(group[at] + salt)))
            if n - len(at) > spare:  # so many empty groups that those which agree may all be empty
                empty = np.setdiff1d(np.arange(n, dtype=np.uint64), group[at])
                out.append(mix(mix(empty + salt) + U(EMPTY_GROUP)))
        return np.concatenate(out) if out else s[:0]


# ---------------------------------------------------------------- the tree


class CountTree:
    """A packed R-tree over count vectors. Nodes hold the largest coordinates, the smallest size and
    the number of points that are still in it."""

    def __init__(self, points: np.ndarray, leaf: int = 16) -> None:
        self.points, self.sizes, n = points, points.sum(1, dtype=np.int64), len(points)
        ranges, self.order = [(0, n)], np.lexsort((points.argmax(1), self.sizes))
        cuts = []
        while ranges:
            lo, hi = ranges.pop()
            if hi - lo <= leaf:
                cuts.append(lo)
                continue
            held = self.order[lo:hi]
            wide = int(np.ptp(points[held], axis=0).argmax())
            mid = (hi - lo) // 2
            self.order[lo:hi] = held[np.argpartition(points[held, wide], mid)]
            ranges += [(lo, lo + mid), (lo + mid, hi)]
        self.starts = [np.array(sorted(cuts))]
        self.high = [np.maximum.reduceat(points[self.order], self.starts[0], axis=0)]
        self.small = [np.minimum.reduceat(self.sizes[self.order], self.starts[0])]
        while len(self.starts[-1]) > leaf:
            at = np.arange(0, len(self.starts[-1]), 8)
            self.high.append(np.maximum.reduceat(self.high[-1], at, axis=0))
            self.small.append(np.minimum.reduceat(self.small[-1], at))
            self.starts.append(at)
        self.ends = [np.append(s[1:], e) for s, e in zip(self.starts, [n, *map(len, self.starts[:-1])], strict=True)]
        self.within = np.ones(n, bool)
        leaf_of = np.empty(n, np.int64)
        leaf_of[self.order] = np.repeat(np.arange(len(self.starts[0])), self.ends[0] - self.starts[0])
        self.nodes = [leaf_of]
        for s, e in zip(self.starts[1:], self.ends[1:], strict=True):
            self.nodes.append(np.repeat(np.arange(len(s)), e - s)[self.nodes[-1]])
        self.left = [np.bincount(x, minlength=len(s)) for x, s in zip(self.nodes, self.starts, strict=True)]
        self.count = n

    def remove(self, ids: np.ndarray) -> None:
        self.within[ids] = False
        self.count -= len(ids)
        for left, node in zip(self.left, self.nodes, strict=True):
            np.subtract.at(left, node[ids], 1)

    def search(self, q: int, percent: int) -> np.ndarray:
        """The points still in the tree whose bound on the overlap with q reaches the threshold."""
        p, size = self.points[q], self.sizes[q]
        at = np.arange(len(self.starts[-1]))
        for level in range(len(self.starts) - 1, -1, -1):
            at = at[self.left[level][at] > 0]
            most = np.minimum(self.high[level][at], p).sum(1, dtype=np.int64)
            at = at[(100 + percent) * most >= percent * (size + self.small[level][at])]
            if not len(at):
                return at
            lengths = self.ends[level][at] - self.starts[level][at]
            at = np.repeat(self.starts[level][at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        at = self.order[at]
        at = at[self.within[at]]
        most = np.minimum(self.points[at], p).sum(1, dtype=np.int64)
        return at[(100 + percent) * most >= percent * (size + self.sizes[at])]


def width_of(size: int, settings: JaccardSettings) -> int:
    """The coordinates of a set's point: a power of two, at least half the size."""
    return max(settings.least_coordinates, 1 << max(0, (size - 1) // 2).bit_length())


def point(s: np.ndarray, width: int) -> np.ndarray:
    """The counts of the shingle groups (by the low bits of the hashes)."""
    return np.bincount((s & U(width - 1)).astype(np.int64), minlength=width)


def folded(p: np.ndarray, width: int) -> np.ndarray:
    """The point with fewer coordinates."""
    return p.reshape(-1, width).sum(0, dtype=np.int64)


def packed(p: np.ndarray) -> bytes:
    """The point in 16 bits a coordinate."""
    return p.astype("<u2").tobytes()


def short_width(size: int, settings: JaccardSettings) -> int:
    """The coordinates of the short point, so many that no count comes near 2**16."""
    return min(width_of(size, settings), max(settings.short_coordinates, 1 << (size // 8192).bit_length()))


def same_width(points: list[np.ndarray]) -> np.ndarray:
    """The points, folded to the smallest width among them."""
    width = min(map(len, points))
    return np.stack([small(folded(p, width)) for p in points])


def small(points: np.ndarray) -> np.ndarray:
    return points.astype(np.uint16) if not points.size or points.max() < 1 << 16 else points


def link_sets(points: np.ndarray, sets: list[np.ndarray] | None, settings: JaccardSettings) -> np.ndarray:
    """For each point the index of the first one of its component: by the bound, or, with the sets, by
    the exact overlap."""
    root = np.full(len(points), -1)
    tree = CountTree(points, settings.leaf)
    for seed in range(len(points)):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        tree.remove(np.array([seed]))
        queue = [seed]
        while queue and tree.count:
            q = queue.pop()
            near = tree.search(q, settings.percent)
            for part in [near] if sets is None else _parts(near, sets):
                if sets is not None:
                    shared = overlaps(sets[q], [sets[i] for i in part])
                    union = len(sets[q]) + tree.sizes[part] - shared
                    part = part[100 * shared >= settings.percent * union]
                root[part] = seed
                tree.remove(part)
                queue += part.tolist()
    return root


def _parts(ids: np.ndarray, sets: list[np.ndarray], limit: int = 1 << 20):
    lo = held = 0
    for k, i in enumerate(ids.tolist()):
        held += len(sets[i])
        if held >= limit:
            yield ids[lo : k + 1]
            lo, held = k + 1, 0
    if lo < len(ids):
        yield ids[lo:]


def overlaps(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(s, every), len(s) - 1)
    first = np.concatenate([[0], np.cumsum([len(x) for x in others])])
    hits = np.concatenate([[0], np.cumsum(s[at] == every)])
    return hits[first[1:]] - hits[first[:-1]]


# ---------------------------------------------------------------- the join


def _sets_of(column: pa.Array, n: int):
    data, offsets = utf8(column)
    for lo, hi in row_ranges(offsets):
        yield lo, hi, shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)


def set_table(df: DataFrame, key: str, text: str, settings: JaccardSettings) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, short, long): set_id and the points are null for an empty
    set, the long point also where the short one has all coordinates."""
    n = settings.n

    def run(batches):
        for b in batches:
            sizes, ids, short, long = [], [], [], []
            for _, _, sets in _sets_of(b.column(1), n):
                for s in sets:
                    sizes.append(len(s))
                    if not len(s):
                        ids.append(None), short.append(None), long.append(None)
                        continue
                    p = point(s, width_of(len(s), settings))
                    ids.append(int(signature(s)))
                    width = short_width(len(s), settings)
                    short.append(packed(folded(p, width)))
                    long.append(packed(p) if len(p) > width else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(short, pa.binary()), pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], names=["doc_id", "text_hash", "n_shingles", "set_id", "short", "long"])

    rows = _input(df, key, text).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id long, short binary, long binary")


def _input(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def candidate_edges(df: DataFrame, points: DataFrame, n_buckets: int, settings: JaccardSettings) -> DataFrame:
    """(a, b): a forest of the sets that share a group's content and whose bound reaches the threshold;
    points has set_id and both points."""
    n, bands = settings.n, Bands(settings)

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, sets in _sets_of(batch.column(1), n):
            for s in sets:
                if len(s):
                    keys.append(bands.keys(s))
                    owners.append(np.full(len(keys[-1]), signature(s)))
        return np.concatenate(keys), np.concatenate(owners)

    lists = written(lists_by_key(df, keyed, n_buckets), "shared-groups")
    held = written(points.join(lists.select(F.col("node").alias("set_id")).distinct(), "set_id", "left_semi").dropDuplicates(["set_id"]), "candidate-points")
    # first each list's sets against one of them; most lists are settled by that
    pairs = lists.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    at = lambda x, p: held.select(F.col("set_id").alias(x), F.col(p).alias(f"{x}_point"))
    short = pairs.join(at("a", "short"), "a").join(at("b", "short"), "b")
    maybe = written(short.select("a", "b", "a_point", "b_point").mapInArrow(_near_pairs(settings), "a long, b long"), "maybe-near")
    long = held.select("set_id", F.coalesce("long", "short").alias("long"), F.col("long").isNotNull().alias("more"))
    more = maybe.join(long.select(F.col("set_id").alias("a"), F.col("long").alias("a_point"), F.col("more").alias("x")), "a")
    more = more.join(long.select(F.col("set_id").alias("b"), F.col("long").alias("b_point"), F.col("more").alias("y")), "b")
    near = written(more.select("a", "b", "a_point", "b_point").mapInArrow(_near_pairs(settings), "a long, b long"), "near-sets")
    # then the lists that still span several components, in trees
    data = held.select(F.col("set_id").alias("node"), F.coalesce("long", "short").alias("point"))
    out = candidate_forest(lists, near, data, lambda rows: link_sets(same_width([np.frombuffer(r[0], np.uint16) for r in rows]), None, settings), settings.tile_sets)
    discard(lists, held, maybe)
    return out


def _near_pairs(settings: JaccardSettings):
    """Keeps the pairs (a, b, a_point, b_point) whose bound reaches the threshold."""
    p = settings.percent

    def run(batches):
        for b in batches:
            one, two = (b.column(i).to_pylist() for i in (2, 3))
            widths = np.array([[len(x), len(y)] for x, y in zip(one, two, strict=True)], np.int64).reshape(-1, 2) // 2
            keep = np.zeros(b.num_rows, bool)
            for wx, wy in {tuple(w) for w in widths.tolist()}:
                at = np.flatnonzero((widths == (wx, wy)).all(1))
                for lo in range(0, len(at), 4096):
                    part, w = at[lo : lo + 4096], min(wx, wy)
                    x, y = (np.frombuffer(b"".join([c[i] for i in part.tolist()]), np.uint16).reshape(len(part), -1, w).sum(1, dtype=np.int32) for c in (one, two))
                    most = np.minimum(x, y).sum(1, dtype=np.int64)
                    keep[part] = (100 + p) * most >= p * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64))
            kept = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept)], names=["a", "b"])

    return run


def candidate_sets(df: DataFrame, wanted: DataFrame, settings: JaccardSettings) -> DataFrame:
    """(set_id, shingles) of the wanted sets; wanted has set_id and the doc_id of one document that has it."""
    n, bits = settings.n, settings.filter_bits
    held = df.sparkSession.sparkContext.broadcast(hash_filter(wanted, "doc_id", bits))

    def run(batches):
        for b in batches:
            part = b.column(1).take(pa.array(np.flatnonzero(passes(held.value, b.column(2).to_numpy()))))
            for _, _, sets in _sets_of(part, n):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([int(signature(s)) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "shingles"])

    rows = df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("spot"))
    sets = rows.mapInArrow(run, "set_id long, shingles binary")
    return sets.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def _verified(sets: list[np.ndarray], settings: JaccardSettings) -> np.ndarray:
    width = width_of(sum(map(len, sets)) // len(sets), settings)
    return link_sets(np.stack([small(point(s, width)) for s in sets]), sets, settings)


def linked_sets(df: DataFrame, wanted: DataFrame, settings: JaccardSettings) -> DataFrame:
    """(a, b): the verified components within each group of candidates, as stars."""
    members = wanted.select("root", F.col("set_id").alias("node"), F.col("n_shingles").alias("weight"))
    data = written(candidate_sets(df, wanted, settings).withColumnRenamed("set_id", "node"), "candidate-sets")
    links = written(linked_members(members, data, lambda rows: _verified([np.frombuffer(r[0], np.uint64) for r in rows], settings), settings.tile_sets, settings.tile_shingles), "set-links")
    discard(data)
    return links


def set_links(df: DataFrame, key: str, text: str, settings: JaccardSettings) -> tuple[DataFrame, DataFrame]:
    """(sets, links): set_table without the points, and the verified links (a, b) between sets."""
    sets = written(set_table(df, key, text, settings), "shingle-sets")
    firsts = sets.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(8, int(total * 1.5 * (100 - settings.percent) / settings.percent * 1.3 / settings.bucket_keys))
    docs = _input(df, key, text).where("doc_id is not null")
    points = sets.where("set_id is not null").select("set_id", "short", "long")
    routes = connected_components(candidate_edges(docs, points, n_buckets, settings))
    wanted = written(firsts.join(routes.withColumnRenamed("node", "set_id"), "set_id"), "candidates")
    links = linked_sets(docs, wanted, settings)
    discard(wanted)
    return sets.select("doc_id", "text_hash", "n_shingles", "set_id"), links


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", settings: JaccardSettings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest id reachable by links."""
    sets, links = set_links(df, key, text, settings or JaccardSettings())
    held = sets.where("set_id is not null and doc_id is not null").select("doc_id", "set_id")
    # an id with several texts ties them together
    several = held.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a != b").select("doc_id", "a")
    ties = held.join(several, "doc_id").where("set_id != a").select("a", F.col("set_id").alias("b"))
    firsts = held.groupBy("set_id").agg(F.min("doc_id").alias("first"))
    parts = connected_components(links.unionByName(ties)).withColumnRenamed("node", "set_id")
    least = parts.join(firsts, "set_id").groupBy("root").agg(F.min("first").alias("component_id"))
    of_set = parts.join(least, "root").select("set_id", "component_id")
    # written, so that the join below can split the rows of a set that very many documents share
    known = written(firsts.join(of_set, "set_id", "left").select("set_id", F.coalesce("component_id", "first").alias("component_id")), "set-components")
    joined = sets.where("doc_id is not null").join(known, "set_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(
        sets.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    )


def keep_one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", settings: JaccardSettings | None = None) -> DataFrame:
    """The rows of df that stay when one text of each component of texts stays: that of the row with the
    smallest id, then the smallest hash. Repeated rows are copies, so one stays; rows that share an id but not
    a text are judged apart. Rows without an id or without words stay."""
    sets, links = set_links(df, key, text, settings or JaccardSettings())
    parts = connected_components(links).withColumnRenamed("node", "set_id")
    rows = sets.where("doc_id is not null").groupBy("doc_id", "text_hash", "set_id").agg(F.count("*").alias("n"))
    placed = rows.where("set_id is not null").join(parts, "set_id", "left").groupBy(F.coalesce("root", "set_id").alias("part"))
    one = placed.agg(F.min(F.struct("doc_id", F.coalesce("text_hash", F.lit(0)).alias("text_hash"))).alias("at")).select("at.*")
    own, hashed = free_name(df, "own_id"), free_name(df, "text_hash", "own_id")
    kept = one.select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed))
    wordless = sets.where("set_id is null and doc_id is not null").select(F.col("doc_id").alias(own), F.coalesce("text_hash", F.lit(0)).alias(hashed))
    named = df.where(F.col(key).isNotNull()).withColumn(own, F.col(key).cast("long")).withColumn(hashed, F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0)))
    stay = named.join(written(kept.unionByName(wordless).distinct(), "kept-texts"), [own, hashed], "left_semi").dropDuplicates([own, hashed]).drop(own, hashed)
    return stay.unionByName(df.where(F.col(key).isNull()))
