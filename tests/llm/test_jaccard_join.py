import random
import re

import numpy as np
import pytest
from conftest import AWKWARD

from nitraflow.llm import jaccard_join as J
from nitraflow.llm.routing import BucketLists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    """{doc_id: (size, component)} by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            shared = len(s & t)
            if s and t and 100 * shared >= percent * (len(s) + len(t) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(seed, bases, copies, size):
    rng, out = random.Random(seed), []
    for b in range(bases):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, size))]
        for _ in range(copies):
            now = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                now[rng.randrange(len(now))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(now[rng.randint(0, 1) :]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_equals_brute_force(docs_of, sample_docs, n, percent):
    texts = near_copies(n, 12, 12, 120) + AWKWARD + ["Same Text", "same text"]
    for df, more in ((docs_of(texts), {"tile_sets": 7}), (sample_docs, {})):
        settings = J.JaccardSettings(n=n, percent=percent, **more)
        found = sorted(tuple(r) for r in J.jaccard_components(df, settings=settings).collect())
        assert found == brute([(r["doc_id"], r["text"]) for r in df.collect()], n, percent)


@pytest.mark.parametrize("percent", [50, 80, 90, 97, 100])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    bands = J.Bands(J.JaccardSettings(percent=percent))
    for _ in range(300):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 1 + size // 5), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if not np.array_equal(a, b) and len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
            assert np.intersect1d(bands.keys(a), bands.keys(b)).size


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (400, 16))
    tree = J.CountTree(points, 8)
    tree.remove(np.arange(0, 400, 3))
    for q in range(0, 400, 7):
        most = np.minimum(points, points[q]).sum(1)
        want = np.flatnonzero((180 * most >= 80 * (points.sum(1) + points[q].sum())) & tree.within)
        assert np.array_equal(np.sort(tree.search(q, 80)), want)


def test_keep_one(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    df = docs_of([(5, text, "s"), (3, text + " x", "s"), (9, "other words here", "s"), (9, "other words here", "s"), (None, text, "s"), (7, None, "s")])
    twice = docs_of([(5, text, "s"), (5, "an unlike text of the same id here", "s"), (3, text, "s"), (5, "an unlike text of the same id here", "s")])
    assert sorted((r["doc_id"], len(r["text"])) for r in J.keep_one_of_each(twice).collect()) == [(3, len(text)), (5, 34)]
    kept = sorted((r["doc_id"] or -1, r["text"] is None) for r in J.keep_one_of_each(df).collect())
    assert kept == [(-1, False), (3, False), (7, True), (9, False)]
    assert J.keep_one_of_each(df.limit(0)).count() == 0 and J.keep_one_of_each(df).columns == df.columns


def test_plan_has_no_pairs_of_everything(sample_docs):
    plan = J.jaccard_components(sample_docs)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_id_with_several_texts_has_the_links_of_each(docs_of):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs_of([(5, a, "s"), (5, b + " b", "s"), (3, b + " b", "s"), (4, a, "s")])).collect())
    assert found == [(3, 37, 3), (4, 36, 3), (5, 36, 3), (5, 37, 3)]


def test_points_fold_and_bound_the_overlap():
    rng, s = np.random.default_rng(2), J.JaccardSettings()
    for size in (1, 70, 900, 20_000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 2**63, size, dtype=np.uint64)]))
        x, y = J.point(a, J.width_of(len(a), s)), J.point(b, J.width_of(len(b), s))
        x, y = J.same_width([x, y])
        assert x.sum() == len(a) and y.sum() == len(b) and np.minimum(x, y).sum() >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("limit", [16, 200, 1 << 20])
def test_lists_of_a_bucket_lose_no_pair(limit):
    rng = np.random.default_rng(limit)
    keys, owners = rng.integers(0, 12, 300).astype(np.uint64), rng.integers(0, 40, 300)
    held, out = BucketLists(limit), []
    for lo in range(0, 300, 30):
        if (b := held.add(keys[lo : lo + 30].tobytes(), owners[lo : lo + 30].tobytes())) is not None:
            out.append(b)
    out.append(held.end())
    rows = {(r["root"], r["node"], r["pivot"]) for b in out for r in b.to_pylist()}
    lists, pivots = {}, {}
    for root, node, pivot in rows:
        lists.setdefault(root, set()).add(node)
        assert pivots.setdefault(root, pivot) == pivot
    want = {frozenset(owners[keys == k].tolist()) for k in set(keys.tolist())}
    assert set(map(frozenset, lists.values())) == {w for w in want if len(w) > 1}
    assert all(pivots[r] in lists[r] for r in lists)
