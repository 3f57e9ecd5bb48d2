import random

import numpy as np
import pyarrow as pa
import pytest

from axonframe.llm import jaccard_join as jj
from axonframe.llm.components import components

STRICT = jj.JoinParams(words=4, percent=85)
TIGHT = jj.JoinParams(words=4, percent=85, leaf=16, leaf_pivots=3, pivots=12, salts=3, often=4, bucket=500)
LOOSE = jj.JoinParams(leaf=5, leaf_pivots=3, pivots=2, salts=2, often=2, bucket=100)


def plain_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, p):
    sets = [plain_set(t, p.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= p.percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def family(rng, base, n, most):
    """Near copies, each with up to ``most`` words changed, some by way of another copy."""
    out = [base]
    for _ in range(n):
        words = rng.choice(out[-3:]).split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        if rng.random() < 0.3:
            words = words[: len(words) - rng.randint(0, 5)]
        out.append(" ".join(words))
    return out


@pytest.fixture
def crowd(prose):
    rng = random.Random(11)
    texts = [prose(n) for n in (1, 2, 3, 4, 5, 6, 8, 9, 30, 60, 300) for _ in range(2)]
    for n, most in ((7, 1), (12, 1), (40, 1), (80, 2), (200, 6)):
        texts += family(rng, prose(n), 14, most)
    texts += family(rng, prose(150), 60, 4) + [texts[-1]] * 12 + ["same same same same"] * 5
    shared = prose(60)
    texts += [f"{shared} {prose(3)}" for _ in range(25)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("p", [STRICT, TIGHT, jj.JoinParams()], ids=["strict", "tight", "default"])
def test_components_against_all_pairs(docs, crowd, p):
    got = sorted(tuple(r) for r in jj.jaccard_components(docs(crowd), p).collect())
    assert got == plain_components(crowd, p)


def test_odd_rows(docs, odd):
    got = jj.jaccard_components(docs([*odd, (0, "TIE")]), STRICT).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(1, 4)}
    assert by[7] == {(1, 0), (1, 7)} and by[0] == {(1, 0)} and by[None] == {(3, None)}
    assert len(got) == len(odd) + 1
    assert jj.jaccard_components(docs([]), STRICT).collect() == []


def test_keep_one(docs, odd):
    rows = [*odd, (0, "TIE"), (11, "long text " * 60_000)]
    df = docs(rows)
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    found = sorted((r["doc_id"] or -1, (r["text"] or "")[:20]) for r in kept.collect())
    want = {(d or -1, (t or "")[:20]) for d, t in rows if (d, t) not in ((7, "tie"), (11, "long text " * 60_000))}
    assert found == sorted(want)


def test_every_link_meets(docs, crowd):
    """Linked sets are in one component of the meetings; texts of their own words meet nothing."""
    for p in (STRICT, TIGHT):
        pairs = [tuple(r) for r in jj.meetings(docs([*crowd, (999, " ".join(f"own{i}" for i in range(99)))]), p, 10**5).collect()]
        met = {}
        for a, b in pairs:
            kind = {a, b} | met.get(a, set()) | met.get(b, set())
            met |= dict.fromkeys(kind, kind)
        sets = {jj.node_of(s): s for s in jj.shingle_sets([t for _, t in crowd], p.words) if len(s)}
        for x, a in sets.items():
            for y, b in sets.items():
                both = len(np.intersect1d(a, b))
                if x != y and 100 * both >= p.percent * (len(a) + len(b) - both):
                    assert y in met[x]
        (own,) = jj.shingle_sets([" ".join(f"own{i}" for i in range(99))], p.words)
        assert jj.node_of(own) not in met


@pytest.mark.parametrize("most", [2, 5, 1000])
@pytest.mark.parametrize("full", [1, 40, 10**6])
def test_shingles_of_several_sets_in_any_blocks(most, full):
    """Also where a bucket comes in pieces and its frequent shingles leave early."""
    rng = np.random.default_rng(2)
    shingle = np.concatenate([rng.integers(0, 60, 300), np.full(50, 7)]).astype(np.uint64)
    node = rng.integers(0, 12, len(shingle)).astype(np.int64)
    bucket = shingle % np.uint64(3)
    need = np.ones(len(node), np.int32)
    parts = [jj.dealt(bucket[i], {"shingles": shingle[i], "nodes": node[i], "needs": need[i]}) for i in np.array_split(np.arange(len(node)), 9)]
    rows = pa.Table.from_batches(parts).sort_by("bucket").to_batches()
    got = {}
    for batch in jj.owned(iter(rows), most, 4, full):
        for r in batch.to_pylist():
            for s, n, o in zip(np.frombuffer(r["shingles"], "<u8"), np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["often"], "<i2")):
                got.setdefault(int(s), {}).setdefault(int(n), set()).add(int(o))
    for s in np.unique(shingle):
        nodes = set(node[shingle == s].tolist())
        assert set(got.get(int(s), {})) == (nodes if len(nodes) > 1 else set())
        # One number a shingle, so all sets put it in the same place.
        assert len(set().union(*got.get(int(s), {0: {1}}).values())) == 1
    if full > 10**5:
        assert all(o == {min(len(set(node[shingle == np.uint64(s)])), most)} for s, of in got.items() for o in of.values())


def test_counted_shingles_are_short(docs, crowd):
    """A shingle crosses the first exchange in 14 bytes, and sets whose short forms collide still meet."""
    values = np.array([1, 2, (5 << 32) + 2, (6 << 32) + 2, (7 << 32) + 9], np.uint64)
    short, need = jj.shortened(values, 4)
    assert short.itemsize == 4 and need == 2 and jj.shortened(values[1:4], 1)[1] == 1
    assert jj.shortened(np.arange(9, dtype=np.uint64), 1 << 20)[1] == jj.NEED_MOST
    rows = {"shingles": short, "nodes": np.full(5, 3), "needs": np.full(5, need, np.uint16)}
    block = jj.dealt(np.array([0, 2, 2, 2, 1]), rows)
    assert sum(len(b) for c in ("shingles", "nodes", "needs", "often") for b in block[c].to_pylist()) == 5 * 14
    wide = [r for b in jj.widened(iter([block])) for r in b.to_pylist()]
    assert [np.frombuffer(r["shingles"], "<u8").tolist() for r in wide] == [[1], [(1 << 32) + 9], [(2 << 32) + 2] * 3]
    assert all(set(np.frombuffer(r["needs"], "<i4")) == {2} for r in wide)
    # Hashes of eight low bits: most sets of the crowd hold colliding shingles.
    plain = jj.shortened
    jj.shortened = lambda v, need: plain(v & np.uint64(255), need)
    try:
        got = sorted(tuple(r) for r in jj.jaccard_components(docs(crowd), TIGHT).collect())
    finally:
        jj.shortened = plain
    assert got == plain_components(crowd, TIGHT)


def test_regions_go_through_cells(crowd):
    """Voronoi cells with windows are formed, and cells are searched in place of whole regions."""
    sets = [s for s in jj.shingle_sets([t for _, t in crowd], TIGHT.words) if len(s)]
    formed = []
    plain = jj.cells_of
    jj.cells_of = lambda d, r: formed.append(plain(d, r)) or formed[-1]
    try:
        jj.join_region(sets, list(range(len(sets))), TIGHT)
    finally:
        jj.cells_of = plain
    copies = sum(int(c.sum() - c.any(1).sum()) for c in formed)
    assert len(formed) > 5 and copies > 0


def test_region_in_one_task(crowd):
    for p in (STRICT, TIGHT, LOOSE):
        sets = [s for s in jj.shingle_sets([t for _, t in crowd], p.words) if len(s)]
        links = jj.join_region(sets, list(range(len(sets))), p)
        joined = jj.Joined(list(range(len(sets))))
        for i, j in links:
            joined.link(i, np.array([j]))
        full = jj.Joined(list(range(len(sets))))
        for i in range(len(sets)):
            both = np.array([len(np.intersect1d(sets[i], s)) for s in sets])
            full.link(i, np.flatnonzero(p.linked(both, np.array([len(s) for s in sets]), len(sets[i]))))
        pairs = lambda label: {(i, int(np.flatnonzero(label == v)[0])) for i, v in enumerate(label)}
        assert pairs(joined.label) == pairs(full.label)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: i - (i - 1) % 7 if i else 0 for i in range(1, 61)}
    assert all(got[i] == want[i] for i in want if i in got) and all(got[k] == 100 for k in range(100, 160))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
