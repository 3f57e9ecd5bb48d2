import hashlib
import math
from collections import Counter

import pytest

from axonframe.llm import mixing


def plain_count(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16) / 2**48
    p = cdf = math.exp(-rate)
    n = 0
    while cdf <= u and n < mixing.MOST:
        n += 1
        p *= rate / n
        cdf += p
    return n


def table():
    return [(i, "x" * (i % 7 + 1), "en", ["a", "b", "a", None][i % 4]) for i in range(2000)]


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_counts_and_shares(docs, weights):
    rows = table()
    got = mixing.poisson_mix(docs(rows, clash=False), seed=5, weights=weights).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s or ""] += len(t)
    of = {s: 1.0 for s in size} if weights is None else {s: weights.get(s, 0.0) for s in size}
    rate = {s: of[s] / sum(of.values()) * sum(size.values()) / size[s] for s in size}
    want = {i: n for i, _, _, s in rows if (n := plain_count(5, i, rate[s or ""]))}
    assert Counter(r["doc_id"] for r in got) == want
    assert all({r["copy"] for r in got if r["doc_id"] == i} == set(range(n)) for i, n in list(want.items())[:50])
    shares = Counter()
    for r in got:
        shares[r["source"] or ""] += len(r["text"])
    for s in size:
        assert abs(shares[s] / sum(shares.values()) - of[s] / sum(of.values())) < 0.05


def test_odd_rows(docs, odd):
    df = docs(odd)
    out = mixing.poisson_mix(df)
    assert out.columns[: len(df.columns)] == df.columns and len(set(out.columns)) == len(out.columns)
    out.collect()
    assert mixing.poisson_mix(docs([])).collect() == []
    assert mixing.poisson_mix(docs([(1, None), (2, "")])).collect() == []


def test_a_small_source_gets_its_whole_weight(docs):
    """No rate is cut by default: one character beside 9,900 is repeated some 4,950 times; a limit is for the asking."""
    rows = [(0, "x", "en", "tiny"), *[(i, "y" * 100, "en", "big") for i in range(1, 100)]]
    got = mixing.poisson_mix(docs(rows)).collect()
    tiny = [r["copy_" if "copy_" in r else "_copy"] for r in got if r["doc_id"] == 0]
    assert 4500 < len(tiny) < 5400 and len(set(tiny)) == len(tiny)
    assert sum(r["doc_id"] == 0 for r in mixing.poisson_mix(docs(rows), rate_most=16.0).collect()) <= mixing.MOST


def test_a_huge_rate_is_dealt_out(docs, monkeypatch):
    """Blocks of slices in many tasks give the counts that one block gives."""
    rows = [(0, "x", "en", "tiny"), (1, "y" * 9000, "en", "big")]
    whole = sorted(r["shuffle_key"] for r in mixing.poisson_mix(docs(rows)).collect())
    monkeypatch.setattr(mixing, "BLOCK", 8)
    assert sorted(r["shuffle_key"] for r in mixing.poisson_mix(docs(rows)).collect()) == whole


def test_same_result_in_any_layout(docs):
    rows = table()
    a = mixing.poisson_mix(docs(rows)).select("doc_id", "shuffle_key").collect()
    b = mixing.poisson_mix(docs(rows[::-1]).repartition(7)).select("doc_id", "shuffle_key").collect()
    assert sorted(a) == sorted(b)


def test_a_small_source_gets_its_whole_weight(docs):
    # 20 equal weights; the small source has 0.1 % of the characters, so its rate is about 50.
    rows = [(i, "x", "en", "small") for i in range(100)] + [(1000 + i, "y" * 100, "en", f"s{i % 19}") for i in range(1000)]
    total = sum(len(t) for _, t, *_ in rows)
    got = Counter(r["doc_id"] for r in mixing.poisson_mix(docs(rows), rate_most=None).select("doc_id").collect())
    counts = [got[i] for i in range(100)]
    rate = total / 20 / 100
    assert 50 <= rate < 51 and abs(sum(counts) - 100 * rate) < 4 * math.sqrt(100 * rate)
    assert 0.5 * rate < sum((n - rate) ** 2 for n in counts) / 100 < 1.6 * rate
    assert all(got[1000 + i] == plain_count(1, 1000 + i, total / 20 / 5300) for i in range(0, 1000, 19))
