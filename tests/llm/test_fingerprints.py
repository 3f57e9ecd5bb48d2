import hashlib
import random

import numpy as np

from axonframe.llm import fingerprints as fp


def real_set(text, k=5):
    w = text.encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates(prose):
    rng = random.Random(2)
    for n in (3, 50, 200, 3000):
        a = prose(n).split()
        b = list(a)
        for _ in range(n // 20):
            b[rng.randrange(n)] = "new"
        x, y = fp.fingerprint(" ".join(a)), fp.fingerprint(" ".join(b))
        sa, sb = real_set(" ".join(a)), real_set(" ".join(b))
        slack = 1e-9 if n < 250 else 0.12
        assert abs(fp.resemblance(x, y) - jaccard(sa, sb)) <= slack
        assert abs(fp.containment(x, y) - len(sa & sb) / len(sa)) <= 2 * slack
        assert abs(fp.distinct_count(x) / len(sa) - 1) <= 2 * slack
        assert (fp.from_text(fp.to_text(x)) == x).all()


def test_merge_of_parts_is_the_sketch_of_the_whole(prose):
    words = prose(2000).encode().split()
    (whole,) = fp.shingles_of([b" ".join(words)], 5)
    parts = [fp.sketch(p) for p in np.array_split(whole, 7)]
    assert (fp.merge(parts) == fp.sketch(whole)).all()
    repeated = np.concatenate([np.repeat(whole[:3], 5000), whole])
    assert (fp.sketch(repeated) == fp.sketch(whole)).all()


def test_compare_with_edits(docs, odd, prose):
    rows = [*odd, *[(20 + 3 * i, prose(40 + i)) for i in range(30)]]
    got = fp.compare_with_edits(docs(rows)).collect()
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + u[:cut]
        a, e, n = fp.fingerprint(t), fp.fingerprint(edited), fp.fingerprint(u)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.to_text(a), fp.to_text(e), fp.resemblance(a, e), fp.resemblance(a, n)))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)


def test_one_row_and_none(docs):
    (row,) = fp.compare_with_edits(docs([(1, "abcdef")])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0
    assert fp.compare_with_edits(docs([])).collect() == []


def test_shingles_of_many_are_those_of_each(prose):
    texts = ["", " ", "a", "a b c d", "b a c d", "x" * 63, "x" * 64, "x" * 65, "x" * 700, "é " * 9, "abcdefgh abcdefghi", "abcdefg\x00 abcdefg", prose(50), "", "\x1c\x85 \u2028"]
    raw = [t.encode() for t in texts]
    for size in (1, 4, 5):
        each = fp.shingles_of(raw, size)
        assert all((a == fp.shingles_of([r], size)[0]).all() for a, r in zip(each, raw, strict=True))
        want = [len(r.split()) for r in raw]
        assert [len(a) for a in each] == [n - size + 1 if n >= size else min(n, 1) for n in want]
    hashes, words = np.concatenate(fp.shingles_of(raw, 1)), [w for r in raw for w in r.split()]
    assert len(set(hashes.tolist())) == len(set(words)) and len(hashes) == len(words)
