import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from axonframe.llm.merkle import Shape, build_manifest, proof_digest, prove, refold, verify_documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level, arity):
    """All levels and, for each leaf, its siblings level by level."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    paths = []
    for i in range(len(level)):
        path = []
        for lv in levels[:-1]:
            run = lv[i - i % arity : i - i % arity + arity]
            path.append((run[: i % arity], run[i % arity + 1 :]))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def fold(leaf, path):
    for before, after in path:
        leaf = h(*before, leaf, *after)
    return leaf


def plain(rows, arity=2):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        built[name] = tree([x[2] for x in groups[name]], arity)
    if not names:
        return []
    root, above = tree([built[x][0] for x in names], arity)
    out = []
    for place, name in enumerate(names):
        subroot, paths = built[name]
        for (_, _, leaf, r), path in zip(groups[name], paths):
            path = path + above[place]
            changed = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                changed = leaf_of((*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            folded = fold(changed, path)
            out.append((r[0], leaf, subroot, root, h(*(x for b, a in path for x in b + a)), folded, folded == root))
    return out


def table(docs, rows):
    """(doc_id, source, lang, n_chars, text) rows as a documents table with clashing columns."""
    return docs([(r[0], r[4], r[2], r[1]) for r in rows])


def rows_of(n, langs, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "é漢", "text %d" % i])
        out.append((i * 3, rng.choice([None, "", "web"]), rng.choice(langs), None if text is None else len(text), text))
    return out


CASES = {
    "one": rows_of(1, ["en"]),
    "one group": rows_of(37, ["en"]),
    "groups": rows_of(150, ["en"] * 9 + [None, "", "de", "Ünï", "zz", "é", "漢", "\U0001f600", "￿"]),
    "lone leaves": [(i, "s", f"lang{i}", 1, "x") for i in range(13)],
    "copies": [(5, "s", "en", 1, "x")] * 40 + [(None, "s", "en", 1, "x"), (None, None, None, None, None), (7, "s", "en", 1, "a"), (7, "s", "en", 1, "b")],
    "empty": [],
}


@pytest.mark.parametrize("name, shape", [*((n, Shape(2, 3)) for n in CASES), ("groups", Shape()), ("groups", Shape(3, 1)), ("one group", Shape())])
def test_against_plain_python(docs, name, shape):
    got = verify_documents(table(docs, CASES[name]), shape)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(CASES[name], shape.arity)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_a_few_requests_and_records_once(spark):
    rows = spark.createDataFrame([("g", i // 8, "ab" * 32) for i in range(64)] + [("h", 0, "cd" * 32)], "g string, k long, d string")
    manifest = build_manifest(rows, "g", "k", "d", Shape(2, 3))
    # Eight equal subtrees are one record; then the top of g, the lone leaf of h and the groups' own.
    assert manifest.records.count() == 4
    asked = spark.createDataFrame([("g", 63), ("g", 64), ("g", -1), ("h", 0), ("x", 0)], "grp string, rank long")
    proofs = prove(manifest, asked).withColumns({"p": proof_digest(), "top": refold(F.lit("ab" * 32))})
    got = {(r["grp"], r["rank"]): r for r in proofs.collect()}
    assert set(got) == {("g", 63), ("h", 0)}
    subroot, paths = tree(["ab" * 32] * 64, 2)
    other = "cd" * 32
    assert got["g", 63]["subroot"] == subroot and got["g", 63]["root"] == h(subroot, other) == got["g", 63]["top"]
    assert got["g", 63]["p"] == h(*(x for b, a in paths[63] for x in b + a), other)
    assert [len(s["before"]) for s in got["g", 63]["siblings"]] == [64] * 6 + [0] and got["h", 0]["p"] == h(subroot)
