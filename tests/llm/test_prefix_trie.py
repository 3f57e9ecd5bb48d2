import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.llm import prefix_trie as pt


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    """(conv_id, turn, role, text) rows; every step as the definition has it."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    original = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        convs[c] = original.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def below(k):
        leaves = 0 if kids[k] else 1
        saved = (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        for child in kids[k]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for k, cs in members.items():
        ends = sorted(c for c in cs if len(convs[c]) == len(k))
        leaves, saved = below(k)
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids[k]), leaves, saved, sha))
    return Counter(out)


def talk(n, seed=1, first=0):
    rng = random.Random(seed)
    return [(first + c, t, ("user", "assistant")[t % 2], rng.choice(["hi", "", "the same words", f"turn {t}", f"own {c}"])) for c in range(n) for t in range(rng.randrange(1, 7))]


CASES = {
    "talk": talk(90),
    "copies": [(c, t, "user", f"turn {t}") for c in range(60) for t in range(5)] + [(c, 5, "user", "odd one") for c in range(0, 60, 9)],
    "odd": [
        (1, None, None, None), (1, 3, "user", "x"), (1, 3, "user", "x"), (1, 3, "a", "y"), (None, 1, "user", "lost"), (2, 0, "", ""), (2, 1, "ab", "c"), (3, 0, "a", "bc"),
        (3, 1, "a", "b c  d\n\te"), (-5, 0, "user", "minus"), (-25, 0, "user", "minus"), (-20, 1, "user", "base"), (40, 0, "user", "é漢\U0001f600 " * 30_000), (41, 0, "user", "z"),
    ],
    "one": [(7, 0, "user", "alone")],
    "long": [(20, i, "user", f"t{i % 3}") for i in range(30)] + [(c, i, "user", f"t{i % 3}") for c in (21, 22) for i in range(41)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_plain_python(spark, monkeypatch, name):
    monkeypatch.setattr(pt, "CHUNK", 8)
    df = spark.createDataFrame(CASES[name], "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("depth", "length", "p1", "words", "rank", "n", "head", "h"):
        df = df.withColumn(c, F.lit("x"))
    got = pt.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(CASES[name])


def test_sketch_too_small_to_clear_anything(spark, monkeypatch):
    """Sketch of a few cells: all prefixes go the exact way, with the same result; no lone prefix is wrong."""
    monkeypatch.setattr(pt, "CELLS_MOST", 8)
    df = spark.createDataFrame(CASES["talk"], "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in pt.prefix_trie(df).collect()) == plain(CASES["talk"])


def test_sketch_never_counts_too_low(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**63), 2**63 - 1, size=(3000, 2), dtype="i8")
    values[1000:2000] = values[:1000]
    df = spark.createDataFrame(values.tolist(), "p1 long, p2 long").repartition(5)
    for cells in (1 << 10, 1 << 18):
        counters = pt.sketch(df, cells)
        found = pt.cells_of(values[:, 0].copy(), values[:, 1].copy(), cells)
        estimate = np.minimum(counters[0][found[0]], counters[1][found[1]])
        assert (estimate[:2000] == 2).all() and (estimate >= 1).all()
        assert cells < 1 << 18 or (estimate[2000:] == 1).mean() > 0.99


def test_most_lone_tails_stay_out_of_the_shuffle(spark):
    rows = pt.written(pt.prefixes(pt.rebuilt(spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(200) for t in range(6)], "conv_id long, turn long, role string, text string"))[0]), "p")
    screened = pt.screened(rows, pt.sketch(rows, 1 << 12))
    lone = screened.groupBy("p1", "p2").count().filter("count = 1").count()
    assert screened.filter("alone").count() > 0.9 * lone > 500


def test_long_lists_of_ids_stream(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 64)
    ids = [(d, 1, 2, i * 7) for d in (1, 2) for i in range(500 * d)]
    got = {r["depth"]: r["ends_sha256"] for r in pt.joined_ids(spark.createDataFrame(ids, "depth long, p1 long, p2 long, conv_id long").repartition(7)).collect()}
    for d in (1, 2):
        assert got[d] == hashlib.sha256(",".join(str(i * 7) for i in range(500 * d)).encode()).hexdigest()
