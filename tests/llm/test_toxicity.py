import random
import zlib

import pytest

from axonframe.llm import toxicity as tox


def crowd(prose, n=700):
    rng = random.Random(8)
    bad = ["idiot", "moron", "you pathetic", "vequon", "vequai", "vequel", "vequou"]
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.randint(10, 80)).split()
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


@pytest.fixture
def tables(spark, docs, prose):
    rows, labels = crowd(prose)
    extra = [(None, 0, 1), (3, 1, None), (10**9, 0, 1)]
    return docs([*rows, (None, "null id"), (5000, None), (5001, ""), (5002, "you idiot " * 40_000)]), spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int"), dict(rows), {d: t for d, _, t in labels}


def test_held_out_accuracy(tables):
    docs, labels, texts, truth = tables
    got = {r["doc_id"]: r for r in tox.score_toxicity(docs, labels).collect()}
    assert len(got) == len(texts) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [d for d in texts if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in texts)
    right = sum(got[d]["predicted"] == truth[d] for d in held) / len(held)
    assert right > 0.95 and got[5002]["predicted"] == 1 and got[5000]["predicted"] == got[5001]["predicted"] == 0


def test_held_out_labels_are_not_looked_at(spark, tables):
    docs, labels, _, truth = tables
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    a, b = (sorted(tuple(r) for r in tox.score_toxicity(docs.filter("doc_id is not null"), x).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_drop_toxic_keeps_the_rest(tables):
    docs, labels, texts, truth = tables
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sum(truth.get(i) == 0 for i in ids) >= 0.98 * sum(t == 0 for t in truth.values())
    assert sum(truth.get(i) == 1 for i in ids) <= 0.05 * sum(truth.values())


def test_without_both_labels(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in tox.score_toxicity(docs(odd), none).collect()} == {0.0}
    assert tox.score_toxicity(docs([]), none).collect() == []


def test_features():
    words = tox.Words({"vequ-": 2.0, "moron": 1.0})
    by = dict(zip(tox.FEATURES, tox.features("You m0r*on VEQUON! idiot", words), strict=True))
    assert by["terms"] > 0 and by["heaviest term"] == 2.0 and by["insults per word"] == 0.25 and by["second person per word"] == 0.25
    assert by["nearness of second person and a term"] == pytest.approx(1 / 3) and by["words in capitals"] == 0.25 and by["exclamation and question marks"] == 0.25
    assert by["obfuscated words"] == 0.25 and by["obfuscated terms"] == 1.0
    assert len(tox.features("", words)) == len(tox.FEATURES)
