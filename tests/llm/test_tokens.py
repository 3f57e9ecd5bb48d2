import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from axonframe.llm import packing, token_output
from axonframe.llm.common import shared_dir
from axonframe.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return REAL.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_by_word_equals_the_library(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["don't STOP", "á eé", "<|endoftext|> x<|startoftext|>y", "Σας ΣΑΣ", "tab\tfeed\x0c\x0b\x85 x y", "\x00\x1c\x1d", "İstanbul ﬁ", "12 a1b2", "J\u030c H\u0331 T\u0308 I\u0307 A\u0301", "<|ENDOFTEXT|> X", "اًب 漢字"]
    for text in texts:
        assert np.frombuffer(encoder(PATH).encode_all([text])[0], "<u2").tolist() == ids_of(text, 0)[:-1], text
    assert encoder(PATH).encode_all(texts) == [encoder(PATH).encode_all([t])[0] for t in texts]


def test_elias_fano_round_trip():
    rng = random.Random(1)
    for values in ([], [0], [5, 5, 5], [2**62], sorted(rng.randrange(10**9) for _ in range(3000)), list(range(700)), [0] * 600 + [10**12]):
        ef = token_output.EliasFano.of(np.array(values, np.uint64))
        data = b"xyz" + ef.to_bytes()
        again, end = token_output.EliasFano.from_bytes(memoryview(data), 3)
        assert end == len(data) and again.values().tolist() == values
        assert [again.select(i) for i in range(len(values))] == values
    dense = token_output.EliasFano.of(np.arange(0, 10**6, 37, dtype=np.uint64))
    assert len(dense.to_bytes()) < 10**6 // 37 * 1.3
    with pytest.raises(IndexError):
        dense.select(10**6)


def test_token_files(spark, docs, odd):
    path = shared_dir(spark, "tokens")
    token_output.write_token_files(docs(odd), path, PATH)
    got = sorted((tuple(r) for r in token_output.read_token_files(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for (doc_id, text), found in zip(rows, got, strict=True):
        ids = ids_of(text, 2)
        assert found == (doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_of_no_documents(spark, docs):
    path = shared_dir(spark, "tokens")
    token_output.write_token_files(docs([]), path, PATH)
    assert token_output.read_token_files(spark, path).collect() == []


def test_shard_gives_one_document():
    shard = token_output.Shard(token_output.pack_shard(1, 0, [None, 3, 9], [b"\1\0", b"\2\0\3\0", b"\4\0"], 2) + b"\n")
    assert [shard.document(i).tolist() for i in range(3)] == [[1], [2, 3], [4]]
    assert shard.ids_of_documents() == [None, 3, 9]
    assert [shard.start(i) for i in range(3)] == [0, 1, 3]


def test_a_document_is_found_by_select():
    rng = random.Random(5)
    known = sorted(rng.randrange(-(10**6), 10**6) for _ in range(2000))
    known[700:705] = [known[700]] * 5
    rows = [None, None, *known]
    ids = [np.arange(rng.randrange(1, 9), dtype="<u2").tobytes() for _ in rows]
    shard = token_output.Shard(token_output.pack_shard(0, 0, rows, ids, 2) + b"\n")
    assert all(shard.document(i).tobytes() == own for i, own in enumerate(ids))
    assert [shard.place_of(d) for d in known] == [2 + known.index(d) for d in known]
    missing = set(range(-1000, 1000)) - set(known) | {-(10**7), 10**7}
    assert {shard.place_of(d) for d in missing} == {None}


def check_packing(rows, wanted, room):
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= room
    found = sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = sorted(
        (d or -1, k, at, len(ids[at : at + room]), crc(ids[at : at + room]))
        for d, text in wanted for ids in [ids_of(text, 0)] for k, at in enumerate(range(0, len(ids), room))
    )
    assert found == want
    return len(places), sum(r["length"] for r in rows)


def test_packing_odd_rows(docs, odd):
    rows = packing.pack(docs(odd), PATH, room=64).collect()
    check_packing(rows, odd, 64)
    assert packing.pack(docs([]), PATH).collect() == []


def test_packing_is_close_to_the_bound(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(table.repartition(1), PATH).collect()
    n, total = check_packing(rows, [tuple(r) for r in table.select("doc_id", "text").collect()], 2048)
    assert n <= 1.02 * total / 2048 + 8


def test_packing_does_not_depend_on_partitions(spark, docs, prose):
    rows = [(i, prose(i % 37 + 1)) for i in range(400)]
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n, block in (("3", 4096), ("200", 4096), ("200", 100)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = packing.pack(docs(rows).repartition(int(n) // 2 + 1), PATH, room=256, block=block).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", asked)
        n_sequences, total = check_packing(got, rows, 256)
        assert n_sequences <= 1.01 * total / 256 + (400 // block + 1)
        found.append(sorted(tuple(r) for r in got))
    assert found[0] == found[1] and len({r[5] >> 40 for r in found[2]}) == 4


def test_bin_completion_beats_best_fit():
    # Best fit decreasing needs three sequences, completion finds the two.
    lengths = [6, 5, 5, 4, 4, 3, 3]  # 15 each
    assert len(packing.best_fit_decreasing(lengths, 15)) >= 2
    got = packing.complete(lengths, 15)
    assert len(got) == 2 and sorted(i for b in got for i in b) == list(range(7))
    hard = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 3  # sums to 540: six of 90? bound 6
    got = packing.complete(hard, 90)
    assert sorted(i for b in got for i in b) == list(range(30)) and all(sum(hard[i] for i in b) <= 90 for b in got)
    assert len(got) <= len(packing.best_fit_decreasing(hard, 90))


def test_optimum_on_small_cases():
    rng = random.Random(3)

    def least(lengths, room):
        best = len(lengths)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= room:
                    place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        return best

    for _ in range(60):
        lengths = sorted((rng.randint(2, 30) for _ in range(rng.randint(1, 9))), reverse=True)
        assert len(packing.complete(lengths, 40)) == least(lengths, 40), lengths


def test_fillings_are_undominated():
    left = packing.Lengths([7, 5, 5, 3, 2])
    found = packing.fillings(10, left, 100)
    assert (7, 3) in found and (5, 5) in found or found[0] in ((7, 3), (5, 5))
    assert all(sum(f) <= 10 for f in found) and (5, 3, 2) not in found[:1]
