import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken

from axonframe.llm import quality

PATH = public_tokenizers.path("piece_bpe_32k.model")
SECOND = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts(docs, odd, prose):
    rows = [*odd, (20, prose(300)), (21, prose(10) + "\n" + prose(12)), (22, "a b\na b\n \n \na b\x0b\n"), (23, "x " * 9), (24, " ".join([prose(30)] * 2)), (25, "a b  c \x1c d #$%"), (26, prose(200) + " " + "q w e r t y u i " * 2)]
    got = quality.quality_rules(docs(rows), PATH).collect()
    find = lambda r: (r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
    assert sorted(map(find, got), key=str) == sorted(((d, *plain(t)) for d, t in rows), key=str)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert {r["doc_id"] for r in got if r["kept"]} >= {20, 26}
    assert quality.quality_rules(docs([]), PATH).collect() == []


def test_fertility_of_words():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = "plain words, ünïcode 漢字 \U0001f600"
    ids = [i for w in text.split() for i in model.encode(w)]
    n, share = len(ids), Counter(ids)
    (got,) = quality.measures([text], PATH, SECOND)
    assert got[5] == n and math.isclose(got[6], sum(len(w) for w in text.split()) / n)
    assert math.isclose(got[7], sum(model.is_byte(i) for i in ids) / n) and got[7] > 0
    assert math.isclose(got[8], -sum(c / n * math.log2(c / n) for c in share.values()))
    bare = [not any(c.isalnum() for c in model.id_to_piece(i)) and not model.is_byte(i) for i in ids]
    assert math.isclose(got[9], sum(bare) / n) and got[9] > 0
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(SECOND[0], "rb"))}
    encoding = tiktoken.Encoding("plain", pat_str=SECOND[1], mergeable_ranks=ranks, special_tokens={})
    assert math.isclose(got[10], sum(len(w) for w in text.split()) / len(encoding.encode_ordinary(" " + text)))
    assert quality.measures([text, None, ""], PATH)[0][10] is None
    ((*_, long),) = quality.measures(["c" * 100_000], PATH, SECOND)
    assert long > 1


def test_scripts():
    found = {"plain": "Latin", "12 !": "none", "": "none", "ünïcode": "Latin", "слово a": "Cyrillic", "漢字仮名a": "Han", "αβγ д": "Greek", "שלום": "Hebrew", "aд": "Cyrillic"}
    assert {t: quality.script_of(t) for t in found} == found


def plain_verdicts(rows, bands):
    """doc_id -> kept, from the measures of each row by plain medians."""
    middle = lambda values: float(np.percentile(values, 50))
    by_lang, out = {}, {}
    for (doc_id, text, lang), m in zip(rows, quality.measures([t for _, t, _ in rows], PATH, SECOND), strict=True):
        base = m[0] < 20 or 100 * m[4] > 30 * m[0]
        by_lang.setdefault(lang or quality.script_of(text or ""), []).append((doc_id, base, m))
    for own in by_lang.values():
        passed = [m for _, base, m in own if not base]
        if not passed:
            out |= {d: False for d, *_ in own}
            continue
        size = middle([round(math.log2(m[5]), 2) for m in passed])
        entropy = lambda m: m[8] + bands.halving * max(0.0, size - math.log2(max(1, m[5])))
        values = (lambda m: math.log(max(m[6], 1e-9)), lambda m: math.log(max(m[10], 1e-9)), lambda m: m[7], lambda m: m[9], entropy)
        least = (bands.least_log_ratio, bands.least_log_ratio, bands.least_fallback, bands.least_bare, bands.least_entropy)
        limits = []
        for value, low in zip(values, least, strict=True):
            seen = [round(value(m), 3) for m in passed]
            mid = middle(seen)
            limits.append((mid, max(low, bands.deviations * 1.4826 * middle([abs(v - mid) for v in seen]))))
        for doc_id, base, m in own:
            away = [value(m) - mid for value, (mid, _) in zip(values, limits, strict=True)]
            wide = [w for _, w in limits]
            e, b = bands.sampling / math.sqrt(max(1, m[5])), bands.bare_sampling / math.sqrt(max(1, m[5]))
            outside = abs(away[0]) > wide[0] + e or abs(away[1]) > wide[1] + e or away[2] > wide[2] + e or away[3] > wide[3] + b or away[4] < -wide[4]
            out[doc_id] = not base and not outside
    return out


def test_verdicts_of_the_given_texts(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in table.collect()]
    rows += [(-1, rows[0][1], None), (-2, None, None), (-3, "слово " * 30, None), (-4, rows[1][1], "xx")]
    got = quality.quality_rules(spark.createDataFrame(rows, table.schema), PATH, SECOND).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == plain_verdicts(rows, quality.Bands())


def test_labelled_junk_goes_and_good_texts_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), PATH, SECOND).collect() if not r["base_failed"]]
    junk, good = ([r["kept"] for r in got if labels.get(r["doc_id"]) == q] for q in (0, 1))
    assert len(junk) > 20 and sum(junk) <= 0.05 * len(junk)
    assert len(good) > 200 and sum(good) >= 0.995 * len(good)


def test_bands_per_language(docs, prose):
    rows = [(i, prose(100), "en", "s") for i in range(40)] + [(100 + i, " ".join("漢字仮名交" for _ in range(60)) + f" {i}", "ja", "s") for i in range(3)]
    bytes_in_en = [(200, " ".join(chr(0x1F600 + i % 60) + chr(0x13000 + i) for i in range(120)), "en", "s")]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs(rows + bytes_in_en), PATH).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not got[200]["kept"] and not got[200]["base_failed"]
    # A text without a language is held against those in its script.
    one = quality.quality_rules(docs([(1, prose(100), None, "s")]), PATH).collect()
    assert one[0]["kept"]


def test_noise_is_rejected(spark, sf):
    rng = random.Random(1)
    some = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(3, most)))
    noise = {
        -1: [base64.b64encode(rng.randbytes(9)).decode() for _ in range(150)], -2: [hashlib.md5(bytes([i])).hexdigest() for i in range(150)],
        -3: [some("abcdefghijklmnopqrstuvwxyz", 9) for _ in range(150)], -4: [some("#*$%&|<>@!^~", 6) for _ in range(150)],
        -5: [rng.choice("buy cheap pills online now best price free shipping click here today".split()) for _ in range(150)],
        # Short ones are judged too.
        -6: [some("#*$%&|<>@!^~", 3) for _ in range(22)],
    }
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    bad = spark.createDataFrame([(i, " ".join(w), "en") for i, w in noise.items()], table.schema)
    got = {r["doc_id"]: r for r in quality.quality_rules(table.unionByName(bad), PATH).collect()}
    for i in noise:
        assert not got[i]["base_failed"] and not got[i]["kept"], (i, got[i])
