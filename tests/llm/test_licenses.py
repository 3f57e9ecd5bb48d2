import re

import pytest

from axonframe.llm import licenses

MIT = licenses.TEMPLATES[4][0]
ISC = licenses.TEMPLATES[7][0]
TEXTS = {
    1: "x CC-BY y cc by cc  BY cc", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "All rights\nreserved; all RIGHTS reserved.",
    4: "Licensed under CC BY-NC 4.0.", 5: f"a b {MIT} c", 6: " ".join(w for i, w in enumerate(MIT.split()) if i != 9), 7: "of this software and associated documentation", 8: "ccé by cc by",
    9: f"{MIT} and {ISC}".upper(), 10: "cc by-sa", 11: "c" * 100_000 + " cc by", 12: "all rights not reserved", 13: "general public", 14: "v1cc by2",
}


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.fixture
def found(docs, odd):
    rows = [*odd, *[(100 + i, t) for i, t in TEXTS.items()], (102, TEXTS[2])]
    return rows, licenses.scan_licenses(docs(rows)).collect()


def test_base(found):
    rows, got = found
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((d, *base(t)) for d, t in rows), key=str)


def test_labels(found):
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in found[1]}
    assert labels[102] == ("gpl", 1.0) and labels[104] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert labels[105] == ("mit", 1.0) and labels[107] == ("", 0.0) and labels[109] == ("isc,mit", 1.0)
    label, score = labels[106]  # one word left out: two diagonals make one span
    assert label == "mit" and 0.6 <= score < 1
    assert all(0 <= s <= 1 for _, s in labels.values())


def test_no_documents(docs):
    assert licenses.scan_licenses(docs([])).collect() == []


def test_every_gram_can_be_told_by_an_anchor():
    anchors = licenses.anchors()
    for *_, is_base, _, _, gram in licenses.template_rows():
        assert is_base or licenses.has_phrase(gram.split()) or any(a in gram for a in anchors)


@pytest.mark.parametrize(("notice", "label"), [
    ("Released under the MIT License.", "mit"), ("Licensed under the MIT license", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the Apache License 2.0", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("License: CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), ("All rights reserved.", "reserved"),
    ("Released under the BSD license", "bsd"), ("Licensed under the ISC license", "isc"), ("Released under the Mozilla Public License 2.0", "mpl-2.0"),
    ("CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("Released under the Unlicense", "unlicense"), ("Released under the old tree.", ""), ("MIT is a school", ""),
])
def test_plain_notices(docs, notice, label):
    (got,) = licenses.scan_licenses(docs([(1, f"some prose ahead of it. {notice}\nand some after it")])).collect()
    assert got["labels"] == label and got["score"] == (1.0 if label else 0.0)


def test_whole_texts(docs):
    rows = [(i, f"ahead of it\n{text}\nafter it") for i, (text, _) in enumerate(licenses.TEXTS)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(rows)).collect()}
    for i, (_, label) in enumerate(licenses.TEXTS):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    # No text stands for a license that is not its own.
    assert {got[i]["labels"] for i in range(len(rows))} == {"mit", "isc", "bsd", "apache-2.0", "gpl", "mpl-2.0", "zlib"}


def test_spans_are_verified(docs):
    words = licenses.plain_words(licenses.TEXTS[3][0]).split()
    lone = ("software", "distributed", "under", "the", "license")
    rows = [
        # The same grams again and again are counted once.
        (1, " x y z ".join([" ".join(words[20:26])] * 40)),
        # Less than the share of the template.
        (2, " ".join(words[40:70])), (3, " ".join(lone * 3)),
        # Words put in after every seventh leave it whole enough; after every fourth, too few words are the template's.
        (4, " ".join(w if i % 9 else f"{w} so" for i, w in enumerate(words))),
        (5, " ".join(w if i % 4 else f"{w} so to say" for i, w in enumerate(words))),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs(rows)).collect()}
    assert got[1] == got[2] == got[3] == got[5] == ("", 0.0)
    assert got[4][0] == "apache-2.0"


def test_all_grams_vote(docs):
    grams = {t: [r[-1] for r in licenses.template_rows() if r[0] == f"text {t}"] for t, _ in licenses.TEMPLATES}
    for template, found in grams.items():
        words = template.split()
        assert found == [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    # 9 of the 14 grams; some have no long word.
    (got,) = licenses.scan_licenses(docs([(1, "This Source Code Form is subject to the terms of the Mozilla")])).collect()
    assert got["labels"] == "mpl-2.0" and got["score"] == 9 / 14


def test_no_text_with_a_gram_is_passed_over():
    for *_, gram in licenses.template_rows():
        if len(gram.split()) == licenses.K or gram in licenses.PHRASES:
            assert re.search(licenses.possible(), gram) and re.search(licenses.possible(), "a  (" + gram.replace(" ", ",\n- ") + "s)")
    assert not re.search(licenses.possible(), "the license of a common text, in any case")
