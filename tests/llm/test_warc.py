import base64
import gzip
import glob
import hashlib

import pytest

from axonframe.llm import warc
from axonframe.llm.common import shared_dir


def made(spark, rows, least=0, versions=(1, 2)):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS key", "'y' AS digest")
    arc, out = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    for k, v in enumerate(versions):
        warc.write_arc(pages.filter(f"coalesce(page_id, 0) % {len(versions)} = {k}"), f"{arc}/v{v}", version=v)
    warc.convert(spark, f"{arc}/*", out, least)
    return out, [tuple(r) for r in warc.read_warc(spark, out).collect()]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (1, "http://a/x", "<p>hi</p>"), (2, "http://a/y z", "<p>hi</p>"), (3, None, None), (4, "no scheme", ""), (5, "http://a/x", "a\r\n\r\nWARC/1.1\r\nb\n\nhttp://fake 0 0 0 9\n"),
    (6, "http://é/ü", "ünï 漢字 \x00 \n"), (None, "http://n", "null id"), (7, "http://a", "same"), (7, "http://a", "same"), (8, "http://long", "line\n" * 200_000),
]


def test_records_against_plain_rules(spark):
    _, got = made(spark, ROWS)
    best = {}
    for page, _, html in ROWS:
        if page is not None:
            best[html or ""] = max(best.get(html or "", -1), page)
    want = list(
        (page or -1, len((html or "").encode()), b32(html), *(("response", None) if page in (None, best.get(html or "")) else ("revisit", best[html or ""])))
        for page, _, html in ROWS
    )
    assert sorted(((r[0] or -1, *r[1:5]) for r in got), key=str) == sorted(want, key=str)
    assert {r[6] for r in got} == {"2008-04-30T20:48:25Z"}


def test_small_payloads_stay_responses(spark):
    _, got = made(spark, ROWS, least=10)
    assert {r[3] for r in got if r[1] < 10} == {"response"}


def test_files_are_warc(spark):
    out, _ = made(spark, ROWS)
    for name in glob.glob(f"{out}/part-*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]


def test_empty_table(spark):
    assert made(spark, [])[1] == []


def test_ids_carry_keys():
    for key in (0, 1, -1, 2**62, -(2**63), 2**63 - 1):
        assert warc.key_of(warc.record_id(key, "salt")) == key


def test_arc_stream_takes_declared_lengths():
    text = b"filedesc://x 0.0.0.0 1996 text/plain 8\n2 0 me\n\n\ndamage\nhttp://a b 1.2.3.4 1996092314 text/html 200 - - 0 f 5\n\nab\n\n\n"
    lines = iter(text[:-1].split(b"\n"))
    ((version, fields, block),) = warc.arc_stream(warc.Stream(lines))
    assert (version, fields["URL"], block) == (2, "http://a b", b"\nab\n\n")
    assert warc.iso("1996092314") == "1996-09-23T14:00:00Z"


def test_cut_archive_is_an_error():
    with pytest.raises(ValueError, match="ends"):
        list(warc.arc_stream(warc.Stream(iter([b"http://a 1.1.1.1 19960101000000 text/html 50", b"short"]))))


def test_page_ids_of_any_size(spark):
    """Of equal payloads the record of the largest id is the response, up to the limits of a long."""
    ids = [3, 10**18 + 5, 2**63 - 1, -(2**63), 10**17]
    _, got = made(spark, [(i, "http://a", "same") for i in ids])
    assert {(r[0], r[3], r[4]) for r in got} == {(i, "response", None) if i == 2**63 - 1 else (i, "revisit", 2**63 - 1) for i in ids}
