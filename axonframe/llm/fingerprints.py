"""Bottom-k sketches of word shingles: mergeable fingerprints of whole texts.

A sketch is the k smallest 48-bit hashes of a text's distinct shingles, in ascending order, as
base64 of 6-byte big-endian numbers. Sketches of parts merge to the sketch of the whole set; two
sketches estimate resemblance, containment and, one alone, the number of distinct shingles. All
three are exact while the sets at hand have fewer than k shingles together. White space is ASCII's; letter case counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import arrow_batches, deal_in_order
from axonframe.llm.shingles import shingles_of

K, WORDS = 256, 5
SPACE = 1 << 48


def sketch(values: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct 48-bit hashes."""
    small = values >> np.uint64(16)
    if len(small) > 4 * k:
        # The k smallest distinct ones are among the smallest; widen if repeats fill them up.
        take = 2 * k
        while take < len(small):
            part = np.unique(np.partition(small, take)[:take])
            if len(part) > k:
                return part[:k]
            take *= 2
    return np.unique(small)[:k]


def merge(sketches: Sequence[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.unique(np.concatenate([*sketches, np.zeros(0, np.uint64)]))[:k].astype(np.uint64)


def distinct_count(s: np.ndarray, k: int = K) -> float:
    return float(len(s)) if len(s) < k else (k - 1) * SPACE / (float(s[-1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity of the sets; 1 for two empty ones."""
    both = merge([a, b], k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's set that lies in b's; 1 for an empty a."""
    if not len(a):
        return 1.0
    union = distinct_count(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).ravel().view(">u8").astype(np.uint64)


def fingerprints(texts: Sequence[str], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    return [sketch(values, k) for values in shingles_of([t.encode() for t in texts], words)]


def fingerprint(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    return fingerprints([text], k, words)[0]


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles double, kept_share double"
)


def compared(pairs: Sequence[tuple[tuple, tuple]], k: int, words: int) -> pa.RecordBatch:
    """Results for (document, next document) pairs of (doc_id, text, sketch)."""
    edits = []
    for (_, text, _), (_, following, _) in pairs:
        cut = len(text) // 3
        edits.append(text[: len(text) - cut] + following[:cut])
    out = [
        (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(changed),
            resemblance(own, changed, k), resemblance(own, following, k), distinct_count(own, k), containment(own, changed, k),
        )
        for ((doc_id, text, own), (_, _, following)), edited, changed in zip(pairs, edits, fingerprints(edits, k, words), strict=True)
    ]
    columns = list(zip(*out, strict=True)) or [[]] * 9
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], OUT.replace(",", "").split()[::2])


def compare_with_edits(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each text beside its edited form, whose last third is the beginning of the next document.

    The next document is that of the next smaller doc_id; the smallest is followed by the largest.
    Rows of one doc_id follow in order of their texts; null ids come last. A null text is empty; a
    table of one row is its own next. ``n_shingles`` is the estimated number of distinct shingles,
    ``kept_share`` the estimated containment of the text in its edited form.

    Rows move once, to ranges of the id. The first document of a range goes to the range above
    too, as the next of its last one, so each task reads its sorted rows as a stream and holds two.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = deal_in_order(rows, "doc_id")
    bucket = dealt.bucket
    # The largest id of each range, one row a range.
    heads = {r[bucket]: r["head"] for r in dealt.rows.groupBy(bucket).agg(F.max("doc_id").alias("head")).collect()}
    used = sorted(heads)
    above = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    size = max([*used, 0]) + 1
    head_of = F.array(*[F.lit(heads.get(b)).cast("long") for b in range(size)])
    above_of = F.array(*[F.lit(above.get(b, 0)) for b in range(size)])
    is_head = F.col("doc_id").eqNullSafe(F.element_at(head_of, F.col(bucket) + 1))
    own = F.struct(F.col(bucket).alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(above_of, F.col(bucket) + 1).alias("at"), F.lit(True).alias("guest"))
    placed = dealt.rows.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("place"))
    flat = placed.select("doc_id", "text", F.col("place.at").alias("at"), F.col("place.guest").alias("guest"))
    ordered = flat.repartitionById(max(1, dealt.n), F.col("at")).sortWithinPartitions(
        F.col("at"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, at, closed = None, None, False
        for batch in batches:
            pairs = []
            columns = [c.to_pylist() for c in batch.columns]
            for doc_id, text, place, is_guest, own in zip(*columns, fingerprints(columns[1], k, words), strict=True):
                if place != at:
                    waiting, at, closed = None, place, False
                if closed:
                    continue  # further rows of the guest's id
                doc = (doc_id, text, own)
                if waiting:
                    pairs.append((waiting, doc))
                waiting, closed = doc, is_guest
            yield compared(pairs, k, words)

    return ordered.mapInArrow(compare, OUT)
