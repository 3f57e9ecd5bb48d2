"""Token-id files: one concatenated id array with Elias-Fano document boundaries.

A shard holds whole documents in ascending doc_id order:

    magic  "AXEF0002"                      8 bytes
    header bucket, number, n_docs, n_null, n_ids, id width, id base      7 x int64, little-endian
    ids of the documents   (Elias-Fano, relative to the base, without the null ones)
    ends of the documents  (Elias-Fano, in ids from the start of the shard)
    token ids              n_ids x width bytes, little-endian
    one line feed

An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n)) bits: the low bits
are packed, the high ones are unary in a bit vector whose every 64th one is sampled (32 bits each),
so the i-th value is one select away. Readers take the offsets of documents by select
and never decode a table of boundaries. Nulls come first; rows with equal ids follow by text.

Files are written by Spark's text writer (a shard is one line of raw bytes) and read by its
binary reader, so they may lie in any store that Spark reaches. Ids are written in tasks that
stream their sorted rows: a task holds one shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonframe.llm.common import arrow_batches, deal_in_order, in_partitions, written
from axonframe.llm.tokens import encoder, ids_crc32

MAGIC = b"AXEF0002"
SAMPLE = 64
SHARD_IDS, SHARD_DOCS = 8 << 20, 1 << 17
HEADER = "<7q"


class EliasFano:
    """A non-decreasing sequence of integers from 0; ``select`` gives one of them."""

    HEAD = "<3q"

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.lows, self.highs, self.samples = n, low_bits, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, "<u4"))
        low = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low, lows, np.packbits(high, bitorder="little").tobytes(), cls.sampled(ones))

    @staticmethod
    def sampled(ones: np.ndarray) -> np.ndarray:
        """Places of every SAMPLE-th one; a sequence has at most three bits a value, so 32 do for SHARD_DOCS."""
        if ones[-1] >= 1 << 32:
            raise ValueError("too many values for one sequence")
        return ones[::SAMPLE].astype("<u4")

    def to_bytes(self) -> bytes:
        return struct.pack(self.HEAD, self.n, self.low_bits, len(self.highs)) + self.lows + self.highs + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low, n_high = struct.unpack_from(cls.HEAD, data, at)
        at += struct.calcsize(cls.HEAD)
        n_low, n_samples = (n * low + 7) // 8, -(-n // SAMPLE)
        lows, highs = bytes(data[at : at + n_low]), bytes(data[at + n_low : at + n_low + n_high])
        at += n_low + n_high
        samples = np.frombuffer(data, "<u4", n_samples, at)
        return cls(n, low, lows, highs, samples), at + 4 * n_samples

    def select(self, i: int) -> int:
        """Value i: from the sampled one before it, then by counted bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, place = i % SAMPLE, int(self.samples[i // SAMPLE])
        if left:
            byte = (place + 1) // 8
            word = self.highs[byte] & (0xFF << ((place + 1) % 8)) & 0xFF
            while left > word.bit_count():
                left -= word.bit_count()
                byte += 1
                word = self.highs[byte]
            for _ in range(left - 1):
                word &= word - 1
            place = 8 * byte + (word & -word).bit_length() - 1
        first, low = i * self.low_bits, 0
        if self.low_bits:
            last = first + self.low_bits
            part = int.from_bytes(self.lows[first // 8 : -(-last // 8)], "little")
            low = (part >> (first % 8)) & ((1 << self.low_bits) - 1)
        return (place - i) << self.low_bits | low

    def values(self) -> np.ndarray:
        """All values at once."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))[: self.n]
        high = (high - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), count=self.n * self.low_bits, bitorder="little")
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return high + (bits.reshape(self.n, self.low_bits).astype(np.uint64) * weights).sum(1, dtype=np.uint64)


class Shard:
    """A shard's bytes, opened: ids, boundaries and the ids of one document."""

    def __init__(self, data: bytes | memoryview, at: int = 0) -> None:
        view = memoryview(data)
        if bytes(view[at : at + len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        at += len(MAGIC)
        self.bucket, self.number, self.n_docs, self.n_null, self.n_ids, width, self.base = struct.unpack_from(HEADER, view, at)
        self.doc_ids, at = EliasFano.from_bytes(view, at + struct.calcsize(HEADER))
        self.ends, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)
        self.end = at + self.n_ids * width + 1

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.ends.select(i)]

    def place_of(self, doc_id: int) -> int | None:
        """The first document with this id: a binary search that selects one id a step."""
        low, high = 0, self.doc_ids.n
        while low < high:
            middle = (low + high) // 2
            if self.doc_ids.select(middle) + self.base < doc_id:
                low = middle + 1
            else:
                high = middle
        there = low < self.doc_ids.n and self.doc_ids.select(low) + self.base == doc_id
        return self.n_null + low if there else None

    def ids_of_documents(self) -> list[int | None]:
        return [None] * self.n_null + [int(v) + self.base for v in self.doc_ids.values()]


def pack_shard(bucket: int, number: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    head = struct.pack(HEADER, bucket, number, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), width, base)
    relative = np.array([d - base for d in known], np.uint64)
    return MAGIC + head + EliasFano.of(relative).to_bytes() + EliasFano.of(ends).to_bytes() + b"".join(ids)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Write ``doc_id, text`` as token shards under ``path``, each document followed by ``end_id``."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = deal_in_order(rows, "doc_id")
    bucket = dealt.bucket

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        stop = enc.one(end_id)
        doc_ids, ids, held, place, number = [], [], 0, None, 0
        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, number
            data = pack_shard(place, number, doc_ids, ids, enc.width)
            doc_ids, ids, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict({"shard": pa.array([data], pa.binary())})

        for batch in batches:
            table = batch.to_pydict()
            for b, doc_id, own in zip(table[bucket], table["doc_id"], enc.encode_all(table["text"]), strict=True):
                if ids and (b != place or held >= SHARD_IDS or len(ids) >= SHARD_DOCS):
                    yield flush()
                if b != place:
                    place, number = b, 0
                tokens = own + stop
                doc_ids.append(doc_id)
                ids.append(tokens)
                held += len(tokens) // enc.width
        if ids:
            yield flush()

    made = in_partitions(dealt, [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()])
    made.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards: doc_id, start (over all shards), n_tokens, ids_crc32.

    Files are read once; what is kept of each document is one small row, written to the shared folder.
    A shard's start is a running sum over one row per shard, at least 2^17 documents or 2^23 ids each but
    for the last of a range: a window without a key over as many rows.
    """
    arrow_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, shard in opened(batches):
            starts = np.fromiter(map(shard.start, range(shard.n_docs)), np.int64, shard.n_docs)
            ends = np.append(starts[1:], shard.n_ids)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([shard.bucket] * shard.n_docs, pa.int64()),
                "number": pa.array([shard.number] * shard.n_docs, pa.int64()),
                "doc_id": pa.array(shard.ids_of_documents(), pa.int64()),
                "first": pa.array(starts),
                "n_tokens": pa.array(ends - starts),
                "ids_crc32": pa.array([ids_crc32(shard.ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
            })

    rows = written(files.mapInArrow(documents, "bucket long, number long, doc_id long, first long, n_tokens long, ids_crc32 long"), "token-rows")
    sizes = rows.groupBy("bucket", "number").agg(F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("bucket", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["bucket", "number"]).select(
        "doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            data, at = memoryview(content.as_buffer()), 0
            while at < len(data):
                shard = Shard(data, at)
                at = shard.end
                yield path, shard
