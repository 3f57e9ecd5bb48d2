"""Quality rules: plain counts and tokeniser fertility with bands per language.

Fertility measures how public vocabularies cope with a text: characters per token under one
vocabulary with byte fallback and, if given, under a second; the shares of byte-fallback tokens and
of tokens without a letter or digit; and the entropy of the tokens. A text is taken word by word,
each word encoded once per task and remembered.

The bands are set from all documents of a language that pass the base rule: the median, and a
distance from it in robust deviations, with a least width so that even texts of one kind never
reject one another. The shorter the text, the wilder its ratios: the bands of ratios and shares
widen by the sampling error of its tokens. Entropy is taken with the bits that a text shorter than
most of its language cannot have, so that repetition shows in short texts as in long ones. No text
is left out; one without a language is held against those in the script of most of its letters.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import arrow_batches, written
from axonframe.llm.tokens import WordMemory

WORDS_LEAST, REPEATS_MOST, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Bands:
    """How far from its language's median a text may be: robust deviations, least widths, and what a short text gets more.

    ``sampling`` and ``bare_sampling`` (for tokens without a letter or digit) are divided by the root of the tokens;
    ``halving`` is entropy for each halving of the median's tokens.
    """

    deviations: float = 6.0
    least_log_ratio: float = 0.3
    least_fallback: float = 0.1
    least_bare: float = 0.1
    least_entropy: float = 1.0
    sampling: float = 1.0
    bare_sampling: float = 0.5
    halving: float = 0.35


class Fertility:
    """Tokens of a word under a SentencePiece vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(self.model.get_piece_size())
        self.is_byte = np.array([self.model.is_byte(i) for i in pieces])
        self.is_bare = ~self.is_byte & np.array([not any(map(str.isalnum, self.model.id_to_piece(i))) for i in pieces])
        self.memory = WordMemory(self.make)

    def make(self, words: list[bytes]) -> list[bytes]:
        return [array("I", i).tobytes() for i in self.model.encode([w.decode() for w in words], num_threads=1)]

    def ids(self, texts: Sequence[list[bytes]]) -> list[np.ndarray]:
        return [np.frombuffer(own, "<u4") for own in self.memory.texts(texts)]


@functools.cache
def fertility(path: str) -> Fertility:
    return Fertility(path)


#: Characters of a word that the second vocabulary sees at a time.
PIECE = 4096


class SecondCount:
    """Numbers of tokens of words, each after a space, under a vocabulary of ranks; long words in pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memory = WordMemory(self.make)

    def make(self, words: list[bytes]) -> list[bytes]:
        return [array("I", [self.count(f" {w.decode()}")]).tobytes() for w in words]

    def count(self, word: str) -> int:
        return sum(len(self.encoding.encode_ordinary(word[i : i + PIECE])) for i in range(0, len(word), PIECE))

    def of(self, texts: Sequence[list[bytes]]) -> list[int]:
        return [int(np.frombuffer(own, "<u4").sum()) for own in self.memory.texts(texts)]


@functools.cache
def second_count(path: str, pattern: str) -> SecondCount:
    return SecondCount(path, pattern)


# First code points of blocks of letters, and their scripts.
SCRIPTS = (
    (0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
    (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "other"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x32000, "other"),
)
SCRIPT_FROM = np.array([0, *[first for first, _ in SCRIPTS]])
SCRIPT_OF = ["none", *[name for _, name in SCRIPTS]]


def script_of(text: str) -> str:
    """The script of most letters, the first by name of equal ones; ``none`` without letters."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "none"
    letters, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)
    alike = np.array([chr(c).isalpha() for c in letters])
    sums = Counter()
    for place, n in zip(np.searchsorted(SCRIPT_FROM, letters[alike], "right") - 1, counts[alike], strict=True):
        sums[SCRIPT_OF[place]] += int(n)
    return min(sums, key=lambda name: (-sums[name], name), default="none")


def n_repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Names of windows by doubling: equal names, equal words; no hash can collide.
    name, width = ids, 1
    while width < window:
        pair = name[: len(name) - width] * (int(name.max()) + 1) + name[width:]
        name = np.unique(pair, return_inverse=True)[1]
        width *= 2
    if width != window:
        raise ValueError("the window must be a power of two")
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def n_dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measures(texts: list[str | None], path: str, second: tuple[str, str] | None = None) -> list[tuple]:
    words = [(t or "").encode().split() for t in texts]
    model = fertility(path)
    others = second_count(*second).of(words) if second else [None] * len(texts)
    return [measures_of(t or "", w, i, model, n) for t, w, i, n in zip(texts, words, model.ids(words), others, strict=True)]


def measures_of(text: str, words: list[bytes], ids: np.ndarray, model: Fertility, second: int | None) -> tuple:
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    share = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
    return (
        len(words), word_chars, n_symbols, n_dup_lines(text), n_repeat_words(words), len(ids),
        word_chars / len(ids) if len(ids) else 0.0,
        float(model.is_byte[ids].mean()) if len(ids) else 0.0,
        float(-(share * np.log2(share)).sum()) + 0.0,
        float(model.is_bare[ids].mean()) if len(ids) else 0.0,
        None if second is None else word_chars / second if second else 0.0,
    )


FIELDS = [
    *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")],
    *[(n, pa.float64()) for n in ("chars_per_token", "fallback_share", "token_entropy", "bare_share", "second_chars_per_token")],
]


def measure(docs: DataFrame, vocabulary: str, second: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, lang and the measures of every whole text; a null text has no words, a null language is the text's script."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = measures(texts, vocabulary, second)
            columns = list(zip(*found, strict=True)) or [[]] * len(FIELDS)
            arrays = [pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)]
            langs = [f"script {script_of(t or '')}" if lang is None else lang for lang, t in zip(batch["lang"].to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), *arrays], ["doc_id", "lang", *[n for n, _ in FIELDS]])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{n} {'long' if k == pa.int64() else 'double'}" for n, k in FIELDS)
    return rows.mapInArrow(run, f"doc_id long, lang string, {kinds}")


def fails_base() -> Column:
    return (F.col("n_words") < WORDS_LEAST) | (100 * F.col("n_repeat_words") > REPEATS_MOST * F.col("n_words"))


def sized(measured: DataFrame, bands: Bands) -> DataFrame:
    """Adds ``full_entropy``: with the bits that a text shorter than its language's median lacks for that."""
    size = F.log2(F.greatest("n_tokens", F.lit(1)))
    counted = measured.filter(~fails_base()).groupBy("lang", F.round(size, 2).alias("size")).agg(F.count("*").alias("n"))
    middles = counted.groupBy("lang").agg(F.percentile("size", 0.5, F.col("n")).alias("size_middle"))
    short = F.greatest(F.lit(0.0), F.coalesce("size_middle", size) - size)
    return measured.join(middles, "lang", "left").withColumn("full_entropy", F.col("token_entropy") + F.lit(bands.halving) * short)


def judged() -> dict[str, Column]:
    """What is held against a band: its name and value."""
    ratio, second = (
        F.when(F.col(c).isNotNull(), F.ln(F.greatest(c, F.lit(1e-9)))) for c in ("chars_per_token", "second_chars_per_token")
    )
    return {"ratio": ratio, "second": second, "fallback": F.col("fallback_share"), "bare": F.col("bare_share"), "entropy": F.col("full_entropy")}


def bands_of(measured: DataFrame, bands: Bands) -> DataFrame:
    """Median and width per language of each judged value, over all documents that pass the base rule.

    Values are rounded and counted first, so a language with most of the rows is a short list.
    """
    values = F.array(*[F.struct(F.lit(what).alias("what"), F.round(value, 3).alias("value")) for what, value in judged().items()])
    long = measured.filter(~fails_base()).select("lang", F.inline(values)).filter("value IS NOT NULL")
    counted = long.groupBy("lang", "what", "value").agg(F.count("*").alias("n"))
    middle = counted.groupBy("lang", "what").agg(F.percentile("value", 0.5, F.col("n")).alias("middle"))
    away = counted.join(middle, ["lang", "what"]).withColumn("away", F.abs(F.col("value") - F.col("middle")))
    spread = away.groupBy("lang", "what").agg(F.first("middle").alias("middle"), F.percentile("away", 0.5, F.col("n")).alias("mad"))
    least = {"ratio": bands.least_log_ratio, "second": bands.least_log_ratio, "fallback": bands.least_fallback, "bare": bands.least_bare, "entropy": bands.least_entropy}
    width = F.greatest(F.lit(bands.deviations * 1.4826) * F.col("mad"), *[F.when(F.col("what") == w, F.lit(v)) for w, v in least.items()])
    wide = spread.withColumn("width", width).groupBy("lang")
    return wide.agg(*[F.max(F.when(F.col("what") == w, F.col(c))).alias(f"{w}_{c}") for w in judged() for c in ("middle", "width")])


def quality_rules(docs: DataFrame, vocabulary: str, second: tuple[str, str] | None = None, bands: Bands = Bands()) -> DataFrame:
    """Per document the counts, ``base_failed`` and ``kept``, and its fertility measures.

    ``second`` is a file of ranks and the pattern that splits texts for it; without one its measure
    is null. Null and empty texts have no words and fail the base rule. Rows stand each for itself,
    with equal or null doc_ids too; a null language is replaced by the script. A text in a language
    of which none passes the base rule fails it itself. Further columns are not read. An empty table
    gives an empty one.
    """
    measured = sized(written(measure(docs, vocabulary, second), "fertility"), bands)
    rows = measured.join(bands_of(measured, bands), "lang", "left")
    root = F.sqrt(F.greatest("n_tokens", F.lit(1)).cast("double"))
    error, bare_error = F.lit(bands.sampling) / root, F.lit(bands.bare_sampling) / root
    above = {w: value - F.col(f"{w}_middle") for w, value in judged().items()}
    outside = (
        (F.abs(above["ratio"]) > F.col("ratio_width") + error)
        | F.coalesce(F.abs(above["second"]) > F.col("second_width") + error, F.lit(False))
        | (above["fallback"] > F.col("fallback_width") + error)
        | (above["bare"] > F.col("bare_width") + bare_error)
        | (above["entropy"] < -F.col("entropy_width"))
    )
    return rows.select(
        "doc_id", *[F.col(n) for n, _ in FIELDS], fails_base().alias("base_failed"),
        (~fails_base() & ~F.coalesce(outside, F.lit(False))).alias("kept"),
    )
