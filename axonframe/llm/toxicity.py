"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Three parts of the labelled sample are kept apart by a hash: one gives the lexicon (words and
word beginnings that mark toxic texts), one the trees, one the calibration. So the trees see how
far the lexicon can be trusted on texts that it was not made from, and the calibration how far
the trees can. Labels are looked at for sampled rows only, never where crc32(doc_id) mod 3 is 1.

Scoring is one pass over the texts: features in Arrow batches, trees and calibration by Spark ML.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import arrow_batches, fresh, whole_text, written

#: Labelled rows that the model is fitted on, at most about so many.
SAMPLE = 24_000
#: Terms of the learned lexicon, and from how many toxic texts of its part (or which share of them) a term is taken.
TERMS, SEEN_LEAST, SEEN_SHARE, SURE = 400, 4, 0.004, 0.8
THRESHOLD = 0.7
MEMORY = 400_000

# Insults known beforehand, and words of the second person.
INSULTS = frozenset("clown crap creep disgusting dumb fool freak garbage idiot idiots imbecile jerk loser losers moron morons pathetic scum shut stupid trash ugly vermin worthless".split())
YOU = frozenset("you your yours yourself youre ur u tu toi te ton ta vous votre vos du dich dir dein deine ihr euch usted ustedes ti tuyo vosotros".split())
PLAIN = str.maketrans("013457@$!|", "oieastasil")
BEGINNINGS = (4, 5, 6)

FEATURES = (
    "terms per word", "terms", "weight of terms", "heaviest term", "insults per word", "insults",
    "second person per word", "nearness of second person and a term", "capitals", "words in capitals",
    "exclamation and question marks", "other punctuation", "obfuscated words", "obfuscated terms", "log of words",
)


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}|#%&*$-_").lower()


def terms_in(word: str) -> list[str]:
    """The word and its beginnings (marked by a dash)."""
    return [word, *[f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n]]


class Words(dict):
    """What one written word stands for: its number in the table of flags and weights."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.rows: list[tuple] = []
        self.numbers: dict[tuple, int] = {}

    def __missing__(self, word: str) -> int:
        low = bare(word)
        weight = max((self.lexicon.get(t, 0.0) for t in terms_in(low)), default=0.0)
        hidden = low.translate(PLAIN).replace("*", "").replace(".", "").replace("-", "") if low and not low.isalpha() else low
        masked = hidden != low and any(c.isalpha() for c in low)
        found = max((self.lexicon.get(t, 0.0) for t in terms_in(hidden)), default=0.0) if masked else 0.0
        row = (weight, low in INSULTS, low in YOU, len(low) > 1 and word.isupper(), masked, float(masked and (found > 0 or hidden in INSULTS)))
        if len(self) > MEMORY:
            self.clear()
        self[word] = number = self.numbers.setdefault(row, len(self.numbers))
        if number == len(self.rows):
            self.rows.append(row)
        return number


def features(text: str, words: Words) -> list[float]:
    tokens = text.split()
    n = max(1, len(tokens))
    numbers = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    table = np.array(words.rows, np.float64).reshape(-1, 6)[numbers]
    letters = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars = max(1, int(letters.sum()))
    weight, hit = table[:, 0], (table[:, 0] > 0) | (table[:, 1] > 0)
    near, you, at = 0.0, np.flatnonzero(table[:, 2]), np.flatnonzero(hit)
    if len(you) and len(at):
        right = np.searchsorted(you, at)
        gaps = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
        near = 1.0 / (1.0 + float(gaps.min()))
    marks = letters[33] + letters[63]
    other = letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum() - marks
    return [
        float((weight > 0).sum()) / n, math.log1p(float((weight > 0).sum())), float(weight.sum()) / n, float(weight.max(initial=0.0)),
        float(table[:, 1].sum()) / n, math.log1p(float(table[:, 1].sum())), float(table[:, 2].sum()) / n, near,
        float(letters[65:91].sum()) / chars, float(table[:, 3].sum()) / n, float(marks) / n, float(other) / n,
        float(table[:, 4].sum()) / n, float(table[:, 5].sum()), math.log1p(len(tokens)),
    ]


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(lexicon)
        for batch in batches:
            yield pd.Series([features(t, words) for t in batch])

    return run(whole_text(text.cast("string")))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms with their log odds: those of toxic texts first, then how often clean texts have them.

    Equal texts count once. At most ``TERMS`` terms come to the driver.
    """
    texts = sample.dropDuplicates(["text", "toxic"])
    totals = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"].to_pylist():
                counts.update({t for w in {bare(w) for w in text.split()} if w for t in terms_in(w)})
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("text").mapInArrow(presence, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    least = max(SEEN_LEAST, SEEN_SHARE * toxic)
    of_toxic = counted(texts.filter("toxic = 1"), "bad").filter(F.col("bad") >= least)
    both = of_toxic.join(counted(texts.filter("toxic = 0"), "good"), "term", "left").na.fill(0, ["good"])
    # A rate among toxic texts against the rate among clean ones, smoothed.
    odds = F.ln((F.col("bad") + 0.5) / (toxic + 1.0)) - F.ln((F.col("good") + 0.5) / (clean + 1.0))
    sure = both.withColumn("weight", odds).filter((F.col("bad") >= SURE * (F.col("bad") + F.col("good"))) & (F.col("weight") > 0))
    top = sure.orderBy(F.desc(F.col("bad") * F.col("weight")), "term").limit(TERMS)
    return {r["term"]: r["weight"] for r in top.select("term", "weight").collect()}


@dataclass
class ToxicityModel:
    """A fitted model; without both labels in the sample it scores every text ``constant``."""

    lexicon: dict[str, float]
    trees: object | None
    calibration: object | None
    constant: float

    def score(self, docs: DataFrame, out: str) -> DataFrame:
        """``docs`` with the score of each text."""
        arrow_batches(docs.sparkSession)
        if self.trees is None:
            return docs.withColumn(out, F.lit(self.constant))
        dense, raw, both, margin, scaled = fresh(docs, "tox_dense", "tox_raw", "tox_probability", "tox_margin", "tox_scaled")
        rows = docs.withColumn(dense, array_to_vector(feature_column(F.col("text"), self.lexicon)))
        trees = self.trees.copy().setFeaturesCol(dense).setRawPredictionCol(raw).setProbabilityCol(both).setPredictionCol("")
        rows = trees.transform(rows).withColumn(margin, vector_to_array(both)[1])
        rows = self.calibration.copy().setFeaturesCol(margin).setPredictionCol(scaled).transform(rows)
        # Calibration has steps; a thousandth of the trees' own value orders texts within one.
        value = 0.999 * F.col(scaled) + 0.001 * F.col(margin)
        return rows.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).drop(dense, raw, both, margin, scaled)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> ToxicityModel:
    """Fit on a hashed sample of the labelled rows, about ``sample_rows`` at most.

    A doc_id labelled more than once is toxic if one of its labels says so. Null labels and ids
    are left out.
    """
    arrow_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(remainder(F.col("doc_id")) != 1)
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    drawn = known.withColumn("part", part).filter(F.col("part") < 1_000_000 * min(1.0, sample_rows / max(1, n)))
    drawn = drawn.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text").cast("string")).alias("text"))
    # The drawn labels are bounded by sample_rows, some 20 bytes each.
    sample = written(texts.join(F.broadcast(drawn), "doc_id"), "toxicity-sample")
    lexicon = learn_lexicon(sample.filter("part < 4"))
    dense = sample.select("part", F.col("toxic").cast("double").alias("label"), array_to_vector(feature_column(F.col("text"), lexicon)).alias("features"))
    dense = written(dense, "toxicity-features")
    of = {r["part"]: (r["n"], r["s"]) for r in dense.groupBy((F.when(F.col("part") < 8, 0).otherwise(1)).alias("part")).agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()}
    (n_trees, bad_trees), (n_rest, bad_rest) = of.get(0, (0, 0.0)), of.get(1, (0, 0.0))
    if not (0 < bad_trees < n_trees) or not n_rest:
        return ToxicityModel(lexicon, None, None, (bad_trees + bad_rest) / max(1, n_trees + n_rest))
    trees = GBTClassifier(maxIter=24, maxDepth=3, stepSize=0.25, maxBins=48, seed=7, labelCol="label", featuresCol="features")
    model = trees.fit(dense.filter("part >= 4 and part < 8") if bad_in(dense, 4, 8) else dense.filter("part < 8"))
    scored = model.transform(dense.filter("part >= 8")).select("label", vector_to_array("probability")[1].alias("margin"))
    calibration = IsotonicRegression(labelCol="label", featuresCol="margin").fit(scored)
    return ToxicityModel(lexicon, model, calibration, 0.0)


def bad_in(dense: DataFrame, low: int, high: int) -> bool:
    row = dense.filter((F.col("part") >= low) & (F.col("part") < high)).agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    return row["a"] == 0.0 and row["b"] == 1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted.

    Null texts count as empty. Rows stand each for itself; a null id is not held out. Further
    columns are not read. An empty table gives an empty result.
    """
    model = fit(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return model.score(rows, "score").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The table without the texts whose score reaches ``threshold``."""
    (score,) = fresh(docs, "toxicity_score")
    return fit(docs, labels).score(docs, score).filter(F.col(score) < threshold).select(docs.columns)
