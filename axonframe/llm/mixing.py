"""Mixing sources to target weights by Poisson replication.

A document of a source is repeated Poisson(rate) times, rate being the source's target size over
its size; the count inverts the distribution at a uniform number hashed from seed and doc_id, so
it is the same in every run and on every machine. A rate above 16 is the sum of equal slices of at
most 16, each with a uniform number of its own: a sum of Poisson counts is one. A row is multiplied
step by step, by blocks of slices, slices and counts, each a short array, and blocks are dealt out before
they grow, so no rate is too large for one task. Copies are dealt out by a hash of (seed,
doc_id, copy) and sorted by it: a global shuffle. Only DataFrame functions are used; sources are
one row each, so a source with most of the documents is no hot key: the join with them is a
broadcast while they fit, else Spark deals out the large side's skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import fresh, whole_text, written

#: Largest count of a slice of a rate; Poisson(rate) passes it with a probability below 1e-12 for rates up to 16.
MOST = 64
#: The largest rate of a slice, and the slices of a block.
SLICE, BLOCK = 16.0, 4096


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 48 bits, from the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def poisson_limits(rate: Column) -> Column:
    """P(N <= k) for k = 0 .. MOST - 1."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda acc, k: F.struct(
        (acc["p"] * rate / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST - 1)), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, total_share: float, rate_most: float | None) -> DataFrame:
    """Per source: chars, target share and rate. Without weights all sources weigh the same.

    Sources that ``weights`` does not name get weight 0. A source without characters gets rate 0.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sizes = docs.groupBy(source.alias("source")).agg(F.sum(F.char_length(whole_text()).cast("long")).alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.join(named, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.col("weight")).otherwise(F.lit(0.0)))
    # A row a source, written once; the two totals come to the driver.
    sizes = written(sizes, "source-sizes")
    total = sizes.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(float(total["weight"] or 1.0))
    wanted = share * F.lit(int(total["chars"] or 0)) * F.lit(float(total_share)) / F.col("chars")
    rate = F.when((F.col("chars") > 0) & (F.col("weight") > 0), wanted).otherwise(F.lit(0.0))
    if rate_most is not None:
        rate = F.least(rate, F.lit(float(rate_most)))
    return sizes.select("source", "chars", share.alias("share"), rate.alias("rate"))


def poisson_mix(docs: DataFrame, seed: int = 1, weights: Mapping[str, float] | None = None, total_share: float = 1.0, rate_most: float | None = None) -> DataFrame:
    """``docs`` with each row repeated by its count, plus copy, rate and shuffle_key.

    A null source is a source of its own, the empty name. Null texts have no characters. Rows of one doc_id get
    one count, null ids too; the copies of repeated rows have equal keys. Copies are numbered from 0,
    those of slice i of a large rate from 64 i. ``rate_most`` cuts rates on request; without it every
    source gets its whole weight, however small it is. An empty table gives an empty result.
    """
    source, rate, slices, cdf, block, slice_, copy, key = fresh(docs, "mix_source", "mix_rate", "mix_slices", "mix_cdf", "mix_block", "mix_slice", "copy", "shuffle_key")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(SLICE)).cast("long"))
    rates = source_rates(docs, weights, total_share, rate_most).select(
        F.col("source").alias(source), F.col("rate").alias(rate), parts.alias(slices), poisson_limits(F.col("rate") / parts).alias(cdf)
    )
    rates = written(rates, "rates")
    rows = docs.withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit(""))).join(rates, source)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{slices}` - 1) div {BLOCK}")))
    rows = rows.withColumn(block, blocks)
    if not rates.filter(F.col(slices) > BLOCK).isEmpty():
        rows = rows.repartition(F.xxhash64(ident, F.col(block)))
    last = F.least(F.col(slices), (F.col(block) + 1) * BLOCK) - 1
    rows = rows.withColumn(slice_, F.explode(F.sequence(F.col(block) * BLOCK, last)))
    at = F.when(F.col(slice_) == 0, uniform(F.lit(str(seed)), ident)).otherwise(uniform(F.lit(str(seed)), ident, F.col(slice_).cast("string")))
    count = F.size(F.filter(cdf, lambda p: p <= at))
    numbers = F.when(count > 0, F.sequence(F.col(slice_) * MOST, F.col(slice_) * MOST + count - 1))
    copies = rows.withColumn(copy, F.explode(numbers))
    keyed = copies.withColumn(key, uniform(F.lit(f"{seed} order"), ident, F.col(copy).cast("string")))
    return keyed.select(*docs.columns, F.col(copy).alias(copy), F.col(rate).alias("rate") if "rate" not in docs.columns else F.col(rate), key).repartition(F.col(key)).sortWithinPartitions(key)
