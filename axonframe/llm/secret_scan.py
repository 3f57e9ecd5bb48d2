"""Secret scans over an incremental blob ledger.

Every historical version of a path is addressed by its content, sha256 of the text. The ledger,
a folder in the shared store, knows which (blob, rule version) pairs were scanned and what was
found. A scan reads one copy of each blob with an unseen pair, appends pairs and findings, and
joins all findings back to all paths. A rule whose pattern changes gets a new version: only its
pairs are unseen.

Only DataFrame functions are used. Matches and the texts between them have known lengths, so the
places follow by a running sum per blob and rule, in code points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonframe.llm.common import fresh, shared_dir, whole_text


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; else the match is dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def plain(self) -> str:
        """The pattern for engines without possessive loops, with the same matches."""
        return self.pattern.replace("*+", "*").replace(")++", ")+")


# The rules, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", 1, r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: What parts the lines of a key, and a line: a header of an encrypted key, or base64 of 16 characters or more.
PEM_GAP = r"(?:[\x20\x09-\x0D]|\\[nr])++"
PEM_LINE = PEM_GAP + r"(?:(?:Proc-Type|DEK-Info):[^\n]*+|" + "[A-Za-z0-9+/=]" * 16 + "[A-Za-z0-9+/=]*+)"
ADDED = (
    # To the END line over text without a double hyphen, else over the lines of the body and a padded last one.
    # Loops over groups are possessive: they take no stack, however long the key is, and lose no match.
    Rule("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-[^-])*+-----END [A-Z ]*PRIVATE KEY-----|(?:" + PEM_LINE + r")*+(?:" + PEM_GAP + r"[A-Za-z0-9+/]+={1,2})?)"),
    Rule("ghtoken", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED

PAIRS = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Ledger:
    """Scanned pairs and findings, appended under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        empty.write.mode("append").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def pairs(self) -> DataFrame:
        return self._read("pairs", PAIRS).distinct()

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def append(self, unseen: DataFrame, found: DataFrame) -> None:
        # Findings first: a scan that dies between the two is done again, not lost.
        found.write.mode("append").parquet(f"{self.path}/findings")
        unseen.write.mode("append").parquet(f"{self.path}/pairs")


def matches(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings in ``blobs(blob, text, unseen)``, of the rules whose kinds are in ``unseen``."""
    scans = []
    for rule in rules:
        found = lambda group, rule=rule: F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group))
        wanted = F.array_contains("unseen", rule.kind) & F.col("text").rlike(rule.pattern)
        scans.append(F.when(wanted, F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"),
            F.transform(found(0), F.char_length).alias("lengths"),
            F.transform(found(rule.group), F.char_length).alias("measured"),
            F.transform(F.split("text", rule.pattern, -1), F.char_length).alias("gaps"),
        )))
    hits = blobs.select("blob", F.inline(F.array_compact(F.array(*scans))))
    one = F.transform("lengths", lambda n, i: F.struct(
        n.alias("length"), F.element_at("measured", i + 1).alias("measured"), F.element_at("gaps", i + 1).alias("gap")
    ))
    each = hits.select("blob", "kind", "version", "least", F.posexplode(one).alias("n", "m"))
    run = Window.partitionBy("blob", "kind").orderBy("n")
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(run)
    placed = each.select("*", end.cast("long").alias("end")).filter("m.measured >= least")
    return placed.select("blob", "kind", "version", (F.col("end") - F.col("m.length")).cast("long").alias("start"), "end")


def scan(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger has not seen of ``versions(blob, text)``; all findings of these rules.

    One copy of a blob is scanned; copies fold before they move.
    """
    name = F.concat_ws(":", "kind", "version")
    seen = ledger.pairs().groupBy("blob").agg(F.collect_set(name).alias("seen"))
    known = F.coalesce("seen", F.array().cast("array<string>"))
    all_kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    new = F.filter(all_kinds, lambda r: ~F.array_contains(known, F.concat_ws(":", r["kind"], r["version"])))
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    todo = blobs.join(seen, "blob", "left").withColumn("new", new).filter(F.size("new") > 0)
    texts = todo.select("blob", "text", F.transform("new", lambda r: r["kind"]).alias("unseen"))
    ledger.append(todo.select("blob", F.inline("new")), matches(texts, rules))
    return ledger.findings().filter(name.isin([f"{r.kind}:{r.version}" for r in rules]))


def spans_by_blob(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob and ``found``: spans by start, then rule, each with the end of all before it."""
    rank = F.coalesce(*[F.when(F.col("kind") == r.kind, i) for i, r in enumerate(rules)])
    ahead = Window.partitionBy("blob").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("rank", rank).withColumn("before", F.coalesce(F.max("end").over(ahead), F.lit(0)))
    return ranked.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "before"))).alias("found"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, shared_dir(spark, "blob-ledger"))


def find_secrets(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Null and empty texts have no spans. Rows stand each for itself, those of equal or null ids
    too; further columns are not read. An empty table gives an empty result.
    """
    text = whole_text(F.col("text").cast("string"))
    versions = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), blob_of(text).alias("blob"))
    per_blob = spans_by_blob(scan(versions, ledger, rules), rules)
    rows = versions.select("doc_id", "blob").join(per_blob, "blob", "left")
    of = lambda kind: F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return rows.withColumn("found", F.coalesce("found", F.array().cast(per_blob.schema["found"].dataType))).select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """The table with every secret in ``text`` replaced by ``mark``; texts without one stay, null too.

    ``n_chars``, where there is one, becomes the new length of the texts that change.
    """
    blob, found = fresh(docs, "blob", "found")
    text = whole_text(F.col("text").cast("string"))
    versions = docs.select(text.alias("text"), blob_of(text).alias("blob"))
    per_blob = spans_by_blob(scan(versions, ledger, rules), rules).select(F.col("blob").alias(blob), F.col("found").alias(found))
    rows = docs.withColumn(blob, blob_of(text)).join(per_blob, blob, "left")
    # The text between what came before and a span, then the mark; an overlapping span adds none.
    piece = lambda s: F.when(
        (s["start"] > s["before"]) | (s["before"] == 0),
        F.concat(F.substring(F.col("text"), s["before"].cast("int") + 1, (s["start"] - s["before"]).cast("int")), F.lit(mark)),
    ).otherwise("")
    last = F.array_max(F.transform(found, lambda s: s["end"])).cast("int")
    clean = F.concat(F.array_join(F.transform(found, piece), ""), F.substring(F.col("text"), last + 1, F.char_length("text")))
    changed = F.col(found).isNotNull()
    if "n_chars" in docs.columns:
        length = F.when(changed, F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", length)
    return rows.withColumn("text", F.when(changed, clean).otherwise(F.col("text"))).select(docs.columns)
