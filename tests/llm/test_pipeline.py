"""The stages after one another against plain Python, each on its own input."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from axonframe.llm import jaccard_join
from axonframe.llm.common import written
from test_jaccard_join import plain_components
from test_mixing import plain_count
from test_secrets import plain


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = "this note tells where the old house stands and password=abcdefgh12 opens its door for all"
    extra = [(10**6 + i, f"{text} {i}", "en", "src1", len(text) + 2) for i in (0, 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = rows_of(docs.select("doc_id", "text", "source"))
        docs = written(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            inputs[f"after {name}"] = rows_of(docs.select("doc_id", "text", "source"))
    # Toxicity: labelled clean documents stay, most toxic ones go.
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r[0] for r in inputs["after toxicity"]}
    assert len({d for d, t in toxic.items() if not t} - kept) <= 2
    # Near copies: one of each component, the smallest.
    pairs = [(d, t) for d, t, _ in inputs["ngram_jaccard_join"]]
    want = {d for d, _, c in plain_components(pairs, jaccard_join.JoinParams()) if d == c}
    assert {r[0] for r in inputs["after ngram_jaccard_join"]} == want and len(want) < len(pairs)
    # Secrets: the same documents, none left to find but in the mark itself.
    before, after = dict(r[:2] for r in inputs["secret_scan"]), dict(r[:2] for r in inputs["after secret_scan"])
    assert before.keys() == after.keys() and any(plain(t) for t in before.values()) and not any(plain(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not plain(t))
    # Mixture: Poisson counts by plain Python.
    size = Counter()
    for _, t, s in inputs["source_mixture"]:
        size[s] += len(t)
    total = sum(size.values())
    counts = {d: n for d, t, s in inputs["source_mixture"] if (n := plain_count(1, d, 1 / len(size) * total / size[s]))}
    assert Counter(r[0] for r in inputs["after source_mixture"]) == counts
    # Packing: every token of every copy, in sequences of at most 2048.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = docs.collect()
    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {d: n * (len(tokenizer.encode(after[d], add_special_tokens=False).ids) + 1) for d, n in counts.items()}
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "source_mixture", "best_fit_packing"]
