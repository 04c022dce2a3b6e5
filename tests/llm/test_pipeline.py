"""The pipeline against a plain version of every stage, each on its own input."""

import re

import pytest

import corpus_pipeline
from headmint.llm.queries import MODEL
from tests.llm.test_edges import components_of, documents, near_copies, plain_secrets

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, out[-1], small)
        out.append(spark.createDataFrame(df.collect(), df.schema))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_quality_keeps_clean_and_drops_marked(spark, small, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    right = [(i in kept) == bool(q) for i, q in label.items()]
    assert sum(right) / len(right) > 0.9


def test_one_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    label = components_of([t for _, t in rows])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == [rows[i][0] for i, _, c in label if c == i]


def test_contaminated_documents_go(spark, small, stages):
    words = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    sizes = {len(g) for g in grams}

    def hit(t):
        w = words(t)
        return any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))

    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, t in before.items() if not hit(t)}


def test_secrets_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        text, at, want = before[r["doc_id"]], 0, ""
        for a, b, _ in plain_secrets(text):
            if a > at or not want:
                want += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["text"] == (want + text[at:] if want else text) and r["n_chars"] == len(r["text"])


def test_tokens_equal_the_library(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = {r["doc_id"]: r["ids"] for r in stages[5].collect()}
    assert got == {i: library.encode(t) for i, t in text.items()}


def test_run_equals_the_stages(spark, small, stages):
    rows = lambda df: sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, small)) == rows(stages[-1])


def test_near_duplicates_on_planted_copies(spark):
    texts = near_copies(11, 6, 8)
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in components_of(texts) if c == i]
