"""One very long text among short ones, and columns named like those that the operators make."""

import pytest

import corpus_pipeline
from ridgelog.llm.chat import format_conversations
from ridgelog.llm.decontam import clean_documents, contamination
from ridgelog.llm.extract import extract_main_text
from ridgelog.llm.licenses import scan_licenses, template_table
from ridgelog.llm.pii import personal_data
from ridgelog.llm.quality import RuleModel, accepted, judge_quality
from ridgelog.llm.queries import MODEL_PATH
from ridgelog.llm.shards import shard_documents
from ridgelog.llm.simhash import near_duplicates, one_of_each
from ridgelog.llm.sptok import encode, read_model

WORDS = 200_000
LONG = " ".join(f"w{i % 9973}" for i in range(WORDS - 13)) + " Released under the MIT License. mail me@example.org one two three four five six"
ITEM = "one two three four five six"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "x", 1), (2, "short text", "x", 2), (3, LONG, "x", 3)]
    names = "doc_id long, text string, _id string, n_chars long"
    return spark.createDataFrame(rows, names).selectExpr("*", "'a' AS bits", "'b' AS root", "'c' AS word", "'d' AS _text_key", "'e' AS kept", "'f' AS component_id").cache()


def test_long_text_near_duplicates(docs):
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    kept = one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and kept.columns == docs.columns


def test_long_text_decontamination(spark, docs):
    items = spark.createDataFrame([(7, ITEM, "x")], "item_id long, text string, words string")
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in contamination(docs, items).collect()) == [(1, WORDS + 2, 6), (2, 2, 0), (3, WORDS + 2, 6)]
    clean = clean_documents(docs, items)
    assert [r["doc_id"] for r in clean.collect()] == [2] and clean.columns == docs.columns


def test_long_text_licenses(spark, docs):
    found = scan_licenses(docs, template_table(spark)).collect()
    assert sorted((r["doc_id"], r["license"], r["containment"]) for r in found) == [(1, "MIT", 1.0), (3, "MIT", 1.0)]


def test_long_text_shards(docs):
    assert {r["doc_id"]: (r["shard"], r["slot"], r["size"]) for r in shard_documents(docs, 2).collect()} == {1: (0, 0, len(LONG) + 1), 3: (0, 1, len(LONG) + 1), 2: (1, 0, 11)}


def test_long_text_rules_and_spans(docs):
    model = RuleModel(None, 1.0)
    assert {r["doc_id"]: (r["n_words"], r["kept"]) for r in judge_quality(docs, model).collect()} == {1: (WORDS, False), 2: (2, False), 3: (WORDS, False)}
    assert accepted(docs, model).columns == docs.columns
    at = LONG.index("me@")
    assert {r["spans"] for r in personal_data(docs).collect()} == {f"email:{at}:{at + 14}", ""}


def test_long_text_tokens(docs):
    rows = {r["doc_id"]: r for r in encode(docs, read_model(MODEL_PATH)).collect()}
    assert all(r["exact"] for r in rows.values()) and rows[1]["ids"] == rows[3]["ids"] and rows[1]["n_ids"] > WORDS


def test_long_pages_and_messages(spark):
    pages = spark.createDataFrame([(1, "u", f"<nav>{LONG}</nav><article><p>{LONG}</p></article>", "x")], "page_id long, url string, html string, n_chars string")
    assert extract_main_text(pages).first()["text"] == LONG
    messages = [(1, 0, "user", "\n".join(LONG.split())), (1, 1, "user", "\n".join("> " + w for w in LONG.split()[:5000]) + "\nyes")]
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    reply = format_conversations(frame).where("turn = 1").first()
    assert (reply["own"], reply["reply_to"], reply["n_quoted"], reply["n_linked"]) == ("yes", 0, 5000, 5000)


def test_stages_keep_every_column(spark, docs):
    """All stages but the last return the columns they got, whatever their names."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
    assert "doc_id" in corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").columns
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
