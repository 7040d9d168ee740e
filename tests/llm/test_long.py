"""Texts of 150,000 words and a conversation of 5,000 turns go through every operator whole."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm import chat, fingerprints, language, neardup, packing, pieces, quality, substrings, token_counts, toxicity, vocab
from tests.llm.conftest import words
from tests.llm.test_duplicates import groups, removed
from tests.llm.test_native import digest, marks


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(12)
    passage = words(rng, 400)
    first, second = words(rng, 150_000), words(rng, 150_000)
    first[90_000:90_400] = passage
    second[140_000:140_400] = passage
    return [(1, " ".join(first)), (2, " ".join(second)), (3, "y" * 1_000_000), (4, "short one"), (5, " ".join(first[:-3] + ["other", "last", "words"]))]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame(long_texts, "doc_id long, text string")


def test_duplicates(long_docs, long_texts):
    for n, kept in ((2, {1, 3, 4}), (5, {1, 2, 3, 4})):  # few words: nearly all pairs of them are in both texts
        got = Counter(tuple(r) for r in neardup.near_duplicates(long_docs, n=n).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == groups(long_texts, n) and {r[0] for r in got if r[3]} == kept
    rows = substrings.deduplicate(long_docs, with_text=False).collect()
    assert {tuple(r) for r in rows} == set(removed(long_texts))


def test_tokens(long_docs, long_texts, vocabulary):
    model = pieces.Model(vocabulary("piece_bpe_32k.model")).library
    assert {r.doc_id: r.n_tokens for r in pieces.encode(long_docs, vocabulary("piece_bpe_32k.model"), arrays=False).collect()} == {i: len(model.encode(t)) for i, t in long_texts}
    library = vocab.load(vocabulary("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(long_docs, vocabulary("byte_bpe_50k.json")).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in long_texts}
    library = vocab.load(vocabulary("word_bpe_49k.json"))
    packed = packing.pack(long_docs, vocabulary("word_bpe_49k.json"), with_ids=False, max_open=3)
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in long_texts}


def test_rules_and_marks(long_docs, long_texts):
    got = {r.doc_id: r for r in quality.apply(long_docs).collect()}
    assert all(got[i].n_words == len(t.split()) and got[i].word_chars == sum(map(len, t.split())) for i, t in long_texts)
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(long_docs).collect()} == {i: digest(marks(t)) for i, t in long_texts}


def test_learned(spark, long_docs, long_texts):
    model = language.fit(long_docs.withColumn("lang", F.lit("xx")))
    assert {r.doc_id: r.lang_pred for r in language.predict(long_docs, model).collect()} == {i: "xx" for i, _ in long_texts}
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(long_docs, toxicity.fit(long_docs, labels)).collect()}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values())


def test_conversation(spark):
    turns = [(c, k, "user" if k % 2 == 0 else "assistant", f"said {k} " + "word " * 20) for c, n in ((1, 5_000), (2, 4_999), (3, 10)) for k in range(n)]
    (row,) = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert (row.conv_id, row.n_turns, row.n_copies) == (1, 5_000, 1) and row.rendered.count("<|im_start|>") == 5_000
