"""Language identification and toxicity: held-out accuracy, the awkward table, and the models themselves."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import language, queries, toxicity
from emberlog.llm.text import blocks


@pytest.fixture(scope="module")
def medium():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


def test_language_held_out(spark, medium):
    got = queries.op7_language_id(spark, medium).toPandas()
    docs = queries.table(spark, medium, "documents").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    test = docs[docs.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.97
    assert docs.rejected.mean() < 0.01 and got.score.between(0, 1).all() and len(got) == len(docs)


def test_language_probabilities_add_up():
    """Interpolated probabilities of all characters after a context sum to one, unknown ones included."""
    words = ["abba", "abab", "baab", "cab"]
    grams, word = language.grams_of(words)
    rows, counts = np.unique(grams, axis=0, return_counts=True)
    model = language.estimate(np.array(["x"] * len(rows), object), rows, counts)
    keys, p = model.grams[0]
    characters = [language.END, *map(ord, "abc")]
    for context in ([2, 2, 2], [2, 2, 97], [2, 97, 98], [98, 98, 97], [122, 122, 122]):
        total = 0.0
        for c in [*characters, 0x7A]:  # the last stands for all unknown ones
            score = float(p[keys == language.keys_of(np.array([[c]]))][0, 0]) if c != 0x7A else float(model.unknown[0])
            for n in range(2, 5):
                k, w = model.contexts[n - 2]
                hit = k == language.keys_of(np.array([context[4 - n :]]))
                score += float(w[hit][0, 0]) if hit.any() else 0
                k, w = model.grams[n - 1]
                hit = k == language.keys_of(np.array([[*context[4 - n :], c]]))
                if hit.any():
                    score = float(w[hit][0, 0])
            total += np.exp(score)
        assert total == pytest.approx(1, abs=1e-5)
    assert word.tolist() == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4


def test_language_equals_a_plain_model():
    """Counts, discounts, continuation counts and log probabilities against a plain interpolated Kneser-Ney model for each language."""
    import math
    from collections import Counter, defaultdict

    texts = {"x": "abba abab baab cab abba cc", "y": "bad dab add bad a abba dad da"}
    counts = {lang: Counter(tuple(g) for g in language.grams_of(t.split())[0].tolist()) for lang, t in texts.items()}
    lang = np.array([x for x in counts for _ in counts[x]], object)
    grams = np.array([g for x in counts for g in counts[x]])
    model = language.estimate(lang, grams, np.array([n for x in counts for n in counts[x].values()]))
    alphabet = len({g[-1] for x in counts for g in counts[x]}) + 1

    def plain(four):
        level = {4: four}
        for n in (3, 2, 1):
            level[n] = Counter(g[1:] for g in level[n + 1])
        discount, total, kinds = {}, defaultdict(int), defaultdict(int)
        for n, c in level.items():
            n1, n2 = (sum(1 for v in c.values() if v == k) for k in (1, 2))
            discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for g, v in c.items():
                total[n, g[:-1]] += v
                kinds[n, g[:-1]] += 1

        def p(g):
            n, context = len(g), g[:-1]
            if not n:
                return 1 / alphabet
            if not total[n, context]:
                return p(g[1:])
            return max(level[n][g] - discount[n], 0) / total[n, context] + discount[n] * kinds[n, context] / total[n, context] * p(g[1:])

        return p

    words = ["abba", "dab", "cad", "a", "zab", "bcd"]
    score, n = model.scores(words)
    for k, word in enumerate(words):
        assert n[k] == len(word) + 1
        own = language.grams_of([word])[0].tolist()
        for j, x in enumerate(model.languages):
            p = plain(counts[x])
            assert score[k, j] == pytest.approx(sum(math.log(p(tuple(g))) for g in own), abs=1e-4)


def test_planted_noise_goes_and_clean_text_stays(spark, medium):
    """Letters drawn at random, texts with their letters shuffled, and words of another language, among all documents."""
    docs = queries.table(spark, medium, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    rng = np.random.default_rng(6)
    clean = [r.text for r in docs.where("length(text) between 300 and 3000 and lang = 'en'").limit(100).collect()]

    def shuffled(t):
        letters = [c for c in t if c.isalpha()]
        rng.shuffle(letters)
        left = iter(letters)
        return "".join(next(left) if c.isalpha() else c for c in t)

    parts = ["kuu", "jyv", "saa", "pöyt", "lintu", "hyvä", "ystäv", "ikkun"], ["ssa", "lla", "kkään", "ttömyys", "iin", "sta"]
    kinds = {
        "random": [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(60)) for _ in range(100)],
        "shuffled": [shuffled(t) for t in clean],
        "other": [" ".join(rng.choice(parts[0]) + rng.choice(parts[1]) for _ in range(60)) for _ in range(100)],
    }
    rows = [(k, kind, t) for k, (kind, t) in enumerate((kind, t) for kind, all_ in kinds.items() for t in all_)]
    gone = {r.kind: r.share for r in language.predict(spark.createDataFrame(rows, "doc_id long, kind string, text string"), model, keep=["kind"]).groupBy("kind").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert all(share > 0.9 for share in gone.values()), gone
    assert language.predict(docs, model).where("not rejected").count() > 0.98 * docs.count()


def test_language_edges(spark, awkward, empty, texts):
    model = language.fit(awkward)
    got = language.predict(awkward, model, keep=["score", "row"])
    assert got.columns == ["doc_id", "lang_pred", "score", "cross_entropy", "rejected", "score", "row"]
    rows = got.toDF("doc_id", "lang_pred", "s", "ce", "rejected", "score", "row").collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    no_letter = [i for i, t in texts if not any(map(str.isalpha, t or "")) and i is not None]
    assert no_letter and all(by[i].lang_pred == "und" and by[i].s == 0 and by[i].rejected for i in no_letter)
    assert all(r.lang_pred == "en" for r in rows if r.doc_id is not None and r.doc_id not in no_letter)
    nothing = language.fit(empty)
    assert nothing.languages == [] and language.predict(awkward, nothing).where("lang_pred <> 'und'").count() == 0
    assert language.predict(empty, model).count() == 0


def test_language_model_holds_all_grams(spark):
    """A language among very many, of which most 4-grams are seen once, keeps them all."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(3)
    rare = ["".join(rng.choice(list(letters), 6)) for _ in range(600)]
    rows = [("x", " ".join(rare))] + [(f"l{k}", "ab") for k in range(600)]
    docs = spark.createDataFrame([(1, t, x) for x, t in rows], "doc_id long, text string, lang string")
    model = language.fit(docs)
    grams, _ = language.grams_of([*rare, "ab"])
    assert len(model.languages) == 601 and np.isin(language.keys_of(grams), model.grams[-1][0]).all()
    assert len(model.grams[-1][0]) == len(np.unique(grams, axis=0)) > 1_000_000 // 601


def test_noise_is_rejected(spark, medium):
    docs = queries.table(spark, medium, "documents")
    model = language.fit(docs)
    noise = spark.createDataFrame([(1, "xq zvkw qqx jzx wvq kkz " * 20), (2, "the of and to in is that " * 5)], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in language.predict(noise, model).collect()}
    assert got == {1: True, 2: False}


def test_noise_is_rejected_beside_many_characters(spark, medium):
    """A language of a few thousand characters doesn't loosen the limits of the others."""
    docs = queries.table(spark, medium, "documents").select("doc_id", "text", "lang")
    han = [(10**9 + 5 * k, " ".join(chr(0x4E00 + (k * 97 + j * 31) % 5000) * 2 for j in range(60)), "zh") for k in range(150)]
    model = language.fit(docs.unionByName(spark.createDataFrame(han, docs.schema)))
    rng = np.random.default_rng(4)
    noise = [(k, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60))) for k in range(5)]
    assert all(r.rejected for r in language.predict(spark.createDataFrame(noise, "doc_id long, text string"), model).collect())
    assert language.predict(docs, model).where("rejected").count() < 0.01 * docs.count()


def test_toxicity_held_out(spark):
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    got = queries.op9_toxicity(spark, path).toPandas()
    both = queries.table(spark, path, "labels").toPandas().merge(got, on="doc_id")
    test = both[both.held_out]
    hit = ((test.toxic == 1) & (test.predicted == 1)).sum()
    assert hit / (test.predicted == 1).sum() > 0.9 and hit / (test.toxic == 1).sum() > 0.8
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_swaps_lower_the_weight_of_groups():
    """A term that goes with the label in training only by chance loses weight when swapping it may not change a score."""
    rng = np.random.default_rng(1)
    h = {w: toxicity.word_hash(w) for w in ["vile", "women", "men", *(f"w{k}" for k in range(50))]}
    texts, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        own = {h[f"w{i}"] for i in rng.integers(0, 50, 8)}
        if bad and rng.random() < 0.7:
            own.add(h["vile"])
        if rng.random() < (0.8 if bad else 0.1):
            own.add(h["women"])
        texts.append(np.array(sorted(own), np.uint64))
        labels.append(float(bad))
    swap = [(np.array([h["women"]], np.uint64), np.array([h["men"]], np.uint64))] * 200
    plain, fair = (toxicity.train(texts, np.array(labels), s) for s in ([], swap))

    def weight(model, word):
        at = np.flatnonzero(model.hashes == np.uint64(h[word]))
        return float(model.weights[at[0]]) if len(at) else 0.0

    assert weight(plain, "women") > 0.5 and abs(weight(fair, "women")) < 0.3 * weight(plain, "women")
    assert weight(fair, "vile") > 0.5


def test_swapped_terms():
    groups = [line.split() for line in toxicity.IDENTITY_TERMS]
    assert toxicity.swapped("Women vote. He sings.", groups) == [("women", "men"), ("women", "girls"), ("women", "boys")]
    found = toxicity.swapped("Women vote. He sings.\nA gay man", groups)
    assert found[3:] == [("gay", "lesbian"), ("gay", "straight"), ("gay", "bisexual"), ("gay", "transgender"), ("man", "woman"), ("man", "girl"), ("man", "boy")]
    # a sentence that has the other term already only loses one
    assert toxicity.swapped("a male and a FEMALE", groups) == [("female", ""), ("male", "")]
    assert toxicity.swapped("a male", []) == [] and toxicity.swapped("", groups) == []


def test_neutral_mentions_of_groups(spark):
    """Where a term goes with the label in training, the penalty lowers the gap of swapped sentences and the false positives on neutral mentions."""
    rng = np.random.default_rng(2)
    rows, labels, at = [], [], 0
    while len(rows) < 600:
        at += 1
        if zlib.crc32(str(at).encode()) % 5 == 0:
            continue
        bad = len(rows) % 4 == 0
        own = [f"w{chr(97 + i)}" for i in rng.integers(0, 20, 8)] + ["vile"] * (bad and rng.random() < 0.6) + (["muslims"] if rng.random() < (0.7 if bad else 0.02) else ["hindus"] if rng.random() < 0.3 else [])
        rng.shuffle(own)
        rows.append((at, " ".join(own) + "."))
        labels.append((at, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = toxicity.gaps(toxicity.fit(docs, known, identity_terms=()), toxicity.neutral())
    fair_model = toxicity.fit(docs, known)
    fair = toxicity.gaps(fair_model, toxicity.neutral())
    assert fair["largest"] < 0.5 * plain["largest"] and fair["toxic"] <= plain["toxic"]
    assert plain["toxic"] > 0 and fair["toxic"] == 0
    (block,) = blocks(__import__("pyarrow").array(["you vile one"]))
    assert fair_model.logits(block)[0] > 0


def test_toxicity_edges(spark, awkward, empty, texts):
    labels = spark.createDataFrame([(0, 0), (3, 1), (6, None), (None, 1), (9999, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    got = toxicity.score(awkward, model, keep=["row"]).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        none = toxicity.fit(awkward, some)
        assert toxicity.score(awkward, none).where("predicted = 1").count() == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, labels) is not None


def test_words_are_letters_in_lower_case():
    import pyarrow as pa

    (block,) = blocks(pa.array(["Idiot! idiot, x1y", ""]))
    h, first = toxicity.distinct_words(block)
    assert first.tolist() == [0, 3, 3] and np.uint64(toxicity.word_hash("idiot")) in h
