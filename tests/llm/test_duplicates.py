"""Substring and near-duplicate removal against plain versions."""

import hashlib
import importlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from emberlog.llm import neardup, shared, substrings
from emberlog.llm.components import components
from emberlog.llm.filters import IdFilter, id_filter
from emberlog.llm.fmindex import Bits, Index, Wavelet
from emberlog.llm.shingles import shingle_sets
from emberlog.llm.text import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] * bool(w))


def groups(rows, n):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def test_near_duplicates(awkward, texts):
    for n in (2, 5):
        got = Counter(tuple(r) for r in neardup.near_duplicates(awkward, n=n).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == groups(texts, n)


def test_an_id_with_several_texts(spark):
    """Each text of an id is linked by its own words, and links to any of them count for the id."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(3)]
    a, b, c = (" ".join(x) for x in texts)
    near_a, near_b, near_c = (" ".join([*x[:-1], "changed"]) for x in texts)
    rows = [(5, a), (5, b), (9, near_b), (7, near_a), (6, c), (5, near_c), (8, c), (20, a), (21, "alone")]
    for data in (rows, rows[::-1]):
        docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
        got = Counter(tuple(r) for r in neardup.near_duplicates(docs, n=2).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == groups(data, 2)
        assert {r[0] for r in got if r[3]} == {5, 21}


def test_large_groups_in_rounds(spark, monkeypatch):
    """Posting lists and clusters beyond one task give the same groups: near copies, chains of them, and texts that are alike but not linked."""
    monkeypatch.setattr(neardup, "GROUP", 8)
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    data = []
    for changes in (9, 16):
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(changes)):
                own[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
            data.append((len(data), " ".join(own)))
    chain = [f"c{k}" for k in range(80)]
    for k in range(25):
        chain[k * 3 : k * 3 + 3] = [f"d{k}a", f"d{k}b", f"d{k}c"]
        data.append((len(data), " ".join(chain)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter(tuple(r) for r in neardup.near_duplicates(df, n=2).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == groups(data, 2)
    assert 3 < sum(r[3] for r in got) < 50


def test_rounds_write_few_files(spark, dealt_wide, monkeypatch):
    """What a round writes of a large group's rows and trees is in few files, whatever the shuffles are dealt over."""
    monkeypatch.setattr(neardup, "GROUP", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    data = []
    for _ in range(90):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        data.append((len(data), " ".join(own)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter(tuple(r) for r in neardup.near_duplicates(df, n=2).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == groups(data, 2)
    rounds = [n for columns, n in dealt_wide if "done" in columns]
    assert len(rounds) > 2 and max(rounds) <= 8


def test_no_documents(empty):
    assert neardup.near_duplicates(empty).count() == 0
    assert substrings.deduplicate(empty).count() == 0


def test_matches_needed():
    assert neardup.matches_needed(0.8, 64) == 36
    assert neardup.matches_needed(0.0, 8) == 1


def test_forest_is_spanning():
    rng = np.random.default_rng(4)
    for n in (1, 2, 40):
        near = rng.random((n, n)) < 0.05
        near |= near.T
        parent = list(range(n))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        edges = neardup.forest(n, lambda k, some, near=near: near[k, some])
        for a, b in edges:
            assert near[a, b]
            parent[root(a)] = root(b)
        assert len(edges) == n - len({root(i) for i in range(n)})
        assert all(root(i) == root(j) for i in range(n) for j in range(n) if near[i, j])


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 30)] + [(100, 101), (101, 100), (5, 5), (50, 40), (50, 45)] + [(200, 200 + k) for k in range(1, 40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 10 for k in range(10, 31)) and got[101] == 100 and got[45] == got[50] == 40 and got[239] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark):
    edges = [(500, k) for k in range(501, 560)] + [(k, 700) for k in range(600, 650)] + [(559, 650), (650, 649), (1, 2)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.pop(1) == got.pop(2) == 1 and set(got.values()) == {500} and len(got) == 60 + 51 + 1


def plain_components(edges):
    least = {x: x for e in edges for x in e}
    while True:
        new = {x: min([least[x], *[least[b if a == x else a] for a, b in edges if x in (a, b)]]) for x in least}
        if new == least:
            return least
        least = new


def test_few_edges_are_one_task(spark, dealt_wide):
    """A graph of some hundred edges takes fewer tasks than one shuffle has, and leaves few files."""
    rng = random.Random(11)
    edges = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(300)) if a != b]
    df, _ = shared.written(spark.createDataFrame(edges, "a long, b long").repartition(32))
    del dealt_wide[:]
    sc = spark.sparkContext
    sc.setJobGroup("few edges", "")
    try:
        got = {r.id: r.component for r in components(df).collect()}
        tracker = sc.statusTracker()
        tasks = sum(tracker.getStageInfo(k).numCompletedTasks for j in tracker.getJobIdsForGroup("few edges") for k in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(k))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_components(edges)
    assert tasks < 64
    assert dealt_wide and max(n for _, n in dealt_wide) <= 8


def test_components_of_any_size(spark, monkeypatch):
    """Beyond what one task takes the stars give the same, at every bound."""
    module = importlib.import_module("emberlog.llm.components")
    rng = random.Random(12)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 120)] + [(7, 7)]
    want = plain_components([e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges, "a long, b long")
    for bound in (0, 30, 10**6):
        monkeypatch.setattr(module, "WHOLE", bound)
        assert {r.id: r.component for r in components(df).collect()} == want


def test_edges_are_contracted(monkeypatch):
    """What a task makes of its edges has the same components, whatever it holds at once; a hub of many repeated edges is one star."""
    module = importlib.import_module("emberlog.llm.components")
    rng = random.Random(13)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, 200 + k % 20) for k in range(1, 200) if k % 20]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    want = plain_components(edges)
    for bound in (1, 10, 50, 10**6):
        monkeypatch.setattr(module, "WHOLE", bound)
        batches = [pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in edges[k : k + 16]]) for k in range(0, len(edges), 16)]
        out = [(r["u"], r["v"]) for b in module.contracted(iter(batches)) for r in b.to_pylist()]
        assert plain_components(out) == want
    assert len(out) == len(want) - len(set(want.values()))


def test_id_filter(spark):
    keep = id_filter(spark.range(0, 1000, 3))
    assert isinstance(keep, IdFilter) and keep(np.arange(0, 1000, 3)).all()
    assert keep(np.arange(10**6, 10**6 + 1000)).mean() < 0.3


def test_shingles_of_blocks(texts):
    every = [t or "" for _, t in texts]
    for block in blocks(pa.array(every), 3000):
        for n in (1, 2, 5):
            _, first = shingle_sets(block, n)
            assert np.diff(first).tolist() == [len(shingles(every[k], n)) for k in block.rows]


def test_bits_and_wavelet():
    rng = np.random.default_rng(6)
    bits = rng.random(1000) < 0.4
    at = np.arange(1001)
    assert (Bits(bits).rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    symbols = rng.integers(0, 37, 700)
    wavelet = Wavelet(symbols, 37)
    for c in (0, 5, 36):
        assert (wavelet.rank(np.full(701, c), np.arange(701)) == np.concatenate([[0], np.cumsum(symbols == c)])).all()


def test_backward_search():
    rng = np.random.default_rng(7)
    text = np.append(rng.integers(1, 4, 499), 0)  # a zero ends the last segment
    values = rng.integers(0, 1000, 500)
    index = Index(text, 4, values)
    for length in (1, 3, 13):
        ends = np.arange(length - 1, 499)
        alive, low, high = index.matching(text, ends, length)
        counts = Counter(tuple(text[e - length + 1 : e + 1]) for e in ends)
        own = {int(a): int(h - x) for a, x, h in zip(alive, low, high, strict=True)}
        for k, e in enumerate(ends):
            n = counts[tuple(text[e - length + 1 : e + 1])]
            assert own.get(k, 1) == n
        least = index.least_of(low, high)
        for a, v in zip(alive, least, strict=True):
            run = tuple(text[ends[a] - length + 1 : ends[a] + 1])
            assert v == min(values[e - length + 1] for e in ends if tuple(text[e - length + 1 : e + 1]) == run)


def removed(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                run = tuple(w[k : k + 13])
                first[run] = min(i, first.get(run, i))
    out = Counter()
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substrings(awkward, texts):
    rows = substrings.deduplicate(awkward, keep=["row", "low"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removed(texts)
    whole = dict(texts)
    for r in rows:
        assert r.row == "y" and r.low == 0.5
        if r.n_removed == 0 and r.doc_id != 7 and r.doc_id is not None:
            assert r.text == whole[r.doc_id]
        elif r.n_removed:
            assert hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() == r.kept_sha256


def test_beyond_the_filters(spark, awkward, texts, monkeypatch):
    """With more repeated anchors than a filter may hold they are joined, with the same result."""
    monkeypatch.setattr(substrings, "MAX_FILTERED", 0)
    rows = substrings.deduplicate(awkward, with_text=False).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removed(texts)


def test_hot_anchors(spark, monkeypatch):
    """Runs of anchors in many documents are dealt out one by one, with the same result; so are small index blocks."""
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "INDEX_WORDS", 10)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(20)]
    data = [(i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(15)] + passage[: rng.randrange(10, 21)] + [f"y{rng.randrange(3)}" for _ in range(15)])) for i in range(40)]
    got = substrings.deduplicate(spark.createDataFrame(data, "doc_id long, text string"), with_text=False)
    assert Counter(tuple(r) for r in got.collect()) == removed(data)
