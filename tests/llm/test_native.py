"""Chat formatting, quality rules and winnowing: SQL and plain Python, and plans without Python."""

import hashlib
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import chat, fingerprints, quality
from emberlog.llm.queries import ORACLE_SQL
from tests.oracle import norm


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    columns = sorted(df.columns)
    mine = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert mine == sorted(repr([norm(r[k]) for k in at]) for r in found.fetchall())


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def turns(*conversations):
    return [(i, k, role, text) for i, said in conversations for k, (role, text) in enumerate(said)]


def test_chat_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", None)
    data = turns((1, [a]), (2, [a, b]), (3, [a, b, c]), (4, [a, b, c]), (5, [b]), (6, [(None, "hi")]), (7, [("user", ""), b]), (8, [a, ("assistant", "no")]))
    data += [(9, 0, "user", "hi"), (9, 0, "user", "hi"), (None, 0, "user", "lone"), (None, None, None, None), (10, None, "user", "hi")]
    df = spark.createDataFrame([(*x, "n", "p", 1) for x in data], "conv_id long, turn long, role string, text string, n string, place string, a int")
    got = chat.format_chats(df)
    no_python(got)
    same(got, ORACLE_SQL["op1_chat_formatting"], conversations=df.select("conv_id", "turn", "role", "text"))
    kept = {r.conv_id: r for r in got.collect()}
    assert kept[3].n_copies == 2 and kept[3].rendered.endswith("<|im_start|>user\n<|im_end|>\n") and not {1, 2, 4} & set(kept)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality(awkward, empty):
    got = quality.apply(awkward)
    no_python(got)
    same(got, quality.oracle(), documents=awkward.select("doc_id", "text"))
    assert quality.apply(empty).count() == 0


def test_repeated_runs(spark):
    text = "a b c d a b c x a b c a b c"
    r = quality.apply(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_repeat_words == 12 and r.n_words == 14 and r.base_failed and not r.kept


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "the " + "word of length " * 40 + " ".join(f"w{k}" for k in range(200)))], "doc_id long, text string")
    assert quality.apply(df).first().kept
    assert not quality.apply(df, rules=(quality.Rule("word_length", least=9),)).first().kept
    with pytest.raises(KeyError):
        quality.compile_rules((quality.Rule("unknown", most=1),))


def spark_hash(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def rolled(words, k):
    """The hashes of runs of k words, each from the one before: turned by a bit, without the word that leaves, with the one that comes."""

    def turn(h, n):
        n %= 64
        return (h << n | h >> 64 - n) & (1 << 64) - 1

    own, out, h = [spark_hash(x) & (1 << 64) - 1 for x in words], [], 0
    for i, x in enumerate(own):
        h = turn(h, 1) ^ x ^ (turn(own[i - k], k) if i >= k else 0)
        if i >= k - 1:
            mixed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42)
            out.append(mixed - (1 << 64) if mixed >> 63 else mixed)
    return out


def marks(text, k=fingerprints.K, w=fingerprints.WINDOW):
    x = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = rolled(x, k) if len(x) >= k else [spark_hash(" ".join(x))] * bool(x)
    places = []
    for j in range(max(1, len(h) - w + 1) if h else 0):
        part = h[j : j + w]
        at = j + max(i for i, v in enumerate(part) if v == min(part))
        if not places or places[-1] != at:  # they never go back
            places.append(at)
    return [(h[p], p) for p in places]


def digest(m):
    return hashlib.sha256(" ".join(f"{h & (1 << 64) - 1:X}" for h, _ in m).encode()).hexdigest()


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a or b else 1.0


def test_winnowing(spark, awkward, texts):
    got = fingerprints.compare_edited(awkward)
    no_python(got)
    order = sorted(((i is not None, i or 0, t or "") for i, t in texts), reverse=True)
    want = []
    for n, (known, i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][2]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own = marks(t)
        want.append((i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(marks(edited)), round(likeness(own, marks(edited)), 9), round(likeness(own, marks(after)), 9)))
    mine = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_other_runs_and_windows(spark, texts):
    rows = [(k, t) for k, (_, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, text string")
    for k, w in ((1, 1), (3, 2), (5, 7)):
        got = {r.i: [(m.hash, m.position) for m in r.m] for r in df.select("i", fingerprints.winnow(F.col("text"), k, w).alias("m")).collect()}
        assert got == {i: marks(t or "", k, w) for i, t in rows}


def test_shared_runs_are_found(spark):
    """A shared run of WINDOW + K - 1 words always yields a common mark; positions are kept."""
    shared = "one two three four five"
    df = spark.createDataFrame([(1, f"a b c {shared} d e f g"), (2, f"x y {shared} z")], "doc_id long, text string")
    first, second = fingerprints.fingerprint(df).orderBy("doc_id").collect()
    both = {m.hash: m.position for m in first.marks}.keys() & {m.hash: m.position for m in second.marks}.keys()
    assert both
    at = {m.hash: m.position for m in first.marks}, {m.hash: m.position for m in second.marks}
    assert all(at[0][h] - at[1][h] == 1 for h in both)


def test_lone_and_no_documents(spark, empty):
    r = fingerprints.compare_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0
    assert fingerprints.compare_edited(empty).count() == 0
    same_text = spark.createDataFrame([(k, "equal text here now") for k in range(3)], "doc_id long, text string")
    assert fingerprints.fingerprint(same_text).select("fingerprint").distinct().count() == 1
    assert F is not None
