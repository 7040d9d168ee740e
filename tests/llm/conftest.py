import glob
import random

import pytest

from emberlog.llm import shared

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, sig int, component string, route string, low double, kept string, hash string, position long, bucket string, score string, row string, start string"


def words(rng, n):
    return [rng.choice(["ta", "ne", "ri", "mo", "sul", "ka", "pe"]) + rng.choice(["lo", "mi", "ra", "tes", "un"]) + rng.choice(["", "s", "en", "ix"]) for _ in range(n)]


def twins(n, x="x", y="y"):
    """Two different words of n letters (a power of two) on which every polynomial hash modulo 2**64 agrees from 1024 letters on."""
    word = "".join(x if k.bit_count() % 2 else y for k in range(n))
    return word, word.translate(str.maketrans({x: y, y: x}))


def rows():
    """Texts with every awkward case: nulls, empty, white space alone, no white space, other scripts, words that weak hashes confuse, copies, near copies, shared passages, long ones."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 40))
    base = words(rng, 120)
    near = [list(base) for _ in range(6)]
    for k, x in enumerate(near[1:], 1):
        x[k * 15] = "changed"
    texts = [" ".join(x) for x in near]
    texts += ["", None, " \n\t ", "x", "a b", "A B", "x" * 5000, "日本語 テキスト 😀", "İstanbul ΣΑΣ ½", "<|endoftext|> a<|endoftext|>", "▁a ▁b  c", "one\n\ntwo  three\tfour", "!!! ### $$$"]
    texts += [" ".join(words(rng, 30)) + " " + passage + "\n" + " ".join(words(rng, 30)) for _ in range(4)]
    texts += [passage, passage, passage.replace(" ", "\n"), " ".join(words(rng, 9000)), "same line\n" * 30, " ".join(words(rng, 60))]
    lead = " ".join(words(rng, 12))
    for n in (1024, 4096):
        a, b = twins(n)
        texts += [f"{lead} {a}", f"{lead} {b}", a, b]
    out = [(k * 3, t) for k, t in enumerate(texts)]
    out += [(7, texts[0]), (7, texts[0]), (None, passage), (None, None)]  # repeated rows, rows without an id
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    """The table, with further columns whose names the operators use themselves."""
    rest = ("en", "s", 1, "id", 1, "c", "r", 0.5, "k", "h", 2, "b", "x", "y", "z")
    return spark.createDataFrame([(i, t, *rest) for i, t in rows()], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def texts():
    return rows()


@pytest.fixture(scope="session")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path


@pytest.fixture
def dealt_wide(spark, monkeypatch):
    """Shuffles of 64 tasks that are never put together; the part files of each table written meanwhile, by its columns."""
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    files, write = [], shared.written

    def written(df, keep=False):
        table, path = write(df, keep)
        files.append((tuple(df.columns), len(glob.glob(f"{path.removeprefix('file:')}/part-*"))))
        return table, path

    monkeypatch.setattr(shared, "written", written)
    for k, v in own.items():
        spark.conf.set(k, v)
    yield files
    for k, v in old.items():
        spark.conf.set(k, v)
