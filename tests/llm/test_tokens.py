"""Packing, SentencePiece and token counts against the libraries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import packing, pieces, token_counts, vocab
from emberlog.llm.text import Codes, blocks, numbered
from tests.llm.conftest import twins

EXTRA = ["", " ", "  ", " a", "a ", "\n\na  b \n c\t", "I'LL don't 'S x's", "é x y　z  w", "a \n b", "²3 µm ª", "..!!'s", "<| a |>", "x\x85y", "\x1c a", "ﬁ ﬂ é ́x", "a" * 300]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_equal_the_library(vocabulary, texts, name):
    encoder = (vocab.WordEncoder if name.startswith("word") else vocab.ByteEncoder)(vocabulary(name), bound=50)
    every = EXTRA + [t or "" for _, t in texts]
    for _ in range(2):  # cold, and with what the cache kept
        for size in (100, 1 << 20):
            got = [x.tolist() for b in blocks(pa.array(every), size) for x in encoder.documents(b)]
            assert got == [encoder.library.encode(t, add_special_tokens=False).ids for t in every]


def test_token_counts(spark, awkward, texts, vocabulary):
    library = vocab.load(vocabulary("byte_bpe_50k.json"))
    got = token_counts.count_tokens(awkward, vocabulary("byte_bpe_50k.json")).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert Counter(tuple(r) for r in got) == want


def test_token_counts_of_nothing(empty, vocabulary):
    assert token_counts.count_tokens(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_length_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 60_000).astype(np.uint64))
    keys[:5000] = np.arange(1, 5001)  # crowded slots
    table = token_counts.LengthTable(keys, keys + np.uint64(7), np.arange(len(keys), dtype=np.int32))
    assert (table.look(keys, keys + np.uint64(7)) == np.arange(len(keys))).all()
    assert (table.look(keys, keys) == -1).all()  # the second hash tells them apart
    others = np.arange(10**9, 10**9 + 1000).astype(np.uint64)
    assert (table.look(others, others) == -1).all()


def test_codes_forget_and_find():
    seen = []

    def encode(parts):
        seen.extend(parts)
        return np.array([len(p) for p in parts], np.int32), np.ones(len(parts), np.int64)

    codes = Codes(encode, bound=3)
    for text in ["a bb ccc dddd", "a bb", "a eeeee"]:
        (block,) = blocks(pa.array([text]))
        s, e, _ = block.spans()
        flat, _ = codes.gather(codes.look(block, s, e, *block.identities(s, e)))
        assert flat.tolist() == [len(w) for w in text.split()]
    assert seen.count(b"a") == 2  # forgotten once


def test_strings_that_share_a_hash():
    """Those that share the first of two hashes keep their own codes, in one block and across blocks."""
    codes = Codes(lambda parts: (np.array([len(p) for p in parts], np.int32), np.ones(len(parts), np.int64)))
    for text in ["a bb ccc a", "dddd bb"]:
        (block,) = blocks(pa.array([text]))
        s, e, _ = block.spans()
        _, checks = block.identities(s, e)
        flat, _ = codes.gather(codes.look(block, s, e, np.full(len(s), 5, np.uint64), checks))
        assert flat.tolist() == [len(w) for w in text.split()]
    a, b = np.array([1, 1, 1, 2], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    assert len(set(numbered(a, b).tolist())) == 3 and numbered(a, b)[0] == numbered(a, b)[2]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 63, 64, 65, 1024, 2048, 4096])
def test_hashes_of_twins(size):
    """Words that differ have different hashes, wherever they lie; equal ones have equal ones."""
    a, b = twins(size) if size & (size - 1) == 0 else ("x" * size, "x" * (size - 1) + "y")
    (block,) = blocks(pa.array([f"{a} {b} z{a} {a}\n{b}"]))
    s, e, _ = block.spans()
    first, second = block.identities(s, e)
    for h in (first, second):
        assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_sentencepiece(awkward, texts, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    library = pieces.Model(path).library
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    rows = pieces.encode(awkward, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    for r in rows:
        assert len(r.ids) == len(r.begins) == len(r.ends) == r.n_tokens


def test_spans_equal_the_library(texts, vocabulary):
    compare(vocabulary("piece_bpe_32k.model"), EXTRA + [t or "" for _, t in texts])


def compare(path, every):
    """Codes and spans of a model's own normalisation against the library's whole encoding; also with what the cache kept."""
    model = pieces.Model(path)
    for size in (100, 1 << 20):
        found = [x for b in blocks(pa.array(every), size) for x in model.documents(b)]
        for t, (ids, begins, ends) in zip(every, found, strict=True):
            proto = model.library.encode(t, return_type="proto")
            assert ids.tolist() == [p.id for p in proto.pieces] == model.library.encode(t)
            assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces]
    return model


def with_rules(path, to, map_=b"", **flags):
    """A copy of a model with other rules of normalising; its merges stay."""
    with open(path, "rb") as file:
        raw = pieces.without_rules(file.read())[: -len(pieces._NO_RULES)]

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    rules = b"\x12" + varint(len(map_)) + map_ + b"".join(varint(k << 3) + bytes([flags.get(n, 1)]) for n, k in (("prefix", 3), ("squeeze", 4), ("escape", 5)))
    to.write_bytes(raw + b"\x1a" + varint(len(rules)) + rules)
    return str(to)


ODD = ["ﬁ ﬂ ½ ™", "　a　 b　", "Ａ１ｂ", "e\u0301 \u1e9b\u0323", "㍿ ㎏", " \t x \n\n y  ", "a　", "　", "ﬁ", "abcab ab q qq abc", "q", " q ", "x q　q y"]


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("rules", ["none", "nfkc", "nmt_nfkc_cf", "own"])
def test_models_with_a_character_map(texts, vocabulary, tmp_path, rules, squeeze, prefix):
    """The ids and spans of a model that has a compiled map come from this module's normalisation, and equal the library's."""
    import sentencepiece

    map_ = b""
    if rules == "own":
        map_ = compiled({"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YY", b"\t": b" ", b"q": b""})
    elif rules != "none":
        normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rules)
        map_ = dict(pieces.fields(dict(pieces.fields(normalizer.serialized_model_proto()))[3]))[2]
    path = with_rules(vocabulary("piece_bpe_32k.model"), tmp_path / "m.model", map_, prefix=prefix, squeeze=squeeze)
    model = compare(path, EXTRA + ODD + [t or "" for _, t in texts if len(t or "") < 3000])
    assert model.local and bool(model.map.units) == (rules != "none")


def compiled(rules):
    """A character map in the compiled form, each trie node in a block of its own."""
    strings, units = b"", {}
    tree = {}
    for key, value in rules.items():
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = len(strings)
        strings += value + b"\0"
    todo, free = [(0, 0, tree)], 256  # place of the unit, its label, its children

    while todo:
        place, label, node = todo.pop()
        base, free = free, free + 256
        offset = base ^ place
        units[place] = (offset << 10 if offset < 1 << 21 else 0) | (0x100 if None in node else 0) | label
        for byte, child in node.items():
            if byte is None:
                units[base] = 0x80000000 | child
            else:
                todo.append((base ^ byte, byte, child))
    size = (max(units) // 256 + 1) * 256  # whole blocks, as the library asks for
    trie = b"".join(units.get(k, 0).to_bytes(4, "little") for k in range(size))
    return len(trie).to_bytes(4, "little") + trie + strings


def test_longest_prefix_normalisation(vocabulary):
    rules = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YY", b"\t": b" ", b"q": b""}
    model = pieces.Model(vocabulary("piece_bpe_32k.model"))
    model.map = pieces.CharacterMap(compiled(rules))
    text, places = model.normalise("abcabﬁ\tq z".encode())
    assert text.decode() == "▁YYXfi▁▁z"
    assert places.tolist() == [0, 0, 0, 0, 0, 3, 5, 5, 8, 8, 8, 10, 10, 10, 11, 12]


def test_packing(awkward, texts, vocabulary):
    library = vocab.load(vocabulary("word_bpe_49k.json"))
    ids = {}
    for i, t in texts:
        ids.setdefault(i, set()).add(tuple([*library.encode(t or "", add_special_tokens=False).ids, 2]))
    rows = packing.pack(awkward, vocabulary("word_bpe_49k.json"), size=512).collect()
    sequences, total = {}, 0
    for r in rows:
        assert 0 < r.length == len(r.ids) <= 512
        assert any(tuple(r.ids) == own[r.start : r.start + r.length] and len(own) == r.doc_tokens for own in ids[r.doc_id])
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    for pieces_ in sequences.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at == 512 or at & (at - 1) == 0


def test_packer_follows_the_rule():
    """Every placement has the least sum of squares among all that are possible."""
    rng, closed = np.random.default_rng(3), []
    packer = packing.Packer(20, lambda n, p: closed.append(p))
    for k in range(400):
        size = int(rng.integers(1, 20))
        options = []
        for level in [0, *np.flatnonzero(packer.levels[1:20]) + 1]:
            if level + size <= 20:
                after = packer.levels[1:20].copy()
                if level:
                    after[level - 1] -= 1
                if level + size < 20:
                    after[level + size - 1] += 1
                options.append(int((after**2).sum()))
        packer._place((k, 0, size))
        assert int((packer.levels[1:20] ** 2).sum()) == min(options)
    packer.finish()
    for p in closed:
        fill = sum(x[2] for x in p)
        assert fill == 20 or fill & (fill - 1) == 0


def test_many_open_windows_are_poured():
    closed = []
    packer = packing.Packer(100, lambda n, p: closed.append(p), max_open=8)
    for k in range(60):
        packer.add(k, 51)  # no two fit
    assert packer.n_open <= 8
    packer.finish()
    assert sum(x[2] for p in closed for x in p) == 60 * 51


def test_nothing_to_pack(empty, vocabulary):
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0
    assert pieces.encode(empty, vocabulary("piece_bpe_32k.model")).count() == 0
