"""Encoders of public vocabulary files that work on distinct pieces of text.

Each encoder cuts texts at places that the library's own rules never merge
across, so the codes of a text are those of its pieces, one after another. A
worker keeps codes by two hashes of a piece (see ``text.Codes``); the
library itself encodes every distinct piece.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

import numpy as np

from emberlog.llm.text import Block, Codes

#: White space beyond ASCII, with some more; and 0x1c-0x1f, on which libraries differ. A text with any goes through the library whole.
_ODD_BYTES = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2[\x80-\x81]|\xe3\x80\x80|\xef\xbb\xbf")


def _string(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class Encoder:
    """Codes of whole documents by way of distinct pieces."""

    def __init__(self, bound: int = 500_000):
        self.codes = Codes(self.pieces, bound)

    def cut(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, and each document's first piece (and one more)."""
        raise NotImplementedError

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def odd(self, raw: bytes) -> bool:
        """Whether a text must be encoded whole."""
        return _ODD_BYTES.search(raw) is not None

    def documents(self, block: Block) -> list[np.ndarray]:
        """The codes of each document of a block."""
        starts, ends, first = self.cut(block)
        codes, bounds = self.codes.gather(self.codes.look(block, starts, ends, *block.identities(starts, ends)))
        at = bounds[first]
        out = [codes[at[k] : at[k + 1]] for k in range(len(block))]
        if self.odd(block.data.tobytes()):
            for k in range(len(block)):
                if self.odd(raw := block.raw(k)):
                    out[k] = np.array(self.whole(_string(raw)), np.int32)
        return out


def joined(library, words: list[str], plain: list[int], glue: str, bounds, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words in their order, the plain ones encoded many at a time.

    bounds: from the codes of plain[at:to] joined to each word's end in them,
    or None if they can't be told apart; those are then encoded one by one.
    """
    codes, lengths, order, rest = [], [], [], sorted(set(range(len(words))) - set(plain))
    groups = library.encode_batch_fast([glue.join(words[k] for k in plain[i : i + step]) for i in range(0, len(plain), step)], add_special_tokens=False)
    for g, coded in enumerate(groups):
        ids, own = np.array(coded.ids, np.int32), plain[g * step : (g + 1) * step]
        ends = bounds(ids, g * step, g * step + len(own))
        if ends is None:
            rest += own
            continue
        codes.append(ids)
        lengths.append(np.diff(ends, prepend=0))
        order += own
    for coded in library.encode_batch_fast([words[k] for k in rest], add_special_tokens=False):
        codes.append(np.array(coded.ids, np.int32))
        lengths.append(np.array([len(codes[-1])]))
    order = np.argsort(np.array(order + rest, np.int64), kind="stable")
    flat, lengths = np.concatenate([np.zeros(0, np.int32), *codes]), np.concatenate([np.zeros(0, np.int64), *lengths])
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    return flat[np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)], lengths


class WordEncoder(Encoder):
    """A ``tokenizers`` file whose rules lower-case the text and drop white space; words stand alone.

    Words of Latin-1 characters are joined for the library and told apart by
    the end-of-word mark, which each of their pre-tokens ends with; others
    go to it one by one.
    """

    LETTERS = "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == "L")
    NUMBERS = "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == "N")
    PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")

    def __init__(self, path: str, bound: int = 500_000):
        super().__init__(bound)
        self.library = load(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def cut(self, block):
        return block.spans()

    def whole(self, text):
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, pieces):
        words = [_string(p) for p in pieces]
        plain = [k for k, w in enumerate(words) if max(w) < "Ā" and "<|" not in w]
        parts = np.array([1 if (w := words[k]).isalpha() else len(self.PARTS.findall(w.lower())) for k in plain], np.int64)

        def bounds(ids: np.ndarray, at: int, to: int) -> np.ndarray | None:
            ends, upto = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(parts[at:to])
            return ends[upto - 1] if len(ends) == upto[-1] else None

        return joined(self.library, words, plain, " ", bounds)


class ByteEncoder(Encoder):
    """A ``tokenizers`` file of byte-level BPE: a piece is a run of white space and the word after it.

    The file's pattern starts a pre-token at the begin of each run of white
    space, so none reaches across pieces.
    """

    def __init__(self, path: str, bound: int = 500_000):
        super().__init__(bound)
        self.library = load(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True

    def cut(self, block):
        _, ends, _ = block.spans()
        # a piece ends where a word ends; what follows the last word of a text is a piece too
        bounds = np.unique(np.concatenate([ends, block.offsets]))
        starts, ends = bounds[:-1], bounds[1:]
        return starts, ends, np.searchsorted(starts, block.offsets)

    def whole(self, text):
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, pieces):
        words = [_string(p) for p in pieces]
        plain = [k for k, w in enumerate(words) if w[0] == " " and "<|" not in w and len(w.split()) == 1 and not w[1].isspace()]

        def bounds(ids: np.ndarray, at: int, to: int) -> np.ndarray | None:
            begins = np.flatnonzero(self.begins[ids])
            return np.append(begins[1:], len(ids)) if len(begins) == to - at else None

        return joined(self.library, words, plain, "", bounds)


@cache
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file; it lives as long as the worker."""
    return WordEncoder(path)


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
