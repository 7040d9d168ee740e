"""Distinct word shingles of documents as 64-bit hashes.

The hash mixes both identities of every word (see ``text``). Two shingles of a pair of documents of a million words
share one by chance with a probability below 1e-6, and much less for usual lengths.
"""

from __future__ import annotations

import numpy as np

from emberlog.llm.text import LOWER, Block, inner, mix, windows


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles (A-Z in lower case) of each document, sorted, one document after another, and where each begins (and one more).

    A document of fewer words has its whole sequence as one shingle; one without words has none.
    """
    starts, ends, first = block.spans()
    hashes = block.hashes(starts, ends, LOWER)
    at, doc = inner(first, n)
    grams = windows(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = []
        for k in short.tolist():
            h = np.array([counts[k]], np.uint64)
            for x in hashes[first[k] : first[k + 1]]:
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + x)
            own.append(h[0])
        grams, doc = np.concatenate([grams, np.array(own, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    g, d = grams[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], np.searchsorted(d[new], np.arange(len(block) + 1))
