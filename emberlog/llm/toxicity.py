"""Toxicity: a logistic model of words, trained so that swapping identity terms changes no score.

Features are the distinct lower-case words of a text. Sentences of the labelled
texts that name a group are copied with the term replaced by each other term of
its kind; the squared change of the logit between a sentence and its copy is
penalised, so that a neutral mention of one group weighs no more than that of
another, and terms that only stand in for a label lose their weight. The terms are a
parameter; where no labelled sentence has one of them there is nothing to swap, and the
penalty is zero. ``gaps`` measures what swapping does to a model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared
from emberlog.llm.language import held_out
from emberlog.llm.text import LOWER, NOT_LETTERS, Block, blocks, column

#: Labelled documents to learn from, at most so many of each label (the least by a hash of the id).
MAX_PER_LABEL = 6000
#: Words in fewer training documents than this are no features; features at most.
MIN_DOCUMENTS, MAX_FEATURES = 3, 1 << 18
#: Weights of the squared norm and of the counterfactual penalty.
RIDGE, COUNTERFACTUAL = 1.0, 5.0

#: Terms for groups in English, German, French and Spanish; each is swapped for the others in its line.
IDENTITY_TERMS = (
    "women men girls boys",
    "woman man girl boy",
    "female male",
    "gay lesbian straight bisexual transgender",
    "muslims jews christians hindus buddhists atheists",
    "muslim jewish christian hindu buddhist atheist",
    "black white asian latino arab",
    "immigrants refugees foreigners citizens",
    "mexican chinese african american european indian",
    "old young disabled blind deaf",
    "frauen männer mädchen jungen",
    "muslime juden christen hindus buddhisten atheisten",
    "schwule lesben heterosexuelle bisexuelle",
    "ausländer flüchtlinge einwanderer einheimische",
    "femmes hommes filles garçons",
    "musulmans juifs chrétiens hindous bouddhistes athées",
    "immigrés réfugiés étrangers citoyens",
    "mujeres hombres niñas niños",
    "musulmanes judíos cristianos hindúes budistas ateos",
    "inmigrantes refugiados extranjeros ciudadanos",
)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    block = Block(range(1), raw, np.array([0, len(raw)]))
    return int(block.hashes(np.array([0]), np.array([len(raw)]), LOWER)[0])


def distinct_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of each document, one after another, and the first of each document (and one more)."""
    starts, ends, first = block.spans(NOT_LETTERS)
    hashes = block.hashes(starts, ends, LOWER)
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(block) + 1))


@dataclass
class Model:
    """Weights of words by sorted hash; a text's score is the logistic of their sum and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, block: Block) -> np.ndarray:
        h, first = distinct_words(block)
        if len(self.hashes) and len(h):
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            w = np.where(self.hashes[i] == h, self.weights[i], 0.0)
        else:
            w = np.zeros(len(h))
        total = np.concatenate([[0.0], np.cumsum(w)])
        return total[first[1:]] - total[first[:-1]] + self.bias


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling(toxic: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Words whose likelihood ratio against independence of the label is beyond what chance gives the best of all words."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    n, share = len(labels), labels.mean()
    rest, rest_toxic = n - counts, labels.sum() - toxic
    ratio = 2 * (part(toxic, counts * share) + part(counts - toxic, counts * (1 - share)) + part(rest_toxic, rest * share) + part(rest - rest_toxic, rest * (1 - share)))
    often = counts >= MIN_DOCUMENTS
    keep = np.flatnonzero(often & (ratio >= 2 * np.log(max(2, int(often.sum())))))
    return np.sort(keep[np.argsort(-ratio[keep], kind="stable")[:MAX_FEATURES]])


def train(texts: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, features: np.ndarray | None = None, penalty: float = COUNTERFACTUAL) -> Model:
    """texts: distinct word hashes; swaps: word hashes that a sentence loses and gains when a term is swapped; features: the words that count, sorted, by default the telling ones."""
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart
        return Model(np.zeros(0, np.uint64), np.zeros(0), 20.0 if len(labels) and labels.min() else -20.0)
    flat = np.concatenate(texts)
    hashes, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keep = _telling(np.bincount(back, labels[row], len(hashes)), counts, labels) if features is None else np.flatnonzero(np.isin(hashes, features))
    new = np.full(len(hashes), -1)
    new[keep] = np.arange(len(keep))
    hashes, feature = hashes[keep], new[back]
    row = row[feature >= 0]
    feature = feature[feature >= 0]

    def known(h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1) if len(hashes) else np.zeros(0, int)
        return i[hashes[i] == h] if len(hashes) else i

    pairs = [(known(a), known(b)) for a, b in swaps]
    pairs = [p for p in pairs if len(p[0]) or len(p[1])]
    p_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    p_feature = np.concatenate([np.concatenate([a, b]) for a, b in pairs]) if pairs else np.zeros(0, int)
    p_sign = np.concatenate([np.concatenate([-np.ones(len(a)), np.ones(len(b))]) for a, b in pairs]) if pairs else np.zeros(0)
    n, m = len(labels), len(hashes)
    w, b = np.zeros(m), 0.0
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    # steps are scaled for each word by how often it occurs (AdaGrad)
    sums, sum_b, rate = np.full(m, 1e-8), 1e-8, 0.5
    for _ in range(steps):
        error = (_logistic(np.bincount(row, w[feature], n) + b) - labels) * balance
        gradient = np.bincount(feature, error[row], m) + RIDGE * w
        if pairs:
            change = np.bincount(p_row, p_sign * w[p_feature], len(pairs))
            gradient += 2 * penalty * np.bincount(p_feature, p_sign * change[p_row], m)
        sums += gradient**2
        w -= rate * gradient / np.sqrt(sums)
        sum_b += error.sum() ** 2
        b -= rate * error.sum() / np.sqrt(sum_b)
    # the bias moves so that the best cut of the training scores, by F1 among those of at least even precision, is at one half
    z = np.bincount(row, w[feature], n) + b
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + labels.sum())
    last = np.append(z[order][:-1] > z[order][1:], True)
    good = last & (2 * hits >= np.arange(1, n + 1))
    if not good.any():
        return Model(hashes, w, float(b - z[order][0] - 1))
    best = int(np.argmax(np.where(good, f1, -1)))
    cut = (z[order][best] + z[order][best + 1]) / 2 if best + 1 < n else z[order][best] - 1
    return Model(hashes, w, float(b - cut))


def swapped(text: str, groups: list[list[str]]) -> list[tuple[str, str]]:
    """For each sentence that names a group, the term that it loses and the one that it gains, for every other term of the line.

    A term that the sentence has already is not gained: the second of the pair is empty.
    """
    line = {t: g for g in groups for t in g}
    pattern = re.compile(r"\b(" + "|".join(sorted(line)) + r")\b", re.I)
    found = []
    for sentence in re.split(r"[.!?\n]", text) if line else []:
        terms = {m.lower() for m in pattern.findall(sentence)}
        found += [(t, "" if other in terms else other) for t in sorted(terms) for other in line[t] if other != t]
    return found


def gaps(model: Model, sentences: list[str], terms: tuple[str, ...] = IDENTITY_TERMS) -> dict[str, float]:
    """What swapping does to the scores of some sentences that name groups: the mean and largest change of the logit, and the share predicted toxic."""
    groups = [line.split() for line in terms]
    changes, hits = [], 0
    for sentence in sentences:
        (block,) = blocks(pa.array([sentence]))
        before = model.logits(block)[0]
        hits += before >= 0
        for old, new in swapped(sentence, groups):
            (block,) = blocks(pa.array([re.sub(rf"\b{old}\b", new, sentence, flags=re.I)]))
            changes.append(abs(model.logits(block)[0] - before))
    return {"mean": float(np.mean(changes)) if changes else 0.0, "largest": float(np.max(changes)) if changes else 0.0, "toxic": float(hits) / max(1, len(sentences))}


def neutral(terms: tuple[str, ...] = IDENTITY_TERMS) -> list[str]:
    """A neutral mention of every term."""
    return [f"Some {t} were there" for line in terms for t in line.split()]


def telling(rows: DataFrame) -> np.ndarray:
    """The words of labelled texts (label, words) that tell the labels apart, as _telling judges them, with counts added up on the executors."""
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == n:
        return np.zeros(0, np.uint64)
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).where(F.col("n") >= MIN_DOCUMENTS)
    often = counts.count()

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    share, seen, hits = toxic / n, F.col("n"), F.col("toxic")
    rest, rest_hits = F.lit(n) - seen, F.lit(toxic) - hits
    ratio = 2 * (part(hits, seen * share) + part(seen - hits, seen * (1 - share)) + part(rest_hits, rest * share) + part(rest - rest_hits, rest * (1 - share)))
    best = counts.select("word", ratio.alias("ratio")).where(F.col("ratio") >= 2 * math.log(max(2, often))).orderBy(F.col("ratio").desc(), "word").limit(MAX_FEATURES)
    return np.sort(best.select("word").toArrow().column(0).to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_label: int = MAX_PER_LABEL, identity_terms: tuple[str, ...] = IDENTITY_TERMS) -> Model:
    """Learns from a bounded sample of labelled documents that aren't held out.

    Null labels and ids, and ids without a document, are left out. An id labelled more than once counts with its
    largest label; of rows that repeat an id each counts, of equal texts with one label one. Without
    both labels the model predicts the one it has, or none as toxic. Words are counted on the executors; the driver
    gets the telling ones of each text alone, whatever a text's length. Further columns aren't read.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("label"))
    # two samples of fixed size: bounded, so that they can be broadcast
    sample = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(max_per_label)
        sample = part if sample is None else sample.unionByName(part)
    groups = [line.split() for line in identity_terms]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = column(batch, "label").cast(pa.int64())
            for block in blocks(column(batch, "text")):
                h, first = distinct_words(block)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
                pairs = [",".join(f"{a}>{b}" for a, b in swapped(block.raw(k).decode("utf-8", "replace"), groups)) for k in range(len(block))]
                yield pa.RecordBatch.from_arrays([label.slice(block.rows[0], len(block)), lists, pa.array(pairs, pa.string())], ["label", "words", "pairs"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")
    rows, path = shared.written(source.mapInArrow(words, "label long, words array<long>, pairs string").dropDuplicates(["label", "words"]))
    features = telling(rows)
    known_ = spark.sparkContext.broadcast(features)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "words")
            first = lists.offsets.to_numpy()
            h = lists.values.to_numpy(zero_copy_only=False)
            keep = np.isin(h.view(np.uint64), known_.value)
            upto = np.concatenate([[0], np.cumsum(keep)])
            kept = pa.ListArray.from_arrays(pa.array(upto[first], pa.int32()), pa.array(h[keep]))
            yield pa.RecordBatch.from_arrays([column(batch, "label"), kept, column(batch, "pairs")], ["label", "words", "pairs"])

    found = rows.mapInArrow(chosen, "label long, words array<long>, pairs string").toArrow()
    shared.remove(spark, path)
    texts = [np.array(x, np.int64).view(np.uint64) for x in found.column("words").to_pylist()]
    y = found.column("label").to_numpy().astype(np.float64)
    pairs = found.column("pairs").to_pylist()
    order = sorted(range(len(texts)), key=lambda k: (y[k], texts[k].tobytes(), pairs[k]))  # whatever order rows came in
    terms = {t: np.array([word_hash(t)], np.uint64) for g in groups for t in g} | {"": np.zeros(0, np.uint64)}
    swaps = [tuple(terms[t] for t in pair.split(">")) for k in order for pair in pairs[k].split(",") if pair]
    return train([texts[k] for k in order], y[order] if len(order) else y, swaps, features=features)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, score, predicted, and columns to keep) of every row; a null or empty text has the score of the bias alone.

    Repeated rows are scored each, equal texts alike; a score of exactly one half is toxic. A long text is read in
    whole. An empty table gives no rows. Columns that are not kept are not read; kept ones may have any name.
    """
    shared.small_batches(docs.sparkSession)
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        for batch in batches:
            rest = [column(batch, f"_keep_{k}") for k in range(len(keep))]
            for block in blocks(column(batch, "_text")):
                value = _logistic(m.logits(block))
                at, size = block.rows[0], len(block)
                out = [column(batch, "_id").slice(at, size), pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out + [c.slice(at, size) for c in rest], ["_id", "score", "predicted", *(f"_keep_{k}" for k in range(len(keep)))])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"_id {kinds['_id']}, score double, predicted int" + "".join(f", _keep_{k} {kinds[f'_keep_{k}']}" for k in range(len(keep)))
    return source.mapInArrow(run, schema).withColumnsRenamed({"_id": id_col} | {f"_keep_{k}": c for k, c in enumerate(keep)})
