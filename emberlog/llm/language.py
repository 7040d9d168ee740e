"""Language identification by interpolated Kneser-Ney character models.

For each language a model of character 4-grams inside words (with marks for
begin and end) is estimated from the counts of all training documents: each
task counts distinct words first and their n-grams once, Spark adds the counts
up, and lower orders take continuation counts. Probabilities of seen n-grams
and weights of seen contexts are kept in arrays sorted by a 64-bit hash, with
one column for each language. A document goes to the language of the lowest
cross-entropy per character; it is rejected if even that lies above what all but
one in a thousand of the language's own documents have of that length under a model that hasn't
seen them: each half of the training documents is scored by a model of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared
from emberlog.llm.text import NOT_LETTERS, Block, Codes, blocks, column, mix

ORDER = 4
BEGIN, END = 2, 3
#: Share of a language's own left-out documents that its limit would reject.
FALSE_REJECTS = 0.001
#: Least distance, in nats, from the median to the last decile of left-out documents that is believed.
LEAST_SPREAD = 0.01
#: Characters of a document whose entropy varies by chance as much as it does between documents: the spread is as sqrt(1 + SHORT / n).
SHORT = 200
#: Fewest left-out documents that tell a language's limit; one with less rejects nothing but texts without letters.
ENOUGH = 20
#: Distinct words that a task counts before it turns them into n-grams.
MAX_WORDS = 50_000
UNKNOWN = "und"


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of some words as rows of code points, and the word of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    pad = ORDER - 1
    room = lengths + pad + 1
    starts = np.cumsum(room) - room
    flat = np.full(int(room.sum()), BEGIN, np.int64)
    flat[np.arange(len(points)) + np.repeat(starts + pad - (np.cumsum(lengths) - lengths), lengths)] = points
    flat[starts + room - 1] = END
    counts = lengths + 1
    at = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.stack([flat[at + k] for k in range(ORDER)], 1) if len(words) else np.zeros((0, ORDER), np.int64), np.repeat(np.arange(len(words)), counts)


def keys_of(grams: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").lower()


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, g0 ... g3, n) of all 4-grams of (lang, text)."""
    names = ["lang", *(f"g{k}" for k in range(ORDER)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counted in held.items():
                listed = [(w, n) for raw, n in counted.items() if any(map(str.isalpha, w := _text(raw)))]
                grams, word = grams_of([w for w, _ in listed])
                weights = np.array([n for _, n in listed], np.int64)[word]
                keys, at, back = np.unique(keys_of(grams), return_index=True, return_inverse=True)
                total = np.bincount(back, weights, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *(pa.array(grams[at, k].astype(np.int32)) for k in range(ORDER)), pa.array(total)], names)
            held.clear()

        for batch in batches:
            langs = column(batch, "lang").to_pylist()
            for block in blocks(column(batch, "text")):
                starts, ends, first = block.spans(NOT_LETTERS)
                hashes = block.hashes(starts, ends)
                own = np.array(langs[block.rows[0] : block.rows[-1] + 1], object)
                of_word = np.repeat(np.arange(len(block)), np.diff(first))
                for lang in sorted(set(own)):
                    these = np.flatnonzero((own == lang)[of_word])
                    _, at, n = np.unique(hashes[these], return_index=True, return_counts=True)
                    counted, data = held.setdefault(lang, {}), block.data
                    for s, e, c in zip(starts[these[at]].tolist(), ends[these[at]].tolist(), n.tolist(), strict=True):
                        word = data[s:e].tobytes()
                        counted[word] = counted.get(word, 0) + c
                if sum(map(len, held.values())) > MAX_WORDS:
                    yield from flush()
        yield from flush()

    found = docs.select("lang", "text").mapInArrow(run, "lang string, " + "".join(f"g{k} int, " for k in range(ORDER)) + "n long")
    return found.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted hash arrays by order; a row for each n-gram or context, a column for each language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by order: hashes, log probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by length: hashes, log weights
    unknown: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log probability of a character never seen
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))  # median entropy of each language's left-out documents
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))  # from there to their last decile, for long documents
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))  # spreads from the median to the limit
    cache: Codes | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def limits(self, which: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The highest entropy that isn't rejected, of documents of n characters in these languages."""
        return self.usual[which] + self.reach[which] * self.spread[which] * np.sqrt(1 + SHORT / np.maximum(n, 1))

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its characters with the end mark (0: no letter in it)."""
        grams, word = grams_of(words)
        keys, at = self.grams[0]
        hashes = keys_of(grams[:, ORDER - 1 :])
        i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        score = np.where((keys[i] == hashes)[:, None], at[i], self.unknown)
        for n in range(2, ORDER + 1):
            known, weights = self.contexts[n - 2]
            hashes = keys_of(grams[:, ORDER - n : ORDER - 1])
            i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            score += np.where((known[i] == hashes)[:, None], weights[i], 0)
            keys, at = self.grams[n - 1]
            hashes = keys_of(grams[:, ORDER - n :])
            i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[i] == hashes
            score[hit] = at[i[hit]]
        letters = np.array([any(map(str.isalpha, w)) for w in words], bool)
        total = np.stack([np.bincount(word, score[:, k], len(words)) for k in range(len(self.languages))], 1)
        return np.where(letters[:, None], total, 0), np.where(letters, np.bincount(word, minlength=len(words)), 0)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        total, n = self.scores([_text(p) for p in pieces])
        width = len(self.languages) + 1
        return np.concatenate([total, n[:, None]], 1).astype(np.float32).view(np.int32).ravel(), np.full(len(pieces), width)

    def documents(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each document in each language, and its characters."""
        if self.cache is None:
            self.cache = Codes(self._encode)
        starts, ends, first = block.spans(NOT_LETTERS)
        flat, _ = self.cache.gather(self.cache.look(block, starts, ends, *block.identities(starts, ends)))
        rows = flat.view(np.float32).reshape(-1, len(self.languages) + 1).astype(np.float64)
        total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0)])
        own = total[first[1:]] - total[first[:-1]]
        return own[:, :-1], np.rint(own[:, -1])


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def estimate(lang: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Model:
    """A model from 4-gram counts; the discount of an order in a language is n1 / (n1 + 2 n2), a half where either is 0."""
    languages = sorted(set(lang))
    model = Model(languages)
    if not languages:
        return model
    index = {x: k for k, x in enumerate(languages)}
    which = np.fromiter(map(index.__getitem__, lang), np.int64, len(lang))
    level = {ORDER: (which, grams, n.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):  # continuation counts
        w, g, _ = level[order + 1]
        _, at, counts = np.unique(keys_of(np.concatenate([w[:, None], g[:, 1:]], 1)), return_index=True, return_counts=True)
        level[order] = w[at], g[at, 1:], counts.astype(np.float64)
    width, lower = len(languages), None
    model.usual, model.spread, model.reach = np.full(width, np.inf), np.zeros(width), np.zeros(width)
    alphabet = len(np.unique(level[1][1])) + 1
    for order in range(1, ORDER + 1):
        w, g, c = level[order]
        n1, n2 = (np.bincount(w[c == k], minlength=width).astype(np.float64) for k in (1, 2))
        discount = np.where((n1 > 0) & (n2 > 0), n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        keys = keys_of(g)
        union, at = np.unique(keys, return_index=True)
        rows = g[at]
        if order == 1:
            total = np.bincount(w, c, width)
            kinds = np.bincount(w, minlength=width)
            back = discount * kinds / np.maximum(total, 1) / alphabet
            p = np.tile(back, (len(union), 1))
            p[np.searchsorted(union, keys), w] += np.maximum(c - discount[w], 0) / total[w]
            model.unknown = np.log(np.maximum(back, 1e-12))
        else:
            contexts = keys_of(g[:, :-1])
            known = np.unique(contexts)
            total, kinds = np.zeros((len(known), width)), np.zeros((len(known), width))
            place = np.searchsorted(known, contexts)
            np.add.at(total, (place, w), c)
            np.add.at(kinds, (place, w), 1)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            i, hit = _found(lower[0], keys_of(rows[:, 1:]))
            assert hit.all()
            p = weight[np.searchsorted(known, keys_of(rows[:, :-1]))] * np.exp(lower[1][i])
            p[np.searchsorted(union, keys), w] += np.maximum(c - discount[w], 0) / total[place, w]
            model.contexts.append((known, np.log(weight).astype(np.float32)))
        lower = union, np.log(p)
        model.grams.append((union, np.log(p).astype(np.float32)))
    return model


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; an unknown id doesn't."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all documents with a known language and text that aren't held out; the model holds every 4-gram counted.

    Rows without an id are learned from; repeated rows count each; without any row to learn from the model knows no language.
    """
    shared.small_batches(docs.sparkSession)
    train = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # copies of a text are in one half
    train = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(2)).alias("half"))
    names = ["lang", *(f"g{k}" for k in range(ORDER))]
    counted = count_grams(train.select(F.concat(F.col("half").cast("string"), "lang").alias("lang"), "text")).withColumn("half", F.substring("lang", 1, 1)).withColumn("lang", F.expr("substring(lang, 2)"))
    found = counted.groupBy(*names).agg(*[F.sum(F.when(F.col("half") == str(k), F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2)]).toArrow()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    grams = np.stack([found.column(f"g{k}").to_numpy() for k in range(ORDER)], 1)
    order = np.lexsort([*grams.T[::-1], lang.indices.to_numpy()])
    lang, grams = np.array(lang.dictionary.to_pylist(), object)[lang.indices.to_numpy()[order]], grams[order]
    halves = [found.column(f"n{k}").to_numpy()[order] for k in range(2)]
    del found
    model = estimate(lang, grams, halves[0] + halves[1])
    if model.languages:
        calibrate(model, train, [estimate(lang[n > 0], grams[n > 0], n[n > 0]) for n in halves])
    return model


def calibrate(model: Model, train: DataFrame, halves: list[Model]) -> None:
    """Sets the limits from the entropies of all training documents (lang, text, half), each under the model of the other half.

    The limit lies where FALSE_REJECTS of them are beyond. Of fewer than 1 / FALSE_REJECTS the farthest is taken, and
    moved out as a tail that falls with the square of the distance would have it.
    """
    parts = [_judged(train.where(F.col("half") == k), halves[1 - k], "half", "text", ["lang"]) for k in range(2)]
    own, path = shared.written(parts[0].unionByName(parts[1]).where(F.col("_keep_0") == F.col("lang_pred")).where("cross_entropy is not null").select("lang_pred", "cross_entropy", "_n"))
    usual = own.groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 0.5).alias("usual"), F.count(F.lit(1)).alias("docs"))
    above = (F.col("cross_entropy") - F.col("usual")) / F.sqrt(1 + SHORT / F.col("_n"))
    # one row a language
    spread = own.join(F.broadcast(usual), "lang_pred").groupBy("lang_pred", "usual", "docs").agg(F.percentile_approx(above, F.array(F.lit(0.9), F.lit(1 - FALSE_REJECTS))).alias("at"))
    place = {x: k for k, x in enumerate(model.languages)}
    for r in spread.where(F.col("docs") >= ENOUGH).collect():
        k, decile = place[r.lang_pred], max(r.at[0], LEAST_SPREAD)
        model.usual[k], model.spread[k] = r.usual, decile
        model.reach[k] = max(1.0, r.at[1] / decile) * max(1.0, 1 / (FALSE_REJECTS * r.docs)) ** 0.5
    shared.remove(train.sparkSession, path)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected, and columns to keep) of every row.

    A null text, one without a letter, or any text when no language was learned, is
    ``und`` with score 0, a null cross-entropy, and is rejected. Repeated rows are judged each; of equal entropies
    the first language by name counts. An empty table gives no rows. A long text is read in whole, its distinct words are
    scored once. Columns that are not kept are not read; kept ones may have any name.
    """
    shared.small_batches(docs.sparkSession)
    return _judged(docs, model, id_col, text_col, keep).drop("_n").withColumnsRenamed({"_id": id_col} | {f"_keep_{k}": c for k, c in enumerate(keep)})


def _judged(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """What predict gives, with the id as ``_id``, columns to keep as ``_keep_0`` and so on, and characters as ``_n``."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            rest = [column(batch, f"_keep_{k}") for k in range(len(keep))]
            for block in blocks(column(batch, "_text")):
                part = slice(block.rows[0], block.rows[-1] + 1)
                if m.languages:
                    total, n = m.documents(block)
                    known = n > 0
                    entropy = -total / np.maximum(n, 1)[:, None]
                    best = entropy.argmin(1)
                    lowest = entropy[np.arange(len(best)), best]
                    share = np.exp((lowest[:, None] - entropy) * np.minimum(n, 20)[:, None])
                    score = np.where(known, 1 / share.sum(1), 0.0)
                    rejected = ~known | (lowest > m.limits(best, n))
                    pred = names[np.where(known, best, len(m.languages))]
                else:
                    known, n = np.zeros(len(block), bool), np.zeros(len(block))
                    score, lowest, rejected, pred = np.zeros(len(block)), np.zeros(len(block)), ~known, np.full(len(block), UNKNOWN, object)
                size = part.stop - part.start
                out = [column(batch, "_id").slice(part.start, size), pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(lowest, pa.float64(), mask=~known), pa.array(rejected), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out + [c.slice(part.start, size) for c in rest], ["_id", "lang_pred", "score", "cross_entropy", "rejected", "_n", *(f"_keep_{k}" for k in range(len(keep)))])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"_id {kinds['_id']}, lang_pred string, score double, cross_entropy double, rejected boolean, _n long" + "".join(f", _keep_{k} {kinds[f'_keep_{k}']}" for k in range(len(keep)))
    return source.mapInArrow(run, schema)
