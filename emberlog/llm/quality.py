"""Quality rules: a table of thresholds compiled into one projection, without any user function."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.native import index, let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine für ist mit nicht sich und von zu "
    "avec ce de des du elle en est et il la le les ou par pas pour que une "
    "con como del el ella en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails unless ``least <= measure <= most``; None: no such bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Length, symbol, stop-word and line ratios; measures() says what each is.
RULES = (
    Rule("word_length", least=2, most=15),
    Rule("symbol_ratio", most=0.3),
    Rule("stop_ratio", least=0.02),
    Rule("duplicate_line_ratio", most=0.4),
)
MIN_WORDS, MOST_REPEATED = 50, 50


def _repeat_words(w: Column, n: int = 3) -> Column:
    """Words covered by runs of n words that occur twice or more.

    Runs are sorted by hash and place within the text; those with an equal
    neighbour are the repeated ones. Texts whose runs all differ skip it.
    """

    def repeated(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(s, lambda x, j: F.when(j > 0, s[j - 1]["h"] == x["h"]).otherwise(F.lit(False)) | F.when(j < last, s[j + 1]["h"] == x["h"]).otherwise(F.lit(False)))
            places = F.sort_array(F.transform(same, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.when(j < F.size(p) - 1, F.least(F.lit(n), p[j + 1] - x)).otherwise(F.lit(n))), F.lit(0), lambda a, x: a + x))

        found = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    # each word is hashed once, a run is the hash of its words' hashes
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda g: let(F.transform(index(F.size(g) - (n - 1)), lambda i: F.xxhash64(*[g[i + k] for k in range(n)])), repeated))


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text (null: empty) as columns, apart from what is derived from them."""
    text = F.coalesce(text, F.lit(""))
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "by_words": by_words,
        "lines": lines,
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row with the counts of measures() passes every rule; ratios of nothing are 0."""

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    known = {
        "word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "duplicate_line_ratio": ratio("n_dup_lines", "n_lines"),
    }
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict = verdict & (known[rule.measure] >= F.lit(float(rule.least)))
        if rule.most is not None:
            verdict = verdict & (known[rule.measure] <= F.lit(float(rule.most)))
    return verdict


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed, kept.

    A null or empty text has no words and fails the base rules. Repeated rows
    are judged each; no row needs another, so nothing is shuffled. An empty table gives no rows. A measure that equals its
    bound passes. A very long text is measured whole, in memory that grows with its words. Further columns are
    not read, whatever their names.
    """
    got = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in measures(F.col(text_col)).items()])
    flat = got.select(
        F.col("id").alias(id_col),
        F.col("by_words.n_words").alias("n_words"),
        F.col("by_words.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("lines.n_dup_lines").alias("n_dup_lines"),
        F.col("by_words.n_repeat_words").alias("n_repeat_words"),
        F.col("by_words.n_stop_words").alias("n_stop_words"),
        F.col("lines.n_lines").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over ``documents`` as DuckDB SQL."""
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    ratios = {"word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_ratio": ("n_stop_words", "n_words"), "duplicate_line_ratio": ("n_dup_lines", "n_lines")}
    tests = []
    for r in rules:
        a, b = ratios[r.measure]
        value = f"(case when {b} > 0 then {a}::double / {b} else 0 end)"
        tests += [f"{value} {sign} {float(bound)}" for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None]
    return f"""
    with t as (
      select doc_id, row_number() over () as row, coalesce(text, '') as text from documents
    ), w as (
      select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
      from t
    ), runs as (
      select row, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) as run
      from (select row, w, unnest(generate_series(1, len(w) - 2)) as i from w)
    ), again as (
      select row, i from (select row, i, count(*) over (partition by row, run) as n from runs) where n > 1
    ), covered as (
      select row, count(distinct place) as n_repeat_words
      from (select row, unnest([i, i + 1, i + 2]) as place from again) group by row
    ), counts as (
      select doc_id, len(w)::bigint as n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
        len(l)::bigint as n_lines
      from w left join covered using (row)
    ), judged as (
      select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from counts
    )
    select *, not base_failed and {" and ".join(tests) or "true"} as kept from judged
    """
