"""Chat formatting of logged conversations: snapshots that longer ones continue are collapsed first.

A log often holds a conversation again after each turn. Every turn gets the
rolling hash of all turns up to it; a conversation whose hash over all its
turns is also that of a proper prefix of another is left out by an
anti-join, and of equal ones the least id stays. The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def rolled(turns: DataFrame) -> DataFrame:
    """(id, turn, role, text, place, n, a, b): place and number of turns; a and b, 128 bits together, are the hash of all turns so far.

    A turn's hash covers its place, so the exclusive or of hashes up to a turn
    identifies the sequence. Nulls differ from empty strings.
    """
    group = Window.partitionBy("id")
    order = group.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    placed = turns.withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(group))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("a", F.bit_xor(F.xxhash64("place", *parts)).over(upto)).withColumn("b", F.bit_xor(F.xxhash64(F.lit("second"), *parts, "place")).over(upto))


def maximal(turns: DataFrame) -> DataFrame:
    """(id, n_copies) of conversations that are no proper prefix of another, one for each group of equal ones."""
    key = ["n", "a", "b"]
    whole = turns.where(F.col("place") == F.col("n")).select("id", *key)
    one = whole.groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = turns.where(F.col("place") < F.col("n")).select(F.col("place").cast("long").alias("n"), "a", "b").distinct()
    return one.join(prefixes, key, "left_anti").select("id", "n_copies")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_copies, rendered) of each maximal conversation.

    Turns are ordered by turn, role and text, nulls first, and all of them
    count, repeated rows too. A null role or text is rendered as empty. Rows
    with a null id form one conversation. n_copies: conversations with equal turns, itself included. A conversation is
    rendered in one task whatever its length, as its text is one value; so are all rows without an id. An empty table gives no rows. Further
    columns are not read, whatever their names.
    """
    source = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    every = rolled(source)
    kept = maximal(every).withColumnRenamed("id", "kept_id")
    shown = every.select("id", "place", "n", render(F.col("role"), F.col("text")).alias("said")).join(kept, F.col("id").eqNullSafe(F.col("kept_id")))
    grouped = shown.groupBy("id").agg(F.max("n").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("place", "said"))).alias("said"))
    return grouped.select(F.col("id").alias(id_col), "n_turns", "n_copies", F.array_join(F.transform("said", lambda x: x["said"]), "").alias("rendered"))


ORACLE_SQL = f"""
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place from conversations
), c as (
  select conv_id, count(*) as n, list(struct_pack(role := role, text := text) order by place) as turns,
    string_agg('{BEGIN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' order by place) as rendered
  from t group by conv_id
), prefixes as (
  select distinct turns[1:i] as turns from (select turns, unnest(generate_series(1, n - 1)) as i from c)
), one as (
  select turns, min(conv_id) as conv_id, count(*) as n_copies, max(n) as n_turns, any_value(rendered) as rendered from c group by turns
)
select conv_id, n_turns, n_copies, rendered from one where not exists (select 1 from prefixes p where p.turns = one.turns)
"""
