"""Winnowing: fingerprints of documents that share a hash whenever they share a long enough run of words.

Every word is hashed once. The hash of a run of ``k`` words rolls along: it is the exclusive or of its words'
hashes, each turned by one bit for every word behind it, and mixed at the end. From every window of ``w``
neighbouring hashes the least is taken, the rightmost of equal ones. Any run of
``w + k - 1`` words that two texts share then yields a common fingerprint, and
its positions are kept. A text of fewer than ``k`` words is one run; a text
without words has no fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.native import index, let, words

K, WINDOW = 2, 4


def winnow(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """Chosen hashes in order of position: an array of structs (hash, position), positions counted in words."""

    def turned(h: Column) -> Column:
        return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))

    def shifted(x: Column, by: int, less: int) -> Column:
        """x without its first ``by`` elements, and ``less`` fewer in all; empty where there are no more."""
        return F.slice(x, F.lit(by + 1), F.greatest(F.size(x) - less, F.lit(0)))

    def hashed(x: Column) -> Column:
        def runs(run: Column, own: Column, j: int) -> Column:  # a run takes that of one word less, turned, and the word behind it
            if j == k:
                return F.transform(run, lambda v: F.xxhash64(v))
            longer = F.zip_with(shifted(run, 0, 1), shifted(own, j, j), lambda a, b: turned(a).bitwiseXOR(b))
            return let(longer, lambda r: runs(r, own, j + 1))

        short = F.array(F.xxhash64(F.array_join(x, " ")))
        full = let(F.transform(x, lambda v: F.xxhash64(v)), lambda own: runs(own, own, 1))
        return F.when(F.size(x) >= k, full).when(F.size(x) > 0, short).otherwise(F.array().cast("array<bigint>"))

    def chosen(h: Column) -> Column:
        # places are counted down, so that of equal hashes the rightmost is the least
        marked = F.transform(h, lambda v, i: F.struct(v.alias("hash"), (-i).alias("back")))

        def least(m: Column, width: int) -> Column:  # of each window, from the leasts of windows of half its width
            if width == w:  # neighbouring windows may choose one place; places never go back
                return F.filter(m, lambda v, i: F.when(i > 0, m[i - 1]["back"] != v["back"]).otherwise(F.lit(True)))
            step = min(width, w - width)
            return let(F.zip_with(shifted(m, 0, step), shifted(m, step, step), lambda a, b: F.least(a, b)), lambda x: least(x, width + step))

        one = F.when(F.size(h) > 0, F.array(F.array_min(marked))).otherwise(F.array().cast("array<struct<hash:bigint,back:int>>"))
        found = F.when(F.size(h) >= w, let(marked, lambda m: least(m, 1))).otherwise(one)
        return F.transform(found, lambda m: F.struct(m["hash"].alias("hash"), (-m["back"]).alias("position")))

    return let(words(F.coalesce(text, F.lit(""))), lambda x: let(hashed(x), lambda h: chosen(h)))


def digest(marks: Column) -> Column:
    """One string for a fingerprint: SHA-256 of its hashes in order."""
    return F.sha2(F.array_join(F.transform(marks, lambda m: F.hex(m["hash"])), " "), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """The id, marks (array of (hash, position)) and fingerprint of every row; nothing is shuffled."""
    got = docs.select(F.col(id_col), winnow(F.col(text_col), k, w).alias("marks"))
    return got.withColumn("fingerprint", digest(F.col("marks")))


def with_next(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Every row as (id, text, bucket, place in it, lower, below): the text of the next row downwards by id, the lowest row followed by the highest.

    Rows are dealt by id into buckets of about equal size, bounded by
    quantiles, and each finds its neighbour there. Only the lowest row
    of a bucket looks elsewhere: at the highest row of the bucket below. Ties
    of the id are ordered by text; null ids come lowest.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as the session deals any shuffle into
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    steps = F.array(*[F.lit(j / n) for j in range(1, n)])
    bounds = sorted(set(source.agg(F.percentile_approx("id", steps, 20 * n).alias("b")).first()["b"] or []))
    bucket = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b < F.col("id")))
    source = source.withColumn("bucket", bucket)
    order = [F.col("id").asc_nulls_first(), F.col("text").asc()]
    inside = Window.partitionBy("bucket").orderBy(*order)
    highest = source.groupBy("bucket").agg(F.max_by("text", F.struct(F.col("id").isNotNull().alias("known"), "id", "text")).alias("top"))
    # which bucket lies below is told by their numbers alone; texts don't meet in one task
    known = sorted(r["bucket"] for r in source.select("bucket").distinct().collect())  # n at most
    pairs = spark.createDataFrame([(b, known[k - 1]) for k, b in enumerate(known)], "bucket int, other int")
    below = F.broadcast(pairs).join(highest.select(F.col("bucket").alias("other"), F.col("top").alias("below")), "other").select("bucket", "below")
    rows = source.withColumn("lower", F.lag("text").over(inside)).withColumn("place", F.row_number().over(inside))
    return rows.join(below, "bucket")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by the next document's begin.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_marks and marks, the hashes chosen with their positions, from which equal runs can be
    told. A null text counts as empty; of repeated
    rows each is the other's neighbour; a lone row is followed by itself. Rows without an id come last. An empty table gives no rows. A very
    long text is one row's array, in memory that grows with its words. Further columns are not read, whatever their names.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    following = F.coalesce(F.col("lower"), F.col("below"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(following, F.lit(1), third))
    marked = rows.select("id", "bucket", "place", n.cast("long").alias("n_chars"), edited.alias("edited"), "lower", "below", winnow(F.col("text"), k, w).alias("marks"))
    inside = Window.partitionBy("bucket").orderBy("place")  # equal rows stay in their order
    both = marked.withColumn("lower_marks", F.lag("marks").over(inside)).select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "marks", winnow(F.col("edited"), k, w).alias("edited_marks"), F.coalesce("lower_marks", winnow(F.col("below"), k, w)).alias("next_marks")
    )

    def hashes(c: str) -> Column:
        return F.array_distinct(F.transform(F.col(c), lambda m: m["hash"]))

    near = let(hashes("marks"), lambda own: F.struct(let(hashes("edited_marks"), lambda x: likeness(own, x)).alias("edited"), let(hashes("next_marks"), lambda x: likeness(own, x)).alias("next")))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", digest(F.col("marks")).alias("fingerprint"), digest(F.col("edited_marks")).alias("edited_fingerprint"), near.alias("near"), F.size("marks").cast("long").alias("n_marks"), "marks"
    ).select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"), "n_marks", "marks")
