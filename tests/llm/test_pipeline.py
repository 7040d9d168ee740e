"""The pipeline's stages against plain versions of each, and its queries against SQL."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm import language, neardup, queries, toxicity
from tests.llm.test_duplicates import groups, removed
from tests.oracle import same

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_stages(spark, data, tmp_path):
    docs = queries.table(spark, data, "documents")
    tables = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables[name] = before, docs
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
    before, after = tables["toxicity"]
    model = toxicity.fit(before, queries.table(spark, data, "labels"))
    bad = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = tables["language"]
    rejected = {r.doc_id for r in language.predict(before, language.fit(before)).where("rejected").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - rejected
    before, after = tables["near_duplicates"]
    kept = {i for (i, _, _, k) in groups([(r.doc_id, r.text) for r in before.collect()], 5) if k}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = tables["substrings"]
    old = [(r.doc_id, r.text) for r in before.collect()]
    want = {i: (n - gone) for (i, n, gone, _) in removed(old)}
    assert {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in after.collect()} == want
    before, after = tables["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    per = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert per.where("n <> m").count() == 0


def test_stages_on_awkward_rows(spark, awkward, texts, tmp_path, data):
    docs = awkward.select(*pipeline.COLUMNS)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0
    nothing = awkward.select(*pipeline.COLUMNS).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, data).count() == 0
    assert Counter(i for i, _ in texts)[7] == 2


def test_near_duplicates_write_few_files(spark, dealt_wide, monkeypatch, data):
    """With a group beyond one task the stage keeps the same rows, and its small tables are in few files, as executors spawn a process for each."""
    monkeypatch.setattr(neardup, "GROUP", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(150):
        own = list(base) if k % 3 else [f"x{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(rng.randrange(3)):
            own[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(own), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = pipeline.drop_near_duplicates(spark, docs, data)
    assert Counter(r.doc_id for r in after.collect()) == Counter(i for (i, _, _, kept) in groups([r[:2] for r in rows], 5) if kept)
    small = [n for columns, n in dealt_wide if columns == ("u", "v") or "kept" in columns or "done" in columns]
    assert len(small) > 4 and max(small) <= 8
