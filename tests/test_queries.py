import pytest
from pyspark.sql import functions as F

from emberlog import registry
from emberlog.functions import predicates as P
from emberlog.plans import entry_queries, queries  # noqa: F401  register their queries
from emberlog.schema import LogSchema
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, data, name):
    same(spark, data, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_deltas_and_separators_take_no_whole_table(spark, data):
    """The rows before are found in buckets: no window is over all rows."""
    for name in ("short_delta", "boot_separator"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert all("_bucket" in line for line in plan.splitlines() if "windowspecdefinition" in line)


PUSHED = {
    "match_or_and": ["In(event_type"], "index_filter": ["event_type,view", "user_id,3"], "time_window": ["GreaterThanOrEqual(ts", "LessThanOrEqual(ts"], "commit_guard": ["GreaterThanOrEqual(ts", "LessThanOrEqual(ts"],
    "half_open_window": ["GreaterThanOrEqual(ts"], "count_in_range": ["GreaterThanOrEqual(ts"], "engine_histogram": ["GreaterThanOrEqual(ts"], "histogram_dense": ["GreaterThanOrEqual(ts", "LessThanOrEqual(ts"],
    "facets_excl": ["GreaterThanOrEqual(ts", "LessThanOrEqual(ts"], "facets_single_filter": ["In(event_type"], "page_anchor": ["LessThan(l_shipdate", "GreaterThanOrEqual(l_shipdate"], "page_pages": ["GreaterThanOrEqual(l_shipdate"], "page_boundary": ["GreaterThanOrEqual(l_shipdate"],
}


@pytest.mark.parametrize("name", sorted(PUSHED))
def test_filters_reach_the_scan(spark, data, name):
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(line.split("PushedFilters")[1].split("ReadSchema")[0] for line in plan.splitlines() if "PushedFilters" in line)
    for part in PUSHED[name]:
        assert part in pushed, pushed


def test_numbers_match_as_they_are_written(spark):
    """Text that isn't a whole number as Spark writes it equals no value of a stored number."""
    df = spark.createDataFrame([(1,), (12,), (None,)], "n long")
    schema = LogSchema(F.lit(0), {"n": F.col("n")}, types={"n": "long"})
    for values, want in ((["1"], [1]), (["01", "1.0", " 1", "x", ""], []), (["12", "9" * 30], [12]), ([], [])):
        assert [r.n for r in df.where(P.has_value(schema, "n", values)).collect()] == want
