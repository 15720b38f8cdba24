import pytest

from tests import oracle
from tsumugi.plans import core_queries


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(core_queries.QUERIES))
def test_query(spark, sf, con, name):
    if name in core_queries.SQL:
        oracle.same(spark, sf, con, core_queries.QUERIES[name], core_queries.SQL[name])
    else:
        assert core_queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["task", "n", "degenerate_rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rule_score_of_all_runs(spark, sf, con):
    runs = set(con.execute("select distinct variant, seed from response where task = 'compassion'").fetchall())
    for name in ("rule_score", "missing_responses"):
        every = core_queries.QUERIES[f"{name}_runs"](spark, sf)
        one = every.where(core_queries.ONE_RUN).drop("variant", "seed")
        assert sorted(map(str, one.collect())) == sorted(map(str, core_queries.QUERIES[name](spark, sf).select(one.columns).collect()))
    got = {tuple(r) for r in core_queries.QUERIES["rule_score_runs"](spark, sf).select("variant", "seed").distinct().collect()}
    assert got == runs and len(runs) > 1


def test_schema_kinds_of_all_tables(spark, sf):
    found = {}
    for r in core_queries.QUERIES["schema_kind_counts_all"](spark, sf).collect():
        found.setdefault(r.name, set()).add(r.kind)
    assert set(found) == set(core_queries.KINDS)
    assert all(k in found[n] for n, k in core_queries.KINDS.items())
