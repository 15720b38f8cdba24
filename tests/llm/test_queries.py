import pytest

from tests import oracle
from tsumugi.llm import queries

COLUMNS = {
    "p1_found": ["doc_id", "item_id"],
    "p2_found": ["row_id", "defect"],
    "p3_found": ["row_id"],
    "p4_found": ["src", "record_key"],
    "p5_found": ["field", "id_a", "id_b"],
    "p7_found": ["id_a", "id_b"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    oracle.same(spark, sf, oracle.connection(sf), queries.QUERIES[name], queries.SQL[name])


def test_packs_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = queries.p8_pack(spark, sf).toPandas()
    assert (got.groupby("spec_id").doc_id.nunique() == docs).all()
