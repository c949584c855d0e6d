import pytest

from quirewise.llm.queries import ORACLE, QUERIES
from tests.harness import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_matches_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    assert compare(QUERIES[name](spark, folder), ORACLE[name], folder) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_counts_rows(spark, name):
    folder = "/root/testdata/sf0.001"
    rows = {"op4_warc": "pages", "op12_centroids": "embeddings"}.get(name, "documents")
    assert QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/{rows}.parquet").count()
