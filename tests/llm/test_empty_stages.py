import pytest

import corpus_pipeline
from quirewise.llm import decontaminate, host_rules, mixing, simhash
from tests.llm.fixtures import frame


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", None, 0)] * 3])
def test_stages_on_hardly_anything(spark, tmp_path, rows):
    docs = frame(spark, rows)
    assert "Drop_FP" in docs.columns
    bench = spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string")
    for out in (host_rules.keep_good(docs), simhash.keep_one(docs), decontaminate.drop_contaminated(docs, bench), mixing.mix(docs)):
        assert out.columns == docs.columns
        out.collect()
    assert simhash.keep_one(docs).count() == min(1, len(rows))
    assert decontaminate.drop_contaminated(docs, bench).count() == len(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
