from collections import Counter

import corpus_pipeline
from tests.llm import brute
from tests.llm.fixtures import awkward_documents, frame
from tests.llm.test_mixing import WS
from tests.llm.test_sharding import check


def test_stages(spark, tmp_path):
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = awkward_documents() + [(1000 + r[0], *r[1:]) for r in real]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    sf = f"file://{tmp_path}"
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        out.append(docs)
        assert k == 4 or docs.columns == columns
    plain = [[tuple(r)[:5] for r in x.select(*columns[:5]).collect()] for x in out[:4]]
    failed = [r[-1] for r in brute.op8([r[:2] for r in rows])]
    assert Counter(plain[0]) == Counter(r for r, bad in zip(rows, failed, strict=True) if not bad)
    groups = {(r[0], r[1]): c for r, (_, _, c) in zip(plain[0], brute.op10([r[:2] for r in plain[0]]), strict=True)}
    assert sorted(groups[r[:2]] for r in plain[1]) == sorted(set(groups.values())) and set(plain[1]) <= set(plain[0])
    dirty = brute.op2([r[:2] for r in plain[1]], items)
    assert Counter(plain[2]) == Counter(r for r, d in zip(plain[1], dirty, strict=True) if not d[-1])
    times = Counter(plain[3])
    assert set(times.values()) <= {1, 2} and set(plain[3]) <= set(plain[2])
    words = lambda x: sum(len(WS.findall(r[1] or "")) for r in x)
    assert abs(words(plain[3]) / words(plain[2]) - 1.5) < 0.1
    check(plain[3], out[4].collect())
    assert corpus_pipeline.run(spark, sf).count() == len(plain[3])
