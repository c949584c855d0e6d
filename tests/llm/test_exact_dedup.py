import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirewise.llm import exact_dedup
from tests.llm.brute import fold
from tests.llm.fixtures import awkward_documents, frame

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    import hashlib

    groups = defaultdict(list)
    for d, t in rows:
        groups[fold(t or "")].append(d)
    out = Counter()
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known, default=None)
        for d in ids:
            out[d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out, sum(1 for _ in groups)


def check(found, rows):
    expected, groups = brute(rows)
    found = found.select(*COLUMNS).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    assert sum(r.kept for r in found) == groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("extra", [True, False])
def test_awkward_rows(spark, extra):
    rows = awkward_documents()
    check(exact_dedup.exact_duplicates(frame(spark, rows, extra)), [r[:2] for r in rows])


def test_strings_and_empty(spark):
    docs = spark.createDataFrame([("", "A b"), ("x", "a B"), (None, "a b"), ("é", None), ("z", "")], "doc_id string, text string")
    check(exact_dedup.exact_duplicates(docs), [tuple(r) for r in docs.collect()])
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []


def test_equal_digests_of_unequal_texts(spark):
    """With a digest of four bits nearly all texts collide, and bytes decide."""
    rows = awkward_documents()
    few = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1)
    check(exact_dedup.exact_duplicates(frame(spark, rows, False), digest=few), [r[:2] for r in rows])


def test_state_outlives_the_run(spark, tmp_path):
    """Files that come later meet the state of those before, and none is read twice."""
    rows = [r[:2] for r in awkward_documents()]
    table, state = f"{tmp_path}/documents.parquet", f"file://{tmp_path}/state"
    first = spark.createDataFrame(rows[:30], "doc_id long, text string")
    first.coalesce(2).write.parquet(table)
    check(exact_dedup.duplicates_below(spark, f"file://{table}", state, files=1), rows[:30])
    more = f"{tmp_path}/more"
    spark.createDataFrame(rows[30:], "doc_id long, text string").coalesce(1).write.parquet(more)
    for p in tmp_path.glob("more/part-*"):
        shutil.move(p, f"{table}/{p.name}")
    check(exact_dedup.duplicates_below(spark, f"file://{table}", state), rows)
    check(exact_dedup.duplicates_below(spark, f"file://{table}", state), rows)


def test_no_python_workers(spark):
    plan = exact_dedup.duplicates_below(spark, "/root/testdata/sf0.001/documents.parquet")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
