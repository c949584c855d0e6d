from collections import Counter

import pytest

from quirewise.llm import decontaminate, host_rules, simhash, substring, tokencount
from tests.llm import brute
from tests.llm.fixtures import awkward_documents, frame

COLUMNS = {
    "op6": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
    "op9": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10": ["doc_id", "fingerprint", "component_id"],
}
OPERATORS = {"op6": tokencount.count_tokens, "op8": host_rules.host_quality, "op9": substring.remove_repeats, "op10": simhash.near_duplicates}


@pytest.fixture(scope="module")
def real(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def same(got, expected):
    got, expected = Counter(map(tuple, got)), Counter(map(tuple, expected))
    assert got - expected == expected - got == Counter()


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("extra", [True, False])
def test_awkward_rows(spark, name, extra):
    rows = awkward_documents()
    same(OPERATORS[name](frame(spark, rows, extra)).select(*COLUMNS[name]).collect(), getattr(brute, name)([r[:2] for r in rows]))


@pytest.mark.parametrize("name", OPERATORS)
def test_real_rows(spark, real, name):
    same(OPERATORS[name](frame(spark, real, False)).select(*COLUMNS[name]).collect(), getattr(brute, name)([r[:2] for r in real]))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](frame(spark, [], False)).collect() == []


OP2 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _op2(spark, docs, items, extra=False):
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.contamination(frame(spark, docs, extra), bench).select(*OP2).collect(), brute.op2([d[:2] for d in docs], items))


def test_decontaminate_awkward(spark):
    docs = awkward_documents()
    items = [(i, docs[-20 - i][1]) for i in range(6)] + [(7, "two words"), (8, None), (9, "one"), (10, " "), (11, "An-S the X"), (12, docs[-12][1][40:200]), (12, "one"), (None, "words")]
    _op2(spark, docs, items, True)
    _op2(spark, docs, [])
    _op2(spark, [], items)


def test_decontaminate_real(spark, real):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    _op2(spark, real, items)


def test_keep_one(spark):
    rows = awkward_documents()
    kept = simhash.keep_one(frame(spark, rows)).collect()
    groups = {c for _, _, c in brute.op10([r[:2] for r in rows])}
    assert len(kept) == len(groups)
    by_id = {(r[0], r[1]): c for r, (_, _, c) in zip(rows, brute.op10([r[:2] for r in rows]), strict=True)}
    assert {by_id[r.doc_id, r.text] for r in kept} == groups


def test_dense_group_is_linked():
    import numpy as np

    rng = np.random.default_rng(0)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = np.unique(np.array([center ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(16, 2, replace=False) + 48) for _ in range(300)], np.uint64))
    edges = simhash.forest(near, 0)
    assert len(edges) == len(near) - 1
