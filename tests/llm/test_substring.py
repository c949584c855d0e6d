import numpy as np
import pytest

from quirewise.llm import substring
from tests.llm import brute
from tests.llm.fixtures import awkward_documents, frame
from tests.llm.test_contract import same

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("step", [1, 2])
def test_nodes_between_chunks_and_ranges(spark, monkeypatch, step):
    monkeypatch.setattr(substring, "STEP", step)
    monkeypatch.setattr(substring, "RANGE_WINDOWS", 3000)
    monkeypatch.setattr(substring, "CHUNK_TEXT", 20_000)
    rows = awkward_documents(90)
    rows += [(2000 + i, "a passage of over thirteen words which many of the documents share between them all " * (1 + i % 3) + f"end {i}", "en", "s", 1) for i in range(40)]
    same(substring.remove_repeats(frame(spark, rows)).select(*COLUMNS).collect(), brute.op9([r[:2] for r in rows]))


def test_ids_of_other_types(spark):
    rows = [(None if r[0] is None else f"k{r[0]:05d}", *r[1:]) for r in awkward_documents()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    same(substring.remove_repeats(docs).select(*COLUMNS).collect(), brute.op9([r[:2] for r in rows]))


def test_texts_out(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[5:25]) + " y z"), (3, "few words"), (4, None)]
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, [(*r, "en", "s", 1) for r in rows], False), text_out=True).collect()}
    assert got[1].kept_text == rows[0][1] and got[1].removed == []
    assert got[2].kept_text == "x y z" and [(r.lo, r.hi) for r in got[2].removed] == [(1, 21)]
    assert (got[3].kept_text, got[4].kept_text, got[4].n_words) == ("few words", "", 0)


def test_entries_tell_equal_first_halves_apart():
    hi, lo = np.array([7, 7, 3, 7], np.uint64), np.array([1, 2, 5, 1], np.uint64)
    e = substring.Entries(hi, lo, np.array([4, 9, 6, 2], np.int64))
    assert e.hi.tolist() == [3, 7, 7] and e.lo.tolist() == [5, 1, 2] and e.least.tolist() == [6, 2, 9]
    assert e.spread(e.least).tolist() == [2, 9, 6, 2]


def test_rolling_windows():
    values = np.random.default_rng(0).integers(0, 1 << 63, 200, dtype=np.uint64)
    again = np.concatenate([values[50:80], values])
    assert (substring.rolling(again, 13)[:18] == substring.rolling(values, 13)[50:68]).all()
    assert len(set(substring.rolling(values, 13).tolist())) == 188
