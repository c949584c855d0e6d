import zlib

import numpy as np
import pytest

from quirewise.llm import quality_pu
from tests.llm.fixtures import awkward_documents, frame


@pytest.mark.parametrize(("sf", "least_bad"), [("0.01", 0.9), ("0.1", 0.97)])
def test_held_out_accuracy(spark, sf, least_bad):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet")
    got = quality_pu.score_quality(read("documents"), read("labels"))
    rows = got.join(read("labels"), "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    rank = np.mean([(good.score > s).mean() + 0.5 * (good.score == s).mean() for s in bad.score])
    print("auc", rank, "good kept", good.predicted.mean(), "bad found", 1 - bad.predicted.mean())
    assert rank > 0.99 and good.predicted.mean() >= 0.99 and 1 - bad.predicted.mean() >= least_bad


def test_level_is_set_by_unseen_positives(spark):
    """Whatever pi is taken, the order of scores is kept and nearly all trusted positives stay above one half."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    rows = quality_pu.measured(read("documents")).join(read("labels"), "doc_id", "left").toArrow()
    of = quality_pu.Rows(rows["x"], rows["profile"])
    good = np.array([q == 1 for q in rows["quality"].to_pylist()])
    bad = np.array([q == 0 for q in rows["quality"].to_pylist()])
    positive, unlabelled = of.part(np.flatnonzero(good)), of.part(np.arange(len(of)))
    found = []
    for prior in (0.85, 0.9):
        plain = quality_pu.fit(positive, unlabelled, quality_pu.non_negative_risk(prior), np.log(prior / (1 - prior))).score(of)
        scores = quality_pu.train(positive, unlabelled, prior).score(of)
        assert (np.argsort(scores, kind="stable") == np.argsort(plain, kind="stable")).mean() > 0.99 and (scores <= plain).all()
        assert (scores[good] >= 0.5).mean() > 0.98
        found.append(((plain[bad] < 0.3).mean(), (scores[bad] < 0.3).mean()))
    assert found[0][1] > 0.85 and all(after >= before for before, after in found)


def test_awkward(spark):
    rows = awkward_documents()
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows[:40])] + [(None, 1), (5000, 1), (1, None)], "doc_id long, quality int")
    got = quality_pu.score_quality(frame(spark, rows), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    none = quality_pu.score_quality(frame(spark, rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_pu.score_quality(frame(spark, []), labels).collect() == []


def test_risk_ignores_held_out_labels(spark):
    rows = [(i, "word " * (i % 9 + 1), "en", "s", 1) for i in range(200)]
    labels = [(i, int(i % 9 > 3)) for i in range(200)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    of = lambda x: quality_pu.score_quality(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int")).collect()
    assert sorted(map(str, of(labels))) == sorted(map(str, of(flipped)))


def test_only_positive_labels_are_read(spark):
    rows = [(i, "word " * (i % 9 + 1) + "abc " * (i % 5), "en", "s", 1) for i in range(200)]
    labels = [(i, int(i % 9 > 3)) for i in range(200)]
    of = lambda x: quality_pu.score_quality(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int")).collect()
    assert sorted(map(str, of(labels))) == sorted(map(str, of([x for x in labels if x[1] == 1])))


def test_share_of_positives_is_estimated():
    rng = np.random.default_rng(3)
    positive = rng.normal(1, 1, 4000)
    for share in (0.2, 0.5, 0.9):
        n = int(6000 * share)
        unlabelled = np.concatenate([rng.normal(1, 1, n), rng.normal(-3, 1, 6000 - n)])
        assert abs(quality_pu.mixture_share(positive, unlabelled) - share) < 0.06


def test_risk_is_that_of_its_definition():
    """The slopes are the derivatives of the non-negative risk, by differences, on either side of its corner."""
    rng = np.random.default_rng(1)
    for prior, shift in ((0.3, 0.0), (0.9, 4.0)):
        zp, zu = rng.normal(1 + shift, 1, 30), rng.normal(-1, 1, 40)
        rest = lambda p, u: np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        risk = (lambda p, u: prior * np.logaddexp(0, -p).mean() + rest(p, u)) if rest(zp, zu) >= 0 else (lambda p, u: -rest(p, u))
        gp, gu = quality_pu.non_negative_risk(prior)(zp, zu)
        for k in (0, 7):
            d = np.zeros(30)
            d[k] = 1e-6
            assert abs((risk(zp + d, zu) - risk(zp - d, zu)) / 2e-6 - gp[k]) < 1e-6
            d = np.zeros(40)
            d[k] = 1e-6
            assert abs((risk(zp, zu + d) - risk(zp, zu - d)) / 2e-6 - gu[k]) < 1e-6


def test_sample_is_that_of_least_hash(spark):
    from pyspark.sql import functions as F

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string"), F.repeat(F.lit(" c"), (F.col("id") % 9).cast("int"))).alias("text"))
    df = quality_pu.measured(docs).cache()
    h = F.xxhash64(F.col("doc_id").cast("string"), "x", "profile")
    got, all_rows = quality_pu._sample(df, 500), df.orderBy(h).limit(500).select("x").collect()
    assert len(got) == 500 and np.allclose(got.x, [r.x for r in all_rows])
    assert len(quality_pu._sample(df, 40_000)) == 30_000
