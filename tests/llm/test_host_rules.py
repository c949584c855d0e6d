import numpy as np

from quirewise.llm import host_rules
from tests.llm.fixtures import frame

GOOD = " ".join(f"word{i} and other{i}" for i in range(30))
SOFT = " ".join(f"w{i}#$% a{i}*&" for i in range(40))


def corpus(shares, n=60):
    rows = [(f"host{h}", SOFT if k < share * n else GOOD) for h, share in enumerate(shares) for k in range(n)]
    return [(i, t, "en", s, 1) for i, (s, t) in enumerate([*rows, ("tiny", SOFT), (None, GOOD)])]


def judged(spark, rows):
    return {r.doc_id: r for r in host_rules.host_quality(frame(spark, rows)).collect()}


def test_a_bad_host_loses_its_weak_documents(spark):
    rows = corpus([0.05] * 11 + [0.7])
    got = judged(spark, rows)
    for i, t, _, host, _ in rows:
        assert not got[i].base_failed and got[i].soft_failed == (t == SOFT)
        assert got[i].host_bad == (host == "host11") and got[i].kept == (t == GOOD or host != "host11")
    kept = host_rules.keep_good(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_a_host_may_hold_a_third_of_all_rows(spark):
    rows = corpus([0.05] * 10) + [(10_000 + i, SOFT if i % 4 else GOOD, "en", "large", 1) for i in range(300)]
    got = judged(spark, rows)
    assert {r[3] for r in rows if got[r[0]].host_bad} == {"large"}


def test_like_hosts_are_not_told_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, SOFT if rng.random() < 0.2 else GOOD, "en", f"host{i % 20}", 1) for i in range(2000)]
    assert all(r.kept for r in judged(spark, rows).values())
    assert all(r.kept for r in judged(spark, corpus([0.0] * 5)[:-2]).values())


def test_prior_is_that_of_the_draw(spark):
    rng = np.random.default_rng(9)
    for mean, spread in ((0.1, 0.05), (0.3, 0.2)):
        weight = 1 / spread - 1
        n = rng.integers(5, 400, 3000)
        k = rng.binomial(n, rng.beta(mean * weight, (1 - mean) * weight, 3000))
        hosts = spark.createDataFrame([(str(i), int(a), int(b)) for i, (a, b) in enumerate(zip(n, k))], "host string, n_docs long, n_failed long")
        found = host_rules.beta_prior(hosts)
        assert abs(found[0] - mean) < 0.02 and abs(found[1] - spread) < 0.15 * spread
