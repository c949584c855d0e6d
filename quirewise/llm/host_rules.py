"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior.

Every document is measured by built-in expressions in one pass. Hosts' failure rates are taken to come from a beta
prior, whose mean and spread are fitted to all hosts by the method of moments net of binomial noise: hosts weigh
equally at first, then by what the first fit says their rates tell. A host's rate is the posterior mean, so a host of
a few documents is pulled to the common rate. A host is bad if its shrunk rate lies more than ``host_z`` standard
deviations of the prior above the prior's mean, and its failures exceed that mean's by as many standard deviations of
chance, so that no host is bad for one document. If rates differ by no more than noise, the spread is zero and none is.
Host verdicts are joined back to the documents: in a bad host, documents that fail any soft rule are
rejected too. Documents that break no rule stay whatever their host.

Null text has no words (and fails the length rule); a null host is a host of its own; equal rows
get equal verdicts; a rate at the limit isn't above it; an empty table gives an empty result. Other columns of
``docs`` may have any names: ``keep_good`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import checked_broadcast, free_name, let, materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Standard deviations of the prior above its mean beyond which a host is bad: one host in twenty of a normal spread.
HOST_Z = 1.645


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted by hash with their position; equal neighbours repeat. Sorting keeps a text
    of any length at n log n. Covered words follow from the gaps between repeated positions.
    """

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")),
        )
        return let(F.sort_array(windows), covered)

    def covered(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        index = F.sequence(F.lit(0), F.size(s) - 1)
        hit = F.filter(index, lambda i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(hit, lambda i: F.get(s, i)["at"])), spread)

    def spread(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, of))


def measures(text: Column) -> Column:
    """A struct of the base measures of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.ltrim(F.translate(x, "\t\n\x0b\x0c\r", "     "))) > 0)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(WORD), 0), lambda w: of(t, w)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def soft_failed(m: Column) -> Column:
    """Rules too weak to reject a document alone: symbol-laden words, repeated lines, odd word lengths."""
    mean = m["word_chars"] / F.greatest(m["n_words"], F.lit(1))
    return (100 * m["n_symbols"] > 10 * m["word_chars"]) | (4 * m["n_dup_lines"] > m["n_words"]) | (mean < 2) | (mean > 15)


def host_verdicts(measured: DataFrame, host: str, failed: str, host_z: float = HOST_Z) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_bad: a row for each host. ``failed`` is a boolean column."""
    hosts = materialize(measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col(failed)).alias("n_failed")), "hosts")
    mean, spread = beta_prior(hosts)
    pull = F.col("n_docs") * spread / (1 + (F.col("n_docs") - 1) * spread)  # n / (n + alpha + beta)
    shrunk = mean + (F.col("n_failed") / F.col("n_docs") - mean) * pull
    if not spread:
        return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_bad", F.lit(False))
    limit = mean + host_z * math.sqrt(mean * (1 - mean) * spread)
    by_chance = F.col("n_docs") * mean + host_z * F.sqrt(F.col("n_docs") * (mean * (1 - mean))) + 0.5
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_bad", (F.col("shrunk_rate") > limit) & (F.col("n_failed") > by_chance))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and spread of the prior for ``hosts`` (n_docs, n_failed); the spread is 1 / (alpha + beta + 1), 0 if rates differ by noise only.

    Kleinman's moments: with weights w, the expected sum of w (p - mean)^2 is mean (1 - mean) times
    (1 - spread) a + spread b, where a = sum w/n (1 - w/sum w) and b = sum w (1 - w/sum w).
    """
    mean = spread = 0.0
    n, p = F.col("n_docs"), F.col("n_failed") / F.col("n_docs")
    for weight in (lambda: F.lit(1.0), lambda: n / (1 + spread * (n - 1))):
        w = weight()
        sw, swp, swpp, swn, swwn, sww = hosts.agg(F.sum(w), F.sum(w * p), F.sum(w * p * p), F.sum(w / n), F.sum(w * w / n), F.sum(w * w)).first()
        if not sw:
            return 0.0, 0.0
        mean, a, b = swp / sw, swn - swwn / sw, sw - sww / sw
        if not 0 < mean < 1 or b - a <= 1e-9 * sw:
            return mean, 0.0
        spread = min(0.999, max(0.0, ((swpp - swp * swp / sw) / (mean * (1 - mean)) - a) / (b - a)))
    return mean, spread


def host_quality(docs: DataFrame, host_col: str = "source", host_z: float = HOST_Z) -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, soft_failed, host_rate, host_bad, kept."""
    m = materialize(docs.select(F.col("doc_id"), F.col(host_col).cast("string").alias("host"), measures(F.col("text")).alias("m")), "rules")
    m = m.select("doc_id", "host", "m", base_failed(F.col("m")).alias("base_failed"), soft_failed(F.col("m")).alias("soft_failed"))
    verdicts = host_verdicts(m.withColumn("failed", F.col("base_failed") | F.col("soft_failed")), "host", "failed", host_z)
    verdicts = checked_broadcast(verdicts.select(F.col("host").alias("of"), F.col("shrunk_rate").alias("host_rate"), "host_bad"))
    joined = m.join(verdicts, m["host"].eqNullSafe(verdicts["of"]), "left")
    return joined.select("doc_id", "m.*", "base_failed", "soft_failed", "host_rate", "host_bad", kept(F.col("base_failed"), F.col("soft_failed"), F.col("host_bad")).alias("kept"))


def kept(base: Column, soft: Column, host_bad: Column) -> Column:
    return ~base & ~(soft & F.coalesce(host_bad, F.lit(False)))


def keep_good(docs: DataFrame, host_col: str = "source", host_z: float = HOST_Z) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Measured rows are stored once with their texts, so nothing is measured twice; the host verdicts that
    reject anything are few and joined by an anti join.
    """
    tag = free_name(docs, "host_rule_row")
    stored = materialize(docs.select("*", F.struct(F.col(host_col).cast("string").alias("host"), measures(F.col("text")).alias("m")).alias(tag)), "rules")
    m = F.col(tag)["m"]
    narrow = stored.select(F.col(tag)["host"].alias("host"), (base_failed(m) | soft_failed(m)).alias("failed"))
    bad = checked_broadcast(materialize(host_verdicts(narrow, "host", "failed", host_z).where("host_bad").select(F.col("host").alias("bad_host")), "bad-hosts"))
    good = stored.where(~base_failed(m))
    return good.join(bad, soft_failed(m) & F.col(tag)["host"].eqNullSafe(bad["bad_host"]), "left_anti").drop(tag)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT r, s, array_to_string(words[s:s + 2], ' ') AS h FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS s FROM w WHERE len(words) >= 3)),
again AS (SELECT r, h FROM g GROUP BY r, h HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM g JOIN again USING (r, h)) GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w) w LEFT JOIN rep ON w.r = rep.r),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 4 * n_dup_lines > n_words OR word_chars < 2 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) AS soft_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM f GROUP BY source),
e AS (SELECT source, n, bad::DOUBLE / n AS p FROM h),
s1 AS (SELECT count(*)::DOUBLE AS sw, sum(p) AS swp, sum(p * p) AS swpp, sum(1.0::DOUBLE / n) AS swn, sum(1.0::DOUBLE / n) AS swwn, count(*)::DOUBLE AS sww FROM e),
r1 AS (SELECT swp / sw AS mu, swpp - swp * swp / sw AS s, swn - swwn / sw AS a, sw - sww / sw AS b, sw FROM s1),
q1 AS (SELECT CASE WHEN mu > 0 AND mu < 1 AND b - a > 1e-9 * sw THEN least(0.999, greatest(0.0, (s / (mu * (1 - mu)) - a) / (b - a))) ELSE 0 END AS rho FROM r1),
x AS (SELECT n, p, n / (1 + rho * (n - 1)) AS w FROM e, q1),
s2 AS (SELECT sum(w) AS sw, sum(w * p) AS swp, sum(w * p * p) AS swpp, sum(w / n) AS swn, sum(w * w / n) AS swwn, sum(w * w) AS sww FROM x),
r2 AS (SELECT swp / sw AS mu, swpp - swp * swp / sw AS s, swn - swwn / sw AS a, sw - sww / sw AS b, sw FROM s2),
q2 AS (SELECT mu, CASE WHEN mu > 0 AND mu < 1 AND b - a > 1e-9 * sw THEN least(0.999, greatest(0.0, (s / (mu * (1 - mu)) - a) / (b - a))) ELSE 0 END AS rho FROM r2),
y AS (SELECT source, n, p, mu, rho, mu + (p - mu) * n * rho / (1 + (n - 1) * rho) AS rate FROM e, q2),
v AS (SELECT source, rate, rho > 0 AND rate > mu + 1.645 * sqrt(mu * (1 - mu) * rho) AND n * p > n * mu + 1.645 * sqrt(n * mu * (1 - mu)) + 0.5 AS host_bad FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, round(rate, 6) AS host_rate, host_bad,
  NOT base_failed AND NOT (soft_failed AND host_bad) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
