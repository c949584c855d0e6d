"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

#: Names that the operators use themselves, some in another case.
CLASHING = (
    *("size", "N_Words", "host", "m", "fp", "h", "shard", "target", "copies", "digest", "nth", "rank", "chunk", "words", "kept", "hub", "unit", "of", "n", "least_id", "component_id"),
    *("simhash_row", "drop_id", "Drop_FP", "twice_fp", "root", "simhash_root", "bad_id", "bad_md5", "text_md5", "mix_unit", "mix_unit_of", "mix_copies", "host_rule_row", "bad_host", "every", "base", "loose"),
)
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_documents(n=60, seed=7):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "An", "über", "x", "é", "tion") for b in ("", "s", "ing", "-1", "Ä")] + ["|", "###", "a\tb", "c\x0bd"]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(40)
    texts = [None, "", " ", "\n\n", "one", "two words", "a  b   c ", " lead", "▁mark ▁", "<s> </s>", "x" * 5000, prose(8000), "spam and eggs " * 200, "same line here\n" * 30]
    texts += [prose(rng.randint(1, 200)) for _ in range(n - 30)]
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(8)] + [texts[20]] * 4 + [texts[21] + " tail", "head " + texts[21], texts[22].upper(), texts[23].replace(" ", "\n", 1)]
    rows = [(i * 3 % 101, t, "en", rng.choice(["src0", "src0", "src1", "ümlaut", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[25], rows[25], (None, texts[21], None, None, None), (None, None, None, None, None)]
    return rows


def frame(spark, rows, extra=True):
    """``rows`` as documents; with ``extra``, columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, TYPES)
    if extra:
        for c in CLASHING:
            df = df.withColumn(c, F.lit("x"))
    return df
