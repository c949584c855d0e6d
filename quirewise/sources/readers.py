"""Readers: recognition TSV, JSON cells, dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TSV_FIELDS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def parse_tsv(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed rows of recognition TSV. A header and rows of fewer than eleven fields go; a broken number is 0."""
    f = F.col("_f")
    lines = lines.withColumn("_f", F.explode(F.array(F.split(column, "\t", -1))))  # exploded: split once a row, not again for each filter and field
    number = lambda i: F.coalesce(F.get(f, F.lit(i)).try_cast("double"), F.lit(0.0))
    rows = lines.where((F.size(f) >= 11) & ~F.startswith(column, F.lit("level")))
    typed = [number(i).cast("long" if i < 6 else "double").alias(n) for i, n in enumerate(TSV_FIELDS[:11])]
    return rows.select(*typed, F.coalesce(F.get(f, F.lit(11)), F.lit("")).alias("text"))


def parse_tsv_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Words: an empty text with a negative confidence is no word; confidences aren't below 0."""
    words = parse_tsv(lines, column).where("level = 5 AND NOT (conf < 0 AND text = '')")
    return words.withColumn("conf", F.greatest("conf", F.lit(0.0)))


def parse_tsv_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with their number of words."""
    key = ["page_num", "block_num", "par_num", "line_num"]
    counts = parse_tsv_words(lines, column).groupBy(*key).agg(F.count("*").alias("word_count"))
    return parse_tsv(lines, column).where("level = 4").join(counts, key, "left").fillna(0, ["word_count"])


def explode_json_cells(df: DataFrame, cell: str, schema: str, *keys: str) -> DataFrame:
    """A row for each entry of a JSON array cell; a broken cell has none."""
    return df.select(*keys, F.inline(F.coalesce(F.from_json(cell, schema), F.array().cast(schema))))


@dataclass(frozen=True)
class Affix:
    """A dictionary's affix rule: ``flag`` lets words end (or begin) with ``add`` in place of ``strip`` where ``condition`` matches."""

    flag: str
    suffix: bool
    strip: str
    add: str
    condition: str


def _applied(word: Column, rule: Affix) -> Column:
    if rule.suffix:
        stem = F.substring(word, F.lit(1), F.length(word) - len(rule.strip)) if rule.strip else word
        fits = F.endswith(word, F.lit(rule.strip)) & word.rlike(f"{rule.condition}$")
        return F.when(fits, F.concat(stem, F.lit(rule.add)))
    stem = F.substring(word, F.lit(len(rule.strip) + 1), F.length(word)) if rule.strip else word
    return F.when(F.startswith(word, F.lit(rule.strip)) & word.rlike(f"^{rule.condition}"), F.concat(F.lit(rule.add), stem))


def expand_dictionary(entries: DataFrame, rules: list[Affix], column: str = "value") -> DataFrame:
    """Words of ``stem/FLAGS`` lines and their forms under each flagged rule; blank lines and a leading mark go."""
    line = F.trim(F.regexp_replace(column, "^\ufeff", ""))
    stem, flags = F.regexp_extract(line, "^([^/]*)", 1), F.regexp_extract(line, "/(.*)$", 1)
    forms = [F.when(F.contains("flags", F.lit(r.flag)), _applied(F.col("stem"), r)) for r in rules]
    split = entries.select(stem.alias("stem"), flags.alias("flags")).where("stem <> ''")
    return split.select(F.explode(F.array(F.col("stem"), *forms)).alias("word")).where("word IS NOT NULL")


def read_headwords(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.lower(F.trim(F.regexp_replace(column, "^\ufeff", ""))).alias("word")).where("word <> ''").distinct()


def read_affix_rules(text: str) -> list[Affix]:
    """The PFX and SFX rules of an affix file (a small configuration file)."""
    rules = []
    for line in text.removeprefix("\ufeff").splitlines():
        f = line.split()
        if len(f) >= 5 and f[0] in ("PFX", "SFX"):
            rules.append(Affix(f[1], f[0] == "SFX", "" if f[2] == "0" else f[2], "" if f[3] == "0" else f[3].split("/")[0], f[4]))
    return rules


def render_size(requests: DataFrame, page_w: float, page_h: float, most: float) -> DataFrame:
    """Pixels of each request (page_index, scale), with the scale cut to at most ``most`` pixels."""
    scale = F.least(F.col("scale"), F.sqrt(F.lit(most / (page_w * page_h))))
    whole = lambda x: F.floor(x * scale + 0.5).cast("long")
    return requests.select("page_index", whole(page_w).alias("width"), whole(page_h).alias("height"))
