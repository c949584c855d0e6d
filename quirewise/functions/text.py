"""Column functions on words and texts."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"[^\p{L}\p{N}'’]+"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(word: Column) -> Column:
    """Without leading and trailing characters that are no letters, numbers or apostrophes."""
    return F.regexp_replace(word, f"^{_EDGE}|{_EDGE}$", "")


def replace_core(word: Column, core: Column) -> Column:
    """``core`` in place of the stripped word, inside the word's own punctuation."""
    lead = F.regexp_extract(word, f"^({_EDGE})?", 0)
    tail = F.when(strip(word) == "", F.lit("")).otherwise(F.regexp_extract(word, f"{_EDGE}$", 0))
    return F.when(strip(word) == "", F.concat(core, word)).otherwise(F.concat(lead, core, tail))


def word_like(word: Column) -> Column:
    return strip(word).rlike(r"^[\p{L}'’-]{3,}$")


def roman_like(word: Column) -> Column:
    return word.rlike(r"^[ivxlcdmIVXLCDM]+\.*$")


def capitalised(word: Column) -> Column:
    return strip(word).rlike(r"^\p{Lu}")


def ends_sentence(word: Column) -> Column:
    return word.rlike("[.!?][\"'”’)\\]]*$")


#: Lower-case abbreviations that a full stop does not end a sentence after.
ABBREVIATIONS = "etc viz vol vols chap ch sect ibid seq edit ed trans ult inst cf art lib cap fol ff pp p mr mrs dr st rev esq ver vide sc".split()


def numeral_pattern(thousands: str, ones: int) -> str:
    """Roman numerals in lower case: ``thousands`` repeats m; of each smaller decimal digit at most ``ones`` unit letters follow one another."""
    digit = lambda unit, five, ten: f"(?:{unit}[{five}{ten}]|{five}?{unit}{{0,{ones}}})"
    return f"^m{thousands}{digit('c', 'd', 'm')}{digit('x', 'l', 'c')}{digit('i', 'v', 'x')}$"


_OPENERS, _CLOSERS = "^[“‘\"'(\\[]+", "[”’\"')\\]]+$"


def grammar_core(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def ends_sentence_ui(word: Column) -> Column:
    """As ``ends_sentence``, but not after initials, abbreviations, dotted words and lower-case numerals."""
    s = F.regexp_replace(word, _CLOSERS, "")
    body = F.regexp_replace(s, r"\.$", "")
    bare = F.regexp_replace(body, _OPENERS, "")
    stop = body.rlike(r"\p{L}{3}$") & ~F.contains(body, F.lit(".")) & ~grammar_core(body).isin(ABBREVIATIONS) & ~(bare.rlike(numeral_pattern("*", 3)) & (bare != ""))
    return s.rlike("[!?]$") | (s.rlike(r"\.$") & stop)


def capitalise(word: Column) -> Column:
    lead = F.regexp_extract(word, _OPENERS, 0)
    rest = F.substring(word, F.length(lead) + 1, F.length(word))
    return F.concat(lead, F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(word)))


def clip(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def norm_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def extract_json(text: Column) -> Column:
    """From the first brace to the last, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def safe_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N} -]", " "), " +", " "))


def parse_ranges(text: Column) -> Column:
    """'1-50, 60' as an array of (lo, hi), or null if any part is no range."""
    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    lo = lambda x: F.regexp_extract(x, r"^([0-9]+)\s*(?:[-–—]\s*([0-9]+))?$", 1)
    hi = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^([0-9]+)\s*(?:[-–—]\s*([0-9]+))?$", 2), F.lit("")), lo(x))
    read = F.transform(parts, lambda x: F.struct(lo(x).try_cast("long").alias("lo"), hi(x).try_cast("long").alias("hi")))
    bad = F.exists(read, lambda r: F.coalesce((r["lo"] < 1) | (r["hi"] < r["lo"]), F.lit(True)))
    return F.when((F.size(parts) > 0) & ~bad, read)


def scope_label(ranges: Column) -> Column:
    one = lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat(r["lo"].cast("string"), F.lit("–"), r["hi"].cast("string")))
    return F.array_join(F.transform(ranges, one), ", ")


def format_bytes(n: Column) -> Column:
    whole = lambda x: F.floor(x + 0.5).cast("string")
    gb = F.floor(n / float(1 << 30) * 10 + 0.5).cast("long")
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(whole(n / 1024), F.lit(" KB")))
        .when(n < 1 << 30, F.concat(whole(n / float(1 << 20)), F.lit(" MB")))
        .otherwise(F.concat((F.floor(gb / 10)).cast("string"), F.lit("."), (gb % 10).cast("string"), F.lit(" GB")))
    )


#: Punctuation that a printed book is expected to have.
ORDINARY = ".,;:!?'\"‘’“”()-–—"
_ORDINARY_CLASS = "[.,;:!?'\"‘’“”()–—-]"


def char_kind(ch: Column) -> Column:
    """num, punct, sym, or null for letters and spaces."""
    return F.when(ch.rlike(r"^\p{N}$"), "num").when(ch.rlike(f"^{_ORDINARY_CLASS}$"), "punct").when(ch.rlike(r"^[\p{L}\p{M}\s]$"), F.lit(None)).otherwise("sym")


def count_kinds(text: Column) -> tuple[Column, Column, Column]:
    n = lambda p: F.length(F.regexp_replace(text, p, "")).cast("long")
    return n(r"[^\p{N}]"), n("[^.,;:!?'\"‘’“”()–—-]"), n("[\\p{N}\\p{L}\\p{M}\\s.,;:!?'\"‘’“”()–—-]")


#: What recognition often makes of one printed fragment, and what it was.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("l", "i"), ("i", "l"), ("1", "l"), ("l", "1"), ("I", "l"), ("l", "I"), ("0", "o"), ("o", "0"), ("c", "e"), ("e", "c"), ("ſ", "s"), ("f", "s"), ("s", "f"), ("u", "n"), ("n", "u"),
    ("cl", "d"), ("d", "cl"), ("vv", "w"), ("h", "b"), ("b", "h"), ("t", "l"), ("mn", "rnn"), ("nn", "m"), ("li", "h"), ("h", "li"),
)


def confusions(word: Column) -> Column:
    """array<struct<nth, at, from_, to, candidate>>: one pattern replaced once, occurrences not overlapping."""

    def of(nth: int, old: str, new: str) -> Column:
        pieces = F.split(word, old, -1)
        at = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(F.lit(nth).alias("nth"), i.alias("at"), F.lit(old).alias("from_"), F.lit(new).alias("to"), F.concat(F.array_join(F.slice(pieces, F.lit(1), i), old), F.lit(new), F.array_join(F.slice(pieces, i + 1, F.size(pieces)), old)).alias("candidate")))
        return F.when(F.size(pieces) > 1, at).otherwise(F.array().cast("array<struct<nth:int,at:int,from_:string,to:string,candidate:string>>"))

    return F.concat(*(of(k, a, b) for k, (a, b) in enumerate(CONFUSIONS)))


#: Period endings, what they became, and the lengths of words that they're taken from.
ENDINGS = (("e", "", 3, None), ("ie", "y", 0, None), ("es", "s", 0, None), ("ke", "c", 0, None), ("ke", "k", 0, None), ("cke", "c", 0, None), ("ee", "e", 0, 4))
#: Period spellings inside words and what they became; pairs that stand together are applied in turn.
SPELLINGS = (
    (("ay", "ai"),),
    (("ayd", "aid"), ("aide", "aid")),
    (("eere", "ear"),),
    (("oore", "oor"),),
    (("aine", "ain"),),
    (("aigne", "eign"),),
    (("eeue", "ieve"), ("eiue", "eive")),
    (("ould", "ol"),),
    (("ersw", "ersu"),),
    (("shalbe", "shall"),),
    (("ertue", "irtue"),),
    (("oath", "oth"),),
    (("shew", "show"),),
    (("ould", "old"),),
)


def early_modern(word: Column) -> Column:
    """Candidate modern spellings of a period spelling, in lower case, sorted and without repeats.

    Letters are exchanged first (initial v and inner u, i before a vowel); each of the three forms then loses
    a period ending or a doubled consonant, or has a spelling inside it replaced.
    """
    low = F.lower(word)
    exchanged = [F.regexp_replace(F.regexp_replace(low, "^v", "u"), r"(?<!^)u(?!\z)", "v"), F.regexp_replace(low, "(?<![^aeo])i(?=[aeouy])", "j")]

    def ended(form: Column, old: str, new: str, least: int, most: int | None) -> Column:
        fits = F.endswith(form, F.lit(old)) & (F.length(form) >= least)
        fits = fits if most is None else fits & (F.length(form) <= most)
        return F.when(fits, F.concat(F.substring(form, F.lit(1), F.length(form) - len(old)), F.lit(new)))

    def respelt(form: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
        for pair in pairs:
            form = F.replace(form, *map(F.lit, pair))
        return form

    def undoubled(form: Column, tail: str) -> Column:
        return F.regexp_replace(form, rf"(?<=.)([^aeiou])\1{tail}$", "$1")

    def variants(form: Column) -> list[Column]:
        return [*(ended(form, *x) for x in ENDINGS), *(undoubled(form, x) for x in ("", "e")), *(respelt(form, x) for x in SPELLINGS)]

    every = F.array(*exchanged, *(x for form in (low, *exchanged) for x in variants(form)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != low))))


#: Marks that call a note, and what recognition makes of a dagger.
SYMBOLS = ("*", "†", "‡", "§", "‖", "¶", "||")
_SUP, _SUP_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
_SYMBOL = r"\*|†|‡|§|‖|¶|\|\|"


def note_marker(first: Column) -> Column:
    """The marker that a note starts with, or null."""
    t = F.trim(first)
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"^\(+", ""), r"[.),]+$", ""))
    return (
        F.when(bare.rlike(f"^(?:{_SYMBOL})$"), bare)
        .when(t.isin("!", "?"), t)
        .when(bare.rlike("^[0-9]{1,2}$"), bare)
        .when(bare.rlike(f"^[{_SUP}]+$"), F.translate(bare, _SUP, _SUP_DIGITS))
        .otherwise(F.nullif(F.regexp_extract(t, rf"^({_SYMBOL})\p{{L}}", 1), F.lit("")))
    )


def word_marker(word: Column) -> Column:
    """The marker that a word carries at its end, or null."""
    t = F.regexp_replace(word, r"[.,;:)]+$", "")
    misread = F.when(word.rlike(r"\p{L}.*[^\p{L}\p{N}\s!]!$"), "!").when(word.rlike(r"\p{L}.*[^\p{L}\p{N}\s?]\?$"), "?")
    sup = F.regexp_extract(t, f"[{_SUP}]+$", 0)
    symbol = F.regexp_extract(t, rf"\p{{L}}.*?(\|\||[*†‡§‖¶])$", 1)
    return F.coalesce(
        misread,
        F.when(t.rlike(f"^(?:{_SYMBOL})$"), t),
        F.nullif(symbol, F.lit("")),
        F.when(sup != "", F.translate(sup, _SUP, _SUP_DIGITS)),
        F.nullif(F.regexp_extract(t, r"\p{L}{2}[,;:.]*([0-9]{1,2})$", 1), F.lit("")),
    )


def strip_word_marker(word: Column, marker: Column) -> Column:
    tail = F.regexp_extract(word, r"[.,;:)]*$", 0)
    core = F.substring(word, F.lit(1), F.length(word) - F.length(tail))
    raised = F.translate(marker, _SUP_DIGITS, _SUP)
    cut = F.when(F.endswith(core, marker), F.substring(core, F.lit(1), F.length(core) - F.length(marker))).when(F.endswith(core, raised), F.substring(core, F.lit(1), F.length(core) - F.length(raised))).otherwise(core)
    return F.when(marker == "", word).otherwise(F.concat(cut, tail))


def strip_note_marker(first: Column, marker: Column) -> Column:
    t = F.trim(first)
    rest = F.substring(t, F.length(marker) + 1, F.length(t))
    return F.when((marker == "") | ~note_marker(first).eqNullSafe(marker), first).when(F.startswith(t, marker) & rest.rlike(r"^\p{L}"), rest).otherwise("")


def fold_transcription(text: Column) -> Column:
    """Long s to s and f-ligatures to letters in built-in functions; full compatibility folding is ``normalize``."""
    for a, b in (("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalize(text: Column) -> Column:
    """NFKC, then long s to s. Spark has no such function: an Arrow batch at a time."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).replace("ſ", "s"))

    return nfkc(text)


def placed_words(text: str) -> Column:
    """Words of a text's lines in order, as an array: what is left between spaces; with line_no, word_no in the line and the line's last one, and the characters, gaps
    too, that come before it in the line."""

    def placed(texts: pa.Array) -> pa.Array:  # all words of a batch at once
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        parts = pc.split_pattern(lines.flatten(), " ")
        words, first_line, first_part = parts.flatten(), lines.offsets.to_numpy(), parts.offsets.to_numpy()
        size = pc.utf8_length(words).to_numpy()
        kept = size > 0
        words, size = words.filter(pa.array(kept)), size[kept].astype(np.int64)
        line = np.repeat(np.arange(len(first_part) - 1), np.diff(first_part))[kept]
        of_page = np.repeat(np.arange(len(texts)), np.diff(first_line))
        page = of_page[line]
        own = np.bincount(line, minlength=len(first_part) - 1)  # words of each line
        begin = np.cumsum(own) - own
        ahead = np.cumsum(size + 1) - size - 1
        at = begin[line]
        fields = {"line_no": line - first_line[page], "word_no": np.arange(len(line)) - at, "last_word": own[line] - 1, "text": words, "passed": ahead - ahead[at]}
        whole = lambda x: x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=len(texts)))])
        return pa.ListArray.from_arrays(whole(offsets), pa.StructArray.from_arrays([whole(x) for x in fields.values()], list(fields)))

    return F.arrow_udf(placed, "array<struct<line_no:int,word_no:int,last_word:int,text:string,passed:int>>")(text)
