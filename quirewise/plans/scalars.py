"""Scalar functions over the words that occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirewise.functions import numerals as N
from quirewise.functions import text as T
from quirewise.operators import spelling
from quirewise.plans.registry import query
from quirewise.sources.views import pick

_TK = {"tk": "SELECT DISTINCT text AS token FROM words"}
_STRIP = r"regexp_replace({0}, '^[^\p{{L}}\p{{N}}''’]+|[^\p{{L}}\p{{N}}''’]+$', '', 'g')"
_S = _STRIP.format("token")
_MARKS = "'*', '†', '1', '(2)', '3.', '¹', '||', '!', '?', ')', ',†', '12', '²,', ''"


def tokens(v):
    return v.texts.select(F.col("text").alias("token")).distinct()


def marked(v, suffix=True):
    """Each token with a mark behind (or before) it."""
    mark = pick(F.length("token") + F.ascii("token"), "*", "†", "1", "(2)", "3.", "¹", "||", "!", "?", ")", ",†", "12", "²,", "")
    pairs = tokens(v).select("token", mark.alias("mark"))
    return pairs.select((F.concat("token", "mark") if suffix else F.concat("mark", "token")).alias("token")).distinct()


_AFTER = {"tk": f"SELECT DISTINCT text || ([{_MARKS}])[(length(text) + ascii(text)) % 14 + 1] AS token FROM words"}
_BEFORE = {"tk": f"SELECT DISTINCT ([{_MARKS}])[(length(text) + ascii(text)) % 14 + 1] || text AS token FROM words"}


@query("fn_strip", f"SELECT token, {_S} AS core FROM tk", _TK)
def fn_strip(v):
    return tokens(v).select("token", T.strip(F.col("token")).alias("core"))


@query("fn_replace_core", rf"SELECT token, CASE WHEN {_S} = '' THEN 'New' || token ELSE regexp_extract(token, '^[^\p{{L}}\p{{N}}''’]*') || 'New' || regexp_extract(token, '[^\p{{L}}\p{{N}}''’]*$') END AS replaced FROM tk", _TK)
def fn_replace_core(v):
    return tokens(v).select("token", T.replace_core(F.col("token"), F.lit("New")).alias("replaced"))


@query("fn_normalize", "SELECT token, replace(replace(replace(token, 'ſ', 's'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS folded FROM tk", {"tk": "SELECT DISTINCT replace(replace(text, 'fi', 'ﬁ'), 's', 'ſ') AS token FROM words"})
def fn_normalize(v):
    raw = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("s"), F.lit("ſ"))
    return v.words.select(raw.alias("token")).distinct().select("token", T.normalize(F.col("token")).alias("folded"))


@query("fn_fold_transcription", "SELECT token, replace(replace(replace(token, 'ſ', 's'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS folded FROM tk", {"tk": "SELECT DISTINCT replace(replace(text, 'fi', 'ﬁ'), 's', 'ſ') AS token FROM words"})
def fn_fold_transcription(v):
    raw = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("s"), F.lit("ſ"))
    return v.words.select(raw.alias("token")).distinct().select("token", T.fold_transcription(F.col("token")).alias("folded"))


_PATTERNS = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(T.CONFUSIONS)) + ") p(nth, old, new)"
_SPLIT = "SELECT token, nth, old, new, string_split(token, old) AS ps FROM tk, patterns WHERE contains(token, old)"


@query("fn_confusions", "SELECT token, nth, list_reduce(ps[1:i], lambda a, b: a || old || b) || new || list_reduce(ps[i + 1:], lambda a, b: a || old || b) AS candidate FROM (SELECT *, unnest(generate_series(1, len(ps) - 1)) AS i FROM pieces)", {**_TK, "patterns": _PATTERNS, "pieces": _SPLIT})
def fn_confusions(v):
    return tokens(v).select("token", F.inline(T.confusions(F.col("token")))).select("token", "nth", "candidate")


@query("fn_early_modern")
def fn_early_modern(v):
    return tokens(v).select("token", F.array_join(T.early_modern(T.strip(F.col("token"))), "|").alias("variants"))


@query("fn_known", f"SELECT token, {_S} = '' OR lower({_S}) IN (SELECT token FROM lexicon) AS known FROM tk", _TK)
def fn_known(v):
    return spelling.known(tokens(v), v.lexicon)


@query(
    "fn_misspelt",
    r"""SELECT token, NOT (length(regexp_replace(w, '[^\p{L}]', '', 'g')) < 2 OR regexp_matches(w, '\p{N}') OR lower(core) IN (SELECT token FROM lexicon) OR core = ''
      OR (regexp_matches(w, '''[sS]$') AND (regexp_replace(lower(w), '''s$', '') IN (SELECT token FROM lexicon)))
      OR (len(parts) > 1 AND len(list_filter(parts, lambda p: NOT list_contains(l, p))) = 0)) AS misspelt
    FROM (SELECT token, w, regexp_replace(w, '^[^\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+$', '', 'g') AS core, list_filter(string_split(regexp_replace(lower(w), '[–—]', '-', 'g'), '-'), lambda p: p <> '') AS parts
      FROM (SELECT token, trim(replace(regexp_replace(token, '^[^\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+$', '', 'g'), '’', ''''), '''') AS w FROM tk)), (SELECT list(token) AS l FROM lexicon)""",
    _TK,
)
def fn_misspelt(v):
    return spelling.misspelt(tokens(v), v.lexicon)


#: DuckDB counts bytes of a word, not letters: letters beyond ASCII become capitals, which words in lower case don't have.
_ASCII = "translate({0}, 'äöüßáéíóúñèêçàâëïîôûùœæÿ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"


def _near(unknown: str) -> dict[str, str]:
    """Subqueries: ``near`` has (token, suggestion, distance) for the words of ``unknown`` (token, w), by letters left out of both sides."""
    cut = "SELECT DISTINCT {1}, substr(k, 1, i - 1) || substr(k, i + 1) AS k FROM (SELECT *, unnest(generate_series(1, length(k))) AS i FROM {0})"
    return {
        "asked": f"SELECT DISTINCT token, {_ASCII.format('w')} AS w, {_ASCII.format('w')} AS k FROM ({unknown})",
        "asked1": cut.format("asked", "token, w"), "asked2": cut.format("asked1", "token, w"),
        "there": f"SELECT token AS suggestion, {_ASCII.format('token')} AS s, {_ASCII.format('token')} AS k FROM lexicon",
        "there1": cut.format("there", "suggestion, s"), "there2": cut.format("there1", "suggestion, s"),
        "near": """SELECT DISTINCT token, suggestion, CAST(levenshtein(w, s) AS BIGINT) AS distance FROM (SELECT token, w, k FROM asked UNION SELECT token, w, k FROM asked1 UNION SELECT token, w, k FROM asked2) a
          JOIN (SELECT suggestion, s, k FROM there UNION SELECT suggestion, s, k FROM there1 UNION SELECT suggestion, s, k FROM there2) b USING (k) WHERE levenshtein(w, s) <= 2""",
    }


_UNKNOWN = f"SELECT token, lower({_S}) AS w FROM tk WHERE lower({_S}) NOT IN (SELECT token FROM lexicon) AND length({_S}) >= 4"


@query("fn_suggest", "SELECT token, suggestion, distance FROM near", _TK | _near(_UNKNOWN))
def fn_suggest(v):
    return spelling.suggest(tokens(v), v.lexicon, v.lexicon)


@query("fn_levenshtein", f"SELECT proposal_id, CAST(levenshtein({_ASCII.format('lower(original)')}, {_ASCII.format('lower(replacement)')}) AS BIGINT) AS d, CAST(levenshtein({_ASCII.format('lower(original)')}, {_ASCII.format('reverse(lower(replacement))')}) AS BIGINT) AS reversed FROM proposals")
def fn_levenshtein(v):
    """Edits from what was read to what is proposed, and to its reverse."""
    old, new = F.lower("original"), F.lower("replacement")
    return v.proposals.select("proposal_id", F.levenshtein(old, new).cast("long").alias("d"), F.levenshtein(old, F.reverse(new)).cast("long").alias("reversed"))


_HALVES = "SELECT DISTINCT page_index, seq, lower(substr(text, 1, length(text) // 2)) AS head, lower(substr(text, length(text) // 2 + 1)) AS tail FROM words WHERE length(text) >= 6"


@query("fn_join_score", "SELECT page_index, seq, CAST(CASE WHEN head || tail IN (SELECT token FROM lexicon) THEN 96 WHEN head IN (SELECT token FROM lexicon) AND tail IN (SELECT token FROM lexicon) THEN 88 ELSE 70 END AS BIGINT) AS score FROM halves", {"halves": _HALVES})
def fn_join_score(v):
    half = F.floor(F.length("text") / 2).cast("int")
    halves = v.words.where("length(text) >= 6").select("page_index", "seq", F.lower(F.substring("text", F.lit(1), half)).alias("head"), F.lower(F.substring("text", half + 1, F.length("text"))).alias("tail"))
    return spelling.join_score(halves, v.lexicon).select("page_index", "seq", "score")


_CORES = f"SELECT DISTINCT {_STRIP.format('text')} AS token FROM words WHERE {_STRIP.format('text')} <> '' AND lower({_STRIP.format('text')}) NOT IN (SELECT token FROM lexicon)"


@query(
    "fn_spell_score",
    """SELECT token, CASE WHEN regexp_matches(token, '^\\p{Lu}') THEN least(sc, 60) ELSE sc END AS score FROM (
      SELECT token, sc FROM confused UNION ALL SELECT token, CASE min(distance) WHEN 1 THEN 72 ELSE 55 END FROM near GROUP BY token)""",
    {
        "tk": _CORES, "patterns": _PATTERNS, "pieces": _SPLIT,
        "confused": """SELECT token, CASE WHEN count(*) > 1 THEN 78 WHEN length(token) < 4 THEN 84 ELSE 92 END AS sc
          FROM (SELECT token, list_reduce(ps[1:i], lambda a, b: a || old || b) || new || list_reduce(ps[i + 1:], lambda a, b: a || old || b) AS candidate FROM (SELECT *, unnest(generate_series(1, len(ps) - 1)) AS i FROM pieces)) WHERE lower(candidate) IN (SELECT token FROM lexicon) GROUP BY token""",
        **_near("SELECT token, lower(token) AS w FROM tk WHERE token NOT IN (SELECT token FROM confused) AND length(token) >= 4 AND NOT regexp_full_match(token, '\\p{Lu}+')"),
    },
)
def fn_spell_score(v):
    """By confusion, else by suggestion, for every unknown word."""
    cores = v.texts.select(T.strip(F.col("text")).alias("token")).distinct().where("token <> ''")
    unknown = spelling.known(cores, v.lexicon).where("NOT known").select("token")
    return spelling.spell_scores(unknown, v.lexicon).select("token", F.col("score").cast("int").alias("score"))


_SYM = r"\*|†|‡|§|‖|¶|\|\|"
_BARE = r"trim(regexp_replace(regexp_replace(trim(token), '^\(+', ''), '[.),]+$', ''))"
_DIG = "translate({0}, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')"
_NOTE = rf"CASE WHEN regexp_full_match({_BARE}, '{_SYM}') THEN {_BARE} WHEN trim(token) IN ('!', '?') THEN trim(token) WHEN regexp_full_match({_BARE}, '[0-9]{{1,2}}') THEN {_BARE} WHEN regexp_full_match({_BARE}, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+') THEN {_DIG.format(_BARE)} ELSE nullif(regexp_extract(trim(token), '^({_SYM})\p{{L}}', 1), '') END"


@query("fn_note_marker", f"SELECT token, {_NOTE} AS marker FROM tk", _BEFORE)
def fn_note_marker(v):
    return marked(v, suffix=False).select("token", T.note_marker(F.col("token")).alias("marker"))


_T = "regexp_replace(token, '[.,;:)]+$', '')"
_WORD = rf"coalesce(CASE WHEN regexp_matches(token, '\p{{L}}.*[^\p{{L}}\p{{N}}\s!]!$') THEN '!' WHEN regexp_matches(token, '\p{{L}}.*[^\p{{L}}\p{{N}}\s?]\?$') THEN '?' END, CASE WHEN regexp_full_match({_T}, '{_SYM}') THEN {_T} END, nullif(regexp_extract({_T}, '\p{{L}}.*?(\|\||[*†‡§‖¶])$', 1), ''), nullif({_DIG.format(f"regexp_extract({_T}, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+$')")}, ''), nullif(regexp_extract({_T}, '\p{{L}}{{2}}[,;:.]*([0-9]{{1,2}})$', 1), ''))"


@query("fn_word_marker", f"SELECT token, {_WORD} AS marker FROM tk", _AFTER)
def fn_word_marker(v):
    return marked(v).select("token", T.word_marker(F.col("token")).alias("marker"))


@query("fn_strip_word_marker", f"SELECT token, CASE WHEN marker IS NULL THEN NULL WHEN ends_with(c, marker) THEN c[:length(c) - length(marker)] || tail WHEN ends_with(c, translate(marker, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')) THEN c[:length(c) - length(marker)] || tail ELSE c || tail END AS stripped FROM (SELECT token, {_WORD} AS marker, {_T} AS c, regexp_extract(token, '[.,;:)]*$') AS tail FROM tk)", _AFTER)
def fn_strip_word_marker(v):
    m = marked(v).withColumn("marker", T.word_marker(F.col("token")))
    return m.select("token", F.when(F.col("marker").isNotNull(), T.strip_word_marker(F.col("token"), F.col("marker"))).alias("stripped"))


@query("fn_strip_note_marker", f"SELECT token, CASE WHEN marker IS NULL THEN NULL WHEN starts_with(trim(token), marker) AND regexp_matches(substr(trim(token), length(marker) + 1), '^\\p{{L}}') THEN substr(trim(token), length(marker) + 1) ELSE '' END AS stripped FROM (SELECT token, {_NOTE} AS marker FROM tk)", _BEFORE)
def fn_strip_note_marker(v):
    m = marked(v, suffix=False).withColumn("marker", T.note_marker(F.col("token")))
    return m.select("token", F.when(F.col("marker").isNotNull(), T.strip_note_marker(F.col("token"), F.col("marker"))).alias("stripped"))


@query("fn_ends_sentence", "SELECT token FROM tk WHERE regexp_matches(token, '[.!?][\"''”’)\\]]*$')", _AFTER)
def fn_ends_sentence(v):
    return marked(v).where(T.ends_sentence(F.col("token")))


_ES = "regexp_replace(token, '[”’\"'')\\]]+$', '')"
_EB = f"regexp_replace({_ES}, '\\.$', '')"


@query(
    "fn_ends_sentence_ui",
    rf"""SELECT token, regexp_matches({_ES}, '[!?]$') OR (ends_with({_ES}, '.') AND regexp_matches({_EB}, '\p{{L}}{{3}}$') AND NOT contains({_EB}, '.') AND lower(regexp_replace({_EB}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) NOT IN ({', '.join(f"'{a}'" for a in T.ABBREVIATIONS)})
    AND NOT (regexp_full_match(regexp_replace({_EB}, '^[“‘"''(\[]+', ''), 'm*(c[md]|d?c{{0,3}})(x[cl]|l?x{{0,3}})(i[xv]|v?i{{0,3}})') AND regexp_replace({_EB}, '^[“‘"''(\[]+', '') <> '')) AS ends FROM tk""",
    _TK,
)
def fn_ends_sentence_ui(v):
    return tokens(v).select("token", T.ends_sentence_ui(F.col("token")).alias("ends"))


@query("fn_capitalise", "SELECT token, regexp_extract(token, '^[“‘\"''(\\[]*') || upper(substr(token, length(regexp_extract(token, '^[“‘\"''(\\[]*')) + 1, 1)) || substr(token, length(regexp_extract(token, '^[“‘\"''(\\[]*')) + 2) AS capital FROM tk WHERE NOT contains(token, 'ß')", _BEFORE)
def fn_capitalise(v):
    return marked(v, suffix=False).where(~F.contains("token", F.lit("ß"))).select("token", T.capitalise(F.col("token")).alias("capital"))


_KIND = r"CASE WHEN regexp_full_match(c, '\p{N}') THEN 'num' WHEN regexp_full_match(c, '[.,;:!?''\"‘’“”()–—-]') THEN 'punct' WHEN regexp_full_match(c, '[\p{L}\p{M}\s]') THEN NULL ELSE 'sym' END"
_CHARS = {**_AFTER, "cs": f"SELECT token, i, c, {_KIND} AS kind FROM (SELECT token, unnest(generate_series(1, length(token))) AS i, unnest(string_split(token, '')) AS c FROM tk)"}


@query("fn_char_kind", "SELECT c, any_value(kind) AS kind, count(*) AS n FROM cs GROUP BY c", _CHARS)
def fn_char_kind(v):
    chars = marked(v).select(F.explode(F.filter(F.split("token", ""), lambda c: c != "")).alias("c"))
    return chars.groupBy("c").agg(F.count("*").alias("n")).select("c", T.char_kind(F.col("c")).alias("kind"), "n")


@query("fn_char_runs", "SELECT token, min(i) AS at, string_agg(c, '' ORDER BY i) AS run, any_value(kind) AS kind FROM (SELECT *, i - row_number() OVER (PARTITION BY token, kind ORDER BY i) AS g FROM cs) GROUP BY token, kind, g", _CHARS)
def fn_char_runs(v):
    from pyspark.sql import Window

    chars = marked(v).select("token", F.posexplode(F.filter(F.split("token", ""), lambda c: c != "")).alias("i", "c")).withColumn("i", (F.col("i") + 1).cast("long"))
    kinds = chars.withColumn("kind", T.char_kind(F.col("c")))
    runs = kinds.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("token", "kind").orderBy("i")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "")
    return runs.groupBy("token", "kind", "g").agg(F.min("i").alias("at"), joined.alias("run")).select("token", "at", "run", "kind")


@query("fn_clip", "SELECT page_index, line_no, CASE WHEN length(line) <= 40 THEN line ELSE substr(line, 1, 39) || '…' END AS label FROM lines")
def fn_clip(v):
    return v.lines.select("page_index", "line_no", T.clip(F.col("line")).alias("label"))


@query("fn_xml_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS xml FROM pages")
def fn_xml_escape(v):
    return v.table("pages").select("page_id", T.xml_escape(F.col("html")).alias("xml"))


@query("fn_norm_ws", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def fn_norm_ws(v):
    return v.table("documents").select("doc_id", T.norm_ws(F.col("text")).alias("text"))


@query("fn_extract_json", r"SELECT event_id, props AS json FROM events")
def fn_extract_json(v):
    said = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` done"))
    return v.table("events").select("event_id", T.extract_json(said).alias("json"))


@query("fn_safe_name", r"SELECT page_index, line_no, trim(regexp_replace(regexp_replace(line, '[^\p{L}\p{N} -]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM lines")
def fn_safe_name(v):
    return v.lines.select("page_index", "line_no", T.safe_name(F.col("line")).alias("name"))


_RANGES = "SELECT page_index, CASE page_index % 4 WHEN 0 THEN page_index + 1 || '-' || (page_index + 50) || ', ' || (page_index + 60) WHEN 1 THEN '' WHEN 2 THEN '5-' || page_index % 9 ELSE ' ' || (page_index + 1) || '; x' END AS t FROM book_pages"


@query("fn_parse_ranges", "SELECT page_index, CASE WHEN page_index % 4 = 0 THEN page_index + 1 || '–' || (page_index + 50) || ', ' || (page_index + 60) WHEN page_index % 4 = 2 AND page_index % 9 = 5 THEN '5' WHEN page_index % 4 = 2 AND page_index % 9 > 5 THEN '5–' || page_index % 9 END AS label FROM book_pages")
def fn_parse_ranges(v):
    n = F.col("page_index")
    text = F.when(n % 4 == 0, F.format_string("%d-%d, %d", n + 1, n + 50, n + 60)).when(n % 4 == 1, "").when(n % 4 == 2, F.format_string("5-%d", n % 9)).otherwise(F.format_string(" %d; x", n + 1))
    return v.pages.select("page_index", T.scope_label(T.parse_ranges(text)).alias("label"))


@query("fn_scope_label", "SELECT page_index, page_index || '–' || (page_index + 7) || ', ' || (page_index + 10) AS label FROM book_pages")
def fn_scope_label(v):
    n = F.col("page_index")
    ranges = F.array(F.struct(n.alias("lo"), (n + 7).alias("hi")), F.struct((n + 10).alias("lo"), (n + 10).alias("hi")))
    return v.pages.select("page_index", T.scope_label(ranges).alias("label"))


@query(
    "fn_format_bytes",
    "SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB' WHEN n < 1073741824 THEN CAST(floor(n / 1048576.0::DOUBLE + 0.5) AS BIGINT) || ' MB' ELSE CAST(floor(n / 1073741824.0::DOUBLE * 10 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor(n / 1073741824.0::DOUBLE * 10 + 0.5) AS BIGINT) % 10 || ' GB' END AS size FROM (SELECT event_id, event_id * event_id * event_id * 37 AS n FROM events)",
)
def fn_format_bytes(v):
    e = F.col("event_id").cast("decimal(38,0)")  # cubes of ids beyond 600,000 leave 64 bits
    return v.table("events").select("event_id", T.format_bytes((e * e * e * 37).cast("decimal(38,0)")).alias("size"))


# ---- numerals

_DIGITS = "repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]"
_NUMERALS = {
    "numbers": "SELECT DISTINCT doc_id % 3999 + 1 AS n FROM documents",
    "paged": f"SELECT n, {_DIGITS} AS numeral FROM numbers",
    "old_style": "SELECT DISTINCT repeat('x', CAST(n % 6 AS INTEGER)) || repeat('i', CAST(n // 6 % 5 + 1 AS INTEGER)) AS numeral FROM numbers",
    "valued": "SELECT numeral, list_transform(string_split(numeral, ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 ELSE 0 END) AS vs FROM (SELECT numeral FROM paged UNION SELECT numeral FROM old_style UNION SELECT token FROM tokens)",
    "summed": "SELECT numeral, CAST(list_sum(list_transform(vs, lambda v, i: CASE WHEN v < coalesce(vs[i + 1], 0) THEN -v ELSE v END)) AS BIGINT) AS total FROM valued",
}


def _numbers(v):
    """Page numbers, as far as numerals go."""
    return v.table("documents").select((F.col("doc_id") % 3999 + 1).alias("n")).distinct()


def _numerals(v):
    """The numerals of page numbers, some old ones with many equal letters, and all words: numeral."""
    n = F.col("n")
    old = F.concat(F.repeat(F.lit("x"), (n % 6).cast("int")), F.repeat(F.lit("i"), (F.floor(n / 6) % 5 + 1).cast("int")))
    numbers = _numbers(v)
    return numbers.select(N.to_roman(n).alias("numeral")).union(numbers.select(old)).union(v.tokens.select("token")).distinct()


#: Every number that has a numeral, and how many pages bear it.
_EVERY = {"every": f"SELECT n, count(d.doc_id) AS pages, {_DIGITS} AS numeral FROM (SELECT unnest(generate_series(1, 3999)) AS n) LEFT JOIN documents d ON d.doc_id % 3999 + 1 = n GROUP BY n"}


@query("fn_to_roman", "SELECT n, numeral, pages FROM every", _EVERY)
def fn_to_roman(v):
    borne = v.table("documents").groupBy((F.col("doc_id") % 3999 + 1).alias("n")).agg(F.count("*").alias("pages"))
    every = v.spark.range(1, 4000).select(F.col("id").alias("n")).join(borne, "n", "left")
    return every.select("n", N.to_roman(F.col("n")).alias("numeral"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


@query("fn_roman_value", f"SELECT numeral, CASE WHEN regexp_matches(numeral, '{N.STANDARD}') THEN total END AS value FROM summed", _NUMERALS)
def fn_roman_value(v):
    return _numerals(v).select("numeral", N.roman_value(F.upper("numeral")).cast("long").alias("value"))


@query("fn_roman_old", f"SELECT numeral, CASE WHEN regexp_matches(numeral, '{N.OLD}') THEN total END AS value FROM summed", _NUMERALS)
def fn_roman_old(v):
    return _numerals(v).select("numeral", N.roman_old(F.col("numeral")).cast("long").alias("value"))


@query("fn_roman_info")
def fn_roman_info(v):
    """All words, and the numerals of page numbers with ones for i, and a full stop."""
    misread = _numbers(v).select(F.concat(F.translate(N.to_roman(F.col("n")), "i", "1"), F.lit(".")).alias("token"))
    return misread.union(_numerals(v)).distinct().withColumn("info", N.roman_info(F.col("token"))).select("token", "info.core", "info.value", "info.standard", "info.readings")
