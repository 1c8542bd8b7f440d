"""Quality rules: line-first cleaning. DataFrame functions only, no shuffle: every document is judged in its own row.

Each line is tested for its ending, navigation, symbols, shouting and boilerplate; failing lines go, and a document that
loses too much of its text, or that has too few words or too many repeated passages, is rejected.

Defined results: a null text is an empty one, has no words and is rejected; lines without a word are kept as they are
and count for nothing; repeated rows are judged each for itself, equally; extra columns pass through untouched, and
columns of the operator's own names are replaced; an empty table gives an empty table; texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space within a line; a line's end is looked at without it, so that line feeds and carriage returns are one.
SPACE = " \t\r\x0b\x0c"
#: Code points that end a sentence, and quotes and brackets that may close behind them.
ENDS = ".!?…。！？:;"
CLOSERS = "\"'”’»)]"
#: Between the links of a menu: blanks around a bar, a bullet or an arrow, which may end the line.
LINK_SEPARATOR = r"[ \t\r\x0B\f][|•·»›>](?:[ \t\r\x0B\f]|\z)"
#: What pages repeat about themselves.
BOILERPLATE = (
    r"all cookies|cookie policy|cookie settings|uses cookies|privacy policy|terms of use|terms of service|enable javascript|"
    r"sign in to|sign up for|log in to|click here to|subscribe to our|skip to content|skip to main content|lorem ipsum"
)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    #: Percent of the words that may lie in windows of window_words words found twice or more.
    max_repeat_percent: int = 30
    window_words: int = 8
    #: A line goes if so many separators of links are in it,
    nav_separators: int = 2
    #: if over this percent of its words hold or are symbols,
    max_symbol_percent: int = 40
    #: if it has so many words of two letters or more and over this percent of them are in capitals,
    shout_words: int = 4
    max_shout_percent: int = 60
    #: if it holds phrases that pages repeat about themselves, and no more than so many words for each of them (a long
    #: paragraph that names a privacy policy once is no boilerplate),
    boilerplate_words: int = 60
    #: or if it has so many words and doesn't end as a sentence does, unless it ends with a digit or is the last line with
    #: a word.
    unended_words: int = 12
    #: Percent of the words that a document may lose with its lines.
    max_lost_percent: int = 50


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+"))


def _joined(left: str, right: str, step: Column) -> Column:
    """Hashes of the windows of left, each with that of right which begins step words after it."""
    n = F.greatest(F.size(right) - step, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, step + 1, n), lambda a, b: F.xxhash64(a, b))


def line_verdict(line: Column, last: Column, rules: QualityRules = QualityRules()) -> Column:
    """Why a line fails: null if it doesn't. Lines without a word never fail, the last one that has any not for its end."""
    n = _n_words(line)
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]+"))
    letters = F.regexp_count(line, F.lit(r"\p{L}{2,}"))
    shouts = F.regexp_count(line, F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})"))
    bare = F.rtrim(line, F.lit(SPACE))
    ended = F.contains(F.lit(ENDS), F.right(F.rtrim(bare, F.lit(CLOSERS)), F.lit(1))) & (F.rtrim(bare, F.lit(CLOSERS)) != "")
    phrases = F.regexp_count(F.lower(line), F.lit(BOILERPLATE))
    # The cheap tests that most lines don't pass stand before the dear ones.
    return (
        F.when(~line.rlike(r"[^\x20\x09-\x0D]"), None)
        .when(F.regexp_count(bare, F.lit(LINK_SEPARATOR)) >= rules.nav_separators, "navigation")
        .when((symbols > 1) & (symbols * 100 > n * rules.max_symbol_percent), "symbols")
        .when(line.rlike(r"\p{Lu}\p{Lu}[^\p{Ll}]{0,3}\p{Lu}") & (letters >= rules.shout_words) & (shouts * 100 > letters * rules.max_shout_percent), "shouting")
        .when((phrases > 0) & (n <= phrases * rules.boilerplate_words), "boilerplate")
        .when(~last & ~ended & ~F.right(bare, F.lit(1)).rlike("[0-9]") & (n >= rules.unended_words), "punctuation")
    )


def judge(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words (long), line_reasons (array of the
    reasons of the lines that went), cleaned_text, base_failed and kept (boolean) to the rows of docs."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "line_reasons", "cleaned_text", "base_failed", "kept")
    passed = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    w = rules.window_words

    # Steps that a later step reads more than once are columns of their own, so that each is computed once.
    last = F.length(F.regexp_replace(F.rtrim(t, F.lit(SPACE + "\n")), r"[^\n]+", ""))
    first = docs.select(*passed, t.alias("_t"), F.split(t, "\n").alias("_lines"), last.alias("_last"), _words(t).alias("_words"))
    # Hashes of one word, then of windows twice as long or a word longer, until they are w words long.
    hashed = first.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x))).withColumn("_one", F.col("_hashes"))
    for bit in bin(w)[3:]:
        hashed = hashed.withColumn("_hashes", _joined("_hashes", "_hashes", F.size("_words") - F.size("_hashes") + 1)).withColumn("_hashes", F.col("_hashes"))
        if bit == "1":
            hashed = hashed.withColumn("_hashes", _joined("_hashes", "_one", F.size("_words") - F.size("_hashes") + 1))
    second = hashed.select(
        *passed, "_t", "_hashes",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.filter("_lines", lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_worded"),
        F.transform("_lines", lambda x, i: F.struct(x.alias("line"), line_verdict(x, i == F.col("_last"), rules).alias("why"))).alias("_judged"),
    )
    # Only where some window occurs twice are the windows sorted by hash, so that equal ones are neighbours.
    ordered = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    third = second.select(
        *passed, "n_words", "word_chars",
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        ordered.alias("_ordered"), F.filter("_judged", lambda x: x.why.isNull()).alias("_stay"), F.filter("_judged", lambda x: x.why.isNotNull()).alias("_go"),
    )
    n = F.size("_ordered")
    marked = F.zip_with(
        F.zip_with("_ordered", F.concat(F.array(F.lit(None).cast("bigint")), F.transform("_ordered", lambda x: x.h)), lambda x, h: F.struct(x.h.alias("h"), x.i.alias("i"), h.eqNullSafe(x.h).alias("same"))),
        F.slice(F.transform("_ordered", lambda x: x.h), 2, F.greatest(n, F.lit(1))),
        lambda x, h: F.when(x.i.isNotNull() & (x.same | h.eqNullSafe(x.h)), x.i),
    )
    starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    start = F.struct(F.lit(-w).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, start, lambda acc, i: F.struct(i.alias("at"), (acc.n + F.least(F.lit(w), i - acc.at)).alias("n")), lambda acc: acc.n)
    fourth = third.select(
        *passed, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(n == 0, 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.aggregate("_go", F.lit(0), lambda a, x: a + _n_words(x.line)).cast("long").alias("n_lost_words"),
        F.transform("_go", lambda x: x.why).alias("line_reasons"),
        F.array_join(F.transform("_stay", lambda x: x.line), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    good = (F.col("n_lost_words") * 100 <= F.col("n_words") * rules.max_lost_percent) & (F.col("n_words") - F.col("n_lost_words") >= rules.min_words)
    return fourth.select("*", failed.alias("base_failed"), (~failed & good).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The judged rows that are kept. Rows are dropped by a generator: a filter would be pushed below the projections, and
    all of their expressions copied into it."""
    judged = judge(docs, text, rules)
    return judged.withColumn("_kept", F.explode(F.filter(F.array("kept"), lambda k: k))).drop("_kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")


#: The same in DuckDB. Windows are compared as texts, not by hash.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, i - p)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -7) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) = len(ls) AS last, unnest(list_transform(ls, lambda x: rtrim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS bare FROM w),
feat AS (SELECT doc_id, l, last, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
  len(regexp_extract_all(bare, '[ \t\r\x0B\f][|•·»›>](?:[ \t\r\x0B\f]|\z)')) AS nav,
  len(regexp_extract_all(l, '[#*$%&|<>]+')) AS sym,
  len(regexp_extract_all(l, '\p{L}{2,}')) AS letters,
  len(list_filter(regexp_extract_all(l, '\p{L}+'), lambda x: regexp_full_match(x, '\p{Lu}{2,}'))) AS shout, regexp_matches(l, '\p{Lu}\p{Lu}[^\p{Ll}]{0,3}\p{Lu}') AS loud,
  len(regexp_extract_all(lower(l), 'all cookies|cookie policy|cookie settings|uses cookies|privacy policy|terms of use|terms of service|enable javascript|sign in to|sign up for|log in to|click here to|subscribe to our|skip to content|skip to main content|lorem ipsum')) AS boil,
  regexp_matches(bare, '[.!?…。！？:;]["''”’»)\]]*\z') AS ended, regexp_matches(bare, '[0-9]\z') AS digit FROM lines),
lost AS (SELECT doc_id, sum(n) AS n FROM feat WHERE nav >= 2 OR (sym > 1 AND sym * 100 > n * 40) OR (loud AND letters >= 4 AND shout * 100 > letters * 60) OR (boil > 0 AND n <= 60 * boil) OR (n >= 12 AND NOT last AND NOT ended AND NOT digit) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_lost_words * 100 <= n_words * 50 AND n_words - n_lost_words >= 20 AS kept FROM g
"""
