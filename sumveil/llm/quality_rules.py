"""Line-first quality rules, in DataFrame expressions only.

Every line that has a word is judged by itself: too many marks or symbols, long and
without any mark, made of separators (navigation), or a short line with a boilerplate
phrase.  Failing lines are removed.  A document is rejected if the removed lines hold
more than a share of its words, or if its base figures fail.

A null or empty text has no words, fails the base figures and keeps an empty text.
Rows are judged one by one: repeated rows give repeated results, an empty table an
empty one, and columns besides the named ones pass through ``clean`` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, keep_where, let, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Words in failing lines, of all words, above which a document goes.
MAX_LOST_PERCENT = 30
#: Per cent of a line's words: doubled marks, separators. Of its characters: symbols.
EMPHASIS_PERCENT, SEPARATOR_PERCENT, SYMBOL_PERCENT = 30, 20, 10
#: A line of so many words has a mark somewhere; one of at most so many can be boilerplate.
UNMARKED_WORDS, BOILERPLATE_WORDS = 20, 25

SYMBOLS = r"[#*$%&|<>]"
EMPHASIS = r"[!?][!?]+"
LINE_SYMBOLS = r"[#*$%&|<>{}^~=_@\\]"
MARKS = r"[.,:;!?\x{2026}\x{3001}\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{0964}]"
SEPARATORS = r"[|>\x{00BB}\x{203A}\x{2022}\x{00B7}]"
#: Without one of these a line passes the rules on marks, symbols and separators.
SUSPECT = r"[!?][!?]|[#*$%&|<>{}^~=_@\\\x{00BB}\x{203A}\x{2022}\x{00B7}]"
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "javascript", "subscribe",
    "sign in", "sign up", "lorem ipsum", "share this", "share on", "click here", "read more", "back to top",
)


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern)).cast("long")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def line_fails(line: Column) -> Column:
    """The rules for one line, cheap tests first; a line without a word passes."""
    n = _count(line, WORD)
    marks_and_symbols = F.rlike(line, F.lit(SUSPECT)) & (
        (100 * _count(line, EMPHASIS) >= EMPHASIS_PERCENT * n)
        | (100 * _count(line, LINE_SYMBOLS) >= SYMBOL_PERCENT * F.length(line))
        | ((_count(line, SEPARATORS) >= 3) & (100 * _count(line, SEPARATORS) >= SEPARATOR_PERCENT * n))
    )
    unmarked = ~F.rlike(line, F.lit(MARKS)) & (n >= UNMARKED_WORDS)
    boilerplate = let(F.lower(line), lambda x: _any([F.contains(x, F.lit(p)) for p in BOILERPLATE])) & (n <= BOILERPLATE_WORDS)
    return marks_and_symbols | unmarked | boilerplate


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    Windows are compared by hash and position in one sorted array; only texts in which
    some hash repeats are sorted.
    """
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(ordered, k - 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(placed), covered))

    return F.coalesce(F.when(F.size(w) >= 3, let(windows, count)), F.lit(0)).cast("long")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with struct ``_q``: base figures, lost words, cleaned text and the verdict."""
    value = F.coalesce(F.col(text), F.lit(""))
    w, lines, bad = F.col("_w"), F.col("_lines"), F.col("_bad")
    full = lambda x: F.filter(x, lambda y: F.rlike(y, F.lit(WORD)))
    return (
        docs.withColumns({"_w": words(F.col(text)), "_lines": F.split(value, "\n", -1)})
        .withColumns({"_bad": F.filter(lines, line_fails), "_distinct": F.array_distinct(lines)})
        .withColumn(
            "_f",
            F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _count(value, SYMBOLS).alias("n_symbols"),
                F.when(F.size("_distinct") == F.size(lines), F.lit(0)).otherwise(F.size(full(lines)) - F.size(full(F.col("_distinct")))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.when(F.size(bad) == 0, value).otherwise(F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n")).alias("clean_text"),
                F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + _count(x, WORD)).alias("n_lost_words"),
            ),
        )
        .withColumn("_base", (F.col("_f.n_words") < MIN_WORDS) | (100 * F.col("_f.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_f.n_words")))
        .withColumn("_q", F.struct("_f.*", F.col("_base").alias("base_failed"), (~F.col("_base") & (100 * F.col("_f.n_lost_words") <= MAX_LOST_PERCENT * F.col("_f.n_words"))).alias("kept")))
        .drop("_w", "_lines", "_bad", "_distinct", "_f", "_base")
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base figures, base_failed, n_lost_words and kept."""
    return judge(docs.select("doc_id", "text")).select("doc_id", "_q.*").drop("clean_text")


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with failing lines removed, in the input's columns."""
    new = {"text": F.col("_q.clean_text"), "n_chars": F.length("_q.clean_text").cast("long")}
    return keep_where(judge(docs), F.col("_q.kept"), [new.get(c, F.col(c)).alias(c) for c in docs.columns])


def _sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    phrase = " OR ".join(f"contains(lower(x), {q(p)})" for p in BOILERPLATE)
    n = lambda x, p: f"len(regexp_extract_all({x}, {q(p)}))"
    has = lambda x, p: f"regexp_matches({x}, {q(p)})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {q(WORD)}) AS w FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
lx AS (SELECT doc_id, x, {n("x", WORD)} AS n FROM l),
lr AS (SELECT doc_id, x, n, n > 0 AND (100 * {n("x", EMPHASIS)} >= {EMPHASIS_PERCENT} * n OR 100 * {n("x", LINE_SYMBOLS)} >= {SYMBOL_PERCENT} * length(x)
  OR (n >= {UNMARKED_WORDS} AND NOT {has("x", MARKS)}) OR ({n("x", SEPARATORS)} >= 3 AND 100 * {n("x", SEPARATORS)} >= {SEPARATOR_PERCENT} * n)
  OR (n <= {BOILERPLATE_WORDS} AND ({phrase}))) AS bad FROM lx),
la AS (SELECT doc_id, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS lost, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS dup FROM lr GROUP BY 1),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g2),
g4 AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE k >= 2),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM g4 GROUP BY 1),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {n("t", SYMBOLS)}::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
  coalesce(rep, 0)::BIGINT AS n_repeat_words, lost AS n_lost_words FROM w JOIN la USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words AS kept FROM b"""


SQL = _sql()
