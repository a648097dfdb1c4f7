"""Line-first quality rules against plain Python."""

import re

import pytest
from sumveil.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, n_words string, kept int, _q string, x string"
CLEAN = "\n".join(" ".join(f"{w}{i}" for w in "plain words of a text that nobody cleans".split()) + "." for i in range(9))
TEXTS = [
    None,
    "",
    "  \n\t\n",
    CLEAN,
    CLEAN,
    CLEAN + "\n" + "home | about | news | contact | login",
    "home | about | news | contact | login\n" * 12 + CLEAN[:150],
    "BUY!! NOW!! CHEAP!! STUFF!! " * 20,
    "wo###rd $$$ &&& " * 30,
    "the same three words again " * 40,
    CLEAN + "\nall rights reserved.\n" + "\n".join(f"again{i} and{i} other{i} words{i}." for i in range(9)),
    "no mark at all in this very long line of words " * 5,
    "é漢字\x0b\x0c\r mixed   blanks " + CLEAN,
    "a b c a b c d",
    "a b",
    "long text. " * 60_000,
]


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", None) for i, t in enumerate(TEXTS)] + [(None, CLEAN, None, None, None, None)], SCHEMA)


def test_base_figures(docs):
    rows = {r.doc_id: r for r in qr.verdicts(docs).collect()}
    for i, t in [*enumerate(TEXTS), (None, CLEAN)]:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert not (r.base_failed and r.kept)
    assert [i for i in range(len(TEXTS)) if rows[i].kept] == [3, 4, 5, 10, 12]


def test_failing_lines_are_removed(docs):
    rows = {r.doc_id: r for r in qr.clean(docs).collect()}
    assert set(rows) == {3, 4, 5, 10, 12, None}
    assert rows[5].text == rows[3].text == CLEAN and "reserved" not in rows[10].text
    assert qr.clean(docs).columns == docs.columns


def test_native_and_empty(spark, docs):
    plan = qr.verdicts(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert qr.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0
