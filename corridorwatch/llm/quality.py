"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

Every line (cut at ``\\n``) that has a word is judged by three rules and removed if one holds:

* punctuation: more than a fifth of its characters are symbols, or it has fewer than four
  words and no closing punctuation mark;
* navigation: two or more separators between entries;
* boilerplate: it contains one of the fixed phrases, in any case.

A document fails its base checks with fewer than ten words or too many repeated five-word
windows; it is rejected if the removed lines held more than half of its word characters.

Defined results: a null text counts as empty (no words, base check failed, nothing kept, no
clean text); lines without a word are kept as they are; repeated rows are judged each;
other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MIN_LINE_WORDS = 4

#: Fixed values.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&|<>{}[]~^=@!"
CLOSING = ".!?…:;\"')”»"
SEPARATORS = "|»›·•"
BOILERPLATE = (
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "licensed under",
    "click here",
    "sign up",
    "log in",
    "subscribe",
    "javascript",
    "lorem ipsum",
)

_LINE_SYMBOLS = re.compile("[" + re.escape(LINE_SYMBOLS) + "]")
_SEPARATORS = re.compile("[" + re.escape(SEPARATORS) + "]")
_BOILERPLATE = re.compile("|".join(BOILERPLATE))

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines_removed bigint, chars_removed bigint, clean_text string"
)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of ``width`` words that occurs at least twice in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    window = code[:n]
    for k in range(1, width):
        # windows get dense numbers after every word, so the numbers never overflow
        _, window = np.unique(window * len(ids) + code[k : k + n], return_inverse=True)
    repeated = np.bincount(window)[window] > 1
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, np.flatnonzero(repeated), 1)
    np.add.at(steps, np.flatnonzero(repeated) + width, -1)
    return int((np.cumsum(steps) > 0).sum())


def line_fails(line: str, n_words: int, n_chars: int) -> bool:
    """n_chars: characters of the line's words."""
    if 5 * len(_LINE_SYMBOLS.findall(line)) > n_chars:
        return True
    if n_words < MIN_LINE_WORDS and line.rstrip(SPACES)[-1] not in CLOSING:
        return True
    if len(_SEPARATORS.findall(line)) >= 2:
        return True
    return _BOILERPLATE.search(_lower(line)) is not None


_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _lower(line: str) -> str:
    return line.translate(_UPPER)


def _word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def judge(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # splits bytes at ASCII white space
    n_words, word_chars = len(words), _word_chars(text)
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup, n_removed, chars_removed, seen, left = 0, 0, 0, set(), []
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            n_dup += line in seen
            seen.add(line)
            chars = _word_chars(line)
            if line_fails(line, n, chars):
                n_removed += 1
                chars_removed += chars
                continue
        left.append(line)
    n_repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEATED_PERCENT * n_words
    kept = not failed and 2 * chars_removed <= word_chars
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, kept, n_removed, chars_removed, "\n".join(left) if kept else None


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The figures, the verdict and the cleaned text (null if rejected) of every row."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batch: dict) -> dict:
        made = [judge(t) for t in batch["text"]]
        return dict(zip(names, [batch["doc_id"], *(list(c) for c in zip(*made))]))

    given = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(given, run, SCHEMA)


def _ere(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]^\\-" else c for c in chars) + "]"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_W = r"'[^\x20\x09-\x0D]+'"
#: DuckDB SQL of the query's columns.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, {_W}) AS words FROM d),
pos AS (SELECT rid, generate_subscripts(words, 1) AS i, words FROM w),
win AS (SELECT rid, i, list_slice(words, i, i + 4) AS five FROM pos WHERE i + 4 <= len(words)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win),
cover AS (SELECT DISTINCT rid, i + k AS j FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1),
reps AS (SELECT rid, count(*) AS n_repeat FROM cover GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
lined AS (SELECT rid, l, len(regexp_extract_all(l, {_W})) AS nw, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS nc FROM line),
judged AS (
  SELECT rid, l, nc,
    5 * len(regexp_extract_all(l, {_sql(_ere(LINE_SYMBOLS))})) > nc
    OR (nw < {MIN_LINE_WORDS} AND NOT regexp_matches(l, {_sql(_ere(CLOSING) + '[\\x20\\x09-\\x0D]*$')}))
    OR len(regexp_extract_all(l, {_sql(_ere(SEPARATORS))})) >= 2
    OR regexp_matches(l, {_sql('(?i)' + '|'.join(BOILERPLATE))}) AS bad
  FROM lined WHERE nw > 0),
lines AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup, coalesce(sum(CASE WHEN bad THEN nc END), 0) AS gone
  FROM judged GROUP BY rid),
base AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, {_sql(_ere(SYMBOLS))})) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, coalesce(gone, 0) AS gone
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN reps USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND 2 * gone <= word_chars AS kept
FROM base
"""
