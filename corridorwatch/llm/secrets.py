"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

Base patterns find key assignments, access keys and long hexadecimal runs. The lexer reads
name-operator-value statements (``=``, ``:=``, ``:``, ``=>``) wherever one stands, also inside
the value of another, keeps the literals bound to names (those of a bracket or call too, but
for what an inner name binds), follows names used as values (also joined with ``+``), and
scores each literal by the most sensitive name it reaches; literals that score high enough
become spans of kind ``literal``. So do the passwords of URLs and the texts of elements with sensitive
names. Scores go back along the names in one pass. Base spans always stay.

Defined results: a null or empty text has no spans; positions count code points, end
exclusive; whole texts are read; repeated rows are scanned each; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows

#: Kinds in output order.
KINDS = ("assign", "access", "hex", "literal")

MIN_SCORE = 3.0

#: What names hold, and how much it says about the value. Long words count anywhere in a name,
#: short ones only as a part of it, split at case and punctuation.
ANYWHERE = {
    "password": 3.0,
    "passwd": 3.0,
    "passphrase": 3.0,
    "secret": 3.0,
    "apikey": 3.0,
    "privatekey": 3.0,
    "accesskey": 3.0,
    "credential": 2.5,
}
PARTS = {
    "pwd": 3.0,
    "pass": 3.0,
    "token": 2.5,
    "tokens": 2.5,
    "bearer": 2.0,
    "auth": 1.5,
    "key": 1.0,
    "keys": 1.0,
}
INNOCENT = ("secretary", "secretariat")
#: Words that stand for a value to come, at the start of a part and as a whole part.
OPENINGS = ("example", "changeme", "placeholder", "dummy", "your", "xxxx")
WHOLE = ("none", "null", "true", "false", "todo")
#: A longer random value holds such a short word by chance, so there it says nothing.
CHANCE = 400


def _either_case(word: str) -> str:
    """ASCII letters in both cases, and nothing else that a case-folding match would let in."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run that is too short has no long enough run inside it: the bound may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("pass", "secret", "token", "api")

# The runs are possessive and start behind no name character, so a text is passed over once.
_HEAD = re.compile(r"""(?<![A-Za-z0-9_.\-])(?P<name>[A-Za-z0-9_.\-]++)(?P<quote>\\*+["']\]?)?[\x20\t]*+(?::=|=>|=(?!=)|:(?!//))[\x20\t]*+""")
_QUOTE = re.compile(r"""(?:[bBfFrRuU]{1,2}(?=["']))?(\\+["']|"{3}|'{3}|["'])""")
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+(?={q})") for q in "\"'"}
_BARE = re.compile(r"""[^\s"';,(){}\[\]]++""")
_CHAIN = re.compile(r"[\x20\t]+(?::=|=>|=(?!=))[\x20\t]*")
_JOIN = re.compile(r"[\x20\t]*(?:\+|\|\||\?\?|or\b)[\x20\t]*")
_GAP = re.compile(r"[\s,;+|?]+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: A value that is filled in elsewhere.
_TEMPLATE = re.compile(r"\$\{[^}]*\}|\$\([^)]*\)|\$[A-Z_][A-Z0-9_]*|%\([^)]*\)[a-z]|%[A-Z_]+%|%[a-z]|\{\{?[^{}]*\}?\}|<[^<>]*>")
_URL = re.compile(r"""(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*+://[^\s/:@"'<>]*+:([^\s/@"'<>]++)@""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)[^<>]*+>([^<>]++)</")
_CLOSED = re.compile(r"\s*(?:[,)}\]]|$)")
_LINE_END = re.compile(r"[\x20\t]*(?:$|[\n;,)}\]])")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _entropy(value: str) -> float:
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values()) if value else 0.0


def name_score(name: str) -> float:
    plain = re.sub(r"[^a-z0-9]", "", name.lower())
    found = [s for word, s in ANYWHERE.items() if word in plain and not any(w in plain for w in INNOCENT)]
    found += [PARTS[p] for p in (part.lower() for part in _NAME_PART.findall(name)) if p in PARTS]
    return max(found + [PARTS["pwd"]] * (plain.endswith("pwd") or plain.startswith("pwd")), default=0.0)


def stands_for_other(value: str) -> bool:
    """Templates, and words that say a value is still to come."""
    if _TEMPLATE.fullmatch(value):
        return True
    parts = [p.lower() for p in re.findall(r"[A-Za-z]+", value)] if len(value) <= CHANCE else []
    return any(p.startswith(OPENINGS) or p in WHOLE for p in parts)


def literal_score(value: str, quoted: bool = False) -> float:
    """What the literal itself says; far below zero for what cannot be a secret.

    Quoted words with blanks say nothing by themselves: their name alone decides.
    """
    if len(value) < 6 or stands_for_other(value):
        return -10.0
    if any(c.isspace() for c in value):
        return 0.0 if quoted and len(value) >= 12 else -10.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if len(value) < 8 and kinds < 3:
        return -10.0
    return (0.5 if _entropy(value) >= 2.5 else -2.0) + (0.5 if kinds >= 2 else -1.5)


class _Reader:
    """The statements of a text and the literals and names that each one binds.

    Statements are found at every operator, whatever stands around them: inside brackets,
    calls, quoted text or other values. They are read from the last to the first, so a value
    in brackets passes over the statements inside it, whose literals are theirs.
    """

    def __init__(self, text: str) -> None:
        self.text, self.n = text, len(text)
        self.heads = list(_HEAD.finditer(text))
        self.at = {m.start(): i for i, m in enumerate(self.heads)}
        self.starts = {m.end(): i for i, m in enumerate(self.heads)}
        self.ends = [0] * len(self.heads)
        #: Statements that stand inside the brackets of another one.
        self.inner = [False] * len(self.heads)
        self.items: list[list[tuple[int, int, bool]]] = [[] for _ in self.heads]
        for i in range(len(self.heads) - 1, -1, -1):
            self.items[i], self.ends[i] = self._value(self.heads[i].end())

    def _quoted(self, m: re.Match) -> tuple[int, int, int]:
        """Start and end of the literal behind an opening quote, and where to read on."""
        text, quote, start = self.text, m[1], m.end()
        if quote in _QUOTED and (found := _QUOTED[quote].match(text, start)):
            return start, found.end(), found.end() + 1
        line = text.find("\n", start)
        end = text.find(quote, start, self.n if len(quote) == 3 and quote[0] != "\\" or line < 0 else line)
        if end >= 0:
            return start, end, end + len(quote)
        bare = _BARE.match(text, start)  # the closing quote is missing
        end = bare.end() if bare else start
        return start, end, end

    def _bare(self, at: int) -> tuple[int, int, bool] | None:
        """Start and end of a bare word, and whether it only names what the value behind it is bound to."""
        text = self.text
        m = _BARE.match(text, at)
        if not m:
            return None
        end, after = m.end(), text[m.end() : m.end() + 1]
        word = text[at:end]
        if word[-1] in "=:" and after and after in "\"'([{\\" and at in self.at:
            return at, end, True
        if word[-1] == "+" and len(word) > 1 and not _LINE_END.match(text, end):
            end = at + len(word.rstrip("+"))
        return at, max(end, at + 1), False

    def _value(self, at: int) -> tuple[list[tuple[int, int, bool]], int]:
        """Literals (start, end, bare) from here on, and the end of the value."""
        text, found = self.text, []
        while at < self.n:
            if q := _QUOTE.match(text, at):
                start, end, at = self._quoted(q)
                found.append((start, end, False))
            elif text[at] in "([{":
                at = self._group(at, found)
            elif word := self._bare(at):
                start, at, names = word
                if names or (chain := _CHAIN.match(text, at)):
                    at = at if names else chain.end()
                    if (same := self.starts.get(at)) is None:
                        continue
                    found += self.items[same]
                    return found, self.ends[same]
                found.append((start, at, True))
                if text[at : at + 1] and text[at] in "([{":
                    at = self._group(at, found)
            if not (join := _JOIN.match(text, at)):
                break
            at = join.end()
        return found, at

    def _group(self, at: int, found: list) -> int:
        """Reads a bracket to its end: its literals, but for those that a statement inside it binds."""
        text, depth, first, line = self.text, 0, len(found), None
        fresh = False
        while at < self.n:
            if gap := _GAP.match(text, at):
                fresh |= "," in gap[0]
                line = len(found) if line is None and "\n" in gap[0] else line
                at = gap.end()
                continue
            char = text[at]
            if char in "([{":
                at, depth, fresh = at + 1, depth + 1, True
                continue
            if char in ")]}":
                at, depth, fresh = at + 1, depth - 1, False
                if not depth:
                    return at
                continue
            q = _QUOTE.match(text, at)
            head = self.at.get(q.end() if q else at)
            if head is not None and (not q or self.heads[head]["quote"]):
                self.inner[head] = True
                at, fresh = self.ends[head], False
            elif q:
                start, end, at = self._quoted(q)
                found.append((start, end, False))
                fresh = False
            elif word := _BARE.match(text, at):
                if fresh and _CLOSED.match(text, word.end()):
                    found.append((at, word.end(), True))
                at, fresh = word.end(), False
            else:
                at += 1
        # the bracket is never closed: only its line counts
        del found[len(found) if line is None else max(line, first) :]
        return at


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals whose bound names, directly or through other names, are sensitive."""
    read = _Reader(text)
    # per name the statement that bound it last; a name inside brackets (an argument, a key) doesn't
    # replace what a statement of its own has bound
    bound: dict[str, int] = {}
    inner: dict[str, int] = {}
    longest, count = 0, len(read.heads)
    spans: list[list[tuple[int, int, bool]]] = [[] for _ in range(count)]
    uses: list[list[int]] = [[] for _ in range(count)]
    scores = [0.0] * count
    known = lambda name: name in bound or name in inner
    for i, m in enumerate(read.heads):
        name = m["name"].lstrip("0123456789.-")
        if not name:
            continue
        for start, end, bare in read.items[i]:
            for a, b in _operands(text, start, end, known, longest) if bare else ((start, end),):
                word = text[a:b] if bare and b - a <= longest else None
                if word is not None and known(word):
                    uses[i] += [where[word] for where in (bound, inner) if word in where]
                elif a < b:
                    spans[i].append((a, b, not bare))
        (inner if read.inner[i] else bound)[name] = i
        longest = max(longest, len(name))
        scores[i] = name_score(name)
    # names are used behind the statements that bind them: one pass from the end takes every score back
    best: dict[tuple[int, int, bool], float] = {}
    for i in range(count - 1, -1, -1):
        if score := scores[i]:
            for span in spans[i]:
                best[span] = max(best.get(span, 0.0), score)
            for j in uses[i]:
                scores[j] = max(scores[j], score)
    return [("literal", a, b) for (a, b, quoted), score in best.items() if score + literal_score(text[a:b], quoted) >= MIN_SCORE]


def marked_spans(text: str) -> list[tuple[str, int, int]]:
    """Passwords of URLs, and texts of elements with sensitive names."""
    found = []
    if "://" in text:
        found += [m.span(1) for m in _URL.finditer(text) if len(m[1]) >= 4 and not stands_for_other(m[1])]
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            start, end = m.span(2)
            while start < end and text[start].isspace():
                start += 1
            while start < end and text[end - 1].isspace():
                end -= 1
            if (score := name_score(m[1])) and score + literal_score(text[start:end], True) >= MIN_SCORE:
                found.append((start, end))
    return [("literal", a, b) for a, b in found]


def _operands(text: str, start: int, end: int, known: Callable[[str], bool], longest: int) -> list[tuple[int, int]]:
    """The parts of a bare word between its ``+`` if one of them is a known name; else the word, which may hold ``+`` itself."""
    if text.find("+", start, end) < 0:
        return [(start, end)]
    parts, at = [], start
    for part in text[start:end].split("+"):
        parts.append((at, at + len(part)))
        at += len(part) + 1
    return parts if any(b - a <= longest and known(text[a:b]) for a, b in parts) else [(start, end)]


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each by start and then kind."""
    if not text:
        return [], []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = base_spans(text)
    more = set(lexed_spans(text) if "=" in text or ":" in text else []) | set(marked_spans(text))
    return sorted(base, key=order), sorted([*base, *more], key=order)


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with overlapping spans merged and replaced by a mark."""
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], "<secret>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base findings, their digest, and all spans of every row."""

    def run(batch: dict) -> dict:
        found = [scan(t) for t in batch["text"]]
        count = lambda kind: [sum(s[0] == kind for s in base) for base, _ in found]
        return {
            "doc_id": batch["doc_id"],
            "n_assign": count("assign"),
            "n_access": count("access"),
            "n_hex": count("hex"),
            "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found],
            "spans": [_joined(spans) for _, spans in found],
        }

    return map_rows(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, SCHEMA)


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All columns of every row, secrets replaced in the text and its length brought up to date."""
    names = docs.columns

    def run(batch: dict) -> dict:
        given = batch[text]
        made = [redact(t, scan(t)[1]) for t in given]
        out = dict(batch, **{text: made})
        if length in names:
            out[length] = [old if new is was else len(new) for old, new, was in zip(batch[length], made, given)]
        return out

    return map_rows(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
