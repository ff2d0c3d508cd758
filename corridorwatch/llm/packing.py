"""Packing token sequences: a cutting-stock problem solved by column generation.

Documents become token ids with a closing id. A document is cut into whole sequences of
``CAPACITY`` tokens and one rest; pieces are sorted into classes of ``UNIT`` tokens. The
linear program over patterns (how many pieces of each class share a sequence) covers the
histogram of all pieces: a knapsack dynamic program prices patterns against the duals until
none improves. The histogram has at most CAPACITY / UNIT entries however many documents
there are, so this runs on the driver in bounded memory and time. Patterns are rounded down,
what is left is packed first-fit, and the pieces of a class, ranked, fill the pattern slots
of their class in turn.

Defined results: a null text counts as empty, which gives one piece with the closing id;
no document is dropped and none is cut below CAPACITY; repeated rows and repeated ids are
packed each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows, ranked, sliced, written

CAPACITY = 4096
UNIT = 16
UNITS = CAPACITY // UNIT
CLOSING_ID = 2
#: Words remembered per worker; the memory is emptied when full.
CACHED_WORDS = 400_000
#: Words that the tokenizer gets at a time.
JOINED_WORDS = 500

_TOKENIZER: dict = {}
#: Bytes that separate words.
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 13, 32]] = True


#: Words whose pre-tokens follow from their characters: printable ASCII and the accented letters of Latin-1.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The tokenizer's own split of lower-cased words, restricted to those characters.
_PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
_WORD_END = "</w>"


class WordTokenizer:
    """Token ids of texts, distinct word by distinct word.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its words in turn. Words of many texts are found and numbered in Arrow; only
    distinct ones are looked up or tokenized, and one gather lays all ids side by side.
    Words are remembered in two generations, so that frequent ones stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _ids(self, entries: list[bytes]) -> list[bytes]:
        """The ids of each entry, a word with the white space behind it."""
        young, old = self._young, self._old
        if len(young) > CACHED_WORDS:
            self._old, self._young = old, young = young, {}
        found = [young.get(e) for e in entries]
        plain, other = [], []
        for i, ids in enumerate(found):
            if ids is None:
                e = entries[i]
                ids = old.get(e)
                if ids is None:
                    word = e.decode().rstrip(" \t\n\r")
                    (plain if _PLAIN.fullmatch(word) else other).append((i, word))
                else:
                    found[i] = young[e] = ids
        for some, split in ((plain, self._split_plain), (other, self._split_other)):
            for start in range(0, len(some), JOINED_WORDS):
                part = some[start : start + JOINED_WORDS]
                for (i, _), ids in zip(part, split([w for _, w in part])):
                    found[i] = young[entries[i]] = ids
        return found

    def _split_plain(self, words: list[str]) -> list[bytes]:
        """One call for many words; the tokens that end a pre-token tell them apart again."""
        encoded = self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, dtype="<u4")
        needed = np.cumsum([0, *(len(_PRE_TOKEN.findall(w.lower())) for w in words)])
        ends = np.append(0, np.flatnonzero(self._ends[ids]) + 1)
        if len(ends) != needed[-1] + 1:
            return self._split_other(words)
        cuts, flat = (4 * ends[needed]).tolist(), ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _split_other(self, words: list[str]) -> list[bytes]:
        """The same by the offsets of the tokens, which costs more."""
        encoded = self._tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        cuts = (4 * np.searchsorted([at for at, _ in encoded.offsets], starts)).tolist()
        flat = np.array(encoded.ids, dtype="<u4").tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by CLOSING_ID, and the number of ids per text."""
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        gap = _SPACES[data]
        begins = np.ones(len(data), dtype=bool)
        begins[1:] = gap[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= ~gap
        starts = np.flatnonzero(begins)
        # a word runs to the begin of the next one: what follows it is white space, whichever text that is in
        edges = np.append(starts, len(data)).astype("<i8")
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        # the closing id is one more word, behind the words of every text
        ids = [*self._ids(distinct), np.array([CLOSING_ID], dtype="<u4").tobytes()]
        pool = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        ends = np.searchsorted(starts, offsets[1:])
        codes = np.insert(words.indices.to_numpy(), ends, len(distinct))
        each = sizes[codes]
        place = np.cumsum(each)
        found = pool[np.repeat((np.cumsum(sizes) - sizes)[codes] - (place - each), each) + np.arange(place[-1] if len(place) else 0)]
        return found, np.diff(place[ends + np.arange(len(ends))], prepend=0)


def tokenizer(path: str | None) -> WordTokenizer:
    if path not in _TOKENIZER:
        if path is None:
            import public_tokenizers

            _TOKENIZER[path] = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
        else:
            _TOKENIZER[path] = WordTokenizer(path)
    return _TOKENIZER[path]


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, units (and ids)."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, units int" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                ids, counts = tokenizer(tokenizer_path).encode(part.column(1))
                pieces = -(-counts // CAPACITY)
                doc = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CAPACITY
                length = np.minimum(counts[doc] - start, CAPACITY)
                at = (np.cumsum(counts) - counts)[doc] + start
                cuts = [ids[a:b].tobytes() for a, b in zip(at.tolist(), (at + length).tolist())]
                made = {
                    "doc_id": part.column(0).take(pa.array(doc)), "start": start, "length": length,
                    "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                    "doc_tokens": counts[doc], "units": (-(-length // UNIT)).astype(np.int32),
                }
                yield pa.RecordBatch.from_pydict(made | {"ids": pa.array(cuts, pa.binary())} if keep_ids else made)

    given = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, schema)


@dataclass(frozen=True)
class Plan:
    """``patterns[p, c]``: pieces of ``c`` units in a sequence of pattern p; ``uses[p]``: its sequences."""

    patterns: np.ndarray
    uses: np.ndarray


def _best_pattern(value: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray]:
    """The knapsack dynamic program: the most valuable pattern of at most UNITS units."""
    best, taken = np.zeros(UNITS + 1), np.full(UNITS + 1, -1)
    for room in range(1, UNITS + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(sizes, room, side="right")
        if n:
            with_one = best[room - sizes[:n]] + value[:n]
            k = int(with_one.argmax())
            if with_one[k] > best[room] + 1e-12:
                best[room], taken[room] = with_one[k], k
    pattern, room = np.zeros(len(sizes)), UNITS
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[UNITS]), pattern


def solve(histogram: dict[int, int], most_steps: int = 5000) -> Plan:
    """Column generation over ``{units: pieces}``: a revised simplex whose columns are priced by the knapsack."""
    sizes = np.array(sorted(histogram), dtype=int)
    demand = np.array([histogram[s] for s in sizes], dtype=float)
    m = len(sizes)
    basis = np.diag([float(UNITS // s) for s in sizes])
    inverse = np.diag([1.0 / (UNITS // s) for s in sizes])
    for step in range(most_steps):
        amount = inverse @ demand
        worth, column = _best_pattern(inverse.sum(axis=0), sizes)  # every sequence costs one
        if worth <= 1 + 1e-9:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-10, amount / np.where(direction > 1e-10, direction, 1.0), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, row)
            inverse[leave] = row
    uses = np.floor(np.maximum(inverse @ demand, 0) + 1e-9).astype(int)
    rest = np.round(demand - basis @ uses).astype(int)
    while (rest < 0).any():  # rounding noise: give back sequences that have nothing to hold
        short = int(np.flatnonzero(rest < 0)[0])
        p = int(np.flatnonzero((basis[short] > 0) & (uses > 0))[0])
        uses[p] -= 1
        rest = np.round(demand - basis @ uses).astype(int)
    bins, rooms = [], []
    for k in range(m - 1, -1, -1):
        left = int(rest[k])
        for b in range(len(bins)):
            n = min(left, rooms[b] // sizes[k])
            bins[b][k] += n
            rooms[b] -= n * sizes[k]
            left -= n
        while left:
            n = min(left, UNITS // sizes[k])
            bins.append(np.zeros(m, dtype=int))
            bins[-1][k], left = n, left - n
            rooms.append(UNITS - n * sizes[k])
    patterns = np.zeros((m + len(bins), UNITS + 1), dtype=int)
    patterns[:m, sizes] = basis.T.astype(int)
    if bins:
        patterns[m:, sizes] = np.array(bins)
    uses = np.append(uses, np.ones(len(bins), dtype=int))
    used = (uses > 0) & (patterns.sum(axis=1) > 0)
    return Plan(patterns[used], uses[used])


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Sequence and slot of every piece, from its rank in its class; ``pieces`` has ``units`` and ``rank``."""
    first = np.concatenate([[0], np.cumsum(plan.uses)])[:-1]
    slots = np.concatenate([np.zeros((len(plan.uses), 1), dtype=int), np.cumsum(plan.patterns, axis=1)[:, :-1]], axis=1)
    by_class = {}
    for c in np.flatnonzero(plan.patterns.sum(axis=0)):
        p = np.flatnonzero(plan.patterns[:, c])
        held = plan.patterns[p, c] * plan.uses[p]
        by_class[int(c)] = (p, np.concatenate([[0], np.cumsum(held)])[:-1], plan.patterns[p, c])
    names = [f.name for f in pieces.schema if f.name not in ("units", "rank")]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def run(batch: dict) -> dict:
        units, rank = np.array(batch["units"], dtype=int), np.array(batch["rank"], dtype=np.int64)
        sequence, slot = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        for c in np.unique(units):
            at = np.flatnonzero(units == c)
            p, start, each = by_class[int(c)]
            k = np.searchsorted(start, rank[at], side="right") - 1
            inside = rank[at] - start[k]
            sequence[at] = first[p[k]] + inside // each[k]
            slot[at] = slots[p[k], c] + inside % each[k]
        return {**{n: batch[n] for n in names}, "sequence_id": sequence, "slot": slot}

    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", sequence_id bigint, slot bigint"
    return map_rows(pieces, run, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece (and its ids)."""
    pieces = written(cut(docs, key, text, tokenizer_path, keep_ids), "pack-pieces")
    counts = pieces.groupBy("units").agg(F.count("*").alias("n"))
    histogram = {r["units"]: r["n"] for r in counts.collect()}  # at most UNITS rows
    if not histogram:
        return pieces.drop("units").withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    plan = solve(histogram)
    sized = pieces.join(F.broadcast(counts), "units")  # at most UNITS rows
    numbered = ranked(sized, ["units"], "n", ["doc_id", "start"], ["doc_id", "start", "length", "ids_crc32"], "rank").drop("n")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = place(numbered, plan).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.drop("slot")
