"""Exact repeated substrings by prefix-free parsing.

A byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed.

Parsing: a position is a trigger if its rolling hash is the least of all positions of some
window of LENGTH bytes. Triggers depend on content only, and every window has one, so equal
windows are parsed alike wherever they stand. All windows with the same trigger (in two
groups by their distance to it) form a phrase. A phrase has a core, the bytes that every
window of its group shares whatever the phrase's ends, and a body, all its bytes.

Corpus order: the suffix order of dictionary and parse is only needed as far as LENGTH
bytes, and only to tell which windows stand beside an equal one; digests stand for ranks.
* A core that occurs once leaves all windows of its phrase unique; most text ends here.
* A body that occurs again repeats all windows of its phrase at once; repetitive text ends here.
* What is left, phrases with a shared core at the ends of repetitions, each distinct body
  once, is cut into phrases of at most ``FINE`` windows and told apart likewise, and what is
  still left then window by window.

Defined results: a null text counts as empty; texts shorter than LENGTH bytes lose nothing;
matches never cross documents; repeated rows repeat each other and so lose all windows;
an empty table gives no rows; other columns are not looked at. Digests have 64 bits per
stage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows, written

LENGTH = 200
#: Bytes under the rolling hash.
SEED_BYTES = 16
REACH = LENGTH - SEED_BYTES + 1
#: Distances to the trigger that share a group.
GROUP = (REACH + 1) // 2
#: The same for the second cut.
FINE = 8

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_COUNT = 1 << 12


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def triggers(data: np.ndarray) -> np.ndarray:
    """For every window start the position of its trigger: the leftmost least hash within it."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        moved = np.zeros_like(h)
        moved[shift:] = h[:-shift] << np.uint32(shift)
        h = h + moved
    h = h[SEED_BYTES - 1 :]  # h[t] now belongs to the bytes t .. t + SEED_BYTES - 1
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    n = len(h)
    order = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // REACH) * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = order
    blocks = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - REACH + 1
    least = np.minimum(behind[:windows], ahead[REACH - 1 : REACH - 1 + windows])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(trigger: np.ndarray, start: np.ndarray, width: int) -> tuple[list, list, list]:
    """(first window, number of windows, core start) of the phrases of consecutive windows ``start``."""
    group = (trigger - start) // width
    first = np.concatenate([[0], np.flatnonzero((np.diff(trigger) != 0) | (np.diff(group) != 0)) + 1])
    count = np.diff(np.append(first, len(start)))
    return start[first].tolist(), count.tolist(), (trigger[first] - width * group[first]).tolist()


def _digests(raw: bytes, found: tuple[list, list, list], trigger: np.ndarray, width: int) -> tuple[list, list, list]:
    """Cores, bodies and spans. The distance to the trigger is part of either digest."""
    digest, length = xxhash.xxh3_64_intdigest, LENGTH - width + 1
    cores, bodies, spans = [], [], []
    for first, n, core in zip(*found):
        lead = int(trigger[first]) - first
        cores.append(_signed(digest(raw[core : core + length], seed=lead // width)))
        bodies.append(_signed(digest(raw[first : first + n - 1 + LENGTH], seed=lead)))
        spans.append(first * _COUNT + n)
    return cores, bodies, spans


def _parse(batch: dict) -> dict:
    out: dict[str, list] = {"row": [], "core": [], "body": [], "span": []}
    for row, text in zip(batch["row"], batch["text"]):
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) < LENGTH:
            continue
        trigger = triggers(np.frombuffer(raw, dtype=np.uint8))
        made = _digests(raw, phrases(trigger, np.arange(len(trigger)), GROUP), trigger, GROUP)
        out["row"] += [row] * len(made[0])
        for name, values in zip(("core", "body", "span"), made):
            out[name] += values
    return out


def _split(batch: dict) -> dict:
    """The listed phrases cut finer."""
    out: dict[str, list] = {"row": [], "core": [], "body": [], "span": [], "alone": []}
    for row, text, spans in zip(batch["row"], batch["text"], batch["spans"]):
        raw = text.encode("utf-8", "surrogatepass")
        trigger = triggers(np.frombuffer(raw, dtype=np.uint8))
        for s in spans:
            first, n = divmod(s["span"], _COUNT)
            made = _digests(raw, phrases(trigger[first : first + n], np.arange(first, first + n), FINE), trigger, FINE)
            out["row"] += [row] * len(made[0])
            out["alone"] += [s["alone"]] * len(made[0])
            for name, values in zip(("core", "body", "span"), made):
                out[name] += values
    return out


def _windows(batch: dict) -> dict:
    """Every window of the listed phrases, by digest."""
    out: dict[str, list] = {"digest": [], "row": [], "start": [], "alone": []}
    digest = xxhash.xxh3_64_intdigest
    for row, text, spans in zip(batch["row"], batch["text"], batch["spans"]):
        raw = text.encode("utf-8", "surrogatepass")
        for s in spans:
            first, n = divmod(s["span"], _COUNT)
            out["digest"] += [_signed(digest(raw[i : i + LENGTH])) for i in range(first, first + n)]
            out["row"] += [row] * n
            out["start"] += range(first, first + n)
            out["alone"] += [s["alone"]] * n
    return out


def _remove(batch: dict) -> dict:
    out: dict[str, list] = {"doc_id": batch["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
    for text, whole, single in zip(batch["text"], batch["whole"], batch["single"]):
        raw = text.encode("utf-8", "surrogatepass")
        ranges = [divmod(s, _COUNT) for s in whole or ()] + [(s, 1) for s in single or ()]
        spans: list[list[int]] = []
        for first, n in sorted(ranges):
            end = first + n - 1 + LENGTH
            if spans and first <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([first, end])
        kept, at = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(sum(b - a for a, b in spans))
        out["n_spans"].append(len(spans))
        out["kept_sha256"].append(kept.hexdigest())
        out["spans"].append(",".join(f"{a}:{b}" for a, b in spans))
    return out


def _told_apart(parse: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(row, span) of phrases that repeat whole, and (row, spans) of one phrase for each body that stays open.

    Only phrases that stand ``alone`` are to be marked; the others are there to be met. An
    open phrase is alone if its body occurs once.
    """
    seen = F.count("*").alias("n"), F.max("alone").alias("any_alone")
    cores = parse.groupBy("core").agg(*seen, F.min("body").alias("lo"), F.max("body").alias("hi")).where((F.col("n") > 1) & F.col("any_alone"))
    shared = written(parse.join(cores.select("core", (F.col("lo") == F.col("hi")).alias("alike")), "core"), f"{name}-shared", free=True)
    mixed = shared.where(~F.col("alike"))
    bodies = mixed.groupBy("core", "body").agg(*seen, F.first(F.struct("row", "span")).alias("at"))
    bodies = written(bodies, f"{name}-bodies")
    again = mixed.where("alone").join(bodies.where(F.col("n") > 1).select("core", "body"), ["core", "body"])
    whole = shared.where(F.col("alike") & F.col("alone")).select("row", "span").unionByName(again.select("row", "span"))
    alone = ((F.col("n") == 1) & F.col("any_alone")).alias("alone")
    return whole, bodies.groupBy("at.row").agg(F.collect_list(F.struct("at.span", alone)).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    parse = map_rows(rows, _parse, "row bigint, core bigint, body bigint, span bigint").withColumn("alone", F.lit(True))
    whole, left = _told_apart(written(parse, "pfp-parse", free=True), "pfp")
    texts = written(rows.dropDuplicates(["row"]).join(left, "row").select("row", "text", "spans"), "pfp-texts", free=True)
    fine = map_rows(texts, _split, "row bigint, core bigint, body bigint, span bigint, alone boolean")
    whole_fine, left = _told_apart(written(fine, "pfp-fine", free=True), "pfp-fine")

    listed = texts.select("row", "text").join(left, "row").select("row", "text", "spans")
    windows = written(map_rows(listed, _windows, "digest bigint, row bigint, start int, alone boolean"), "pfp-windows", free=True)
    equal = windows.groupBy("digest").agg(F.count("*").alias("n"), F.max("alone").alias("any_alone")).where((F.col("n") > 1) & F.col("any_alone"))
    single = windows.where("alone").join(equal.select("digest"), "digest").select("row", "start")
    whole = whole.unionByName(whole_fine)

    marks = whole.select("row", "span", F.lit(None).cast("int").alias("start")).unionByName(single.select("row", F.lit(None).cast("bigint").alias("span"), "start"))
    lists = marks.groupBy("row").agg(F.collect_list("span").alias("whole"), F.collect_list("start").alias("single"))
    marked = rows.join(lists, "row", "left").select("doc_id", "text", "whole", "single")
    return map_rows(marked, _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string")
