"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts the UTF-8 text of a document into chunks of
variable length: boundaries depend on content only, so an insertion shifts no chunk but its
own. Chunks are known by digest. Of equal chunks the one in the document with the smallest
id (none comes last), and there the first, stays; runs of later copies that are long enough
together, or cover a whole document, are removed. A chance repetition of one short chunk
inside a longer document is no run and stays.

Defined results: a null or empty text has no chunk and no span; of repeated rows (same id and
text) one is treated as if it were the only one and the others lose their whole text; rows
that repeat an id with another text, or have no id, are documents of their own, in the order
of a hash of id and text; an empty table gives no rows; other columns are not looked at.
Digests have 64 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows, written

WINDOW = 16
MEAN_GAP = 32
SHORTEST, LONGEST = 16, 256
#: Bytes that a run of repeated chunks has at least, unless it covers its document.
MIN_RUN = 100

_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPAN = 1 << 10
#: Added to the length of a document's last chunk.
_LAST = 1 << 9


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array."""
    n = len(data)
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):  # after these steps a position sums the gears of its last 16 bytes
        moved = np.zeros_like(h)
        moved[shift:] = h[:-shift] << np.uint32(shift)
        h = h + moved
    cut = np.flatnonzero((h >> np.uint32(8)) % np.uint32(1 << 16) < (1 << 16) // MEAN_GAP) + 1
    ends, last = [], 0
    for c in cut.tolist():
        while c - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if c - last >= SHORTEST:
            last = c
            ends.append(last)
    while n - last > LONGEST:
        last += LONGEST
        ends.append(last)
    if n > last:
        ends.append(n)
    return np.array(ends, dtype=np.int64)


def _chunks(batch: dict) -> dict:
    out: dict[str, list] = {"row": [], "doc_id": [], "digest": [], "span": []}
    digest = xxhash.xxh3_64_intdigest
    for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
        raw = text.encode("utf-8", "surrogatepass")
        ends = boundaries(np.frombuffer(raw, dtype=np.uint8)).tolist()
        starts = [0, *ends[:-1]]
        out["row"] += [row] * len(ends)
        out["doc_id"] += [doc_id] * len(ends)
        out["digest"] += [digest(raw[a:b]) - (1 << 63) for a, b in zip(starts, ends)]
        out["span"] += [a * _SPAN + b - a + _LAST * (b == len(raw)) for a, b in zip(starts, ends)]
    return out


def _runs(batch: dict) -> dict:
    """Per document: repeated chunks, removed bytes and the removed spans."""
    out: dict[str, list] = {"row": batch["row"], "n_repeated": [], "n_removed": [], "spans": []}
    for marks in batch["marks"]:
        runs, seen, last_end = [], set(), -1
        for m in sorted(marks, key=lambda m: m["span"]):
            start, length = divmod(m["span"], _SPAN)
            last, length = divmod(length, _LAST)
            stays = m["first"] and m["digest"] not in seen
            seen.add(m["digest"])
            if stays:
                continue
            if runs and last_end == start:
                runs[-1][1:] = start + length, last
            else:
                runs.append([start, start + length, last])
            last_end = start + length
        kept = [r for r in runs if r[1] - r[0] >= MIN_RUN or r[0] == 0 and r[2]]
        out["n_repeated"].append(len(marks))
        out["n_removed"].append(sum(r[1] - r[0] for r in kept))
        out["spans"].append(",".join(f"{a}:{b}" for a, b, _ in kept))
    return out


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_repeated (chunks that occur elsewhere too), n_removed (bytes), spans (byte ranges to remove)."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    chunks = written(map_rows(rows, _chunks, "row bigint, doc_id bigint, digest bigint, span bigint"), "chunk-rows", free=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    shared = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(order)["row"].alias("least")).where(F.col("n") > 1)
    shared = written(shared, "chunk-shared", free=True)  # a join of two plain exchanges can split a hot digest
    marks = chunks.join(shared, "digest").select("row", "digest", "span", (F.col("row") == F.col("least")).alias("first"))
    lists = marks.groupBy("row").agg(F.collect_set(F.struct("span", "digest", "first")).alias("marks"))
    found = map_rows(lists, _runs, "row bigint, n_repeated bigint, n_removed bigint, spans string")
    sizes = rows.groupBy("doc_id", "row", F.octet_length("text").cast("bigint").alias("n_bytes")).agg(F.count("*").alias("c"))
    none = {"n_repeated": F.lit(0), "n_removed": F.lit(0), "spans": F.lit("")}
    one = sizes.join(found, "row", "left").select("doc_id", "n_bytes", "c", *[F.coalesce(F.col(k), v).alias(k) for k, v in none.items()])
    each = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))))
    again = (F.col("copy") > 1) & (F.col("n_bytes") > 0)
    whole = {"n_removed": F.col("n_bytes"), "spans": F.concat(F.lit("0:"), F.col("n_bytes").cast("string"))}
    return each.select("doc_id", "n_bytes", "n_repeated", *[F.when(again, v).otherwise(F.col(k)).alias(k) for k, v in whole.items()])


def remove_spans(text: str | None, spans: str) -> str | None:
    """The text without the byte ranges; a character cut by a range goes whole."""
    if not text or not spans:
        return text
    raw, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in (map(int, s.split(":")) for s in spans.split(",")):
        parts.append(raw[at:start])
        at = end
    return b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
