"""Near-duplicate documents: an inverted join on MinHash signature coordinates.

A document is the set of its distinct five-word shingles. Rows with equal sets form one
class. Every class posts itself under each of ``COORDINATES`` coordinate-value pairs of its
MinHash signature. Two sets of similarity 0.75 agree in at least ``LEAST_MATCHES``
coordinates but for a chance of about 1e-8, so

* a class with fewer shared pairs than that has no partner and is skipped;
* of a class's shared pairs, rarest first, only the prefix that any partner must meet is
  posted (all but LEAST_MATCHES - 1 of them).

Posting lists are merged without listing their pairs: every list is first compared with its
hub, the class whose pairs are the most common. Confirmed links are contracted to components,
and only members that the hub's component doesn't hold are compared with members of other
components. Two classes that agree in enough coordinates and never meet are therefore already
in one component. Candidates pass by the number of agreeing coordinates, by a bound that bit maps of the
sets give, and then by the exact similarity of their full sets.

A text is found again by its id and its 128-bit digest, and travels to a check once per hub
slice or partner.

Defined results: a null or empty text, or one without words, has no shingle, is linked with
nothing and is its own component; fewer than five words are one shingle; repeated rows share
a class, and one of them at most is kept; rows that repeat an id with other texts are connected through that id; a null id is
in the component of its class, which is null if it has no other id; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import WORD, map_rows, sliced, written
from corridorwatch.llm.graph import components

WIDTH = 5
PERCENT = 75
COORDINATES = 64
LEAST_MATCHES = 26
#: Words remembered per worker; the memory is emptied when full.
CACHED_WORDS = 400_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1 << 40, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_PLACE = _rng.integers(1 << 40, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.array([(0x9E3779B97F4A7C15 * n) % (1 << 64) for n in range(WIDTH)], dtype=np.uint64)
_BLOCK = 1 << 14
#: Words of 64 bits in the bit map of a set.
MAP_WORDS = 32
#: Rows of a posting list that meet those of another block in one group.
BLOCK_ROWS = 1024

_HASHES: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space
    if len(_HASHES) > CACHED_WORDS:
        _HASHES.clear()
    get, digest = _HASHES.get, xxhash.xxh3_64_intdigest
    codes = [get(w) for w in words]
    for i, c in enumerate(codes):
        if c is None:
            codes[i] = _HASHES[words[i]] = digest(words[i])
    h = np.array(codes, dtype=np.uint64)
    if not len(h):
        return h
    if len(h) < WIDTH:
        return _mix((h * _PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + _SHORT[len(h)])
    n = len(h) - WIDTH + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, WIDTH):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), _BLOCK):
        block = found[start : start + _BLOCK]
        least = np.minimum(least, (block[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bit_map(found: np.ndarray) -> np.ndarray:
    """A bit per element; what one map has and the other lacks bounds the common elements from above."""
    bits = np.zeros(64 * MAP_WORDS, dtype=np.uint8)
    bits[found % np.uint64(64 * MAP_WORDS)] = 1
    return np.packbits(bits).view(np.int64)


def _digest(found: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(found.tobytes())
    return tuple(int(x) for x in np.array([d & (1 << 64) - 1, d >> 64], dtype=np.uint64).view(np.int64))


def _sketch(batch: dict) -> dict:
    sets = [shingles(t) for t in batch["text"]]
    names = [_digest(x) if len(x) else (None, None) for x in sets]
    return {
        "n_shingles": [len(x) for x in sets],
        "h1": [n[0] for n in names],
        "h2": [n[1] for n in names],
        "sig": [signature(x) if len(x) else None for x in sets],
        "bits": [bit_map(x) if len(x) else None for x in sets],
    }


def _compatible(a: Column, b: Column) -> Column:
    """Set sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _possible() -> Column:
    """Whether the bit maps of u and v leave room for the similarity."""
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    most = F.least(F.col("n_u") - lacks("bits_u", "bits_v"), F.col("n_v") - lacks("bits_v", "bits_u"))
    return most * (100 + PERCENT) >= (F.col("n_u") + F.col("n_v")) * PERCENT


def _pairs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of different components that the bit maps allow, list by list; rows come sorted by list."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "block", "node", "n", "component")}
        cols["bits"] = batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, MAP_WORDS)
        if held is not None:
            cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
        changed = (np.diff(cols["key"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        for a, b in zip(starts[:-1], starts[1:]):
            yield from _pairs_of_list({c: x[a:b] for c, x in cols.items()})
        held = {c: x[starts[-1] :] for c, x in cols.items()}
    if held is not None:
        yield from _pairs_of_list(held)


def _pairs_of_list(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if (rows["component"] == rows["component"][0]).all():
        return
    one_block = rows["i"][0] == rows["j"][0]
    left = np.flatnonzero(rows["block"] == rows["i"][0])
    right = left if one_block else np.flatnonzero(rows["block"] == rows["j"][0])
    if not len(left) or not len(right):
        return
    n, bits, component, node = rows["n"], rows["bits"], rows["component"], rows["node"]
    nb, bb = n[right][None, :], bits[right][None, :, :]
    for start in range(0, len(left), 32):
        at = left[start : start + 32]
        na, ba = n[at][:, None], bits[at][:, None, :]
        most = np.minimum(na - np.bitwise_count(ba & ~bb).sum(-1, dtype=np.int64), nb - np.bitwise_count(bb & ~ba).sum(-1, dtype=np.int64))
        ok = (most * (100 + PERCENT) >= (na + nb) * PERCENT) & (component[at][:, None] != component[right][None, :])
        if one_block:
            ok &= node[at][:, None] < node[right][None, :]
        x, y = np.nonzero(ok)
        if len(x):
            yield pa.RecordBatch.from_pydict({"u": node[at[x]], "v": node[right[y]]})


def lists_of_components(labelled: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) that share a posting list and not a component.

    A long list is cut into blocks, and every two blocks meet in a group of their own, so no
    task holds a whole list; only pairs that the bit maps allow come out.
    """
    mixed = (
        labelled.groupBy("key")
        .agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select("key", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    rows = labelled.join(mixed, "key").join(classes.select("node", "bits"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "component", "bits")
    in_order = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return in_order.mapInArrow(_pairs_of_lists, "u bigint, v bigint")


def postings(classes: DataFrame) -> DataFrame:
    """(key, node, n, score): the prefix of every class that can have a partner; score: how common its pairs are."""
    every = classes.select("node", F.posexplode("sig").alias("at", "value")).select(
        "node", F.shiftleft(F.col("at").cast("bigint"), 32).bitwiseOR(F.col("value").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key")
    )
    shared = every.groupBy("key").agg(F.count("*").alias("freq")).where(F.col("freq") > 1)
    of_class = (
        every.join(shared, "key")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("pairs"))
        .where(F.size("pairs") >= LEAST_MATCHES)
    )
    score = F.aggregate("pairs", F.lit(0).cast("bigint"), lambda s, p: s + p["freq"])
    prefix = F.slice("pairs", 1, F.size("pairs") - (LEAST_MATCHES - 1))
    listed = of_class.select("node", score.alias("score"), F.explode(prefix).alias("pair"))
    return listed.join(classes.select("node", "n"), "node").select(F.col("pair.key").alias("key"), "node", "n", "score")


def _found_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, h1, h2, text): for each class one text with its set, found by id and digest."""
    at = [F.md5("text").alias("k1"), F.coalesce("doc_id", F.lit(0)).alias("k2"), F.col("doc_id").isNull().alias("k3")]
    # rows that repeat are merged before they travel
    texts = docs.where(F.col("text").isNotNull()).select(*at, "text").groupBy("k1", "k2", "k3").agg(F.first("text").alias("text"))
    wanted = nodes.join(classes, "node").select(
        "node", "h1", "h2", F.col("at.digest").alias("k1"), F.coalesce("at.doc_id", F.lit(0)).alias("k2"), F.col("at.doc_id").isNull().alias("k3")
    )
    return texts.join(wanted, ["k1", "k2", "k3"]).select("node", "h1", "h2", "text")


def _links_of_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that are linked with their hub; rows come sorted by hub and slice, the hub itself first."""
    at: tuple | None = None
    hub = np.empty(0, dtype=np.uint64)
    for batch in batches:
        for part in sliced(batch):
            out: dict[str, list] = {"u": [], "v": []}
            for v, slice_, node, h1, h2, text in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("v", "slice", "node", "h1", "h2", "text"))):
                found = shingles(text)
                if _digest(found) != (h1, h2):
                    raise ValueError("a text doesn't have the set of its class")
                if at != (v, slice_):
                    if node != v:
                        raise ValueError("a hub's text is missing")
                    at, hub = (v, slice_), found
                    continue
                both = len(np.intersect1d(hub, found, assume_unique=True))
                if 100 * both >= PERCENT * (len(hub) + len(found) - both):
                    out["u"].append(node)
                    out["v"].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in out.items()})


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Links (u, v) among candidate pairs: by agreeing coordinates, then on the full sets."""
    side = lambda c: classes.select(*[F.col(x).alias(y) for x, y in (("node", c), ("sig", f"sig_{c}"), ("bits", f"bits_{c}"), ("n", f"n_{c}"))])
    equal = F.aggregate(F.zip_with("sig_u", "sig_v", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    likely = pairs.distinct().join(side("u"), "u").join(side("v"), "v")
    likely = likely.where((equal >= LEAST_MATCHES) & _possible()).select("u", "v")
    likely = written(likely, f"{name}-likely", free=True)
    sizes = written(likely.groupBy("v").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("slices")), f"{name}-slices", free=True)
    dealt = likely.join(sizes, "v").select("v", F.pmod(F.xxhash64("u"), F.col("slices")).alias("slice"), F.col("u").alias("node"))
    hubs = sizes.select("v", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("v").alias("node"))
    nodes = likely.select(F.col("u").alias("node")).union(sizes.select("v")).distinct()
    texts = _found_texts(docs, classes, nodes)
    sent = dealt.unionByName(hubs).join(texts, "node").withColumn("member", F.col("node") != F.col("v"))
    in_order = sent.repartition("v", "slice").sortWithinPartitions("v", "slice", "member").select("v", "slice", "node", "h1", "h2", "text")
    return written(in_order.mapInArrow(_links_of_hubs, "u bigint, v bigint"), f"{name}-links", free=True)


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest, n_shingles, h1, h2) of ``docs`` (doc_id, text), their classes, and components of classes."""
    given = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    schema = "doc_id bigint, digest binary, n_shingles bigint, h1 bigint, h2 bigint, sig array<int>, bits array<bigint>"
    rows = written(map_rows(given, _sketch, schema, keep=("doc_id", "digest"), unread=("doc_id", "digest")), "near-rows", free=True)
    grouped = rows.where(F.col("n_shingles") > 0).groupBy("h1", "h2").agg(
        F.min("doc_id").alias("label"), F.min(F.struct(F.lower(F.hex("digest")).alias("digest"), "doc_id")).alias("at"),
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"),
    )
    # the numbers are read back from the written table, so they stay the same
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "near-classes", free=True)
    posts = written(postings(classes), "near-posts", free=True)

    hub = posts.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("hub"))
    stars = posts.join(hub, "key").where((F.col("node") != F.col("hub.node")) & _compatible(F.col("n"), F.col("hub.n")))
    links = confirm(stars.select(F.col("node").alias("u"), F.col("hub.node").alias("v")), classes, docs, "near-stars")
    found = written(components(links, "near-components"), "near-components", free=True)

    labelled = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).select("key", "node", "n", "score", "component")
    labelled = written(labelled, "near-labelled", free=True)
    more = confirm(lists_of_components(labelled, classes), classes, docs, "near-strays")

    links = links.unionByName(more)
    return rows, classes, written(components(links, "near-components"), "near-components", free=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows, classes, final = _classified(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    by_class = classes.select("node", "label", "h1", "h2").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return _named(rows, by_class)


def _named(rows: DataFrame, by_class: DataFrame) -> DataFrame:
    """Components by their smallest id; ids that stand for several classes tie these together."""
    members = rows.where(F.col("n_shingles") > 0).select("doc_id", "h1", "h2").distinct()
    ties = members.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    tied = members.join(ties, "doc_id").join(by_class, ["h1", "h2"]).select("doc_id", "component")
    edges = tied.join(tied.groupBy("doc_id").agg(F.min("component").alias("least")), "doc_id").select(F.col("component").alias("u"), F.col("least").alias("v"))
    if not ties.isEmpty():
        merged = components(edges, "near-ties").withColumnRenamed("component", "merged")
        by_class = by_class.join(merged.withColumnRenamed("node", "component"), "component", "left").withColumn("component", F.coalesce("merged", "component"))
    least = by_class.groupBy("component").agg(F.min("label").alias("component_id"))
    named = by_class.join(least, "component").select("h1", "h2", "component_id")
    # rows equal in id and set are one counted row until the end; only the first of them is kept
    counted = rows.groupBy("doc_id", "n_shingles", "h1", "h2").agg(F.count("*").alias("c"))
    out = counted.join(named, ["h1", "h2"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))))
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    first = (F.col("n_shingles") == 0) | (F.col("copy") == 1)
    out = out.select("doc_id", "n_shingles", component_id.alias("component_id"), first.alias("first"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("first")).drop("first")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of every group of near copies, all columns as given; rows without a word all stay.

    Groups are made by texts alone, so rows that share an id, or have none, are kept or
    dropped each for itself. Of a group the row with the smallest id stays, one without an id
    only if no row has one; among rows equal in id and text the choice depends on their columns.
    """
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    rows, classes, final = _classified(docs.where(worded).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    of_class = classes.select("node", "h1", "h2").join(final, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.lower(F.hex("digest")).alias("digest")))
    # one row per class first, so that a group of copies never meets in one task
    by_class = written(rows.groupBy("h1", "h2").agg(first.alias("first")), "near-firsts", free=True)
    best = by_class.join(of_class, ["h1", "h2"]).groupBy("component").agg(F.min("first").alias("best"))
    stay = best.select(F.col("best.none").alias("__none"), F.coalesce("best.id", F.lit(0)).alias("__id"), F.col("best.digest").alias("__digest"))
    stay = written(stay, "near-stay", free=True)
    # rows equal in id and text meet after each task has left one of them
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    ident = F.col(key).cast("bigint")
    given = docs.where(worded).select(
        ident.isNull().alias("__none"), F.coalesce(ident, F.lit(0)).alias("__id"), F.md5(F.col(text)).alias("__digest"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"), F.xxhash64(*hashed).alias("__order"),
    )
    names = ["__none", "__id", "__digest"]
    single = given.groupBy(*names).agg(F.min_by("__all", "__order").alias("__all")).join(stay, names, "left_semi")
    return docs.where(~worded).unionByName(single.select("__all.*"))
