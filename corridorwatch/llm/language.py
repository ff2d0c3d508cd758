"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors of hashed character 1- to 3-grams. A bounded sample of
labelled rows trains one weight vector per language with follow-the-regularised-leader
(per-coordinate rates, L1 and L2 penalties); a part of the sample, unseen in training,
then sets the temperature of the softmax.

Document frequencies count every labelled document that may be learned from. Only the
rows that the gradient steps see are bounded (``max_train_docs``).

Defined results: a null text or one without a letter gives ``und`` with score 0; so does
every text if there is nothing to learn from. Rows with a null label or null id are never
learned from but get a prediction. Repeated rows get the same prediction; of equal scores the
first language by name wins. Texts are read whatever their length, in blocks of ``BLOCK``
characters. An empty table gives no rows. Columns other than the named ones are not looked at,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows

BITS = 15
BLOCK = 1 << 20
UNKNOWN = "und"

_TO_SPACE = {c: " " for c in range(128) if not chr(c).isalpha()}


@dataclass(frozen=True)
class LanguageConfig:
    """``max_train_docs`` bounds the labelled rows of the fit; ``calibration_share`` of them set the temperature."""

    max_train_docs: int = 6000
    #: More labels than this are an error: the model holds a column of weights for each.
    max_languages: int = 1000
    calibration_share: float = 0.2
    steps: int = 800
    batch: int = 32
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    """Weights already multiplied with the inverse document frequencies, one column per language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    nonzero_share: float


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character 1- to 3-grams of the whole text, block by block."""
    text = " " + " ".join(text.lower().translate(_TO_SPACE).split()) + " "
    for start in range(0, len(text), BLOCK):
        # two characters of overlap: every n-gram is seen in exactly one block
        chars = np.frombuffer(text[start : start + BLOCK + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = min(BLOCK, len(text) - start)
        h1 = chars * np.uint32(2654435761)
        h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(2246822519) + h1[1:]
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(3266489917) + h1[2:]
        for n, h in enumerate((h1, h2, h3), start=1):
            h = (h[:own] + np.uint32(n)) * np.uint32(668265263)
            yield ((h ^ (h >> np.uint32(16))) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(1 << BITS, dtype=np.int64)
    for buckets in _grams(text):
        total += np.bincount(buckets, minlength=1 << BITS)
    index = np.flatnonzero(total)
    return index, total[index]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task: how many of the task's documents have the bucket."""
    seen, rows = np.zeros(1 << BITS, dtype=np.int64), 0
    flag = np.zeros(1 << BITS, dtype=bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            flag[:] = False
            for buckets in _grams(text):
                flag[buckets] = True
            seen += flag
            rows += 1
    index = np.flatnonzero(seen)
    # the number of documents travels as bucket -1
    yield pa.RecordBatch.from_pydict(
        {"bucket": np.append(index, -1).astype(np.int64), "n": np.append(seen[index], rows).astype(np.int64)}
    )


def _sample_features(columns: dict) -> dict:
    made = [_counts(t) for t in columns["text"]]
    return {
        "lang": columns["lang"],
        "draw": columns["draw"],
        "buckets": [m[0].astype("<i4").tobytes() for m in made],
        "shares": [(m[1] / m[1].sum()).astype("<f4").tobytes() for m in made],
    }


def fit_language(docs: DataFrame, may_learn: Column, config: LanguageConfig = LanguageConfig(), text: str = "text", label: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Train on rows where ``may_learn`` holds; at most ``max_train_docs`` of them reach the fit.

    The draw takes the same number from every language and depends on the key only.
    """
    usable = docs.where(may_learn & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}") & F.col(label).isNotNull() & F.col(key).isNotNull())
    labels = {r[0]: r[1] for r in usable.groupBy(F.col(label).alias("lang")).count().limit(config.max_languages + 1).collect()}
    if len(labels) > config.max_languages:
        raise ValueError(f"more than {config.max_languages} different labels in {label}")
    languages = tuple(sorted(labels))
    if not languages:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)

    table = usable.select(F.col(text).alias("text")).mapInArrow(_document_frequencies, "bucket bigint, n bigint")
    found = table.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(1 << BITS)
    inside = found["bucket"] >= 0
    frequency[found["bucket"][inside]] = found["n"][inside]
    n_docs = int(found["n"][~inside].sum())
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1.0

    quota = max(1, config.max_train_docs // len(languages))
    share = F.create_map(*[F.lit(x) for k, n in labels.items() for x in (k, min(1.0, quota / n))])
    draw = F.xxhash64(F.lit(config.seed), F.col(key).cast("string"))
    sampled = usable.select(F.col(text).alias("text"), F.col(label).alias("lang"), draw.alias("draw")).where(
        F.pmod("draw", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    )
    features = map_rows(sampled, _sample_features, "lang string, draw bigint, buckets binary, shares binary")
    rows = features.orderBy("draw", "lang").limit(config.max_train_docs).toArrow()
    return _train(rows, languages, idf, config)


@dataclass(frozen=True)
class _Sample:
    """Rows of the sample side by side, as they came from Arrow: ``buckets`` and ``shares`` of row i lie at ``at[i] : at[i + 1]``."""

    at: np.ndarray
    buckets: np.ndarray
    shares: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> _Sample:
        flat = [rows[c].cast(pa.large_binary()).combine_chunks() for c in ("buckets", "shares")]
        flat = [f.chunk(0) if isinstance(f, pa.ChunkedArray) else f for f in flat]
        offsets = [np.frombuffer(f.buffers()[1], "<i8", len(f) + 1) if len(f) else np.zeros(1, "<i8") for f in flat]
        values = [np.frombuffer(f.buffers()[2] or b"", kind) for f, kind in zip(flat, ("<i4", "<f4"))]
        return _Sample(offsets[0] // 4, *values)

    def row(self, i: int, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of row i and their shares times ``factor``."""
        part = slice(self.at[i], self.at[i + 1])
        return self.buckets[part], self.shares[part] * factor[self.buckets[part]]


def _train(rows: pa.Table, languages: tuple[str, ...], idf: np.ndarray, config: LanguageConfig) -> LanguageModel:
    sample, n, n_lang = _Sample.of(rows), len(rows), len(languages)
    norm = float(np.mean([np.sqrt((sample.row(i, idf)[1] ** 2).sum()) for i in range(n)])) if n else 1.0
    scale = idf / max(norm, 1e-12)  # vectors of length one on average
    target = np.array([languages.index(x) for x in rows["lang"].to_pylist()], dtype=int)
    order = np.random.default_rng(config.seed).permutation(n)
    n_held = int(n * config.calibration_share)
    held, train = order[:n_held], order[n_held:]

    size = (1 << BITS) + 1  # the last coordinate is the bias
    z, acc = np.zeros((size, n_lang)), np.zeros((size, n_lang))

    def weights(at: np.ndarray) -> np.ndarray:
        """The leader's closed form: exact zeros where the L1 penalty wins."""
        zi = z[at]
        w = -(zi - np.sign(zi) * config.l1) / ((config.beta + np.sqrt(acc[at])) / config.alpha + config.l2)
        return np.where(np.abs(zi) <= config.l1, 0.0, w)

    def step(batch: np.ndarray) -> None:
        own = [sample.row(i, scale) for i in batch]
        flat = np.concatenate([np.append(index, size - 1) for index, _ in own])
        vals = np.concatenate([np.append(value, 1.0) for _, value in own])
        row = np.repeat(np.arange(len(batch)), [len(index) + 1 for index, _ in own])
        at, inverse = np.unique(flat, return_inverse=True)
        w = weights(at)
        logits = np.stack([np.bincount(row, vals * w[inverse, k], len(batch)) for k in range(n_lang)], axis=1)
        p = _softmax(logits)
        p[np.arange(len(batch)), target[batch]] -= 1.0
        grad = np.stack([np.bincount(inverse, vals * p[row, k], len(at)) for k in range(n_lang)], axis=1) / len(batch)
        sigma = (np.sqrt(acc[at] + grad * grad) - np.sqrt(acc[at])) / config.alpha
        z[at] += grad - sigma * w
        acc[at] += grad * grad

    rng, left = np.random.default_rng(config.seed + 1), train[:0]
    for _ in range(config.steps if len(train) else 0):
        if not len(left):
            left = rng.permutation(train)
        step(left[: config.batch])
        left = left[config.batch :]
    w = weights(np.arange(size))
    matrix, bias = (w[:-1] * scale[:, None]).astype(np.float32), w[-1]
    logits = np.array([value @ w[index] + bias for index, value in (sample.row(i, scale) for i in held)]).reshape(-1, n_lang)
    return LanguageModel(languages, matrix, bias, _temperature(logits, target[held]), float((w != 0).mean()))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows, by golden-section search on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / math.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(p)), target], 1e-12)).mean())

    low, high, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def predict_language(docs: DataFrame, model: LanguageModel, columns: list[str], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The named columns and the prediction, as columns ``lang`` and ``score``, for every row.

    Inside, columns go by their place, so any names may be asked for.
    """
    places, found_lang, found_score = _placed(docs, columns), "__lang", "__score"
    predicted = _predicted(docs, model, places, text)
    given = [F.col(place).alias(name) for place, (name, _) in places.items()]
    return predicted.select(*given, F.col(found_lang).alias(lang), F.col(found_score).alias(score))


def recognised(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model recognises, with the columns of ``docs``, whatever their names.

    A text without a letter has no language. Others go if their score stays below
    ``least_score``; a model without languages knows nothing against any text.
    """
    places = _placed(docs, docs.columns)
    predicted = _predicted(docs, model, places, text)
    if model.languages:
        known = (F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score(len(model.languages)))
    else:
        known = F.col("__letter")
    return predicted.where(known).select(*[F.col(place).alias(name) for place, (name, _) in places.items()])


def least_score(languages: int) -> float:
    """A fifth more than an even guess among the languages, one half at most."""
    return min(0.5, 1.2 / languages)


def _placed(docs: DataFrame, columns: list[str]) -> dict[str, tuple[str, str]]:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return {f"c{i}": (name, kinds[name]) for i, name in enumerate(columns)}


def _predicted(docs: DataFrame, model: LanguageModel, places: dict[str, tuple[str, str]], text: str) -> DataFrame:
    """Columns by place, __letter, __lang and __score; a text among the columns travels once."""
    at = next((place for place, (name, _) in places.items() if name == text), "__text")
    languages, weights, bias, temperature = model.languages, model.weights, model.bias, model.temperature

    def predict(batch: dict) -> dict:
        lang, score = [], []
        for value, has_letter in zip(batch[at], batch["__letter"]):
            if not has_letter or not languages:
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            total, n = np.zeros(len(languages)), 0
            for buckets in _grams(value):
                total += weights[buckets].sum(axis=0, dtype=np.float64)
                n += len(buckets)
            p = _softmax(((total / n + bias) / temperature)[None, :])[0]
            best = int(p.argmax())
            lang.append(languages[best])
            score.append(float(p[best]))
        return {"__lang": lang, "__score": score}

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    whole = [] if at in places else [F.col(text).alias(at)]
    given = docs.select(*[F.col(f"`{name}`").alias(place) for place, (name, _) in places.items()], *whole, letter.alias("__letter"))
    schema = ", ".join(f"{place} {kind}" for place, (_, kind) in places.items()) + ", __letter boolean, __lang string, __score double"
    return map_rows(given, predict, schema, keep=(*places, "__letter"), unread=tuple(p for p in places if p != at))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row; the model learns from rows outside the held-out quarter."""
    model = fit_language(docs, ~held_out(), config)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out().alias("held_out"))
    return predict_language(rows, model, ["doc_id", "held_out"])
