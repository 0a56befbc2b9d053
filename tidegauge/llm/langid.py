"""Language of a text: averaged hashed subword embeddings and a linear softmax, with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import digest_sample, fresh, quoted, stored

UNDETERMINED = "und"
ASCII_LETTER = re.compile(r"[A-Za-z]")
# ASCII other than letters turns into blanks, which mark where words begin and end.
LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
SUBWORD_BYTES = (3, 4)
BLOCK = 1 << 20

PREDICTION = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)
BAGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("buckets", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )
)


@dataclass(frozen=True)
class LanguageSettings:
    """Bounds and rates of the training; the sample is the only bounded part."""

    per_language: int = 600  # labelled documents per language, those with the lowest digests
    most_documents: int = 4800  # of all languages together, with equal parts
    learned_bytes: int = 8192  # a longer document teaches with a part of so many bytes, at a place its digest names
    bits: int = 16  # 2 ** bits buckets
    dim: int = 16
    epochs: int = 4
    least_steps: int = 20_000  # a small sample is learned in more epochs
    rate: float = 2.0
    piece_bytes: int = 160  # a short piece of each sampled document is learned besides the whole
    calibration_share: float = 0.25
    min_confidence: float = 0.5  # calibrated; less confident predictions are rejected
    seed: int = 11


def has_letter(text: str) -> bool:
    """Whether a text has a letter: numbers in any form, such as fractions or raised digits, are none."""
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def subword_buckets(data: bytes, bits: int) -> Iterator[np.ndarray]:
    """Hash buckets of all subwords of a lower-case text, in blocks: a long text is never expanded whole."""
    data = b" " + data.translate(LETTERS_ONLY) + b" "
    longest = max(SUBWORD_BYTES)
    for start in range(0, max(1, len(data) - longest + 1), BLOCK):
        codes = np.frombuffer(data, np.uint8, min(BLOCK + longest - 1, len(data) - start), start).astype(np.uint32)
        n_starts = min(BLOCK, len(codes))
        for size in SUBWORD_BYTES:
            n = min(n_starts, len(codes) - size + 1)
            if n <= 0:
                continue
            packed = np.full(n, size, np.uint32)
            for i in range(size):
                packed = packed * np.uint32(257) + codes[i : i + n]
            yield (packed * np.uint32(2654435761)) >> np.uint32(32 - bits)


def bag(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each occurs."""
    counts = np.zeros(1 << bits, np.int64)
    for buckets in subword_buckets(data, bits):
        counts += np.bincount(buckets, minlength=1 << bits)
    hit = np.flatnonzero(counts)
    return hit, counts[hit]


@dataclass(frozen=True)
class LanguageModel:
    """``table`` is embeddings times output weights: one row of logits per bucket."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: LanguageSettings

    def probabilities(self, data: bytes) -> np.ndarray:
        """Calibrated probabilities of the whole text's languages."""
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subword_buckets(data, self.settings.bits):
            total += self.table[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return softmax((total / max(n, 1) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        found = self.probabilities(text.lower().encode("utf-8", "replace"))
        best = int(found.argmax())
        score = float(found[best])
        return self.languages[best], score, score < self.settings.min_confidence


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _sample(docs: DataFrame, settings: LanguageSettings, text: str, lang: str, row_id: str) -> DataFrame:
    """Bags of a bounded sample: lang, digest, bags. Texts are read for chosen rows only."""
    known = docs.where(F.col(quoted(lang)).isNotNull() & F.col(quoted(text)).isNotNull())
    known = known.select(F.col(quoted(row_id)).alias("id"), F.col(quoted(lang)).cast("string").alias("lang"))
    # One number reaches the driver.
    n_languages = max(1, known.agg(F.count_distinct("lang")).first()[0])
    per_language = max(1, min(settings.per_language, settings.most_documents // n_languages))
    chosen = digest_sample(known, "lang", per_language, settings.seed, "id")
    chosen = chosen.select("id", "lang", F.xxhash64(F.lit(settings.seed), "id").alias("digest"))
    # per_language rows for each language at most.
    chosen = F.broadcast(stored(chosen.distinct(), "language_sample"))

    @F.arrow_udf(BAGS)
    def bags(texts: pa.Array, digests: pa.Array) -> pa.Array:
        rows = []
        for t, digest in zip(texts, digests.to_pylist()):
            data = t.as_py().lower().encode("utf-8", "replace")
            begins = [digest % max(1, len(data) - n) for n in (settings.learned_bytes, settings.piece_bytes)]
            rows.append([])
            for at, n in zip(begins, (settings.learned_bytes, settings.piece_bytes)):
                buckets, counts = bag(data[at : at + n], settings.bits)
                packed = buckets.astype(np.int32).tobytes(), counts.astype(np.float32).tobytes()
                rows[-1].append(dict(zip(("buckets", "counts"), packed)))
        kind = pa.struct([("buckets", pa.binary()), ("counts", pa.binary())])
        return pa.array(rows, pa.list_(kind))

    rows = docs.where(F.col(quoted(text)).isNotNull()).select(
        F.col(quoted(row_id)).alias("id"), F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("own")
    )
    joined = rows.join(chosen, "id").where("own = lang")
    return joined.select("lang", "digest", "id", bags("text", "digest").alias("bags"))


def train(
    docs: DataFrame, settings: LanguageSettings = LanguageSettings(), text: str = "text", lang: str = "lang", row_id: str = "doc_id"
) -> LanguageModel:
    """Fit on a bounded sample of the rows with a language; see :class:`LanguageSettings`.

    The sample's bags are brought to the driver, as Arrow tables that are read in place: at
    most ``most_documents`` rows, or one for each language, whose size ``learned_bytes``
    bounds. Without labelled rows the model knows no language.
    """
    sample = _sample(docs, settings, text, lang, row_id).toArrow()
    bags = sample["bags"].combine_chunks()
    # Digest, id, language and place of the bags.
    keys = zip(*[sample[c].to_pylist() for c in ("digest", "id", "lang")], range(sample.num_rows))
    rows = sorted(keys, key=lambda r: r[:3])
    languages = tuple(sorted({name for _, _, name, _ in rows}))
    if not languages:
        return LanguageModel((), np.zeros((1 << settings.bits, 0)), np.zeros(0), 1.0, settings)
    place = {name: i for i, name in enumerate(languages)}
    n_held = round(len(rows) * settings.calibration_share)

    def examples(part: list) -> list[tuple[np.ndarray, np.ndarray, int]]:
        found = []
        for *_, name, at in part:
            for b in bags[at].values:
                counts = np.frombuffer(b["counts"].as_buffer(), np.float32)
                if len(counts):
                    found.append((np.frombuffer(b["buckets"].as_buffer(), np.int32), counts / counts.sum(), place[name]))
        return found

    table, bias = _descend(examples(rows[n_held:]), len(languages), settings)
    held = examples(rows[:n_held])
    logits = np.array([weights @ table[buckets] + bias for buckets, weights, _ in held]).reshape(-1, len(languages))
    temperature = _temperature(logits, np.array([y for *_, y in held], int)) if len(held) else 1.0
    return LanguageModel(languages, table, bias, temperature, settings)


def _descend(
    examples: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, settings: LanguageSettings
) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on embeddings and output weights, with a falling rate."""
    random = np.random.default_rng(settings.seed)
    embeddings = random.uniform(-1, 1, (1 << settings.bits, settings.dim)).astype(np.float32) / settings.dim
    output = np.zeros((settings.dim, n_languages), np.float32)
    bias = np.zeros(n_languages, np.float32)
    # None if too little was sampled.
    steps = max(settings.epochs * len(examples), settings.least_steps) if examples else 0
    for step in range(steps):
        if step % len(examples) == 0:
            order = random.permutation(len(examples))
        buckets, weights, label = examples[order[step % len(examples)]]
        hidden = weights @ embeddings[buckets]
        error = softmax(hidden @ output + bias)
        error[label] -= 1
        error *= settings.rate * (1 - step / steps)
        back = output @ error
        output -= np.outer(hidden, error)
        bias -= 0.1 * error
        embeddings[buckets] -= weights[:, None] * back
    return embeddings @ output, bias.astype(np.float64)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the lowest log loss on held-out examples, from a geometric grid."""
    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean())

    return float(min(np.geomspace(0.25, 5, 61), key=loss))


def predicted(model: LanguageModel, text: str = "text") -> Column:
    """A struct column (lang_pred, score, rejected) for whole texts.

    A null, blank or letterless text is ``und`` with score 0 and rejected; so is every
    text if the model knows no language.
    """

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(PREDICTION.names, model.predict(t.as_py()))) for t in texts], PREDICTION_ARROW)

    return predict(F.col(quoted(text)).cast("string"))


PREDICTION_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of those names are replaced."""
    (found,) = fresh(docs, "_language")
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in PREDICTION.names]
    return docs.withColumn(found, predicted(model, text)).select(*kept, f"{found}.*")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    (found,) = fresh(docs, "_language")
    kept = docs.withColumn(found, predicted(model, text)).where(~F.col(f"{found}.rejected"))
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])
