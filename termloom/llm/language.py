"""Language identification with error-correcting output codes.

Languages get codewords of bits. For each bit a linear n-gram classifier (naive
Bayes over hashed character n-grams) tells the languages with that bit from the
others; every classifier also gets a weight, its accuracy on calibration rows. A
text's margins are decoded to the codeword of least weighted logistic loss; the
score is that language's share after a softmax, and a text whose two best
codewords are close is flagged as ambiguous. Texts are read to their end.

Every language found is learned. The fit uses about ``train_rows`` rows with a
language, evenly over the languages, and ``calibration_rows`` more, chosen by a
hash of the id, but never fewer than about ``least_rows`` of a language (all, if it
has fewer). The counts of the n-grams stay distributed; the driver holds what
grows with the bits, the log of the number of languages, and one codeword and
name a language. Predictions use nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
and so is everything if nothing can be learned. Rows without an id are not
trained on and not held out. Rows that repeat an id are predicted one by one. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ready_workers, sized, stored

BINS = 1 << 14
ORDERS = (2, 3)
TRAIN_ROWS, CALIBRATION_ROWS = 20_000, 2_000
LEAST_ROWS = 100
# Languages that a task counts at once, in dense form.
COUNTED = 128
SEED = 20240502
CLOSE = 0.2
UNKNOWN = "und"
_CHUNK = 1 << 20
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of the lower-cased text; ASCII without letters counts as space."""
    counts = np.zeros(BINS)
    longest = max(ORDERS)
    for i in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[i:i + _CHUNK + longest - 1].lower().encode("utf-32-le"), dtype="<u4")
        codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
        for order in ORDERS:
            places = len(codes) - order + 1
            if places > 0:
                mixed = np.full(places, order, dtype=np.uint32)
                for j in range(order):
                    mixed = (mixed ^ codes[j:j + places]) * _FACTORS[j]
                    mixed ^= mixed >> np.uint32(15)
                counts += np.bincount(mixed & np.uint32(BINS - 1), minlength=BINS)
    return counts


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language: all splits for few, else the best of random codes."""
    if languages <= 5:
        bits = (1 << max(languages - 1, 1)) - 1
        rows = [[1] * bits] + [[1 if (b >> (r - 1)) & 1 == 0 else -1 for b in range(1, bits + 1)] for r in range(1, languages)]
        return np.array(rows[:languages])
    rng = np.random.default_rng(SEED)
    bits = int(np.ceil(10 * np.log2(languages)))
    values = np.array([-1, 1], dtype=np.int8)
    # Comparing all pairs grows with the square; many languages get fewer draws, as long codes are apart by chance.
    tries = int(np.clip(100 * (128 / languages) ** 2, 1, 100))
    draws = (rng.choice(values, size=(languages, bits)) for _ in range(tries))
    if tries == 1:
        return next(draws)

    def nearest(code: np.ndarray) -> float:
        wide = code.astype(np.float32)
        agree = wide @ wide.T
        np.fill_diagonal(agree, -bits)
        # A column without both values tells nothing.
        return -agree.max() - bits * (np.abs(code.sum(axis=0, dtype=np.int64)) == languages).sum()

    return max(draws, key=nearest)


class LanguageModel:
    """Bit classifiers over n-gram counts, and the decoder."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray):
        """``low`` and ``high`` are, per bit, the largest typical margin without and the smallest with the bit."""
        self.languages, self.code = languages, code
        split = np.isfinite(low) & np.isfinite(high)
        low, high = np.where(split, low, 0), np.where(split, high, 0)
        middle, gap = (high + low) / 2, np.abs(high - low)
        self.bias = np.where(split, middle * 4 / (gap + 1e-9), 0)
        self.weights = weights * np.where(split, 4 / (gap + 1e-9), 1)
        self.trust = np.ones(code.shape[1])

    def margins(self, text: str) -> np.ndarray:
        counts = grams(text)
        return counts @ self.weights / max(counts.sum(), 1) - self.bias

    def calibrate(self, right: np.ndarray, seen: int) -> None:
        """Weigh each bit by how far its accuracy is above chance."""
        if seen:
            self.trust = np.maximum(2 * right / seen - 1, 0.01)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        # A bit of -1 instead of +1 adds its margin to the loss.
        loss = np.logaddexp(0, -margins) @ self.trust + (self.code < 0) @ (self.trust * margins)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(loss.argmin())
        runner = np.partition(share, -2)[-2] if len(share) > 1 else 0.0
        return self.languages[best], float(share[best]), bool(share[best] - runner < CLOSE)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sparse(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in total.items():
        bins = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int32)), pa.array(counts[bins])], ["lang", "bin", "n"]
        )
    total.clear()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in total and len(total) >= COUNTED:
                yield from _sparse(total)
            total[lang] = total.get(lang, 0) + grams(text)
    yield from _sparse(total)


def _fit(grams_of: DataFrame, languages: list[str]) -> LanguageModel:
    """The model from a stored table of ``lang, bin, n``, which is summed where it lies."""
    spark = grams_of.sparkSession
    code = codewords(len(languages))
    bits = code.shape[1]
    number = {x: i for i, x in enumerate(languages)}
    sizes = np.full(len(languages), 0.5 * BINS)
    for row in grams_of.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator():
        sizes[number[row["lang"]]] += row["n"]
    known = spark.sparkContext.broadcast((number, code, sizes))

    def shares(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number, _, sizes = known.value
        at = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
        return at, batch.column("bin").to_numpy(), batch.column("n").to_numpy() / sizes[at]

    def by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            at, bins, share = shares(batch)
            code = known.value[1][at]
            parts = np.hstack([(code < 0) * share[:, None], (code > 0) * share[:, None]])
            for i, x in enumerate(bins.tolist()):
                sums[x] = sums[x] + parts[i] if x in sums else parts[i].copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["bin", "sums"]
        )

    table = grams_of.repartition("bin").mapInArrow(by_bin, "bin int, sums array<double>").toArrow()
    rest = 0.5 / sizes
    sums = np.tile(np.concatenate([rest @ (code < 0), rest @ (code > 0)]), (BINS, 1))
    if table.num_rows:
        sums[table.column("bin").to_numpy()] += np.array(table.column("sums").to_pylist())
    minus, plus = (code < 0).sum(axis=0), (code > 0).sum(axis=0)
    both = (minus > 0) & (plus > 0)
    weights = np.zeros((BINS, bits))
    weights[:, both] = np.log((sums[:, bits:] / np.maximum(plus, 1))[:, both] / (sums[:, :bits] / np.maximum(minus, 1))[:, both])
    told = spark.sparkContext.broadcast((weights, weights.sum(axis=0)))

    def extremes(code: np.ndarray, typical: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.where(code < 0, typical, -np.inf).max(axis=0, initial=-np.inf)
        return low, np.where(code > 0, typical, np.inf).min(axis=0, initial=np.inf)

    def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, whole = told.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            at, bins, share = shares(batch)
            for x in np.unique(at).tolist():
                here = at == x
                sums[x] = sums.get(x, 0.5 / known.value[2][x] * whole) + share[here] @ weights[bins[here]]
        if sums:
            low, high = extremes(known.value[1][list(sums)], np.array(list(sums.values())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (low, high)], ["low", "high"]
            )

    found = grams_of.repartition("lang").mapInArrow(by_language, "low array<double>, high array<double>").collect()
    # Languages without any n-gram have even shares.
    bare = sizes == 0.5 * BINS
    low, high = extremes(code[bare], np.outer(rest[bare], told.value[1]))
    for row in found:
        low, high = np.maximum(low, row["low"]), np.minimum(high, row["high"])
    return LanguageModel(languages, code, weights, low, high)


def train(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS, least_rows: int = LEAST_ROWS
) -> LanguageModel | None:
    """Fit on rows with a language that are not held out; None if there is none."""
    spark = docs.sparkSession
    ready_workers(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).filter("doc_id is not null and lang is not null").filter(~held_out())
    sizes = stored(rows.groupBy("lang").count(), "languages")
    languages = sorted(r["lang"] for r in sizes.select("lang").toLocalIterator())
    if not languages:
        return None
    longest = max(len(x.encode()) for x in languages)

    def lot(bound: int, seed: int) -> Column:
        """Whether a row is in its language's share, by a hash of its id."""
        share = F.least(F.lit(1.0), F.lit(max(bound / len(languages), float(least_rows))) / F.col("count"))
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1e6 < share

    # The corpus is read once for both samples.
    sample = stored(
        rows.join(sized(sizes, longest + 24), "lang")
        .select("lang", "text", lot(train_rows, 1).alias("fit"), lot(calibration_rows, 2).alias("check"))
        .filter("(fit or check) and text is not null"), "language-sample",
    )
    summed = sample.filter("fit").select("lang", "text").mapInArrow(_counted, "lang string, bin int, n double")
    model = _fit(stored(summed.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "grams"), languages)
    number = {x: i for i, x in enumerate(languages)}
    shared = spark.sparkContext.broadcast((model, number))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = shared.value
        right, seen = np.zeros(model.code.shape[1]), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                right += (model.margins(text) > 0) == (model.code[number[lang]] > 0)
                seen += 1
        yield pa.RecordBatch.from_arrays([pa.array([right.tolist()], pa.list_(pa.float64())), pa.array([seen], pa.int64())], ["right", "seen"])

    checks = sample.filter("check").select("lang", "text").mapInArrow(measured, "right array<double>, seen long").collect()
    model.calibrate(sum(np.array(r["right"]) for r in checks), sum(r["seen"] for r in checks))
    return model


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The language of every row's whole text."""
    ready_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                shared.value.decode(shared.value.margins(text)) if shared.value and has_letter(text)
                else (UNKNOWN, 0.0, False)
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_()),
            ], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, PREDICTED)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on ``docs`` and predict all of them."""
    return predict(docs, train(docs, **options))
