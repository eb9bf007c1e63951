"""Quality classification by co-training on two views of a document.

The content view describes the text (characters, words, repetition); the
metadata view describes the page (source, language, recorded length, layout of
its lines). Two logistic classifiers start from the labelled rows. In each round
each of them labels the unlabelled rows it is surest of, in the proportion of
the classes, and hands them to the other view's training rows. Afterwards each
view is calibrated on labelled rows that were kept apart, the two calibrated
views are combined, and all documents are scored.

The fit uses about ``labelled`` labelled rows, chosen by a hash of the id within
each class: a class below half of them is used whole, and every row stands for as
many as its class was thinned by. The rounds choose among all other rows: each
scores them where they lie and takes the ``SHARE`` of ``unlabelled`` rows (of all,
if there are fewer) it is surest of. Every text is read and scored in full.

Defined results: null and empty texts have all-zero content features and get a
score like others; null metadata counts as a value of its own. Several labels of
one document are averaged, ties and null labels are not used. Without labels of
both classes everything is kept with score 1. Rows without an id are scored, not
trained on. An empty table gives an empty result. Other columns are ignored by
``classify`` and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import sized, ready_workers, stored

LABELLED, UNLABELLED = 10_000, 10_000
ROUNDS = 5
SURE = 0.9
SHARE = 0.05
PSEUDO_WEIGHT = 0.5
# Shares in which the surest rows of all tasks are thinned.
SHARES = 256
# Documents are rejected only when good quality is unlikely, so that clean ones stay.
THRESHOLD = 0.25
SOURCE_BINS, LANG_BINS = 32, 16
_SYMBOLS = b"#$%&*@|<>{}[]\\^~`_+=/"
SCORED = "doc_id long, content_score double, metadata_score double, score double, kept boolean"


def content_features(text: str | None) -> list[float]:
    """Numbers that describe the whole text."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(raw):
        return [0.0] * 16
    counts = np.bincount(raw, minlength=256)
    size = len(raw)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, symbols = counts[48:58].sum(), counts[list(_SYMBOLS)].sum()
    words = text.split()
    n = max(len(words), 1)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(3)] + [0, 0, 0]
    lines = [line for line in text.split("\n") if line]
    marks = counts[[46, 33, 63]].sum()
    return [
        np.log1p(n), upper / max(upper + lower, 1), digits / size, symbols / size, counts[33] / size,
        (counts[33:48].sum() + counts[58:65].sum()) / size, counts[128:].sum() / size, counts[:32].sum() / size,
        len(seen) / n, top[0] / n, sum(top[:3]) / n, sum(map(eq, words, words[1:])) / n,
        sum(map(len, words)) / n / 10, marks / n, sum(len(w) <= 3 for w in words) / n,
        1 - len(set(lines)) / max(len(lines), 1),
    ]


def metadata_features(source: str | None, lang: str | None, n_chars: int | None, text: str | None) -> list[float]:
    """Numbers that describe the page around the text."""
    lengths = [len(line) for line in (text or "").split("\n")]
    slots = [0.0] * (SOURCE_BINS + LANG_BINS)
    slots[zlib.crc32(str(source).encode()) % SOURCE_BINS] = 1.0
    slots[SOURCE_BINS + zlib.crc32(str(lang).encode()) % LANG_BINS] = 1.0
    return [
        np.log1p(max(n_chars or 0, 0)), np.log1p(len(lengths)), np.log1p(max(lengths)),
        np.log1p(sum(lengths) / len(lengths)), *slots,
    ]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0):
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rows = self.rows(x)
        keep = np.full(rows.shape[1], penalty)
        keep[-1] = 1e-3
        self.w = np.zeros(rows.shape[1])
        for _ in range(25):
            p = sigmoid(rows @ self.w)
            slope = rows.T @ (weight * (p - y)) + keep * self.w
            curve = (rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + np.diag(keep)
            step = np.linalg.solve(curve, slope)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.rows(x) @ self.w


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def first_rows(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` surest rows of each view and label, whatever the number of tasks that found some.

    They are thinned by share first, so that no task gets what all others found.
    """
    sure = F.when(F.col("label") == 1, -F.col("p")).otherwise(F.col("p"))
    for share in ([F.pmod(F.xxhash64("row"), F.lit(SHARES))], []):
        order = Window.partitionBy("view", "label", *share).orderBy(sure, "lot", "row")
        found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")
    return found


class Pool:
    """All rows without a label, described and stored; picked rows are gone."""

    def __init__(self, rows: DataFrame, size: int, unlabelled: int):
        """``rows`` are stored and have a ``row`` key and a ``lot`` that breaks ties."""
        self.rows, self.most = rows, min(size, unlabelled)
        self.gone: set[int] = set()

    def pick(self, views: list[Logistic], good: int, bad: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """For each view the features and labels of the rows it is surest of, at most ``good`` and ``bad``."""
        shared = self.rows.sparkSession.sparkContext.broadcast((views, np.array(sorted(self.gone), dtype=np.int64)))

        def surest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, gone = shared.value
            best: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, lot = batch.column("row").to_numpy(), batch.column("lot").to_numpy()
                for i, name in enumerate(("content", "metadata")):
                    p = sigmoid(views[i].logit(_numbers(batch.column(name))))
                    # The second view may find up to all rows of the first one taken.
                    for label, most, sure in ((1, good, p >= SURE), (0, bad, p <= 1 - SURE)):
                        here = sure & ~np.isin(row, gone)
                        new = [p[here], lot[here], row[here]]
                        old = best.get((i, label))
                        new = [np.concatenate(x) for x in zip(old, new, strict=True)] if old else new
                        order = np.lexsort((new[2], new[1], -new[0] if label else new[0]))
                        best[i, label] = [x[order[:most + i * (good + bad)]] for x in new]
            for (i, label), (p, lot, row) in best.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), i)), pa.array(np.full(len(p), label)), *map(pa.array, (p, lot, row))],
                    ["view", "label", "p", "lot", "row"],
                )

        found = first_rows(
            self.rows.mapInArrow(surest, "view long, label long, p double, lot long, row long"), max(good, bad) + good + bad
        ).toArrow()
        view, label, p, lot, row = (found.column(c).to_numpy() for c in found.column_names)
        taken: list[dict[int, float]] = []
        for i in (0, 1):
            here: dict[int, float] = {}
            for value, most in ((1, good), (0, bad)):
                at = np.flatnonzero((view == i) & (label == value))
                at = at[np.lexsort((row[at], lot[at], -p[at] if value else p[at]))]
                free = [x for x in row[at].tolist() if x not in self.gone]
                here |= dict.fromkeys(free[:most], float(value))
            self.gone |= set(here)
            taken.append(here)
        return [self.features(here) for here in taken]

    def features(self, labels: dict[int, float]) -> tuple[list[np.ndarray], np.ndarray]:
        if not labels:
            return [np.empty(0), np.empty(0)], np.empty(0)
        spark = self.rows.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(x,) for x in labels], "row long"))
        table = self.rows.join(wanted, "row").toArrow().combine_chunks()
        table = table.sort_by([("lot", "ascending"), ("row", "ascending")])
        parts = [np.array(table.column(c).to_pylist(), dtype=float) for c in ("content", "metadata")]
        return parts, np.array([labels[x] for x in table.column("row").to_pylist()])


class CoTrained:
    """Two views, their calibrations, and how they are combined."""

    def __init__(self, labelled: list[np.ndarray], y: np.ndarray, stands_for: np.ndarray, pool: Pool, rounds: int = ROUNDS):
        apart = np.arange(len(y)) % 5 == 0
        if (stands_for != 1).any():
            # What was drawn by class is also split by class, or a rare one is missing on a side.
            for value in (0, 1):
                here = np.flatnonzero(y == value)
                apart[here] = np.arange(len(here)) % 5 == 0
        if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
            apart = np.zeros(len(y), dtype=bool)
        fit = ~apart
        extra: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        base = np.average(y[fit], weights=stands_for[fit])

        def view(i: int) -> Logistic:
            xs = [labelled[i][fit], *(x for x, _ in extra[i])]
            ys = [y[fit], *(labels for _, labels in extra[i])]
            weight = np.concatenate([stands_for[fit], *(np.full(len(x), PSEUDO_WEIGHT) for x, _ in extra[i])])
            return Logistic(np.vstack(xs), np.concatenate(ys), weight)

        self.views = [view(0), view(1)]
        take = int(np.ceil(SHARE * pool.most))
        for _ in range(rounds if take else 0):
            picked = pool.pick(self.views, int(np.ceil(take * base)), int(np.ceil(take * (1 - base))))
            for i, (views, labels) in enumerate(picked):
                if len(labels):
                    extra[1 - i].append((views[1 - i], labels))
            self.views = [view(0), view(1)]
        # With too few rows to keep some apart, the training rows calibrate.
        held = apart if apart.any() else fit
        logits = [v.logit(x[held])[:, None] for v, x in zip(self.views, labelled, strict=True)]
        self.calibrated = [Logistic(z, y[held], stands_for[held]) for z in logits]
        both = np.hstack([c.logit(z)[:, None] for c, z in zip(self.calibrated, logits, strict=True)])
        self.combined = Logistic(both, y[held], stands_for[held])

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: content, metadata, combined."""
        parts = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, views, strict=True)]
        return sigmoid(parts[0]), sigmoid(parts[1]), sigmoid(self.combined.logit(np.column_stack(parts)))


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    columns = [batch.column(c).to_pylist() for c in ("source", "lang", "n_chars", "text")]
    content = [content_features(text) for text in columns[3]]
    metadata = [metadata_features(*row) for row in zip(*columns, strict=True)]
    return [np.array(content, dtype=float), np.array(metadata, dtype=float)]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            content, metadata = _views(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(list(content.tolist()), pa.list_(pa.float64())),
                 pa.array(list(metadata.tolist()), pa.list_(pa.float64()))], ["doc_id", "label", "content", "metadata"],
            )


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def train(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS
) -> CoTrained | None:
    """Fit on labelled rows of ``docs`` and all the others; None without both classes."""
    ready_workers(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.avg("quality").alias("mean")).filter("mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).cast("double").alias("label"))
    known = stored(known, "known-labels")
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).join(sized(known, 24), "doc_id", "left")
    sizes = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    good, bad = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not good or not bad:
        return None
    # A class below half of the rows leaves the others to the other class.
    share = {
        value: min(1.0, max(labelled / 2, labelled - other) / size) for value, size, other in ((1.0, good, bad), (0.0, bad, good))
    }
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    chosen = F.col("label").isNull() | (lot < F.when(F.col("label") == 1, share[1.0]).otherwise(share[0.0]))
    rows = _columns(docs).filter("doc_id is not null").join(sized(known, 24), "doc_id", "left").filter(chosen)
    described = rows.select("doc_id", "text", "lang", "source", "n_chars", "label").mapInArrow(
        _described, "doc_id long, label double, content array<double>, metadata array<double>"
    ).withColumn("row", F.monotonically_increasing_id()).withColumn("lot", F.xxhash64("doc_id"))
    described = stored(described, "training-rows")
    table = described.filter("label is not null").orderBy("lot", "doc_id", "content").toArrow()
    label = table.column("label").to_numpy()
    views = [
        np.array(table.column(c).to_pylist(), dtype=float).reshape(len(label), -1) for c in ("content", "metadata")
    ]
    if len(set(label)) < 2:
        raise ValueError("no row of a labelled class was drawn")
    stands_for = np.where(label == 1, good / (label == 1).sum(), bad / (label == 0).sum())
    pool = Pool(described.filter("label is null").select("row", "lot", "content", "metadata"), sizes.get(None, 0), unlabelled)
    return CoTrained(views, label, stands_for, pool, rounds)


def score(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of every row, and whether it is kept."""
    ready_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ones = np.ones(batch.num_rows)
            parts = shared.value.score(_views(batch)) if shared.value else (ones, ones, ones)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, parts), pa.array(parts[2] >= threshold)],
                ["doc_id", "content_score", "metadata_score", "score", "kept"],
            )

    return _columns(docs).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``."""
    return score(docs, train(docs, labels, **options), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier keeps."""
    model = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and shared.value:
                batch = batch.filter(pa.array(shared.value.score(_views(batch))[2] >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
