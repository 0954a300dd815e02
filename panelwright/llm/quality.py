"""Document quality by a sparse ensemble of rules (operator 10).

Shallow boosted trees are grown on text statistics of labelled rows; every path from a root to a node becomes
a conjunctive rule ("share of symbols > 0.1 and distinct words <= 0.5"). A lasso logistic regression over the
rules keeps few of them, and those are compiled into one Spark column, so scoring is a projection. Labels, language, source and id never enter the statistics.

Scale: statistics come from one vectorised pass over the bytes of a run of texts, without a shuffle.
Training takes at most ``max_train`` labelled rows, drawn by a hash of the id: the only bounded step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text_arrays as T
from panelwright.session import durable

MAX_TRAIN = 20_000
CUTOFF = 0.3
HOLD_OUT = 5
Condition = tuple[str, bool, float]  # statistic, above (else not above), threshold


NAMES = ("log_words", "word_length", "upper", "symbols", "digits", "bare", "distinct", "repeats", "sentence_ends", "line_words")
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 digit, 3 symbol, 4 newline, 5 end of a sentence, 6 inside a character
_CLASS[65:91], _CLASS[48:58], _CLASS[10], _CLASS[128:192] = 1, 2, 4, 6
_CLASS[[*range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = 3
_CLASS[[33, 46, 63]] = 5
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per text, all from 0 upwards; all are 0 for an empty text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = np.bincount(row * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    chars = np.maximum(size - kind[:, 6], 1)
    starts, ends, rows = T.words(~T.BLANK[data], offsets)
    hashes = T.span_hashes(T.FOLD[data], starts, ends)
    per_row = lambda mask=None: np.bincount(rows if mask is None else rows[mask], minlength=n)[:n]
    count = per_row()
    words = np.maximum(count, 1)
    letters = np.concatenate([[0], np.cumsum(_ALNUM[data])])
    bare = letters[ends] == letters[starts]
    closing = _CLASS[data[ends - 1]] == 5 if len(ends) else bare
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])]) if len(rows) else bare
    _, first = np.unique(T.mix(hashes + T.mix(rows.astype(np.uint64))), return_index=True)
    return np.stack(
        [
            np.log1p(count), (size - np.bincount(row[T.BLANK[data]], minlength=n)[:n]) / words, kind[:, 1] / chars, kind[:, 3] / chars, kind[:, 2] / chars, per_row(bare) / words,
            np.bincount(rows[first], minlength=n)[:n] / words, per_row(again) / words, per_row(closing) / words, np.where(size > 0, count / (kind[:, 4] + 1), 0.0),
        ],
        1,
    )


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctive rules: ``score = sigmoid(bias + sum of weights of rules that hold)``."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, edge in rule:
                holds = holds & ((stats[name] > edge) if above else (stats[name] <= edge))
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, names: list[str], target: np.ndarray, trees: int, depth: int, rate: float, edges: int = 32, least: int = 20) -> set[tuple[Condition, ...]]:
    """Paths of boosted regression trees on the logistic gradient, over quantile-binned statistics."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, edges))) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)  # bin b: cuts[b - 1] < value <= cuts[b]
    prior = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    margin, paths = np.full(len(x), np.log(prior / (1 - prior))), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = target - p, p * (1 - p)
        nodes = [(np.arange(len(x)), ())]
        for level in range(depth + 1):
            below = []
            for rows, path in nodes:
                best = (1e-6, None)
                if level < depth and len(rows) >= 2 * least:
                    whole_g, whole_h = slope[rows].sum(), bend[rows].sum() + 1.0
                    for j, c in enumerate(cuts):
                        g = np.cumsum(np.bincount(binned[rows, j], slope[rows], len(c) + 1))[:-1]
                        h = np.cumsum(np.bincount(binned[rows, j], bend[rows], len(c) + 1))[:-1]
                        n = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))[:-1]
                        gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h) - whole_g**2 / whole_h
                        gain = np.where((n >= least) & (len(rows) - n >= least), gain, -1)
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), (j, int(gain.argmax())))
                if best[1] is None:
                    margin[rows] += rate * slope[rows].sum() / (bend[rows].sum() + 1.0)
                    continue
                j, b = best[1]
                left = binned[rows, j] <= b
                for part, above in ((rows[left], False), (rows[~left], True)):
                    paths.add(tuple(sorted({*path, (names[j], above, float(cuts[j][b]))})))
                    below.append((part, (*path, (names[j], above, float(cuts[j][b])))))
            nodes = below
    return paths


def lasso_logistic(r: np.ndarray, target: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the mean log loss with an l1 penalty; the bias is not penalised."""
    n, m = r.shape
    step = 4.0 / max((r**2).sum(1).mean() + 1, 1.0)
    bias, w = 0.0, np.zeros(m)
    ahead_b, ahead_w, pace = bias, w, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(ahead_b + r @ ahead_w))) - target
        new_b, moved = ahead_b - step * error.mean(), ahead_w - step * (r.T @ error) / n
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead_b, ahead_w = new_b + (pace - 1) / next_pace * (new_b - bias), new_w + (pace - 1) / next_pace * (new_w - w)
        bias, w, pace = new_b, new_w, next_pace
    return bias, w


def fit(x: np.ndarray, names: list[str], target: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, penalty: float = 1e-3) -> RuleModel:
    """Rules and weights from a sample; with one class or no rows, a constant score (their mean, 0.5 without rows)."""
    if len(target) == 0 or target.min() == target.max():
        mean = float(np.clip(target.mean(), 0.01, 0.99)) if len(target) else 0.5
        return RuleModel(float(np.log(mean / (1 - mean))))
    paths = sorted(grow(x, names, target, trees, depth, rate))
    at = {n: j for j, n in enumerate(names)}
    held = np.stack([np.all([(x[:, at[n]] > e) == above for n, above, e in p], axis=0) for p in paths], 1).astype(float) if paths else np.zeros((len(x), 0))
    # Rules that hold for the same rows say the same; keep the shortest.
    seen: dict[bytes, int] = {}
    for j in sorted(range(len(paths)), key=lambda j: len(paths[j])):
        seen.setdefault(held[:, j].tobytes(), j)
    kept = sorted(seen.values())
    bias, w = lasso_logistic(held[:, kept], target, penalty)
    return RuleModel(float(bias), [(paths[j], float(v)) for j, v in zip(kept, w, strict=True) if v])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus one double per statistic, named ``stat_...`` (existing columns of these names are replaced)."""
    added = [f"stat_{x}" for x in NAMES]
    kept = [c for c in docs.columns if c not in added]
    at, rows = kept.index(text_col), docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.select("*", *[F.lit(None).cast("double").alias(x) for x in added]).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in T.runs(batch.column(at)):
                values = statistics(data, offsets)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, values.T)], [*kept, *added])

    return rows.mapInArrow(measure, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    """Fit on labelled rows whose id is not held out: at most ``max_train``, those with the smallest hash of the id.

    Statistics are computed only for documents up to the hash of the last drawn label. Rows without an id or
    a label don't count; of an id labelled twice the smaller label holds.
    """
    names = [f"stat_{x}" for x in NAMES]
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label")).withColumn("draw", F.xxhash64("id")).orderBy("draw", "id").limit(max_train)
    known = durable(known)
    last = known.agg(F.max("draw")).first()[0]
    if last is None:
        return fit(np.zeros((0, len(names))), names, np.zeros(0))
    ids = docs.select(F.col(f"`{id_col}`").cast(known.schema["id"].dataType).alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.xxhash64("id") <= last)
    rows = with_statistics(ids, "text").drop("text").join(known, "id").orderBy("draw", "id", *names).limit(max_train).select(*names, "label").collect()
    data = np.array(rows, dtype=float).reshape(-1, len(names) + 1)
    return fit(data[:, :-1], names, (data[:, -1] > 0.5).astype(float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF, max_train: int = MAX_TRAIN) -> DataFrame:
    """All columns of ``docs`` plus ``held_out``, ``score`` and ``predicted`` (existing ones of these names are replaced).

    Null and empty texts get the score of all-zero statistics. Every row comes back once; repeated rows score
    alike. A null id is not held out and never trains. Without usable labels the score is 0.5 throughout.
    """
    model = train(docs, labels, id_col, text_col, max_train=max_train)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = with_statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("text")), "text")
    score = model.score({f"stat_{x}": F.col(f"stat_{x}") for x in NAMES})
    rows = rows.select("row", score.alias("score")).select("row.*", held_out(F.col("row")[id_col]).alias("held_out"), "score")
    return rows.withColumn("predicted", F.when(F.col("score") >= cutoff, 1).otherwise(0))
