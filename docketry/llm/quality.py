"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``statistics``: shares of kinds of characters, words and lines of each text.
2. ``rules_of_trees``: small boosted trees are grown on labelled rows; every
   path from a root to a node is a rule, a conjunction of bounds.
3. ``fit_lasso``: logistic regression over the rules with an absolute penalty
   leaves few of them.
4. ``score_column``: the rules left become one Spark column expression.

Fitting uses at most ``FIT_ROWS`` labelled rows, those with the smallest key
hash, and so a bounded part of the driver.  Statistics and scores cover every
whole text.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docketry.llm.frames import named, slices, small_batches
from docketry.llm.words import cut_words, text_buffer, word_hashes

#: Most labelled rows that a fit takes.
FIT_ROWS = 20_000
TREES, TREE_DEPTH, BINS, LEARNING_RATE, LEAST_LEAF = 40, 3, 24, 0.4, 10
PENALTY, STEPS = 0.0008, 400
#: A text with this score or more is good.
GOOD = 0.7

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|<>{}[]\\/=_",
    "symbol": b"#$%&*@^~+",
}
STATISTICS = (
    *(f"{kind}_share" for kind in _KINDS),
    "wide_share",  # bytes beyond ASCII
    "words",  # logarithm of their number
    "word_bytes",
    "longest_word",  # logarithm of its bytes
    "distinct_words",
    "short_words",
    "upper_words",
    "marked_words",  # words that end in a symbol or bar
    "lines",  # words a line
    "repeated_lines",
)


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(bounds) - 1)


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Each statistic of each text; all zero for NULL and empty texts."""
    data, offsets = text_buffer(texts)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = np.zeros(256, dtype=np.uint8)
    for n, letters in enumerate(_KINDS.values(), 1):
        kind[list(letters)] = n
    kind[128:] = len(_KINDS) + 1
    kinds = kind[data]
    bounds = offsets.tolist()
    tally = np.array(
        [np.bincount(kinds[a:b], minlength=len(_KINDS) + 2) for a, b in zip(bounds, bounds[1:])]
    ).reshape(len(size), len(_KINDS) + 2)
    out = {f"{k}_share": tally[:, n] / size for n, k in enumerate(_KINDS, 1)}
    out["wide_share"] = tally[:, -1] / size
    words = cut_words(texts)
    length = words.end - words.start
    number = np.diff(words.row)
    safe = np.maximum(number, 1).astype(float)
    out["words"] = np.log1p(number)
    out["word_bytes"] = _counts_at(length, words.row) / safe
    longest = np.zeros(len(number))
    filled = number > 0
    if filled.any():
        longest[filled] = np.maximum.reduceat(length, words.row[:-1][filled])
    out["longest_word"] = np.log1p(longest)
    out["distinct_words"] = _distinct(word_hashes(words), words.row) / safe
    out["short_words"] = _counts_at(length <= 3, words.row) / safe
    lowers = np.concatenate([[0], np.cumsum(kinds == 2, dtype=np.int32)])
    uppers = np.concatenate([[0], np.cumsum(kinds == 1, dtype=np.int32)])
    loud = (lowers[words.end] == lowers[words.start]) & (uppers[words.end] - uppers[words.start] > 1)
    out["upper_words"] = _counts_at(loud, words.row) / safe
    last = kinds[words.end - 1]
    out["marked_words"] = _counts_at((last == 7) | (last == 8), words.row) / safe
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_end = line_end - (data[np.maximum(line_end, 1) - 1] == 10)
    full = line_end > line_start
    lines = words._replace(start=line_start[full], end=line_end[full])
    bounds = np.searchsorted(lines.start, offsets)
    n_lines = np.maximum(np.diff(bounds), 1)
    out["lines"] = np.log1p(number / n_lines)
    out["repeated_lines"] = 1.0 - np.maximum(_distinct(word_hashes(lines), bounds), 1) / n_lines
    return out


def _counts_at(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one DOUBLE column for each of :data:`STATISTICS`.

    Columns of the input with such a name are replaced.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[named(c) for c in docs.columns if c.lower() not in STATISTICS])
    schema = T.StructType(
        [*rows.schema.fields, *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = text_statistics(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(made[s], pa.float64()) for s in STATISTICS)],
                [*batch.schema.names, *STATISTICS],
            )

    return rows.mapInArrow(work, schema)


@dataclass(frozen=True)
class Bound:
    """``statistic > at`` if ``above``, else ``statistic <= at``."""

    statistic: str
    at: float
    above: bool

    def column(self) -> Column:
        return named(self.statistic) > self.at if self.above else named(self.statistic) <= self.at


Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """A base score and weighted rules; the logistic of their sum is the score."""

    base: float
    rules: tuple[tuple[Rule, float], ...]


def rules_of_trees(
    x: np.ndarray, y: np.ndarray, names: Sequence[str] = STATISTICS
) -> list[Rule]:
    """All paths of boosted trees grown on the rows of ``x``, each once."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    logit = np.full(len(y), np.log(rate / (1 - rate)))
    found: dict[frozenset, Rule] = {}

    def best_split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        best = (1e-6, None, None)
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = binned[rows, f]
            g = np.cumsum(np.bincount(b, grad[rows], len(cuts) + 1))[:-1]
            h = np.cumsum(np.bincount(b, hess[rows], len(cuts) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        return best[1:]

    def grow(rows: np.ndarray, path: Rule, grad: np.ndarray, hess: np.ndarray) -> None:
        if path:
            found.setdefault(frozenset(path), path)
        f, at = best_split(rows, grad, hess) if len(path) < TREE_DEPTH else (None, None)
        if f is None:
            logit[rows] += LEARNING_RATE * grad[rows].sum() / (hess[rows].sum() + 1)
            return
        low = binned[rows, f] <= at
        for part, above in ((rows[low], False), (rows[~low], True)):
            grow(part, (*path, Bound(names[f], float(edges[f][at]), above)), grad, hess)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        grow(np.arange(len(y)), (), y - p, p * (1 - p))
    return list(found.values())


def holds(rule: Rule, x: np.ndarray, names: Sequence[str] = STATISTICS) -> np.ndarray:
    """Whether each row of ``x`` meets the rule."""
    ok = np.ones(len(x), dtype=bool)
    for bound in rule:
        value = x[:, names.index(bound.statistic)]
        ok &= value > bound.at if bound.above else value <= bound.at
    return ok


def fit_lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of penalised logistic regression, by accelerated
    proximal steps."""
    n = len(y)
    step = 4.0 / max(np.linalg.norm(r, 2) ** 2 / n + 1.0, 1.0)
    weight = seen = np.zeros(r.shape[1], dtype=np.float32)
    base = base_seen = 0.0
    pace = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(r @ seen + base_seen)))
        gone = p - y
        next_weight = seen - step * (r.T @ gone.astype(np.float32) / n)
        next_weight = np.sign(next_weight) * np.maximum(np.abs(next_weight) - step * PENALTY, 0)
        next_weight = next_weight.astype(np.float32)
        next_base = base_seen - step * float(gone.mean())
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = np.float32((pace - 1) / next_pace)
        seen = next_weight + ahead * (next_weight - weight)
        base_seen = next_base + float(ahead) * (next_base - base)
        weight, base, pace = next_weight, next_base, next_pace
    return base, weight


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """The ensemble for statistics ``x`` and labels ``y`` (0 or 1).

    With one class, or no row, there are no rules and the score is the smoothed
    share of good rows.
    """
    if len(y) == 0 or y.min() == y.max():
        rate = (float(y.sum()) + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(rate / (1 - rate))), ())
    rules = rules_of_trees(x, y)
    if not rules:
        return fit(x, y[:0])
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float32)
    base, weight = fit_lasso(r, y)
    kept = [(rule, float(w)) for rule, w in zip(rules, weight) if abs(w) > 1e-4]
    return RuleEnsemble(float(base), tuple(kept))


def training_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fold: Column | None
) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``FIT_ROWS`` documents.

    Labels that are neither 0 nor 1 and ids that are NULL are left out; of
    several labels of one id the smallest counts.
    """
    asked = labels.select(named(doc_id).alias("_id"), named(label).cast("int").alias("_y"))
    asked = asked.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    if fold is not None:
        asked = asked.filter(fold)
    asked = asked.groupBy("_id").agg(F.min("_y").alias("_y"))
    sample = asked.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    texts = docs.select(named(doc_id).alias("_id"), named(text).cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(sample), "_id")  # at most FIT_ROWS short rows
    rows = statistics(chosen, "_text").drop("_text")
    rows = rows.orderBy(F.xxhash64("_id"), *rows.columns).limit(FIT_ROWS).toPandas()
    return rows[list(STATISTICS)].to_numpy(dtype=float), rows["_y"].to_numpy(dtype=float)


def score_column(model: RuleEnsemble) -> Column:
    """The score as an expression over the statistics columns."""
    total = F.lit(model.base)
    for rule, weight in model.rules:
        met = rule[0].column()
        for bound in rule[1:]:
            met = met & bound.column()
        total = total + F.when(met, F.lit(weight)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    fold: Column | None = None,
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``GOOD`` on).

    ``fold`` is a condition on ``_id`` that restricts the labels learnt from.
    Only statistics of the text enter a score, so equal texts score alike; NULL
    and empty texts score as the text without characters.  Columns of the input
    named ``score`` or ``predicted`` are replaced, all others stay, and so do
    all rows.
    """
    model = fit(*training_rows(docs, labels, doc_id, text, label, fold))
    kept = [named(c) for c in docs.columns if c.lower() not in ("score", "predicted")]
    renamed = docs.select(
        F.struct(*kept).alias("_row"), named(text).cast("string").alias("_text")
    )
    scored = statistics(renamed, "_text").select(
        "_row.*", score_column(model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
