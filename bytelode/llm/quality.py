"""Quality rules: statistics of each document, base rules, and gradient-boosted trees over the statistics.

Words are runs of other bytes than ASCII white space, unchanged. The trees are grown on histograms with a
logistic loss; on the features of ``MONOTONE`` no split and no leaf may reverse the stated direction.
They are flattened into arrays of nodes and score a batch in one numpy pass a level.

Fitting uses at most ``max_labelled`` labelled ids, those of the smallest hash, one row each (of rows that share an
id the one of the smallest statistics, of labels the best), in order of the ids, so that the trees don't depend on how
rows are dealt. Scoring covers all rows. With no labelled rows, or of one class only, the base rules alone decide.

Null and empty texts have no words and fail the base rules. Repeated rows each get a row. Rows without id are
judged and not learnt from. A column named like a result column gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import add_columns, column, texts_of
from ._shared import bounded_sample, table, tuned
from ._text import Words, flat, grams, mix

MAX_LABELLED = 20_000
#: A document goes when the trees give it less than this chance of being good.
THRESHOLD = 0.5
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHERS = ("n_upper", "n_lower", "n_digits", "n_marks", "n_lines", "n_distinct")
#: Chance of being good may only fall as these rise (-1), or is free (0).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": -1, "distinct_share": 0, "words_a_line": 0}
MONOTONE = tuple(FEATURES.values())


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS = {"n_symbols": _table(SYMBOLS), "n_upper": _table(bytes(range(65, 91))), "n_lower": _table(bytes(range(97, 123))), "n_digits": _table(bytes(range(48, 58))), "n_marks": _table(b"!?;:=@~^_\\/{}[]")}


def repeated_words(first: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Of each row: words in windows that occur twice or more in it."""
    n = len(h)
    g = grams(h, window)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    if not len(g):
        return np.zeros(len(count), np.int64)
    at = np.flatnonzero(row[: len(g)] == row[window - 1 :][: len(g)])
    key = mix(g[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int32)
    starts = at[twice]
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:n]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def statistics(col: pa.Array, texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of a batch."""
    buf, off = flat(col)
    words = Words(buf, off)
    h = words.hashes()
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    out = {"n_words": words.count, "word_chars": total(words.inside & ((buf & 0xC0) != 0x80))}
    out |= {name: total(is_[buf]) for name, is_ in _IS.items()}
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    key = mix(h ^ mix(words.row().astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[order[1:]] = key[order][1:] != key[order][:-1]
    some = np.concatenate([[0], np.cumsum(fresh)])
    return out | {"n_lines": lines, "n_dup_lines": dup, "n_repeat_words": repeated_words(words.first, h, WINDOW), "n_distinct": some[words.first[1:]] - some[words.first[:-1]]}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of FEATURES."""
    f = {k: v.astype(np.float64) for k, v in s.items()}
    words, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    columns = (np.log1p(f["n_words"]), f["word_chars"] / words, f["n_symbols"] / chars, f["n_dup_lines"] / np.maximum(f["n_lines"], 1), f["n_repeat_words"] / words, f["n_upper"] / np.maximum(f["n_upper"] + f["n_lower"], 1), f["n_digits"] / chars, f["n_marks"] / words, f["n_distinct"] / words, f["n_words"] / np.maximum(f["n_lines"], 1))
    return np.stack(columns, 1)


@dataclass(frozen=True)
class Trees:
    """Flattened trees: of each node its feature (-1: leaf), threshold, left child (right is the next) and value."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of being good."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                f = np.maximum(self.feature[node], 0)
                node = np.where(inner, self.left[node] + (x[rows, f] > self.threshold[node]), node)
            out += self.value[node]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 5.0, least: int = 10) -> Trees:
    """Boosted trees of logistic loss. Children of a monotone split keep to either side of the middle of their values."""
    cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    chance = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(chance / (1 - chance)))
    score = np.full(len(x), base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> None:
        G, H = g[rows].sum(), h[rows].sum()
        own = float(np.clip(G / (H + smooth), low, high))
        best = (1e-6, -1, 0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(gs / (hs + smooth), low, high), np.clip((G - gs) / (H - hs + smooth), low, high)
                gain = 2 * (gs * vl + (G - gs) * vr - G * own) - ((hs + smooth) * vl**2 + (H - hs + smooth) * vr**2 - (H + smooth) * own**2)
                gain[(ns < least) | (len(rows) - ns < least) | (monotone[j] * (vr - vl) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k] + vr[k]) / 2)
        if best[1] < 0:
            value[at] = rate * own
            score[rows] += rate * own
            return
        _, j, k, middle = best
        a, b = node(), node()
        feature[at], threshold[at], left[at] = j, float(cuts[j][k]), a
        side = binned[rows, j] <= k
        bounds = ((low, high), (low, high)) if not monotone[j] else ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle))
        grow(a, rows[side], g, h, *bounds[0], level + 1)
        grow(b, rows[~side], g, h, *bounds[1], level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(node())
        grow(roots[-1], np.arange(len(x)), y - p, np.maximum(p * (1 - p), 1e-6), -4.0, 4.0, 0)
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), base)


def add_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of COUNTS and OTHERS as longs."""
    tuned(docs.sparkSession)
    names = (*COUNTS, *OTHERS)

    def make():
        def run(part: pa.RecordBatch) -> list:
            s = statistics(column(part, text_col), texts_of(part, text_col))
            return [pa.array(s[n], pa.int64()) for n in names]

        return run

    return add_columns(docs, text_col, ", ".join(f"{n} long" for n in names), make)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Trees | None:
    """Trees fitted on a bounded sample of labelled rows; None where the labels don't show both classes."""
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    sample = bounded_sample(sample, id_col, max_labelled)
    # at most max_labelled rows of two numbers
    own = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    names = (*COUNTS, *OTHERS)
    one = add_statistics(own, text_col).groupBy(id_col).agg(F.min(F.struct("y", *names)).alias("s")).select(F.col(id_col).alias("id"), "s.*")
    got = one.toArrow().sort_by("id")
    y = got["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit(features({n: got[n].to_numpy() for n in names}), (y > 0).astype(np.float64), MONOTONE)


def judge(docs: DataFrame, trees: Trees | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with COUNTS, ``base_failed``, ``quality_score`` (null without trees) and ``kept``."""
    tuned(docs.sparkSession)

    def make():
        def run(part: pa.RecordBatch) -> list:
            s = statistics(column(part, text_col), texts_of(part, text_col))
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            good = trees.score(features(s)) if trees else None
            kept = ~failed & (good >= threshold if trees else True)
            return [*(pa.array(s[n], pa.int64()) for n in COUNTS), pa.array(failed), pa.array(good) if trees else pa.nulls(len(failed), pa.float64()), pa.array(kept)]

        return run

    return add_columns(docs, text_col, ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, quality_score double, kept boolean", make)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, with trees fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")


def quality_counts(spark, sf_dir: str) -> DataFrame:
    """The part of that which SQL can say: counts and base rules of every whole text."""
    return op7_quality(spark, sf_dir).select("doc_id", *COUNTS, "base_failed")


COUNTS_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM c, unnest(range(i, i + 5)) AS t(j) WHERE c.n > 1 GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN r USING (doc_id)
"""
