"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled rows by a likelihood-ratio test;
features are densities of its hits, their nearness to second-person words, and rates of capitals,
punctuation and obfuscation. Fitting uses a bounded sample of labelled rows; scoring reads every
row and whole text once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import frugal, materialise, slices, text_of

#: Bound of the sample of labelled rows that the lexicon, the trees and the calibration are fitted on.
MAX_TRAIN_ROWS = 20_000
#: Folds of the labelled rows: each is scored by what the others have taught.
FOLDS = 4
#: Bound of the lexicon.
MAX_LEXICON = 20_000
#: Least likelihood ratio (chi-square, one degree) of a lexicon entry: one chance in some millions.
LEAST_RATIO = 26.0
PREFIXES = (4, 5, 6)
# Second-person words of English, German, French and Spanish (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su tus".split())
# Stand-ins for letters (fixed values).
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_JOINT = re.compile(r"[0-9@$!*._\-]+(?=[^\W\d_])")
_JOINERS = re.compile(r"[^\w]|_")
_CAPS = re.compile(r"\b[A-ZÀ-Þ]{2,}\b")
_MARKS = re.compile(r"[^\w\s]")
_REPEATS = re.compile(r"(.)\1\1")
NEAR = 5
FEATURES = 18


def _obfuscated(low: str) -> list[str]:
    """White-space separated strings with digits or signs inside a word, or with digits or @ and $ that lead one."""
    out, done, left, since = [], 0, 0, 0
    for m in _JOINT.finditer(low):
        at = m.start()
        if at < done or not (low[at - 1 : at].isalpha() or (m[0][0] in "0123456789@$" and not low[at - 1 : at].strip())):
            continue
        left = max(left, max(low.rfind(blank, since, at) for blank in " \n\t") + 1)  # no stretch is searched twice
        since = at
        right = next((i for i in range(m.end(), len(low)) if low[i].isspace()), len(low))
        out.append(low[left:right])
        done = right
    return out


def words_of(low: str) -> tuple[list[str], list[str]]:
    """(words of a lower-cased text, words read from obfuscated spellings)."""
    hidden = [w for m in _obfuscated(low) for w in (_JOINERS.sub("", m.translate(_LEET)),) if w.isalpha()]
    return _WORD.findall(low), hidden


def _beginnings(word: str) -> list[str]:
    return ["^" + word[:k] for k in PREFIXES if len(word) > k]


def _capitals(text: str, low: str) -> int:
    if len(text) != len(low):
        return sum(map(str.isupper, text))
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (text, low))
    return int(np.count_nonzero(a != b))


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, in toxic texts, in others): how many texts of the partition hold a word or word beginning."""
    counts = (Counter(), Counter())
    for batch in slices(batches, "text"):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words, hidden = words_of(text.lower())
            tokens = {*words, *hidden}
            tokens |= {b for w in tokens for b in _beginnings(w)}
            counts[1 if label else 0].update(tokens)
    tokens = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([counts[1][t] for t in tokens], pa.int64()), pa.array([counts[0][t] for t in tokens], pa.int64())], names=["token", "toxic", "other"])


def features(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES))
    start = {t[1:]: w for t, w in lexicon.items() if t[0] == "^"}.get
    p, q, r = PREFIXES
    for i, text in enumerate(texts):
        low = text.lower()
        words, hidden = words_of(low)
        n, chars = max(1, len(words)), max(1, len(text))
        at = [j for j, w in enumerate(words) if w in lexicon]
        weights = [lexicon[words[j]] for j in at]
        begun = [max(start(w[:p], 0.0), start(w[:q], 0.0) if len(w) > q else 0.0, start(w[:r], 0.0) if len(w) > r else 0.0) for w in set(words) if len(w) > p]
        begun = [w for w in begun if w > 0]
        masked = [lexicon[w] for w in hidden if w in lexicon]
        people = [j for j, w in enumerate(words) if w in SECOND_PERSON]
        following = [bisect_left(people, j - NEAR) for j in at]  # the first that is not too far before
        near = sum(k < len(people) and people[k] <= j + NEAR for j, k in zip(at, following, strict=True))
        capitals = _capitals(text, low)
        marks = len(_MARKS.findall(text))
        out[i] = (
            len(at) / n, np.log1p(len(at)), max(weights, default=0.0), sum(weights), len(set(words[j] for j in at)),
            len(begun) / n, np.log1p(len(begun)), max(begun, default=0.0), sum(begun),
            len(people) / n, near, capitals / chars, len(_CAPS.findall(text)) / n,
            text.count("!") / n, marks / chars, len(hidden) / n, len(masked), len(_REPEATS.findall(text)) / n,
        )
    return out


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None
    calibration: Isotonic | None
    rate: float  # share of toxic rows, the score of all where nothing could be fitted

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        margin = self.trees.margin(features(texts, self.lexicon))
        # A little of the margin itself keeps the order inside the steps of the calibration.
        return np.clip(0.998 * self.calibration(margin) + 0.002 / (1 + np.exp(-margin)), 0.0, 1.0)


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Tokens that toxic texts hold more often than others, with log odds, from (text, label)."""
    counts = train.mapInArrow(frugal(token_counts), "token string, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    sums = train.groupBy("label").count().collect()
    toxic, other = (sum(r["count"] for r in sums if bool(r["label"]) is side) for side in (True, False))
    if not toxic or not other:
        return {}
    share = toxic / (toxic + other)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    ratio = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    found = counts.where((a > 2) & (a * other > b * toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (other + 1))
    top = found.select("token", odds.alias("odds"), "ratio").where("odds > 1").orderBy(F.desc("ratio"), "token").limit(MAX_LEXICON)
    return {r["token"]: float(r["odds"]) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """A model from the labelled rows of docs. Null labels are left out; of several labels of an id the largest counts."""
    marked = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = marked.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(max_rows)
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).join(F.broadcast(sample), "id")  # at most max_rows rows
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int")
    train = materialise(texts.select("id", "text", "label", fold.alias("fold")), "toxic-train")
    # A row's features come from a lexicon that has not seen its fold, so neither trees nor calibration are fitted on words that know the answer.
    lexicons = [learn_lexicon(train.where(F.col("fold") != f).select("text", "label")) for f in range(FOLDS)]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.stack([features([t], lexicons[f])[0] for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("fold"), flat], names=["id", "label", "fold", "x"])

    rows = train.mapInArrow(frugal(featured), "id long, label int, fold int, x array<double>").toPandas().sort_values("id", kind="stable")
    y, of = rows["label"].to_numpy(np.float64), rows["fold"].to_numpy(np.int64)
    lexicon = learn_lexicon(train.select("text", "label"))
    if len(y) < 10 or y.min() == y.max():
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(rows["x"].tolist())
    trees = Boosted().fit(x, y)
    return Model(lexicon, trees, Isotonic().fit(out_of_fold_margins(x, y, of), y), float(y.mean()))


def out_of_fold_margins(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's margin by trees grown on the other folds; by trees grown on all rows where the others have one label only."""
    out = np.zeros(len(y))
    for f in np.unique(fold).tolist():
        mine, others = fold == f, fold != f
        if not others.any() or y[others].min() == y[others].max():
            others = np.ones(len(y), bool)
        out[mine] = Boosted().fit(x[others], y[others]).margin(x[mine])
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (double, 0 to 1) of each row; null text is empty, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return rows.mapInArrow(frugal(run), "doc_id long, score double")
