"""Toxic passages by maximum-scoring segment search.

Training counts, in toxic and clean labelled documents, in how many a word or a word-initial or word-final part occurs. A feature's
evidence is the log-odds ratio of its rates in the two classes under an informative Dirichlet prior (each feature's
prior is its share of the joint counts, PRIOR tokens in all), less Z standard deviations. A word scores as its strongest
feature; words without evidence of LEAST or more score NEUTRAL, below zero.

Scoring reads a text once and finds all maximal-scoring segments in linear time (each such segment outscores all that
contain it or that it contains). The k-th occurrence of a scoring word in a text counts 1 / k of its log-odds, since
repeats of one word aren't independent evidence. By extreme-value theory the best segment of n clean words follows a Gumbel law, so a
segment of score S has E = K n exp(-lambda S) equals by chance; lambda and K are fitted on the clean training documents.
A segment is significant if E < 1. The best segment's -ln E and the sum over the significant ones are put on a scale of
0 to 1 by a logistic fit on the training documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import SLICE, map_rows, schema_of, text_rows
from tidemark.session import ship

#: Labelled documents that the model is fitted on, at most; chosen by a hash of the id, half of each class if there are enough.
SAMPLE = 20_000
PRIOR, Z, LEAST, NEUTRAL = 20_000.0, 2.0, 1.0, -0.1
#: Lengths of the word parts that are features beside the word.
PARTS = range(3, 7)

#: What isn't a letter, at either end of a word.
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
MEMO = 300_000


def normal(word: str) -> str:
    """Lower case, without what isn't a letter at either end."""
    return EDGES.sub("", word.lower())


def features(word: str) -> list[str]:
    """The word, and its initial and final parts, marked as such."""
    n = len(word)
    return ["=" + word] + ["^" + word[:k] for k in PARTS if k < n] + ["$" + word[-k:] for k in PARTS if k < n] if word else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end exclusive, score), in order; linear in the number of words.

    Runs of words that don't score above zero are one step. Each new run of positive words is joined to earlier
    segments as long as that makes a larger sum than either side has. The one to join is the last whose sum before is
    less; chain has those that can still be it, with rising sums before, so each is passed over once.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    cut = np.flatnonzero(np.diff(up) > 1) + 1
    starts, ends = up[np.r_[0, cut]], up[np.r_[cut - 1, len(up) - 1]] + 1
    sums = np.r_[0.0, np.cumsum(scores, dtype=float)]
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    chain: list[int] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        left, right = sums[a], sums[b]
        while True:
            while chain and found[chain[-1]][2] >= left:
                chain.pop()
            if not chain or found[chain[-1]][3] >= right:
                chain.append(len(found))
                found.append((a, b, left, right))
                break
            j = chain.pop()
            a, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass
class Model:
    """What training leaves; its weights are of words of the bounded sample."""

    weights: dict[str, float]
    rate: float = 1.0
    place: float = 0.0
    logistic: tuple[float, float, float] = (-2.0, 0.5, 0.0)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, raw: str) -> float:
        found = self.memo.get(raw)
        if found is None:
            found = max([self.weights[f] for f in features(normal(raw)) if f in self.weights], default=NEUTRAL)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[raw] = found
        return found

    def found(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words; (start word, end word, -ln E) of the maximal segments."""
        words = text.split()
        get, new = self.memo.get, self.word
        scores = np.array([s if (s := get(w)) is not None else new(w) for w in words], float)
        seen: dict[str, int] = {}
        for i in np.flatnonzero(scores > 0).tolist():  # the k-th occurrence of a word counts 1 / k
            seen[words[i]] = k = seen.get(words[i], 0) + 1
            scores[i] /= k
        shift = self.place + math.log(max(1, len(words)))
        return len(words), [(a, b, self.rate * s - shift) for a, b, s in segments(scores)]

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """The significant ones among them."""
        return [p for p in self.found(text)[1] if p[2] > 0]

    def score(self, passages: list[tuple[int, int, float]]) -> float:
        """0 to 1, of a text's passages."""
        a, b, c = self.logistic
        x, y = inputs(passages)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y))))


def inputs(passages: list[tuple[int, int, float]]) -> tuple[float, float]:
    """-ln E of the best passage (0 if there is none), and the logarithm of the sum over all."""
    likely = [e for *_, e in passages]
    return max(likely, default=0.0), math.log1p(sum(likely))


def gumbel(bins: dict[float, int], words: int) -> tuple[float, float]:
    """(lambda, ln K): segments of clean text with a score of S or more come at a rate of K exp(-lambda S) a word.

    bins: how many segments of the clean documents, of so many words, have each score. The exponent follows from the
    median above the lowest score, which single odd documents don't move (it is 1, its value for log-likelihood ratios,
    if there are few segments), and K from their number.
    """
    total, below = sum(bins.values()), 0
    low = middle = min(bins, default=LEAST)
    for at in sorted(bins):
        middle, below = at, below + bins[at]
        if 2 * below >= total:
            break
    rate = min(2.0, max(0.25, math.log(2) / (middle - low))) if total >= 30 and middle > low else 1.0
    return rate, math.log(max(1, total) / max(1, words)) + rate * low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weights: np.ndarray | float = 1.0) -> tuple[float, float, float]:
    """Intercept and two slopes, by Newton's method with a ridge on the slopes. weights: how many documents each row stands for."""
    design, w, many = np.c_[np.ones(len(x)), x], np.zeros(3), np.broadcast_to(weights, len(x))
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (many * p * (1 - p))[:, None]) + penalty, design.T @ (many * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the documents of labels (rows with a null id or label are left out; of several labels of an id the highest counts).

    At most SAMPLE labelled documents are used; in the logistic fit each stands for as many of its class as the sample
    leaves out, so the scores have the class mix of all labels. Without both classes nothing scores as toxic.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    sample = marked.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(SAMPLE // 2).unionByName(marked.where("toxic = 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE // 2))
    stands_for = {r.toxic: max(1.0, r.n / (SAMPLE // 2)) for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    rows = text_rows(docs, id_col, text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("toxic", "text")

    def count(c: dict[str, list]) -> dict[str, list]:
        found: dict[tuple[str, int], int] = {}
        for text, toxic in zip(c["text"], c["toxic"]):
            for w in set(map(normal, text.split())):  # once a document: a word that one document repeats is no evidence
                found[w, toxic] = found.get((w, toxic), 0) + 1
        return {"word": [w for w, _ in found], "toxic": [t for _, t in found], "n": list(found.values())}

    words = map_rows(rows, count, schema_of(rows, [], "word string, toxic int, n long")).where("word <> ''")
    both = words.groupBy("word").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("n1"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("n0"))
    parts = [F.concat(F.lit("="), "word")]
    parts += [F.when(F.length("word") > k, F.concat(F.lit("^"), F.left("word", F.lit(k)))) for k in PARTS]
    parts += [F.when(F.length("word") > k, F.concat(F.lit("$"), F.right("word", F.lit(k)))) for k in PARTS]
    every = both.select(F.explode(F.array(*parts)).alias("f"), "n1", "n0").where("f is not null").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # Counts of a bounded sample, and of them the features that are commoner among toxic documents.
    totals = every.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    n1, n0 = float(totals.n1 or 0), float(totals.n0 or 0)
    if not n1 or not n0:
        return Model({}, logistic=(-2.0, 0.0, 0.0))
    a = F.lit(PRIOR / (n1 + n0)) * (F.col("n1") + F.col("n0"))
    ratio = F.log((F.col("n1") + a) / (F.lit(n1 + PRIOR) - F.col("n1") - a)) - F.log((F.col("n0") + a) / (F.lit(n0 + PRIOR) - F.col("n0") - a))
    ratio = ratio - F.lit(Z) * F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a))
    strong = every.where("n1 > 0").select("f", ratio.alias("w")).where(F.col("w") >= LEAST)
    model = Model({r.f: r.w for r in strong.collect()})

    def first(c: dict[str, list]) -> dict[str, list]:
        found: dict[float, int] = {-1.0: 0}
        for text, toxic in zip(c["text"], c["toxic"]):
            if not toxic:
                n, here = model.found(text)
                found[-1.0] += n
                for *_, e in here:  # the model as it stands: e is the score less the logarithm of n
                    at = round(e + math.log(max(1, n)), 1)
                    found[at] = found.get(at, 0) + 1
        return {"at": list(found), "n": list(found.values())}

    seen = map_rows(rows, first, schema_of(rows, [], "at double, n long")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row for each tenth
    bins = {r.at: r.n for r in seen}
    clean_words = bins.pop(-1.0, 0)
    model.rate, model.place = gumbel(bins, clean_words)

    def second(c: dict[str, list]) -> dict[str, list]:
        found = [inputs(model.passages(t)) for t in c["text"]]
        return {"toxic": c["toxic"], "x": [x for x, _ in found], "y": [y for _, y in found]}

    fit = map_rows(rows, second, schema_of(rows, ["toxic"], "x double, y double")).toPandas().sort_values(["toxic", "x", "y"])
    model.logistic = logistic(fit[["x", "y"]].to_numpy(), fit.toxic.to_numpy(), weights=fit.toxic.map(stands_for).to_numpy(float))
    model.memo = {}
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5, else 0), passages (start, end in words, -ln E; significant ones).

    A null or empty text scores as one without any evidence. Repeated rows are scored each.
    """
    rows = text_rows(docs, id_col, text_col)

    def run(c: dict[str, list]) -> dict[str, list]:
        found = [model.passages(t) for t in c["text"]]
        scores = [model.score(p) for p in found]
        passages = [[{"start": a, "end": b, "evidence": e} for a, b, e in p] for p in found]
        return {"doc_id": c["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores], "passages": passages}

    return map_rows(rows, run, schema_of(rows, ["doc_id"], "score double, predicted int, passages array<struct<start:int,end:int,evidence:double>>"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that model doesn't predict to be toxic. A null text stays."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array([model.score(model.passages(t or "")) < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
