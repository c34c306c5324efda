"""Toxicity by weak supervision.

1. Voters. On a sample of labelled rows (at most MAX_ROWS, in hash order of the identifier; it is the classifier's
   sample, and bounded so at every size) words, word beginnings of 4 to 8 letters and a few patterns of whole texts are
   counted by documents. All that come with the label far more often than without vote for it, all that come far more
   rarely vote against: lexicons and patterns of both polarities, as many as the sample bears out.
2. Label model. Every document that isn't held out, labelled or not, is reduced to the set of voters that fire in it;
   equal sets are counted together and written. On this table a generative model of the votes given a hidden class is
   fitted by expectation maximisation, a Spark job a round: how often each voter fires in either class, and so its
   accuracy. Then correlations of voters within the classes are estimated from how often two fire together, a voter's
   weight of evidence is divided by the sum of its positive correlations, so that a word, its beginnings and its company
   count about once, and the model is fitted again. Labels aren't used in this step but for the share of the class.
3. Classifier. A linear (logistic) model of the voters that fire and the numbers of their hits is trained on the
   posteriors of the sample, weighted so that both classes count alike.

All rows are then scored where they are read, whole texts. Labels, language, source and identifiers never enter a score.

Defined cases: null and empty texts have the score of no votes; without labelled rows, or with one class only, there are
no voters and all scores are the share of the class (0 if unknown); labels with a null identifier or value are left out,
repeated ones count once (the larger); documents that repeat an identifier are scored on their own, and each counts in
the label model; very long texts are one set of votes; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_lists, materialise

#: Labelled rows that voters are found in and the classifier learns from.
MAX_ROWS = 20_000
BEGINNINGS = (4, 5, 6, 7, 8)
#: A voter for the label occurs in as many labelled documents at least, and as many times as often with the label.
LEAST_DOCS, LEAST_LIFT = 4, 40.0
#: A voter against it would be expected with the label as often at least, and is as many times rarer.
LEAST_EXPECTED, LEAST_DROP = 12.0, 4.0
ROUNDS = 12
THRESHOLD = 0.7
CACHE = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(ident) -> F.Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _marks(chunk: bytes) -> set[str]:
    out = set()
    for w in _LETTERS.findall(chunk.decode("utf-8", "replace").lower()):
        if len(w) >= 3:
            out.add("=" + w)
        out.update(w[:k] for k in BEGINNINGS if len(w) > k)
    return out


_UPPER, _LOWER, _DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))


def patterns(data: bytes) -> set[str]:
    """Patterns of a whole text; their names start with #."""
    many = lambda what: len(data) - len(data.translate(None, what))
    upper, lower, digits = many(_UPPER), many(_LOWER), many(_DIGITS)
    found = {"#capitals": upper > lower and upper >= 10, "#bangs": data.count(b"!") >= 3, "#questions": data.count(b"?") >= 3, "#digits": 5 * digits > upper + lower, "#link": b"://" in data or b"www." in data, "#mail": b"@" in data, "#lines": data.count(b"\n") >= 5}
    return {k for k, v in found.items() if v}


class _Votes(dict):
    """From a blank-free chunk of a text to the voters that it fires; of bounded size."""

    def __init__(self, voters: list[str]):
        super().__init__()
        self.at = {v: i for i, v in enumerate(voters)}

    def __missing__(self, chunk: bytes) -> tuple:
        if len(self) >= CACHE:
            self.clear()
        got = self[chunk] = tuple(self.at[m] for m in _marks(chunk) if m in self.at) if self.at else ()
        return got


def votes(data: bytes, table: _Votes) -> Counter:
    found: Counter = Counter()
    for hit in map(table.__getitem__, data.lower().split()):
        if hit:
            found.update(hit)
    found.update(table.at[m] for m in patterns(data) if m in table.at)
    return found


def _mine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("mark", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    held: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return batches(schema, [list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]])

    for batch in it:
        for label, data in zip(batch.column(0).to_pylist(), byte_lists(batch, 1), strict=True):
            marks = patterns(data)
            for chunk in set(data.lower().split()):
                marks |= _marks(chunk)
            for m in marks:
                held.setdefault(m, [0, 0])[0 if label else 1] += 1
        if len(held) > 300_000:
            yield out()
            held.clear()
    if held:
        yield out()


class LabelModel:
    """The hidden class and the votes. Voters below ``n_for`` vote for the label, the others against it; a voter that
    doesn't fire abstains; that none votes for the label is a vote of its own against it (number m)."""

    def __init__(self, m: int, n_for: int, prior: float):
        self.m, self.n_for, self.prior = m, n_for, prior
        self.p1 = np.r_[np.full(n_for, 0.3), np.full(m - n_for, 0.03), 0.1]
        self.p0 = np.r_[np.full(n_for, 0.01), np.full(m - n_for, 0.1), 0.9]
        self.weight = np.ones(m + 1)

    def posterior(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """From the voters that fire, row after row, and where each row starts (with the end): the class's probability."""
        evidence = self.weight * np.log(self.p1 / self.p0)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        z = np.bincount(row, weights=evidence[flat], minlength=len(at) - 1)
        silent = np.bincount(row, weights=flat < self.n_for, minlength=len(at) - 1) == 0
        z += np.log(self.prior / (1 - self.prior)) + silent * evidence[self.m]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def sums(self, flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected numbers by class (2 rows): of each voter's votes, of silence, of documents."""
        post = self.posterior(flat, at)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        silent = np.bincount(row, weights=flat < self.n_for, minlength=len(at) - 1) == 0
        out = []
        for w in (n * post, n * (1 - post)):
            out.append(np.r_[np.bincount(flat, weights=w[row], minlength=self.m), w[silent].sum(), w.sum()])
        return np.array(out)

    def together(self, flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i * m + j, i < j) of voters that fire together, and their expected numbers by class."""
        post = self.posterior(flat, at)
        size = np.diff(at)
        row = np.repeat(np.arange(len(size)), size)
        later = at[row + 1] - np.arange(len(flat)) - 1  # voters behind each in its row
        first = np.repeat(np.arange(len(flat)), later)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
        key, back = np.unique(flat[first].astype(np.int64) * self.m + flat[second], return_inverse=True)
        w = n[row[first]]
        q = post[row[first]]
        return key, np.array([np.bincount(back, weights=x, minlength=len(key)) for x in (w * q, w * (1 - q))])

    def update(self, sums: np.ndarray) -> float:
        """New rates; a voter never speaks against its polarity. Returns the largest change."""
        p = (sums[:, :-1] + 0.01) / (sums[:, -1:] + 1)
        mid = np.sqrt(p[0] * p[1])
        wrong = np.where(np.arange(self.m + 1) < self.n_for, p[0] < p[1], p[0] > p[1])
        p = np.where(wrong, mid, p)
        change = max(np.abs(p[0] - self.p1).max(), np.abs(p[1] - self.p0).max())
        self.p1, self.p0 = p
        return float(change)

    def correlate(self, key: np.ndarray, both: np.ndarray, size: np.ndarray) -> None:
        """Weights from numbers of pairs by class (both) and of documents by class (size)."""
        i, j = key // self.m, key % self.m
        cov, var = 0.0, 0.0
        for p, b, s in zip((self.p1, self.p0), both, size, strict=True):
            cov = cov + b / size.sum() - s / size.sum() * p[i] * p[j]
            var = var + s / size.sum() * p * (1 - p)
        corr = cov / np.sqrt(var[i] * var[j] + 1e-18)
        near = corr > 0.3
        total = np.bincount(i[near], weights=corr[near], minlength=self.m) + np.bincount(j[near], weights=corr[near], minlength=self.m)
        self.weight = np.r_[1 / (1 + total / 2), 1.0]


def _ballot(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voters row after row, where rows start, and how often each set of voters occurs."""
    votes_ = batch.column(0)
    at = votes_.offsets.to_numpy().astype(np.int64)
    return votes_.flatten().to_numpy(), at - at[0], batch.column(1).to_numpy()


def fit_labels(ballots: DataFrame, model: LabelModel) -> LabelModel:
    """Fits the model to ballots (votes array<int>, n long), a job a round."""

    def expectation(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            s = model.sums(*_ballot(batch))
            total = s if total is None else total + s
        if total is not None:
            yield batches(pa.schema([("i", pa.int32()), ("s1", pa.float64()), ("s0", pa.float64())]), [np.arange(total.shape[1]), total[0], total[1]])

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            key, both = model.together(*_ballot(batch))
            yield batches(pa.schema([("k", pa.int64()), ("s1", pa.float64()), ("s0", pa.float64())]), [key, both[0], both[1]])

    def sums() -> np.ndarray:
        got = ballots.mapInArrow(expectation, "i int, s1 double, s0 double").groupBy("i").agg(F.sum("s1").alias("s1"), F.sum("s0").alias("s0")).collect()  # a row a voter
        out = np.zeros((2, model.m + 2))
        for r in got:
            out[:, r["i"]] = r["s1"], r["s0"]
        return out

    for step in range(2):
        for _ in range(ROUNDS):
            found = sums()
            if model.update(found) < 1e-4:
                break
        if step == 0:
            got = ballots.mapInArrow(pairs, "k long, s1 double, s0 double").groupBy("k").agg(F.sum("s1").alias("s1"), F.sum("s0").alias("s0")).toArrow()  # a row a pair of voters
            model.correlate(got["k"].to_numpy(), np.array([got["s1"].to_numpy(), got["s0"].to_numpy()]), found[:, -1])
    return model


def train_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method, some rows at a time; the last coefficient is the constant."""
    w = np.zeros(x.shape[1] + 1)
    pull = np.full(len(w), ridge * weight.sum() / 100)
    pull[-1] = 1e-9
    for _ in range(rounds):
        grad, hess = pull * w, np.diag(pull + 1e-9)
        for at in range(0, len(x), 2000):
            part = np.c_[x[at : at + 2000], np.ones(len(x[at : at + 2000]))].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            grad = grad + part.T @ (weight[at : at + 2000] * (p - y[at : at + 2000]))
            hess += (part * (weight[at : at + 2000] * p * (1 - p) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(found: Counter, m: int, n_for: int) -> list[float]:
    """The numbers of hits for and against, behind the voters that fire."""
    hits = sum(n for i, n in found.items() if i < n_for)
    return [float(np.log1p(hits)), float(np.log1p(sum(found.values()) - hits))]


def _linear_score(found: Counter, w: np.ndarray, m: int, n_for: int) -> float:
    z = w[-1] + sum(w[i] for i in found)
    for k, x in enumerate(_features(found, m, n_for)):
        z += w[m + k] * x
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """voters (those for the label first, n_for of them) and weights; from rows that aren't held out."""
    key = F.col(ident).cast("long")
    marked = labels.select(key.alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").where(~held_out(F.col("k")))
    sample = marked.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(MAX_ROWS)
    learn = docs.where(~held_out(key)).select(key.alias("k"), F.col(text).alias("t"))
    rows = learn.join(F.broadcast(sample), "k").select("y", "t")  # MAX_ROWS rows of two numbers
    size = sample.groupBy().agg(F.sum((F.col("y") > 0).cast("int")).alias("toxic"), F.count("*").alias("n")).first()
    n1, n = size["toxic"] or 0, size["n"]
    share = n1 / n if n else 0.0
    if not 0 < n1 < n:
        return {"voters": [], "n_for": 0, "w": np.array([0.0, 0.0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))])}
    counts = rows.mapInArrow(_mine, "mark string, toxic long, clean long").groupBy("mark").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    lift = (F.col("a") / n1) / ((F.col("b") + 0.5) / (n - n1))
    expected = F.col("b") * (n1 / (n - n1))
    for_it, against = (F.col("a") >= LEAST_DOCS) & (lift >= LEAST_LIFT), (expected >= LEAST_EXPECTED) & (F.col("a") * LEAST_DROP <= expected)
    found = counts.where(for_it | against).select("mark", for_it.alias("f")).collect()  # marks of MAX_ROWS rows at most
    voters = sorted(r["mark"] for r in found if r["f"])
    n_for = len(voters)
    voters += sorted(r["mark"] for r in found if not r["f"])
    m = len(voters)
    if not n_for:
        return {"voters": [], "n_for": 0, "w": np.array([0.0, 0.0, np.log(share / (1 - share))])}
    cast = pa.schema([("votes", pa.list_(pa.int32())), ("hits", pa.list_(pa.int64()))])

    def collect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Votes(voters)
        for batch in it:
            got = [sorted(votes(data, table).items()) for data in byte_lists(batch, 0)]
            yield batches(cast, [[[i for i, _ in x] for x in got], [[c for _, c in x] for x in got]])

    ddl = "votes array<int>, hits array<long>"
    ballots = learn.select("t").mapInArrow(collect, ddl).groupBy("votes").agg(F.count("*").alias("n"))
    model = fit_labels(materialise(ballots, "ballots"), LabelModel(m, n_for, share))
    got = rows.select("t").mapInArrow(collect, ddl).toArrow()  # MAX_ROWS rows of some numbers
    each = sorted(zip(got["votes"].to_pylist(), got["hits"].to_pylist(), strict=True))  # sums don't depend on the order of rows
    at = np.r_[0, np.cumsum([len(v) for v, _ in each])]
    flat = np.array([i for v, _ in each for i in v], np.int64)
    post = model.posterior(flat, at)
    x = np.zeros((len(each), m + 2), np.float32)
    x[np.repeat(np.arange(len(each)), np.diff(at)), flat] = 1
    x[:, m:] = [_features(Counter(dict(zip(v, h, strict=True))), m, n_for) for v, h in each]
    weight = np.where(post > 0.5, 0.5 / max(post.mean(), 1e-3), 1.0)
    return {"voters": voters, "n_for": n_for, "w": train_linear(x, post, weight), "posterior": post, "label_model": model}


def score(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, n_votes of every row of docs."""
    model = fit(docs, labels, ident, text, label)
    voters, w, m, n_for = model["voters"], model["w"], len(model["voters"]), model["n_for"]
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_votes", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Votes(voters)
        for batch in it:
            found = [votes(x, table) for x in byte_lists(batch, 1)]
            yield batches(out, [batch.column(0), [_linear_score(x, w, m, n_for) for x in found], [sum(x.values()) for x in found]])

    scored = docs.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, score double, n_votes long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_votes")
