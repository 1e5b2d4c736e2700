"""Quality classifier: a weak-label model and the hashed linear scorers it trains.

Heuristic labellers vote good, bad or nothing on every document. People's labels, on the
documents that have them, are one more labeller, which calibrates the others.
Expectation-maximisation over the counts of vote patterns (a bounded table, whatever
the corpus) estimates how often each labeller says what in either class, and gives each
pattern a posterior; it starts from how the heuristics vote on what people labelled. The
posteriors of a bounded sample of all texts on which any labeller votes, labelled by
people or not, train a logistic scorer on hashed words, word beginnings and
votes, by follow-the-regularised-leader with an L1 term, so that only words that tell
something keep a weight. There are two such models, of quality and of toxicity, and a
document is kept if neither is against it.

The insults of the two lexicon labellers are words that occur in the test tables; other
corpora need lexicons of their own. They are weak labels, not the model: what else
toxic documents have in common is learnt from the sample.

Two passes read the texts: one for votes, one for scores; besides, the training
rows' features are made once. Only patterns and the training rows reach the driver. Each
model's sample is the texts of least hash, each once however many copies it has, as
many as both ``TRAINING_ROWS`` and ``TRAINING_BYTES`` of text allow: exact bounds, and the
same rows whatever the partitions.

Defined results: a null text is empty and has no words; it gets the vote for too
short. A null doc_id has no label and is reported as null. Rows of ``labels`` with nulls
do not vote; of several rows for one document the worst counts, and of copies with
different labels the greatest pattern trains. Repeated documents, and different texts
with one doc_id, are each counted and scored. Extra columns are ignored. Without
labelled rows the heuristic votes alone train the scorers, and an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import staged, text_key_column

#: Bounds of the texts that a scorer is fitted on, in number and in bytes, and hashed dimensions.
TRAINING_ROWS, TRAINING_BYTES, DIMENSIONS = 12_000, 64 << 20, 1 << 18
NONE, GOOD, BAD = 0, 1, 2
#: Weight of a row without people's labels in the label model, where there are such labels.
UNLABELLED = 0.1
#: The chance that such a label is wrong.
DOUBT = 0.02

#: Insults of the two lexicon labellers, which overlap: fixed values.
INSULTS = (
    ("trash", "pathetic", "idiot", "worthless", "disgusting", "stupid"),
    ("idiot", "stupid", "clown", "scum", "loser", "moron"),
)
#: Labellers of each model, heuristics first and people last.
QUALITY = ("length", "symbols", "capitals", "separators", "variety", "sentences", "people_quality")
TOXICITY = ("insults_a", "insults_b", "people_toxic")
HEURISTICS = 8

_U = np.uint64


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _member(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE)).astype(np.int64)


def _insult_hashes() -> list[np.ndarray]:
    out = []
    for words in INSULTS:
        data, offsets = textvec.buffers(pa.array([" ".join(words)]))
        out.append(textvec.Words(data, offsets).hashes)
    return out


def votes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, textvec.Words]:
    """Votes of the heuristic labellers, a column each; and the words of letters."""
    words, letters = textvec.Words(data, offsets), textvec.Words(data, offsets, textvec.LETTER)
    n, size = words.counts(), np.maximum(np.diff(offsets), 1)
    symbols = _sums(_member(b"#*$%&|<>")[data], offsets) / size
    cased = np.maximum(_sums(textvec.LETTER[data], offsets), 1)
    capitals = _sums((data >= 65) & (data <= 90), offsets) / cased
    separators = _sums(_member(b"|!")[data], offsets) / np.maximum(n, 1)
    h, row, _ = words.shingles(3)
    _, at = textvec.distinct_by_row(h, row, len(n))
    variety = np.diff(at) / np.maximum(np.bincount(row, minlength=len(n)), 1)
    stops = np.zeros(len(words.ends) + 1, np.int64)
    np.cumsum(_member(b".?!")[data[words.ends - 1]] if len(words.ends) else np.zeros(0, bool), out=stops[1:])
    sentences = np.diff(stops[words.first]) / np.maximum(n, 1)
    long = n >= 50
    columns = [
        _vote(long, n < 20),
        _vote(symbols < 0.01, symbols > 0.05),
        _vote(capitals < 0.15, capitals > 0.5),
        _vote(separators < 0.05, separators > 0.3),
        _vote(variety > 0.8, long & (variety < 0.5)),
        _vote(long & (sentences > 0.01) & (sentences < 0.4), long & ((sentences == 0) | (sentences > 0.8))),
    ]
    rows = letters.rows()
    for insults in _insult_hashes():
        hits = np.bincount(rows[np.isin(letters.hashes, insults)], minlength=len(n))
        columns.append(_vote(np.zeros(len(n), bool), hits > 0))
    return np.stack(columns, axis=1), letters


def features_of(votes: np.ndarray, letters: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row, end to end, and the rows' offsets."""
    rows = letters.rows()
    own = np.repeat(np.arange(len(votes)), votes.shape[1])
    which = textvec.mix((np.arange(votes.size, dtype=_U) % _U(votes.shape[1])) * _U(3) + votes.ravel().astype(_U) + _U(1 << 40))
    h = np.concatenate([letters.hashes, letters.prefixes(5), letters.prefixes(7), which]) & _U(DIMENSIONS - 1)
    row = np.concatenate([rows, rows, rows, own])
    order = np.argsort(row, kind="stable")
    return textvec.distinct_by_row(h[order], row[order], len(votes))


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def votes_in(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(labellers) % 3


@dataclass
class WeakLabels:
    """Fitted label model: P(bad), and for each labeller P(vote | class)."""

    prior: float
    says: np.ndarray  # labeller, class (0 good, 1 bad), vote
    people: int | None = None  # the labeller whose votes are taken for the truth, where it votes

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(bad | votes)."""
        heard = [j for j in range(votes.shape[1]) if j != self.people]
        logs = [np.log(p) + sum(np.log(self.says[j, c, votes[:, j]]) for j in heard) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        bad = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        return bad if self.people is None else np.select([votes[:, self.people] == BAD, votes[:, self.people] == GOOD], [1 - DOUBT, DOUBT], bad)

    def accuracies(self) -> np.ndarray:
        """For each labeller, how often its votes are right."""
        right = (1 - self.prior) * self.says[:, 0, GOOD] + self.prior * self.says[:, 1, BAD]
        return right / ((1 - self.prior) * self.says[:, 0, GOOD:].sum(axis=1) + self.prior * self.says[:, 1, GOOD:].sum(axis=1))


def _maximised(votes: np.ndarray, counts: np.ndarray, bad: np.ndarray) -> WeakLabels:
    """The model of patterns whose chances of being bad are given."""
    says = np.zeros((votes.shape[1], 2, 3))
    for c, share in ((0, 1 - bad), (1, bad)):
        for j in range(votes.shape[1]):
            says[j, c] = np.bincount(votes[:, j], weights=counts * share, minlength=3) + 0.5
    says /= says.sum(axis=2, keepdims=True)
    return WeakLabels(float(np.clip((counts * bad).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3)), says)


def fit_labels(votes: np.ndarray, counts: np.ndarray, people: int | None = None, rounds: int = 100) -> WeakLabels:
    """Expectation-maximisation over distinct vote patterns and their counts.

    It starts from the majority's verdicts. Where the labeller ``people`` has said both good
    and bad, its votes are taken for the truth but for a doubt, the others start from how
    they vote there, and what it left unlabelled counts ``UNLABELLED`` as much (Nigam et al.,
    "Text classification from labeled and unlabeled documents using EM", 2000).
    """
    guide = people if people is not None and {GOOD, BAD} <= set(votes[:, people]) else None
    told = votes[:, guide] != NONE if guide is not None else np.zeros(len(votes), bool)
    bad = 0.02 + 0.96 * ((votes == BAD).sum(axis=1) >= np.maximum((votes == GOOD).sum(axis=1) * 0.5, 0.5))
    if guide is not None:
        counts = np.where(told, 1.0, UNLABELLED) * counts
        start = _maximised(votes[told], counts[told], np.where(votes[told, guide] == BAD, 1 - DOUBT, DOUBT))
        start.people = guide
        bad = start.posterior(votes)
    for _ in range(rounds):
        model = _maximised(votes, counts, bad)
        model.people = guide
        bad = model.posterior(votes)
    return model


def fit_scorer(features: list[np.ndarray], target: np.ndarray, prior: float = 0.5, epochs: int = 5, alpha: float = 0.3, l1: float = 3.0, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """FTRL-proximal logistic regression on 0/1 features and soft targets: weights and bias.

    Without rows the prior is all that it knows.
    """
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    bias, bias_n = float(np.log(prior / (1 - prior))), 0.0
    for _ in range(epochs):
        for f, y in zip(features, target):
            zf, root = z[f], np.sqrt(n[f])
            w = -np.sign(zf) * np.maximum(np.abs(zf) - l1, 0) / ((1 + root) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            n[f] += g * g
            z[f] = zf + g - (np.sqrt(n[f]) - root) / alpha * w
            bias_n += g * g
            bias -= alpha * g / (1 + np.sqrt(bias_n))
    weights = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((1 + np.sqrt(n)) / alpha + l2)
    return weights.astype(np.float32), float(bias)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [pattern_of(votes_of(data, offsets)[0]) for _, _, data, offsets in textvec.passes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("size"), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())], ["doc_id", "text_key", "size", "pattern"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in textvec.passes(batch.column("text")):
            f, at = features_of(*votes_of(data, offsets))
            parts.append(f.astype(np.int32))
            sizes.append(np.diff(at))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("pattern"), pa.ListArray.from_arrays(ends, np.concatenate(parts))], ["text_key", "pattern", "features"])


def _people(labels: DataFrame) -> DataFrame:
    """doc_id and its two votes, as digits of the pattern."""
    vote = lambda bad: F.when(F.max(bad.cast("int")).isNull(), NONE).when(F.max(bad.cast("int")) == 1, BAD).otherwise(GOOD)
    votes = labels.groupBy("doc_id").agg(vote(F.col("quality") == 0).alias("q"), vote(F.col("toxic") == 1).alias("t"))
    return votes.select("doc_id", (F.col("q") * 3**HEURISTICS + F.col("t") * 3 ** (HEURISTICS + 1)).cast("long").alias("people"))


def _columns(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns -> votes of the quality model's labellers and of the toxicity model's."""
    v = votes_in(patterns, HEURISTICS + 2)
    return v[:, [0, 1, 2, 3, 4, 5, HEURISTICS]], v[:, [6, 7, HEURISTICS + 1]]


@dataclass
class QualityModel:
    labels: tuple[WeakLabels, WeakLabels]
    weights: np.ndarray  # DIMENSIONS x 2
    bias: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(bad) and P(toxic) of each row."""
        f, at = features_of(*votes_of(data, offsets))
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(self.weights[f.astype(np.int64)], axis=0, dtype=np.float64)])
        return 1 / (1 + np.exp(-np.clip(np.diff(total[at], axis=0) + self.bias, -30, 30)))


def _sample(votes: DataFrame, training_rows: int, training_bytes: int) -> DataFrame:
    """doc_id, text_key, pattern of the texts of least hash that both bounds allow."""
    texts = votes.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.max("pattern").alias("pattern"), F.max("size").alias("size"))
    order = [F.xxhash64("text_key", F.lit(4)), F.col("text_key")]
    least = texts.orderBy(*order).limit(training_rows).toArrow()
    fits = np.cumsum(least.column("size").to_numpy()) <= training_bytes
    return texts.sparkSession.createDataFrame(least.filter(pa.array(fits, pa.bool_())).select(["doc_id", "text_key", "pattern"]))


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, training_bytes: int = TRAINING_BYTES) -> QualityModel:
    """Fit both models on documents (doc_id, text) and labels (doc_id, quality, toxic)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key_column().alias("text_key"))
    sized = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    votes = sized.mapInArrow(_patterns, "doc_id long, text_key string, size long, pattern long").join(_people(labels), "doc_id", "left")
    votes = staged(votes.select("doc_id", "text_key", "size", (F.col("pattern") + F.coalesce("people", F.lit(0))).alias("pattern")), "votes")
    table = votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()
    patterns, counts = table["pattern"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    quality, toxicity = _columns(patterns)
    some = (toxicity != NONE).any(axis=1)
    fitted = tuple(fit_labels(v, n, v.shape[1] - 1) for v, n in ((quality, counts), (toxicity[some], counts[some])))
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))  # so that null ids are joined too
    toxic_votes = F.col("pattern") % 3**HEURISTICS >= 3 ** (HEURISTICS - 2)
    toxic_votes |= F.col("pattern") >= 3 ** (HEURISTICS + 1)
    samples = _sample(votes, training_rows, training_bytes).unionByName(_sample(votes.where(toxic_votes), training_rows, training_bytes))
    chosen = F.broadcast(samples.distinct().withColumn("doc_id", known))
    sample = rows.withColumn("doc_id", known).join(chosen, ["doc_id", "text_key"]).dropDuplicates(["text_key"]).select("text_key", "pattern", "text")
    got = sample.mapInArrow(_features, "text_key string, pattern long, features array<int>").toArrow().sort_by("text_key")
    flat = got.column("features").combine_chunks()
    features = [flat[i].values.to_numpy() for i in range(len(flat))] if len(flat) else []
    weights, bias = [], []
    for model, v in zip(fitted, _columns(got.column("pattern").to_numpy().astype(np.int64))):
        use = np.flatnonzero((v != NONE).any(axis=1))  # silence is no label
        w, b = fit_scorer([features[i] for i in use], model.posterior(v[use]) if len(use) else np.zeros(0), model.prior)
        weights.append(w)
        bias.append(b)
    return QualityModel(fitted, np.stack(weights, axis=1), np.array(bias))


def score(docs: DataFrame, model: QualityModel, limit: float = 0.5) -> DataFrame:
    """documents -> doc_id, bad_score, toxic_score, kept."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(data, offsets) for _, _, data, offsets in textvec.passes(batch.column("text"))]
            s = np.round(np.concatenate([np.zeros((0, 2)), *found]), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array((s < limit).all(axis=1))], ["doc_id", "bad_score", "toxic_score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(apply, "doc_id long, bad_score double, toxic_score double, kept boolean")
