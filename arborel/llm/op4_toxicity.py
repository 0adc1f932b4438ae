"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks.

The kernel of two words counts the triples of letters that both hold in order, with gaps, each weighted by DECAY to the power of the span it covers in
either word (spans up to SPAN), and normalised by length; inserted or separated letters weaken a match but don't destroy it. LANDMARKS words
that set toxic training documents apart from clean ones (besides some plain ones) span the Nystrom space, in which a linear machine is trained on
labelled bags of words: in each toxic document the highest-scoring word is its witness, clean documents give hard negatives (MI-SVM). As the
kernel is a sum over triples, the trained machine folds into one weight for each triple of landmark letters, so scoring a word takes a lookup for each
of its triples. A document's profile (the margins of its worst words, how many are above nought, how many words there are) becomes a score by
logistic scaling on the training documents, as words that are rare but clean turn up by chance in long texts.

At most SAMPLE labelled rows of each class, chosen by a hash of the id, are used for training; scoring covers every word of every text. Runs of
single letters are read as one word. Null, empty or white texts get the score of a margin of no word. Labels without a document and
documents without a label are no error; of labels that disagree about a document the toxic one counts; with labels of one class only, all scores are that class's smoothed rate. Rows that repeat are scored each, and very long texts
whole. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free, small_batches, table

DECAY, SPAN, LANDMARKS, PLAIN = 0.6, 8, 192, 96
#: Labelled rows of each class used for training, at most.
SAMPLE = 2000
ROUNDS, SEED, CUT, LIFT, LEAST_Z, WORST = 7, 11, 0.3, 5.0, 2.5, 5
#: Distinct words whose scores a worker remembers.
REMEMBERED = 250_000
STEPS = np.array([(0, j, k) for k in range(2, SPAN) for j in range(1, k)])
WEIGHTS = (DECAY ** (STEPS[:, 2] + 1)).astype(np.float32)


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, without marks at their ends; runs of three and more single letters make a word too."""
    found = (text or "").lower().split()
    words = set(found)
    if sum(len(w) == 1 for w in words) >= 3:
        for single, run in itertools.groupby(found, lambda w: len(w) == 1):
            if single and len(letters := "".join(run)) >= 3:
                words.add(letters)
    return words


def bare(word: str) -> str:
    """The word without marks at its ends, after a sign for its beginning."""
    return "^" + (word if word.isalpha() else word.strip("\"'.,;:!?()[]{}<>|%&$*#-_~/\\`+=") or word)


class Kernel:
    """Triples of the letters of the landmarks; letters besides are one more."""

    def __init__(self, landmarks: list[str]):
        self.letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(landmarks))))}
        self.base = len(self.letters) + 1
        self.column = None  # of each triple; 0 for those of no landmark
        known = np.unique(np.concatenate([self.triples([w])[0][0] for w in landmarks]))
        self.column = np.zeros(self.base**3, np.int32)
        self.column[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1

    def triples(self, words: list[str]):
        """For words of one length: codes (words x places x steps), and their weights, 0 beyond the word's end."""
        n = len(words[0])
        ids = np.array([[self.letters.get(c, 0) for c in w] for w in words], np.int64)
        at = np.arange(n)[:, None]
        inside = at + STEPS[None, :, 2] < n
        pad = np.pad(ids, ((0, 0), (0, SPAN)))
        codes = (pad[:, at + STEPS[None, :, 0]] * self.base + pad[:, at + STEPS[None, :, 1]]) * self.base + pad[:, at + STEPS[None, :, 2]]
        weights = np.where(inside, WEIGHTS[None, :], 0).astype(np.float32)
        codes = codes.reshape(len(words), -1)
        return codes if self.column is None else self.column[codes], weights.reshape(-1), float(np.sqrt((weights.astype(np.float64) ** 2).sum())) or 1.0

    def dense(self, words: list[str]) -> np.ndarray:
        """The normalised feature vectors of a few words."""
        out = np.zeros((len(words), self.width), np.float32)
        for i, w in enumerate(words):
            codes, weights, norm = self.triples([w])
            np.add.at(out[i], codes[0], weights / norm)
        out[:, 0] = 0
        return out

    def against(self, words: list[str], table_: np.ndarray) -> np.ndarray:
        """Each word's feature vector times each row of table_: words x rows."""
        out = np.zeros((len(words), len(table_)), np.float32)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, rows in by.items():
            step = max(1, 400_000 // (n * len(STEPS) * len(table_)))
            for a in range(0, len(rows), step):
                codes, weights, norm = self.triples([words[i] for i in rows[a : a + step]])
                for r, line in enumerate(table_):
                    out[rows[a : a + step], r] = line[codes] @ weights / norm
        return out


def telling(words: list[str], toxic: np.ndarray, clean: np.ndarray, t: float, c: float) -> np.ndarray:
    """Of each word the z value of the difference between its document rates, 0 unless it is LIFT times as common in toxic documents."""
    high, low = toxic / t, clean / c
    z = (high - low) / np.sqrt((high + low) / min(t, c) + 1e-9)
    return np.where((high >= LIFT * low) & (toxic > 0) & np.array([len(w) >= 4 for w in words], bool), z, 0.0)


def chosen_landmarks(words: list[str], z: np.ndarray, plain: np.ndarray, rng) -> list[int]:
    """The most telling words (of those that share their first five signs, six at most), and plain ones."""
    picked, heads = [], Counter()
    for i in sorted(np.flatnonzero(z >= LEAST_Z).tolist(), key=lambda i: (-z[i], words[i])):
        if len(picked) >= LANDMARKS - PLAIN:
            break
        if heads[words[i][:5]] < 6:
            heads[words[i][:5]] += 1
            picked.append(i)
    rest = sorted((int(i) for i in plain if len(words[i]) >= 3), key=lambda i: words[i])
    return picked + [int(i) for i in rng.permutation(rest)[:PLAIN]]


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 2e-4, steps: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps over the rows inside the margin; the last coefficient is the offset."""
    x = np.c_[x, np.ones(len(x))]
    sign = 2.0 * y - 1
    v = np.zeros(x.shape[1])
    ridge = strength * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        inside = sign * (x @ v) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + ridge, a.T @ sign[inside])
        done = np.abs(new - v).max() < 1e-6
        v = v + 0.7 * (new - v) if not done else new
        if done:
            break
    return v


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Coefficients, the last an offset, towards Platt's smoothed targets (Newton steps with a little shrinkage)."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[x, np.ones(len(x))]
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    v = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (p - t) + ridge @ v)
        v = v - move * min(1.0, 3.0 / (np.abs(move).max() + 1e-9))
    return v


class Model:
    def __init__(self, kernel, table_, offset, rate=None):
        self.kernel, self.table, self.offset, self.rate = kernel, table_, offset, rate
        self.known: dict[str, float] = {}
        self.mean = self.scale = self.slopes = None

    def words(self, words: list[str]) -> np.ndarray:
        return self.kernel.against(words, self.table[None])[:, 0] + self.offset

    def profiles(self, bags: list[set[str]]) -> np.ndarray:
        """For each bag: its WORST largest margins, and the logarithms of one plus the numbers of words above nought and of words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*bags).difference(self.known)) if bags else []
        self.known.update(zip(new, self.words([bare(w) for w in new]).tolist()))
        return np.array([self.profile(np.fromiter(map(self.known.__getitem__, bag), float, len(bag))) for bag in bags]).reshape(len(bags), WORST + 2)

    def profile(self, margins: np.ndarray) -> np.ndarray:
        row = np.full(WORST + 2, self.offset)
        top = -np.sort(np.partition(-margins, WORST)[:WORST]) if len(margins) > WORST else np.sort(margins)[::-1]
        row[: len(top)] = top
        row[WORST:] = np.log1p((margins > 0).sum()), np.log1p(len(margins))
        return row

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(texts), self.rate)
        x = (self.profiles([words_of(t) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.slopes[:-1] + self.slopes[-1], -30, 30)))


def trained(texts: list[str | None], labels: list[int], seed: int = SEED) -> Model:
    y = np.array(labels, float)
    constant = Model(None, None, 0.0, float((y.sum() + 1) / (len(y) + 2)))
    if not len(y) or y.min() == y.max():
        return constant
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    bags = [np.array([number.setdefault(bare(w), len(number)) for w in sorted(words_of(t))], np.int32) for t in texts]
    words, sets = list(number), [np.unique(b) for b in bags]
    count = lambda wanted: np.bincount(np.concatenate([*(s for s, t in zip(sets, y) if t == wanted), np.zeros(0, np.int32)]), minlength=len(words))
    toxic, clean = count(1), count(0)
    z = telling(words, toxic, clean, max(1.0, y.sum()), max(1.0, (1 - y).sum()))
    negatives = np.flatnonzero(clean)
    landmarks = chosen_landmarks(words, z, negatives[z[negatives] < LEAST_Z], rng)
    first = [i for i in landmarks if z[i] >= LEAST_Z]
    if not first:
        return constant
    place = np.full(len(words), LANDMARKS)
    place[first] = np.arange(len(first))
    # a toxic document without a telling word says nothing about words: labels may be wrong
    cases = [c for s, t in zip(sets, y) if t for c in [s[z[s] >= 0.6 * LEAST_Z]] if len(c)]
    witness = [int(c[place[c].argmin()]) for c in cases if place[c].min() < LANDMARKS]
    hard: list[int] = []
    best, least = constant, np.inf
    for _ in range(ROUNDS):
        kernel = Kernel([words[i] for i in landmarks])
        features = kernel.dense([words[i] for i in landmarks])
        values, vectors = np.linalg.eigh((features @ features.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-4))  # Nystrom: kernel values with the landmarks times this
        positive = sorted({*witness, *first})
        near = sorted(set(hard) - set(positive))
        some = sorted({int(i) for i in rng.permutation(negatives)[:2000]} - {*positive, *near})
        x = kernel.against([words[i] for i in positive + some + near], features).astype(np.float64) @ root
        label = np.r_[np.ones(len(positive)), np.zeros(len(some) + len(near))]
        often = np.sqrt(clean[some + near].astype(float))  # a clean word counts by how often it would mislead
        often[: len(some)] *= 0.5 / (often[: len(some)].sum() + 1e-9)
        often[len(some) :] *= 4.0 / (often[len(some) :].sum() + 1e-9)
        v = hinge(x, label, np.r_[np.full(len(positive), 1 / len(positive)), often])
        model = Model(kernel, ((root @ v[:-1]) @ features).astype(np.float32), float(v[-1]))
        margins = model.words(words)
        if len(negatives):
            order = negatives[np.argsort(-margins[negatives], kind="stable")]
            hard = list(dict.fromkeys(hard + order[:600].tolist()))
            # the landmarks that stand for clean words are those hardest to tell
            landmarks = first + [int(i) for i in order if place[i] == LANDMARKS and len(words[i]) >= 3][:PLAIN]
        # a word is a witness if it scores above what all but a fiftieth of clean documents reach
        worst = [margins[s].max() for s, t in zip(sets, y) if not t and len(s)]
        bar = max(0.0, float(np.quantile(worst, 0.98))) if worst else 0.0
        witness = [int(c[margins[c].argmax()]) for c in cases if margins[c].max() > bar] or witness
        # of the rounds the one whose scores fit the training documents best
        profiles = np.array([model.profile(margins[b]) for b in bags])
        model.mean, model.scale = profiles.mean(axis=0), profiles.std(axis=0) + 1e-6
        x = (profiles - model.mean) / model.scale
        model.slopes = logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ model.slopes[:-1] + model.slopes[-1], -30, 30)))
        loss = -np.mean(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-9, 1)))
        if loss < least:
            best, least = model, loss
    return best


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that aren't held out: of each class the `sample` rows with the smallest hash of the id. Training runs in one task, which gets
    2 * sample texts at most; the driver gets the machine only."""
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id").select("doc_id", "text", "toxic")  # 2 * sample ids at most

    def train(group: pa.Table) -> pa.Table:
        one = {r["doc_id"]: r for r in sorted(group.to_pylist(), key=lambda r: (r["doc_id"], r["text"] or ""))}
        model = trained([one[i]["text"] for i in sorted(one)], [one[i]["toxic"] for i in sorted(one)])
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(train, "model binary").collect()
    return pickle.loads(found[0].model) if found else trained([], [])


def scorer(model: Model, at: int, name: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            scores = np.concatenate([model.scores(texts[i : i + 128].to_pylist()) for i in range(0, len(texts), 128)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """docs with a column `name`, which must be free; all their columns stay."""
    small_batches(docs.sparkSession)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(scorer(model, docs.columns.index("text"), name), schema)


def without_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows that score below the cut, with all their columns, whatever their names."""
    (name,) = free(docs, "_score")
    return scored(docs, model, name).where(F.col(name) < cut).drop(name)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
