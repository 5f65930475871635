"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and their first PREFIXES letters, each hashed to 32 bits. The score is
sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>), so a pair of terms, such as an insult with the name of a group,
can count for more than either does alone. The pair sum takes linear time: half of |sum v|^2 - sum |v|^2.

Training rows are a bounded sample: of all labelled rows that `train` lets through, the MOST_EACH with the smallest
seeded hashes of each label. Spark picks them, joins only them with their texts and hashes these; the machine itself is
fitted with AdaGrad on those few rows. So chance words don't vote, a term is in the machine for one of two reasons:

* alone: LEAST_ROWS of the rows have it and its share of label 1 differs from the sample's by LEAST_Z standard errors;
* in a pair: a linear fit of the terms above leaves rows unexplained, and all pairs of words in these are counted, however
  frequent the words are. A pair that LEAST_ROWS + 2 unexplained rows of one label have is tested on all rows of the sample: the
  chance of so many rows of one label, where the linear fit's probabilities hold, is at most exp(-n * KL(seen, expected))
  (Chernoff), and a pair counts if that is below CHANCE_PAIRS / number of tested pairs. So at most CHANCE_PAIRS pairs are
  expected to come in by chance. No other bound holds on terms or pairs; a cell count of hashed pairs drops, before they are
  listed, those that can't reach the least number of rows. A pair that counts starts with factors in its direction.

What is broadcast is as large as the terms of the bounded sample that pass. Scoring is one pass over the texts without a
shuffle.

Defined cases: null and empty texts have no terms and score sigmoid(w0); rows whose label is null aren't trained on,
repeated labels count as often as they stand; without rows of both labels the score is the share of label 1 (one half
if there are none); extra columns aren't read, so they can't enter a score, and a column with the score's name is replaced; rows that repeat
score alike; an empty table gives an empty table; texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

FACTORS, MOST_EACH, LEAST_ROWS, LEAST_Z, EPOCHS, SEED = 4, 2500, 3, 3.0, 15, 7
#: Pairs that may come in by chance, the error from which a row counts as unexplained, and cells of the pair count.
CHANCE_PAIRS, UNEXPLAINED, CELLS = 1.0, 0.3, 1 << 22
PREFIXES = (4, 5, 6, 7)
_STRIP = ".,;:!?\"'()[]{}<>*&%$#|-_"


def word_terms(raw: str) -> list[int]:
    """Hashes of a word and of its first letters."""
    word = raw.strip(_STRIP).lower()
    if not word:
        return []
    crc = zlib.crc32  # words are even, beginnings are odd
    return [crc(word.encode("utf-8", "surrogatepass")) & ~1, *(crc(b"^" + word[:n].encode("utf-8", "surrogatepass")) | 1 for n in PREFIXES if len(word) >= n)]


def terms(text: str) -> np.ndarray:
    """Hashes of a text's distinct terms, ascending."""
    found: set[int] = set()
    for raw in set(text.split()):
        found.update(word_terms(raw))
    return np.sort(np.fromiter(found, np.uint32, len(found)))


def _pair_codes(own: np.ndarray, step: int = 1 << 22) -> Iterator[np.ndarray]:
    """All pairs of ascending numbers below 2^31 as (smaller << 31) + larger, in pieces of about `step`."""
    n, at = len(own), 0
    while at < n - 1:
        to = min(n - 1, at + max(1, step // n))
        i, j = np.nonzero(np.arange(n)[None, :] > np.arange(at, to)[:, None])
        yield (own[i + at] << 31) + own[j]
        at = to


def _all_pairs(rows: list[np.ndarray], step: int = 1 << 22) -> Iterator[np.ndarray]:
    """The pairs of all rows, about `step` at a time."""
    held, size = [], 0
    for r in rows:
        for codes in _pair_codes(r, step):
            held.append(codes)
            size += len(codes)
            if size >= step:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def common_pairs(rows: list[np.ndarray], least: int) -> np.ndarray:
    """Codes of the pairs of numbers that at least `least` of the rows have."""
    if len(rows) < least:
        return np.zeros(0, np.int64)
    every, count = np.unique(np.concatenate(rows), return_counts=True)
    often = every[count >= least]
    rows = [r[np.isin(r, often)] for r in rows]
    cells = np.zeros(CELLS, np.int64)

    def cell(codes: np.ndarray) -> np.ndarray:
        return codes % 4294967291 % CELLS  # a prime below 2^32

    for pairs in _all_pairs(rows):
        cells += np.bincount(cell(pairs), minlength=CELLS)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for pairs in _all_pairs(rows):
        new, n = np.unique(pairs[cells[cell(pairs)] >= least], return_counts=True)
        every = np.union1d(codes, new)
        sums = np.zeros(len(every), np.int64)
        sums[np.searchsorted(every, codes)] += counts
        sums[np.searchsorted(every, new)] += n
        codes, counts = every, sums
    return codes[counts >= least]


class FactorizationMachine:
    def __init__(self, seed: int = SEED):
        self.bias, self.seed = 0.0, seed
        self.terms = np.zeros(0, np.uint32)
        self.linear, self.factors = np.zeros(0), np.zeros((0, FACTORS))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def numbers(self, text: str) -> np.ndarray:
        """The machine's own numbers of a text's terms; a bounded cache keeps those of each word."""
        if not hasattr(self, "_index"):
            self._index, self._words = {int(t): i for i, t in enumerate(self.terms)}, {}
        if len(self._words) > 1_000_000:
            self._words.clear()
        found: set[int] = set()
        words, index = self._words, self._index
        for raw in set(text.split()):
            if (own := words.get(raw)) is None:
                own = tuple(index[t] for t in word_terms(raw) if t in index)
                if len(raw) <= 64:
                    words[raw] = own
            if own:
                found.update(own)
        return np.sort(np.fromiter(found, np.int64, len(found)))

    def raw(self, x: np.ndarray) -> float:
        v = self.factors[x]
        s = v.sum(0)
        return float(self.bias + self.linear[x].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))))

    def choose(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Terms that tell something of the label alone."""
        share = labels.mean()
        every, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        of_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        n = np.bincount(inverse, minlength=len(every))
        ones = np.bincount(inverse, weights=labels[of_row], minlength=len(every))
        z = (ones - n * share) / np.sqrt(n * share * (1 - share))
        self.terms = every[(n >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z)]

    def choose_pairs(self, rows: list[np.ndarray], labels: np.ndarray, chance: np.ndarray) -> list[tuple[int, int, float]]:
        """Pairs of words, with the side they take, that depart from the chances which the terms on their own give."""
        words = [(r[r % 2 == 0] >> 1).astype(np.int64) for r in rows]
        least = LEAST_ROWS + 2
        open_rows = np.abs(labels - chance) >= UNEXPLAINED
        tested = np.unique(np.concatenate([common_pairs([words[i] for i in np.flatnonzero(open_rows & (labels == y))], least) for y in (0, 1)]))
        if not len(tested):
            return []
        parts = np.unique(np.concatenate([tested >> 31, tested & ((1 << 31) - 1)]))
        n, ones, expected = np.zeros((3, len(tested)))
        for r, y, p in zip(words, labels, chance):
            for codes in _pair_codes(r[np.isin(r, parts)]):
                at = np.searchsorted(tested, codes)
                at = at[tested[np.minimum(at, len(tested) - 1)] == codes]
                n[at] += 1
                ones[at] += y
                expected[at] += p
        seen, mean = ones / n, np.clip(expected / n, 1e-9, 1 - 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(seen > 0, seen * np.log(seen / mean), 0) + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / (1 - mean)), 0)
        at = np.flatnonzero(n * distance >= np.log(len(tested) / CHANCE_PAIRS) + 1e-9)
        return [(int(c >> 31) << 1, (int(c) & ((1 << 31) - 1)) << 1, 1.0 if s > m else -1.0) for c, s, m in zip(tested[at], seen[at], mean[at])]

    def fit(self, rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 2e-3) -> None:
        y = np.array(labels, float)
        share = y.mean() if len(y) else 0.5
        if not 0 < share < 1:
            self.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9))) if len(y) else 0.0
            return
        self.choose(rows, y)
        own = self._start(rows, [])
        self._descend(own, y, epochs, rate, decay, paired=False)
        pairs = self.choose_pairs(rows, y, np.array([self.score(x) for x in own]))
        self.terms = np.union1d(self.terms, np.array([t for p in pairs for t in p[:2]], np.uint32))
        self._descend(self._start(rows, pairs), y, epochs, rate, decay)

    def _start(self, rows: list[np.ndarray], pairs: list[tuple[int, int, float]]) -> list[np.ndarray]:
        """Fresh weights, with factors of the pairs in their direction; the rows in the machine's own numbers."""
        rng, size = np.random.default_rng(self.seed), len(self.terms)
        self.bias, self.linear, self.factors = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
        for a, b, side in pairs:
            push = rng.normal(0, 0.2, FACTORS)
            self.factors[np.searchsorted(self.terms, a)] += push
            self.factors[np.searchsorted(self.terms, b)] += side * push
        return [np.searchsorted(self.terms, r[np.isin(r, self.terms)]) for r in rows]

    def _descend(self, rows: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, decay: float, paired: bool = True) -> None:
        """AdaGrad over the rows in seeded random order."""
        rng, size = np.random.default_rng(self.seed + 1), len(self.terms)
        g_linear, g_factors, g_bias = np.full(size, 1e-2), np.full((size, FACTORS), 1e-1), 1e-2
        if not paired:
            self.factors = np.zeros((size, FACTORS))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x = rows[i]
                v = self.factors[x]
                s = v.sum(0)
                raw = float(self.bias + self.linear[x].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]
                g_bias += error * error
                self.bias -= rate * error / np.sqrt(g_bias)
                if not len(x):
                    continue
                g = error + decay * self.linear[x]
                g_linear[x] += g * g
                self.linear[x] -= rate * g / np.sqrt(g_linear[x])
                if paired:
                    g = error * (s - v) + decay * v
                    g_factors[x] += g * g
                    self.factors[x] -= 0.25 * rate * g / np.sqrt(g_factors[x])


def sample(labels: DataFrame, label: str, train: Column, most: int = MOST_EACH, id_column: str = "doc_id") -> DataFrame:
    """At most `most` rows of each label 0 and 1 that `train` lets through, by a seeded hash of the id."""
    rows = labels.filter(train & F.col(label).isin(0, 1)).select(F.col(id_column).alias("_fm_id"), F.col(label).cast("int").alias("_fm_label"))
    h = F.xxhash64(F.lit(SEED), "_fm_id")
    return rows.filter("_fm_label = 1").orderBy(h, "_fm_id").limit(most).union(rows.filter("_fm_label = 0").orderBy(h, "_fm_id").limit(most))


def train(docs: DataFrame, labels: DataFrame, where: Column, label: str = "toxic", id_column: str = "doc_id", text: str = "text", most: int = MOST_EACH) -> FactorizationMachine:
    """Fits the machine on the bounded sample; only the sampled rows' term numbers come to the driver."""
    chosen = F.broadcast(sample(labels, label, where, most, id_column))  # at most 2 * most rows
    rows = docs.select(F.col(id_column).alias("i"), F.col(text).alias("t")).join(chosen, F.col("i") == F.col("_fm_id")).select("i", "t", "_fm_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            numbers = [terms(t).tobytes() for t in texts_of(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("_fm_label"), pa.array(numbers, pa.binary())], ["i", "label", "terms"])

    found = rows.withColumn("i", F.col("i").cast("long")).mapInArrow(run, "i long, label int, terms binary").collect()
    found.sort(key=lambda r: (r["i"], r["label"], bytes(r["terms"])))  # the same order in every run
    machine = FactorizationMachine()
    machine.fit([np.frombuffer(r["terms"], np.uint32) for r in found], [r["label"] for r in found])
    return machine


def score(docs: DataFrame, machine: FactorizationMachine, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score to every row; the text is the only input."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*[f"`{c}`" for c in keep]).withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in slices(batches, text):
            scores = [fm.score(fm.numbers(t)) for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, name])

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)
