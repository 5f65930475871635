"""Quality rules on repetition: how much of a text lies inside n-grams and lines that occur more than once.

Word numbers get one running polynomial over the whole text, sum of x_i * B^i modulo 2^64; the hash of any window of n words
is the difference of two places of it, brought to a common power, so it costs the same for every n. Windows whose hash
occurs twice or more mark their words, first occurrences included, and the marked words' characters over all word
characters are the coverage. A repeated window starts with a repeated shorter one, so longer lengths look only where the
length before found something. Repeated lines are measured in the same way. A text fails where a coverage is above its limit.

The base rule counts words in windows of five. Lengths below five find what no window of five does: words that each
stand several times in a row, or short runs that come back in another company. The limits lie above what labelled good
texts reach (0.25, 0.25 and 0.21 for two, three and four words, 0.10 for lines); those from five words on hold characters,
so they also fail texts whose long words repeat.

Everything happens inside one row, so nothing is shuffled and a text of any length is one numpy array.

Defined cases: a null or empty text has no words, all counts 0, fails the base rule (fewer than 10 words) and isn't
kept; extra columns stay untouched in `quality_rules` and columns with the names of the results are replaced; repeated
rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Window lengths, and the largest share of word characters inside repeated windows of each length.
NGRAMS = {2: 0.30, 3: 0.30, 4: 0.25, 5: 0.25, 7: 0.22, 10: 0.20}
LINE_LIMIT = 0.15
#: Fixed values of the base rule.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20

_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def repeated(numbers: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, marks the words that lie in a window of so many words which occurs at least twice."""
    size = len(numbers)
    # a fixed mixing of word numbers
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    powers, back = np.full(size + 1, _BASE), np.full(size + 1, _INVERSE)
    powers[0] = back[0] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    run = np.zeros(size + 1, np.uint64)
    np.cumsum(x * powers[:size], out=run[1:])
    at, found = np.arange(size), {}
    for n in sorted(lengths):
        at = at[at <= size - n]
        h = (run[at + n] - run[at]) * back[at]
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        edge = np.zeros(size + 1, np.int64)
        edge[at] += 1
        edge[at + n] -= 1
        found[n] = np.cumsum(edge[:-1]) > 0
    return found


def measure(text: str, ngrams: dict[int, float] = NGRAMS, line_limit: float = LINE_LIMIT) -> dict:
    """Counts and coverages of one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white-space characters only
    seen: dict[bytes, int] = {}
    numbers = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    sizes = np.array([len(w.decode("utf-8", "surrogatepass")) for w in seen], np.int64)[numbers] if words else numbers
    chars = int(sizes.sum())
    line_seen: set[str] = set()
    n_dup_lines = dup_chars = 0
    for line in text.split("\n"):
        size = len(line.strip(SPACES))
        if size:
            if line in line_seen:
                n_dup_lines += 1
                dup_chars += size
            line_seen.add(line)
    marks = repeated(numbers, [*{WINDOW, *ngrams}])
    covered = {n: float(sizes[marks[n]].sum()) / max(chars, 1) for n in ngrams}
    n_repeat = int(marks[WINDOW].sum())
    line_cover = dup_chars / max(len(text), 1)
    failed = len(words) < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "line_coverage": line_cover, "ngram_coverage": [covered[n] for n in ngrams],
        "kept": not failed and line_cover <= line_limit and all(covered[n] <= most for n, most in ngrams.items()),
    }


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, line_coverage double, ngram_coverage array<double>, kept boolean"


def quality_rules(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with the measures of their text; without the text if keep_text is false."""
    names = [part.split()[0] for part in RESULT.split(", ")]
    own = [c for c in df.columns if c not in names and (keep_text or c != text)]
    schema = df.select(*[f"`{c}`" for c in own]).schema
    result = df.sparkSession.createDataFrame([], RESULT).schema
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [measure(t) for t in texts_of(batch, text)]
            arrays = [batch.column(c) for c in own] + [pa.array([f[n] for f in found], kind) for n, kind in zip(names, types)]
            yield pa.RecordBatch.from_arrays(arrays, own + names)

    for field in result:
        schema = schema.add(field)
    return df.select(*[f"`{c}`" for c in dict.fromkeys([*own, text])]).mapInArrow(run, schema)
