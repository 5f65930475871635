"""The state machine over blocks against a plain loop: hot keys over many blocks, all entry states."""

import random

import numpy as np
import pytest

from tamarack.operators.utterances import Piece, _going_on, utterances


def loop(speaks, silence, most):
    found, start, quiet, frames = [], -1, 0, 0
    for n, speaking in enumerate(speaks, 1):
        if start < 0:
            if not speaking:
                continue
            start, quiet, frames = n, 0, 0
        quiet, frames = 0 if speaking else quiet + 1, frames + 1
        if quiet >= silence or frames >= most:
            found.append((start, n, frames))
            start = -1
    return found + ([(start, len(speaks), frames)] if start > 0 else [])


@pytest.mark.parametrize("silence,most", [(1, 1), (2, 8), (4, 25), (3, 4), (5, 2)])
def test_a_piece_from_every_entry_state(silence, most):
    rng = random.Random(silence * 100 + most)
    for _ in range(150):
        speaks = np.array([rng.random() < rng.choice([0.05, 0.3, 0.9]) for _ in range(rng.randrange(1, 40))])
        piece = Piece(speaks, silence, most)
        table = piece.function()
        for state in range(len(table)):
            frames, quiet = ((state - 1) // silence + 1, (state - 1) % silence) if state else (0, 0)
            if quiet >= frames and state:
                continue  # an utterance starts with a speaking frame
            found, now = [], [frames, quiet]
            for at, speaking in enumerate(speaks):
                if not now[0] and not speaking:
                    continue
                now = [now[0] + 1, 0 if speaking else now[1] + 1]
                if now[1] >= silence or now[0] >= most:
                    found.append((at, now[0]))
                    now = [0, 0]
            left = 1 + (now[0] - 1) * silence + now[1] if now[0] else 0
            assert piece.run(state) == (found, left) and table[state] == left


def test_going_on():
    # key a in blocks 0 to 2, b in 2 and 3, c in 3 alone, d in 5
    assert _going_on([(0, 1, 10), (1, 11, 5), (2, 16, 9), (3, 4, 7), (5, 1, 2)]) == {0: (0, 0, 1), 1: (0, 1, 2), 2: (2, 0, 3)}


@pytest.mark.parametrize("count", [1, 9, 40])
def test_utterances_equal_a_loop(spark, count):
    rng = random.Random(count)
    by_key = {k: [rng.random() < p for _ in range(n)] for k, n, p in [("hot", 900, 0.6), (None, 300, 0.9), ("a", 1, 1), ("b", 1, 0), *[(f"k{i}", rng.randrange(1, 60), rng.random()) for i in range(20)]]}
    by_key["all"] = [True] * 400
    rows = [(k, i, None if not s and i % 2 else 1.0 if s else 0.0) for k, ss in by_key.items() for i, s in enumerate(ss)]
    rng.shuffle(rows)
    got = utterances(spark.createDataFrame(rows, "k string, n int, level double"), "k", ["n"], "level", 0.5, 3, 20, count).collect()
    want = [(k, *u) for k, ss in by_key.items() for u in loop(ss, 3, 20)]
    assert sorted(map(repr, ((r["k"], r["start"], r["end"], r["frames"]) for r in got))) == sorted(map(repr, want))


def test_the_empty_table(spark):
    assert utterances(spark.createDataFrame([], "k string, n int, level double"), "k", ["n"], "level", 0.5).count() == 0
