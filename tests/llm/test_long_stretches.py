"""Long stretches of the random field: equal to the whole lattice, bounded memory, false alarms."""

import random
import tracemalloc

import numpy as np
import pytest

from civiltext.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.fit_field(pii.made_up(["alpha", "beta", "gamma", "the", "of"]))


def whole(text, field):
    x = pii.lattice(text)
    return [(x.spans[i][0], x.spans[j - 1][1], k) for i, j, k in field.best(x)]


@pytest.mark.parametrize("block", [1, 3, 13, 50, 2000])
def test_blocks_equal_the_whole_lattice(field, block):
    rng = random.Random(block)
    pieces = ["alpha", "12", "(555) 123-4567", "a@b.example.com", "4111 1111 1111 1111", "+49 30 1234567", "10.0.0.1", "token =", "deadbeefdeadbeefdeadbeefdeadbeef", "7", "-", ".", "@", "(", "x1"]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(40)] + ["", "5", "@", "a" * 50]
    found = 0
    for t in texts:
        got = pii.entities(t, field, block)
        assert got == whole(t, field)
        found += len(got)
    assert found > 50
    rng = np.random.default_rng(block)
    wild = pii.Field(rng.normal(size=field.weights.shape), rng.normal(size=field.joins.shape))
    for t in texts:
        assert pii.entities(t, wild, block) == whole(t, wild)


def test_a_long_run_of_numbers_is_held_in_little_memory(field):
    text = " ".join(map(str, range(20_000)))
    pii.entities(text[:1000], field)
    tracemalloc.start()
    pii.entities(text, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_added_spans_keep_apart_from_base_spans(field):
    text = "write to a.b@example.com or 10.1.2.3 or +49 30 1234567 or (555) 123-4567 now " * 400
    base, added = pii.all_spans(text, field)
    cover = np.zeros(len(text), bool)
    for _, a, b in base:
        cover[a:b] = True
    assert len(base) >= 1200 and added and not any(cover[a:b].any() for _, a, b in added)


def test_plain_numbers_raise_few_alarms(spark):
    rows = [(i, f"In {1900 + i % 100} the town had {i * 37} people, {i % 90} houses and {i % 7}.{i % 10} percent more trees than in {1800 + i % 99}. Call +49 30 {1000000 + i}.") for i in range(200)]
    field = pii.learn(spark.createDataFrame(rows, "doc_id int, text string"))
    alarms = sum(len(pii.all_spans(t, field)[1]) for _, t in rows)
    assert alarms <= 10  # of a thousand plain numbers
