"""Vectors, conversations, components, and the pipeline."""

import math
import random

import numpy as np
import pytest

from folioflow.llm import chat, common, neardup, queries


def vectors():
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in (0, 1, 2):
        centers = rng.normal(size=(12, 16))
        for c in centers:
            for _ in range(rng.integers(1, 12)):
                rows.append((k, (c + rng.normal(size=16) * 0.06).tolist(), label))
                k += 1
    rows += [(k + j, rows[0][1], 0) for j in range(5)]  # equal ones
    k += 5
    rows += [(k, [2 * x for x in rows[0][1]], 0), (k + 1, rows[0][1], None), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [math.nan] * 16, 0), (k + 5, [math.inf] + [0.0] * 15, 0), (k + 6, [None] * 16, 0), (k + 7, [], 0), (k + 8, rows[0][1][:8], 0), (None, rows[0][1], 0), (7, rows[7][1], rows[7][2])]
    return rows


def brute(rows, cosine):
    unit = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v) / np.linalg.norm(v), label
    link = {i: set() for i, _, _ in rows if i is not None}
    for i, (a, x) in unit.items():
        link[i] = {j for j, (b, y) in unit.items() if j != i and x == y and len(a) == len(b) and float(a @ b) >= cosine}
    out = {}
    for i in link:
        stack, seen = [i], {i}
        while stack:
            for j in link[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out[i] = (len(link[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("options", [{}, {"cell": 10, "most": 6, "block": 7}])
def test_near_vectors(spark, options):
    rows = vectors()
    df = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, embedding array<double>, label int, kept string").repartition(3)
    found = neardup.near_vectors(df, **options).collect()
    expected = brute(rows, 0.98)
    assert sum(v[0] for v in expected.values()) > 50
    assert {r.vec_id: (r.n_links, r.component_id, r["kept"]) for r in found if r.vec_id is not None} == expected
    assert [(r.n_links, r["kept"]) for r in found if r.vec_id is None] == [(0, True)]


def test_near_vectors_of_nothing(spark):
    assert neardup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_norms_of_any_size(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1e-310, 2e-310], 0), (4, [0.0, 0.0], 0), (5, [1e200, -2e200], 0)]
    out = {r.vec_id: r.n_links for r in neardup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0}


def turns():
    return [(1, 0, "system", "be brief"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé\nyou"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "x"), (3, 1, "user", ""), (None, 0, "user", "lost"), (None, 0, "user", "lost"), (None, 0, "system", "alone"), (5, 0, "a|><|assistant", "x<|end|>"), (5, 1, "b", "y"), (4, 0, "u", "y" * 100_000)]


def test_perspectives(spark):
    df = spark.createDataFrame([(*t, "z") for t in turns()], "conv_id long, turn long, role string, text string, mask string").repartition(3)
    rows = chat.rotate(df).collect()
    lone = [r for r in rows if r.conv_id is None]
    assert [(r.speaker, r.n_turns, r.text[slice(*map(int, r["mask"].split(":")))]) for r in lone] == [("user", 1, "lost")] * 2
    out = {(r.conv_id, r.speaker): r for r in rows if r.conv_id}
    assert set(out) == {(1, "ann"), (1, "bob"), (3, "unknown"), (3, "user"), (4, "u"), (5, "a|>< |assistant"), (5, "b")}
    assert out[5, "b"].text == "<|user name=a|>< |assistant|>\nx< |end|><|end|>\n<|assistant|>\ny<|end|>\n"
    r = out[1, "bob"]
    assert r.text == "<|system|>\nbe brief<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\nhé\nyou<|end|>\n" + "<|user name=ann|>\n<|end|>\n" * 2
    for (conv, speaker), r in out.items():
        learned = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")]
        own = [(t or "").replace("<|", "< |") for c, _, role, t in turns() if c == conv and (role or "unknown").replace("<|", "< |") == speaker]
        assert [r.text[a:b] for a, b in learned] == own and r.n_learned == len(own)
    assert chat.rotate(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sorted_files(spark):
    keys = random.Random(1).sample(range(-(10**12), 10**12), 5000)
    files = common.write_sorted(spark.createDataFrame([(k, k % 7 / 2) for k in keys], "k long, v double").selectExpr("k", "cast(v as float) v"), "test", ("v",))
    table = common.Sorted(files)
    probe = np.array(keys[:50] + [1, 2, 3], dtype=np.int64)
    assert table.contains(probe).tolist() == [True] * 50 + [k in set(keys) for k in (1, 2, 3)]
    assert table.values(probe[:50], "v")[0].tolist() == [k % 7 / 2 for k in keys[:50]]
    assert not common.Sorted([]).contains(probe).any()


def test_sql(spark, sf_dir, duck):
    from tests.conftest import same_rows

    made = queries.queries()
    for name, sql in queries.oracle_sql().items():
        same_rows(made[name](spark, sf_dir), duck.sql(sql))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
