"""Families of near copies large enough that every list of the index is paired in blocks."""

import random

import pytest

from folioflow.llm import jaccard


def family():
    rng, rows = random.Random(9), []
    base = [f"w{rng.randrange(400)}" for _ in range(160)]
    for k in range(45):
        text = list(base)
        for _ in range(k % 4):
            text[rng.randrange(len(text))] = f"x{k}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join(base[: 150 + k])) for k in range(12)]
    return rows


def brute(rows):
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    link = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        stack, seen = [i], {i}
        while stack:
            for j in link[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out[i] = (len(link[i]), min(seen))
    return out


@pytest.mark.parametrize("frequent,wide,hot", [(1000, 24, 5), (3, 24, 7), (3, 1, 3), (3, 1, 3000)])
def test_lists_in_blocks(spark, monkeypatch, frequent, wide, hot):
    monkeypatch.setattr(jaccard.frequent_tokens, "__defaults__", (5, frequent))
    monkeypatch.setattr(jaccard.signatures, "__defaults__", (90, wide))
    monkeypatch.setattr(jaccard.pair_index, "__defaults__", (90, hot))
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute(rows)
    assert max(n for n, _ in expected.values()) > 25
    assert {r.doc_id: (r.n_similar, r.component_id) for r in jaccard.ngram_join(df).collect()} == expected
