"""What op6 looks up and hashes: each n-gram once, and the same results as the plain ways."""

import collections
import random

import numpy as np
import pyarrow as pa

from folioflow.llm import common, keyed, quality, words

TEXTS = ["", "Ab aB ab\x00 ab", " x\ty\n\nx\ty\n z", "é Éa " * 3, "w" * 64 + " " + "w" * 65 + " " + "W" * 65 + "\n" + "v" * 200 + " " + "v" * 200, "tail", "\n", "12345678 123456789 1234567812345678"]


def test_known_ngrams_are_not_looked_up_again(spark, monkeypatch):
    texts = ["abab abba baab", "ab ba ab", "abc cab 中文", "bb"]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, lang_id long")
    model = common.Sorted(quality.model_files(*quality.kneser_ney(common.written(quality.count_ngrams(df), "t"))))
    probe, off = quality.char_ngrams(*common.text_buffers(pa.array([*texts, "abacab zq", ""])))
    lang = np.repeat(np.array([0, 1, 0, 1, 5, 0]), np.diff(off))
    plain = quality.log_probabilities(model, lang, probe)
    asked = []
    values = common.Sorted.values
    monkeypatch.setattr(common.Sorted, "values", lambda self, keys, *names, **k: (asked.append(len(keys)), values(self, keys, *names, **k))[1])
    recent = quality.Recent()
    first = quality.log_probabilities(model, lang, probe, recent=recent)
    assert sum(asked) > 0
    asked.clear()
    again = quality.log_probabilities(model, lang, probe, recent=recent)
    assert np.array_equal(first, plain) and np.array_equal(again, plain) and not asked
    other = 1 - lang  # the same n-grams in another language
    assert np.array_equal(quality.log_probabilities(model, other, probe, recent=recent), quality.log_probabilities(model, other, probe))


def test_recent_with_one_slot_for_many(spark, monkeypatch):
    monkeypatch.setattr(quality.Recent, "BITS", 1)
    df = spark.createDataFrame([("some words of a text", 0)], "text string, lang_id long")
    model = common.Sorted(quality.model_files(*quality.kneser_ney(common.written(quality.count_ngrams(df), "t"))))
    recent = quality.Recent()
    for text in ("some words", "words of some", "of a text", "unseen"):
        probe, _ = quality.char_ngrams(*common.text_buffers(pa.array([text])))
        lang = np.zeros(len(probe), np.int64)
        assert np.array_equal(quality.log_probabilities(model, lang, probe, recent=recent), quality.log_probabilities(model, lang, probe))


def test_words_and_hashes_agree_with_spans():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aB \n\t\x0b\x1fé") for _ in range(rng.randrange(60))) for _ in range(200)]
    raw, off = common.text_buffers(pa.array(texts))
    for lower in (False, True):
        s, e, h, rows = words.spans(raw, off, lower=lower)
        got = words.word_spans(raw, off)
        assert all(np.array_equal(a, b) for a, b in zip(got, (s, e, rows)))
        mine = words.word_hashes(words.lowered(raw) if lower else raw, s, e)
        assert len(set(zip(h.tolist(), mine.tolist()))) == len(set(h.tolist())) == len(set(mine.tolist()))
    counts, (folded, rows) = quality.base_counts(pa.array(texts))
    assert np.array_equal(folded, mine) and np.array_equal(rows, off if not len(s) else words.word_spans(raw, off)[2])
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b")]
        assert counts["n_dup_lines"][i] == len(lines) - len(set(lines))
    assert len(words.word_hashes(raw[:0], s[:0], e[:0])) == 0


def test_grouped_tells_keys_apart_that_share_upper_bits():
    keys = np.array([5 << 40, (5 << 40) + 1, 5 << 40, 7, (5 << 40) + 1, 5 << 40], np.uint64)
    row = np.array([0, 0, 0, 1, 1, 2])
    by = words.Grouped(keys, row)
    assert by.keys.tolist() == sorted(set(keys.tolist()))
    found = {(int(by.keys[k]), int(row[a])): int(n) for k, a, n in zip(by.key, by.at, by.size)}
    assert found == dict(collections.Counter(zip(keys.tolist(), row.tolist())))
    assert all((by.keys[by.key[g]], row[by.at[g]]) == (k, r) for g, k, r in zip(by.number, keys, row))


def test_sums_without_values_count_and_are_found(spark):
    rng = np.random.default_rng(4)
    few = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    drawn = few[rng.integers(0, 2000, 20_000) ** 2 // 2000]

    def rows_of(values):
        def of(part):
            keys = np.concatenate([np.frombuffer(bytes.fromhex(x), np.uint64) for x in part.column("text").to_pylist()])
            return (keys & np.uint64(1)).astype(np.int64), keys.view(np.int64), [np.ones(len(keys))] if values else []

        return of

    df = spark.createDataFrame([(drawn[i : i + 500].tobytes().hex(),) for i in range(0, len(drawn), 500)], "text string")
    counts = collections.Counter((drawn >> np.uint64(16)).tolist())
    expected = np.array([counts.get(k, 0) for k in (few >> np.uint64(16)).tolist()], float)
    for values in (True, False):
        table = keyed.sums(df, rows_of(values), ("c",), "t")
        assert np.array_equal(table.values(few.view(np.int64), "c")[0], expected)
        assert np.array_equal(table.values(np.repeat(few, 3).view(np.int64), "c")[0], np.repeat(expected, 3))
        assert table.done.agg({"total": "sum"}).first()[0] == len(drawn)


def test_counts_with_and_without_values_merge():
    low = lambda *x: np.array(x, np.uint64)
    lang = lambda *x: np.array(x, np.int32)
    held = [(lang(0, 1), low(3, 9), [np.array([4, 2], np.float32)]), (lang(1, 0, 0), low(9, 3, 8), []), (lang(0), low(8), [])]
    for n in (2, 1 << 17):
        found = keyed._counted(list(held), n)
        assert [x.tolist() for x in (found[0], found[1], found[2][0])] == [[0, 0, 1], [3, 8, 9], [5, 2, 3]]


def test_ordering_sorts_keys_that_share_upper_bits():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000, 70_000):
        keys = rng.integers(0, 1 << 48, n).astype(np.uint64)
        keys[n // 2 :] = keys[: n - n // 2] ^ rng.integers(0, 4, n - n // 2).astype(np.uint64)  # near ones
        order = keyed.ordering(keys)
        assert np.array_equal(np.sort(order), np.arange(n)) and np.array_equal(keys[order], np.sort(keys))
