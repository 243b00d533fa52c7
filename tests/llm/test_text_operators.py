"""Every operator on documents against brute force, on texts made of all the awkward cases."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import common, jaccard, keyed, langid, licenses, lines, mixing, packing, quality, tokens, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(n))


def corpus():
    rng = random.Random(3)
    shared = "\n".join(passage(k, 30) for k in (901, 902, 903))
    rows = []
    for k in range(40):
        text = "\n".join(passage(100 + k * 7 + j, rng.randrange(5, 40)) for j in range(rng.randrange(1, 6)))
        if k % 5 == 0:
            text += "\n" + shared + "\n" + passage(5000 + k)
        rows.append((k, text))
    rows += [(100 + k, passage(1, 100)) for k in range(6)]  # copies
    base = passage(2, 200).split()
    for k in range(6):  # near copies
        changed = list(base)
        changed[10 * k + 3] = f"changed{k}"
        rows.append((110 + k, " ".join(changed)))
    rows += [(200, None), (201, ""), (202, " \t\n \r"), (203, "one"), (204, "one"), (205, "ONE"), (206, "a b c d"), (207, "é à ü ñ   \U0001f600"), (208, "x" * 300_000), (209, "word " * 3000)]
    rows += [(210, "\n\n\nPage\n\n"), (300, "same row"), (300, "same row"), (None, "null id"), (None, None), (211, "1234 5678 !!! ???"), (212, "<|endoftext|> it's <|ENDOFTEXT|> don't")]
    return [(i, t, (None if i in (1, None) else "en" if (i or 0) % 3 else "fr"), None if i == 2 else f"s{(i or 0) % 4}", len(t or ""), "own", "own", "own") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


# --- words ---------------------------------------------------------------------------------


def test_spans_are_the_words_of_the_pattern(monkeypatch):
    texts = [t for _, t, *_ in corpus()] + ["a\x0bb\x1cc", " x　y"]
    for segment in (words.SEGMENT, 64):
        monkeypatch.setattr(words, "SEGMENT", segment)
        raw, off = common.text_buffers(pa.array(texts))
        s, e, h, word_off = words.spans(raw, off)
        seen = {}
        for k, t in enumerate(texts):
            found = [bytes(raw[a:b]).decode() for a, b in zip(s[word_off[k] : word_off[k + 1]], e[word_off[k] : word_off[k + 1]])]
            assert found == WORD.findall(t or "")
            for w, x in zip(found, h[word_off[k] : word_off[k + 1]].tolist()):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_lower_case_folds_ascii_only():
    raw, off = common.text_buffers(pa.array(["AbC É", "abc é"]))
    _, _, h, _ = words.spans(raw, off, lower=True)
    assert h[0] == h[2] and h[1] != h[3]


# --- op 1 ------------------------------------------------------------------------------------


def reference_ids(text, end):
    return tokens.encoder(tokens.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("bits,n,block", [(1, 10, 4), (5, 1000, 64), (16, 5000, 4096), (17, 9000, 4096), (3, 0, 8), (8, 64, 64)])
def test_pack_roundtrip_and_random_access(bits, n, block):
    import io

    ids = np.random.default_rng(bits).integers(0, 1 << bits, n, dtype=np.uint32)
    cut = np.unique(np.random.default_rng(1).integers(0, n + 1, 5))
    offsets = np.unique(np.concatenate([[0], cut, [n]])).astype(np.int64)
    out = io.BytesIO()
    tokens.write_shard(out, np.arange(len(offsets) - 1), offsets, ids, bits, block)
    shard = tokens.Shard(out.getvalue())
    for k in range(len(offsets) - 1):
        assert (shard.doc(k) == ids[offsets[k] : offsets[k + 1]]).all()
    assert len(shard.payload) == sum(-(-min(block, n - a) * bits // 8) for a in range(0, n, block))


@pytest.mark.parametrize("shard_ids", [tokens.SHARD_IDS, 50])
def test_token_files(docs, none, shard_ids):
    manifest = tokens.write_token_files(docs, end_id=1, shard_ids=shard_ids)
    read = tokens.read_token_files(manifest)
    assert read.rdd.getNumPartitions() == manifest.count()
    out = read.collect()
    rows = sorted(((i, t) for i, t, *_ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(out) == len(rows)
    expected = collections.Counter()
    for i, t in rows:
        ids = reference_ids(t, 1)
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == expected
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert tokens.read_token_files(tokens.write_token_files(none)).count() == 0


def test_encoder_forgets_without_harm():
    enc = tokens.Encoder(tokens.default_tokenizer(), most_words=50)
    texts = [t or "" for _, t, *_ in corpus()]
    for _ in range(2):
        for t in texts:
            ids, _ = enc.encode(pa.array([t]))
            assert ids.tolist() == reference_ids(t, 0)[:-1]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.local
    ids, off = enc.encode(pa.array(["a  b", None, "c"]))
    assert ids[off[0] : off[1]].tolist() == enc.tokenizer.encode("a  b", add_special_tokens=False).ids and off[1] == off[2]


# --- op 2 ------------------------------------------------------------------------------------


def brute_links():
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").translate(low))
        if i is not None:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    link = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])} for i in sets}
    root = {}
    for i in sorted(sets):
        stack, seen = [i], {i}
        while stack:
            for j in link[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        root[i] = min(seen)
    return {i: (len(sets[i]), len(link[i]), root[i]) for i in sets}


@pytest.mark.parametrize("frequent,wide,hot", [(24, 24, 3000), (2, 3, 8), (1, 2, 3)])
def test_ngram_join(docs, monkeypatch, frequent, wide, hot):
    monkeypatch.setattr(jaccard.frequent_tokens, "__defaults__", (5, frequent))
    monkeypatch.setattr(jaccard.signatures, "__defaults__", (90, wide))
    monkeypatch.setattr(jaccard.pair_index, "__defaults__", (90, hot))
    found = jaccard.ngram_join(docs).collect()
    expected = brute_links()
    assert {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in found if r.doc_id is not None} == expected
    assert sum(r.doc_id is None for r in found) == 2 and len(found) == len(expected) + 2


def test_ngram_join_of_nothing(none):
    assert jaccard.ngram_join(none).count() == 0


def test_signatures_meet_whenever_sets_are_similar():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(2, 120))
        x = np.unique(rng.integers(0, 2000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        drop = rng.random(len(x)) < 0.05
        y = np.unique(np.concatenate([x[~drop], rng.integers(0, 2000, int(drop.sum())).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]))
        if 100 * len(np.intersect1d(x, y)) < 90 * len(np.union1d(x, y)):
            continue
        often = lambda t: (t >> np.uint64(7)) % np.uint64(3) > 0
        (a, wa), (b, wb) = jaccard.signatures(x, often(x), 90, 6), jaccard.signatures(y, often(y), 90, 6)
        assert len(np.intersect1d(a, b)) or (len(x) < 2 or len(y) < 2)


# --- op 4 ------------------------------------------------------------------------------------


def brute_lines():
    text = {}
    for i, t, *_ in corpus():
        text[i] = t or ""
    places = collections.defaultdict(list)
    for i in (i for i in text if i is not None):
        own = [x for x in text[i].split("\n") if x]
        for k in range(len(own)):
            if k + 1 < len(own):
                places[tuple(own[k : k + 2])].append((i, k, 2))
            if len(WORD.findall(own[k])) >= 50:
                places[own[k],].append((i, k, 1))
    gone = collections.defaultdict(set)
    for found in places.values():
        for i, k, n in sorted(found)[1:]:
            gone[i].update(range(k, k + n))
    return text, gone


def test_line_dedup(docs, none):
    text, gone = brute_lines()
    for r in lines.dedup_lines(docs).collect():
        if r.doc_id is None:
            assert r.removed_lines == [] and r.kept
            continue
        assert r.removed_lines == sorted(gone[r.doc_id]), r.doc_id
        at, left = -1, []
        for x in text[r.doc_id].split("\n"):
            at += x != ""
            if x == "" or at not in gone[r.doc_id]:
                left.append(x)
        if r.removed_lines and len(r.removed_lines) == r.n_lines:
            assert r.text == "" and not r["kept"]
        else:
            assert (r.text or "") == "\n".join(left)
        assert r.source == (None if r.doc_id == 2 else f"s{r.doc_id % 4}")
    assert lines.dedup_lines(none).count() == 0


def test_every_removed_line_stays_somewhere(docs):
    left, before = set(), set()
    for r in lines.dedup_lines(docs).collect():
        left |= set((r.text or "").split("\n"))
    for _, t, *_ in corpus():
        before |= set((t or "").split("\n"))
    assert before <= left | {""}


def test_chunk_boundaries_shift_with_the_text():
    own = [passage(k, 6) for k in range(60)]
    a = lines.units(pa.array(["\n".join(own)]))
    b = lines.units(pa.array(["\n".join(["new line", *own])]))
    chunks = lambda u: set(u["hash"][u["chunk"]].tolist())
    assert len(chunks(a) & chunks(b)) >= len(chunks(a)) - 1 > 2


# --- op 5 ------------------------------------------------------------------------------------


def test_license_scan(spark, none):
    mit = licenses.TEMPLATES["mit"]
    damaged = mit.replace("free of charge, ", "").replace("without limitation ", "with no limits ")
    rows = [
        (1, "intro words here\n" + mit + " trailing", "x"), (2, damaged, "x"), (3, "é " + licenses.TEMPLATES["apache-2.0-notice"] + ".", "x"), (4, "the license of the software is here", "x"), (5, None, "x"), (6, "", "x"),
        (7, "Released under the MIT License.\nReleased under the MIT License.", "x"), (8, licenses.TEMPLATES["apache-2.0-header"].upper(), "x"), (None, "Licensed under CC BY-NC 4.0.", "x"), (9, "w " * 100_000 + licenses.TEMPLATES["isc"], "x"),
    ]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    texts = {i: t for i, t, _ in rows}
    got = collections.defaultdict(list)
    for r in found:
        got[r.doc_id].append(r.license)
        assert 0.8 <= r.coverage <= 1 and 0 <= r.start < r.end <= len(texts[r.doc_id])
    assert dict(got) == {1: ["mit"], 2: ["mit"], 3: ["apache-2.0-notice"], 7: ["mit-notice"] * 2, 8: ["apache-2.0-header"], None: ["cc-by-nc-4.0-notice"], 9: ["isc"]}
    exact = next(r for r in found if r.doc_id == 1)
    assert texts[1][exact.start : exact.end] == mit.rstrip(".") and exact.coverage == 1
    assert licenses.scan_licenses(none).count() == 0


def test_license_texts_parts_and_kin(spark):
    from importlib.resources import files

    texts = {x.name[:-4]: x.read_text() for x in files("folioflow.llm").joinpath("license_texts").iterdir()}
    mit = licenses.TEMPLATES["mit"]
    half = mit.split()
    split = " ".join([*half[:80], *("inserted%d" % k for k in range(30)), *half[80:]])
    notice = licenses.TEMPLATES["gpl-3.0-notice"]
    disclaimer = mit[mit.index("THE SOFTWARE IS PROVIDED") :]
    rows = [*texts.items(), ("split", split), ("v9", notice.replace("3", "1")), ("lesser", notice.replace("General", "Lesser General")), ("cc", "Licensed under CC BY-SA 4.0"), ("part", "before it " + disclaimer)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in licenses.scan_licenses(df, least=0.0).collect():
        found[rows[r.doc_id][0]].append(r)
    for name, text in texts.items():
        (r,) = found[name]
        assert r.license == name and r.coverage == 1 and r.end - r.start > 0.95 * len(text.strip())
    assert [(r.license, r.coverage) for r in found["split"]] == [("mit", 1)]
    assert not {"v9", "cc"} & set(found) and all(r.license != "gpl-3.0-notice" for r in found["lesser"])
    (r,) = found["part"]
    assert r.license == "mit" and 0.3 < r.coverage < 0.7
    assert "part" not in {rows[r.doc_id][0] for r in licenses.scan_licenses(df).collect()}


# --- op 6 ------------------------------------------------------------------------------------


def test_quality_counts(docs, none):
    out = quality.quality_rules(docs).collect()
    assert len(out) == len(corpus())
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    expected = collections.Counter()
    for i, t, *_ in corpus():
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        times, cover = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if times[tuple(w[k : k + 5])] > 1:
                cover.update(range(k, k + 5))
        expected[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)] += 1
    assert got == expected
    assert all(not r["kept"] for r in out if r.base_failed)
    assert sum(r["kept"] for r in out) >= 40
    assert quality.quality_rules(none).count() == 0


def test_kneser_ney_is_a_distribution_and_agrees_with_a_plain_model(spark):
    texts = ["abab abba baab", "ab ba ab", "abc cab", "bb"]
    df = spark.createDataFrame([(t, 0) for t in texts], "text string, lang_id long")
    grams = collections.Counter()
    keys, _ = quality.char_ngrams(*common.text_buffers(pa.array(texts)))
    grams.update(keys.tolist())
    counted = {r.k: r.c for r in quality.count_ngrams(df).collect()}
    assert counted == grams
    entries, unseen = quality.kneser_ney(common.written(quality.count_ngrams(df), "t"))
    table = {(r.n, r.k): (r.logp, r.back) for r in entries.collect()}

    level, levels = grams, {4: grams}
    for n in (3, 2, 1):
        level = collections.Counter(k & ((1 << 12 * n) - 1) for k in level)
        levels[n] = level

    def discount(n, c):
        kinds = [sum(v == i for v in levels[n].values()) for i in (1, 2, 3, 4)]
        y = kinds[0] / (kinds[0] + 2 * kinds[1]) if kinds[0] else 0.5
        d = [i - (i + 1) * y * (kinds[i] / kinds[i - 1] if kinds[i - 1] else 0.5) for i in (1, 2, 3)]
        return [min(max(x, 0.1), i - 0.1) for i, x in zip((1, 2, 3), d)][min(c, 3) - 1]

    def p(n, k):
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        low = p(n - 1, k & ((1 << 12 * (n - 1)) - 1))
        same = {x: c for x, c in levels[n].items() if x >> 12 == k >> 12}
        if not same:
            return low
        total = sum(same.values())
        c = same.get(k, 0)
        return max(0.0, (c - discount(n, c)) / total if c else 0.0) + sum(discount(n, v) for v in same.values()) / total * low

    files = quality.model_files(entries, unseen)
    probe, _ = quality.char_ngrams(*common.text_buffers(pa.array(["abacab zq"])))
    got = quality.log_probabilities(common.Sorted(files), np.zeros(len(probe), np.int64), probe)
    assert np.allclose(got, [np.log(p(4, k)) for k in probe.tolist()], atol=1e-5)
    assert len(table) == sum(map(len, levels.values()))
    context = next(iter(grams)) >> 12 << 12
    assert abs(sum(p(4, context | s) for s in levels[1]) + p(4, context | 4000) - 1) < 1e-9


def plain_word_model(texts):
    """Perplexity of each text under the counts of all others: everything counted anew without it; discounts of all texts."""

    def levels(some):
        three = collections.Counter()
        for t in some:
            w = ["<s>", "<s>", *WORD.findall(t.lower()), "</s>"]
            three.update(zip(w, w[1:], w[2:]))
        two = collections.Counter(k[1:] for k in three)
        return {3: three, 2: two, 1: collections.Counter(k[1:] for k in two)}

    def discounts(table):
        n = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [0.0, *[min(max(i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0.5), 0.1), i - 0.1) for i in (1, 2, 3)]]

    whole = levels(texts)
    d = {n: discounts(t) for n, t in whole.items()}
    out = []
    for i, text in enumerate(texts):
        others = levels(texts[:i] + texts[i + 1 :])

        def p(k):
            if not k:
                return 1 / (len(whole[1]) + 1)
            n, low = len(k), p(k[1:])
            same = {x: c for x, c in others[n].items() if x[:-1] == k[:-1]}
            if not same:
                return low
            cut = lambda c: d[n][min(c, 3)]
            c = same.get(k, 0)
            return (c - cut(c) + sum(map(cut, same.values())) * low) / sum(same.values())

        w = ["<s>", "<s>", *WORD.findall(text.lower()), "</s>"]
        logs = [np.log(p(k)) for k in zip(w, w[1:], w[2:])]
        out.append(np.exp(-np.mean(logs)))
    return out


def test_word_model_agrees_with_a_plain_one(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c d e Fa g".split()) for _ in range(rng.randrange(3, 40))) for _ in range(12)]
    texts += [texts[0], "x y z x y z", "lone"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.word_perplexity for r in quality.quality_rules(df).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], plain_word_model(texts), rtol=1e-4)


def test_word_entries_grow_with_the_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "0L lang_id")
    rows_of = lambda part: (np.zeros(len(g := quality.word_grams(part.column("text"), part.column("lang_id").to_numpy())[0]["tri"]), np.int64), g, [np.ones(len(g))])
    trigrams = lambda df: keyed.sums(df, rows_of, ("c",), "t").done.agg({"distinct": "sum"}).first()[0]
    half, whole = trigrams(docs.where("doc_id % 2 = 0")), trigrams(docs)
    expected = set()
    for r in docs.collect():
        if w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            w = ["<s>", "<s>", *w, "</s>"]
            expected.update(zip(w, w[1:], w[2:]))
    assert whole == len(expected) and whole > 1.5 * half


# --- op 7 ------------------------------------------------------------------------------------


def check_packing(out, capacity):
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_packing(docs, none):
    out = packing.pack_documents(docs).collect()
    by = check_packing(out, 2048)
    expected = collections.Counter()
    for i, t, *_ in corpus():
        ids = reference_ids(t, 0)
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[i, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    counts = collections.Counter(r.length for r in out)
    full = counts.pop(2048, 0)
    assert len(by) <= full + packing.lower_bound(counts, 2048) + 1
    assert packing.pack_documents(none).count() == 0


def exact_bins(sizes, capacity):
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in sorted({b for b in bins if b >= sizes[k]}):
            bins.remove(room)
            bins.append(room - sizes[k])
            go(k + 1, bins)
            bins.remove(room - sizes[k])
            bins.append(room)
        bins.append(capacity - sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_plan_is_optimal_on_small_inputs():
    rng, better = random.Random(5), 0
    for _ in range(120):
        sizes = sorted((rng.randrange(5, 60) for _ in range(rng.randrange(1, 11))), reverse=True)
        counts = collections.Counter(sizes)
        patterns = packing.plan(counts, 100)
        used = collections.Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= 100
            for s in pattern:
                used[s] += times
        assert used == counts
        n, greedy = sum(t for _, t in patterns), sum(t for _, t in packing.best_fit_decreasing(counts, 100))
        assert packing.lower_bound(counts, 100) <= n <= greedy
        assert n == exact_bins(sizes, 100)
        better += n < greedy
    assert sum(t for _, t in packing.plan({44: 2, 42: 2, 38: 2, 24: 2, 26: 1, 11: 2}, 100)) <= sum(t for _, t in packing.best_fit_decreasing({44: 2, 42: 2, 38: 2, 24: 2, 26: 1, 11: 2}, 100))


# --- op 9 ------------------------------------------------------------------------------------

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then the other", "de": "der schnelle braune fuchs springt über den faulen hund und dann", "fr": "le rapide renard brun saute par dessus le chien paresseux et puis", "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"}


def test_language_id(spark, none):
    rows = [(k, " ".join(random.Random(k).sample(TEXTS[lang].split(), 7)), lang) for k, lang in enumerate(list(TEXTS) * 30)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "en"), (1003, TEXTS["de"], None), (1004, "×÷ ☃", "fr"), (None, TEXTS["fr"], "fr")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, lang string, score string")
    out = langid.identify_documents(df).collect()
    got = {r.doc_id: r for r in out}
    for i, _, lang in rows[:120]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002, 1004))
    assert got[1003].lang_pred == "de" and got[None].lang_pred == "fr" and not got[None].held_out
    assert langid.identify_documents(none).count() == 0
    one = langid.identify_documents(df.where("lang = 'en'")).where("text rlike '[a-z]'").collect()
    assert {r.lang_pred for r in one} == {"en"}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 9, 20])
def test_codewords_differ(n):
    code = langid.code_matrix(n)
    assert code.shape[0] == n
    if n > 1:
        apart = (code.shape[1] - (code @ code.T)[np.triu_indices(n, 1)]) / 2
        assert apart.min() >= (1 if n < 3 else 2)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_every_language_is_learned(spark):
    rows = [(k, "the words of a common tongue", "en") for k in range(6000)] + [(10_000 + k, "rarissima verba paucorum hominum", "la") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, most=50)
    assert list(model.languages) == ["en", "la"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(df.where("doc_id >= 10000 OR doc_id < 3"), model).collect()}
    assert {got[k] for k in (10_000, 10_001, 10_002)} == {"la"} and {got[k] for k in (0, 1, 2)} == {"en"}


# --- op 10 -----------------------------------------------------------------------------------


def level(sizes, weights, most=3):
    """Targets by repeated resharing, in fractions."""
    from fractions import Fraction

    total, target, free = sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = Fraction(most * sizes[i])
            left -= target[i]
        free -= over
    return [float(t) for t in target]


def test_mix(docs, none):
    out = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, source, *_ in corpus():
        sizes[source] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    expected = dict(zip(names, level([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken == r["size"] * r.copies and r.taken <= 3 * r["size"]
        assert r.copies in (int(r.target // r.source_size), int(r.target // r.source_size) + 1)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mixed(docs).count() == sum(r.copies for r in out)
    assert mixing.mix(none).count() == 0


def test_taken_words_come_near_the_targets(spark):
    rows = [(k if k % 50 else None, " ".join(["w"] * (1 + k * k % 97 if k % 23 else 1000)), f"s{k % 7}" if k % 7 else None) for k in range(1, 700)]
    rows += [(700 + k, "w w w", "s9") for k in range(40)]
    by = collections.defaultdict(list)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r.source].append(r)
    for own in by.values():
        mean = own[0].source_size / len(own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= mean


@pytest.mark.parametrize("seed", range(12))
def test_targets_are_the_reshared_ones(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice((0, 1, 5, 100, 10_000)) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(level(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))]))
