"""Quality rules: repetition counts of whole texts and n-gram perplexity under a modified Kneser-Ney model.

The model is one of characters, of order `ORDER`, per language (column `lang`; null is a
language of its own), counted over all texts. A character is a symbol of 12 bits (letters folded,
white space one symbol, digits one) or, from code point 3824 on, two of them, so that an n-gram of up to
four symbols packs into 48 bits. Languages go by the 64-bit hash of their name.
Spark counts the n-grams (each task sends a sorted, already summed table), derives
continuation counts, discounts and interpolated probabilities by joins on those keys, and
writes keys, log probabilities and back-off weights as sorted arrays in the shared folder,
which scoring tasks map into memory.

A second model counts words, order three, without any bound: `word_tables` counts every trigram
of folded words under a hash (`keyed`: sorted compressed blocks travel, about four bytes a key), and
each text is scored by the counts of all *other* texts
(its own are taken off at every order), for otherwise any rare word sequence would be
explained by itself. So a trigram or bigram that stands once in all texts needs no entry: it is
counted in its contexts and in the discounts, and a text that meets no entry is the one that
holds it. Entries grow with the input.

A text's perplexity under either model is compared with its language's band: the
median of log perplexity, less `LOWER` and plus `UPPER` times a standard deviation that falls with
the root of the text's length (its scale is the language's median absolute deviation times that
root); a text below (made of what repeats) or above (made of what is rare) is rejected. Words
reject above only: any copy of a text elsewhere makes its words predictable, and copies are not this
operator's matter.

Edge cases: null and empty texts have zero counts and fail the base rules (fewer than ten words);
perplexity is null for a text without characters; a language whose texts all score alike
has a band of `LEAST` below and ten times that above; repeated rows count twice in the model; an empty table gives an empty
result; other columns are ignored. A language
of one text has no other texts: its words are all equally likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Sorted, read_table, roomy, scratch, slices, text_buffers, write_sorted, written
from folioflow.llm.keyed import Sums, freed, sums
from folioflow.llm.words import Grouped, groups, lowered, mix, shingles, take_ranges, word_hashes, word_spans

ORDER = 4
LOWER, UPPER = 4.5, 9.0  # reach below and above the median, in standard deviations
LEAST = 0.005
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words in repeated windows

START, END = 1, 2
_STEP = np.uint64(0x9FB21C651E98DF25)
WIDE = 3824  # code points from here on are two symbols: 3824 + code // 4096, then code % 4096
_SYMBOL = None


def symbols(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The 12-bit symbols of code points, and how many each of them has (1 or 2; None if all have 1)."""
    global _SYMBOL
    if _SYMBOL is None:
        table = np.arange(WIDE, dtype=np.uint16)
        for c in range(WIDE):
            low = chr(c).lower()
            if len(low) == 1 and ord(low) < WIDE:
                table[c] = ord(low)
        table[[0x20, *range(0x09, 0x0E), 0x85, 0xA0]] = 0x20
        table[0x30:0x3A] = 0x30
        table[:3] = 0x7F
        _SYMBOL = table.astype(np.int64)
    first = _SYMBOL.take(codes, mode="clip")
    wide = codes >= WIDE
    if not wide.any():
        return first, None
    first = np.where(wide, WIDE + (codes >> np.uint32(12)), first).astype(np.int64)
    n = 1 + wide.astype(np.int64)
    out = np.repeat(first, n)
    out[(np.cumsum(n) - 1)[wide]] = codes[wide] & np.uint32(4095)
    return out, n


def char_ngrams(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at every character and at the end mark of each row; the rows' offsets.

    A row begins with order - 1 start marks and an empty row has no n-gram.
    """
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = np.diff(_char_offsets(raw, offsets))
    values, each = symbols(codes)
    if each is not None:
        n = np.diff(np.concatenate([[0], np.cumsum(each)])[_char_offsets(raw, offsets)])
    rows = np.flatnonzero(n)
    off = np.concatenate([[0], np.cumsum(np.where(n > 0, n + order, 0))])
    marks = (off[rows][:, None] + np.arange(order - 1)).ravel()
    ends = off[rows + 1] - 1
    inside = np.ones(off[-1], dtype=bool)
    inside[marks] = inside[ends] = False
    key = np.full(off[-1], START, dtype=np.int64)
    key[inside] = values
    key[ends] = END
    width = 1  # symbols in a key
    while width < order:
        step = min(width, order - width)
        before = key[:-step] << np.int64(12 * step)
        key[step:] |= before
        width += step
    inside[ends] = True
    return key[inside], np.concatenate([[0], np.cumsum(np.where(n > 0, n + 1, 0))])


def _char_offsets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows' offsets in code points."""
    return offsets - np.searchsorted(np.flatnonzero(raw.view(np.int8) < -64), offsets)


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang_id, k, c): n-grams of all texts; each task sums its own before the shuffle."""

    def merge(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order_ = np.argsort(keys, kind="stable")
        keys, counts = keys[order_], counts[order_]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                keys, counts = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang, np.int64)), pa.array(keys), pa.array(counts)], names=["lang_id", "k", "c"])

        for batch in batches:
            for part in slices(batch):
                keys, off = char_ngrams(*text_buffers(part.column("text")), order)
                langs = part.column("lang_id").to_numpy()
                for lang in np.unique(langs).tolist():
                    rows = np.flatnonzero(langs == lang)
                    own = np.sort(keys[take_ranges(off[rows], np.diff(off)[rows])])
                    if not len(own):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    held.setdefault(lang, []).append((own[first], np.diff(np.append(first, len(own)))))
                    size += len(first)
                if size > 3_000_000:
                    held = {lang: [merge(parts)] for lang, parts in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > 2_000_000:  # bounds the worker's memory; Spark sums what is sent twice
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return docs.select("text", "lang_id").mapInArrow(run, "lang_id long, k long, c long").groupBy("lang_id", "k").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Entries (n, lang_id, k, logp, back) of every order, and (lang_id, logp) of an unseen symbol.

    Modified Kneser-Ney: raw counts at the highest order, numbers of distinct left neighbours
    below it; discounts by counts of counts for each language and order; interpolated.
    """
    level, levels = counts, {order: counts}
    for n in range(order - 1, 0, -1):
        level = level.groupBy("lang_id", F.col("k").bitwiseAND((1 << (12 * n)) - 1).alias("k")).agg(F.count("*").alias("c"))
        if n > 1:
            level = written(level, f"order{n}")
        levels[n] = level
    vocabulary = levels[1].groupBy("lang_id").agg((F.count("*") + 1).cast("double").alias("v"))
    lower, out = None, []
    for n in range(1, order + 1):
        table = levels[n]
        kinds = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        found = table.groupBy("lang_id").agg(*kinds)
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        discount = [
            F.least(F.greatest(F.lit(i) - (i + 1) * y * F.when(F.col(f"n{i}") > 0, F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5)), F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}")
            for i in (1, 2, 3)
        ]
        # one row a language: as small as the list of languages
        rated = table.join(found.select("lang_id", *discount), "lang_id")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rated = rated.select("lang_id", "k", "c", off.alias("d"), F.shiftright("k", 12).alias("h"))
        sums = rated.groupBy("lang_id", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        own = rated.join(sums, ["lang_id", "h"])
        base = (F.col("c") - F.col("d")) / F.col("total")
        left = F.col("mass") / F.col("total")
        if n == 1:
            probabilities = own.join(vocabulary, "lang_id").select("lang_id", "k", (base + left / F.col("v")).alias("p"))
            unseen = sums.join(vocabulary, "lang_id").select("lang_id", F.log(left / F.col("v")).alias("logp"))
        else:
            probabilities = own.withColumn("s", F.col("k").bitwiseAND((1 << (12 * (n - 1))) - 1)).join(lower, ["lang_id", "s"]).select("lang_id", "k", (base + left * F.col("p_low")).alias("p"))
            backs = sums.select("lang_id", F.col("h").alias("k"), F.log(left).alias("back"))
            out[-1] = out[-1].join(backs, ["lang_id", "k"], "left")
        probabilities = written(probabilities, f"prob{n}")
        lower = probabilities.select("lang_id", F.col("k").alias("s"), F.col("p").alias("p_low"))
        out.append(probabilities.select("lang_id", "k", F.log("p").alias("logp")))
    entries = None
    for n, table in enumerate(out, 1):
        back = F.coalesce("back", F.lit(0.0)) if "back" in table.columns else F.lit(0.0)
        rows = table.select(F.lit(n).alias("n"), "lang_id", "k", "logp", back.alias("back"))
        entries = rows if entries is None else entries.unionByName(rows)
    return entries, unseen


def _key(lang: np.ndarray, n: int | np.ndarray, k: np.ndarray) -> np.ndarray:
    """A 64-bit hash of language, order and packed n-gram."""
    with np.errstate(over="ignore"):
        return mix(mix(lang.view(np.uint64), 40) + mix(k.view(np.uint64), 41) + mix(np.asarray(n, dtype=np.int64).view(np.uint64), 42), 43).view(np.int64)


def model_files(entries: DataFrame, unseen: DataFrame) -> list[dict]:
    """Sorted arrays of all orders; an unseen symbol's log probability is the entry of order 0."""

    def keyed(batches):
        for b in batches:
            lang, n, k = (b.column(c).to_numpy() for c in ("lang_id", "n", "k"))
            yield pa.RecordBatch.from_arrays([pa.array(_key(lang, n.astype(np.int64), k)), b.column("logp"), b.column("back")], names=["k", "logp", "back"])

    columns = "lang_id", F.col("n").cast("long").alias("n"), "k", F.col("logp").cast("float").alias("logp"), F.col("back").cast("float").alias("back")
    rows = entries.select(*columns).unionByName(unseen.withColumns({"n": F.lit(0), "k": F.lit(0).cast("long"), "back": F.lit(0.0)}).select(*columns))
    return write_sorted(rows.mapInArrow(keyed, "k long, logp float, back float"), "model", ("logp", "back"))


class Recent:
    """Log probabilities that were looked up lately: a table by hash, in which what comes later replaces what is there."""

    BITS = 19

    def __init__(self):
        self.hashes = (np.arange(1 << self.BITS, dtype=np.uint64) ^ np.uint64(1)) << np.uint64(64 - self.BITS)  # none of its slot's
        self.logs = np.zeros(1 << self.BITS)


def log_probabilities(model: Sorted, lang: np.ndarray, keys: np.ndarray, order: int = ORDER, recent: Recent | None = None) -> np.ndarray:
    """ln p of each packed n-gram's last symbol given the ones before, in its language's model; `recent` serves one model and order."""
    if not len(keys):
        return np.zeros(0)
    with np.errstate(over="ignore"):
        hashed = keys.view(np.uint64) * _STEP
        hashed += lang.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if recent is None:
        return _looked_up(model, lang, keys, hashed, order)
    slot = (hashed >> np.uint64(64 - Recent.BITS)).view(np.int64)
    out = recent.logs.take(slot)
    new = np.flatnonzero(recent.hashes.take(slot) != hashed)
    if len(new):
        hashed, slot = hashed[new], slot[new]
        out[new] = logs = _looked_up(model, lang[new], keys[new], hashed, order)
        recent.hashes[slot] = hashed
        same = recent.hashes[slot] == hashed  # where several fell into a slot, one of them stays
        recent.logs[slot[same]] = logs[same]
    return out


def _looked_up(model: Sorted, lang: np.ndarray, keys: np.ndarray, hashed: np.ndarray, order: int) -> np.ndarray:
    first, inverse, _ = groups(hashed)
    tongue, gram = lang[first], keys[first]
    out = np.zeros(len(first))
    rest = np.arange(len(first))
    for n in range(order, 0, -1):
        if not len(rest):
            break
        k = gram[rest] & np.int64((1 << (12 * n)) - 1)
        logp = model.values(_key(tongue[rest], n, k), "logp")[0]
        hit = ~np.isnan(logp)
        out[rest[hit]] += logp[hit]
        rest, k = rest[~hit], k[~hit]
        if n > 1 and len(rest):
            back = model.values(_key(tongue[rest], n - 1, k >> np.int64(12)), "back")[0]
            out[rest] += np.nan_to_num(back)
    if len(rest):
        out[rest] += model.values(_key(tongue[rest], 0, np.zeros(len(rest), np.int64)), "logp", absent=-20.0)[0]
    return out[inverse]


# --- words ------------------------------------------------------------------------------------

_EDGE = mix(np.array([START, END], dtype=np.uint64), 7)


def folded_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lowered, and the rows' offsets."""
    s, e, off = word_spans(raw, offsets)
    return word_hashes(lowered(raw), s, e), off


def word_grams(column: pa.Array, lang: np.ndarray, words: tuple[np.ndarray, np.ndarray] | None = None, of: tuple[str, ...] = ("tri", "pair", "word")) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Keys of the trigram that ends at every word and at the end mark of each row (tri), and the rows' offsets.

    Besides the keys of all pairs and words of the row but its first mark: tri[i] begins with pair[at[i]] and
    ends with pair[at[i] + 1], whose words are word[at[i]] and word[at[i] + 1]. A row
    begins with two start marks; a row without words has no trigram. `row` is the row of each pair. `words`: the folded words' hashes and offsets, where known. `of`: the keys that are wanted.
    """
    h, off = words or folded_words(*text_buffers(column))
    n = np.diff(off)
    rows = np.flatnonzero(n)
    line_off = np.concatenate([[0], np.cumsum(np.where(n > 0, n + 3, 0))])
    line = np.full(line_off[-1], _EDGE[0])
    line[take_ranges(line_off[rows] + 2, n[rows])] = h
    line[line_off[rows + 1] - 1] = _EDGE[1]
    row = np.repeat(np.arange(len(n)), np.where(n > 0, n + 3, 0))
    tongue = mix(lang.view(np.uint64), 8)[row]
    rest = np.ones(len(line), bool)
    rest[line_off[rows]] = False  # the first mark ends no pair
    use = rest.copy()
    use[line_off[rows] + 1] = False
    at = (np.cumsum(rest) - 1)[use] - 1
    pair = line.copy()
    pair[1:] += line[:-1] * _STEP
    key = lambda x, k, where: mix(x[where] + tongue[where], 50 + k).view(np.int64)
    out = {"at": at, "row": row[rest]}
    if "tri" in of:
        triple = line.copy()
        triple[1:] += pair[:-1] * _STEP
        out["tri"] = key(triple, 2, use)
    if "pair" in of:
        out["pair"] = key(pair, 1, rest)
    if "word" in of:
        out["word"] = key(line, 0, rest)
    return out, np.concatenate([[0], np.cumsum(np.where(n > 0, n + 1, 0))])


class WordModel:
    """Sums of the word model: see `word_tables`."""

    def __init__(self, tri: Sums, pairs: Sums, words: Sums):
        self.tri, self.pairs, self.words = tri, pairs, words


def word_tables(docs: DataFrame) -> WordModel:
    """Modified Kneser-Ney counts of words, order three, from (text, lang_id).

    tri: c of trigrams. pairs: c (distinct words before), t (occurrences), m (sum of the discounts of
    the trigrams that begin with it). words: c, t, m likewise over distinct pairs. What a pair or a word
    sums over distinct n-grams comes from a pass over the texts in which each of the n-gram's t
    occurrences gives its t-th part. Trigrams and pairs of one occurrence have no entry.
    """

    def grams(part, *of):
        lang = part.column("lang_id").to_numpy()
        g, off = word_grams(part.column("text"), lang, of=of)
        return g, lang, np.repeat(np.arange(len(lang)), np.diff(off))

    def tri(part):
        g, lang, row = grams(part, "tri")
        return lang[row], g["tri"], []

    threes = sums(docs, tri, ("c",), "trigrams", once=("c",))

    def parts(table: Sums, lang, row, c, t):
        """Of each n-gram's occurrence: its part of 1 and of its discount."""
        return 1 / t, table.discounts(lang)[row, np.minimum(c, 3).astype(np.int64)] / t

    def pair(part):
        g, lang, row = grams(part, "tri", "pair")
        c3 = threes.values(g["tri"], "c", absent=1)[0]
        n = len(g["pair"])
        c, m = np.zeros(n), np.zeros(n)
        c[g["at"] + 1], m[g["at"]] = parts(threes, lang, row, c3, c3)
        return lang[g["row"]], g["pair"], [c, np.ones(n), m]  # the last pair of a text begins no trigram but has occurred

    twos = sums(docs, pair, ("c", "t", "m"), "pairs", once=("c", "t"), shares={"m": "t"})

    def word(part):
        g, lang, row = grams(part, "pair", "word")
        c2, t2 = twos.values(g["pair"][g["at"] + 1], "c", "t", absent=1)
        n = len(g["word"])
        c, t, m = np.zeros(n), np.zeros(n), np.zeros(n)
        c[g["at"] + 1], m[g["at"]] = parts(twos, lang, row, c2, t2)
        t[g["at"]] = c2 / t2
        first, number, _ = groups(g["word"].view(np.uint64))  # words recur within a slice
        return lang[g["row"][first]], g["word"][first], [np.bincount(number, weights=x, minlength=len(first)) for x in (c, t, m)]

    return WordModel(threes, twos, sums(docs, word, ("c", "t", "m"), "words", shares={"m": "t"}))


def word_log_probabilities(model: WordModel, column: pa.Array, langs: np.ndarray, words_=None) -> tuple[np.ndarray, np.ndarray]:
    """ln p of each word and end mark by the counts of all other texts of its language; the rows' offsets."""
    g, off = word_grams(column, langs, words_)
    n = np.diff(off)
    if not len(g["tri"]):
        return np.zeros(0), off
    row, head = np.repeat(np.arange(len(n)), n), g["at"]
    by3, by2, by1 = Grouped(g["tri"].view(np.uint64), row), Grouped(g["pair"].view(np.uint64), g["row"]), Grouped(g["word"].view(np.uint64), g["row"])
    values = lambda sums, by, *names, absent: [x[by.key] for x in sums.ordered_values(by.keys, *names, absent=absent)]
    first3, in3, own3 = by3.at, by3.number, by3.size
    pair_at, pair_in = by2.at, by2.number
    word_at, word_in = by1.at, by1.number
    in2, from3, in1, from2 = pair_in[head + 1], pair_in[head], word_in[head + 1], word_in[head]
    own2 = np.bincount(from3, minlength=len(pair_at))  # texts' own occurrences of a pair at the head of a trigram

    def left(c, own, d, at):
        rest, at, d = np.maximum(c - own, 0), 4 * at, d.ravel()
        return rest, d.take(at + np.minimum(rest, 3).astype(np.int64)), d.take(at + np.minimum(c, 3).astype(np.int64))

    threes, pairs, words = model.tri, model.pairs, model.words
    c3, d3, d3_all = left(values(threes, by3, "c", absent=1)[0], own3, threes.discounts(langs), row[first3])
    gone3 = (c3 == 0).astype(float)
    c2, t2, m2 = values(pairs, by2, "c", "t", "m", absent=0)
    lone = c2 + t2 == 0  # no entry: one occurrence in all texts, this one
    c2[lone] = 1
    t3, m3 = t2 - own2, m2 - np.bincount(from3[first3], weights=d3_all - d3, minlength=len(pair_at))

    some2 = np.flatnonzero(np.bincount(in2, minlength=len(pair_at)))
    place2 = np.full(len(pair_at), -1)
    place2[some2] = np.arange(len(some2))
    c2, d2, d2_all = left(c2[some2], np.bincount(place2[in2[first3]], weights=gone3, minlength=len(some2)), pairs.discounts(langs), g["row"][pair_at[some2]])
    gone2 = (c2 == 0).astype(float)
    token2 = np.zeros(len(some2), np.int64)  # a token that ends each of these pairs
    token2[place2[in2]] = np.arange(len(in2))
    c1, t1, m1 = values(words, by1, "c", "t", "m", absent=0)
    mids = from2[token2]
    t2 = t1 - np.bincount(from2[first3], weights=gone3, minlength=len(word_at))
    m2 = m1 - np.bincount(mids, weights=d2_all - d2, minlength=len(word_at))

    some1 = np.flatnonzero(np.bincount(in1, minlength=len(word_at)))
    place1 = np.full(len(word_at), -1)
    place1[some1] = np.arange(len(some1))
    rows1 = g["row"][word_at[some1]]
    c1, d1, d1_all = left(np.where(c1[some1] > 0, c1[some1], 1), np.bincount(place1[in1[token2]], weights=gone2, minlength=len(some1)), words.discounts(langs), rows1)
    total, mass, distinct = words.language_numbers(langs, "total", "mass", "distinct")
    t1 = total - np.bincount(row[token2], weights=gone2, minlength=len(n))
    m1 = mass - np.bincount(rows1, weights=d1_all - d1, minlength=len(n))

    def mixed(c, d, t, m, low):
        seen = t > 0.5
        return np.where(seen, (c - d + np.maximum(m, 0) * low) / np.where(seen, t, 1), low)

    # each pair's and trigram's probability once, then that of the tokens
    p = mixed(c1, d1, t1[rows1], m1[rows1], (1 / (distinct + 1))[rows1])
    p = mixed(c2, d2, t2[mids], m2[mids], p[place1[in1[token2]]])
    p = mixed(c3, d3, t3[from3[first3]], m3[from3[first3]], p[place2[in2[first3]]])
    return np.log(np.maximum(p, 1e-30))[in3], off


def base_counts(column: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    r"""n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row; and the folded words' hashes and offsets."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    s, e, off = word_spans(raw, offsets)
    low = lowered(raw)
    folded = word_hashes(low, s, e)
    h = folded
    if len(capital := np.flatnonzero(low != raw)):
        capital = np.unique(np.searchsorted(s, capital, side="right") - 1)
        h = folded.copy()
        h[capital] = word_hashes(raw, s[capital], e[capital])
    between = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), offsets))
    marks = raw - np.uint8(ord("#")) < 4  # # $ % &
    for x in b"*|<>":
        marks |= raw == x
    bytes_ = np.concatenate([[0], np.cumsum(e - s)])[off]
    # words in 5-word windows that occur twice or more in their text
    row = np.repeat(np.arange(n), np.diff(off))
    start = np.flatnonzero(row[:-4] == row[4:]) if len(s) > 4 else np.zeros(0, np.int64)
    windows, window_off = shingles(h, off, 5)
    full = np.diff(off) >= 5
    values = windows[np.repeat(full, np.diff(window_off))]
    _, number, times = groups(values ^ mix(row[start].astype(np.uint64), 13))
    twice = times[number] > 1
    edge = np.bincount(start[twice], minlength=len(s) + 1) - np.bincount(start[twice] + 5, minlength=len(s) + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return {
        "n_words": np.diff(off),
        "word_chars": np.diff(bytes_) - between(raw.view(np.int8) < -64),
        "n_symbols": between(marks),
        "n_dup_lines": repeated_lines(raw, offsets, s, e),
        "n_repeat_words": covered[off[1:]] - covered[off[:-1]],
    }, (folded, off)


def repeated_lines(raw: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of each row the lines that hold a word and equal an earlier one of it; s, e: the words.

    Only lines that share length and first eight bytes with another of their row are hashed whole.
    """
    breaks = np.flatnonzero(raw == 0x0A)
    edges = np.sort(np.concatenate([breaks, breaks + 1, offsets]))  # between two of them lies a line, a break or nothing
    ls, le = edges[:-1], edges[1:]
    holds = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[holds], le[holds]
    n = len(offsets) - 1
    lrow = np.searchsorted(offsets, ls, side="right") - 1
    head = word_hashes(raw, ls, np.minimum(le, ls + 8)) + mix((le - ls).astype(np.uint64), 5) + mix(lrow.astype(np.uint64), 6)
    _, number, times = groups(head)
    like = np.flatnonzero(times[number] > 1)
    if not len(like):
        return np.zeros(n, np.int64)
    lrow = lrow[like]
    lh = word_hashes(raw, ls[like], le[like])
    order = np.lexsort((lh, lrow))
    again = (lh[order][1:] == lh[order][:-1]) & (lrow[order][1:] == lrow[order][:-1])
    return np.bincount(lrow[order][1:][again], minlength=n)


def quality_rules(docs: DataFrame, order: int = ORDER, below: float = LOWER, above: float = UPPER) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity, lower, upper, word_perplexity, word_upper, kept)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.select("doc_id", "text", F.xxhash64("lang").alias("lang_id"))
    with scratch() as folders:
        files = model_files(*kneser_ney(written(count_ngrams(rows, order), "ngrams"), order))
        folders -= {f["root"] for f in files}
    freed(docs.sparkSession)
    word_model = word_tables(rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches):
        roomy()
        model, recent = Sorted(files), Recent()
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                counts, folded = base_counts(part.column("text"))
                keys, off = char_ngrams(*text_buffers(part.column("text")), order)
                lang = np.repeat(part.column("lang_id").to_numpy(), np.diff(off))
                logs = np.concatenate([[0.0], np.cumsum(log_probabilities(model, lang, keys, order, recent))])
                n = np.diff(off)
                mean = (logs[off[1:]] - logs[off[:-1]]) / np.maximum(n, 1)
                word_logs, word_off = word_log_probabilities(word_model, part.column("text"), part.column("lang_id").to_numpy(), folded)
                word_logs, tokens = np.concatenate([[0.0], np.cumsum(word_logs)]), np.diff(word_off)
                word_mean = (word_logs[word_off[1:]] - word_logs[word_off[:-1]]) / np.maximum(tokens, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang_id"), *[pa.array(counts[c].astype(np.int64)) for c in names], pa.array(n.astype(np.int64)), pa.array(-mean, mask=n == 0), pa.array(tokens.astype(np.int64)), pa.array(-word_mean, mask=tokens == 0)],
                    names=["doc_id", "lang_id", *names, "n_chars", "log_ppl", "n_tokens", "word_log_ppl"],
                )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_id long, " + ", ".join(f"{c} long" for c in names) + ", n_chars long, log_ppl double, n_tokens long, word_log_ppl double"
    scored = written(rows.select("doc_id", "text", "lang_id").mapInArrow(score, schema), "scored")
    joined, bands = scored, {}
    for log, length in (("log_ppl", "n_chars"), ("word_log_ppl", "n_tokens")):
        root = F.sqrt(F.greatest(F.col(length), F.lit(1)).cast("double"))
        middle = scored.groupBy("lang_id").agg(F.percentile_approx(log, 0.5, 10000).alias("middle"))
        apart = scored.join(middle, "lang_id").groupBy("lang_id", "middle").agg(F.percentile_approx(F.abs(F.col(log) - F.col("middle")) * root, 0.5, 10000).alias("mad"))
        joined = joined.join(apart.withColumnsRenamed({"middle": f"{log}_middle", "mad": f"{log}_mad"}), "lang_id", "left")
        deviation = 1.4826 * F.coalesce(f"{log}_mad", F.lit(0.0)) / root
        bands[log] = F.col(f"{log}_middle") - below * deviation - LEAST, F.col(f"{log}_middle") + above * deviation + 10 * LEAST
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    (low, high), (_, word_high) = bands.values()
    inside, ordered = F.coalesce(F.col("log_ppl").between(low, high), F.lit(False)), F.coalesce(F.col("word_log_ppl") <= word_high, F.lit(False))
    return joined.select(
        "doc_id", *names, failed.alias("base_failed"), F.exp("log_ppl").alias("perplexity"), F.exp(low).alias("lower"), F.exp(high).alias("upper"),
        F.exp("word_log_ppl").alias("word_perplexity"), F.exp(word_high).alias("word_upper"), (~failed & inside & ordered).alias("kept"),
    )


def op6_quality_rules(spark, sf_dir):
    return quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
