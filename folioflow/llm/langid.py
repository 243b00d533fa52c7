"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword of +1 and -1; for each bit a binary classifier tells from the
n-grams on which side of the split a text is. The classifiers are naive Bayes over hashed
byte trigrams with add-`smooth` counts pooled over the bit's languages. Decoding weighs
each bit's logistic loss by the bit's trust, the least margin it has on the learned n-gram profiles of the
languages themselves, and picks the codeword of least loss; the softmax of the losses is the score, and a text whose two best
codewords are within `ambiguous` of one another is flagged.

Training takes a bounded sample: about `most` labelled rows of each language (by hash of the id, or of the text without one), all of a rare one. Everything
else covers whole texts of all rows. Prediction sees the text alone.

Edge cases: a null text and one without letters give `und` and score 0; with no labelled text at
all every prediction is `und`; with one language, texts with letters get it; a null lang is
never learned; repeated rows predict alike; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import read_table, slices, text_buffers

BITS = 16
MOST = 8000
SMOOTH = 0.5
AMBIGUOUS = 0.6
HELD_OUT = 2

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of each row, the rows' offsets in them, and whether a row has letters.

    ASCII letters are folded, digits, signs and white space all count as a blank; each row
    stands between blanks. Bytes of other letters are taken as they are.
    """
    n = len(offsets) - 1
    folded = np.full(len(raw) + 2 * n, 0x20, dtype=np.uint8)
    folded[np.arange(len(raw)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1] = _FOLD[raw]
    off = offsets + 2 * np.arange(n + 1)
    b = folded.astype(np.uint32)
    code = np.zeros(len(b), dtype=np.uint32)
    code[:-2] = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    use = code != 0x202020
    use[-2:] = False
    ends = off[1:]
    use[ends - 1] = False
    use[ends - 2] = False
    hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    at = np.concatenate([[0], np.cumsum(use)])
    letters = np.concatenate([[0], np.cumsum(folded != 0x20)])
    return hashed[use], at[off], (letters[off[1:]] - letters[off[:-1]]) > 0


def code_matrix(n: int, seed: int = 5) -> np.ndarray:
    """Codewords (n x bits, +1 and -1): all splits for up to six languages, else the best of some random ones."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=float).T
    width = 10 * int(np.ceil(np.log2(n)))
    rng, best, far = np.random.default_rng(seed), None, -1.0
    for _ in range(60):
        code = rng.choice((-1.0, 1.0), size=(n, width))
        apart = (width - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = SMOOTH):
        self.languages = languages
        self.code = code_matrix(len(languages))
        share = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True) if len(languages) else counts
        weights = []
        for bit in self.code.T:
            weights.append(np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)))
        self.weights = np.array(weights) if weights else np.zeros((0, counts.shape[1]))
        # how far apart a bit's two sides are, on the languages' own n-grams: its reliability
        margin = np.array([[(share[k] * w).sum() for w in self.weights] for k in range(len(languages))]) if len(weights) else np.zeros((len(languages), 0))
        self.trust = np.clip((margin * self.code).min(axis=0), 0.05, None) if len(weights) else np.zeros(0)
        if len(self.trust):
            self.trust = self.trust / self.trust.mean()

    def predict(self, hashed: np.ndarray, off: np.ndarray, lettered: np.ndarray, ambiguous: float = AMBIGUOUS):
        n, count = len(off) - 1, np.diff(off)
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        margins = np.zeros((n, len(self.weights)))
        rows = np.flatnonzero(count > 0)
        if len(rows):
            for b, w in enumerate(self.weights):
                margins[rows, b] = np.add.reduceat(w[hashed], off[rows])
        # the evidence of n-grams that overlap isn't independent: it grows with the root of their number
        scaled = margins / np.maximum(count, 1)[:, None] * np.sqrt(np.maximum(count, 1))[:, None]
        loss = np.stack([(self.trust * np.logaddexp(0, -word * scaled)).sum(axis=1) for word in self.code], axis=1)
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = 1.0 / share.sum(axis=1)
        names = [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist())]
        return names, np.where(lettered, score, 0.0), lettered & (score < ambiguous)


def train(docs: DataFrame, most: int = MOST, smooth: float = SMOOTH, bits: int = BITS) -> Model:
    """A model from about `most` rows (text, lang) of every language of `docs`, all rows of a language of fewer.

    The sample is taken by hash of doc_id; a language has the same chance of being learned at every size of the table.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    shares = labelled.groupBy("lang").agg(F.count("*").alias("__rows")).select(F.col("lang").alias("__lang"), F.least(F.lit(1.0), most / F.col("__rows")).alias("__share"))
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    place = F.shiftrightunsigned(hashed, 11) / float(1 << 53)  # fine enough for any number of rows
    sample = labelled.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(place < F.col("__share"))  # a row for each language

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                hashed, off, _ = features(*text_buffers(part.column("text")), bits)
                for k, lang in enumerate(part.column("lang").to_pylist()):
                    own = held.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                    np.add.at(own, hashed[off[k] : off[k + 1]], 1)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(held), pa.string()), "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in held.values()], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        own = sum(np.frombuffer(zlib.decompress(c), dtype=np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})

    parts = sample.select("text", "lang").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary")
    rows = sorted((r["lang"], np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)) for r in parts.collect())
    return Model([lang for lang, _ in rows], np.array([c for _, c in rows], dtype=float).reshape(len(rows), 1 << bits), smooth)


def identify(docs: DataFrame, model: Model, bits: int = BITS, *, keep_text: bool = True) -> DataFrame:
    """`docs` with lang_pred, score and ambiguous, predicted from column text alone."""
    base = docs.drop("lang_pred", "score", "ambiguous")
    names = [c for c in base.columns if keep_text or c != "text"]
    shared = base.sparkSession.sparkContext.broadcast(model)  # languages x 2^bits numbers, whatever the corpus

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, most=1 << 19):
                raw, offsets = text_buffers(part.column("text"))
                hashed, off, lettered = features(raw, offsets, bits)
                lettered = lettered.copy()
                ascii_letters = np.concatenate([[0], np.cumsum((_FOLD[raw] >= 0x61) & (_FOLD[raw] < 0x7B))])
                unsure = np.flatnonzero(lettered & (ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]))
                for k in unsure.tolist():  # no ASCII letter: other letters or only signs?
                    lettered[k] = any(c.isalpha() for c in part.column("text")[k].as_py())
                lang, score, flag = model.predict(hashed, off, lettered)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag)], names=[*names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in names)
    return base.mapInArrow(run, schema + ", lang_pred string, score double, ambiguous boolean")


def held_out(doc_id="doc_id"):
    """Whether a document isn't learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all."""
    marked = docs.withColumn("held_out", held_out())
    return identify(marked, train(marked.where("NOT held_out").select("doc_id", "text", "lang")))


def op9_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", held_out())
    model = train(marked.where("NOT held_out").select("doc_id", "text", "lang"))
    return identify(marked.select("doc_id", "text", "held_out"), model, keep_text=False)


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
