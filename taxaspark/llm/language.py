"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and n-grams of 1 to 3 characters are
hashed to `DIMS` features; a text is the L2-normalised vector of counts times inverse document
frequency, over its whole length. Document frequencies come from every row that may be learned from.
The weights are fitted by follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on
a sample of labelled rows: of each language, however rare, the `SAMPLE` distinct rows of the least hashes
of id and text that have a letter (the bound is the parameter `most`; equal rows count once). A fifth of
the sample is set aside to fit the temperature by which scores are divided before the softmax. The sample,
and so the model, follows from the rows alone, in whatever order they come.

Learning uses text and non-null labels only; prediction uses the text alone. A text that is null or
has no letter gets `und` and score 0, and so does every text if nothing can be learned. Repeated rows
are predicted alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import textnum
from .common import Scratch, bounded_batches, hash_key

DIMS = 1 << 14
GRAMS = 3
#: Bound of the labelled sample: rows of a language.
SAMPLE = 1000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
UNKNOWN = "und"
_chars: list[np.ndarray] = []


def _folds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter and else a blank; and whether it is a letter."""
    if not _chars:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _chars.extend([table, table != 32])
    return _chars[0], _chars[1]


def features(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashed n-grams of each order over all characters, where each row's characters begin, and whether a row has a letter."""
    fold, letter = _folds()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if firsts[-1] != len(codes):  # bytes that aren't UTF-8: take the rows one by one
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        firsts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    has = np.diff(np.concatenate([[0], np.cumsum(letter[codes])])[firsts]) > 0
    low = fold[codes]
    shift = np.uint32(32 - dims.bit_length() + 1)
    out, acc = [], np.zeros(len(low), np.uint32)
    for k in range(GRAMS):
        acc = acc[: len(low) - k] * np.uint32(0x01000193) + low[k:]
        out.append((((acc ^ np.uint32(k * 0x5BD1E995)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int32))
    return out, firsts, has


def _counts(grams: list[np.ndarray], firsts: np.ndarray, r: int, dims: int) -> np.ndarray:
    a, b = firsts[r], firsts[r + 1]
    return np.bincount(np.concatenate([g[a : max(a, b - k)] for k, g in enumerate(grams)]), minlength=dims)


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def document_frequencies(texts: DataFrame, dims: int = DIMS) -> tuple[np.ndarray, int]:
    """How many rows hold each feature, and the number of rows; each task sends one row per feature it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for b in batches:
            for _, _, data, offsets in textnum.slices(b.column("text")):
                grams, firsts, _ = features(data, offsets, dims)
                for r in range(len(offsets) - 1):
                    total[:dims] += _counts(grams, firsts, r, dims) > 0
                total[dims] += len(offsets) - 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "n"])

    found = np.zeros(dims + 1, np.int64)
    for r in texts.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # dims + 1 rows at most
        found[r["feature"]] = r["n"]
    return found[:dims], int(found[dims])


def sample(labelled: DataFrame, dims: int = DIMS, most: int = SAMPLE) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The languages, and for at most `most` rows of each the features with their counts and the label's number.

    The least hashes of a language are numbered within parts of the hash first, so its rows never meet in one task.
    """
    keyed = labelled.where(F.col("text").rlike(r"\p{L}")).select(hash_key(F.col("doc_id"), F.col("text"), seed=3).alias("_key"), "lang", "text")  # copies with other ids are drawn apart
    ids = keyed.select("lang", "_key").distinct().withColumn("_part", F.pmod("_key", F.lit(64)))
    for w in (W.partitionBy("lang", "_part"), W.partitionBy("lang")):
        ids = ids.withColumn("_i", F.row_number().over(w.orderBy("_key"))).where(F.col("_i") <= most).drop("_i")
    ids = Scratch(labelled.sparkSession).keep(ids.select("lang", "_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in textnum.slices(b.column("text")):
                grams, firsts, has = features(data, offsets, dims)
                rows = [_counts(grams, firsts, r, dims) if has[r] else np.zeros(0, int) for r in range(j - i)]
                at = [np.flatnonzero(c).astype("<i4") for c in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key").slice(i, j - i), b.column("lang").slice(i, j - i), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<f4").tobytes() for a, c in zip(at, rows, strict=True)], pa.binary())],
                    names=["_key", "lang", "at", "n"],
                )

    drawn = keyed.join(ids, ["lang", "_key"], "left_semi").dropDuplicates(["lang", "_key"]).select("_key", "lang", "text")
    got = drawn.mapInArrow(run, "_key bigint, lang string, at binary, n binary").collect()  # `most` rows of each language
    got = sorted((r for r in got if len(r["at"])), key=lambda r: (r["_key"], r["lang"]))
    langs = sorted({r["lang"] for r in got})
    xs = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<f4").astype(float)) for r in got]
    return langs, xs, np.array([langs.index(r["lang"]) for r in got], int)


def fit(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, classes: int, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (features + 1 x classes; the last row is the bias) and the temperature."""
    dims = len(idf)
    unit = []
    for at, n in xs:
        v = n * idf[at]
        norm = math.sqrt(v @ v) or 1.0
        unit.append((np.append(at, dims), np.append(v / norm, 1.0)))
    calibrate = np.arange(len(ys)) % 5 == 4 if len(ys) >= 50 else np.zeros(len(ys), bool)
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(11)
    learn = np.flatnonzero(~calibrate)
    for _ in range(EPOCHS):
        for i in order.permutation(learn):
            at, v = unit[i]
            w = weights(at)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[ys[i]] -= 1
            g = v[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w, _temperature(np.array([v @ w[at] for at, v in (unit[i] for i in np.flatnonzero(calibrate))]), ys[calibrate])


def _temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of least log-loss, by golden section over its logarithm."""
    if not len(ys):
        return 1.0

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        top = s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(ys)), ys]))

    a, b, g = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train(docs: DataFrame, dims: int = DIMS, most: int = SAMPLE):
    """(languages, idf-scaled weights, bias, temperature) from the rows of `docs` that may be learned from."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    langs, xs, ys = sample(labelled, dims, most)
    if not langs:
        return [], np.zeros((dims, 0)), np.zeros(0), np.zeros(dims), 1.0
    df, rows = document_frequencies(labelled, dims)
    idf = np.log((1 + rows) / (1 + df)) + 1
    w, t = fit(xs, ys, len(langs), idf)
    return langs, w[:dims], w[dims], idf, t


def predict(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score of each row; the text alone decides."""
    bounded_batches(docs.sparkSession)
    langs, w, bias, idf, t = model
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([*kept.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    weights = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(w), idf))  # DIMS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, idf = weights.value
        dims = len(idf)
        for b in batches:
            for i, j, data, offsets in textnum.slices(b.column("_text")):
                names, scores = [UNKNOWN] * (j - i), np.zeros(j - i)
                if langs:
                    grams, firsts, has = features(data, offsets, dims)
                    for r in np.flatnonzero(has):
                        n = _counts(grams, firsts, r, dims)
                        at = np.flatnonzero(n)
                        v = n[at] * idf[at]
                        s = (v @ w[at] / math.sqrt(v @ v) + bias) / t
                        p = np.exp(s - s.max())
                        k = int(p.argmax())
                        names[r], scores[r] = langs[k], p[k] / p.sum()
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in keep] + [pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """The rows of `docs`, with their columns, whose language is told with a score of `least` or more."""
    rows = docs.select("text", F.struct(*docs.columns).alias("_row"))
    found = predict(rows, train(docs), ["_row"]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = predict(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
