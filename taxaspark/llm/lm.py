"""Masked pseudo-likelihood: a small network guesses every word from the words on both sides.

Vocabulary: every word of the corpus. The network has `CLASSES` x `MEMBERS` entries: the `NAMED` most
frequent words (counted over all texts), dealt to the classes by rank, and buckets for the rest by hash.
A word's probability is that of its class, times that of its entry within the class, both given by the
context. A word of a bucket takes the entry's probability times its share of the bucket's count, so each
word has a probability of its own and all words' add up to one. Counts of the `SENT` most frequent words
are sent to the tasks; all rarer words meet their counts in a join.

The network adds one embedding per place of a window of `SIDE` words on either side and takes tanh. Texts
are read twice, to count and to encode; training and scoring read the written entry numbers. Every row is
trained on: rows are dealt by a hash of all their columns to shards of about `SHARD_WORDS` words, so copies of
a text with other ids are dealt apart. In each of `ROUNDS` rounds a third of the shards start from the same
weights, each is trained with numpy in the order of the hash, and the weights are averaged by words, in the
order of the shards. So the weights follow from the table alone, however its rows lie in files and tasks;
rows that are equal in all columns are trained once. Scores are sums of 32-bit logarithms: they agree to about
five digits between partitionings.

A document's score is the sum of the log-probabilities of all its words, each predicted from its neighbours in
the whole text. Null, empty and blank texts have no words and score 0. Repeated rows score alike. An empty
table gives an empty result; columns other than those kept and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, bounded_batches

CLASSES, MEMBERS = 32, 128
BUCKETS = 512
ENTRIES = CLASSES * MEMBERS
NAMED = ENTRIES - BUCKETS
EDGE = ENTRIES  # beyond either end of the text
SENT = 1 << 16
SIDE, HIDDEN = 2, 16
ROUNDS = 3
SHARD_WORDS = 1_000_000
BATCH, RATE = 3072, 0.3
#: Groups in which shards' weights are added up, and what a worker collects before it sends word counts.
GROUPS, HELD = 8, 1 << 20
#: Tasks of a training round at most.
TASKS = 20_000
_ABSENT = -30.0
_SHIFTS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


# --- vocabulary ------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, n) over all texts; tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([h for h, _ in held] or [np.zeros(0, np.uint64)]), return_inverse=True)
            n = np.concatenate([n for _, n in held] or [np.zeros(0)])
            return words, np.bincount(at, n, len(words)).astype(np.int64)

        out = lambda words, n: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])
        for b in batches:
            for _, _, data, offsets in textnum.slices(b.column("text")):
                held.append(np.unique(textnum.words(data, offsets, fold=True)[0], return_counts=True))
                if sum(len(h) for h, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield out(*held.pop())
        yield out(*merged())

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, the most frequent first."""
    top = counts.orderBy(F.desc("n"), "word").limit(most).toArrow()
    return top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()


def bucket_of(hashed: np.ndarray) -> np.ndarray:
    return ((hashed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def named_entry(rank: np.ndarray) -> np.ndarray:
    """Entries are class x MEMBERS + member; ranks go round the classes, and buckets lie behind them."""
    return rank % CLASSES * MEMBERS + rank // CLASSES


def bucket_entry(bucket: np.ndarray) -> np.ndarray:
    return bucket % CLASSES * MEMBERS + NAMED // CLASSES + bucket // CLASSES


class Vocabulary:
    """Sent words (the most frequent first) with their counts, and the count of each bucket over the whole corpus."""

    def __init__(self, words: np.ndarray, n: np.ndarray, buckets: np.ndarray):
        self.order = np.argsort(words)
        self.sorted, self.logs = words[self.order], np.log(n[self.order])
        rank = np.arange(min(len(words), NAMED))
        self.counts = np.zeros(ENTRIES, np.int64)
        self.counts[named_entry(rank)] = n[: len(rank)]
        self.counts[bucket_entry(np.arange(BUCKETS))] = buckets
        self.totals = np.log(np.maximum(self.counts, 1))

    def __call__(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries; log of a word's share of its entry, for words that weren't sent without their own count; which those are."""
        at = np.minimum(np.searchsorted(self.sorted, hashed), max(len(self.sorted) - 1, 0))
        sent = self.sorted[at] == hashed if len(self.sorted) else np.zeros(len(hashed), bool)
        rank = np.where(sent, self.order[at], NAMED) if len(self.sorted) else np.full(len(hashed), NAMED)
        named = rank < NAMED
        entry = np.where(named, named_entry(np.minimum(rank, NAMED - 1)), bucket_entry(bucket_of(hashed)))
        share = np.where(named, 0.0, -self.totals[entry])
        more = sent & ~named
        share[more] += self.logs[at[more]]
        return entry, share, ~sent


def vocabulary(counts: DataFrame, sent: int = SENT) -> Vocabulary:
    words, n = most_frequent(counts, max(sent, NAMED))
    bucket = F.pmod(F.shiftrightunsigned("word", 40), F.lit(BUCKETS))
    buckets = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        buckets[r["bucket"]] = r["n"]
    np.subtract.at(buckets, bucket_of(words[:NAMED]), n[:NAMED])
    return Vocabulary(words, n, buckets)


# --- network ---------------------------------------------------------------------------------

Weights = dict[str, np.ndarray]
_SHAPES = {"b": (HIDDEN,), "d": (CLASSES,), "e": (2 * SIDE, ENTRIES + 1, HIDDEN), "m": (CLASSES, MEMBERS), "u": (HIDDEN, CLASSES), "v": (CLASSES, HIDDEN, MEMBERS)}


def start(counts: np.ndarray) -> Weights:
    """Small random weights; without a context, classes and members have the corpus' own frequencies."""
    r = np.random.default_rng(7)
    w = {k: (r.normal(0, 0.1, s) if k in "euv" else np.zeros(s)).astype("f4") for k, s in _SHAPES.items()}
    c = counts.reshape(CLASSES, MEMBERS)
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1)), _ABSENT)
    w["m"] = (log(c) - np.log(np.maximum(c.sum(1, keepdims=True), 1))).clip(_ABSENT).astype("f4")
    w["d"] = (log(c.sum(1)) - np.log(max(c.sum(), 1))).clip(_ABSENT).astype("f4")
    return w


def pack(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpack(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k in sorted(_SHAPES):
        n = int(np.prod(_SHAPES[k]))
        out[k] = flat[at : at + n].reshape(_SHAPES[k]).astype("f4")
        at += n
    return out


def padded(ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' entries with `SIDE` edges before, between and behind them, and where each word now is."""
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.arange(len(ids)) + SIDE * (row + 1)
    out = np.full(len(ids) + SIDE * len(firsts), EDGE, np.int32)
    out[at] = ids
    return out, at


def hidden(w: Weights, around: np.ndarray) -> np.ndarray:
    h = np.take(w["e"][0], around[:, 0], axis=0)
    h += w["b"]
    for k in range(1, around.shape[1]):
        h += np.take(w["e"][k], around[:, k], axis=0)
    return np.tanh(h, out=h)


def _exp(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp, in place, and its sum over each row; held below the end of 32-bit numbers."""
    np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    return s, s @ np.ones(s.shape[1], "f4")


def _own(s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log-probability of each row's own column."""
    log = s[np.arange(len(s)), own]
    np.minimum(log, 60, out=log)
    return log - np.log(_exp(s)[1])


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts words of one class together, and (class, from, to) in it."""
    order = np.argsort(classes.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()
    return order, [(c, a, z) for c, (a, z) in enumerate(zip([0, *ends], ends, strict=False)) if z > a]


def log_probabilities(w: Weights, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    h = hidden(w, around)
    classes, members = np.divmod(ids, MEMBERS)
    out = _own(h @ w["u"] + w["d"], classes).astype(float)
    order, parts = _by_class(classes)
    h, members = h[order], members[order]
    inner = np.empty(len(ids))
    for c, a, z in parts:
        inner[a:z] = _own(h[a:z] @ w["v"][c] + w["m"][c], members[a:z])
    out[order] += inner
    return out


def gradients(w: Weights, ids: np.ndarray, around: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Of the mean log-loss: those of all weights but the embeddings, and of the hidden sums."""
    n = len(ids)
    h = hidden(w, around)
    classes, members = np.divmod(ids, MEMBERS)
    order, parts = _by_class(classes)
    h, classes, members = np.take(h, order, axis=0), classes[order], members[order]
    places = np.arange(n)
    p, total = _exp(h @ w["u"] + w["d"])
    p *= (1 / total)[:, None]
    p[places, classes] -= 1
    back = p @ w["u"].T
    out = {"v": np.zeros(_SHAPES["v"], "f4"), "m": np.zeros(_SHAPES["m"], "f4"), "u": h.T @ p, "d": p.sum(0)}
    for c, a, z in parts:
        hc, v = h[a:z], w["v"][c]
        q, total = _exp(hc @ v + w["m"][c])
        q *= (1 / total)[:, None]
        q[places[: z - a], members[a:z]] -= 1
        back[a:z] += q @ v.T
        np.matmul(hc.T, q, out=out["v"][c])
        np.add.reduce(q, 0, out=out["m"][c])
    back *= (1 - h * h) / n
    for g in out.values():
        g /= n
    out["b"] = back.sum(0)
    sums = np.empty_like(back)
    sums[order] = back
    return out, sums


def step(w: Weights, g2: Weights, ids: np.ndarray, around: np.ndarray) -> None:
    """One step down the mean log-loss of a batch, scaled per weight by its past gradients."""
    dense, back = gradients(w, ids, around)
    for k, g in dense.items():
        past = g2[k]
        past += g * g
        g *= RATE
        g /= np.sqrt(past) + 1e-4
        w[k] -= g
    # embeddings: only rows that the batch holds have a gradient
    for k in range(around.shape[1]):
        at = around[:, k].astype(np.uint16)
        order = np.argsort(at, kind="stable")
        held = at[order]
        firsts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        g, rows = np.add.reduceat(np.take(back, order, axis=0), firsts, axis=0), held[firsts]
        past = np.take(g2["e"][k], rows, axis=0) + g * g
        g2["e"][k][rows] = past
        g *= RATE
        g /= np.sqrt(past) + 1e-4
        w["e"][k][rows] -= g


def fit_shard(w: Weights, ids: np.ndarray, firsts: np.ndarray) -> None:
    """Trains the weights on the shard's words, in an order that follows from their number."""
    around, at = padded(ids, firsts)
    g2 = {k: np.full(v.shape, 1e-6, "f4") for k, v in w.items()}
    mixed = np.random.default_rng(len(ids)).permutation(len(ids))
    for a in range(0, len(ids), BATCH):
        pick = mixed[a : a + BATCH]
        step(w, g2, ids[pick], around[at[pick][:, None] + _SHIFTS])


# --- training and scoring --------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """Rows come sorted by `column`: all rows of each of its values."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        key = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                if held and key[x] != last:
                    yield held
                    held = []
                held.append(b.slice(x, y - x))
                last = key[x]
    if held:
        yield held


def train(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> Weights:
    """`encoded` has _key (a hash of the row), _fresh (not an equal row seen in its task) and _ids (entries as 16-bit numbers)."""
    spark = encoded.sparkSession
    flat = pack(start(counts))
    shards = rounds * max(1, -(-int(counts.sum()) // (rounds * shard_words)))
    rows = encoded.where("_fresh and length(_ids) > 0").select("_key", "_ids", F.pmod("_key", F.lit(shards)).alias("_shard"))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(flat)  # one and a half MB, whatever the corpus

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for parts in _runs(batches, "_shard"):
                keys = np.concatenate([p.column("_key").to_numpy() for p in parts])
                texts = [x for p in parts for x in p.column("_ids").to_pylist()]
                fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                texts = [texts[i] for i in fresh]
                ids = np.frombuffer(b"".join(texts), "<u2").astype(np.int64)
                w = unpack(sent.value)
                fit_shard(w, ids, np.cumsum([0, *(len(x) // 2 for x in texts)]))
                yield pa.RecordBatch.from_arrays([parts[0].column("_shard").slice(0, 1), pa.array([pack(w).tobytes()], pa.binary()), pa.array([len(ids)])], names=["shard", "w", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, of = None, 0, None
            out = lambda: pa.RecordBatch.from_arrays([pa.array([of]), pa.array([total.tobytes()], pa.binary()), pa.array([n])], names=["g", "w", "n"])
            for b in batches:
                for g, x, m in zip(*(b.column(c).to_pylist() for c in ("g", "w", "n")), strict=True):
                    if g != of and total is not None:
                        yield out()
                        total, n = None, 0
                    x = np.frombuffer(x, "f4").astype(float) * m
                    total, n, of = (x if total is None else total + x), n + m, g
            if total is not None:
                yield out()

        # a number of tasks by the shards, which cost time and not bytes: small tasks aren't put together again
        dealt = rows.where(F.col("_shard") % rounds == k).repartition(min(shards // rounds, TASKS), "_shard").sortWithinPartitions("_shard", "_key")
        trained = dealt.mapInArrow(learn, "shard bigint, w binary, n bigint").withColumn("g", F.pmod(F.floor(F.col("shard") / rounds), F.lit(GROUPS)))
        sums = trained.repartition(GROUPS, "g").sortWithinPartitions("g", "shard").mapInArrow(add, "g bigint, w binary, n bigint").collect()  # GROUPS rows at most
        n = sum(r["n"] for r in sums)
        if n:
            flat = (sum(np.frombuffer(r["w"]) for r in sorted(sums, key=lambda r: r["g"])) / n).astype("f4")
    return unpack(flat)


def encode(docs: DataFrame, keep: list[str], words: Vocabulary) -> DataFrame:
    """The columns `keep`, _key, _fresh, _n (words), _share (sum of logs), _rare (hashes of words that weren't sent) and _ids."""
    kept = docs.select(*keep, F.xxhash64(*keep, "text").alias("_key"), F.col("text").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = sent.value, set()  # equal rows of one task are trained once
        for b in batches:
            for i, j, data, offsets in textnum.slices(b.column("_text")):
                hashed, firsts = textnum.words(data, offsets, fold=True)
                ids, share, rare = words(hashed)
                sums = np.concatenate([[0.0], np.cumsum(share)])[firsts]
                ends = np.concatenate([[0], np.cumsum(rare)])[firsts]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashed[rare].view(np.int64)))
                raw = ids.astype("<u2").tobytes()
                blobs = pa.array([raw[2 * x : 2 * y] for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)], pa.binary())
                keys = b.column("_key").slice(i, j - i)
                fresh = [k not in seen and not seen.add(k) for k in keys.to_pylist()]
                if len(seen) > HELD:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(i, j - i) for c in keep], keys, pa.array(fresh), pa.array(np.diff(firsts)), pa.array(np.diff(sums)), lists, blobs],
                    names=[*keep, "_key", "_fresh", "_n", "_share", "_rare", "_ids"],
                )

    return kept.mapInArrow(run, ", ".join([*fields, "_fresh boolean", "_n bigint", "_share double", "_rare array<bigint>", "_ids binary"]))


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns `keep`, n_words, score (summed log-probability) and mean_score (per word)."""
    spark, scratch, keep = docs.sparkSession, Scratch(docs.sparkSession), list(keep)
    bounded_batches(spark)
    counts = scratch.keep(word_counts(docs))
    words = vocabulary(counts)
    encoded = scratch.keep(encode(docs, keep, words).withColumn("_id", F.monotonically_increasing_id()))
    sent = spark.sparkContext.broadcast(pack(train(encoded, words.counts, shard_words=shard_words)))
    kept = encoded.select(*keep, "_id", "_n", "_share", "_ids")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
        w = unpack(sent.value)
        for b in batches:
            blobs = b.column("_ids").to_pylist()
            ids = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
            firsts = np.cumsum([0, *(len(x) // 2 for x in blobs)])
            around, at = padded(ids, firsts)
            logs = np.zeros(len(ids) + 1)
            for a in range(0, len(ids), rows):
                logs[a + 1 : a + 1 + rows] = log_probabilities(w, ids[a : a + rows], around[at[a : a + rows][:, None] + _SHIFTS])
            total = np.diff(np.cumsum(logs)[firsts]) + b.column("_share").to_numpy()
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*keep, "_id", "_n"]], pa.array(total)], names=[*keep, "_id", "_n", "_score"])

    found = kept.mapInArrow(run, ", ".join([*fields, "_score double"]))
    # the rare words' own counts; that of a word that stands once adds log 1
    rare = encoded.select("_id", F.explode("_rare").alias("word"))
    own = rare.join(counts.where("n > 1"), "word").groupBy("_id").agg(F.sum(F.log("n").cast("decimal(18,12)")).cast("double").alias("_own"))
    total = F.col("_score") + F.coalesce("_own", F.lit(0.0))
    out = found.join(own, "_id", "left")
    return out.select(*keep, F.col("_n").alias("n_words"), total.alias("score"), (total / F.greatest("_n", F.lit(1))).alias("mean_score"))
