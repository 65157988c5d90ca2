"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole.

Sets are dealt to size bands. A band's space cuts the universe of shingle hashes into m equal
segments. Two sets of the band that reach the similarity differ in at most H shingles, so with
segment weights that add up to more than H some segment of weight v differs in fewer than v: weight 1
asks for equal subsets, weight 2 for subsets that differ by one shingle at most, found through the
subsets with one shingle left out. How many segments a band has and how many of them carry weight 2
minimises the rows to be written and the likely false matches (`plan`). A set also probes the space
of the next smaller band if a set of it can be similar enough.

A segment that is empty, or whose subset is shared by more than `LIMIT` sets, has weight 0 as long as
the rest of the set's segments outweigh H. Since all sets write all their non-empty segments, one
such set in a pair is enough for the pair to be met elsewhere. Only sets whose rest is too light
("deficient": members of large groups of near copies, or made of common passages) keep their common
segments, and a pair is met in those only if both are deficient. Such a bucket isn't expanded into
pairs: each member is measured against a pivot, in a few rounds, until links join most of it; then
members of different components meet in blocks within a task, and only pairs that can be links come out.

Every link is verified on the sets themselves, after odd sketches (parities of hashed shingles, a
lower bound of the difference) have thrown out distant pairs. Shingles and sets are identified by
64-bit hashes; two different sets of one identity are detected by a second hash, and the join then
runs again with another seed, and raises if five seeds fail. Texts equal as sets are one class throughout.

The number of links of each document is exact. Where no common bucket took part, the links found are all
there are. A component that holds members of common buckets is counted anew: its classes meet in blocks of
about `BLOCK_SHINGLES` shingles, a task multiplies the two blocks' membership matrices, and only the counts
come out. That work grows with the square of a group of near copies (not of equal texts, which are one class).

A document is a row: rows of one id with other texts are documents of their own. Null, empty and blank texts
have no shingles and link with nothing; so do rows without id, whose component is null. Repeated rows are copies
of each other. An empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textnum
from .common import Scratch, bounded_batches

N = 5
PERCENT = 80
#: More sets than this at one subset make it common.
LIMIT = 8
#: Rounds of pivots for common buckets, the members that must be left for another round, and the members of a block.
PIVOTS, PIVOT_ABOVE, BLOCK = 2, 64, 1024
#: Shingles of a block in which a component's links are counted, and columns that are multiplied at once.
BLOCK_SHINGLES, COLUMNS = 1 << 18, 4096
#: A shingle whose pairs are more than a share of 1 / DENSE of a meeting's is a column of a product.
DENSE = 64
#: Ids of needed texts are broadcast up to this many (8 bytes each); above, they are joined by shuffle.
FEW_IDS = 1_000_000
U64 = np.uint64
_SEEN = 1_000_000


def allowed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The most shingles in which sets of sizes a and b can differ: 100 (a + b - x) / 2 >= percent (a + b + x) / 2."""
    return (a + b) * (100 - percent) // (100 + percent)


@functools.lru_cache(maxsize=8)
def plan(most: int, percent: int = PERCENT) -> np.ndarray:
    """Rows (lo, hi, segments, segments of weight 2) of the bands up to a set size of `most`."""
    out, lo = [], 1
    while lo <= most:
        hi = max(lo, lo * 3 // 2 if lo >= 40 else lo * 5 // 4)
        out.append((lo, hi, *_segments(lo, hi, percent)))
        lo = hi + 1
    return np.array(out, np.int64).reshape(-1, 4)


def _segments(lo: int, hi: int, percent: int) -> tuple[int, int]:
    """Segments of a band and how many carry weight 2, at the least cost: rows of a set, likely false matches, and what deficient sets cost."""
    top = hi * 100 // percent
    asks = [(n, allowed(n, min(n * 100 // percent, top), percent) + 1) for n in {lo, hi}] + [(n, allowed(n, hi, percent) + 1) for n in {hi + 1, top} if n <= top]
    need = max(a for _, a in asks)
    if need == 1:
        return 1, 0
    best = (math.inf, need, 0)
    for m in sorted({*np.unique(np.linspace(max(1, need // 2), max(2 * need + 8, 16), 80).astype(int))}):
        for d in sorted({0, m // 4, m // 2, 3 * m // 4, m}):
            rows, light = 0.0, 0.0
            for n, ask in asks:
                none, one = (math.exp(-n / m), n / m * math.exp(-n / m)) if m > 1 else (0.0, float(n == 1))
                plain, double = 1 - none, 2 - 2 * none - one
                spread = (m - d) * max(0.0, none - (1 + n / m) * none * none) + d * max(0.0, one + 4 * (1 - none - one) - double * double)
                over = (m - d) * plain + d * double - ask + 0.5
                light = max(light, 0.5 * math.erfc(over / math.sqrt(2 * spread)) if spread > 1e-9 else float(over < 0))
                rows = m * plain + d * max(0.0, n / m - one) + m * one
            if rows + _LIGHT * light < best[0]:
                best = (rows + _LIGHT * light, m, d)
    return best[1], best[2]


#: What a set that is too light for its space costs, in rows.
_LIGHT = 5_000
_SIGNED = pa.schema([("sig", pa.int64()), ("sid", pa.int64()), ("meta", pa.int64()), ("fact", pa.binary())])
_REDUCED = "kind tinyint, a bigint, b bigint, c bigint, d bigint, sketch binary, e bigint"
_N, _SLACK, _WEIGHT, _LESS, _PROBE = 0, 32, 47, 49, 50


def _sketch(shingles: np.ndarray) -> bytes:
    bits = min(1 << 15, max(64, 1 << (4 * len(shingles) - 1).bit_length()))
    odd = np.bincount((textnum.mix(shingles, 9) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(column: pa.Array, n: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingles, counts, set id, second hash) for runs of rows."""
    for i, _, data, offsets in textnum.slices(column):
        hashed, firsts = textnum.words(data, offsets, fold=True)
        values, counts = textnum.sorted_sets(*textnum.shingles(hashed, firsts, n))
        ends = np.cumsum(counts)
        add = lambda x: np.diff(np.concatenate([[U64(0)], np.cumsum(x, dtype=U64)])[np.concatenate([[0], ends])])
        ids = textnum.mix(add(textnum.mix(values, 1 + 10 * seed)) + counts.astype(U64), 3).view(np.int64)
        yield i, values, counts, ids, add(textnum.mix(values, 2 + 10 * seed)).view(np.int64)


def _signatures(values: np.ndarray, counts: np.ndarray, ids: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signature, set id, meta) of the given sets, first in their own space and then in the next smaller one."""
    if not len(counts):
        return
    bands = plan(1 << int(counts.max()).bit_length(), percent)
    own = np.searchsorted(bands[:, 0], counts, "right") - 1
    for probe in (0, 1):
        band = own - probe
        use = band >= 0
        if probe:
            use &= counts * percent <= bands[np.maximum(band, 0), 1] * 100
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        part = values if len(rows) == len(counts) else values[np.repeat(use, counts)]
        n, band, sid = counts[rows], band[rows], ids[rows]
        hi, m, d = bands[band, 1], bands[band, 2], bands[band, 3]
        other = np.minimum(n, hi) if probe else np.minimum(n * 100 // percent, hi * 100 // percent)
        need = allowed(n, other, percent) + 1
        of = np.repeat(np.arange(len(rows)), n)
        seg = ((part >> U64(32)) * m[of].astype(U64)) >> U64(32)  # sorted within a set, as the hashes are
        seg = seg.astype(np.int64)
        new = np.ones(len(part), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(part)))
        scrambled = textnum.mix(part, 4)
        total = np.add.reduceat(scrambled, at)
        who, which = of[at], seg[at]
        double = (which < d[who]) & (size >= 2)
        weight = np.bincount(who, 1 + double, len(rows)).astype(np.int64)
        slack = weight - need
        place = lambda w, s: (band[w] * (1 << 32) + s).astype(U64) * U64(0x8EBC6AF09C88C6E3)
        meta = n | (np.clip(slack + 1, 0, 32767) << _SLACK) | (probe << _PROBE)
        yield textnum.mix(total + place(who, which)).view(np.int64), sid[who], meta[who] | ((1 + double).astype(np.int64) << _WEIGHT)
        if double.any():  # one shingle left out
            group = np.cumsum(new) - 1
            left = np.flatnonzero(double[group])
            g = group[left]
            yield textnum.mix(total[g] - scrambled[left] + place(who[g], which[g])).view(np.int64), sid[who[g]], meta[who[g]] | (1 << _WEIGHT) | (1 << _LESS)
        for r in np.flatnonzero(slack < 0):  # too light even with all segments that hold something: the empty ones count too
            gaps = np.setdiff1d(np.arange(m[r]), which[who == r])
            if len(gaps):
                yield textnum.mix(place(np.full(len(gaps), r), gaps)).view(np.int64), np.full(len(gaps), sid[r]), np.full(len(gaps), meta[r] | (1 << _WEIGHT))


def _signer(n: int, percent: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within this task write their signatures once
        for b in batches:
            docs, texts = b.column(0), b.column(2).to_numpy()
            for i, values, counts, ids, second in _sets(b.column(1), n, seed):
                facts, fresh = [], np.zeros(len(counts), bool)
                ends = np.cumsum(counts)
                for r, (sid, k) in enumerate(zip(ids.tolist(), counts.tolist(), strict=True)):
                    doc = docs[i + r].as_py()
                    sketch = b""
                    if k and sid not in seen:
                        seen.add(sid)
                        fresh[r] = True
                    if k:
                        sketch = _sketch(values[ends[r] - k : ends[r]])
                    facts.append(np.array([doc is not None, doc or 0, second[r], k, texts[i + r]], np.int64).tobytes() + sketch)
                if len(seen) > _SEEN:
                    seen.clear()
                sids = pa.array(ids)
                yield pa.RecordBatch.from_arrays([sids, sids, pa.array(np.full(len(ids), -1)), pa.array(facts, pa.binary())], schema=_SIGNED)
                for sig, sid, meta in _signatures(values[np.repeat(fresh, counts)], counts[fresh], ids[fresh], percent):
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(sid), pa.array(meta), pa.nulls(len(sig), pa.binary())], schema=_SIGNED)

    return sign


def _reducer(percent: int):
    def out(kind: int, a, b, c=None, d=None, sketch=None, e=None) -> pa.RecordBatch:
        n = len(a)
        longs = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), longs(a), longs(b), longs(c), longs(d), pa.nulls(n, pa.binary()) if sketch is None else pa.array(sketch, pa.binary()), longs(e)],
            names=["kind", "a", "b", "c", "d", "sketch", "e"],
        )

    def pairs(sid: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs within the rows of a (groups x members) table that can be similar and aren't ruled out by their roles."""
        i, j = np.triu_indices(sid.shape[1], 1)
        a, b, x, y = sid[:, i].ravel(), sid[:, j].ravel(), meta[:, i].ravel(), meta[:, j].ravel()
        n, k = x & 0xFFFFFFFF, y & 0xFFFFFFFF
        ok = (np.minimum(n, k) * 100 >= np.maximum(n, k) * percent) & (((x & y) >> _LESS) & 3 == 0)
        return np.minimum(a, b)[ok], np.maximum(a, b)[ok]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in signature order. Holds one batch and at most LIMIT + 1 sets of the open group."""
        held = [np.zeros(0, np.int64)] * 3
        common = None  # the open group, if known to be common
        for b in batches:
            rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            fact = rows[2] < 0
            if fact.any():
                at = np.flatnonzero(fact)
                blobs = b.column(3).take(pa.array(at)).to_pylist()
                head = np.frombuffer(b"".join(x[:40] for x in blobs), np.int64).reshape(-1, 5)
                yield out(0, rows[1][at], pa.array(head[:, 1], mask=head[:, 0] == 0), head[:, 3], head[:, 2], [x[40:] for x in blobs], head[:, 4])
                rows = [x[~fact] for x in rows]
            sig, sid, meta = (np.concatenate(x) for x in zip(held, rows, strict=True))
            if common is not None:
                same = sig == common
                if same.any():
                    yield out(2, sid[same], sig[same], meta[same])
                    sig, sid, meta = sig[~same], sid[~same], meta[~same]
            if not len(sig):
                held = [sig, sid, meta]
                continue
            last = sig[-1]
            yield from groups(sig[sig != last], sid[sig != last], meta[sig != last])
            open_ = sig == last
            o_sid, first = np.unique(sid[open_], return_index=True)
            held = [np.full(len(o_sid), last), o_sid, meta[open_][first]]
            common = None
            if len(o_sid) > LIMIT:
                yield out(2, o_sid, held[0], held[2])
                held, common = [np.zeros(0, np.int64)] * 3, last
        yield from groups(*held)

    def groups(sig: np.ndarray, sid: np.ndarray, meta: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(sig) < 2:
            return
        many = np.zeros(len(sig), bool)
        same = sig[1:] == sig[:-1]
        many[1:] |= same
        many[:-1] |= same
        sig, sid, meta = sig[many], sid[many], meta[many]
        order = np.lexsort((sid, sig))
        sig, sid, meta = sig[order], sid[order], meta[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        sig, sid, meta = sig[fresh], sid[fresh], meta[fresh]
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(sig)))
        found = []
        for g in range(2, LIMIT + 1):
            begin = at[size == g]
            if len(begin):
                pick = begin[:, None] + np.arange(g)
                found.append(pairs(sid[pick], meta[pick]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                ab = np.unique(np.stack([a, b]), axis=1)
                yield out(1, ab[0], ab[1])
        big = np.repeat(size > LIMIT, size)
        if big.any():
            yield out(2, sid[big], sig[big], meta[big])

    return reduce


def _far(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Adds the sketch's lower bound of the number of shingles that differ."""
    for b in rows:
        bound = []
        for x, y in zip(b.column("xs").to_pylist(), b.column("ys").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(p) > len(q):
                p = p[: len(p) // 2] ^ p[len(p) // 2 :]
            while len(q) > len(p):
                q = q[: len(q) // 2] ^ q[len(q) // 2 :]
            bound.append(int(np.bitwise_count(p ^ q).sum()))
        yield pa.RecordBatch.from_arrays([b.column(k) for k in ("a", "b", "ra", "rb", "na", "nb")] + [pa.array(bound, pa.int64())], names=["a", "b", "ra", "rb", "na", "nb", "least"])


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by meeting of blocks; a meeting is held whole (two blocks at most). Yields the pairs that sketches can't tell apart."""
    for parts in _meetings(batches):
        sid, label, n, side = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (1, 2, 3, 4))
        raw = [x for p in parts for x in p.column(5).to_pylist()]
        size = min(map(len, raw))
        rows = []
        for x in raw:
            v = np.frombuffer(x, np.uint8)
            while len(v) > size:
                v = v[: len(v) // 2] ^ v[len(v) // 2 :]
            rows.append(v)
        bits = np.stack(rows).view(np.uint64)
        first, second = (np.flatnonzero((side & 3 == k) | (side & 3 == 2)) for k in (0, 1))
        probe = side >= 4
        out = []
        for at in range(0, len(first), 256):
            i = first[at : at + 256]
            apart = np.zeros((len(i), len(second)), np.int32)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[i, w][:, None] ^ bits[second, w][None, :])
            a, b = n[i][:, None], n[second][None, :]
            ok = (apart <= allowed(a, b, percent)) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
            ok &= (label[i][:, None] != label[second][None, :]) & ~(probe[i][:, None] & probe[second][None, :])
            x, y = np.nonzero(ok)
            out.append((sid[i[x]], sid[second[y]]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        if len(a):
            ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])


def _verifier(n: int, seed: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for text in ("ta", "tb"):
                distinct = b.column(text).dictionary_encode()
                sets, ids = [], []
                for _, values, counts, sid, _ in _sets(distinct.dictionary, n, seed):
                    sets += np.split(values, np.cumsum(counts)[:-1])
                    ids += sid.tolist()
                at = distinct.indices.to_pylist()
                sides.append([(sets[k], ids[k]) if k is not None else (np.zeros(0, U64), 0) for k in at])
            both = []
            for (x, xi), (y, yi), a, c in zip(*sides, b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                # another row of the same id has another text: it isn't the one meant
                both.append(len(np.intersect1d(x, y, assume_unique=True)) if (xi, yi) == (a, c) else -1)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("a", "b", "ra", "rb", "na", "nb")] + [pa.array(both, pa.int64())], names=["a", "b", "ra", "rb", "na", "nb", "common"])

    return verify


def _set_rows(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, values, counts, ids, _ in _sets(b.column("text"), n, seed):
            sets = [x.tobytes() for x in np.split(values, np.cumsum(counts)[:-1])] if len(counts) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sets, pa.binary())], names=["sid", "shingles"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows come sorted by their first column: all rows of each of its values (two blocks at most)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        meet = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(meet[1:] != meet[:-1]) + 1).tolist(), len(meet)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                if held and meet[x] != last:
                    yield held
                    held = []
                held.append(b.slice(x, y - x))
                last = meet[x]
    if held:
        yield held


def _pairs(sides: list[tuple[np.ndarray, np.ndarray]], shape: tuple[int, int], most: int = 1 << 22) -> np.ndarray:
    """How many columns each pair of rows shares, from the (columns, rows) of both sides, sorted by column."""
    (ca, ra), (cb, rb) = sides
    low, high = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    out, ends = np.zeros(shape[0] * shape[1]), np.cumsum(high - low)
    x = 0
    while x < len(ca):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + most, "right")))
        n = (high - low)[x:y]
        begin = np.repeat(low[x:y] - (np.cumsum(n) - n), n)
        out += np.bincount(np.repeat(ra[x:y], n) * shape[1] + rb[begin + np.arange(len(begin))], minlength=len(out))
        x = y
    return out.reshape(shape)


def _count_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each class of a meeting, the documents across that it links with; by the exact sizes of all intersections."""
    for parts in _meetings(batches):
        sid, copies, side = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (1, 2, 3))
        sets = [np.frombuffer(x, U64) for p in parts for x in p.column(4).to_pylist()]
        size = np.array([len(x) for x in sets])
        # shingles of a single set are in no intersection
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = held[column] > 1
        column, row = (np.cumsum(held > 1) - 1)[column[shared]], row[shared]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        common = np.zeros((len(first), len(second)))
        if len(column):
            place = np.full((2, len(sets)), -1)
            place[0, first], place[1, second] = np.arange(len(first)), np.arange(len(second))
            at = place[:, row]
            held = np.stack([np.bincount(column, x >= 0, int(column[-1]) + 1) for x in at])
            # a shingle that few hold is added pair by pair, one that many hold as a column of a product
            dense = (held[0] * held[1] * DENSE > common.size)[column]
            common += _pairs([(column[(x >= 0) & ~dense], x[(x >= 0) & ~dense]) for x in at], common.shape)
            _, compact = np.unique(column[dense], return_inverse=True)
            for c in range(0, int(compact.max(initial=-1)) + 1, COLUMNS):
                x, y = np.searchsorted(compact, [c, c + COLUMNS])
                sides = []
                for k, count in enumerate(common.shape):
                    rows = at[k][dense][x:y]
                    matrix = np.zeros((count, int(compact[y - 1]) - c + 1), "f4")
                    matrix[rows[rows >= 0], compact[x:y][rows >= 0] - c] = 1
                    sides.append(matrix)
                common += sides[0] @ sides[1].T
        link = common * 100 >= (size[first][:, None] + size[second][None, :] - common) * percent
        link &= first[:, None] != second[None, :]
        ids, degree = sid[first], link @ copies[second]
        if (side != 2).any():
            ids, degree = np.concatenate([ids, sid[second]]), np.concatenate([degree, link.T @ copies[first]])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degree.astype(np.int64))], names=["sid", "degree"])


_MEASURED = "a bigint, b bigint, ra bigint, rb bigint, na bigint, nb bigint"


class NgramJoin:
    """The join over one table. `docs` has `doc_id` and `text`."""

    def __init__(self, docs: DataFrame, n: int = N, percent: int = PERCENT):
        self.spark = docs.sparkSession
        self.docs, self.n, self.percent = docs.select("doc_id", "text"), n, percent
        self.scratch = Scratch(self.spark)
        bounded_batches(self.spark)
        for self.seed in range(5):
            self._index()
            if not self.reps.where("bad").limit(1).count():
                break
        else:
            raise RuntimeError("different sets of one identity under each of five seeds")
        self.labels, self.bucket = None, None

    def _index(self) -> None:
        signed = self.docs.withColumn("_text", F.xxhash64("text")).mapInArrow(_signer(self.n, self.percent, self.seed), "sig bigint, sid bigint, meta bigint, fact binary")
        reduced = signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_reducer(self.percent), _REDUCED)
        self.reduced = self.scratch.keep(reduced)
        self.facts = self.reduced.where("kind = 0").select(F.col("a").alias("sid"), F.col("b").alias("doc_id"), F.col("c").alias("n"), F.col("d").alias("second"), "sketch", F.col("e").alias("text_hash"))
        reps = self.facts.where("n > 0").groupBy("sid").agg(
            F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.count("doc_id").alias("copies"), (F.min("second") != F.max("second")).alias("bad")
        )
        self.reps = self.scratch.keep(reps)

    def _measured(self, pairs: DataFrame) -> DataFrame:
        """From (a, b) set ids: rep ids, sizes and the sketches' lower bound of the difference."""
        side = lambda x: self.reps.where("rep is not null").select(F.col("sid").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias("xs" if x == "a" else "ys"))
        percent = self.percent
        return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(lambda rows: _far(rows, percent), f"{_MEASURED}, least bigint")

    def _verified(self, near: DataFrame) -> DataFrame:
        """Adds the exact size of the intersection."""
        ids = near.select(F.col("ra").alias("doc_id")).union(near.select(F.col("rb").alias("doc_id"))).distinct()
        ids = self.scratch.keep(ids)
        small = ids.count() <= FEW_IDS
        texts = self.docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
        side = lambda x: texts.select(F.col("doc_id").alias(f"r{x}"), F.col("text").alias(f"t{x}"))
        joined = near.select("a", "b", "ra", "rb", "na", "nb").join(side("b"), "rb").join(side("a"), "ra")
        return joined.mapInArrow(_verifier(self.n, self.seed), f"{_MEASURED}, common bigint").where("common >= 0").distinct()

    def _is_link(self, common: str = "common"):
        return F.col(common) * 100 >= (F.col("na") + F.col("nb") - F.col(common)) * self.percent

    def _new_links(self, measured: DataFrame) -> DataFrame:
        near = measured.where(F.col("least") <= F.floor((F.col("na") + F.col("nb")) * (100 - self.percent) / (100 + self.percent)))
        return self._verified(near).where(self._is_link()).select("a", "b", "ra", "rb", "common", "na", "nb")

    def links(self) -> DataFrame:
        """Links between classes of equal sets: a, b (set ids), ra, rb (their smallest documents), common, na, nb.

        All links between classes, but for those within a large group of near copies that other links connect already.
        """
        keep = self.scratch.keep
        pairs = self.reduced.where("kind = 1").select("a", "b").distinct()
        found = keep(self._new_links(keep(self._measured(pairs))))
        bit = lambda at, width: F.shiftright("c", at).bitwiseAND((1 << width) - 1)
        hot = self.reduced.where("kind = 2").select(
            F.col("b").alias("sig"), F.col("a").alias("sid"), bit(_SLACK, 15).alias("slack"), bit(_WEIGHT, 2).alias("weight"), bit(_PROBE, 1).alias("probe")
        ).distinct()
        lost = F.sum("weight").over(W.partitionBy("sid", "probe"))
        bucket = keep(hot.withColumn("lost", lost).where("lost > slack - 1").select("sig", "sid", "probe"))
        if bucket.limit(1).count() == 0:
            return found
        self.bucket = bucket
        labels, pivots = None, None
        for _ in range(PIVOTS):
            rows = self._labelled(bucket, labels)
            if pivots is not None:  # a component that holds an earlier pivot of the bucket is settled
                settled = self._labelled(pivots.select("sig", F.col("pivot").alias("sid")), labels).select("sig", "label").distinct()
                rows = rows.join(settled, ["sig", "label"], "left_anti")
            per = rows.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("probe") == 0, F.col("sid"))).alias("pivot"))
            per = per.groupBy("sig").agg(F.sum("size").alias("left"), F.max_by("pivot", F.struct(F.col("pivot").isNotNull(), "size", "pivot")).alias("pivot"))
            new = keep(per.where(F.col("pivot").isNotNull() & (F.col("left") > (1 if pivots is None else PIVOT_ABOVE))).select("sig", "pivot"))
            if pivots is not None and new.limit(1).count() == 0:
                break
            star = rows.join(new, "sig").where("sid <> pivot").select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()
            found = keep(found.union(self._new_links(keep(self._measured(star)))).distinct())
            labels = self.components(found)
            pivots = new if pivots is None else keep(pivots.union(new))
        across = keep(self._across(self._labelled(bucket, labels)))
        if across.limit(1).count():
            found = keep(found.union(self._new_links(keep(self._measured(across)))).distinct())
        return found

    def _across(self, rows: DataFrame) -> DataFrame:
        """(a, b) of buckets that hold several components: pairs of different ones whose sketches leave a link possible.

        Buckets are cut into blocks, and members meet block by block within a task; only possible links come out.
        """
        per = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("probe") == 0).alias("held"), F.count(F.lit(1)).alias("members")).where("lo <> hi and held")
        blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
        rows = rows.join(per.select("sig", blocks.alias("blocks")), "sig")
        mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.join(self.reps.select("sid", "n", "sketch"), "sid")
        meet = F.xxhash64("sig", F.least("mine", "other"), F.greatest("mine", "other"))
        left = F.when(F.col("mine") < F.col("other"), 0).when(F.col("mine") > F.col("other"), 1).otherwise(2)
        side = (left + F.col("probe").cast("int") * 4).cast("int")
        rows = rows.select(meet.alias("meet"), "sid", F.xxhash64("label").alias("label"), "n", side.alias("side"), "sketch")
        percent = self.percent
        return rows.repartition("meet").sortWithinPartitions("meet").mapInArrow(lambda b: _possible(b, percent), "a bigint, b bigint").distinct()

    @staticmethod
    def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("sid"))
        return rows.join(labels.select("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    def components(self, links: DataFrame) -> DataFrame:
        """(sid, label): for each class in a link, the least class of its component, by large-star and small-star rounds."""
        keep, drop = self.scratch.keep, self.scratch.drop
        edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        before = None
        while True:
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before or state[0] == 0:
                break
            before, last = state, edges
            both = edges.union(edges.select("v", "u"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = edges.groupBy("u").agg(F.min("v").alias("m"))
            edges = keep(edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
            drop(last)
        return keep(edges.union(edges.select(F.col("v").alias("u"), "v")).distinct().toDF("sid", "label"))

    def _degrees(self, links: DataFrame, labels: DataFrame) -> DataFrame:
        """(sid, degree): for each class in a link, the documents of the other classes that it links with."""
        copies = self.reps.select("sid", "copies")
        both = links.select(F.col("a").alias("sid"), F.col("b").alias("_to")).union(links.select("b", "a"))
        plain = both.join(copies.toDF("_to", "copies"), "_to").groupBy("sid").agg(F.sum("copies").alias("degree"))
        if self.bucket is None:
            return plain
        hot = self.scratch.keep(labels.join(self.bucket.select("sid").distinct(), "sid", "left_semi").select("label").distinct())
        members = labels.join(hot, "label", "left_semi").join(self.reps.where("rep is not null").select("sid", "rep", "n", "copies"), "sid")
        plain = plain.join(members.select("sid"), "sid", "left_anti")
        blocks = members.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
        put = members.join(blocks, "label").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        ids = self.scratch.keep(members.select(F.col("rep").alias("doc_id")).distinct())
        texts = self.docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_semi").select("text")
        n, seed, percent = self.n, self.seed, self.percent
        sets = texts.mapInArrow(lambda rows: _set_rows(rows, n, seed), "sid bigint, shingles binary").groupBy("sid").agg(F.first("shingles").alias("shingles"))
        met = put.join(sets, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("mine") < F.col("other"), 0).when(F.col("mine") > F.col("other"), 1).otherwise(2)
        meet = F.xxhash64("label", F.least("mine", "other"), F.greatest("mine", "other"))
        met = met.select(meet.alias("meet"), "sid", "copies", side.alias("side"), "shingles").repartition("meet").sortWithinPartitions("meet")
        counted = met.mapInArrow(lambda rows: _count_links(rows, percent), "sid bigint, degree bigint")
        return plain.unionByName(counted.groupBy("sid").agg(F.sum("degree").alias("degree")))

    def _found(self) -> tuple[DataFrame, DataFrame]:
        if self.labels is None:
            self.found = self.links()
            self.labels = self.components(self.found)
        return self.found, self.labels

    def classes(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id (its own id if nothing links), n_copies (documents with the same set), n_links (documents that it links with)."""
        found, labels = self._found()
        per = self._labelled(self.reps.select("sid", "rep", "copies"), labels)
        least = per.groupBy("label").agg(F.min("rep").alias("component_id"))
        degree = self._degrees(found, labels)
        per = per.join(least, "label").join(degree, "sid", "left").select("sid", "component_id", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
        zero = F.lit(0).cast("bigint")
        alone = self.facts.where("n = 0").select("doc_id", zero.alias("n_shingles"), F.col("doc_id").alias("component_id"), zero.alias("n_copies"), zero.alias("n_links"))
        own = lambda c, other: F.when(F.col("doc_id").isNotNull(), F.col(c)).otherwise(other).alias(c)
        linked = self.facts.where("n > 0").join(per, "sid").select("doc_id", F.col("n").alias("n_shingles"), own("component_id", F.lit(None)), own("n_copies", zero), own("n_links", zero))
        return linked.unionByName(alone)

    def representatives(self, docs: DataFrame) -> DataFrame:
        """One row of `docs` of each component: that of the smallest id, and of its texts there the one of the least hash.

        Of rows that are equal in id and text the least by a hash of all columns stays. Rows without id or without words stay all.
        """
        _, labels = self._found()
        named = self._labelled(self.facts.where("n > 0 and doc_id is not null").select("sid", "doc_id", "text_hash"), labels)
        kept = named.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")).distinct()
        free = self.facts.where("n = 0 and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        again = self.facts.where("n > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg((F.count(F.lit(1)) > 1).alias("_again"))
        named = kept.join(again, ["_id", "_hash"]).unionByName(free.withColumn("_again", F.lit(False)))
        rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
        met = rows.where("_id is not null").join(named, ["_id", "_hash"])
        # only rows that come again are grouped
        once = met.where("_again").groupBy("_id", "_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        out = met.where("not _again").select("_row").unionByName(once.select("_row")).unionByName(rows.where("_id is null").select("_row"))
        return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    return NgramJoin(docs, n, percent).classes()
