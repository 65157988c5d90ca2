"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Every document is tokenised once, whole; a document longer than a sequence is cut, its first piece
taking what full pieces leave over. The plan is made from counts alone: there are at most as many
lengths as a sequence has tokens, so best-fit in order of length works on groups of equal bins and the
driver holds a few thousand runs however many documents there are. Pieces then take the planned
slots by their rank within their length, which is found by distributed prefix sums.

Null and empty texts are one end token. Repeated rows are packed each. An empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, copy_numbers, hash_key, prefix_sums

TOKENS = 1024
END = 2
_encoders: dict = {}


def encoder(name: str = "byte_bpe_50k"):
    """text -> ids. The rank file's library gives the ids of the tokenizers file several times as fast; texts that
    hold an added token's own string are left to the tokenizers file."""
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        added = [t.content for t in full.get_added_tokens_decoder().values()]

        def encode(text: str) -> list[int]:
            if any(a in text for a in added):
                return full.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[name] = encode
    return _encoders[name]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % most or most
    return [(0, min(n, first))] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, tokens: int = TOKENS, end: int = END, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for b in batches:
            who, out = [], []
            for i, text in enumerate(b.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), tokens)):
                    who.append(i)
                    out.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            ids = b.column("doc_id").take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(counts: dict[int, int], tokens: int = TOKENS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, how many in each bin)]) from the number of pieces of each length, longest first.

    A piece goes to the bin with the least room that holds it; that bin then stays the tightest while
    it holds another, so bins of one room are filled together and only the last few differ.
    """
    open_: dict[int, list[tuple[int, tuple]]] = {}
    put = lambda room, bins, held: open_.setdefault(room, []).append((bins, held)) if bins else None
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            fit = room // length
            groups = open_.pop(room)
            for at, (bins, held) in enumerate(groups):
                full = min(bins, left // fit)
                put(room - fit * length, full, (*held, (length, fit)))
                left -= full * fit
                rest = bins - full
                if rest and left:
                    put(room - left * length, 1, (*held, (length, left)))
                    rest, left = rest - 1, 0
                put(room, rest, held)
                if not left:
                    for other in groups[at + 1 :]:
                        put(room, *other)
                    break
            if not left:
                break
        fit = tokens // length
        put(tokens - fit * length, left // fit, ((length, fit),))
        if left % fit:
            put(tokens - left % fit * length, 1, ((length, left % fit),))
    return [(bins, list(held)) for groups in open_.values() for bins, held in groups]


def runs(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in each bin, first sequence, offset), by rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for bins, held in plan:
        offset = 0
        for length, fit in held:
            out.setdefault(length, []).append((ranks.get(length, 0), fit, sequence, offset))
            ranks[length] = ranks.get(length, 0) + bins * fit
            offset += length * fit
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokens: int = TOKENS, end: int = END, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_ = Scratch(docs.sparkSession).keep(pieces(docs, tokens, end, name).withColumn("_rid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    planned = runs(best_fit(counts, tokens))
    same = ["doc_id", "start", "ids_crc32"]
    keyed = copy_numbers(cut_, ["length", *same], "_rid", "_copy").withColumn("_key", hash_key(*same, "_copy")).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(keyed, ["length"], ["_key", *same, "_copy"], "_one", "_rank")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                table = planned[int(n)]
                run = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                inner = rank[at] - run[:, 0]
                seq[at] = run[:, 2] + inner // run[:, 1]
                off[at] = run[:, 3] + inner % run[:, 1] * n
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.select(*names, "_rank").mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
