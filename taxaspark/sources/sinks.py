"""Writers. Each writes a directory of parts, one per task; `single` asks for one part, for small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The codec's names of the levels 1 to 9.
_LEVELS = ("BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def gzip_options(level: int | None) -> dict[str, str]:
    """gzip at a level of 1 to 12. The codec's levels end at 9, its strongest, which 10 to 12 mean too."""
    if level is None:
        return {}
    if isinstance(level, bool) or not isinstance(level, int) or not 1 <= level <= 12:
        raise ValueError("the compression level is a whole number from 1 to 12")
    return {"compression": "gzip", "zlib.compress.level": _LEVELS[min(level, 9) - 1]}


def write_lines(df: DataFrame, line: Column, path: str, level: int | None = None, single: bool = False, mode: str = "errorifexists") -> None:
    out = df.select(line.alias("value"))
    (out.coalesce(1) if single else out).write.mode(mode).options(**gzip_options(level)).text(path)


def fastq_record(row: Column | None = None) -> Column:
    """The four lines of a record, from columns or from a struct."""
    at = (lambda c: F.col(c)) if row is None else (lambda c: row[c])
    return F.concat_ws("\n", F.concat(F.lit("@"), F.concat_ws(" ", at("id"), at("desc"))), at("seq"), at("sep"), at("qual"))


def write_fastq(reads: DataFrame, path: str, level: int | None = None, single: bool = False, mode: str = "errorifexists") -> None:
    write_lines(reads, fastq_record(), path, level, single, mode)


def write_fastq_pairs(pairs: DataFrame, path1: str | None, path2: str | None, level: int | None = None, mode: str = "errorifexists") -> None:
    """Either or both mates; the parts of both directories hold the pairs in the same order."""
    if path1 is None and path2 is None:
        raise ValueError("no output: give one path at least")
    for path, r in ((path1, "r1"), (path2, "r2")):
        if path is not None:
            write_lines(pairs, fastq_record(F.col(r)), path, level, mode=mode)


def write_koutput(koutput: DataFrame, path: str, level: int | None = None, mode: str = "errorifexists") -> None:
    write_lines(koutput, F.col("line"), path, level, mode=mode)


def write_koutreads(reads: DataFrame, path: str, level: int | None = None, mode: str = "errorifexists") -> None:
    write_lines(reads, F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in ("taxid", "tags", "lca", "seq", "qual")]), path, level, mode=mode)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)
