"""Secret scans, by DataFrame functions only.

Patterns find candidates; how many repositories and owners hold the same value separates examples
that are copied about from credentials of one owner. Values are counted by 64-bit hashes over the whole corpus,
first per (value, place) and then per value, so a value that a third of all rows hold is summed before it is
shuffled, and is dealt to several tasks where its verdict is joined back. The owner is the source, the
repository the document. Copies of a text are one repository of one owner: a candidate's place is the hash of the
`AROUND` characters on either side, and a value has as many repositories as documents or places, whichever are
fewer, and as many owners as first owners of its places.

Base candidates always stay, as spans of their kind. The method adds spans of kind "opaque": long
unbroken mixed tokens that no base span holds. A candidate looks live if at most `most_owners` owners and
`most_repositories` repositories have it; opaque ones that don't are dropped as examples.

Null text counts as empty. A document without candidates has an empty `spans`. Repeated rows are
scanned alike; the corpus counts of a value count distinct documents. Two values of one hash are counted as one.
Steps grow with a text's length and its number of spans, not with their product. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, running, salted_join

# The patterns of the base kinds, with the least length of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so shorter ones need not be matched and dropped
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "opaque")
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{20})(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])"
MOST_OWNERS, MOST_REPOSITORIES = 1, 4
AROUND = 80
#: Texts are cut in blocks of so many characters, so a late span costs no more than an early one.
BLOCK = 1024

_SPAN = "array<struct<start: bigint, kind: int, end: bigint, value: string, place: bigint>>"


def _spans(text: Column, pattern: str, kind: int, least: int, value_group: int = 0, only: Column | None = None) -> Column:
    """Leftmost matches without overlap, as code-point spans.

    The gaps between matches are what split() leaves, so a match starts after all earlier gaps and matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    lens = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), lens(matches).alias("m"), values.alias("v"))

    def found(x: Column) -> Column:
        sizes = F.transform(x["m"], lambda m, i: m + F.length(F.get(x["gaps"], i)))

        def span(before: Column, i: Column) -> Column:
            gap, value = F.get(x["gaps"], i), F.get(x["v"], i)
            place = F.xxhash64(F.right(gap, F.lit(AROUND)), F.left(F.get(x["gaps"], i + 1), F.lit(AROUND)))
            begin = before + F.length(gap)
            return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + F.get(x["m"], i)).alias("end"), value.alias("value"), place.alias("place"))

        return F.filter(F.transform(running(sizes, lambda a, b: a + b), span), lambda s: F.length(s["value"]) >= least)

    there = text.rlike(pattern) if only is None else only
    return F.when(there, let(pieces, found).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and opaque: arrays of (start, kind, end, value), base by start and then kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    names = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")  # plain searches cost less than the pattern
    base = F.concat(
        _spans(t, ASSIGN, 0, ASSIGN_MIN, 2, only=names & t.rlike(ASSIGN)),
        _spans(t, ACCESS, 1, ACCESS_MIN, only=t.contains("AKIA")),
        _spans(t, HEX, 2, 1),
    )
    df = docs.withColumn("base", F.array_sort(base)).withColumn("opaque", _spans(t, OPAQUE, 3, 1))

    def outside(spans: Column) -> Column:
        """Opaque spans that meet no base span: of the base spans that begin before its end, none ends after its start."""
        both = F.array_sort(F.concat(F.transform("base", lambda b: F.struct(b["start"].alias("at"), b["end"].alias("end"), F.lit(-1).alias("i"))), F.transform(spans, lambda s, i: F.struct((s["end"] - 1).alias("at"), F.lit(-1).cast("bigint").alias("end"), i.alias("i")))))
        free = lambda xs: F.array_sort(F.filter(F.transform(F.arrays_zip(xs.alias("x"), running(F.transform(xs, lambda x: x["end"]), F.greatest, -1).alias("upto")), lambda z: F.when((z["x"]["i"] >= 0) & (z["upto"] <= F.get(spans, z["x"]["i"])["start"]), z["x"]["i"])), lambda i: i.isNotNull()))
        return F.transform(let(both, free), lambda i: F.get(spans, i))

    return df.withColumn("opaque", F.when((F.size("base") > 0) & (F.size("opaque") > 0), outside(F.col("opaque"))).otherwise(F.col("opaque")))


def ownership(found: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per candidate hash: distinct repositories and owners over the corpus, and _n, the spans that hold it."""
    values = found.select(F.xxhash64(owner).alias("_o"), F.xxhash64(repository).alias("_r"), F.explode(F.concat("base", "opaque")).alias("_s"))
    values = values.select(F.xxhash64("_s.value").alias("value_hash"), F.col("_s.place").alias("_p"), "_o", "_r")
    places = values.groupBy("value_hash", "_p").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n"))
    owners = places.groupBy("value_hash", "_o").agg(F.count(F.lit(1)).alias("places"), F.sum("_n").alias("_n"))
    owners = owners.groupBy("value_hash").agg(F.sum("places").alias("places"), F.count(F.lit(1)).alias("n_owners"), F.sum("_n").alias("_n"))
    documents = values.select("value_hash", "_r").distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("documents"))
    return owners.join(documents, "value_hash").select("value_hash", F.least("places", "documents").alias("n_repositories"), "n_owners", "_n")


_MARKED = "array<struct<start: bigint, kind: int, end: bigint, value: string, live: boolean>>"


def _scan(docs: DataFrame, names: list[str], text: str, owner: str, repository: str, most_owners: int, most_repositories: int) -> DataFrame:
    """_row (a struct of the columns `names`), base and marked; candidates are written to the shared folder once, so the texts are matched once."""
    carried = docs.select(F.struct(*names).alias("_row"), F.col(text).alias("_text"), F.col(owner).alias("_owner"), F.col(repository).alias("_repo"))
    scratch = Scratch(docs.sparkSession)
    found = find_candidates(carried, "_text").drop("_text").withColumn("_id", F.monotonically_increasing_id())
    found = scratch.keep(found)
    none = F.size("base") + F.size("opaque") == 0
    some = found.where(~none)
    counts = scratch.keep(ownership(some, "_owner", "_repo"))
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    spans = some.select("_id", F.explode(F.concat("base", "opaque")).alias("_s")).withColumn("value_hash", F.xxhash64("_s.value"))
    met = salted_join(spans, counts.select("value_hash", live.alias("live")), ["value_hash"], counts.select("value_hash", "_n"))
    verdicts = met.select("_id", F.struct("_s.start", "_s.kind", "_s.end", "_s.value", "live").alias("_s"))
    marked = verdicts.where((F.col("_s.kind") < 3) | F.col("_s.live")).groupBy("_id").agg(F.array_sort(F.collect_list("_s")).alias("marked"))
    empty = F.array().cast(_MARKED)
    bare = F.transform("base", lambda s: s.dropFields("place"))
    out = some.join(marked, "_id", "left").select("_row", bare.alias("base"), F.coalesce("marked", empty).cast(_MARKED).alias("marked"))
    return out.unionByName(found.where(none).select("_row", bare.alias("base"), empty.alias("marked")))


def scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text", owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row per row of `docs`: the columns `keep` (default: all), base (array of spans) and marked (all spans that stay, each live or not).

    A candidate of more owners or repositories than allowed is an example, the others look live; base candidates stay all the same.
    Columns of `docs` named base or marked give way to the result's.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "marked")]
    out = _scan(docs, names, text, owner, repository, most_owners, most_repositories)
    return out.select(*[F.col("_row")[c].alias(c) for c in names], "base", "marked")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(body: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced; spans come sorted by start, and those that overlap are replaced as one."""
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(parts: Column, a: Column, b: Column) -> Column:
        """Characters a to b (from 0, end left out): of the first block, of those between and of the last."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        head = F.substring(F.get(parts, i), (a - i * BLOCK + 1).cast("int"), F.least(b - a, F.lit(BLOCK)).cast("int"))
        tail = F.concat(F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(parts, j), F.lit(1), (b - j * BLOCK).cast("int")))
        return F.when(b <= a, "").when(i == j, head).otherwise(F.concat(head, tail))

    def joined_pieces(x: Column) -> Column:
        fresh = lambda s, i: s["start"] >= F.get(x["ends"], i)
        kept = F.transform(spans, lambda s, i: F.when(fresh(s, i), F.concat(piece(x["parts"], F.get(x["ends"], i), s["start"]), F.lit(mark))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), piece(x["parts"], last, F.length(body).cast("bigint")))

    return let(F.struct(ends.alias("ends"), blocks.alias("parts")), joined_pieces)


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every marked span of the text replaced, and n_chars, if there, to match; overlapping spans are replaced as one."""
    names = docs.columns
    found = _scan(docs, names, text, owner, repository, most_owners, most_repositories)
    body, some = F.col("_row")[text], F.size("marked") > 0
    found = found.withColumn("_clean", F.when(some, _cut(body, F.col("marked"), mark)).otherwise(body))
    out = {c: F.col("_row")[c] for c in names}
    out[text] = F.col("_clean")
    if "n_chars" in out:
        out["n_chars"] = F.when(some, F.length("_clean")).otherwise(out["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[v.alias(k) for k, v in out.items()])
