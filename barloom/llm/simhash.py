"""SimHash fingerprints and the search for near ones, in DataFrame expressions only.

Terms are pairs of neighbouring words (white space parts words; a text of one word is one term), lower-cased
and weighted by how often they occur. Every occurrence votes on each of 128 bits by its hash. 128 counters are held in 64
sums with two 32-bit lanes each, so that a term costs a shift and a mask for two bits; a bit is set if more than
half of the votes are for it. Terms are summed where their text was read: one shuffle for the document order, none for the votes.

`near_counts` finds all fingerprints within a Hamming radius: the bits are cut into blocks of which at least three
must be whole, so a table for each choice of three blocks, keyed by them, holds every near pair at least once.
Equal fingerprints are one entry, and the distance is tested inside the join. Joins of more than MOST_BROADCAST rows are by
sorting: the planner goes by the compressed bytes of files, and would send tables of many times that size through the driver.

The order of documents is found in buckets of neighbouring ids, parted by quantiles of the ids, so that neither ids far off nor an id of very
many rows makes a bucket large.

Edge cases: null texts count as empty; texts without words have the fingerprint 0. Rows that repeat a doc_id follow
each other by a hash of their text, then by text; null doc_ids come first, by text, in one bucket. With one row, the next document is the row
itself. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import materialize

LANES = 0x0000000100000001
ROWS_IN_BUCKET, MOST_BUCKETS = 2048, 10_000
MOST_BROADCAST = 100_000  # rows


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def term_hashes(words: str) -> Column:
    """array<long>: a hash for each pair of neighbours in a column of words (a column, so that it is made once)."""
    w = F.col(words)
    pairs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    return F.when(F.size(w) == 1, F.array(F.xxhash64(F.get(w, F.lit(0))))).otherwise(pairs)


def vote_sums(h: Column) -> list[Column]:
    """Aggregates v0..v63: the votes for bits j and j + 32 (j < 32) of the first half, then of the second."""
    other = F.when(h.isNotNull(), F.xxhash64(h, F.lit(1)))  # a hash of NULL isn't NULL
    return [F.sum(F.shiftrightunsigned(x, j).bitwiseAND(F.lit(LANES))).alias(f"v{32 * k + j}") for k, x in enumerate((h, other)) for j in range(32)]


def _half(k: int, total: Column) -> Column:
    out = F.lit(0).cast("long")
    for j in range(32):
        v = F.col(f"v{32 * k + j}")
        for lane in (0, 32):
            votes = F.shiftrightunsigned(v, lane).bitwiseAND(F.lit(0xFFFFFFFF))
            out = out.bitwiseOR(F.when(votes * 2 > total, F.shiftleft(F.lit(1).cast("long"), j + lane)).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 - Hamming distance / 128."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(128.0)


def hex128(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _boundaries(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that part the documents into about equal buckets; an id of very many rows stands there several times."""
    if buckets < 2:
        return []
    at = [k / buckets for k in range(1, buckets)]
    return docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(100_000)).alias("b")).first()["b"] or []


def _count_below(ends: list[int], than: Column, strictly: bool) -> Column:
    """How many of the sorted numbers lie below a column: first of every sixteenth or so, then of those between."""
    step = max(1, round(len(ends) ** 0.5))
    below = (lambda e: e < than) if strictly else (lambda e: e <= than)
    whole = [ends[i : i + step] for i in range(0, len(ends), step)]
    blocks = F.size(F.filter(F.array(*[F.lit(b[-1]) for b in whole]), below))
    rest = F.get(F.array(*[F.array(*map(F.lit, b)) for b in whole]), blocks)
    return blocks * step + F.when(rest.isNull(), 0).otherwise(F.size(F.filter(rest, below)))


def _bucket(ends: list[int]) -> Column:
    """The bucket of a row by doc_id; rows of an id that stands several times among the ends are dealt to its buckets by the hash of their text."""
    if not ends:
        return F.lit(0)
    low, high = _count_below(ends, F.col("doc_id"), True), _count_below(ends, F.col("doc_id"), False)
    share = F.col("mark") / F.lit(2.0**64) + 0.5
    return F.coalesce(low + F.least(high - low, F.floor(share * (high - low + 1))).cast("int"), F.lit(0))


def _in_order(docs: DataFrame, text: str) -> DataFrame:
    """bucket, guest, doc_id, mark, text: buckets of neighbouring documents, each with the document that follows it as a guest at its end."""
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")).otherwise(F.lit(None).cast("long")))
    n = docs.count()
    placed = docs.withColumn("bucket", _bucket(_boundaries(docs, min(MOST_BUCKETS, -(-n // ROWS_IN_BUCKET)))))
    # One row for each bucket that isn't empty (MOST_BUCKETS at most): which document begins it, and the bucket before (of the first: the last).
    order = F.struct("doc_id", "mark", "text")
    firsts = materialize(placed.groupBy("bucket").agg(F.min(order).alias("first")))
    w, last = Window.orderBy("bucket"), Window.orderBy(F.desc("bucket"))
    guests = firsts.select(F.coalesce(F.lag("bucket").over(w), F.first("bucket").over(last)).alias("bucket"), F.lit(1).alias("guest"), "first.doc_id", "first.mark", "first.text")
    return placed.select("bucket", F.lit(0).alias("guest"), "doc_id", "mark", "text").unionByName(guests)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, f0, f1, e0, e1, x0, x1: fingerprints of each text, its edited text and the next text."""
    w = Window.partitionBy("bucket").orderBy("guest", "doc_id", "mark", "text")
    rows = _in_order(docs, text).withColumns({"at": F.row_number().over(w), "next": F.coalesce(F.lead("text").over(w), F.lit("")), "n_chars": F.length("text").cast("long")})
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("next", F.lit(1), cut))
    rows = rows.select("bucket", "at", "guest", "doc_id", "n_chars", "text", edited.alias("edited"), F.sha2(edited, 256).alias("edited_sha256"))
    both = rows.select("bucket", "at", "guest", "doc_id", "n_chars", "edited_sha256", F.explode(F.when(F.col("guest") == 1, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))).alias("one"))
    keys = ["bucket", "at", "guest", "doc_id", "n_chars", "edited_sha256", "kind"]
    words = both.select(*keys[:-1], F.col("one.kind").alias("kind"), words_of(F.col("one.t")).alias("words"))
    terms = words.select(*keys, F.explode_outer(term_hashes("words")).alias("h"))
    votes = terms.groupBy(*keys).agg(*vote_sums(F.col("h")), F.count("h").alias("total"))
    prints = votes.select(*keys, _half(0, F.col("total")).alias("a"), _half(1, F.col("total")).alias("b"))
    one = prints.groupBy("bucket", "at", "guest", "doc_id", "n_chars", "edited_sha256").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(x))).alias(name) for k, x, name in ((0, "a", "f0"), (0, "b", "f1"), (1, "a", "e0"), (1, "b", "e1"))]
    )
    after = Window.partitionBy("bucket").orderBy("at")
    out = one.withColumns({"x0": F.lead("f0").over(after), "x1": F.lead("f1").over(after)})
    return out.filter("guest = 0").select("doc_id", "n_chars", "edited_sha256", "f0", "f1", "e0", "e1", "x0", "x1")


def _sorted_if_many(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that the planner may choose to broadcast only if it has few rows."""
    return df.hint("merge") if rows > MOST_BROADCAST else df


def _blocks(blocks: int) -> list[tuple[int, int, int]]:
    """The blocks' places: (half, shift, bits)."""
    half = blocks // 2
    size = 64 // half
    return [(h, i * size, size if i < half - 1 else 64 - i * size) for h in (0, 1) for i in range(half)]


def near_counts(prints: DataFrame, radius: int = 3, a: str = "f0", b: str = "f1") -> DataFrame:
    """f0, f1, copies, near: each different fingerprint, its rows, and how many other fingerprints lie within the radius."""
    kinds = materialize(prints.groupBy(F.col(a).alias("f0"), F.col(b).alias("f1")).agg(F.count("*").alias("copies")))
    blocks = _blocks(2 * -(-(radius + 3) // 2))
    tables = []
    for nth, whole in enumerate(combinations(range(len(blocks)), len(blocks) - radius)):
        part = [F.shiftrightunsigned(F.col(f"f{blocks[i][0]}"), blocks[i][1]).bitwiseAND(F.lit((1 << blocks[i][2]) - 1 if blocks[i][2] < 64 else -1)) for i in whole]
        tables.append(F.xxhash64(F.lit(nth), *part))
    placed = kinds.select("f0", "f1", F.explode(F.array(*tables)).alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    placed = materialize(_sorted_if_many(placed, kinds.count() * len(tables)).join(shared, "key"))
    other = placed.select("key", F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    distance = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    differ = (F.col("f0") != F.col("g0")) | (F.col("f1") != F.col("g1"))
    mine = _sorted_if_many(placed, placed.count()).alias("p").join(other.alias("q"), (F.col("p.key") == F.col("q.key")) & (distance <= radius) & differ)
    near = mine.select("f0", "f1", "g0", "g1").distinct().groupBy("f0", "f1").agg(F.count("*").alias("near"))
    return kinds.join(near, ["f0", "f1"], "left").select("f0", "f1", "copies", F.coalesce("near", F.lit(0)).alias("near"))


def edited_likeness(docs: DataFrame, radius: int = 3, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_equal, n_near."""
    prints = materialize(fingerprints(docs, text))
    counts = near_counts(prints, radius)
    f, e, x = ((F.col(f"{k}0"), F.col(f"{k}1")) for k in "fex")
    out = _sorted_if_many(prints, prints.count()).join(counts, ["f0", "f1"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex128(*f).alias("fingerprint"), hex128(*e).alias("edited_fingerprint"),
        likeness(f, e).alias("near_edited"), likeness(f, x).alias("near_next"), F.col("copies").alias("n_equal"), F.col("near").alias("n_near"),
    )
