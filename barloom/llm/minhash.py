"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has `coords` coordinates. In round i every element of the set is hashed to a place and a value in
[i, i + 1); the first `coords` rounds take a hashed place, the next `coords` rounds place i - coords for all
elements, and each place keeps its least value. A set stops after the round in which its last place was filled, so every
coordinate is filled after 2 * coords rounds at the latest, and two sketches agree in a coordinate with a probability
that is the sets' similarity. Bands of `rows` coordinates are bucket keys.

Texts with equal sets are one class, represented by its smallest doc_id. Within a bucket not all pairs are drawn. Each
class is first compared with one hub (of its buckets' hubs, the classes that share most buckets with others, the one it meets most). Classes
that share a bucket of more than one component after that form a group with the bucket's hub, and the group's consensus, the shingles that
more than half of it have, stands for a centre: a set's difference from it is small, and so are the differences of two sets.

- A similarity of p means that two sets differ in at most q = (1 - p) / (1 + p) of their sizes' sum. Sets whose differences from
  the consensus stay below that together (by the triangle inequality of the symmetric difference) are linked, known without a comparison:
  all are linked with the one that has most room.
- A pair with a set beyond that has to share part of the two differences, at least half of what they have too much. What only one
  component differs in can't be shared, and of what is left a set's rarest elements suffice to meet every partner (prefix filter, with
  the places at which two meet bounding what can follow). Only such pairs are compared.

So edits that no two copies share cost nothing, however many copies there are and however close to the threshold, and no pair of a bucket is
left out. What is compared is confirmed on the full sets of 64-bit shingle hashes, and the differences are of full sets too.
With 6 rows and 48 bands a pair of similarity 0.8 shares no bucket with probability 5e-7.

Edge cases: null, empty and wordless texts have an empty set and are linked with nothing. Rows that repeat a doc_id count as one
document, whose texts are linked. Rows with a null doc_id are linked with nothing and kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import U64, discard, lean, materialize, mix64, workers_import
from barloom.llm.components import components
from barloom.llm.shingles import shingle_sets

ROWS, BANDS = 6, 48
NONE = np.iinfo(np.uint64).max


def sketches(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """A row of `coords` values for each set; empty sets keep NONE everywhere."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), coords), NONE, dtype=U64)
    flat = out.reshape(-1)
    items = np.concatenate(sets) if sets else np.empty(0, dtype=U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * coords):
        if not len(items):
            break
        h = mix64(items + U64((i + 1) * 0x9E3779B97F4A7C15 & NONE))
        place = ((h >> U64(32)) * U64(coords) >> U64(32)).astype(np.int64) if i < coords else np.full(len(items), i - coords)
        np.minimum.at(flat, owner * coords + place, (h & U64(0xFFFFFFFF)) | U64(i << 32))
        open_ = (out == NONE).any(axis=1)
        live = open_[owner]
        if not live.all():
            items, owner = items[live], owner[live]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band of each sketch."""
    n, coords = sketch.shape
    bands = coords // rows
    part = sketch[:, : bands * rows].reshape(n, bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for j in range(rows):
        acc = mix64(acc ^ part[:, :, j]) + U64(j + 1)
    return acc


def _digests(docs: DataFrame, width: int, rows: int, bands: int, text: str) -> DataFrame:
    """doc_id, n, lo, hi (a digest of the set) and bucket keys."""
    schema = "doc_id long, n long, lo long, hi long, keys array<long>"
    coords = rows * bands

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            items = np.concatenate([*sets, np.empty(0, dtype=U64)])
            keys = np.empty((len(sets), bands), dtype=U64)
            for a in range(0, len(sets), 2000):
                keys[a : a + 2000] = band_keys(sketches(sets[a : a + 2000], coords), rows)
            start = np.concatenate(([0], np.cumsum(n)))
            digest = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix64(items ^ U64(salt)), dtype=U64)))
                digest.append((sums[start[1:]] - sums[start[:-1]]).view(np.int64))
            some = n > 0
            offsets = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), pa.array(digest[0]), pa.array(digest[1]), lists], ["doc_id", "n", "lo", "hi", "keys"])

    return docs.select("doc_id", text).mapInArrow(lean(run), schema)


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int, text: str) -> DataFrame:
    """node, items: the full sets of the given documents."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), width)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            items = np.concatenate([*sets, np.empty(0, dtype=U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))], ["node", "items"])

    found = docs.select(F.col("doc_id").alias("node"), text).join(nodes, "node", "left_semi")
    return found.mapInArrow(lean(run), "node long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked for the pairs a, b: their sets' similarity reaches the percentage."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    close = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    small = 100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y"))
    return both.select("a", "b", F.when(small, close).otherwise(False).alias("linked"))


def _differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, node, v, excess, delta for every set of the groups (hub, node): its difference from the group's consensus, and by how much
    that exceeds what a set may differ (negative: room), times 100 + percent."""
    rows = groups.join(sets, "node")
    count = rows.groupBy("hub").agg(F.count("*").alias("m"))  # 2 at least, so what only one set has isn't in the consensus
    often = rows.select("hub", F.explode("items").alias("h")).groupBy("hub", "h").agg(F.count("*").alias("f"))
    base = often.filter("f > 1").join(count, "hub").filter("2 * f > m").groupBy("hub").agg(F.collect_list("h").alias("base"))
    both = rows.join(base, "hub", "left").withColumn("base", F.coalesce("base", F.array().cast("array<long>")))
    delta = F.concat(F.array_except("items", "base"), F.array_except("base", "items"))
    excess = (100 + percent) * F.size("delta") - (100 - percent) * F.col("size")
    return both.select("hub", "node", "v", F.size("items").alias("size"), delta.alias("delta")).select("hub", "node", "v", excess.cast("long").alias("excess"), "delta")


def _near_consensus(deltas: DataFrame) -> DataFrame:
    """a, b: every set that the triangle inequality links with its group's set of most room."""
    room = deltas.groupBy("hub").agg(F.min(F.struct("excess", "node")).alias("best"))
    sure = deltas.join(room, "hub").filter((F.col("excess") + F.col("best.excess") <= 0) & (F.col("node") != F.col("best.node")))
    return sure.select(F.col("node").alias("a"), F.col("best.node").alias("b"))


def _sharing(deltas: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of different components that can share as much of their differences as a link needs."""
    unit = 2 * (100 + percent)
    rows = deltas.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    room = rows.groupBy("hub").agg(F.min("excess").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("hub", "least")
    rows = rows.join(room, "hub").withColumn("far", F.col("excess") + F.col("least") > 0)
    # Of two sets that aren't far both are linked with the one of most room already.
    nearest = rows.filter("far").groupBy("hub").agg(F.min("excess").alias("far_least"))
    rows = rows.join(nearest, "hub")
    keys = ["hub", "node", "v", "comp", "excess", "least", "far_least", "far"]
    elements = rows.select(*keys, F.explode("delta").alias("h"))
    shared = elements.groupBy("hub", "h").agg(F.count("*").alias("f"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("hub", "h", "f")
    open_ = elements.join(shared, ["hub", "h"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("open"))
    needed = F.ceil((F.col("excess") + F.when(F.col("far"), F.col("least")).otherwise(F.col("far_least"))) / F.lit(float(unit)))
    prefix = F.slice("open", F.lit(1), F.greatest(F.lit(0), F.size("open") - needed.cast("int") + 1))
    meet = open_.select("hub", "node", "comp", "excess", "far", F.size("open").alias("n"), F.posexplode(prefix).alias("at", "e"))
    meet = materialize(meet.select("hub", "node", "comp", "excess", "far", (F.col("n") - F.col("at")).alias("rest"), F.col("e.h").alias("h")))
    mine = meet.filter("far").select("hub", "h", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("excess").alias("ea"), F.col("rest").alias("ra"))
    other = meet.select("hub", "h", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("excess").alias("eb"), F.col("rest").alias("rb"), F.col("far").alias("fb"))
    enough = unit * F.least("ra", "rb") >= F.col("ea") + F.col("eb")
    same = (mine["hub"] == other["hub"]) & (mine["h"] == other["h"])
    pairs = mine.join(other, same & (F.col("ca") != F.col("cb")) & (~F.col("fb") | (F.col("a") < F.col("b"))) & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    workers_import(docs.sparkSession)
    seen = materialize(_digests(docs, width, rows, bands, text))
    some = seen.filter("n > 0 and doc_id is not null")
    classes = materialize(some.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("node")))
    reps = some.join(classes.select("lo", "hi", F.col("node").alias("doc_id")), ["doc_id", "lo", "hi"])
    bucketed = reps.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    shared = bucketed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "size")
    members = materialize(bucketed.join(shared, "key").distinct())
    # Rows of one doc_id are one document: its classes are linked as they stand.
    same = some.groupBy("doc_id").agg(F.min("lo").alias("low"), F.max("lo").alias("high")).filter("low < high").select("doc_id")
    repeated = some.join(same, "doc_id").join(classes, ["lo", "hi", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = materialize(repeated.distinct())
    central = materialize(members.groupBy("node").agg(F.sum("size").alias("weight")))
    # A document of several texts has several sets, told apart by v.
    sets = materialize(_sets_of(docs, central.select("node"), width, text).withColumn("v", F.xxhash64("items")).distinct())
    weighed = materialize(members.select("key", "node").join(central, "node"))
    discard(members)
    label = components(links)

    def now() -> DataFrame:
        """key, node, comp, hub: buckets that still hold more than one component, with their hubs."""
        placed = weighed.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        hub = F.max(F.struct("weight", -F.col("node"), "comp"))
        open_ = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), hub.alias("by")).filter("low < high")
        return placed.join(open_.select("key", (-F.col("by.col2")).alias("hub"), F.col("by.comp").alias("other")), "key")

    met = now().filter("comp <> other").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("k"))
    best = met.groupBy("a").agg(F.max(F.struct("k", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    tested = materialize(_verified(best, sets, percent))
    links = links.unionByName(tested.filter("linked").select("a", "b"))
    label = components(links)
    groups = materialize(now().select("hub", "node").distinct())
    if not groups.isEmpty():
        deltas = materialize(_differences(groups, sets, percent))
        links = links.unionByName(materialize(_near_consensus(deltas).distinct()))
        label = components(links)
        known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = materialize(_verified(_sharing(deltas, label, percent).join(known, ["a", "b"], "left_anti"), sets, percent))
        links = links.unionByName(found.filter("linked").select("a", "b"))
        label = components(links)
        discard(deltas)
    discard(sets)
    discard(weighed)
    ids = classes.join(label, "node", "left").select("lo", "hi", "n", F.coalesce("label", "node").alias("component"))
    out = seen.drop("keys").join(ids, ["lo", "hi", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
