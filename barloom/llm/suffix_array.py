"""Suffix-array removal of repeated strings of bytes.

A string of `span` bytes that starts at two places is found in three steps.

1. Shards. Every window of `span` bytes has a landmark: the 16-byte gram in it with the least hash (the leftmost of equals).
   Equal windows have equal landmarks at the same place, so only windows of one landmark are ever compared. Neighbouring
   windows with the same landmark form a segment. Segments are counted by landmark and by content: a landmark met once
   needs no comparison, and of segments of equal content (copies) one stands for all and the others are known repeats.
2. Suffix sorting. The remaining segments of a shard of landmarks are written one after another, each with an end mark of its own,
   and their suffixes are sorted by the difference cover {1, 2} modulo 3: the triples at sampled places are sorted and
   named, names are sorted by recursion until they differ, and the remaining suffixes, sorted by their first symbol
   and the rank that follows, are merged in. Neighbours in that order are compared over `span` bytes.
3. A landmark with more than `hot` distinct segments (a line that very many documents share) isn't put into one shard: its windows
   are dealt out one by one, by a 128-bit digest, and counted. That way is exact too, up to the digest.

Edge cases: null and empty texts and those shorter than `span` lose nothing. Rows that repeat a doc_id are documents of
their own; equal rows are copies of each other. Matches never cross documents. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import U64, discard, lean, materialize, mix64, own_prefix, workers_import
from barloom.llm.shingles import CHUNK, chunks, powers, prefix_sums

SPAN, GRAM, HOT = 200, 16, 2000
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20  # the JVM keeps buffers of the batches that it has written
DIGEST_BYTES = 1 << 17  # of segments whose windows are digested at once
SHARD_BYTES = 1_500_000  # symbols and ranks of a shard have to fit into 21 bits
FAR = U64(np.iinfo(np.uint64).max)
PLACE_BITS = U64(22)  # of a hash, the others decide: places in two chunks and a window fit


# --- suffix sorting --------------------------------------------------------------------------------


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of s, whole numbers from 1 to below 2**21 (as is its length); the end sorts first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    t = np.concatenate((s.astype(U64), np.zeros(3, dtype=U64)))
    at = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))  # a dummy at n keeps the first kind whole
    key = t[at] << U64(42) | t[at + 1] << U64(21) | (t[np.minimum(at + 2, n + 2)])
    order = np.argsort(key)  # equal triples get one name, whatever their order
    in_order = key[order]
    names = np.cumsum(np.concatenate(([True], in_order[1:] != in_order[:-1])))
    if names[-1] < len(at):
        named = np.empty(len(at), dtype=np.int64)
        named[order] = names
        order = suffix_order(named)
    sample = at[order]
    rank = np.zeros(n + 3, dtype=U64)
    rank[sample] = np.arange(1, len(sample) + 1, dtype=U64)
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    two = t[rest] << U64(21) | rank[rest + 1]
    rest = rest[np.argsort(two)]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    # A remaining suffix compares with the first kind by a symbol and a rank, with the second by two symbols and a rank.
    a = np.searchsorted(t[first] << U64(21) | rank[first + 1], t[rest] << U64(21) | rank[rest + 1])
    b = np.searchsorted(t[second] << U64(42) | t[second + 1] << U64(21) | rank[second + 2], t[rest] << U64(42) | t[rest + 1] << U64(21) | rank[rest + 2])
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(rest)) + a + b
    out[place] = rest
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = sample
    return out


def repeated_starts(segments: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each segment, a flag for each of its windows: it equals another window of these segments."""
    n = len(segments)
    sizes = np.array([len(x) for x in segments], dtype=np.int64)
    data = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = data.astype(np.int64) + n + 1
    text[ends] = np.arange(1, n + 1)
    order = suffix_order(text)
    whole = np.ones(len(data), dtype=bool)  # starts of windows that end inside their segment
    for d in range(0, span):
        whole[np.maximum(ends - d, 0)] = False
    order = order[whole[order]]
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for d in [*range(0, span - 7, 8), span - 8] if span >= 8 else []:
        same = same[(words[a[same] + d] == words[b[same] + d]).all(axis=1)]
    if span < 8:
        for d in range(span):
            same = same[data[a[same] + d] == data[b[same] + d]]
    flags = np.zeros(len(data), dtype=bool)
    flags[a[same]] = True
    flags[b[same]] = True
    starts = ends - sizes
    return [flags[p : p + max(0, k - span + 1)] for p, k in zip(starts.tolist(), sizes.tolist(), strict=True)]


# --- landmarks -------------------------------------------------------------------------------------


def _slide_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = -(-len(x) // w) * w
    block = np.concatenate((x, np.full(size - len(x), FAR))).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def pieces_of(texts: list[bytes], span: int) -> tuple[list[int], list[int], list[bytes]]:
    """Owner, offset and bytes: texts as they are, long ones in pieces that overlap by what a window needs."""
    owner, offset, data = [], [], []
    for i, t in enumerate(texts):
        for p in range(0, max(1, len(t) - span + 1), CHUNK):
            owner.append(i)
            offset.append(p)
            data.append(t[p : p + CHUNK + span - 1])
    return owner, offset, data


def segments_of(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Owner, first window, number of windows, landmark and content digest of all segments of the texts.

    Of a gram's hash the same bits decide everywhere, so equal windows have equal landmarks wherever they lie.
    """
    owners, offsets, pieces = pieces_of(texts, span)
    owners, offsets = np.array(owners, dtype=np.int64), np.array(offsets, dtype=np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in chunks(pieces):
        data = np.frombuffer(b"\0".join(pieces[a:b]) + b"\0", dtype=np.uint8)
        sizes = np.array([len(t) for t in pieces[a:b]], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        if len(data) < span:
            continue
        sums, (_, down) = prefix_sums(data), powers(len(data) + 1)
        n = len(data) - gram + 1
        h = mix64((sums[gram : gram + n] - sums[:n]) * down[:n])
        place = np.arange(n, dtype=U64)
        least = _slide_least((h >> PLACE_BITS << PLACE_BITS) | place, span - gram + 1)
        mark = (least & ((U64(1) << PLACE_BITS) - U64(1))).astype(np.int64)
        owner = np.repeat(np.arange(b - a), sizes + 1)[: len(mark)]
        inside = np.arange(len(mark)) + span <= (starts + sizes)[owner]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        new = np.concatenate(([True], (mark[at[1:]] != mark[at[:-1]]) | (at[1:] != at[:-1] + 1)))
        first = at[new]
        count = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
        end = first + count - 1 + span
        content = mix64((sums[end] - sums[first]) * down[first] + count.astype(U64) * U64(0x2545F4914F6CDD1D))
        who = owner[first]
        found.append((owners[a + who], first - starts[who] + offsets[a + who], count, h[mark[first]], content))
    if not found:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


# --- Spark -----------------------------------------------------------------------------------------

KEYS = "id long, sig long"
#: Bytes in another order, for a second polynomial: 167 x x + 13 modulo 256 meets each once.
OTHER = (np.arange(256) * 167 + 13).astype(np.uint8)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """The document's id and a signature of its text stand for a row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("id"), F.xxhash64(t).alias("sig"), t.cast("binary").alias("data"), F.col("doc_id"))


def _find_segments(keyed: DataFrame, span: int) -> DataFrame:
    def run(batches):
        for b in batches:
            owner, first, count, mark, content = segments_of(b.column(2).to_pylist(), span)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(mark.view(np.int64)), pa.array(content.view(np.int64))],
                ["id", "sig", "first", "windows", "mark", "content"],
            )

    return keyed.select("id", "sig", "data").mapInArrow(lean(run), f"{KEYS}, first int, windows int, mark long, content long")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each row's structs begin and end, and the structs' fields for all rows; a null row has none."""
    offsets = column.offsets.to_numpy()
    first, last = int(offsets[0]), int(offsets[-1])
    flat = column.values.slice(first, last - first)
    return offsets - first, [flat.field(k) for k in range(flat.type.num_fields)]


def _cut_out(keyed: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of the wanted segments (id, sig, parts)."""
    names = ["id", "sig", "first", "mark", "known", "hot", "data"]

    def run(batches):
        for b in batches:
            offsets, (first, windows, mark, known, hot) = _lists(b.column(3))
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            texts = b.column(2).to_pylist()
            data = [texts[i][p : p + n + span - 1] for i, p, n in zip(owner.tolist(), first.to_pylist(), windows.to_pylist(), strict=True)]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), first, mark, known, hot, pa.array(data, pa.binary())], names)

    part = F.struct("first", "windows", "mark", "known", "hot")
    lists = wanted.groupBy("id", "sig").agg(F.collect_list(part).alias("parts"))
    one = keyed.select("id", "sig", "data").join(lists, ["id", "sig"]).dropDuplicates(["id", "sig"])
    return one.select("id", "sig", "data", "parts").mapInArrow(lean(run), f"{KEYS}, first int, mark long, known boolean, hot boolean, data binary")


def _sort_shards(cut: DataFrame, shards: int, span: int) -> DataFrame:
    """Repeats among the segments of each landmark: id, sig, start, size (a run of windows)."""

    names = ["id", "sig", "start", "windows"]

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        known, first = rows["known"].to_numpy(), rows["first"].to_numpy()
        who, start, size = [], [], []
        for i, flags in enumerate(repeated_starts(rows["data"].to_pylist(), span)):
            if not known[i] and flags.any():
                p, q = _runs(flags)
                who.append(np.full(len(p), i))
                start.append(first[i] + p)
                size.append(q - p)
        who, start, size = (np.concatenate([*x, np.empty(0, dtype=np.int64)]).astype(np.int64) for x in (who, start, size))
        take = pa.array(who)
        ids = [rows[c].take(take).combine_chunks() for c in ("id", "sig")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names)

    def run(batches):
        held, size, mark = [], 0, None
        for b in batches:
            marks = b.column(3).to_numpy()
            if not len(marks):
                continue
            upto = np.concatenate(([0], np.cumsum(pa.compute.binary_length(b.column(5)).to_numpy() + 1)))
            ends = np.flatnonzero(np.concatenate(([bool(held) and marks[0] != mark], marks[1:] != marks[:-1])))
            at = 0
            # A shard ends with a landmark, once it has enough bytes.
            while (k := int(np.searchsorted(upto[ends], upto[at] + SHARD_BYTES // 2 - size, side="right"))) < len(ends):
                e = int(ends[k])
                held.append(b.slice(at, e - at))
                yield done(held)
                held, size, at = [], 0, e
            held.append(b.slice(at))
            size += int(upto[-1] - upto[at])
            mark = marks[-1]
        if held:
            yield done(held)

    dealt = cut.select("id", "sig", "first", "mark", "known", "data").repartition(shards, "mark").sortWithinPartitions("mark")
    return dealt.mapInArrow(lean(run), f"{KEYS}, start int, windows int")


def window_digests(segments: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """Segment, place in it and 128 bits of every window: two polynomials over different values of the bytes."""
    data = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
    sizes = np.array([len(x) for x in segments], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    count = np.maximum(sizes - span + 1, 0)
    who = np.repeat(np.arange(len(segments)), count)
    place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[who] + place
    _, down = powers(len(data) + 1)
    halves = [mix64((sums[at + span] - sums[at]) * down[at]).view(np.int64) for sums in (prefix_sums(data), prefix_sums(OTHER[data]))]
    return who, place, *halves


def _count_windows(cut: DataFrame, span: int) -> DataFrame:
    """The same for windows of very common landmarks, dealt out by a digest of each."""

    def run(batches):
        for b in batches:
            segments = b.column(4).to_pylist()
            for p, q in chunks(segments, DIGEST_BYTES):
                who, place, lo, hi = window_digests(segments[p:q], span)
                take = pa.array(who + p)
                start = b.column(2).take(take).to_numpy() + place
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(start.astype(np.int32)), b.column(3).take(take), pa.array(lo), pa.array(hi)], ["id", "sig", "start", "known", "lo", "hi"])

    all_ = cut.select("id", "sig", "first", "known", "data").mapInArrow(lean(run), f"{KEYS}, start int, known boolean, lo long, hi long")
    twice = all_.groupBy("lo", "hi").agg(F.count("*").alias("k")).filter("k > 1").select("lo", "hi")
    return all_.filter("not known").join(twice, ["lo", "hi"]).select("id", "sig", "start", F.lit(1).alias("windows"))


def repeats(docs: DataFrame, span: int = SPAN, hot: int = HOT, text: str = "text") -> DataFrame:
    """id, sig, start, windows: runs of windows of which each occurs elsewhere too."""
    workers_import(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    keyed = _keyed(docs, text)
    segments = materialize(_find_segments(keyed, span))
    by_content = segments.groupBy("mark", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "first")).alias("one"))
    by_mark = by_content.groupBy("mark").agg(F.count("*").alias("kinds"))
    kinds = by_content.join(by_mark, "mark").filter("copies > 1 or kinds > 1")
    known = F.col("copies") > 1
    is_one = (F.col("one.id") == F.col("id")) & (F.col("one.first") == F.col("first"))  # or several, if texts share an id: no harm
    suspects = segments.join(kinds, ["mark", "content"]).select("id", "sig", "first", "windows", "mark", known.alias("known"), ((F.col("kinds") > 1) & (~known | is_one)).alias("compare"), (F.col("kinds") > hot).alias("hot"))
    suspects = materialize(suspects)
    discard(segments)
    del by_content, by_mark, kinds, segments
    cut = materialize(_cut_out(keyed, suspects.filter("compare"), span))
    size = cut.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // (4 * SHARD_BYTES)) + 1)
    found = _sort_shards(cut.filter("not hot"), shards, span).unionByName(_count_windows(cut.filter("hot"), span))
    return suspects.filter("known").select("id", "sig", F.col("first").alias("start"), "windows").unionByName(found)


def cover(starts: np.ndarray, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs."""
    order = np.argsort(starts, kind="stable")
    a = starts[order].astype(np.int64)
    b = np.maximum.accumulate(a + windows[order] + span - 1)
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))]


def kept_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at = [0, *ends.tolist()]
    to = [*starts.tolist(), len(data)]
    return b"".join([data[p:q] for p, q in zip(at, to, strict=True)])


def _runs_by_document(docs: DataFrame, span: int, hot: int, text: str) -> DataFrame:
    found = repeats(docs, span, hot, text).distinct()
    return found.groupBy("id", "sig").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))


def removal_digest(docs: DataFrame, span: int = SPAN, hot: int = HOT, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    runs = _runs_by_document(docs, span, hot, text)

    def run(batches):
        for b in batches:
            offsets, (start, windows) = _lists(b.column(2))
            start, windows = start.to_numpy(), windows.to_numpy()
            rows = []
            for data, p, q in zip(b.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                kept, spans = data, 0
                if q > p:
                    a, e = cover(start[p:q], windows[p:q], span)
                    kept, spans = kept_bytes(data, a, e), len(a)
                rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _keyed(docs, text).join(runs, ["id", "sig"], "left")
    return joined.select("doc_id", "data", "runs").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, span: int = SPAN, hot: int = HOT, text: str = "text") -> DataFrame:
    """The documents with their repeats cut out of the text; a character that loses a byte goes whole."""
    runs = _runs_by_document(docs, span, hot, text)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    o = own_prefix(docs.columns)
    marked = docs.withColumns({f"{o}id": F.coalesce("doc_id", F.lit(-(2**63) + 1)), f"{o}sig": F.xxhash64(t)})
    joined = marked.join(runs.select(*[F.col(c).alias(f"{o}{c}") for c in ("id", "sig", "runs")]), [f"{o}id", f"{o}sig"], "left")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            offsets, (start, windows) = _lists(b.column(b.num_columns - 1))
            start, windows = start.to_numpy(), windows.to_numpy()
            for k in np.flatnonzero(np.diff(offsets)).tolist():
                data = texts[k].encode()
                a, e = cover(start[offsets[k] : offsets[k + 1]], windows[offsets[k] : offsets[k + 1]], span)
                texts[k] = kept_bytes(data, a, e).decode(errors="ignore")
            cols = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.select(*docs.columns, f"{o}runs").mapInArrow(lean(run), docs.schema)
