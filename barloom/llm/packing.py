"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to tiers by length: whole windows of the largest tier are cut off long documents, what
is left goes to the smallest tier (a power of two) that holds it. Each tier fills windows of its own length,
longest pieces first; the gap that a window keeps is filled from the shorter tiers, whole pieces first and
a cut piece last, so a window leaves full. Pieces of a tier too few for a window are promoted to the next.
What remains at the end of a partition is cut to windows of decreasing powers of two, so nothing is padded.
Each partition packs for itself as it is scanned: no shuffle, no group, memory bounded by the buffer.
Full windows of a tier are dealt to step groups that hold the same number of tokens each.

Ids come from the tokenizer library; a word's ids are kept in a cache bounded by bytes, since words between white
space are encoded independently by pre-tokenizers that never join across it.

Edge cases: null and empty texts are the single end id; rows are packed as they are, repeated ones and null
doc_ids too; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barloom.llm.common import WordCache, lean, workers_import
from barloom.llm.token_counts import by_bytes

TIERS = (256, 512, 1024, 2048)
BUFFER_TOKENS = 1 << 20
STEP_TOKENS = 16_384
CHUNK_BYTES = 2 << 20
MARKS = (b".", b",")
SHIFT = 40  # a sequence's number is its partition's number times 2**40, plus its number there
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray | None:
    """Which ids end a word, if the vocabulary marks them."""
    t = tokenizer(path)
    suffix = getattr(t.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    out = np.zeros(t.get_vocab_size(), dtype=bool)
    out[[i for w, i in t.get_vocab().items() if w.endswith(suffix)]] = True
    return out


def _letters(word: str) -> bool:
    return word.isalpha() and word.lower().isalpha()


def _encode_new(words: list[bytes], path: str) -> list[bytes]:
    """Ids of words. Words of letters only are one pre-token each; some of them share a call, and their marked ends part the ids.

    What lower-casing makes of a letter may be none (İ), so both forms are looked at; words that the marks don't part are encoded one by one.
    """
    t, ends = tokenizer(path), _word_ends(path)
    texts = [w.decode() for w in words]
    out: list[bytes] = [b""] * len(words)
    plain = [i for i, w in enumerate(texts) if ends is not None and _letters(w)]
    groups = [plain[i : i + 50] for i in range(0, len(plain), 50)] + [[i] for i in sorted(set(range(len(texts))).difference(plain))]
    encoded = list(zip(groups, t.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True))
    while encoded:
        group, e = encoded.pop()
        ids = np.array(e.ids, dtype="<u4")
        data = ids.tobytes()
        if len(group) == 1:
            out[group[0]] = data
            continue
        cut = [0, *((np.flatnonzero(ends[ids]) + 1) * 4).tolist()]
        if len(cut) != len(group) + 1:
            encoded += zip([[i] for i in group], t.encode_batch_fast([texts[i] for i in group], add_special_tokens=False), strict=True)
            continue
        for i, p, q in zip(group, cut[:-1], cut[1:], strict=True):
            out[i] = data[p:q]
    return out


def _words(text: str) -> list[bytes]:
    """What lies between spaces and line ends, A-Z lower-cased as the tokenizer does, unless a special token may stand there."""
    data = text.encode()
    if b"<|" not in data:
        data = data.lower()
    return data.replace(b"\n", b" ").split(b" ")


def _cost(word: bytes) -> int:
    return 220 + 3 * len(word)


def _learn(words: set[bytes], cache: WordCache, path: str) -> None:
    """Ids of new words. Letters with one stop or comma behind are two pre-tokens, whose ids follow each other."""
    new = cache.missing(words, _cost)
    marked = [w for w in new if w[-1:] in MARKS and _letters(w[:-1].decode())]
    parts = cache.missing({w[:-1] for w in marked}.union(MARKS), _cost)
    for part in by_bytes(parts.union(new.difference(marked)), CHUNK_BYTES // 4):
        cache.now.update(zip(part, _encode_new(part, path), strict=True))
    now = cache.now
    for w in marked:
        now[w] = now[w[:-1]] + now[w[-1:]]


_CACHES: dict[str, WordCache] = {}


def token_bytes(texts: list[str], path: str, end_id: int = 1):
    """Each text's ids and the end id, as little-endian unsigned 32-bit numbers."""
    cache = _CACHES.setdefault(path, WordCache())
    end = np.array([end_id], dtype="<u4").tobytes()
    for chunk in by_bytes(texts, CHUNK_BYTES):
        cut = [_words(t) for t in chunk]
        cache.begin()
        _learn(set(chain.from_iterable(cut)), cache, path)
        get = cache.now.__getitem__
        for words in cut:
            yield b"".join(map(get, words)) + end


class Packer:
    """Takes documents' ids in turn and gives pieces: (doc_id, start, ids, doc_tokens, sequence, offset, tier)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER_TOKENS, base: int = 0):
        self.tiers, self.buffer, self.next = tiers, buffer, base
        self.queue: list[list[tuple]] = [[] for _ in tiers]  # by tier, sorted by length: (length, order, doc_id, start, ids, doc_tokens)
        self.held = 0
        self.order = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, big, start = len(ids) // 4, self.tiers[-1], 0
        while n - start >= big:
            self._window([(big, 0, doc_id, start, ids[4 * start : 4 * (start + big)], n)], big)
            start += big
        if n > start:
            self._queue((n - start, self.order, doc_id, start, ids[4 * start :], n))
        if self.held >= self.buffer:
            self.pack()

    def _queue(self, piece: tuple) -> None:
        k = next(k for k, t in enumerate(self.tiers) if piece[0] <= t)
        self.order += 1
        insort(self.queue[k], (piece[0], self.order, *piece[2:]))
        self.held += piece[0]

    def _window(self, pieces: list[tuple], tier: int) -> None:
        offset = 0
        for length, _, doc_id, start, ids, n in pieces:
            self.out.append((doc_id, start, length, zlib.crc32(ids), n, self.next, offset, tier))
            offset += length
        self.next += 1

    def _take(self, k: int, room: int) -> tuple | None:
        """The longest piece of tier k that fits."""
        at = bisect_right(self.queue[k], (room, float("inf"))) - 1
        if at < 0:
            return None
        piece = self.queue[k].pop(at)
        self.held -= piece[0]
        return piece

    def _split(self, k: int, room: int) -> tuple | None:
        """The first `room` ids of tier k's longest piece; the rest goes back to the tier it now fits."""
        if not self.queue[k]:
            return None
        length, _, doc_id, start, ids, n = self.queue[k].pop()
        self.held -= length
        self._queue((length - room, 0, doc_id, start + room, ids[4 * room :], n))
        return (room, 0, doc_id, start, ids[: 4 * room], n)

    def pack(self) -> None:
        """Fill windows of every tier, from the longest, while the tiers up to it hold enough."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            while self.queue[k] and sum_at_least(self.queue[: k + 1], tier):
                room, pieces = tier, []
                while room:
                    # Whole pieces, from this tier down; then a cut from the shortest tier that must be cut to fit.
                    piece = next((p for j in range(k, -1, -1) if (p := self._take(j, room))), None)
                    piece = piece or next((p for j in range(k + 1) if (p := self._split(j, room))), None)
                    pieces.append(piece)
                    room -= piece[0]
                self._window(pieces, tier)
        # What a tier couldn't fill joins the next one's pieces.
        for k in range(len(self.tiers) - 1):
            for piece in self.queue[k]:
                insort(self.queue[k + 1], piece)
            self.queue[k] = []

    def close(self) -> None:
        """Pack all, then cut what remains to windows of decreasing powers of two."""
        self.pack()
        left = [p for q in self.queue for p in q]
        room_for = sum(p[0] for p in left)
        self.queue, self.held = [[] for _ in self.tiers], 0
        while room_for:
            tier = min(1 << (room_for.bit_length() - 1), self.tiers[-1])
            room, pieces = tier, []
            while room:
                length, order, doc_id, start, ids, n = left.pop()
                m = min(room, length)
                pieces.append((m, order, doc_id, start, ids[: 4 * m], n))
                if m < length:
                    left.append((length - m, order, doc_id, start + m, ids[4 * m :], n))
                room -= m
            self._window(pieces, tier)
            room_for -= tier


def sum_at_least(queues: list[list[tuple]], total: int) -> bool:
    for q in queues:
        for p in reversed(q):
            total -= p[0]
            if total <= 0:
                return True
    return False


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 1, step_tokens: int = STEP_TOKENS, text: str = "text") -> DataFrame:
    """A row per piece. Windows of one tier in a partition are dealt, step_tokens at a time, to step groups."""
    workers_import(docs.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId()
        packer, seen = Packer(tiers, base=part << SHIFT), {}

        def rows():
            pieces, packer.out = packer.out, []
            groups = []
            for p in pieces:
                tier, seq = p[7], p[5]
                known = seen.get(tier)
                if known is None or known[1] != seq:
                    nth = 0 if known is None else known[0] + 1
                    seen[tier] = known = (nth, seq)
                groups.append((part << SHIFT) + (tier.bit_length() << 32) + known[0] * tier // step_tokens)
            cols = list(zip(*pieces, strict=True)) if pieces else [()] * 8
            types = [pa.int64()] * 7 + [pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)] + [pa.array(groups, pa.int64())], [f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            ids = b.column(0).to_pylist()
            for doc_id, data in zip(ids, token_bytes([t or "" for t in b.column(1).to_pylist()], tokenizer_path, end_id), strict=True):
                packer.add(doc_id, data)
            yield rows()
        packer.close()
        yield rows()

    return docs.select("doc_id", text).mapInArrow(lean(run), SCHEMA)
