"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Symbols of a word are merged in the order of their scores: an agenda holds the adjacent pairs whose
union is a piece; the pair with the best score (ties: the leftmost) is merged, and its two new neighbour pairs
enter the agenda. Words of up to `WIDE` symbols are merged side by side: one matrix row is one word's agenda,
and each round takes the best pair of every row. Longer words have a heap of their own.

Texts are cut before spaces (see `token_counts`); words that a worker has met before come from a
cache bounded by bytes. With ``verify`` the ids of each Arrow batch's new words are compared with the library's, and what they decode to
one after another with its decode; a difference is an error. Documents are decoded from all their ids.

Edge cases: null and empty texts have no ids and decode to the empty text; characters without a piece become
their UTF-8 bytes' pieces; U+2581 is a space, as in the library. Rows are kept, repeated ones too.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import WordCache, lean, workers_import
from barloom.llm.token_counts import CALL_BYTES, CHUNK_BYTES, SPACE, Part, by_bytes, cut_text, encode_parts, processor

WIDE = 48
STEP = 1 << 21  # above any symbol: a pair (a, b) is the number a * STEP + b
NEVER = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Symbols: pieces have their ids; a character without a piece is `size` + its code point."""

    def __init__(self, path: str):
        sp = processor(path)
        self.size = n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        name = {i: sp.id_to_piece(i) for i in plain}
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int64)
        for i, p in name.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        by_name = {p: i for i, p in name.items()}
        scores = np.array([sp.get_score(i) for i in plain], dtype=np.float32)
        _, place = np.unique(-scores, return_inverse=True)
        self.rank = np.full(n + 1, NEVER, dtype=np.int32)  # by piece; equal scores share a rank; the last is "no piece"
        self.rank[plain] = place
        keys, made = [], []
        for i, p in name.items():
            for cut in range(1, len(p)):
                a, b = self._symbol(p[:cut], by_name), self._symbol(p[cut:], by_name)
                if a is not None and b is not None:
                    keys.append(a * STEP + b)
                    made.append(i)
        order = np.argsort(keys, kind="stable")
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int32)[order]
        self.pairs = dict(zip(keys, made, strict=True))
        self.bytes_at = sp.piece_to_id("<0x00>")
        self.text_of = [self._text(sp, i) for i in range(n)]
        self.digits = [str(i) for i in range(n)]
        self.byte_ids = {i for i in range(n) if sp.is_byte(i)}

    def _symbol(self, s: str, by_name: dict) -> int | None:
        return int(self.of_char[ord(s)]) if len(s) == 1 else by_name.get(s)

    @staticmethod
    def _text(sp, i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([int(sp.id_to_piece(i)[1:-1], 16)])
        if sp.is_unknown(i):
            return " ⁇ ".encode()
        return b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or `size`."""
        key = a * STEP + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], np.int32(self.size))

    def ids(self, symbols: list[int]) -> list[int]:
        if max(symbols, default=0) < self.size:
            return symbols
        return list(chain.from_iterable([s] if s < self.size else [self.bytes_at + b for b in chr(s - self.size).encode()] for s in symbols))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge_rows(v: Vocabulary, s: np.ndarray) -> list[list[int]]:
    """s: words of one length, a row each. Every round merges each row's best pair, so all rows get shorter together."""
    out: list[list[int]] = [[]] * len(s)
    row = np.arange(len(s))
    made = v.join(s[:, :-1], s[:, 1:]) if s.shape[1] > 1 else np.empty((len(s), 0), dtype=np.int32)
    while len(row):
        if made.shape[1] == 0:
            for r, w in zip(row.tolist(), s.tolist(), strict=True):
                out[r] = w
            break
        rank = v.rank[made]
        best = rank.argmin(axis=1)  # the first of equals is the leftmost
        live = rank[np.arange(len(row)), best] != NEVER
        if not live.all():
            for r, w in zip(row[~live].tolist(), s[~live].tolist(), strict=True):
                out[r] = w
            row, s, made, best = row[live], s[live], made[live], best[live]
            if not len(row):
                break
        n, w = s.shape
        i = np.arange(n)
        s[i, best] = made[i, best]
        keep = np.ones((n, w), dtype=bool)
        keep[i, best + 1] = False
        s = s[keep].reshape(n, w - 1)
        keep = np.ones((n, w - 1), dtype=bool)
        keep[i, best] = False
        made = made[keep].reshape(n, w - 2)
        left = np.flatnonzero(best > 0)
        made[left, best[left] - 1] = v.join(s[left, best[left] - 1], s[left, best[left]])
        right = np.flatnonzero(best < w - 2)
        made[right, best[right]] = v.join(s[right, best[right]], s[right, best[right] + 1])
    return out


def _merge_long(v: Vocabulary, s: list[int]) -> list[int]:
    """The same merges for one long word, with a heap and links between neighbours."""
    n, none = len(s), v.size
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, pairs = v.rank, v.pairs
    agenda: list[tuple[int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        p = pairs.get(s[a] * STEP + s[b], none)
        if p != none:
            heapq.heappush(agenda, (int(rank[p]), a, s[a] * STEP + s[b], b))

    for a in range(n - 1):
        offer(a, a + 1)
    while agenda:
        _, a, key, b = heapq.heappop(agenda)
        if s[a] < 0 or after[a] != b or s[a] * STEP + s[b] != key:
            continue  # one of the two has been merged meanwhile
        s[a], s[b] = pairs[key], -1
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return [x for x in s if x >= 0]


def encode_words(v: Vocabulary, words: list[str]) -> list[list[int]]:
    """Ids of each string, the leading space symbol included in it; no dummy prefix is added."""
    out: list[list[int]] = [[]] * len(words)
    if not words:
        return out
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = v.of_char[codes]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        if n == 0:
            continue
        if n > WIDE:
            merged = [_merge_long(v, symbols[b : b + n].tolist()) for b in starts[at].tolist()]
        else:
            merged = _merge_rows(v, symbols[starts[at][:, None] + np.arange(n)])
        for i, m in zip(at.tolist(), merged, strict=True):
            out[i] = v.ids(m)
    return out


def encode_text(text: str, path: str) -> list[int]:
    """The ids of one text."""
    return list(chain.from_iterable(encode_words(vocabulary(path), [symbols_of(w) for w in cut_text(text, path)])))


def symbols_of(part: Part) -> str:
    """What is merged: a word after a space, a later part of a long word as it is."""
    return (SPACE + part if isinstance(part, str) else part[1]).replace(" ", SPACE)


def decode_ids(ids: list[int], path: str) -> str:
    """The text of ids: the dummy space goes, control pieces are empty, bytes that aren't UTF-8 become U+FFFD each."""
    return decode_bytes(ids, vocabulary(path)).decode()


def decode_bytes(ids: list[int], v: Vocabulary) -> bytes:
    """The same in UTF-8. Where the pieces' bytes follow each other to valid UTF-8, every run of byte pieces is valid by itself."""
    text_of = v.text_of
    if not ids or text_of[ids[0]]:
        data = b"".join([text_of[i] for i in ids])
        with contextlib.suppress(UnicodeDecodeError):
            data.decode()
            return data if ids and ids[0] in v.byte_ids else data.removeprefix(b" ")
    raw, run = [], []
    dropped = False

    def flush() -> None:
        data = bytes(run)
        while data:
            for n in (1, 2, 3, 4):
                try:
                    raw.append(data[:n].decode().encode())
                    data = data[n:]
                    break
                except UnicodeDecodeError:
                    pass
            else:
                raw.append("�".encode())
                data = data[1:]
        run.clear()

    for i in ids:
        if i in v.byte_ids:
            run += v.text_of[i]
            dropped = True
            continue
        flush()
        piece = v.text_of[i]
        if piece and not dropped:
            piece = piece.removeprefix(b" ")
            dropped = True
        raw.append(piece)
    flush()
    return b"".join(raw)


def _learn(v: Vocabulary, words: list[Part], cache: dict, path: str, verify: bool) -> None:
    ids = encode_words(v, [symbols_of(w) for w in words])
    if verify:
        theirs = encode_parts(words, path)
        if ids != theirs:
            w, a, b = next(x for x in zip(words, ids, theirs, strict=True) if x[1] != x[2])
            raise ValueError(f"ids differ from the library's: {w!r}: {a} and {b}")
        # Words one after another, each with its space: one text.
        whole = ids if set(map(type, words)) <= {str} else [a for w, a in zip(words, ids, strict=True) if isinstance(w, str)]
        if decode_bytes(list(chain.from_iterable(whole)), v) != " ".join(processor(path).decode(whole, num_threads=1)).encode():
            raise ValueError(f"the decoded text differs from the library's: {words[:20]!r} ..")
    digits = v.digits
    for w, a in zip(words, ids, strict=True):
        cache[w] = (tuple(a), ",".join([digits[i] for i in a]))


_CACHES: dict[str, WordCache] = {}


def codec_digest(docs: DataFrame, model_path: str, verify: bool = True, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids (decimal, joined by commas), sha256 of the text decoded from them."""
    workers_import(docs.sparkSession)

    def run(batches):
        v, cache = vocabulary(model_path), _CACHES.setdefault(model_path, WordCache())
        for b in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for chunk in by_bytes([t or "" for t in b.column(1).to_pylist()], CHUNK_BYTES):
                cut = [cut_text(t, model_path) for t in chunk]
                cache.begin()
                for part in by_bytes(cache.missing(set(chain.from_iterable(cut)), lambda w: 300 + 12 * len(w if isinstance(w, str) else w[1])), CALL_BYTES):
                    _learn(v, part, cache.now, model_path, verify)
                get = cache.now.__getitem__
                for words in cut:
                    known = list(map(get, words))
                    ids = list(chain.from_iterable([k[0] for k in known]))
                    n_tokens.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([k[1] for k in known]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decode_bytes(ids, v)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text).mapInArrow(lean(run), SCHEMA)
