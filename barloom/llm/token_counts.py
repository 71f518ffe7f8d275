"""Token counts: the library's batch encoding inside Arrow functions that return lengths only.

Texts are cut at safe boundaries. The dummy prefix that the library puts before a text and the space
before a word are the same symbol, and (checked on the vocabulary when it is loaded) no piece joins
anything to a following space. So a text is the sum of its words, each encoded by the library as a text of
its own. A long word (a text without spaces) is cut further, between two characters that stand side by side in no piece:
nothing is ever merged across such a place. Its later parts are encoded after the character before them, whose own tokens are then
taken off. Calls are balanced by bytes, and words that a worker has met before are not encoded again: the cost of a corpus depends on how
often its words repeat. The cache is bounded by bytes.

Edge cases: null and empty texts have 0 tokens, runs of spaces and U+2581 stay with the word that
follows (at the end of a text: that precedes), a text of spaces only is one fragment. Rows are kept as
they are, repeated ones too; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import WordCache, lean, workers_import

SPACE = "▁"
LONG = 2048  # characters of a word from which on it is cut
CALL_BYTES = 1 << 20
CHUNK_BYTES = 4 << 20
_SPACED = re.compile(r" *[^ ]+(?: +\Z)?")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=2)
def processor(path: str):
    """The library's processor, once per worker; the vocabulary must allow cuts before spaces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if SPACE in p[1:] and set(p) != {SPACE} and p.lstrip(SPACE).find(SPACE) >= 0:
            raise ValueError(f"piece {i} has a space after other characters: texts can't be cut before spaces")
    return sp


def fragments(text: str) -> list[str]:
    """The words of a text, each to be encoded as a text of its own."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    found = _SPACED.findall(text)
    return [found[0], *(f[1:] for f in found[1:])] if found else [text]


@lru_cache(maxsize=2)
def inner_pairs(path: str) -> frozenset[str]:
    """Two characters that stand side by side in some piece."""
    sp = processor(path)
    pieces = (sp.id_to_piece(i).replace(SPACE, " ") for i in range(sp.get_piece_size()))
    return frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))


Part = str | tuple[str, str]


def parts(word: str, path: str) -> list[Part]:
    """The word, or its parts if it is long: the first one as it is, others with the character before them."""
    if len(word) <= LONG:
        return [word]
    pairs, out, start, at = inner_pairs(path), [], 0, LONG
    while at < len(word):
        if word[at - 1 : at + 1] in pairs:
            at += 1
            continue
        out.append(word[start:at] if not start else (word[start - 1], word[start:at]))
        start, at = at, at + LONG
    return [*out, word[start:] if not start else (word[start - 1], word[start:])]


def cut_text(text: str, path: str) -> list[Part]:
    found = fragments(text)
    if len(text) <= LONG or max(map(len, found)) <= LONG:
        return found
    return [p for f in found for p in parts(f, path)]


def by_bytes(items, limit: int):
    """Lists of strings (or parts) with about `limit` bytes in UTF-8 each; one long string is a list of its own."""
    part, size = [], 0
    for x in items:
        n = utf8_length(x)
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append(x)
        size += n
    if part:
        yield part


def utf8_length(x: Part) -> int:
    if isinstance(x, tuple):
        x = x[1]
    return len(x) if x.isascii() else len(x) if isinstance(x, bytes) else len(x.encode())


def encode_parts(calls: list[Part], path: str) -> list[list[int]]:
    """The library's ids of words and parts."""
    sp = processor(path)
    if set(map(type, calls)) <= {str}:
        return sp.encode(calls, num_threads=1)
    got = sp.encode([c if isinstance(c, str) else c[0] + c[1] for c in calls], num_threads=1)
    return [ids if isinstance(c, str) else ids[len(sp.encode(c[0])) :] for c, ids in zip(calls, got, strict=True)]


def count_texts(texts: list[str], path: str, cache: WordCache) -> list[int]:
    """Tokens of each text. cache: tokens of fragments met before."""
    out: list[int] = []
    for chunk in by_bytes(texts, CHUNK_BYTES):
        cut = [cut_text(t, path) for t in chunk]
        cache.begin()
        for call in by_bytes(cache.missing(set(chain.from_iterable(cut)), lambda w: 150 + len(w if isinstance(w, str) else w[1])), CALL_BYTES):
            cache.now.update(zip(call, map(len, encode_parts(call, path)), strict=True))
        get = cache.now.__getitem__
        out += [sum(map(get, c)) for c in cut]
    return out


_CACHES: dict[str, WordCache] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    workers_import(docs.sparkSession)

    def run(batches):
        cache = _CACHES.setdefault(model_path, WordCache())
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = count_texts(texts, model_path, cache)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", text).mapInArrow(lean(run), SCHEMA)
