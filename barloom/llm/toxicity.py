"""Toxicity by weak supervision.

Voters are patterns that fire or abstain: a fixed lexicon of insults, words and beginnings of words that the labelled sample
shows far more often in toxic texts, and a few marks of style. A generative label model estimates, by expectation-maximization
over labelled and unlabelled documents, how often each voter fires in either class and how voters depend on each other; a voter's say is
divided by what it shares with others. Labels fix the class of their documents in that estimation and nothing else: a logistic regression
is trained on what the model says of all documents by their votes (its posteriors), with the voters' hits and their density
as features, and scores every text in one pass of an Aho-Corasick automaton.

Bounds: the model is fitted on at most `MOST_TOXIC` + `MOST_CLEAN` labelled and `MOST_UNLABELLED` other documents, chosen by a hash of doc_id among the
rows whose crc32(doc_id as text) mod 5 isn't 0, and has at most `MOST_VOTERS` voters (those that tell most). Terms are counted and votes are
taken where the texts are; the driver gets counts of the terms that qualify and, for each document of the sample, which voters fired.
Everything else reads all rows. lang, source, labels and doc_id are no inputs of a score.

Edge cases: null and empty texts score as texts in which no voter fires. Without labelled rows of both kinds the
lexicon alone decides. Null and repeated labels: a document is toxic if any of its labels says so. Of rows that repeat a doc_id
one is in the sample. Rows are kept as they are, repeated ones and null doc_ids too (these are held out).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.llm.common import lean, materialize, workers_import

MOST_TOXIC, MOST_CLEAN, MOST_UNLABELLED, MOST_VOTERS = 3000, 5000, 4000, 400
LEAST_DEPENDENCE = 0.3  # correlations below that, given the class, are taken for chance
STEMS = (4, 5, 6, 7, 8)  # lengths of the beginnings that may become voters
LEAST_LIFT = 30.0  # times as often in toxic texts
# Common English insults.
LEXICON = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
STYLE = (re.compile(r"[!?]{3,}"), re.compile(r"\b[A-ZÀ-Þ]{4,}(?:\s+[A-ZÀ-Þ]{4,}){2,}"), re.compile(r"\byou (?:are|re) (?:a|an|all|so)\b", re.I))
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Model:
    words: list[str]  # voters; a trailing * means that any word beginning so counts
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    accuracy: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))  # how often each voter fires: toxic, other
    shared: np.ndarray = field(default_factory=lambda: np.empty(0))  # what each voter shares with others


class Matcher:
    """Finds the voters' words in a text."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.n = len(words)
        self.trie = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for i, w in enumerate(words):
            by_text.setdefault(w.rstrip("*"), []).append((i, w.endswith("*")))
        for w, who in by_text.items():
            self.trie.add_word(w, (len(w), who))
        if by_text:
            self.trie.make_automaton()

    def features(self, text: str) -> np.ndarray:
        """Voters' hits (0 or 1), style marks, then how many different hits, all hits and hits in a hundred words."""
        x = np.zeros(self.n + len(STYLE) + 3)
        low = text.lower()
        hits, kinds = 0, set()
        for end, (size, who) in self.trie.iter(low) if self.n else ():
            first = end - size + 1
            if first and (low[first - 1].isalnum() or low[first - 1] == "_"):
                continue
            whole = end + 1 == len(low) or not (low[end + 1].isalnum() or low[end + 1] == "_")
            got = False
            for i, open_ in who:
                if open_ or whole:
                    x[i] = 1
                    got = True
            if got:
                hits += 1
                kinds.add(first)
        for k, p in enumerate(STYLE):
            x[self.n + k] = p.search(text) is not None
        x[-3:] = math.log1p(x[: self.n].sum()), math.log1p(hits), min(20.0, 100 * hits / (1 + text.count(" ")))
        return x


def copy_marks(text: str) -> list[int]:
    """Numbers that a text shares with its near copies: of the hashes of its long words the least, the greatest and two between; of a short text itself."""
    h = sorted({zlib.crc32(w.encode()) for w in _WORD.findall(text.lower()) if len(w) >= 7})
    if len(h) < 6:
        return [hash64(("t", text))]
    return [hash64(m) for m in (("a", *h[:2]), ("z", *h[-2:]), ("m", *h[2:4]))]


def hash64(x: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little", signed=True)


def terms_of(text: str) -> set[str]:
    """A text's words and their beginnings, which a trailing * tells from words."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def lift(bad: int, clean: int, n_bad: int, n_clean: int) -> float:
    return (bad + 0.5) / (n_bad + 1) / ((clean + 0.5) / (n_clean + 1))


def pick_voters(counts: dict[str, tuple[int, int]], n_bad: int, n_clean: int) -> list[str]:
    """The lexicon and the terms that tell most; a longer one goes where a shorter does as well. counts: documents by term, toxic and other."""
    good = {t: lift(b, c, n_bad, n_clean) for t, (b, c) in counts.items()}
    good = {t: x for t, x in good.items() if counts[t][0] >= max(4, n_bad // 200) and x >= LEAST_LIFT}
    kept = [t for t in good if not any(good.get(t[:k] + "*", 0) >= 0.5 * good[t] for k in STEMS if k < len(t.rstrip("*")))]
    kept.sort(key=lambda t: (-counts[t][0] * math.log(good[t]), t))
    return list(dict.fromkeys([*LEXICON, *kept]))[:MOST_VOTERS]


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row by its votes, firing rates by class and what each voter shares. gold: the class of a row, -1 where it isn't known.

    Rates and dependences count rows of a known class with it and others with their likelihood in either class, voters that don't fire
    included, in turns until nothing changes. In the posteriors that are returned a voter that doesn't fire abstains: that says nothing.
    """
    known, balance = gold >= 0, gold[gold >= 0].mean()
    p = np.where(known, gold, balance).astype(float)
    rates, shared, post = np.empty((votes.shape[1], 2)), np.zeros(votes.shape[1]), p
    for _ in range(rounds):
        for c, w in enumerate((p, 1 - p)):
            rates[:, c] = (w @ votes + 0.5) / (w.sum() + 1.0)
        rest = votes - p[:, None] * rates[:, 0] - (1 - p)[:, None] * rates[:, 1]
        scale = np.sqrt((rest**2).sum(axis=0) + 1e-9)
        depends = np.clip((rest.T @ rest) / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(depends, 0)
        shared = np.where(depends > LEAST_DEPENDENCE, depends, 0).sum(axis=1)
        prior = min(0.9, max(0.01, float(p.mean())))
        fires, not_ = np.log(rates[:, 0] / rates[:, 1]) / (1 + shared), np.log((1 - rates[:, 0]) / (1 - rates[:, 1])) / (1 + shared)
        odds = math.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(votes @ fires + odds, -30, 30)))
        guess = 1 / (1 + np.exp(-np.clip(votes @ fires + (1 - votes) @ not_ + odds, -30, 30)))
        before, p = p, np.where(known, gold, guess)
        if np.abs(p - before).max() < 1e-6:
            break
    return post, rates, shared


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], penalty)
    reg[-1] = 1e-3
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (s - target) + reg * w
        hess = (x * np.maximum(s * (1 - s), 1e-4)[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def lexicon_model() -> Model:
    words = list(LEXICON)
    return Model(words, np.array([2.0] * len(words) + [0.0] * len(STYLE) + [1.0, 1.0, 0.0, -3.0]))


def fit(words: list[str], x: np.ndarray, gold: np.ndarray) -> Model:
    """x: the features of the sample's texts. A voter more says "none of the words": the only one for clean texts."""
    none = ~x[:, : len(words)].any(axis=1)
    votes = np.hstack([x[:, : len(words) + len(STYLE)], none[:, None]]).astype(float)
    p, rates, shared = label_model(votes, gold)
    return Model(words, fit_linear(x, p), rates, shared)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


MOST_COUNTED = 50_000  # terms that a worker counts before it passes them on


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, bad, clean from (toxic, text): documents with the term, counted in the workers as far as a bounded table goes."""

    def table(counts: dict[str, list[int]]) -> pa.RecordBatch:
        bad, clean = zip(*counts.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(bad, pa.int64()), pa.array(clean, pa.int64())], ["term", "bad", "clean"])

    def run(batches):
        counts: dict[str, list[int]] = {}
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in terms_of(text):
                    counts.setdefault(t, [0, 0])[1 - toxic] += 1
                if len(counts) > MOST_COUNTED:
                    yield table(counts)
                    counts = {}
        if counts:
            yield table(counts)

    return rows.mapInArrow(lean(run), "term string, bad long, clean long")


def _votes(rows: DataFrame, words: list[str]) -> DataFrame:
    """toxic, hits (which voters fired) and the densities of each (toxic, text)."""
    names = ["toxic", "hits", "kinds", "total", "density"]

    def run(batches):
        matcher = Matcher(words)
        for b in batches:
            x = np.array([matcher.features(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
            hits = pa.array([np.flatnonzero(r).tolist() for r in x[:, :-3]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), hits, *(pa.array(x[:, k]) for k in (-3, -2, -1))], names)

    return rows.mapInArrow(lean(run), "toxic int, hits array<int>, kinds double, total double, density double")


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = materialize(known.filter("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(MOST_CLEAN)))
    # Documents without a label take part in the label model, which guesses their class.
    other = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct().join(known, "doc_id", "left_anti")
    picked = picked.unionByName(other.orderBy(*order).limit(MOST_UNLABELLED).withColumn("toxic", F.lit(-1).cast(picked.schema["toxic"].dataType)))
    found = docs.select("doc_id", F.col(text).alias("text")).join(picked, "doc_id").filter("text is not null")
    one = materialize(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    rows = one.select(F.col("toxic").cast("int"), "text")
    if not {0, 1} <= {r["toxic"] for r in rows.select("toxic").distinct().collect()}:
        return lexicon_model()
    # Terms are counted in texts that aren't near copies of one before, in the order of doc_id.
    named = one.filter("toxic >= 0")
    marks = _marks(named)
    first = marks.groupBy("mark").agg(F.min("doc_id").alias("first"))
    copies = marks.join(first, "mark").filter("first <> doc_id").select("doc_id").distinct()
    unlike = materialize(named.join(copies, "doc_id", "left_anti").select(F.col("toxic").cast("int"), "text"))
    n_bad, n_all = unlike.filter("toxic = 1").count(), unlike.count()
    counts = _term_counts(unlike).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean")).filter(f"bad >= {max(4, n_bad // 200)}")
    telling = counts.filter((F.col("bad") + 0.5) / (n_bad + 1) >= 0.99 * LEAST_LIFT * (F.col("clean") + 0.5) / (n_all - n_bad + 1))
    words = pick_voters({r["term"]: (r["bad"], r["clean"]) for r in telling.collect()}, n_bad, n_all - n_bad)

    got = sorted(tuple(r) for r in _votes(rows, words).collect())
    x = np.zeros((len(got), len(words) + len(STYLE) + 3))
    for i, (_, hits, *density) in enumerate(got):
        x[i, hits] = 1
        x[i, -3:] = density
    return fit(words, x, np.array([r[0] for r in got]))


def _marks(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [(i, k) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in copy_marks(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["doc_id", "mark"])

    return rows.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, mark long")


def score_texts(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The columns of docs and one more, named by `out`, which docs must not have."""
    if out in docs.columns:
        raise ValueError(f"the documents have a column {out} already")
    words, weights, at = model.words, model.weights, docs.columns.index(text)
    names = docs.columns

    def run(batches):
        found = Matcher(words)
        for b in batches:
            z = np.array([found.features(t or "") @ weights[:-1] + weights[-1] for t in b.column(at).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(score, pa.float64())], [*names, out])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    workers_import(docs.sparkSession)
    scored = score_texts(docs.select("doc_id", F.col(text).alias("text")), train(docs, labels, text))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
