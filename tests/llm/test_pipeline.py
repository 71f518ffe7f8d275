"""The pipeline on small documents: every stage's decision shows, and clean documents pass."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from barloom.llm import pii  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = text(70)
    docs = {i: text(80) for i in range(40)}
    docs[100] = docs[101] = text(120)  # copies
    docs[102] = docs[100].rsplit(" ", 2)[0]  # a near copy
    docs[103], docs[104] = f"{text(60)} {passage} {text(60)}", f"{text(70)} {passage} {text(50)}"
    docs[105] = text(30) + " write to bosbt.42@mail8.example.com now " + text(30)
    docs[106] = text(20) + " you idiot moron loser scum trash stupid clown pathetic " + text(20)
    docs[107] = None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(106, 1), (0, 0), (1, 0)], "doc_id long, toxic int").filter("doc_id < 100").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.barloom.pii.key", "a key for tests")
    columns, kept = at.columns, {}
    for n, (name, stage) in enumerate(C.STAGES):
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{n}")
        at = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "packing":
            assert at.columns == columns
            kept[name] = {r.doc_id: r.text for r in at.collect()}
    assert set(docs) - set(kept["toxicity"]) == {106}
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {101, 102}
    assert passage not in kept["repeated_passages"][103] and passage not in kept["repeated_passages"][104]
    assert "bosbt.42@mail8" not in kept["personal_data"][105] and "@mail8.example.com" in kept["personal_data"][105]
    assert all(kept["personal_data"][i] == docs[i] for i in range(40))
    assert {r.doc_id for r in at.select("doc_id").distinct().collect()} == set(kept["personal_data"])
    assert at.count() == C.run(spark, str(tmp_path)).count()


def plain_email(name, key="a key for tests"):
    """The pseudonym of an e-mail's local part of at most 20 characters."""
    cut = len(name) // 2
    radix = lambda c: 10 if c.isdigit() else 26 if c.isalpha() else 1
    place = lambda c: int(c) if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 0
    halves, at, size = (name[:cut], name[cut:]), [0, 0], [1, 1]
    for h in (0, 1):
        for c in halves[h]:
            at[h], size[h] = at[h] * radix(c) + place(c), size[h] * radix(c)
    for i in range(pii.ROUNDS):
        h = i % 2
        digest = hashlib.sha256(f"{key}|email/{len(name)}/0|{i}|{at[1 - h]}".encode()).hexdigest()
        at[h] = (at[h] + int(digest[:15], 16)) % size[h]
    out = ""
    for h in (1, 0):
        for c in reversed(halves[h]):
            at[h], k = divmod(at[h], radix(c))
            new = str(k) if c.isdigit() else chr(97 + k) if c.isalpha() else c
            out = (new.upper() if c.isupper() else new) + out
    return out


def plain_run(docs, toxic):
    """Ids of the documents that are left: near copies by brute force, repeats byte by byte, e-mails, the library's ids."""
    docs = {i: t for i, t in docs.items() if i not in toxic}
    words = {i: (t or "").lower().split() for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if root[a] != root[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    docs = {i: t for i, t in docs.items() if root[i] == i}
    data = {i: (t or "").encode() for i, t in docs.items()}
    count = Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for i, b in data.items():
        gone = {q for p in range(len(b) - 199) if count[b[p : p + 200]] > 1 for q in range(p, p + 200)}
        text = bytes(c for q, c in enumerate(b) if q not in gone).decode()
        text = re.sub(r"([A-Za-z0-9][A-Za-z0-9._%+-]*)@", lambda m: plain_email(m[1]) + "@", text)
        out[i] = np.array([*tokens.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
    return out


def test_run_is_a_plain_reading(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = text(70)
    docs = {i: text(rng.randint(1, 150)) for i in range(30)}
    docs |= {30 + i: f"{text(40)} {passage[rng.randint(0, 99) :]} {text(40)}" for i in range(4)}
    docs |= {40 + i: docs[i].rsplit(" ", 1)[0] for i in range(8)} | {50: docs[3], 51: None, 52: ""}
    docs |= {60 + i: f"{text(20)} {name}@mail8.example.com {text(20)}" for i, name in enumerate(("bosbt.42", "Ann_B9", "q7", "x-Y.z10"))}
    docs[70] = text(20) + " you idiot moron loser scum trash stupid clown pathetic " + text(20)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.barloom.pii.key", "a key for tests")
    want, pieces = plain_run(docs, {70}), {}
    for r in C.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (i, r.start, r.doc_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


NAMES = ("score", "_score", "kinds", "__found", "__rest", "__new", "__kinds", "id", "sig", "runs", "__runs", "__id", "__sig", "keys", "node", "component_id", "kept", "shard", "n", "label", "tier")


@pytest.mark.parametrize("odd", [True, False])
def test_every_stage_takes_odd_tables(spark, tmp_path, odd):
    """Repeated rows, null ids and texts, empty and long texts, columns with names that the stages use, no n_chars; and empty tables."""
    from pyspark.sql import functions as F

    text = "a quiet garden by the sea with a bench and a tree under which somebody reads every day until it gets dark"
    rows = [(1, text), (1, text), (1, "other words"), (2, None), (None, text), (None, None), (3, ""), (4, " \n"), (5, "x" * 3000), (6, "write to ann.b@mail8.example.com today"), (7, "word " * 5000), (8, "you idiot moron loser scum trash stupid clown")]
    docs = spark.createDataFrame(rows if odd else [], "doc_id long, text string").withColumns({n: F.lit(i) for i, n in enumerate(NAMES)}).withColumn("extra", F.lit(None).cast("array<int>"))
    labels = spark.createDataFrame([(1, 0), (8, 1), (8, None), (None, 1), (8, 1)] if odd else [], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for n, (name, stage) in enumerate(C.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        if name == "packing":
            assert out.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
            continue
        assert out.columns == docs.columns and (odd or out.count() == 0)
        at = out
    if odd:
        kept = sorted(str(r.doc_id) for r in at.collect())
        assert kept == sorted(map(str, [1, 1, 1, 2, None, None, 3, 4, 5, 6, 7]))
        assert {r.text for r in at.filter("doc_id = 5").collect()} == {""} and "@mail8.example.com" in at.filter("doc_id = 6").first().text
