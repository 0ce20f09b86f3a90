"""Fill-in-the-middle, toxicity and the prefix trie against plain Python, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trellisgraph.llm import fill_in_middle, prefix_trie, toxicity


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def fim(i, t):
    t = t or ""
    h = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, sha(t), sha(t))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return (i, n, form, a, b - a, sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(t))


def test_fill_in_middle(spark):
    r = random.Random(3)
    texts = ["", None, "a", "<", "<P", "x<S>y", "a<M>", "😀éü中文 <", "<<<SP>>>M<P", "w " * 40_000] + ["".join(r.choice("<PSM>aé😀 ") for _ in range(r.randint(0, 12))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "nobody", "x", 1), (3, "<", "x", 1), (3, "<", "x", 1), (-5, "minus", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    got = sorted(map(tuple, fill_in_middle.digest(df).collect()), key=repr)
    assert got == sorted((fim(i, t) for i, t, *_ in rows), key=repr)
    assert {"psm", "spm", "plain"} <= {x[2] for x in got}
    assert fill_in_middle.digest(df.limit(0)).count() == 0


def test_fill_in_middle_between_runs(spark):
    text = "ab  cd1, ef\n\n(gh)"
    cut = fill_in_middle.edges(np.frombuffer(text.encode("utf-32-le"), "<u4"), fill_in_middle.runs).tolist()
    assert [text[a:b] for a, b in zip(cut, cut[1:])] == ["ab", "  ", "cd1", ",", " ", "ef", "\n\n", "(", "gh", ")"]
    df = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    rows = fill_in_middle.transformed(df, F.struct("doc_id"), seed=9, units="runs", apply_percent=100).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(x["back"] == text and x["n"] == len(cut) - 1 and x["prefix_chars"] in cut and x["prefix_chars"] + x["middle_chars"] in cut for x in rows)
    assert len({x["output"] for x in rows}) > 20


SYLLABLES = ["ka", "lo", "mi", "ren", "sta", "tor", "vel", "nu"]


def toxic_rows(n, seed):
    """Half of the toxic texts hold a listed insult, the others words that begin with an invented stem."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(15, 60))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[r.randrange(len(words))] = r.choice(["zorgu", "quixa"]) + r.choice(SYLLABLES) if i % 2 else r.choice(["idiot", "m0ron", "st.u.pid", "LOSER!!"])
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(bad), 1))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_rows(900, 1)
    df = spark.createDataFrame([*docs, (None, "you idiot moron loser", "s"), (5000, None, "s"), (5001, "", "s"), (5001, "", "s"), (5002, "12 ### !!", "s"), (5003, "ka lo " * 30_000, "s")], "doc_id long, text string, score string").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (4, 0, 1), (99_999, 1, 1)], "doc_id long, toxic int, quality int")
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))
    model = toxicity.train(df, known.where(learn))
    rows = toxicity.scored(df, model, F.struct("doc_id", "score")).select("_row.doc_id", "score", "predicted").collect()
    assert len(rows) == len(docs) + 6 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in rows)
    truth = {i: y for i, y, _ in labels}
    held = [x for x in rows if x["doc_id"] in truth and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    hit = [x["predicted"] for x in held if truth[x["doc_id"]]]
    assert sum(hit) / len(hit) > 0.9 and not any(x["predicted"] for x in held if not truth[x["doc_id"]])
    one = {x["doc_id"]: x["predicted"] for x in rows}
    assert one[None] == 1 and not any(one[k] for k in range(5000, 5004))
    assert toxicity.scored(df.limit(0), model, F.struct("doc_id")).count() == 0
    # learnt from a bounded number of rows, and from labels of one kind or none
    assert toxicity.train(df, known, most=60).trees is not None
    for only, want in ((known.where("toxic = 0"), 0.0), (known.where("toxic = 1"), 1.0), (known.limit(0), 0.0)):
        assert {x["score"] for x in toxicity.scored(df, toxicity.train(df, only), F.struct("doc_id")).collect()} == {want}


def test_toxicity_words():
    w = toxicity.tokens(*toxicity.lowered(pa.array(["You 1D10T, st.u.p.i.d!! moron###", "src16 $5 été"])))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == ["you", "idiot", "stupid", "moron", "src", "été"]
    assert w.disguised.tolist()[:4] == [False, True, True, False] and w.text.tolist()[:4] == [0] * 4


def trie_rows(rows):
    """The nodes by their definition."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))] for c, ts in convs.items()}
    rebuilt = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + seq[h:])
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], set()).add(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(1 for x in nodes if len(x) == len(q) + 1 and x[:-1] == q)
        saving = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in members if rebuilt[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids(p), sum(not kids(q) for q in under), saving, sha(ends)))
    return sorted(out, key=repr)


def conversations(seed, n=160):
    r = random.Random(seed)
    said = [None, "", "hi", "how are you", "a b c d e", "x y z", " \t"] + [f"word {k}" for k in range(4)]
    rows = []
    for c in range(-25, n):
        if r.random() < 0.85:
            k = r.choice([1, 1, 2, 3, 4, 6])
            rows += [(c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", None]), r.choice(said[:4] if r.random() < 0.7 else said)) for t in range(k)]
    rows += [(c, t, "user", f"step {t}") for c in range(1000, 1040) for t in range(40)]
    rows += [(c, t, "user", f"grow {t}") for c in range(2000, 2030) for t in range(c - 1990)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_turns", [500_000, 60, 3])
def test_prefix_trie(spark, local_turns):
    rows = conversations(local_turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("code", F.lit("x")).withColumn("seq", F.lit(1)).repartition(5)
    got = sorted(map(tuple, prefix_trie.nodes(df, local_turns).collect()), key=repr)
    assert got == trie_rows(rows)


def test_prefix_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.nodes(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, 0, "user", "only"), (7, 0, "user", "only"), (27, 1, None, None), (40, None, "a", "b")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, prefix_trie.nodes(df).collect()), key=repr) == trie_rows(rows)
