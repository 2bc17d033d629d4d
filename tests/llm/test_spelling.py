"""Spelling variants: brute force over all pairs of words, splitting, edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from zonegrid.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n int, base int, doc string"   # clashing names


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in zip(ids, texts)], SCHEMA)


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, garble=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if garble and h % garble == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        close = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_apart(w, v)]
        form = min(close, key=lambda v: (-counts[v], v), default=None)
        if form is not None and counts[form] < 10 * n:
            form = None
        out[w] = [n, len(close), form, counts.get(form)]
    for w, v in out.items():
        end = w
        while out[end][2] is not None:
            end = out[end][2]
        v.append(end)
    return {w: tuple(v) for w, v in out.items()}


def texts(seed, docs=120):
    """Words with many near words: edits of a few stems, at any place, chains of forms."""
    r = random.Random(seed)
    letters = "abcdeéÀÿ÷z"
    stems = ["".join(r.choice(letters) for _ in range(n)) for n in (6, 7, 7, 8, 9, 9, 13, 14, 20)] + ["aaaaaaa", "abababab"]

    def edit(w):
        at, c = r.randrange(len(w) + 1), r.choice(letters)
        return r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]])
    out = [None, "", "  12 34 ", "X" * 50_000 + " " + "x" * 50_000 + " " + "x" * 49_999 + " " + "X" * 49_999]
    for _ in range(docs):
        line = []
        for _ in range(60):
            w = r.choices(stems, weights=[2 ** k for k in range(len(stems))])[0]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                w = edit(w) or "a"
            line.append(r.choice([w, w.replace("a", "A")]))
        out.append(r.choice([" ", "-", "1", "\n"]).join(line))
    return out


def got(df):
    rows = [(r["word"], (r["n"], r["n_near"], r["form"], r["form_n"], r["root"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("rows", [1024, 6])      # 6: blocks are split down to single letters
def test_matches_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(spelling, "ROWS", rows)
    given = texts(1)
    want = brute(enumerate(given))
    assert got(spelling.variants(frame(spark, given), garble=31)) == want
    assert sum(v[2] is not None for v in want.values()) > 40 and max(v[1] for v in want.values()) > 20
    assert any(v[2] not in (None, v[4]) for v in want.values())   # a chain of two forms


def test_blocks_find_every_pair_once():
    r = random.Random(2)
    own = sorted({"".join(r.choice("abc") for _ in range(7)) for _ in range(300)})
    more = sorted({"".join(r.choice("abc") for _ in range(8)) for _ in range(300)})
    array = lambda x: np.array([w.encode() for w in x], dtype="S8").view(np.uint8).reshape(len(x), 8)
    every = own + more
    want = {(w, v) for n, w in enumerate(own) for v in every[n + 1:] if one_apart(w, v)}
    found = [(own[i], every[j]) for a, b in ((0, 2), (2, 3), (3, 7))
             for i, j in zip(*spelling.near_in_block(array(own), array(more), a, b))]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 400


def test_given_table(spark):
    import pyarrow.parquet as pq
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet")
            .select(["doc_id", "text"]).to_pylist()]
    assert got(queries.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_edges(spark):
    assert spelling.variants(frame(spark, ["a"]).limit(0)).count() == 0
    assert spelling.variants(frame(spark, [None, "", "short words"])).count() == 0
    rows = got(spelling.variants(frame(spark, ["Sentence sentence"] * 3 + ["sentenca " * 2], [None, 1, 1, 2])))
    assert rows == {"sentence": (6, 1, None, None, "sentence"), "sentenca": (2, 1, None, None, "sentenca")}
    ties = got(spelling.variants(frame(spark, ["wordone " * 2 + "wordona " * 20 + "wordonb " * 20])))
    assert ties["wordone"] == (2, 2, "wordona", 20, "wordona")
