"""Bottom-k near-duplicates: brute force over all pairs, chains, hot passages, edge cases."""

import random
import re

import numpy as np
import pytest

from zonegrid.llm import bottomk, queries

SCHEMA = "doc_id long, text string, doc string, n int, key string"   # clashing names


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in zip(ids, texts)], SCHEMA)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
                seen.add((i, j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str), len(seen)


def got(df):
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)


def texts(seed):
    """Copies with more and more changes, chains, short texts, a passage in many texts."""
    r = random.Random(seed)
    sentence = lambda n: [f"w{r.randint(0, 500)}" for _ in range(n)]
    passage = sentence(60)
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d"]
    for _ in range(12):
        now = sentence(r.choice([8, 30, 80, 200, 700]))
        for _ in range(12):
            out.append(" ".join(now))
            now = list(now)
            for _ in range(r.choice([0, 1, 1, max(1, len(now) // 60)])):
                now[r.randrange(len(now))] = f"z{r.randint(0, 99)}"
    for _ in range(60):
        out.append(" ".join(sentence(r.choice([0, 1, 3, 8, 20, 40])) + passage + sentence(r.choice([0, 2, 5, 20]))))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    rows += [(None, rows[20][1]), (7, rows[30][1]), (7, rows[30][1])]      # null and repeated ids
    want, links = brute(rows)
    assert got(bottomk.groups(frame(spark, [t for _, t in rows], [d for d, _ in rows]), percent=85)) == want
    assert links > 200 and len({w[2] for w in want}) > 40


def test_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
            words[r.randrange(120)] = f"x{r.choice([i, 3])}"      # some changes are shared
        rows.append((i, " ".join(words)))
    want, _ = brute(rows)
    assert got(bottomk.groups(frame(spark, [t for _, t in rows]), percent=85)) == want
    assert 50 < len({w[2] for w in want}) < 350


def test_given_table(spark):
    import pyarrow.parquet as pq
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet")
            .select(["doc_id", "text"]).to_pylist()]
    out = queries.op13_minhash(spark, "/root/testdata/sf0.001")
    want, _ = brute(rows)
    assert got(out.select("doc_id", "n_shingles", "component_id")) == want
    assert {r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect()} == {True}


def test_edges(spark):
    assert bottomk.groups(frame(spark, ["a"]).limit(0)).count() == 0
    long_text = " ".join(f"w{i % 70_001}" for i in range(200_000))
    given = frame(spark, [None, "", long_text, long_text + " end", "solo"], [4, 3, 2, 1, None])
    assert got(bottomk.groups(given)) == sorted([(4, 0, 4), (3, 0, 3), (2, 70_001, 1), (1, 70_002, 1), (None, 1, None)], key=str)


def test_need_is_a_lower_bound():
    """Sets at exactly the least similarity share at least ``need`` retained values."""
    r = np.random.default_rng(1)
    for n in (1, 6, 7, 20, 60, 64, 66, 75, 100, 1000):
        for union in {n, n * 100 // 85}:
            common = -(-85 * union // 100)
            for _ in range(200):
                ids = r.permutation(union * 7)[:union]
                more = r.integers(0, union - common + 1)
                a, b = (set(x) for x in (ids[:common + more], np.r_[ids[:common], ids[common + more:]]))
                assert len(set(sorted(a)[:64]) & set(sorted(b)[:64])) >= min(
                    bottomk.need(len(a), 85), bottomk.need(len(b), 85))
