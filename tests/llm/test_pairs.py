"""Line deduplication, SimHash groups, decontamination: brute force and edge cases."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from zonegrid.llm import components, decontam, linededup, simhash

SCHEMA = "doc_id long, text string, line long, doc string, fp string, words int"   # clashing names
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in zip(ids, texts)], SCHEMA)


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def near_texts(seed=3):
    """Lines with 0 to 2 word edits of each other, short lines, blanks."""
    r = random.Random(seed)
    base = [sentence(r, n) for n in (3, 9, 10, 11, 15, 16, 17, 31, 32, 33, 40) for _ in range(2)]
    out = []
    for _ in range(40):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(base).split()
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(w))
                what = r.choice("rid")
                if what == "r":
                    w[at] = r.choice(WORDS)
                elif what == "i":
                    w.insert(at, r.choice(WORDS))
                elif len(w) > 1:
                    del w[at]
            lines.append(r.choice(["", " ", "\t"]) + " ".join(w) + r.choice(["", "\r", "  "]))
            if r.random() < 0.2:
                lines.append("")
        out.append("\n".join(lines))
    return [None, "", "\n\n", *out, out[5], out[5]]


def one_edit(a, b):
    """Whether two different word lists are one word edit apart: all but one word of
    the longer lies in the common beginning and the common end."""
    n, m = max(len(a), len(b)), min(len(a), len(b))
    if n - m > 1:
        return False
    head = next((i for i in range(m) if a[i] != b[i]), m)
    tail = next((i for i in range(m) if a[-1 - i] != b[-1 - i]), m)
    return head + tail >= n - 1


def brute_lines(texts):
    found = [((d, n), x.strip(" \t\r")) for d, t in enumerate(texts) if t for n, x in enumerate(t.split("\n"))]
    found = [(p, x, x.split(" ")) for p, x in found if x]
    out = set()
    for n, (p, x, w) in enumerate(found):
        for q, y, v in found[:n]:
            if x == y or (min(len(w), len(v)) >= linededup.MIN_WORDS and one_edit(w, v)):
                out.add((*p, *q))
                break
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_match_brute_force(spark, seed):
    texts = near_texts(seed)
    got = {tuple(r)[:4] for r in linededup.duplicates(docs(spark, texts)).collect()}
    want = brute_lines(texts)
    assert got == want and len(want) > 40


def test_lines_leave_rows_and_columns(spark):
    long_line = " ".join(f"w{i}" for i in range(3000))
    texts = [None, "", "a b\n\nc d", "c d\nnew", long_line, long_line.replace("w77 ", "")]
    given = docs(spark, texts, ids=[None, 1, 2, 3, 4, 5])
    out = linededup.dedup(given)
    assert out.columns == given.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {None: None, 1: "", 2: "a b\n\nc d", 3: "new", 4: long_line, 5: ""}
    twice = linededup.dedup(given.union(given)).where("doc_id = 2").collect()
    assert [r.text for r in twice] == ["a b\n\nc d"] * 2      # rows of one id are one document
    assert linededup.dedup(given.limit(0)).count() == 0


def test_many_lines_around_one_template(spark):
    stem = " ".join(WORDS[:12])
    texts = [f"{stem} n{i} end of line" for i in range(300)]
    got = linededup.duplicates(docs(spark, texts)).collect()
    assert len(got) == 299 and {r.kept_doc for r in got} == {0}


def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_simhash_matches_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "One", "one", "ONE\x0btwo", "É é", "a b c", "A\u00a0b c"]
    for _ in range(25):
        w = sentence(r, 200).split()
        texts.append(" ".join(w))
        for _ in range(3):
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts.append(sentence(r, 70_000))   # more than a chunk
    prints = [plain_fingerprint(t) for t in texts]
    want = roots(len(texts), [(a, b) for a, b in combinations(range(len(texts)), 2)
                              if bin(prints[a] ^ prints[b]).count("1") <= 2])
    got = {r.doc: r for r in simhash.groups(docs(spark, texts)).collect()}
    assert [got[i].fp % 2 ** 64 for i in range(len(texts))] == prints
    assert [got[i].component for i in range(len(texts))] == want
    kept = simhash.keep_first(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(want) and kept.columns == docs(spark, texts).columns


def test_simhash_links_everything_within_the_ball(spark):
    r = random.Random(9)
    prints = set()
    for _ in range(40):
        p = r.getrandbits(64)
        for bits in ((), (1,), (1, 63), (2, 5), (2, 5, 9), (0, 63)):
            prints.add(p ^ sum(1 << b for b in bits))
    signed = sorted(p - 2 ** 64 if p >> 63 else p for p in prints)
    want = roots(len(signed), [(a, b) for a, b in combinations(range(len(signed)), 2)
                               if bin((signed[a] ^ signed[b]) % 2 ** 64).count("1") <= 2])
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    root = {r.node: r.root for r in components.components(found).collect()}
    got = [signed.index(root.get(p, p)) for p in signed]
    assert [got.index(g) for g in got] == [want.index(w) for w in want]
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), max_bits=3)


def test_simhash_edges(spark):
    given = docs(spark, ["a b c d", "a b c d", "x"], ids=[None, 4, 7])
    assert {(r.doc, r.component) for r in simhash.groups(given).collect()} == {(None, 4), (4, 4), (7, 7)}
    assert {r.doc_id for r in simhash.keep_first(given).collect()} == {4, 7}
    assert simhash.keep_first(given.union(given)).count() == 4     # rows of one id stay together
    assert simhash.groups(given.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(500, 400)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 500: 400}


def test_masks_hit_every_window_with_two_substitutions():
    for gone in combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.AGREE):
        assert any(all(at + i not in gone for i, bit in enumerate(mask) if bit == "1")
                   for mask in decontam.MASKS for at in range(decontam.WINDOW - len(mask) + 1))


def test_short_masks_hit_every_substitution():
    for size, masks in decontam.SHORT.items():
        for gone in range(size) if decontam.least_agreement(size) < size else [None]:
            assert any(all(at + i != gone for i, bit in enumerate(mask) if bit == "1")
                       for mask in masks for at in range(size - len(mask) + 1)), (size, gone)


def brute_overlaps(texts, items):
    number = {}
    words = [np.array([number.setdefault(w, len(number)) for w in re.findall(r"\w+", (t or "").lower())], dtype=int)
             for t in [*texts, *items]]
    out = set()
    for n, b in enumerate(words[len(texts):]):
        size = min(12, len(b))
        if len(b) < 3:
            continue
        need = 10 if size == 12 else size - 1 if size >= 5 else size
        for d, a in enumerate(words[:len(texts)]):
            if len(a) < size or np.isin(a, b).sum() < need:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(a, size)
            if any(((windows == b[j:j + size]).sum(axis=1) >= need).any() for j in range(len(b) - size + 1)):
                out.add((d, n))
    return out


def test_decontamination_matches_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (40, 30, 25, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1)]
    texts = [None, "", "w1"]
    for item in items[4:]:                       # every place of a short item substituted, and two places
        w = item.split()
        for i in range(len(w)):
            for j in {i, (i + 2) % len(w)}:
                texts.append(" ".join(["before", *("other" if k in (i, j) else x for k, x in enumerate(w)), "after"]))
    for _ in range(150):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        part = r.choice(items).split()
        a = r.randrange(len(part))
        part = part[a:a + r.randint(4, 40)]
        for _ in range(r.randint(0, 4)):
            part[r.randrange(len(part))] = "other"
        at = r.randint(0, len(body))
        texts.append(" ".join(body[:at] + part + body[at:]).title())
    texts.append(" ".join(vocabulary * 3 + items[0].split()))     # very long
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*items, None])], "item_id long, text string, words int")
    given = docs(spark, texts)
    got = {(r.doc, r.item) for r in decontam.overlaps(given, table).collect()}
    want = brute_overlaps(texts, items)
    assert got == want and len(want) > 20
    kept = decontam.clean(given, table)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert kept.columns == given.columns


def test_decontamination_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    table = spark.createDataFrame([(None, item), (5, item), (5, item)], "item_id long, text string")
    given = docs(spark, [item, item, "clean"], ids=[None, 2 ** 60 + 1, 3])
    found = decontam.overlaps(given.union(given), table).collect()
    assert sorted((r.doc or 0, r.item or 0, r.agree, r.start) for r in found) == [
        (0, 0, 13, 0), (0, 5, 13, 0), (2 ** 60 + 1, 0, 13, 0), (2 ** 60 + 1, 5, 13, 0)]
    assert {r.doc_id for r in decontam.clean(given, table).collect()} == {3}
    assert decontam.clean(given, table.limit(0)).count() == 3
    assert decontam.overlaps(given.limit(0), table).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    lines = ["a shared line", "own line one", "own line two", "own line three"]
    texts = ["\n".join([lines[0], lines[1]]), "\n".join([lines[2], lines[0]]), "\n".join([lines[3], "x"])]
    for key in (None, 7):
        out = [r.text for r in linededup.dedup(docs(spark, texts, ids=[key] * 3)).collect()]
        assert sorted("\n".join(out).split("\n")) == sorted([*lines, "x"])   # one copy goes, no other line
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    table = spark.createDataFrame([(5, item)], "item_id long, text string")
    for key in (None, 7):
        kept = decontam.clean(docs(spark, [item, "clean", None], ids=[key] * 3), table).collect()
        assert sorted(r.text or "" for r in kept) == ["", "clean"]
    r = random.Random(4)
    one, two = sentence(r, 200), " ".join(f"v{i}" for i in range(200))
    for key in (None, 7):
        got = simhash.keep_first(docs(spark, [one, two, one + " end"], ids=[key] * 3)).collect()
        prints = [plain_fingerprint(t) for t in (one, one + " end")]
        assert bin(prints[0] ^ prints[1]).count("1") <= 2 and len(got) == 2 and two in {x.text for x in got}
    got = simhash.keep_first(docs(spark, [one, one, two, two], ids=[None, None, 7, 7])).collect()
    assert sorted(x.doc_id or 0 for x in got) == [0, 7, 7]     # rows without id are copies, equal rows of an id one document
