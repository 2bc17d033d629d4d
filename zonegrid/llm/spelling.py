"""Groups of spelling variants by blocked Gram matrices.

Words that differ by exactly one inserted, deleted or replaced code point are near. A
word's form is its near word with the most occurrences, if these are ``RATIO`` times its
own; its root is the end of the chain of forms.

Steps
1. Tasks count the words of their texts; Spark adds the counts. Counted are maximal runs
   of Latin letters, A-Z lower-cased.
2. Words of length l and l + 1 make adjacent length blocks. An edit falls in one window
   of letters, and all letters outside it agree: blocks are split by their window and
   the letters outside, at first in halves. Blocks with more than ``ROWS`` words (or
   ``BYTES`` letters) are split again, their window halved, until none is too large or
   the window is a single letter, where the alphabet bounds it. No word is left out.
3. In a block, the product of its letter-count matrix with itself gives squared distances.
   One edit changes one count by one (1), two counts by one (2) or none that are told
   apart (0): pairs at 2 or less stay, and their edit is verified letter by letter. A
   pair is counted in one block alone, that whose window holds the first difference.
4. Blocks return a count and the best near word per word, not pairs; Spark combines them.
5. Forms have ten times the occurrences, so chains are short; each round joins the
   forms with themselves and doubles the steps taken.

Defined results
  null or empty text   no words
  null document id     an empty id
  very long text, run  read whole; a run is one word of any length
  ties                 the form is the smallest word in code-point order
  repeated rows        each row's words count
  empty table          empty result
  extra columns        left out, whatever their names
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, small_batches, stored

RUN = "[a-zÀ-ÿ]+"    # after A-Z became a-z
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
ROWS, BYTES = 1024, 1 << 22    # of a block before it is split
HELD = 200_000                 # words counted in a task before they are sent on
#: Column of the count matrix by code point: a to z, then one for all other letters.
COLUMN = np.array([c - 97 if 97 <= c <= 122 else 26 if c else 27 for c in range(256)])


def words(docs: DataFrame, doc: str = "doc_id", text: str = "text", garble: int | None = None) -> DataFrame:
    """(word, n): words of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences.
    With ``garble``, a run loses a letter where that number divides the crc32 h of
    ``<id>:<run>``: the one at h modulo its length."""
    small_batches(docs.sparkSession)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, least = re.compile(RUN).findall, MIN_LENGTH
        total: Counter = Counter()
        for part in parts:
            for name, body in zip(part["doc"], part["body"]):
                found = Counter(find(body.encode().lower().decode()))   # bytes: A-Z alone
                if garble is None:
                    total.update({w: n for w, n in found.items() if len(w) >= least})
                else:
                    start = zlib.crc32(f"{name}:".encode())
                    for w, n in found.items():
                        if len(w) >= least:
                            h = zlib.crc32(w.encode(), start)
                            if h % garble == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1:]
                                if len(w) < least:
                                    continue
                            total[w] += n
                if len(total) > HELD:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total = Counter()
        yield pd.DataFrame({"word": list(total), "n": list(total.values())}).astype({"word": object, "n": "int64"})

    source = docs.select(F.coalesce(col(doc).cast("string"), F.lit("")).alias("doc"), col(text).alias("body"))
    return (source.where("body is not null").mapInPandas(counted, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))


# ---- blocks ----

KEY = ["base", "a", "b", "rest"]
#: Letters outside the window: a longer word's window has one letter more.
REST = "xxhash64(substring(word, 1, a), substring(word, b + 1 + length(word) - base, length(word)))"


def halves(rows: DataFrame) -> DataFrame:
    """Each window [a, b) of words of length ``base`` cut in two."""
    return (rows.withColumn("w", F.explode(F.expr(
                "array(struct(a, shiftright(a + b, 1) AS b), struct(shiftright(a + b, 1) AS a, b))")))
            .select("word", "n", "base", "w.a", "w.b").withColumn("rest", F.expr(REST)))


def blocks(counts: DataFrame) -> DataFrame:
    """(word, n, base, a, b, rest) of every word in every block it belongs to."""
    whole = counts.select("word", "n", F.explode(F.expr("array(length(word), length(word) - 1)")).alias("base"),
                          F.lit(0).alias("a"), F.col("base").alias("b"))
    level, done = halves(whole), None
    while True:
        large = (level.where("b - a > 1").groupBy(*KEY).agg(F.count("*").alias("size"))
                 .where(f"size > {ROWS} OR size * (base + 1) > {BYTES}").drop("size"))
        large = stored(large, "spelling-large")
        if not large.limit(1).count():
            return level if done is None else done.union(level)
        rest = level.join(large, KEY, "left_anti").select("word", "n", *KEY)
        done = rest if done is None else done.union(rest)
        level = stored(halves(level.join(large, KEY, "left_semi")), "spelling-blocks")


def near_in_block(own: np.ndarray, more: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place among the words of length l, place among all, these first) that are
    one edit apart at a first difference in [a, b). Letters as (words, l + 1) bytes."""
    every = np.concatenate([own, more])
    m, width = every.shape
    cells = COLUMN[every] + 28 * np.arange(m)[:, None]
    counts = np.bincount(cells.ravel(), minlength=28 * m).reshape(m, 28)[:, :27].astype(np.float32)
    square = np.einsum("ij,ij->i", counts, counts)
    distance = square[:len(own), None] + square[None, :] - 2 * (counts[:len(own)] @ counts.T)
    i, j = np.nonzero(distance <= 2)
    i, j = i[i < j], j[i < j]
    size = width - 1
    same = own[i, :size] == every[j, :size]
    begin = np.where(same.all(axis=1), size, same.argmin(axis=1))       # letters alike in front
    back = own[i, size - 1::-1] == np.where((j < len(own))[:, None], every[j, size - 1::-1], every[j, size:0:-1])
    end = np.where(back.all(axis=1), size, back.argmin(axis=1))         # letters alike behind
    edit = np.where(j < len(own), begin + end >= size - 1, begin + end >= size)
    here = edit & (begin >= a) & ((begin < b) | (begin == size) & (b == size))
    return i[here], j[here]


def near(placed: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): partial counts of near words by block."""
    def gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for part in parts:
            part = part if left is None else pd.concat([left, part], ignore_index=True)
            keys = part[KEY].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = int(edges[-1]) if len(edges) else 0
            left = part.iloc[last:]                                     # may go on in the next batch
            yield solve(part["word"].to_numpy(), part["n"].to_numpy(), keys, [0, *edges.tolist()])
        if left is not None and len(left):
            yield solve(left["word"].to_numpy(), left["n"].to_numpy(), left[KEY].to_numpy(), [0, len(left)])

    def solve(text, n, keys, edges):
        out: list[list] = [[], [], [], []]
        for s, e in zip(edges, edges[1:]):
            if e - s < 2:
                continue
            base, a, b = (int(x) for x in keys[s][:3])
            order = np.array(sorted(range(s, e), key=lambda k: len(text[k])))   # own words first
            letters = np.array([text[k].encode("latin-1") for k in order], dtype=f"S{base + 1}")
            letters = letters.view(np.uint8).reshape(len(order), base + 1)
            cut = int((letters[:, base] == 0).sum())
            i, j = near_in_block(letters[:cut], letters[cut:], a, b)
            if not len(i):
                continue
            one, two = np.concatenate([i, j]), np.concatenate([j, i])
            best = sorted(range(len(order)), key=lambda k: (-n[order[k]], text[order[k]]))
            place = np.empty(len(order), dtype=np.int64)
            place[best] = np.arange(len(order))
            top = np.full(len(order), len(order))
            np.minimum.at(top, one, place[two])
            many = np.bincount(one, minlength=len(order))
            for k in np.flatnonzero(many):
                near_to = order[best[top[k]]]
                for column, value in zip(out, (text[order[k]], many[k], n[near_to], text[near_to])):
                    column.append(value)
        return pd.DataFrame(dict(zip(("word", "n_near", "best_n", "best"), out))).astype(
            {"word": object, "n_near": "int64", "best_n": "int64", "best": object})

    found = (placed.repartition(*KEY).sortWithinPartitions(*KEY)
             .mapInPandas(gram, "word string, n_near long, best_n long, best string"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top"))
            .select("word", "n_near", (-F.col("top.minus")).alias("best_n"), "top.best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round takes twice the steps of the last."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                          F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", garble: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    counts = stored(words(docs, doc, text, garble), "spelling-words")
    best = F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best"))
    known = stored(counts.join(near(blocks(counts)), "word", "left")
                   .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           best.alias("form"), F.when(best.isNotNull(), F.col("best_n")).alias("form_n")), "spelling-near")
    ends = roots(known.where("form is not null").select("word", "form"))
    return (known.join(ends, "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
