"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased word sequences. A document holds an item of the benchmark
if some ``WINDOW`` = 12 aligned words agree in at least ``AGREE`` = 10 places: up
to two words of them may be substituted. Items of 5 to 11 words are aligned as a
whole and may have one word substituted; items of 3 and 4 words must occur whole.
One or two words tell nothing and are never found.

Steps
1. Every position of every item is hashed under the ``MASKS``; a 0 in a mask is a
   word that doesn't count. Together the masks hit every window of twelve with
   any two substitutions (tests check all 66). Items under twelve words have
   shorter masks, which hit them with any one substitution (tests check all).
2. Documents are hashed alike. A bitmap of the item hashes (two probes; at most
   ``MAX_BITS`` whatever the benchmark's size) drops most seeds at once; it only
   spares work. What passes is kept with the words around it, once a cluster.
3. Document seeds and item seeds are joined in Spark on the hash; each hit names
   a diagonal (document place minus item place). The diagonals of a cluster and item
   travel together, so that the words around them go once for all.
4. Each (cluster, item) is verified on the words along its diagonals.

Defined results
  null or empty text        holds nothing; as an item, is never found
  very long text            read whole; clusters are cut after ``CUT`` words, with
                            the words around a window on both sides
  ties                      of equal overlaps the earliest place counts
  repeated rows             rows of a doc_id count as one document; rows of an
                            item_id as one item (any of its texts)
  null doc_id / item_id     are documents / items like others; ``clean`` judges every
                            row by its own text, whatever shares its doc_id
  empty tables              empty result; ``clean`` then keeps all
  extra columns             kept by ``clean``, whatever their names
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, row_key, small_batches, stored

#: Spaced seeds, found by search: all 12-word windows with any 2 substitutions are hit.
MASKS = ("11101011", "101100111", "111111")
WINDOW, AGREE = 12, 10
REACH = 16          # words kept on both sides of a cluster: more than a window beyond a seed
CUT = 4096          # words after which a cluster is cut
KNOWN = 65_536      # words whose hashes a task remembers: some 10 MB
MIN_BITS, MAX_BITS = 20, 27   # size of the bitmap as a power of two: 128 KB to 16 MB

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)   # fixed value: 2^64 / golden ratio, odd
#: By item length: half the words stand before or after one substitution; of five words,
#: where half would be two, three in a row or the four around the middle.
SHORT = {3: ("111",), 4: ("1111",), 5: ("111", "11011"), 6: ("111",), 7: ("111",), 8: ("1111",), 9: ("1111",),
         10: ("11111",), 11: ("11111",)}
ALL_MASKS = (*MASKS, *sorted({m for masks in SHORT.values() for m in masks}))


def least_agreement(size: int) -> int:
    """Agreeing words that an aligned window of ``size`` words needs."""
    return AGREE if size == WINDOW else size - 1 if size >= 5 else size


class Hashes(dict):
    """word -> 64-bit hash; forgets all when it has too many words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


def word_hashes(text: str | None, known: Hashes) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.array([known[w] for w in words], dtype=np.uint64)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash at every place where the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, int(mask, 2) * 2 + 1, dtype=np.uint64) * MIX
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[i:i + n]) * MIX
            out ^= out >> np.uint64(29)
    return out


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bitmap of 2^bits."""
    low = np.uint64((1 << bits) - 1)
    return h & low, (h >> np.uint64(64 - bits)) & low


def item_seeds(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words array<long>, hash, at): the seeds of each item."""
    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for part in parts:
            rows = []
            for name, body in zip(part["item"], part["body"]):
                h = word_hashes(body, known)
                masks = MASKS if len(h) >= WINDOW else SHORT.get(len(h), ())
                for mask in masks:
                    rows += [(name, h.view(np.int64), s, i)
                             for i, s in enumerate(seeds(h, mask).view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item", "words", "hash", "at"]).astype({"at": "int32"})

    # As text, ids stay whole on their way through pandas, nulls included.
    return (items.select(col(item).cast("string").alias("item"), col(text).alias("body"))
            .mapInPandas(make, "item string, words array<long>, hash long, at int"))


def bitmap(item_hashes: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, packed bitmap): at most 2^MAX_BITS bits reach the driver, in words of 64."""
    n = item_hashes.count()
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(32 * max(1, n))))))
    low = (1 << bits) - 1
    place = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(low)),
                              F.shiftrightunsigned("hash", 64 - bits).bitwiseAND(F.lit(low))))
    words = (item_hashes.select(place.alias("place"))
             .groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")).toPandas())
    packed = np.zeros(1 << (bits - 6), dtype=np.uint64)
    packed[words["word"].to_numpy(dtype=np.int64)] = words["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits, packed


def clusters(docs: DataFrame, doc: str, text: str, bits: int, packed: np.ndarray) -> DataFrame:
    """(doc, cluster, start, words, hash, at): document words around seeds that pass
    the bitmap. ``at`` counts from the start of the document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(packed)   # at most 16 MB, see MAX_BITS

    def there(place: np.ndarray) -> np.ndarray:
        return (shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    def hits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, places = [], []
        for mask in ALL_MASKS:
            s = seeds(h, mask)
            one, two = probes(s, bits)
            at = np.flatnonzero(there(one))
            at = at[there(two[at])]
            found.append(s[at])
            places.append(at)
        found, places = np.concatenate(found), np.concatenate(places)
        order = np.argsort(places, kind="stable")
        return found[order], places[order]

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for part in parts:
            each = [word_hashes(t, known) for t in part["body"]]
            ends = np.cumsum([len(h) for h in each])
            all_words = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
            found, places = hits(all_words)   # seeds across two documents fail the join or the check
            owner = np.searchsorted(ends, places, side="right")
            names, rows, row = part["doc"].tolist(), [], 0
            while row < len(places):
                o = owner[row]
                first, end = ends[o] - len(each[o]), ends[o]
                last = row + 1
                while (last < len(places) and owner[last] == o and places[last] - places[last - 1] <= REACH
                       and places[last] - places[row] < CUT):
                    last += 1
                a = max(first, places[row] - REACH)
                b = min(end, places[last - 1] + WINDOW + REACH)
                rows.append((names[o], int(places[row] - first), int(a - first), all_words[a:b].view(np.int64),
                             found[row:last].view(np.int64), (places[row:last] - first).astype(np.int32)))
                row = last
            yield pd.DataFrame(rows, columns=["doc", "cluster", "start", "words", "hash", "at"]).astype(
                {"cluster": "int32", "start": "int32"})

    return (docs.select(col(doc).cast("string").alias("doc"), col(text).alias("body")).mapInPandas(
        make, "doc string, cluster int, start int, words array<long>, hash array<long>, at array<int>"))


def agreement(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(agreeing words, words, first word) of the windows that pass on a diagonal:
    word i of the document lies at word i - shift of the item."""
    a, b = max(0, shift), min(len(words), len(item) + shift)
    size = min(WINDOW, len(item))
    if b - a < size:
        return None
    same = words[a:b] == item[a - shift:b - shift]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[size:] - total[:-size] >= least_agreement(size))
    if not len(good):
        return None
    inside = np.zeros(len(same) + 1, dtype=np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + size, -1)
    inside = np.cumsum(inside)[:-1] > 0
    return int(same[inside].sum()), int(inside.sum()), int(a + good[0])


def overlaps(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id",
             text: str = "text") -> DataFrame:
    """(doc, item, agree, words, start): the largest overlap of each pair that has one."""
    made = stored(item_seeds(items, item, text), "items")
    bits, packed = bitmap(made.select("hash").distinct())
    found = stored(clusters(docs, doc, text, bits, packed), "clusters")
    pairs = (found.select("doc", "cluster", F.explode(F.arrays_zip("hash", "at")).alias("s"))
             .select("doc", "cluster", F.col("s.hash").alias("hash"), F.col("s.at").alias("doc_at"))
             .join(made.select("hash", "item", F.col("at").alias("item_at")), "hash")
             .groupBy("doc", "cluster", "item")
             .agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts")))
    bodies = made.select("item", "words").distinct().withColumnRenamed("words", "item_words")
    places = found.select(F.col("doc").alias("d"), F.col("cluster").alias("c"), "start", "words").distinct()
    joined = (pairs.join(places, pairs["doc"].eqNullSafe(places["d"]) & (pairs["cluster"] == places["c"]))
              .drop("d", "c")
              .join(bodies.withColumnRenamed("item", "i"), pairs["item"].eqNullSafe(F.col("i"))).drop("i"))

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for d, i, shifts, start, words, body in part[
                    ["doc", "item", "shifts", "start", "words", "item_words"]].itertuples(index=False):
                words, body = np.asarray(words), np.asarray(body)
                found = [agreement(words, body, int(shift) - start) for shift in shifts]
                rows += [(d, i, got[0], got[1], start + got[2]) for got in found if got]
            yield pd.DataFrame(rows, columns=["doc", "item", "agree", "words", "start"]).astype(
                {"agree": "int32", "words": "int32", "start": "int32"})

    kinds = docs.select(col(doc)).dtypes[0][1], items.select(col(item)).dtypes[0][1]
    best = F.max(F.struct("agree", "words", (-F.col("start")).alias("back"))).alias("best")
    return (joined.mapInPandas(verify, "doc string, item string, agree int, words int, start int")
            .groupBy("doc", "item").agg(best)
            .select(F.col("doc").cast(kinds[0]).alias("doc"), F.col("item").cast(kinds[1]).alias("item"),
                    "best.agree", "best.words", (-F.col("best.back")).alias("start")))


def clean(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id",
          text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    mark = free_name(docs, "leaked_row")
    rows = docs.select(row_key(doc, text).alias(mark), col(text))
    leaked = overlaps(rows, items, mark, item, text).select(F.col("doc").alias(mark)).distinct()
    return docs.join(leaked, row_key(doc, text) == col(mark), "left_anti")
