"""Near-duplicates by bottom-k sketches of word shingles.

A document's set holds the 64-bit hashes of its distinct shingles; its sketch is the
``K`` least of them. Documents link if 100 * intersection >= ``percent`` * union.

Steps
1. Texts are hashed once; equal sets meet by a 128-bit hash and go on as one.
2. Linked sets share at least ``need`` retained values: the number that the sketch of
   their union has in common, but for a chance of ``MISS`` (none where the union has
   at most K values). So two of them share one of their size - need + 1 rarest values,
   and only these are listed. Values of one document alone are listed nowhere, and of
   lists with the same members the rarest stays.
3. Each list compares its members with its first one (whose values are the commonest,
   then the smallest set): one pair a member. A pair goes on if the sketch of the union
   has ``need`` common values, and is then verified on the full sets, which are made
   again for the documents in lists only.
4. Lists that are not one component by now may hold further links. Their documents meet
   once more by the rarest values of their full sets, where the places of a value and
   the sizes tell exactly who can link: near copies that differ from the others in more
   than a link allows leave the common lists. These lists, too, are compared with their
   first members as long as that links any; then the pairs that are left, of different
   components and places and sizes that allow a link, are verified. No link is lost.
5. Links join components; ids follow by the least document.

Defined results
  null or empty text, no words   an empty set, linked with nothing
  fewer words than a shingle     the whole sequence is the one shingle
  very long text                 read whole
  ties in rarity                 by value
  repeated rows                  one row each; equal sets are one component
  null doc_id                    takes part; never a component unless no document of the
                                 component has an id (then null, all of them kept)
  empty table                    empty result
  extra columns                  left out, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp, lgamma

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, small_batches, stored
from .components import components

K = 64
MISS = 1e-9       # chance that a link shares fewer retained values than required
KNOWN = 200_000   # word hashes remembered in a task

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                    0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """The set of a text: sorted distinct hashes."""
    words = text.encode().lower().split() if text else []      # bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        one = codes[k:len(codes) - size + 1 + k]
        total = (total ^ (one >> np.uint64(29)) ^ one) * FACTORS[k % len(FACTORS)] + FACTORS[-1]   # order counts
    total ^= total >> np.uint64(31)
    total *= FACTORS[0]
    return np.unique(total ^ (total >> np.uint64(32)))


@cache
def need(n: int, percent: int) -> int:
    """Retained values that a set of n values shares with every set it links to."""
    def least(union: int) -> int:
        common = -(-percent * union // 100)
        if union <= K:
            return common
        lost, x = 0.0, max(0, K - (union - common))            # hypergeometric, summed from below
        choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
        while True:
            lost += exp(choose(common, x) + choose(union - common, K - x) - choose(union, K))
            if lost > MISS:
                return x
            x += 1
    n = min(n, 1 << 16)                                        # beyond, the chances no longer move
    return max(1, min(least(n), least(n * 100 // percent)))


def sketches(docs: DataFrame, doc: str, text: str, size: int, percent: int) -> DataFrame:
    """(doc, n, need, key, sketch) of every row, written once."""
    small_batches(docs.sparkSession)

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for part in parts:
            rows = []
            for name, body in zip(part["doc"], part["body"]):
                found = shingles(body, size, known)
                rows.append((name, len(found), need(len(found), percent) if len(found) else 0,
                             xxhash.xxh3_128_digest(found.tobytes()), found[:K].view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc", "n", "need", "key", "sketch"])

    kind = docs.select(col(doc)).dtypes[0][1]
    found = (docs.select(col(doc).cast("string").alias("doc"), col(text).alias("body"))
             .mapInPandas(made, "doc string, n long, need int, key binary, sketch array<long>")
             .withColumn("doc", F.col("doc").cast(kind)))
    return stored(found, "bottomk-sketches")


def rarest(values: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, df, rid, n, pos) of values (rid, value) that several documents hold: the
    rarest of each document (rid, n, kept, need) that has ``kept`` values, ``pos`` of
    them rarer, and shares ``need`` of them with all that it links to."""
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = (values.join(shared, "value").groupBy("rid")
           .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("own")))   # of one document
    return (own.join(docs, "rid")
            .select("rid", "n", "need", "kept", F.size("own").alias("shared"), F.posexplode("own").alias("at", "v"))
            .withColumn("pos", F.col("kept") - F.col("shared") + F.col("at"))
            .where("pos <= kept - need").select("v.value", "v.df", "rid", "n", "pos"))


def lists(reps: DataFrame) -> DataFrame:
    """(value, rid, n, pos): documents by their rarest retained values, where lists differ."""
    found = stored(rarest(reps.select("rid", F.explode("sketch").alias("value")),
                          reps.select("rid", "n", "need", F.size("sketch").alias("kept"))), "bottomk-lists")
    each = found.groupBy("value").agg(F.count("*").alias("members"), F.min("df").alias("df"),
                                      F.bit_xor(F.xxhash64("rid")).alias("sig"),
                                      F.bit_xor(F.xxhash64(F.lit(1), "rid")).alias("sig2")).where("members > 1")
    stay = (each.groupBy("members", "sig", "sig2").agg(F.min(F.struct("df", "value")).alias("first"))
            .select("first.value"))
    return stored(found.join(stay, "value").select("value", "rid", "n", "pos"), "bottomk-lists")


def full_sets(docs: DataFrame, doc: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """(rid, hashes) of the wanted sets (rid, doc, key): hashes as packed bytes."""
    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for part in parts:
            found = [shingles(body, size, known).tobytes() for body in part["body"]]
            yield pd.DataFrame({"key": [xxhash.xxh3_128_digest(x) for x in found], "hashes": found})

    some = wanted.select(F.col("doc").alias("id")).distinct()
    source = docs.select(col(doc).alias("doc"), col(text).alias("body"))
    rows = (source.join(some, F.col("doc").eqNullSafe(F.col("id")), "left_semi").select("body")
            .mapInPandas(made, "key binary, hashes binary"))
    return stored(rows.join(wanted.select("rid", "key"), "key").groupBy("rid")
                  .agg(F.first("hashes").alias("hashes")), "bottomk-sets")


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (u, v) whose union sketch has enough common values."""
    one = reps.select(F.col("rid").alias("u"), F.col("sketch").alias("a"), F.col("need").alias("need_u"))
    two = reps.select(F.col("rid").alias("v"), F.col("sketch").alias("b"), F.col("need").alias("need_v"))
    # Sketches order values as unsigned numbers: their bits with the first one turned.
    turned = F.lit(-(1 << 63))
    union = F.slice(F.array_sort(F.transform(F.array_union("a", "b"), lambda x: x.bitwiseXOR(turned))), 1, K)
    common = F.transform(F.array_intersect("a", "b"), lambda x: x.bitwiseXOR(turned))
    return (pairs.join(one, "u").join(two, "v")
            .where(F.size(F.array_intersect(common, union)) >= F.least("need_u", "need_v")).select("u", "v"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that link by their full sets."""
    @F.pandas_udf("boolean")
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            n, m = len(x) // 8, len(y) // 8
            both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64),
                                      assume_unique=True))
            out.append(100 * both >= percent * (n + m - both))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("rid").alias("u"), F.col("hashes").alias("a"))
    two = sets.select(F.col("rid").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(one, "u").join(two, "v").where(link("a", "b")).select("u", "v")


def divided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose members aren't one component, with ``label``."""
    named = members.join(labels, "rid")
    still = (named.groupBy("value").agg(F.min("label").alias("least"), F.max("label").alias("most"))
             .where("least < most").select("value"))
    return stored(named.join(still, "value", "left_semi"), "bottomk-divided")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rid, label) after links (u, v)."""
    one, two = (labels.select(F.col("rid").alias(x), F.col("label").alias(f"label_{x}")) for x in "uv")
    edges = stored(links.join(one, "u").join(two, "v").where("label_u <> label_v")
                   .select(F.greatest("label_u", "label_v").alias("u"), F.least("label_u", "label_v").alias("v"))
                   .distinct(), "bottomk-edges")
    if not edges.limit(1).count():
        return labels
    return stored(labels.join(components(edges), F.col("label") == F.col("node"), "left")
                  .select("rid", F.coalesce("root", "label").alias("label")), "bottomk-labels")


def pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def with_first(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): each member of a list with the list's first one."""
    first = (members.groupBy("value").agg(F.min(F.struct("pos", "n", "rid", "label")).alias("first"))
             .select("value", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("n", "rid", "label")]))
    return (members.join(first, "value").where("label <> first_label")
            .where(100 * F.least("n", "first_n") >= percent * F.greatest("n", "first_n"))
            .select(*pair("rid", "first_rid")).distinct())


def by_full_sets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(value, rid, n, pos, most): the documents of the given lists by the rarest values
    of their full sets.

    Sets of n and m values that link share (n + m) * percent / (100 + percent) of them.
    A document whose value stands at ``pos`` shares at most n - pos values where no rarer
    one is shared, so its partner has ``most`` values at the utmost. Documents for which
    a list has no such partner leave it."""
    def exploded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rid, packed in zip(part["rid"], part["hashes"]):
                yield pd.DataFrame({"rid": rid, "value": np.frombuffer(packed, dtype=np.int64)})

    docs = members.select("rid", "n").distinct()
    values = sets.join(docs.select("rid"), "rid").mapInPandas(exploded, "rid long, value long")
    own = docs.select("rid", "n", F.col("n").alias("kept"), F.ceil(F.col("n") * percent / 100).alias("need"))
    most = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    rows = stored(rarest(values, own).select("value", "rid", "n", "pos", most.alias("most")), "bottomk-full")
    least = rows.groupBy("value").agg(F.min("n").alias("least_n"))
    return stored(rows.join(least, "value").where("most >= least_n").drop("least_n"), "bottomk-full")


def within(rows: DataFrame) -> DataFrame:
    """(u, v): the pairs of each list that may link by their places and sizes."""
    other = rows.select("value", *[F.col(c).alias(f"other_{c}") for c in ("rid", "n", "most", "label")])
    return (rows.join(other, "value")
            .where("rid > other_rid AND label <> other_label AND most >= other_n AND other_most >= n")
            .select(*pair("rid", "other_rid")).distinct())


def joined(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rid, label): the component of every document in a list."""
    def linked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        return merged(labels, verified(stored(pairs, "bottomk-pairs"), sets, percent))

    labels = stored(members.select("rid").distinct().withColumn("label", F.col("rid")), "bottomk-labels")
    labels = linked(estimated(with_first(members.join(labels, "rid"), percent), reps), labels)
    rows, before = by_full_sets(divided(members, labels), sets, percent), None
    while labels is not before:         # first members again, as long as they link any
        before, labels = labels, linked(with_first(divided(rows, labels), percent), labels)
    return linked(within(divided(rows, labels)), labels)


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5,
           percent: int = 80) -> DataFrame:
    """(doc, n, component) per row: component is the least doc reachable over links."""
    prints = sketches(docs, doc, text, shingle, percent)
    reps = stored(prints.where("n > 0").groupBy("key")
                  .agg(F.first(F.struct("doc", "n", "need", "sketch")).alias("r"), F.min("doc").alias("least"))
                  .select(F.monotonically_increasing_id().alias("rid"), "key", "least", "r.*"), "bottomk-reps")
    members = lists(reps)
    wanted = reps.join(members.select("rid").distinct(), "rid", "left_semi").select("rid", "doc", "key")
    labels = joined(members, reps, full_sets(docs, doc, text, shingle, wanted), percent)
    named = reps.join(labels, "rid", "left").select("key", "least", F.coalesce("label", "rid").alias("label"))
    first = named.groupBy("label").agg(F.min("least").alias("component"))
    known = named.join(first, "label").select("key", "component")
    return (prints.join(known, "key", "left")
            .select("doc", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component")))
