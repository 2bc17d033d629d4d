"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit set if it is set in over half of the hashes
(XXH64, seed 42) of its word shingles, repeats included. Fingerprints link at
``max_bits`` or fewer differing bits; ``max_bits`` is even. Each distinct
fingerprint emits every variant within max_bits / 2 bits: two fingerprints link
exactly if they share a variant, half way between them. Variants are shuffled;
all fingerprints of a variant are within max_bits of each other, so each is
linked to the least one (verified by its differing bits) and no group is expanded
into pairs. A variant has at most 1 + 64 (max_bits 2) fingerprints.

Defined results
  null or empty text, no words   fingerprint zero, linked like any other
  fewer words than a shingle     the whole sequence is the one shingle
  very long text                 read whole, in chunks
  ties (a bit set in exactly half)   not set
  repeated rows                  one row each, with the same fingerprint and
                                 component; in ``keep_first`` equal rows of a
                                 doc_id stay or go together, others go by themselves
  null doc_id                    takes part; never a component_id unless no
                                 document of the group has an id; ``keep_first``
                                 then keeps one row
  empty table                    empty result
  extra columns                  kept by ``keep_first``, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import col, free_name, row_key, small_batches, stored
from .components import components

SEED = 42
CHUNK = 1 << 16   # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = text.encode().lower().split() if text else []   # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    shingle = min(shingle, len(words))
    parts = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts),
                         dtype=">u8", count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc, fp) per row, written once: texts are read and hashed one time."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return stored(docs.select(col(doc).alias("doc"), of(col(text)).alias("fp")), "simhash")


def ball(radius: int) -> list[int]:
    """The bit masks of at most ``radius`` bits, as signed integers."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v), u > v: linked fingerprints, enough of the links to join every group."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: variants meet half way")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(max_bits // 2)])
    near = (distinct.select("fp", F.explode(masks).alias("mask"))
            .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
            .withColumn("least", F.min("fp").over(W.partitionBy("variant"))))
    return (near.where((F.col("fp") > F.col("least"))
                       & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= max_bits))
            .select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct())


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3,
           max_bits: int = 2) -> DataFrame:
    """(doc, fp, component): component is the least doc reachable over links."""
    prints = fingerprints(docs, doc, text, shingle)
    distinct = prints.groupBy("fp").agg(F.min("doc").alias("first"))
    linked = components(links(distinct, max_bits))
    rooted = (distinct.join(linked, distinct["fp"] == linked["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return prints.join(named, "fp").select("doc", "fp", "component")


def keep_first(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3,
               max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group: the one of the least id, then of the
    least hash of its text."""
    mark, key = free_name(docs, "simhash_row"), row_key(doc, text)
    rows = docs.select(F.struct(col(doc).isNull().alias("none"), col(doc).alias("doc"), key.alias("row")).alias(mark),
                       col(text))
    stay = stored(groups(rows, mark, text, shingle, max_bits).where(F.col("doc") == F.col("component"))
                  .select(F.col("doc.row").alias(mark)).distinct(), "simhash-rows")
    named = docs.where(col(doc).isNotNull()).join(stay, key == col(mark), "left_semi")
    bare = docs.where(col(doc).isNull()).join(stay, key == col(mark)).dropDuplicates([mark]).drop(mark)
    return named.unionByName(bare)
