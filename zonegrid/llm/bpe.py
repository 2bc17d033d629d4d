"""Byte-level BPE over a global shuffle of distinct words.

A text is split by ``pattern``; each match (a pre-token, here a word) is merged by
ranks on its own. A word's ids don't depend on where it stands, so each distinct
word is encoded once for the whole table:

1. Runs of documents (about ``CHUNK`` characters) turn into word numbers in text
   order, and a list of the run's distinct words, dealt into buckets by their hash.
   Both travel packed: at scale the shuffles move about as much as the input.
2. The words are shuffled by bucket; equal words of all runs meet in one task,
   which merges each of them once.
3. The ids go back to their run, and every document is put together by position.

The documents are read twice (for words, then for positions), so ``docs`` has to
come from files or a checkpoint. A run is named by the hash of all it holds: if
the second read differs from the first, the join fails with an error, never
with wrong ids. A word occurs once per run and bucket, so a word in a third of
all text is no hot key.

Decoding looks the ids up in the broadcast token-byte table, which is as large as
the vocabulary, whatever the input (see README).

Defined results
  null or empty text    no ids; decodes to no bytes
  very long text        a run of its own, encoded whole; long words take
                        n log n steps
  ties                  the leftmost of the pairs of least rank merges first
  repeated rows         one result row each
  null document ids     rows like others
  empty table           empty result
  extra columns         not carried: results have the id, and the ids or bytes
  unknown ids           decoding an id that the vocabulary lacks is an error
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, small_batches

CHUNK = 4_000_000         # characters of a run of documents
SHORT = 48                # bytes of a word that is merged without a heap
VOCABULARY = 64 << 20     # most bytes of ranks that may be broadcast


def load_ranks(path: str) -> dict[bytes, int]:
    """The token -> rank table of a ``.tiktoken`` file (a token in base64 and its rank a line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if sum(map(len, ranks)) + 100 * len(ranks) > VOCABULARY:
        raise ValueError(f"the vocabulary is over {VOCABULARY} bytes: too large to broadcast")
    return ranks


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merge`` of few bytes, where looking through all pairs is faster than a heap."""
    none, rank = float("inf"), ranks.get
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [rank(word[i:i + 2], none) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: adjacent parts of least rank merge until none is in the table."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= SHORT:
        return merge_short(word, ranks)
    ends, prev = list(range(1, n + 1)), list(range(-1, n - 1))   # part i is word[i:ends[i]]
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if ends[i] < 0 or ends[i] == n or ends[ends[i]] != end:
            continue   # one of the two parts has merged since
        gone, ends[i] = ends[i], end
        ends[gone] = -1
        if end < n:
            prev[end] = i
            pair = word[i:ends[end]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, ends[end]))
        if i:
            before = prev[i]
            pair = word[before:end]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], before, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:ends[i]]])
        i = ends[i]
    return ids


def numbered() -> defaultdict:
    """word -> its number, in order of first appearance."""
    return defaultdict(count().__next__)


def packed(numbers: np.ndarray) -> bytes:
    """The bytes of small numbers, the low ones apart from the high ones."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def blanks_alone(pieces: list[str]) -> bool:
    """Whether every blank between the pieces of a text stands between characters that
    aren't white space, and none is at an end of the text."""
    return "" not in pieces and list(map(str.strip, pieces)) == pieces


def runs(parts: Iterator[pd.DataFrame], pattern: str, positions: bool = True) -> Iterator[tuple]:
    """(name, docs, words per doc, word numbers, words) of successive runs; without
    ``positions`` no word numbers.

    No match of the known pattern goes on beyond a non-blank character that a blank
    follows, and none depends on what comes before. So a blank between two characters
    that aren't white space always begins a match: texts are cut there, and each distinct
    piece of a run is matched once, with its blank. A text with other blanks, or any
    text under another pattern, is matched whole."""
    split = regex.compile(pattern)
    cut = pattern == public_tokenizers.PATTERN
    size, name = 0, xxhash.xxh3_128()
    docs, texts, words, pieces, firsts = [], [], numbered(), numbered(), numbered()

    def numbers_of(body: str) -> np.ndarray:
        return np.array(list(map(words.__getitem__, split.findall(body))), dtype=np.uint32)

    def done():
        """Word numbers of the run: those of the distinct pieces, put in their places."""
        # The distinct pieces, a blank before each, are one text: a piece has no other
        # blank, so that its matches go from one that begins with a blank to the next.
        found = split.findall(" " + " ".join(pieces)) if pieces else []
        begins = np.flatnonzero([word[0] == " " for word in found])
        each = [numbers_of(first) for first in firsts]
        sizes = np.concatenate([np.diff(begins, append=len(found)), [len(x) for x in each]]).astype(np.int64)
        numbers = np.concatenate([np.array(list(map(words.__getitem__, found)), dtype=np.uint32), *each])
        begins, counts, codes = np.cumsum(sizes) - sizes, [], []
        for first, own in texts if positions else ():
            if first is not None:
                own = np.concatenate([[len(pieces) + first], own]).astype(np.int64)
                long = sizes[own]
                start = np.cumsum(long) - long
                own = numbers[np.repeat(begins[own] - start, long) + np.arange(int(long.sum()))]
            counts.append(len(own))
            codes.append(own)
        return (name.hexdigest(), docs, counts,
                np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32), list(words))

    for part in parts:
        for doc, text in zip(part["doc"].tolist(), part["body"]):
            text = text or ""
            docs.append(doc)
            first, own = None, text.split(" ") if cut else []
            if cut and blanks_alone(own):
                first, own = firsts[own[0]], list(map(pieces.__getitem__, own[1:]))
            else:
                own = list(map(words.__getitem__, split.findall(text)))
            if positions:
                texts.append((first, np.array(own, dtype=np.uint32)))
            name.update(repr((doc, len(text))).encode() + text.encode())
            size += len(text)
            if size >= CHUNK:
                yield done()
                docs, texts, words, pieces, firsts = [], [], numbered(), numbered(), numbered()
                size, name = 0, xxhash.xxh3_128()
    if docs:
        yield done()


def bucket_of(words: list[str], buckets: int) -> np.ndarray:
    return np.array(list(map(zlib.crc32, map(str.encode, words))), dtype=np.int64) % buckets


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(doc, ids array<int>) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.sparkContext.broadcast(ranks)   # at most VOCABULARY bytes
    kind = docs.select(col(doc)).dtypes[0][1]
    # As text, ids stay whole on their way through pandas, nulls included.
    source = docs.select(col(doc).cast("string").alias("doc"), col(text).alias("body"))

    def vocabularies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, _, _, _, words in runs(parts, pattern, positions=False):
            at = bucket_of(words, buckets)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                own = [words[i].encode() for i in order[edges[b]:edges[b + 1]]]
                if own:
                    sizes = packed(np.array([len(w) for w in own]))
                    rows.append((name, b, sizes, zstandard.ZstdCompressor(level=3).compress(b"".join(own))))
            yield pd.DataFrame(rows, columns=["run", "bucket", "sizes", "words"]).astype({"bucket": "int32"})

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, list[int]] = {}
        for part in parts:
            rows = []
            for run, b, sizes, blob in part[["run", "bucket", "sizes", "words"]].itertuples(index=False):
                ends = np.cumsum(unpacked(sizes)).tolist()
                body = zstandard.ZstdDecompressor().decompress(blob)
                ids = []
                for a, e in zip([0, *ends], ends):
                    word = body[a:e]
                    if word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[word] = merge(word, table.value)
                    ids.append(known[word])
                rows.append((run, b, packed(np.array([len(x) for x in ids])),
                             packed(np.array([i for x in ids for i in x]))))
            yield pd.DataFrame(rows, columns=["run", "bucket", "sizes", "ids"]).astype({"bucket": "int32"})

    def positions(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, names, counts, codes, words in runs(parts, pattern):
            yield pd.DataFrame({"run": [name], "docs": [names], "counts": [packed(np.array(counts))],
                                "codes": [packed(codes)], "buckets": [packed(bucket_of(words, buckets))]})

    def assemble(words: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if len(texts) and not len(words) and any(len(unpacked(x)) for x in texts["buckets"]):
            raise ValueError("the documents changed between two reads: write them to files first")
        out_docs, out_ids = [], []
        words = words.drop_duplicates("bucket").sort_values("bucket")   # equal runs send equal words
        sizes = np.concatenate([unpacked(x) for x in words["sizes"]] or [np.zeros(0, dtype=np.int64)])
        ids = np.concatenate([unpacked(x) for x in words["ids"]] or [np.zeros(0, dtype=np.int64)])
        begins = np.cumsum(sizes) - sizes
        for names, counts, codes, at in texts[["docs", "counts", "codes", "buckets"]].itertuples(index=False):
            order = np.argsort(unpacked(at), kind="stable")   # as the words were dealt
            size, begin = np.empty_like(sizes), np.empty_like(begins)
            size[order], begin[order] = sizes, begins
            codes, stop = unpacked(codes), 0
            for d, n in zip(names, unpacked(counts).tolist()):
                own = codes[stop:stop + n]
                stop += n
                long = size[own]
                first = np.cumsum(long) - long
                take = np.repeat(begin[own] - first, long) + np.arange(int(long.sum()))
                out_docs.append(d)
                out_ids.append(ids[take].astype(np.int32))
        return pd.DataFrame({"doc": out_docs, "ids": out_ids})

    words = (source.mapInPandas(vocabularies, "run string, bucket int, sizes binary, words binary")
             .repartition(buckets // 2, "bucket")
             .mapInPandas(encoded, "run string, bucket int, sizes binary, ids binary"))
    texts = source.mapInPandas(
        positions, "run string, docs array<string>, counts binary, codes binary, buckets binary")
    return (words.groupBy("run").cogroup(texts.groupBy("run"))
            .applyInPandas(assemble, "doc string, ids array<int>")
            .select(F.col("doc").cast(kind).alias("doc"), "ids"))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``encoded`` with a binary column ``out``: the bytes of the ids."""
    small_batches(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(   # at most VOCABULARY bytes
        {i: token for token, i in ranks.items()})

    @F.pandas_udf("binary")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = table.value.__getitem__
        for rows in parts:
            yield pd.Series([b"".join(map(token, x.tolist())) if x is not None else b"" for x in rows],
                            dtype=object)

    return encoded.withColumn(out, joined(col(ids)))


def summary(coded: DataFrame) -> DataFrame:
    """(doc, n_tokens, ids, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return coded.select("doc", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
                        .alias("ids_sha256"),
                        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))
