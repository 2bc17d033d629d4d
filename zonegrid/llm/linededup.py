"""Line deduplication by a deletion-neighbourhood join. DataFrame functions only.

A line (trimmed, blank lines apart) is a list of words, parted by single blanks.
Two lines match if their texts are equal, or if both have at least ``MIN_WORDS``
words and their word edit distance is 1: one word replaced, added or left out.
A line goes if a line that matches it stands earlier, by (doc_id, line number);
it names the earliest such line. A line that goes can still be the earlier one.

Steps
1. Equal lines meet by a 128-bit hash, with map-side combining: one row a text.
2. Block. With one edit, the first or the last p words stay as they are as long
   as 2p + 1 words are there. p follows from the power of two below the word
   count, so it is between a quarter and half of the line; a line just at a power
   of two takes part in the class below as well. Lines that share neither
   beginning nor end with another text can't match and emit nothing.
3. The others emit every variant with one word deleted, where the shared end
   leaves room for an edit, and themselves, as hashed keys. Equal variants join; members of a key are compared with its
   earliest line only, apart by the place of the deleted word, so that no group
   is expanded into pairs.
4. The word edit distance of each such pair is verified on the texts.

Defined results
  null text, blank lines   no lines to compare; blank lines always stay
  very long text or line   compared whole
  repeated rows            rows with the same doc_id and line number are one
                           position: the earliest position stays in each of them
  null doc_id              sorts before all others
  rows that share an id    are one document to ``duplicates``; to ``dedup`` only equal
                           rows are, the others follow each other by a hash
  empty table              empty result
  extra columns            kept by ``dedup``, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, row_key, stored

ENDS = [(k, side, name) for k in ("p0", "p1") for side, name in ((1, "head"), (-1, "tail"))]
MIN_WORDS = 10   # one edit in ten words: lines below match only if equal


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line, h1, h2) of every line that isn't blank."""
    raw, blanks = F.col("raw"), [" ", "\t", "\r"]
    at_ends = F.left(raw, F.lit(1)).isin(blanks) | F.right(raw, F.lit(1)).isin(blanks)
    line = F.when(at_ends, F.btrim(raw, F.lit("".join(blanks)))).otherwise(raw)   # trimming is dear
    return (docs.select(col(doc).alias("doc"), F.posexplode(F.split(col(text), "\n")).alias("line_no", "raw"))
            .select("doc", "line_no", line.alias("line"))
            .where(F.col("line") != "")
            .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))}))


def distinct_lines(found: DataFrame) -> DataFrame:
    """One row a text, without the text, written once: h1, h2, copies, first (struct doc,
    line_no) and, for longer lines, p0 and p1 and the hashes of the first and last p words."""
    words = F.expr("size(split(line, ' '))")
    counted = (found.withColumn("words", words)
               .withColumns({k: F.when(F.col("words") >= MIN_WORDS, half(f"words - {i}"))
                             for i, k in enumerate(("p0", "p1"))})
               .withColumn("p1", F.when(F.col("p1") != F.col("p0"), F.col("p1"))))
    hashed = counted.withColumns({f"{k}_{name}": F.expr(
        f"IF({k} IS NULL, NULL, xxhash64({side}, {k}, substring_index(line, ' ', {side} * {k})))")
        for k, side, name in ENDS})
    same = ["p0", "p1", *[f"{k}_{name}" for k, _, name in ENDS]]
    return stored(hashed.groupBy("h1", "h2").agg(
        F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("copies"),
        *[F.first(c).alias(c) for c in same]), "distinct-lines")


def block_keys(texts: DataFrame) -> DataFrame:
    """(h1, h2, block, side, p): hashes of the first p and the last p words of each
    longer line; side is 1 or -1."""
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.col(k).alias("p"), F.col(f"{k}_{name}").alias("block"))
                     for k, side, name in ENDS])
    return (texts.where("p0 IS NOT NULL").select("h1", "h2", F.inline(ends)).where("block IS NOT NULL")
            .select("h1", "h2", "block", "side", "p"))


def half(words: str) -> Column:
    """p of a line with so many words: a power of two less one, 2p + 1 <= words."""
    return F.expr(f"shiftleft(1, length(bin({words})) - 2) - 1")


def candidates(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2, pos, line, after, before): the texts that share a block with another
    text, at their first place. An edit stands at word ``after`` or later, or at
    least ``before`` words from the end (null: that end isn't shared). Only here do
    texts move; they are written once."""
    keys = block_keys(texts)
    shared = (keys.groupBy("block").agg(F.min("h1").alias("least"), F.max("h1").alias("most"))
              .where("least <> most").select("block"))
    some = (keys.join(shared, "block", "left_semi")
            .groupBy("h1", "h2").agg(F.min(F.when(F.col("side") > 0, F.col("p"))).alias("after"),
                                     F.min(F.when(F.col("side") < 0, F.col("p"))).alias("before")))
    places = (texts.join(some, ["h1", "h2"])
              .select("first", F.col("h1").alias("g1"), F.col("h2").alias("g2"), "after", "before"))
    same = F.xxhash64("line").bitwiseXOR(F.col("g1")) == 0   # rows of one doc_id may differ
    at = found["doc"].eqNullSafe(F.col("first.doc")) & (found["line_no"] == F.col("first.line_no"))
    return stored(found.select("doc", "line_no", "line").join(places, at & same)
                  .select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("first").alias("pos"),
                          "line", "after", "before"), "lines")


def variants(cand: DataFrame) -> DataFrame:
    """(pos, gap, key): the hash of the line without its word number ``gap``, where an
    edit can stand; gap -1 is the line itself. A hash runs on from one array to the
    next, so the words before and after the gap hash like the list without it."""
    gaps = F.expr("filter(sequence(-1, size(words) - 1), g -> g = -1 OR coalesce(g >= after, false) "
                  "OR coalesce(g <= size(words) - 1 - before, false))")
    return (cand.select("pos", F.split("line", " ").alias("words"), "after", "before")
            .select("pos", "words", F.explode(gaps).alias("gap"))
            .select("pos", "gap", F.expr("""
                CASE WHEN gap < 0 THEN xxhash64(words)
                     ELSE xxhash64(slice(words, 1, gap), slice(words, gap + 2, size(words))) END""").alias("key")))


def one_word_edit(a: Column, b: Column) -> Column:
    """Whether the word edit distance of two different texts is 1."""
    x, y = F.split(a, " "), F.split(b, " ")
    long, short = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    unlike = F.zip_with(long, short, lambda p, q: ~p.eqNullSafe(q))
    at = F.array_position(unlike, True).cast("int")        # first place where they part
    rest = F.slice(long, at + 1, F.greatest(F.size(long) - at, F.lit(0)))
    other = F.when(F.size(long) == F.size(short),
                   F.slice(short, at + 1, F.greatest(F.size(short) - at, F.lit(0)))).otherwise(
        F.slice(short, at, F.greatest(F.size(short) - at + 1, F.lit(0))))
    return (F.size(long) - F.size(short) <= 1) & (at > 0) & (rest == other)


def near_lines(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2, near): the earliest text one word edit away, where it is earlier."""
    cand = candidates(found, texts)
    made = stored(variants(cand), "variants")
    by_gap = made.groupBy("key", "gap").agg(F.min("pos").alias("pos"))
    whole = F.min(F.when(F.col("gap") < 0, F.col("pos")))
    cut = F.min(F.when(F.col("gap") >= 0, F.col("pos")))
    by_key = by_gap.groupBy("key").agg(whole.alias("whole"), cut.alias("cut"), F.count("*").alias("gaps"))
    first = (by_gap.join(by_key, "key")
             .select("key", "gap", F.when(F.col("gap") < 0, F.col("cut"))
                     .otherwise(F.least("pos", F.coalesce("whole", "pos"))).alias("near"))
             .where("near is not null"))
    pairs = made.join(first, ["key", "gap"]).where("near < pos").select("pos", "near").distinct()
    mine = cand.select("pos", "h1", "h2", F.col("line").alias("mine"))
    theirs = cand.select(F.col("pos").alias("near"), F.col("line").alias("theirs"))
    return (pairs.join(mine, "pos").join(theirs, "near")
            .where(one_word_edit(F.col("mine"), F.col("theirs")))
            .groupBy("h1", "h2").agg(F.min("near").alias("near")))


def duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line that goes: doc, line_no, kept_doc, kept_line_no, edits (0 or 1)."""
    found = lines(docs, doc, text)
    texts = distinct_lines(found)
    # Few rows, written so that the join below can split a line of very many copies.
    known = stored(texts.join(near_lines(found, texts), ["h1", "h2"], "left")
             .where("copies > 1 or near is not null")
             .select("h1", "h2", F.least("first", F.coalesce("near", "first")).alias("kept"),
                     F.when(F.col("near") < F.col("first"), 1).otherwise(0).alias("edits")), "known-lines")
    return (found.select("doc", "line_no", "h1", "h2").join(known, ["h1", "h2"])
            .where(F.struct("doc", "line_no") > F.col("kept"))
            .select("doc", "line_no", F.col("kept.doc").alias("kept_doc"),
                    F.col("kept.line_no").alias("kept_line_no"), "edits"))


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that go; rows and columns stay."""
    mark, row, gone = (free_name(docs, x) for x in ("line_doc", "line_row", "line_gone"))
    rows = docs.select(F.struct(col(doc).alias("doc"), row_key(doc, text).alias("row")).alias(mark), col(text))
    out = (duplicates(rows, mark, text).groupBy(F.col("doc.doc").alias(mark), F.col("doc.row").alias(row))
           .agg(F.collect_set("line_no").alias(gone)))
    kept = F.filter(F.split(col(text), "\n"), lambda x, i: ~F.array_contains(col(gone), i))
    return (docs.join(out, (row_key(doc, text) == col(row)) & col(doc).eqNullSafe(col(mark)), "left")
            .withColumn(text, F.when(col(gone).isNull(), col(text)).otherwise(F.array_join(kept, "\n")))
            .select(*[col(c) for c in docs.columns]))
