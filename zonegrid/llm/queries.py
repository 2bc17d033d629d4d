"""Registered queries of the training-data operators, with production parameters.

Each reads its whole table through its operator; ``ORACLE`` has the DuckDB
statement where SQL can express the operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bottomk, bpe, convrepair, decontam, langid, license, linededup, pll, simhash, spelling, toxicity, urlfilter
from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.Params())
    out = toxicity.score(docs.select("doc_id", "text"), model, out="toxicity")
    return out.select("doc_id", "toxicity.severity", "toxicity.p_toxic", "toxicity.grade",
                      (F.col("toxicity.p_toxic") >= model.reject_at).alias("rejected"))


@register
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = linededup.duplicates(table(spark, sf_dir, "documents"))
    return gone.select(F.col("doc").alias("doc_id"), "line_no", F.col("kept_doc").alias("kept_doc_id"),
                       "kept_line_no", "edits")


# Word-by-word restatement: every pair of texts that share a text with one word
# left out (or are such a text) is compared by its words.
ORACLE["op6_line_dedup"] = """
WITH raw AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(parts[i], chr(32) || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) t(i)
), occ AS (SELECT * FROM raw WHERE line <> ''),
texts AS (
  SELECT line, min((doc_id, line_no)) AS pos, string_split(line, ' ') AS w FROM occ GROUP BY line
), long AS (SELECT * FROM texts WHERE len(w) >= 10),
cut AS (
  SELECT line, pos, w, g, array_to_string(list_concat(w[1:g - 1], w[g + 1:]), ' ') AS v
  FROM long, unnest(range(1, len(w) + 1)) t(g)
), pairs AS (
  SELECT a.line, b.pos AS near FROM cut a JOIN cut b ON a.v = b.v AND a.g = b.g AND len(a.w) = len(b.w)
  WHERE b.pos < a.pos AND a.line <> b.line
  UNION ALL
  SELECT a.line, b.pos FROM cut a JOIN long b ON a.v = b.line WHERE b.pos < a.pos
  UNION ALL
  SELECT a.line, b.pos FROM long a JOIN cut b ON b.v = a.line WHERE b.pos < a.pos
), kept AS (
  SELECT t.line, least(t.pos, coalesce(n.near, t.pos)) AS kept,
         CASE WHEN n.near < t.pos THEN 1 ELSE 0 END AS edits
  FROM texts t LEFT JOIN (SELECT line, min(near) AS near FROM pairs GROUP BY line) n USING (line)
)
SELECT o.doc_id, o.line_no, kept.kept[1] AS kept_doc_id, kept.kept[2] AS kept_line_no, kept.edits
FROM occ o JOIN kept USING (line) WHERE (o.doc_id, o.line_no) > kept.kept
"""


@register
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "agree", "words", "start")


@register
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.summary(bpe.decode(coded, ranks)).drop("ids").withColumnRenamed("doc", "doc_id")


@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        "language.score", "language.cross_entropy", "language.rejected")


@register
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pll.fit_and_score(docs, keep=["doc_id"]).select("doc_id", "lm.log_prob", "lm.n_tokens", "lm.mean_log_prob")


@register
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.find(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "template", "containment", "word_at")


def _license_oracle() -> str:
    """Every window of every scale against every template, by its shingles' words."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(license.TEMPLATES.items()))
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(template, body)),
tw AS (SELECT template, string_split(trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t),
ts AS (
  SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s FROM tw, unnest(range(1, len(w) - 3)) u(i)
), tn AS (SELECT template, count(*) AS own, CAST(pow(2, ceil(log2(count(*)))) AS INTEGER) AS scale FROM ts GROUP BY template),
dw AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents
), ds AS (
  SELECT doc_id, i - 1 AS at, array_to_string(w[i:i + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) u(i)
), hit AS (SELECT ds.doc_id, ds.at, ds.s, ts.template FROM ds JOIN ts USING (s)),
held AS (
  SELECT h.doc_id, h.template, n.own, k * n.scale AS word_at, count(DISTINCT h.s) AS hits
  FROM hit h JOIN tn n USING (template), unnest([h.at // n.scale - 1, h.at // n.scale]) u(k)
  WHERE k >= 0 GROUP BY ALL
), good AS (SELECT *, hits / own AS containment FROM held WHERE hits / own >= 0.8)
SELECT doc_id, template, max(containment) AS containment,
       CAST(arg_min(word_at, (-containment, word_at)) AS INTEGER) AS word_at
FROM good GROUP BY doc_id, template
"""


ORACLE["op3_license_scan"] = _license_oracle()


@register
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # A page's path ends in the number of its document, which labels may know.
    number = F.try_to_number(F.regexp_extract("url", r"/([0-9]{1,18})(?:[./?#]|$)", 1), F.lit("9" * 18)).cast("long")
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    labels = (table(spark, sf_dir, "labels").groupBy("doc_id").agg(bad.alias("bad")).where("bad is not null")
              .select(F.col("doc_id").alias("number"), F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label")))
    rules = urlfilter.mine(pages.withColumn("number", number).join(labels, "number"))
    found = urlfilter.judge(pages, rules)
    return found.select("page_id", "url_filter.*")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", ""))
            .otherwise(blank("text")))
    return (conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
                                 text.alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .select("conv_id", "turn", "role", "text",
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
                    .alias("copy"))
            .drop("copy"))


@register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = convrepair.repair(damaged(given))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "")
    audits = found.audits.groupBy("conv").agg(word.alias("audit"))
    every = given.select(F.col("conv_id").alias("id")).distinct()
    for part in (found.summary, audits, convrepair.digests(found.rows)):
        every = every.join(part, F.col("id").eqNullSafe(F.col("conv")), "left").drop("conv")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select(F.col("id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        F.concat(F.coalesce("audit", F.lit("")), F.translate(F.coalesce("closing", F.lit("")), "ua", "II"))
                        .alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@register
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"), garble=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@register
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottomk.groups(table(spark, sf_dir, "documents"), shingle=5, percent=85)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))
