"""URL filters: explicit rules, and association rules mined by FP-growth.

DataFrame functions and Spark's FP-growth only. A url's tokens are its scheme, the
words of its host labels, the words of its path and the fields of its query, each
marked by its part; numbers are left out. Labelled urls are transactions of their
tokens and the label; FP-growth mines the frequent combinations, and the rules
"tokens -> block" with enough support, confidence and lift stay, if a share as high
would be unlikely among urls at large (``min_z`` standard errors) and no rule of fewer
of their tokens has the same confidence or more: such a rule says it all.

Matching is by an inverted index: a rule is posted under its rarest token only.
Distinct token sets are matched, not rows: they look their tokens up, and a rule
applies if the set holds all of its tokens. Of several rules the one of highest
confidence (then support, then fewest tokens, then first tokens) counts.

Explicit rules go first: a rule fits its host and all subdomains where the path
starts with the rule's; the longest rule wins. Urls that no rule of either kind
fits are allowed.

Defined results
  null url, no ``://``    host and path are empty, no tokens: allowed
  empty url               likewise
  very long url           read whole
  ties                    see above
  repeated rows           one result each
  null ids or labels      a null label is no label; null ids are kept
  no labels, one class    no mined rules
  empty table             empty result
  extra columns           kept by ``judge``
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name

#: Fixed values: (host, path, verdict) of the explicit rules.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
BLOCK, ALLOW = "block", "allow"
LABEL = "label="   # mark of the label among the items of a transaction
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    min_support: float = 0.005
    min_confidence: float = 0.6
    min_lift: float = 1.5
    min_z: float = 3.0   # standard errors above the share of blocked urls


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The url's distinct tokens, sorted."""
    def marked(mark: str, words: Column) -> Column:
        good = F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
        return F.transform(good, lambda w: F.concat(F.lit(mark), w))

    scheme = F.when(F.instr(url, "://") > 0, F.array(F.lower(F.substring_index(url, "://", 1)))).otherwise(
        F.array().cast("array<string>"))
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.concat(marked("scheme:", scheme), marked("host:", F.split(host_of(url), "[.-]")),
                     marked("path:", F.split(F.lower(path_of(url)), "[/._-]")),
                     marked("query:", F.split(F.lower(query), "[&;]")))
    return F.coalesce(F.array_sort(F.array_distinct(parts)), F.array().cast("array<string>"))


def rule_of(host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest explicit rule that fits; null if none."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    return F.coalesce(*fits)


def mine(labelled: DataFrame, params: Params = Params(), url: str = "url", label: str = "label") -> DataFrame | None:
    """Rules (tokens, key, confidence, lift, support) for blocking, from urls with a
    label (``block`` or ``allow``); None if nothing is labelled."""
    rows = (labelled.select(tokens_of(col(url)).alias("tokens"), col(label).alias("label"))
            .where(F.col("label").isin(BLOCK, ALLOW) & (F.size("tokens") > 0)))
    items = rows.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items"))
    if items.isEmpty():
        return None
    model = FPGrowth(itemsCol="items", minSupport=params.min_support, minConfidence=params.min_confidence).fit(items)
    base, urls = F.col("confidence") / F.col("lift"), F.col("support") * items.count() / F.col("confidence")
    z = (F.col("confidence") - base) / F.sqrt(base * (1 - base) / urls)
    rules = (model.associationRules
             .where((F.col("consequent")[0] == LABEL + BLOCK) & (F.col("lift") >= params.min_lift) & (z >= params.min_z)
                    & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
             .select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "lift", "support"))
    often = (model.freqItemsets.where(F.size("items") == 1)
             .select(F.col("items")[0].alias("token"), F.col("freq")))
    keys = (rules.select("rule_tokens", F.explode("rule_tokens").alias("token")).join(often, "token")
            .groupBy("rule_tokens").agg(F.min(F.struct("freq", "token")).alias("rarest"))
            .select("rule_tokens", F.col("rarest.token").alias("key")))
    return needed(rules.join(keys, "rule_tokens"))


def needed(rules: DataFrame) -> DataFrame:
    """``rules`` without those that a rule of fewer of their tokens makes needless. A
    shorter rule stands under its key, which the longer one must hold."""
    less = rules.select("key", F.col("rule_tokens").alias("less"), F.col("confidence").alias("as_sure"))
    covered = (rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("key")).join(less, "key")
               .where((F.size("less") < F.size("rule_tokens")) & (F.col("as_sure") >= F.col("confidence"))
                      & (F.size(F.array_except("less", "rule_tokens")) == 0))
               .select("rule_tokens"))
    return rules.join(covered, "rule_tokens", "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, rule_tokens, confidence) of the best mined rule of each token set."""
    best = F.struct("confidence", "support", (-F.size("rule_tokens")).alias("short"), "rule_tokens")
    return (sets.select("tokens", F.explode("tokens").alias("key")).join(rules, "key")
            .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
            .groupBy("tokens").agg(F.max(best).alias("best"))
            .select("tokens", "best.rule_tokens", "best.confidence"))


def judge(pages: DataFrame, rules: DataFrame | None, url: str = "url", out: str = "url_filter") -> DataFrame:
    """``pages`` with a struct ``out``: host, path, rule, verdict, mined (tokens of
    the mined rule), confidence."""
    tokens = free_name(pages, "url_tokens")
    rows = pages.withColumn(tokens, tokens_of(col(url)))
    if rules is None:
        best = rows.select(col(tokens).alias("t")).limit(0).selectExpr(
            "t", "cast(null AS array<string>) AS rule_tokens", "cast(null AS double) AS confidence")
    else:
        sets = rows.select(col(tokens).alias("tokens")).distinct()
        best = match(sets, rules).withColumnRenamed("tokens", "t")
    mark = F.struct(F.col("t"), F.col("rule_tokens"), F.col("confidence"))
    named = best.select(mark.alias(free_name(rows, "url_best")))
    found = col(named.columns[0])
    host, path = host_of(col(url)), path_of(col(url))
    rule = rule_of(host, path)
    verdict = F.coalesce(rule["verdict"], F.when(found.isNotNull(), F.lit(BLOCK)), F.lit(ALLOW))
    result = F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), verdict.alias("verdict"),
                      found["rule_tokens"].alias("mined"), found["confidence"].alias("confidence"))
    return (rows.join(named, col(tokens) == found["t"], "left")
            .select(*[col(c) for c in pages.columns if c.lower() != out.lower()], result.alias(out)))
