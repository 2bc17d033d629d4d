"""URL filters, license scans, nearest neighbours, registered queries, the pipeline."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrid.llm import ann, license, urlfilter

SF = "/root/testdata/sf0.001"


def judged(spark, urls):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = urlfilter.judge(pages, None)
    assert out.columns == ["page_id", "url", "verdict", "url_filter"]
    return [r.url_filter for r in out.orderBy("page_id").collect()]


def test_url_parts_and_rules(spark):
    cases = {
        "https://WWW.Example.NET/en/1?x#y": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://planet/x": ("planet", "/x", None, "allow"),
        "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://m.example.com/de": ("m.example.com", "/de", None, "allow"),
        "x://y.org/fr/z://q": ("y.org", "/fr/z:", None, None),
        "http://É.ORG?/fr/": ("É.org", "", None, "allow"),
        "http://h.com#/en/": ("h.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    cases["x://y.org/fr/z://q"] = ("y.org", "/fr/z://q", "org/fr/", "allow")
    for got, (url, want) in zip(judged(spark, list(cases)), cases.items()):
        assert (got.host, got.path, got.rule, got.verdict) == want, url


def test_mined_rules_match_brute_force(spark):
    rows = []
    for i in range(240):
        host = "cheap-pills.example.com" if i % 4 == 0 else f"h{'abc'[i % 3]}.example.com"
        path = f"/{'en' if i % 2 else 'fr'}/{i}"
        bad = (i % 4 == 0) or (i % 24 == 1)
        rows.append((i, f"https://{host}{path}", "block" if bad else "allow"))
    rows += [(900, None, "block"), (901, "https://x.com/", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, label string")
    params = urlfilter.Params(min_support=0.05, min_confidence=0.8)
    rules = urlfilter.mine(table, params)
    got = {tuple(r.rule_tokens): (round(r.confidence, 9), round(r.support, 9)) for r in rules.collect()}
    sets = [(frozenset(r.t), r.label) for r in
            table.where("url is not null and label is not null").select(urlfilter.tokens_of(F.col("url")).alias("t"), "label").collect()]
    base = sum(x == "block" for _, x in sets) / len(sets)
    want, seen = {}, set()
    for s, _ in sets:
        for mask in range(1, 1 << len(s)):
            combo = frozenset(x for i, x in enumerate(sorted(s)) if mask >> i & 1)
            if combo in seen:
                continue
            seen.add(combo)
            have = [x for t, x in sets if combo <= t]
            hit = sum(x == "block" for x in have)
            conf = hit / len(have)
            unlikely = conf - base >= params.min_z * math.sqrt(base * (1 - base) / len(have))
            if hit / len(sets) >= 0.05 and conf >= 0.8 and conf / base >= params.min_lift and unlikely:
                want[tuple(sorted(combo))] = (round(conf, 9), round(hit / len(sets), 9))
    every = dict(want)
    want = {k: v for k, v in every.items() if not any(set(o) < set(k) and every[o][0] >= v[0] for o in every)}
    assert got == want and 0 < len(want) < len(every)
    found = {r.page_id: r.url_filter for r in urlfilter.judge(table.union(table), rules).collect()}
    for i, url, _ in rows[:240]:
        tokens = next(t for t, _ in sets[i:i + 1])
        fits = [k for k in want if set(k) <= tokens]
        assert found[i].verdict == ("block" if fits else "allow")
        if fits:
            best = max(fits, key=lambda k: (want[k][0], want[k][1], -len(k), k))
            assert tuple(found[i].mined) == best
    assert sum(found[i].rule is None and found[i].verdict == "block" for i in range(240)) >= 60   # by mined rules alone
    assert found[900].verdict == "allow" and urlfilter.judge(table, rules).count() == len(rows)
    assert urlfilter.mine(table.limit(0)) is None and urlfilter.judge(table.limit(0), rules).count() == 0


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute_licenses(texts, templates):
    out = {}
    for d, t in enumerate(texts):
        s = shingles(t)
        for name, body in templates.items():
            own = set(shingles(body))
            scale = 2 ** math.ceil(math.log2(len(own)))
            best = max(((len(own & set(s[a:a + 2 * scale])) / len(own), -a) for a in range(0, len(s), scale)), default=(0, 0))
            if best[0] >= 0.8:
                out[(d, name)] = (round(best[0], 9), -best[1])
    return out


def test_license_scan_matches_brute_force(spark):
    t = license.TEMPLATES
    filler = "some other words that stand around the statement in this document and go on for a while "
    header = t["Apache-2.0 header"]
    texts = [None, "", "licensed under", *t.values(), filler * 3 + t["MIT text"].upper() + filler * 2,
             header.replace("compliance", "accordance"), header.replace("compliance", "x").replace("copy", "y"),
             filler * 200 + t["CC BY-NC 4.0"] + ". " + filler * 200 + t["MIT"] + " " + filler + t["MIT"], filler * 5]
    given = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, shingles string")
    got = {(r.doc, r.template): (round(r.containment, 9), r.word_at) for r in license.find(given.union(given)).collect()}
    want = brute_licenses(texts, t)
    assert got == want and len(want) > 20
    assert license.find(given.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license.find(given, {"short": "all rights reserved"})


def test_nearest_neighbours(spark):
    r = np.random.RandomState(1)
    x = r.normal(size=(1200, 16)).astype(np.float32)
    x[100:400] = x[100]                    # ties: one vector many times
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16),
           (5080, [float("inf")] * 16), (5100, [1.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + [(i, v, 0) for i, v in bad] + rows[:50],
                                  "vec_id long, embedding array<float>, score int")
    params = ann.Params(sample_rows=800, block_rows=64, query_rows=32, calibration=40)
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=20, params=params).collect()
    found = {}
    for g in got:
        found.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert set(found) == set(range(0, 1200, 20))
    hits, y = 0, x.astype(np.float64)
    for q, rank in found.items():
        rank.sort()
        score = (y * y[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort([np.arange(len(y)), -score])[:20]
        assert [a for a, _, _ in rank] == list(range(1, 21)) and q not in [v for _, v, _ in rank]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in rank)
        assert [(-s, v) for _, v, s in rank] == sorted((-s, v) for _, v, s in rank)
        hits += len({v for _, v, _ in rank} & set(want.tolist()))
    assert hits / (20 * len(found)) >= 0.9
    few = ann.search(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0, k=20, params=params).collect()
    assert len(few) == 4
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(table.where("vec_id = 5000"), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_are_registered_once_each():
    import __spark_entry__ as entry
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_queries_match_their_oracles(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import oracle_check

    import __spark_entry__ as entry
    duck = oracle_check.duck_con(SF)
    for key in ("op3_license_scan", "op6_line_dedup"):
        message, ok = oracle_check.compare(spark, duck, SF, key, entry.queries()[key], entry.oracle_sql()[key])
        assert ok, message


def test_pipeline_matches_a_plain_restatement(spark):
    import base64

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from test_pairs import brute_lines, brute_overlaps, plain_fingerprint, roots

    from zonegrid.llm import toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.names, model.weights))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rows = [(i, t) for i, t in rows
            if toxicity.sigmoid(np.array(toxicity.weighed(t, weight) - model.thresholds[0])) < model.reject_at]
    gone = {(d, n) for d, n, _, _ in brute_lines([t for _, t in rows])}
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)) for d, (i, t) in enumerate(rows)]
    prints = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
                             if bin(prints[a] ^ prints[b]).count("1") <= 2])
    rows = [x for n, x in enumerate(rows) if root[n] == n]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_overlaps([t for _, t in rows], items)}
    rows = [x for n, x in enumerate(rows) if n not in leaked]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        assert got[i].ids == library.encode_ordinary(t)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline_stages_take_empty_and_odd_tables(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("line", F.lit(1)).withColumn("DOC", F.lit("a"))
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "a"), (1, "", "en", "s", 0, 1, "a")], docs.schema)
    for given in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert out.count() == given.count() or name == "simhash"
            if name != "byte_bpe":
                assert out.columns == given.columns


def test_diagonals_of_a_cluster_and_item_go_together(spark, monkeypatch):
    """A passage that comes again and again meets its item on many diagonals: the words of
    the document go to the check once, and few words are remembered meanwhile."""
    from pyspark.sql.classic.dataframe import DataFrame

    from zonegrid.llm import decontam
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, " ".join([passage] * 30)), (2, "nothing of the kind"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join([passage] * 3))], "item_id long, text string")
    seen, real = [], DataFrame.mapInPandas

    def spy(self, *args, **kw):
        if "item_words" in self.columns:
            seen.append(self.count())
        return real(self, *args, **kw)
    monkeypatch.setattr(DataFrame, "mapInPandas", spy)
    got = [(r.doc, r.item, r.agree, r.words, r.start) for r in decontam.overlaps(docs, items).collect()]
    assert got == [(1, 7, 36, 36, 0)] and seen == [1]
    known = decontam.Hashes()
    for i in range(decontam.KNOWN + 5):
        known[f"w{i}"]
    assert len(known) == 5 and decontam.KNOWN < 100_000
