"""BPE, language identification, toxicity, language-model scores: per-text operators."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from zonegrid.llm import bpe, langid, pll, toxicity

SCHEMA = "doc_id long, text string, lang string, lm string, language string, toxicity string, ids string"
ODD = [None, "", " ", "\n\n  \t", "a", "don't  stop\u00a0\u2003now\r\n\r\n ", "\u00e9\u00e8\u4e2d\u6587\U0001f600 \u0301x",
       "x" * 3000, "ab" * 2000, "  12345 67,890!!! ###", "<|endoftext|>", "\x1c\x85\u200b", "a" * 7 + "\n" * 50]


def docs(spark, texts, langs=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "1", "2", "3", "4") for i, t, g in zip(ids, texts, langs)], SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_bpe_is_the_librarys_and_round_trips(spark, ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 5_000)   # several runs
    texts = [*ODD, *ODD, *[r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
                           .select("text").limit(60).collect()]]
    given = docs(spark, texts)
    coded = bpe.decode(bpe.encode(given, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(coded) == len(texts)
    for r in coded:
        text = texts[r.doc] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.bytes) == text.encode()


def test_bpe_cuts_only_where_the_pattern_does(library):
    """Texts of all kinds of white space: pieces give the library's matches."""
    import pandas as pd
    import regex
    r = random.Random(9)
    parts = ["a", "Word", "don't", "'s", "12", "?!", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\x1c", "\x85",
             "\u200b", "\u3000", "\u4e2d", "\u0301", "\U0001f600", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(20_000)]
    found = list(bpe.runs(iter([pd.DataFrame({"doc": [str(i) for i in range(len(texts))], "body": texts})]),
                          public_tokenizers.PATTERN))
    at = 0
    for _, names, counts, codes, words in found:
        stop = 0
        for n in counts:
            assert [words[c] for c in codes[stop:stop + n]] == regex.findall(public_tokenizers.PATTERN, texts[at])
            stop, at = stop + n, at + 1
    assert at == len(texts)
    assert [x[4] for x in found] == [x[4] for x in bpe.runs(iter([pd.DataFrame(
        {"doc": [str(i) for i in range(len(texts))], "body": texts})]), public_tokenizers.PATTERN, positions=False)]


def test_bpe_edges(spark, ranks):
    given = docs(spark, ["same text"] * 3, ids=[None, 2 ** 60 + 1, 2 ** 60 + 1])
    got = bpe.encode(given, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(r.doc or 0 for r in got) == [0, 2 ** 60 + 1, 2 ** 60 + 1]
    assert len({tuple(r.ids) for r in got}) == 1
    assert bpe.encode(given.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc long, ids array<int>"), ranks).collect()


def test_bpe_vocabulary_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "VOCABULARY", 1000)
    with pytest.raises(ValueError):
        bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain_log_prob(counts, lang, context, letter):
    """Interpolated Kneser-Ney by its recursion, from 4-symbol counts of one language."""
    grams = {g: n for (x, g), n in counts.items() if x == lang}
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    alphabet = len({g[-1] for (_, g) in counts}) + 1

    def discount(k):
        one, two = (sum(n == c for n in levels[k].values()) for c in (1, 2))
        return min(max(one / max(one + 2 * two, 1), 0.1), 0.95)

    def p(k, ctx, w):
        if k == 0:
            return 1 / alphabet
        own = {g[-1]: n for g, n in levels[k].items() if g[:-1] == ctx}
        low = p(k - 1, ctx[1:], w)
        if not own:
            return low
        d, total = discount(k), sum(own.values())
        return max(own.get(w, 0) - d, 0) / total + d * len(own) / total * low
    return np.log(p(4, context, letter))


def test_kneser_ney_matches_its_recursion():
    import pandas as pd
    texts = {"aa": ["the cat sat on the mat", "that hat"], "bb": ["der hut und die hand", "das haus"]}
    letters, counts = langid.Letters(), {}
    for lang, own in texts.items():
        part = pd.DataFrame({"lang": [lang] * len(own), "body": own})
        for rows in langid.gram_counts(iter([part])):
            for r in rows.itertuples():
                counts[(r.lang, r.gram)] = counts.get((r.lang, r.gram), 0) + r.n
    frame = pd.DataFrame([(a, b, n) for (a, b), n in sorted(counts.items())], columns=["lang", "gram", "n"])
    model = langid.kneser_ney(frame, ["aa", "bb"])
    line, places, _ = langid.joined([letters("The hat und qx that")])
    got = langid.log_probs(model, line, places)
    text = "".join(chr(c) if c else " " for c in line)
    for row, at in zip(got, places):
        want = [plain_log_prob(counts, x, text[at - 3:at], text[at]) for x in ("aa", "bb")]
        assert np.allclose(row, want, atol=1e-4)
    context = "hat"   # the distribution over letters sums to one
    total = sum(np.exp(plain_log_prob(counts, "aa", context, c)) for c in {g[-1] for (_, g) in counts})
    assert total <= 1 + 1e-9


def test_language_id_held_out_accuracy_and_edges(spark):
    from pyspark.sql import functions as F
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(table.where(~out))
    got = langid.predict(table.where(out), model).where("lang is not null").collect()
    assert np.mean([r.language.lang == r.lang for r in got]) > 0.97
    odd = docs(spark, [None, "", "12 34 !", "the of and that " * 5000, "the of and that " * 5000], ids=[1, None, 3, 4, 4])
    found = langid.predict(odd, model, out="found").orderBy("doc_id").collect()
    assert [r.found.lang for r in found][:3] == ["und"] * 3 and all(r.found.score == 0 for r in found[:3])
    assert found[3].found == found[4].found and found[3].found.lang == "en" and 0 <= found[3].found.score <= 1
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.fit(odd.where("false")) is None
    nothing = langid.predict(odd, None, out="found").collect()
    assert {r.found.lang for r in nothing} == {"und"} and all(r.found.rejected for r in nothing)


def test_ordinal_gradient_orders_thresholds():
    r = np.random.RandomState(0)
    x = r.randint(0, 2, (400, 3)).astype(float)
    y = np.clip((x @ [2.0, -1.0, 0.0] + r.logistic(size=400) * 0.3).round().astype(int), 0, 2)
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, x[rows, cols], y, 3, 0.1, 800)
    assert t[0] < t[1] and w[0] > 1 and w[1] < -0.5 and abs(w[2]) < 0.6

    def loss(w, t):
        above = np.hstack([np.ones((400, 1)), toxicity.sigmoid((x @ w)[:, None] - t), np.zeros((400, 1))])
        return -np.log(above[np.arange(400), y] - above[np.arange(400), y + 1]).sum() + 0.05 * (w ** 2).sum()
    for i in range(3):   # the result is a minimum
        for step in (-0.2, 0.2):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, t) > loss(w, t) - 1e-2


def toxic_fixture(spark, n=400):
    r = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        body = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            body += r.sample(["insult", "slurword", "hatefully", "nastier"], r.randint(2, 4))
        rows.append(" ".join(body))
        labels.append((i, int(toxic), 1))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity_separates_and_keeps_clean(spark):
    given, labels = toxic_fixture(spark)
    model = toxicity.fit(given, labels.union(labels))
    scored = toxicity.score(given, model, out="found").collect()
    bad = {r.doc_id for r in scored if r.found.p_toxic >= model.reject_at}
    assert bad == set(range(0, 400, 5))
    assert all(0 <= r.found.severity <= 2 for r in scored)
    kept = toxicity.reject(given, model)
    assert kept.columns == given.columns and kept.count() == 320
    odd = docs(spark, [None, "", "insult slurword hatefully " * 4000, "insult slurword hatefully"], ids=[None, 1, 2, 2])
    got = {r.text: r.found for r in toxicity.score(odd, model, out="found").collect()}
    assert got[None] == got[""] and got[None].p_toxic < model.reject_at
    assert got["insult slurword hatefully"].p_toxic > 0.5
    assert toxicity.reject(odd.limit(0), model).count() == 0


def test_toxicity_takes_ids_of_any_type(spark):
    given, labels = toxic_fixture(spark)
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    model = toxicity.fit(named(given), named(labels))
    assert toxicity.reject(named(given), model).count() == 320


def test_toxicity_without_labels_rejects_nothing(spark):
    given, labels = toxic_fixture(spark, 20)
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        model = toxicity.fit(given, few)
        assert toxicity.reject(given, model).count() == 20


def test_lm_counts_scores_and_edges(spark):
    texts = ["the cat sat on the mat . " * 30] * 30 + ["cat the mat on . sat the " * 30, "zz qq xx yy", None, "", "the the"]
    given = docs(spark, texts)
    model, counts = pll.fit(given, pll.Params(words=10, sample_tokens=20_000))
    plain = {}
    for t in texts:
        for w in pll.tokens_of(t):
            plain[w] = plain.get(w, 0) + 1
    assert {r.word: r.n for r in counts.collect()} == plain
    got = {r.doc_id: r["found"] for r in pll.score(given, model, out="found").collect()}
    assert got[0].mean_log_prob > got[30].mean_log_prob + 0.5      # order matters, from both sides
    assert abs(got[0].log_prob - got[1].log_prob) < 1e-2 and got[0].n_tokens == 210
    assert got[32].n_tokens == 0 and got[32].log_prob == 0 and got[33].mean_log_prob is None
    whole = pll.Codes(model.classes(), model.forms).of("the zz never")
    line, places = pll.joined([whole], 3)
    h = pll.hidden(model, line, places, 3)
    groups, z = np.exp(h @ model.top + model.lean), np.exp(h @ model.out + model.bias)
    inside = z.reshape(3, -1, pll.GROUP)
    p = (groups / groups.sum(axis=1, keepdims=True))[:, :, None] * inside / inside.sum(axis=2, keepdims=True)
    assert np.allclose(p.sum(axis=(1, 2)), 1)
    want = np.log(p.reshape(3, -1)[np.arange(3), whole]).sum()
    assert abs(pll.log_probabilities(model, [whole], 3)[0] - want) < 1e-4
    hidden = pll.hidden(model, line, places, 3)
    line[places[1]] = 1 + line[places[1]] % 5                       # a token doesn't see itself
    assert np.allclose(pll.hidden(model, line, places, 3)[1], hidden[1])
    assert pll.score(given.limit(0), model).count() == 0
    empty, none = pll.fit(given.limit(0))
    assert none.count() == 0 and pll.score(given, empty, out="found").count() == len(texts)


@pytest.mark.parametrize("known", [0, 8, 1000])
def test_lm_gives_every_word_its_own_probability(spark, monkeypatch, known):
    monkeypatch.setattr(pll, "KNOWN", known)     # all rare words joined, some, none
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "of", *(f"w{k}" for k in range(i % 40))]) for _ in range(60)) for i in range(80)]
    given = docs(spark, [*texts, *texts[:3], None])
    model, counts = pll.fit(given, pll.Params(words=2))
    n = {c.word: c.n for c in counts.collect()}
    new = ["?", "77777", "q7", *("q" * (3 * k + 1) for k in range(5)), *("\u00e9" * (3 * k + 1) for k in range(5))]
    assert [pll.form(w) for w in new] == list(range(pll.FORMS)) and not set(new) & set(n)
    words = [*n, *new]
    got = pll.score(docs(spark, words), model, out="found").collect()
    p = {words[x.doc_id]: np.exp(x.found.log_prob) for x in got}
    own_class = pll.Codes(model.classes(), model.forms)
    groups = {}
    for w in n:
        groups.setdefault(own_class[w][0], []).append(w)
    for c, own in groups.items():               # in a class, words stand to each other as their counts do
        assert np.allclose([p[w] / p[own[0]] for w in own], [n[w] / n[own[0]] for w in own])
        if c >= model.forms:                    # and a new word of their form like one that is seen once
            assert np.isclose(p[new[c - model.forms]], p[own[0]] / n[own[0]])
        elif c > len(model.number):             # words of about one count
            assert max(n[w] for w in own) < 1.5 * min(n[w] for w in own)
    assert len({round(np.log(p[w]), 6) for own in groups.values() for w in own}) > 20
    assert 1 - 1e-3 < sum(p.values()) <= 1 + 1e-6            # all words, and a new one of each form
    copies = {x.doc_id: x.found.log_prob for x in pll.score(given, model, out="found").collect()}
    assert abs(copies[0] - copies[80]) < 1e-3 and len(copies) == 84


def test_lm_numbers_the_texts_once_for_training_and_scoring(spark, monkeypatch):
    texts = ["the cat sat on the mat, " * 20] * 20 + ["zz qq, xx", None, "", " \n", "_a b_c... (cat) d'e caf\u00e9\u0301"]
    given = docs(spark, texts).coalesce(1)
    model, _ = pll.fit(given, pll.Params(words=4))
    apart = {x.doc_id: x.lm for x in pll.score(given, model, pll.Params(words=4)).collect()}
    calls = []
    number = pll.numbered
    monkeypatch.setattr(pll, "numbered", lambda *args: calls.append(args) or number(*args))
    found = pll.fit_and_score(given, pll.Params(words=4), keep=["doc_id"])
    got = {x.doc_id: x.lm for x in found.collect()}
    assert found.columns == ["doc_id", "lm"] and len(calls) == 1 and set(got) == set(apart)
    for k, x in got.items():
        assert x.n_tokens == apart[k].n_tokens == len(pll.tokens_of(texts[k]))
        assert abs(x.log_prob - apart[k].log_prob) < 1e-6


def test_lm_splits_pieces_as_the_pattern_does():
    marks = ["", ".", "!!", "_", "_.", "\u2026", "\u0301,", "9", "\u00b2", "\u0663"]
    for piece in {a + w + b for a in marks for w in ["word", "\u00e9t\u00e9", "_", "'", "4"] for b in marks}:
        words = pll.TOKEN.findall(piece)
        assert pll.split(piece) == words
        codes = pll.Codes({"word": 1, ".": 2}, 3)
        assert codes.of(piece).tolist() == [{"word": 1, ".": 2}.get(w) or 3 + pll.form(w) for w in words]


def test_lm_learns_from_documents_outside_the_sample(spark):
    r = random.Random(6)
    noise = [f"n{k}" for k in range(20)]
    texts = [" ".join(r.choice(noise) for _ in range(400)) for _ in range(120)] + ["xa xb xc xd " * 300] * 40
    given = docs(spark, texts).repartition(2, "doc_id")
    model, counts = pll.fit(given, pll.Params(words=30, sample_docs=0))     # nothing is drawn
    n = {c.word: c.n for c in counts.collect()}
    alone = np.mean([np.log(n[w] / sum(n.values())) for w in ("xa", "xb", "xc", "xd")])
    got = {x.doc_id: x.found for x in pll.score(given, model, out="found").collect()}
    assert got[130].mean_log_prob > alone + 0.5


def test_lm_gradients_equal_differences():
    r = np.random.RandomState(5)
    m = pll.Model({}, {}, {}, 1, r.normal(0, 0.5, (4, 32, 3)), r.normal(0, 0.5, 3), r.normal(0, 0.5, (3, 2)),
                  r.normal(0, 0.5, 2), r.normal(0, 0.5, (3, 32)), r.normal(0, 0.5, 32), np.zeros(32))
    line, places = pll.joined([r.randint(1, 32, 9), r.randint(1, 32, 1)], 2)

    def loss():
        order, parts = pll.by_group(m, line, places)
        return -pll.predict(m, line, places[order], parts, 2)[-1].mean()

    grads = pll.Steps(m, 2, 0.01, 16).gradients(line, places)
    for k in pll.Steps.NAMES:
        value = getattr(m, k)
        for at in [tuple(r.randint(d) for d in value.shape) for _ in range(12)]:
            kept = value[at]
            value[at] = kept + 1e-2
            up = loss()
            value[at] = kept - 1e-2
            down = loss()
            value[at] = kept
            assert abs((up - down) / 2e-2 - grads[k][at]) < 1e-4, k


def test_lm_reads_pieces_as_whole_texts_and_draws_bounded_windows():
    texts = [*ODD, "a\x1cb\u2028c\u00a0d e\u200bf", "\u0130stanbul \u03a3\u03a3 \u03a3.", "x" * 70 + " y " + "z-" * 50]
    codes, apart = pll.Codes({"a": 1, "x": 2}, 3), pll.Named({"a": 1, "x": 2}, 3)
    for t in texts:
        words = pll.tokens_of(t)
        assert codes.of(t).tolist() == [{"a": 1, "x": 2}.get(w) or 3 + pll.form(w) for w in words]
        named = apart.of(t)
        assert apart.others(named) == pll.Counter(w for w in words if w not in ("a", "x"))
        assert np.where(named < 3, named, 3 + (named - 3) % pll.GROUP).tolist() == codes.of(t).tolist()
    line = np.arange(1, 10_001)
    assert pll.drawn(line, 3, 40, 1).shape == (280,)
    assert pll.drawn(line[:2], 1, 40, 1).tolist() == [0, 1, 2, 1, 2, 0] and len(pll.drawn(line[:0], 3, 40, 1)) == 0


def test_byte_bpe_pieces_and_short_words(monkeypatch):
    """One match over all distinct pieces gives the matches of each text, and the merge
    without a heap gives the ids of the merge with one."""
    import random

    import numpy as np
    import pandas as pd
    import public_tokenizers
    import regex

    from zonegrid.llm import bpe
    rng = random.Random(5)
    signs = [" ", " ", "  ", "\n", "\t", "a", "Bc", "'s", "'ll", "12", "1234", "\u00e9", "\u4e2d", "!", "...", "\x1c", "\u00a0"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(20))) for _ in range(3000)] + ["", None, " ", "a", " a", "a "]
    part = pd.DataFrame({"doc": [str(i) for i in range(len(texts))], "body": texts})
    calls, split = [], regex.compile(public_tokenizers.PATTERN)

    class Counted:
        def findall(self, text):
            calls.append(text)
            return split.findall(text)
    monkeypatch.setattr(bpe.regex, "compile", lambda pattern: Counted())
    for pattern in (public_tokenizers.PATTERN, "other"):
        (_, _, counts, codes, words), = bpe.runs(iter([part]), pattern)
        found, ends = np.array(words, dtype=object)[codes.astype(int)].tolist(), np.cumsum(counts)
        assert [found[e - n:e] for n, e in zip(counts, ends)] == [split.findall(t or "") for t in texts]
    monkeypatch.undo()
    plain = pd.DataFrame({"doc": ["1"], "body": [" ".join(f"w{i}" for i in range(500))]})
    del calls[:]
    monkeypatch.setattr(bpe.regex, "compile", lambda pattern: Counted())
    assert len(next(bpe.runs(iter([plain]), public_tokenizers.PATTERN, positions=False))[4]) and len(calls) <= 2
    monkeypatch.undo()
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = [bytes(rng.choices(b"aabcdeht .\n\xc3\xa9\xff0", k=rng.randrange(60))) for _ in range(3000)]
    short = [bpe.merge(w, ranks) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [bpe.merge(w, ranks) for w in words]
