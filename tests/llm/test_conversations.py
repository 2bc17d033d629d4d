"""Conversation repair: a search over all edits, the contract's damage, many pieces."""

import hashlib
import heapq
import random
import zlib

from zonegrid.llm import convrepair, queries

SCHEMA = "conv_id long, turn long, role string, text string, at string, seq int, conv string"   # clashing names
BLANKS = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, audit, kept (role, text)) by a best-first search over (row, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, n, last, out = heapq.heappop(heap)
        if (n, last) in done:
            continue
        done.add((n, last))
        if n == len(rows) and last in ("", "a"):
            return cost, audit, out
        want = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        heapq.heappush(heap, (cost + 3, audit + "I", n, want, (*out, (name, ""))))
        if n < len(rows):
            role, text, fault = rows[n]
            heapq.heappush(heap, (cost + 4, audit + "D", n + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", n + 1, want, (*out, (name, text))))
                if role[:1] == want or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", n + 1, role[:1], (*out, (role, text))))


def brute(rows):
    """The contract's answer for a conversation's rows (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    roles = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, out = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in (
        "blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())


def damage(given):
    convs = {}
    for conv, turn, role, text in given:
        rows = convs.setdefault(conv, [])
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        if kind:
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in convs.items()}


def sample(seed, convs=60, rows=9):
    r = random.Random(seed)
    texts = ["Hi there.", "Why?", "cut short", "", " \t", "Yes!", "one more. \n", "\x1c", "été.", None]
    out = []
    for c in range(convs):
        turns = r.sample(range(30), r.randint(1, rows))
        for t in turns:
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            out.append((c or None, t if t else None, role, r.choice(texts) if r.random() < .4 else f"text {r.randint(0, 9)}."))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def answers(spark, given, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, given))
    return {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, "").collect()}


def test_matches_a_search_over_all_edits(spark, tmp_path, monkeypatch):
    given = sample(1, 150)
    got = answers(spark, given, tmp_path, monkeypatch)
    want = {c: brute(r) for c, r in damage(given).items()}
    assert got == want and len({w[6] for w in want.values()}) > 60


def test_long_conversations_are_folded_in_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(convrepair, "BLOCK_BITS", 3)
    monkeypatch.setattr(convrepair, "WIDTH", 4)
    r = random.Random(5)
    given = [(c, t, r.choice(["user", "assistant", "system"]), f"{r.randint(0, 400)}{r.choice(['.', '.', ''])}")
             for c, n in ((1, 1500), (2, 90), (3, 9)) for t in range(n)]
    got = answers(spark, given, tmp_path, monkeypatch)
    assert got == {c: brute(x) for c, x in damage(given).items()}


def test_given_tables(spark):
    import pyarrow.parquet as pq
    given = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/conversations.parquet")
             .select(["conv_id", "turn", "role", "text"]).to_pylist()]
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == {c: brute(x) for c, x in damage(given).items()}


def test_edges(spark):
    none = convrepair.repair(frame(spark, []).limit(0))
    assert none.summary.count() == none.audits.count() == none.rows.count() == 0
    text = "long " * 200_000 + "end."
    same = convrepair.repair(frame(spark, [(1, 1, "user", text)] * 40 + [(1, 2, "assistant", text)]))
    one = same.summary.first()
    assert (one["duplicate"], one["cost"], one["illegal"]) == (39, 39 * 4, 39)
    assert [(r["role"], r["text"]) for r in same.rows.orderBy("at", "sub").collect()] == [("user", text), ("assistant", text)]


def test_matrices_agree_with_the_search():
    r = random.Random(3)
    for _ in range(300):
        seq = "".join(r.choice("uuaasoUAx") for _ in range(r.randint(1, 10)))
        names = {"u": "user", "a": "assistant", "s": "system", "o": "tool"}
        rows = [(names.get(c.lower(), "x"), "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in seq]
        known = convrepair.rule_matrices([(seq[:2], "")] if len(seq) > 1 else [])
        m = known[seq] if len(seq) == 1 else known[""]
        for c in seq[2:]:
            m = convrepair.product(m, known[c])
        cost, _, end = min((m[0, j][0] + convrepair.CLOSING[j][0], m[0, j][1], j) for j in range(4) if (0, j) in m)
        word = convrepair.written(m[0, end][2]) + convrepair.CLOSING[end][1]
        assert (cost, word.translate(convrepair.LETTERS)) == cheapest(rows)[:2]
