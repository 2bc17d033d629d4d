"""Repair of conversations by a dynamic program over a Re-Pair grammar.

Every row of a conversation is kept, re-roled (to user or assistant) or deleted, and
empty rows may be inserted, at the least cost that makes the role initials read
``(s?(ua)+)?``. Blank rows and repeats must go; a truncated row that stays costs more.

Steps
1. Rows get a place: sorted by conversation, turn (nulls first) and a hash of role and
   text, ranges of rows to a task, so that a conversation may span many tasks.
2. A row becomes one of nine symbols: its role (s, u, a, other), upper case if its
   text is cut short, or x if it must go. The rows of a conversation that share a block
   of ``BLOCK`` places are a piece; pieces are short strings, equal ones are solved once.
3. Re-Pair: in rounds over all distinct pieces, weighted by their copies, the commonest
   pairs of neighbours that have no symbol in common become new symbols.
4. A symbol has a min-plus matrix over the states of the pattern (nothing yet, after s,
   after u, after a): the least cost from state to state and a rope of the edits. A
   rule's matrix is the product of its two; ropes share their parts. Words of edits that
   end in a row's own letter are never beginnings of each other, so their order among
   the words from one state is a rank, and the product needs ranks, not words, to break
   ties by the least audit.
5. A piece's matrix is the product over its grammar symbols. Costs and ranks of a
   conversation's pieces are folded, at most ``WIDTH`` at a time and in as many levels as
   the longest conversation needs; the states chosen go back down to the pieces.
6. Edits meet the texts by conversation, turn and hash.

Defined results
  null role or text       read as one space: another role, a blank text
  null turn               before all turns; left out of gaps
  null conversation       one conversation
  empty or long texts     empty is blank; texts are hashed and trimmed whole
  ties in turn            ordered by a hash of role and text; equal rows are adjacent
  repeated rows           all but the first are duplicates
  empty table             empty results
  extra columns           left out, whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored

BLOCK_BITS = 8             # places of a block: 256 rows at most in a piece
WIDTH = 256                # pieces or nodes folded at once
RULES = 128                # grammar rules; what they don't cover is folded symbol by symbol
BLANKS = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3

NONE, SYSTEM, USER, ASSISTANT = range(4)                       # states
STEP = {"u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "s": {NONE: SYSTEM}}
NEXT = {NONE: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}     # what may be inserted
CLOSING = {NONE: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "a"), SYSTEM: (2 * INSERT, "ua")}
#: Edits are written u, a (inserted), K, U, A (kept, re-roled), D; the audit has their initials.
LETTERS = str.maketrans("uaUA", "IIRR")
FAR = 1 << 40


# ---- matrices: {(from, to): (cost, rank among the words from that state, rope)} ----

def ranked(best: dict) -> dict:
    """Replace the second part of (cost, order, rope) by its rank among those of one start."""
    out = {}
    for i in range(4):
        row = sorted((x[1], j) for (s, j), x in best.items() if s == i)
        for rank, (_, j) in enumerate(row):
            cost, _, rope = best[i, j]
            out[i, j] = (cost, rank, rope)
    return out


def symbol_matrix(symbol: str) -> dict:
    best: dict = {}
    for start in range(4):
        state, put = start, ""
        for _ in range(3):                                     # up to two insertions first
            ways = [(DELETE, "D", state)]
            if symbol != "x":
                more = CUT_SHORT if symbol.isupper() else 0
                ways.append((REROLE + more, NEXT[state].upper(), STEP[NEXT[state]][state]))
                to = STEP.get(symbol.lower(), {}).get(state)
                if to is not None:
                    ways.append((KEEP + more, "K", to))
            for cost, how, to in ways:
                word = put + how
                new = (INSERT * len(put) + cost, word.translate(LETTERS), word)
                if (start, to) not in best or new < best[start, to]:
                    best[start, to] = new
            put += NEXT[state]
            state = STEP[NEXT[state]][state]
    return ranked(best)


def product(a: dict, b: dict) -> dict:
    best: dict = {}
    for (i, k), (c1, r1, p1) in a.items():
        for (m, j), (c2, r2, p2) in b.items():
            if k == m:
                new = (c1 + c2, (r1, r2), (p1, p2))
                if (i, j) not in best or new[:2] < best[i, j][:2]:
                    best[i, j] = new
    return ranked(best)


def written(rope) -> str:
    """The word of a rope, without recursion."""
    out, stack = [], [rope]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack += [part[1], part[0]]
    return "".join(out)


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, dict]:
    """The matrix of every symbol: the nine of rows, then rule by rule from below."""
    known = {s: symbol_matrix(s) for s in "suaoSUAOx"}
    for pair, name in rules:
        known[name] = product(known[pair[0]], known[pair[1]])
    return known


# ---- grammar ----

def packed(seq: Column, rules: list[tuple[str, str]]) -> Column:
    """The sequence with every rule applied, in order."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, seq)


def grammar(seqs: DataFrame, most: int = RULES) -> list[tuple[str, str]]:
    """(pair, name) rules over the distinct sequences (seq, copies). The driver gets at
    most ``most`` pairs a round. Pairs chosen in one round share no symbol, so the order
    of their replacement doesn't matter; counts of a pair of equal symbols include
    overlaps."""
    rules: list[tuple[str, str]] = []
    while len(rules) < most:
        body = packed(F.col("seq"), rules)
        pairs = (seqs.select(body.alias("body"), "copies").where("length(body) > 1")
                 .select(F.explode(F.expr("transform(sequence(1, length(body) - 1), i -> substring(body, i, 2))"))
                         .alias("pair"), "copies")
                 .groupBy("pair").agg(F.sum("copies").alias("n")).where("n > 1")
                 .orderBy(F.desc("n"), "pair").limit(most).collect())
        used: set[str] = set()
        for r in pairs:
            if len(rules) < most and not used & set(r["pair"]):
                used |= set(r["pair"])
                rules.append((r["pair"], chr(0xE000 + len(rules))))
        if not used:
            break
    return rules


def solved(seqs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(seq, costs, ranks, words): 16 entries each, by 4 * from + to."""
    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = rule_matrices(rules)
        for part in parts:
            rows = []
            for seq, body in zip(part["seq"], part["body"]):
                m = reduce(product, (known[s] for s in body))
                cells = [m.get((k // 4, k % 4), (FAR, 9, "")) for k in range(16)]
                rows.append((seq, [c[0] for c in cells], [c[1] for c in cells], [written(c[2]) for c in cells]))
            yield pd.DataFrame(rows, columns=["seq", "costs", "ranks", "words"])

    return seqs.select("seq", packed(F.col("seq"), rules).alias("body")).mapInPandas(
        solve, "seq string, costs array<long>, ranks array<int>, words array<string>")


# ---- rows, pieces ----

def read(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, h1, h2) with nulls of role and text as one space."""
    return (rows.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"),
                        F.coalesce(col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(col(text).cast("string"), F.lit(" ")).alias("text"))
            .withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role")}))


def pieces(rows: DataFrame) -> DataFrame:
    """(conv, at, rows, seq, roles, blank, duplicate, truncated, illegal) per piece."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    first = F.left("role", F.lit(1))
    order = ["conv", "turn", "h1", "h2", "row"]
    light = (rows.select("conv", "turn", "h1", "h2", F.monotonically_increasing_id().alias("row"),
                         F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("role"),
                         F.when(end == "", "b").when(end.isin(".", "!", "?"), "").otherwise("t").alias("fault"))
             .repartitionByRange(*order).sortWithinPartitions(*order)
             .select("conv", "turn", "h1", "h2", "role", "fault", F.monotonically_increasing_id().alias("at")))
    light = stored(light, "conversation-rows")
    again = (light.groupBy(F.col("conv").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
             .agg(F.min("at").alias("seen"), F.count("*").alias("n")).where("n > 1"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    fault = F.when((F.col("fault") != "b") & (F.col("seen") < F.col("at")), "d").otherwise(F.col("fault"))
    symbol = (F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("role"))
              .otherwise(F.col("role")))
    count = lambda f: F.sum(F.when(F.col("fault") == f, 1).otherwise(0))
    grouped = (light.join(again, same, "left").withColumn("fault", fault).withColumn("symbol", symbol)
               .groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block"))
               .agg(F.min("at").alias("at"), count("b").alias("blank"), count("d").alias("duplicate"),
                    count("t").alias("truncated"),
                    F.array_sort(F.collect_list(F.struct("at", "turn", "h1", "h2", "role", "symbol"))).alias("rows")))
    return stored(grouped.select(
        "conv", "at", "blank", "duplicate", "truncated",
        F.expr("transform(rows, r -> struct(r.turn, r.h1, r.h2))").alias("rows"),
        F.expr("array_join(transform(rows, r -> r.symbol), '')").alias("seq"),
        F.expr("array_join(transform(rows, r -> r.role), '')").alias("roles"))
        .withColumn("illegal", F.expr("""size(filter(transform(rows, (r, i) -> substring(roles, i, 2)),
                                         (p, i) -> i > 0 AND p NOT IN ('su', 'ua', 'au')))""")), "conversation-pieces")


# ---- folding the pieces of a conversation ----

NODE = ("at long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
        "costs array<long>, ranks array<int>")
PICK = "at long, i int, j int"


def matrix_of(node) -> dict:
    return {(k // 4, k % 4): (int(c), int(r), None) for k, (c, r) in enumerate(zip(node["costs"], node["ranks"]))
            if c < FAR}


def folded(nodes: list) -> dict:
    """One node for neighbours in order."""
    m = reduce(product, map(matrix_of, nodes))
    cells = [m.get((k // 4, k % 4), (FAR, 9, None)) for k in range(16)]
    seams = sum((a["last"] + b["first"]) not in ("su", "ua", "au") for a, b in zip(nodes, nodes[1:]))
    return {"at": nodes[0]["at"], "first": nodes[0]["first"], "last": nodes[-1]["last"],
            **{k: sum(n[k] for n in nodes) for k in ("blank", "duplicate", "truncated")},
            "illegal": seams + sum(n["illegal"] for n in nodes),
            "costs": [c[0] for c in cells], "ranks": [c[1] for c in cells]}


def route(nodes: list, start: int, stop: int) -> list[dict]:
    """The states before and after every node on the best way from start to stop."""
    now, back = {start: (0, ())}, []
    for m in map(matrix_of, nodes):
        best: dict = {}
        for (i, j), (cost, rank, _) in m.items():
            if i in now:
                new = (now[i][0] + cost, (now[i][1], rank), i)
                if j not in best or new < best[j]:
                    best[j] = new
        order = {x: n for n, x in enumerate(sorted(b[1] for b in best.values()))}
        now = {j: (b[0], order[b[1]]) for j, b in best.items()}
        back.append({j: b[2] for j, b in best.items()})
        # Ranks of the next step compare with these alone: one number a state.
    picks, j = [], stop
    for node, step in zip(reversed(nodes), reversed(back)):
        picks.append({"at": node["at"], "i": step[j], "j": j})
        j = step[j]
    return picks[::-1]


def gathered(nodes: DataFrame, key: Column) -> DataFrame:
    return (nodes.groupBy("conv", key.alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct(*[x.split()[0] for x in NODE.split(", ")]))).alias("nodes")))


def upward(nodes: DataFrame, shift: int) -> DataFrame:
    """Nodes of a conversation that share ``at >> shift`` become one, with their list."""
    @F.pandas_udf(NODE)
    def fold(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([folded(list(x)) for x in lists], columns=[x.split()[0] for x in NODE.split(", ")])

    return gathered(nodes, F.shiftright("at", shift)).withColumn("node", fold("nodes")).select(
        "conv", "node.*", "nodes")


def closed(nodes: DataFrame) -> DataFrame:
    """(conv, counts, cost, closing, picks) from all nodes of each conversation."""
    out = (f"blank long, duplicate long, truncated long, illegal long, cost long, closing string, "
           f"picks array<struct<{PICK.replace(' ', ':').replace(',:', ',')}>>")

    @F.pandas_udf(out)
    def close(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for x in lists:
            x = list(x)
            all_ = folded(x)
            cost, _, stop = min((all_["costs"][j] + CLOSING[j][0], all_["ranks"][j], j) for j in range(4))
            rows.append((*(all_[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost,
                         CLOSING[stop][1], route(x, NONE, stop)))
        return pd.DataFrame(rows, columns=[p.split()[0] for p in out.split(", ")[:7]])

    return gathered(nodes, F.lit(0)).select("conv", close("nodes").alias("c")).select("conv", "c.*")


def downward(level: DataFrame, picks: DataFrame) -> DataFrame:
    """(at, i, j) of the nodes inside the chosen nodes of a level."""
    @F.pandas_udf(f"array<struct<{PICK.replace(' ', ':').replace(',:', ',')}>>")
    def inner(lists: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series([route(list(x), int(a), int(b)) for x, a, b in zip(lists, i, j)])

    return level.join(picks, "at").select(F.inline(inner("nodes", "i", "j")))


class Repaired:
    """What ``repair`` found. ``summary``: conv, gaps, blank, duplicate, truncated,
    illegal, cost, closing. ``audits``: conv, at, audit, the audit in order of ``at`` in
    pieces. ``rows``: conv, at, sub, role, text, the repaired conversations."""

    def __init__(self, summary: DataFrame, audits: DataFrame, rows: DataFrame):
        self.summary, self.audits, self.rows = summary, audits, rows


def repair(given: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> Repaired:
    rows = read(given, conv, turn, role, text)
    found = pieces(rows)
    seqs = stored(found.groupBy("seq").agg(F.count("*").alias("copies")), "conversation-sequences")
    answers = stored(solved(seqs, grammar(seqs)), "conversation-answers")
    nodes = (found.join(answers.drop("words"), "seq")
             .select("conv", "at", "blank", "duplicate", "truncated", F.col("illegal").cast("long").alias("illegal"),
                     F.left("roles", F.lit(1)).alias("first"), F.right("roles", F.lit(1)).alias("last"),
                     "costs", "ranks"))
    levels, shift = [], BLOCK_BITS
    while nodes.groupBy("conv").count().where(f"count > {WIDTH}").limit(1).count():
        shift += BLOCK_BITS
        levels.append(stored(upward(nodes, shift), "conversation-level"))
        nodes = levels[-1].drop("nodes")
    ends = stored(closed(nodes), "conversation-ends")
    picks = ends.select(F.inline("picks"))
    for level in reversed(levels):
        picks = downward(level, picks)
    cell = F.element_at("words", 4 * F.col("i") + F.col("j") + 1)
    edited = stored(found.join(picks, "at").join(answers.select("seq", "words"), "seq")
                    .select("conv", "at", "rows", cell.alias("word")), "conversation-edits")
    turns = (rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv").alias("c"))
             .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")))
    summary = (ends.drop("picks").join(turns, F.col("conv").eqNullSafe(F.col("c"))).drop("c"))
    audits = edited.select("conv", "at", F.translate("word", "uaUA", "IIRR").alias("audit"))
    return Repaired(summary, audits, repaired_rows(rows, edited, ends))


def repaired_rows(rows: DataFrame, edited: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv, at, sub, role, text): the rows that stay and the inserted ones, by place."""
    per_row = (edited.select("conv", "at", F.posexplode(F.arrays_zip(
                   "rows", F.regexp_extract_all("word", F.lit("([ua]*[KUAD])"), F.lit(1)).alias("edit"))).alias("n", "r"))
               .select("conv", (F.col("at") + F.col("n")).alias("at"), "r.rows.*", "r.edit"))
    named = F.when(F.col("how").isin("u", "U"), "user").otherwise("assistant")
    steps = per_row.select("conv", "at", "turn", "h1", "h2", F.posexplode(F.split("edit", "")).alias("sub", "how"))
    new = (steps.where("how in ('u', 'a')").select("conv", "at", "sub", named.alias("role"), F.lit("").alias("text")))
    tail = (ends.select("conv", F.posexplode(F.split("closing", "")).alias("sub", "how")).where("how <> ''")
            .select("conv", F.lit((1 << 63) - 1).alias("at"), "sub", named.alias("role"), F.lit("").alias("text")))
    stay = steps.where("how in ('K', 'U', 'A')").select(
        F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("h1").alias("g1"), F.col("h2").alias("g2"),
        "at", "sub", "how")
    one = rows.groupBy("conv", "turn", "h1", "h2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = (one.join(stay, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
                     & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
            .select("conv", "at", "sub", F.when(F.col("how") == "K", F.col("role")).otherwise(named).alias("role"),
                    "text"))
    return kept.union(new).union(tail)


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired ``role:text`` lines, newline-joined. The hash of a
    conversation runs in order by its nature: its rows are sorted in one task, which
    spills, and are read as a stream, never held together."""
    kind = rows.schema["conv"].dataType.simpleString()

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for part in parts:
            done = []
            for conv, none, line in zip(part["conv"].tolist(), part["none"].tolist(), part["line"]):
                if (conv, none) == now:
                    sha.update(b"\n")
                else:
                    if now is not None:
                        done.append((None if now[1] else now[0], sha.hexdigest()))
                    now, sha = (conv, none), hashlib.sha256()
                sha.update(line.encode())
            yield pd.DataFrame(done, columns=["conv", "sha256"])
        if now is not None:
            yield pd.DataFrame([(None if now[1] else now[0], sha.hexdigest())], columns=["conv", "sha256"])

    return (rows.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"),
                        F.col("conv").isNull().alias("none"), "at", "sub", F.concat_ws(":", "role", "text").alias("line"))
            .repartition("conv", "none").sortWithinPartitions("conv", "none", "at", "sub")
            .drop("at", "sub").mapInPandas(stream, "conv string, sha256 string")
            .select(F.col("conv").cast(kind).alias("conv"), "sha256"))
