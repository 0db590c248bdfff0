"""Conversation structure repair by an auction shortest-path algorithm.

A conversation's rows and the states of the wanted role pattern ``(s?(ua)+)?`` span a lattice: node (i, state) stands for
i rows consumed, and the edits are its arcs, whose costs are whole numbers. The auction keeps a price per node that no arc
undercuts (p <= cost + p of the head) and a path whose arcs are tight (p = cost + p of the head). From the path's end it
either extends along the cheapest arc or, when the price has to rise to that arc, contracts by one node. A path that
reaches a node of known distance makes the prices on it exact, so the nodes of a column are its origins one after the
other, from the last column to the first, with the prices of the column behind as the starting bid. The converged prices
expose all tight arcs; walking them from (0, start) by the least letter gives the cheapest edits that come first in ASCII.

Prices in a column differ by at most a few inserts, so few different columns exist: a solved one is kept under its row's
kind and the prices behind it, less their smallest, and the work per row is a lookup.

All rows of a conversation are collected in the only shuffle: the digest of a repaired conversation is over one value, so
it is one row by contract. Memory of a task is one Arrow batch and the longest conversation.

Defined cases: null conversations are one conversation; null roles and texts are one space, so such a text is blank;
null turns come first; rows of one turn are taken by role, then text (code points), so equal rows lie beside each other;
a role's initial is its first character, an empty role has none, and both can only be reroled or deleted; a conversation
without rows has zeros and no edits; an empty table gives no rows; very long texts and conversations are taken whole;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCHEMA = ("conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired array<struct<role:string,text:string>>")
#: States: nothing said, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
_END = -1
_SAID = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"


def auction(arcs: dict[int, list[tuple[int, str, object]]], price: dict, settled: set) -> None:
    """Raises the prices of all nodes of ``arcs`` to their distances from the settled nodes.

    ``arcs`` has (cost, letter, head) by tail. Prices must start at or below the distances, with no arc undercut.
    """
    for origin in arcs:
        path = [origin]
        while path[-1] not in settled:
            node = path[-1]
            bid, head = min(((cost + price[head], head) for cost, _, head in arcs[node]), key=lambda x: x[0])
            if price[node] < bid:
                price[node] = bid
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        settled.update(path)


def _column(kind: tuple[str, str], behind: tuple[int, ...] | None) -> tuple[int, tuple[int, ...], tuple]:
    """Solves one column: how far its prices lie above those behind, the prices less their smallest, and the way of
    each state: the letters up to and with the row's own, and the state behind it.

    ``kind`` is the row's initial and fault; ``behind`` None stands for the end of the conversation.
    """
    initial, fault = kind
    extra = TRUNCATED if fault == "truncated" else 0
    arcs = {}
    for state in range(4):
        said = USER if state != USER else ASSISTANT
        arcs[state] = [(INSERT, "I", said)]
        if behind is None:
            if state in (START, ASSISTANT):
                arcs[state].append((0, "", (_END, state)))
            continue
        arcs[state].append((DELETE, "D", (_END, state)))
        if fault not in ("blank", "duplicate"):
            arcs[state].append((REROLE + extra, "R", (_END, said)))
            kept = NEXT.get(initial, {}).get(state)
            if kept is not None:
                arcs[state].append((KEEP + extra, "K", (_END, kept)))
    price = {(_END, state): p for state, p in enumerate(behind or (0, 0, 0, 0))}
    settled = set(price)
    price |= dict.fromkeys(range(4), 0)
    auction(arcs, price, settled)
    ways = []
    for state in range(4):
        letters, node = "", state
        while not isinstance(node, tuple):
            tight = [(letter, head) for cost, letter, head in arcs[node] if price[node] == cost + price[head]]
            letter, node = min(tight, key=lambda x: x[0])
            letters += letter
        ways.append((letters, node[1]))
    low = min(price[s] for s in range(4))
    return low, tuple(price[s] - low for s in range(4)), tuple(ways)


class Lattice:
    """Cheapest edits of conversations, with solved columns kept."""

    def __init__(self) -> None:
        self.known: dict = {}

    def column(self, kind: tuple[str, str], behind: tuple[int, ...] | None):
        found = self.known.get((kind, behind))
        if found is None:
            found = self.known[kind, behind] = _column(kind, behind)
        return found

    def solve(self, kinds: list[tuple[str, str]]) -> tuple[int, list[str]]:
        """The cost, and the letters of each row (inserts before it included), then those behind the last row."""
        base, prices, end = self.column(("", ""), None)
        columns = [end]
        for kind in reversed(kinds):
            low, prices, ways = self.column(kind, prices)
            base += low
            columns.append(ways)
        state, letters = START, []
        for ways in reversed(columns):
            said, state = ways[state]
            letters.append(said)
        return base + prices[START], letters


def _kind(initial: str) -> str:
    return initial if initial in NEXT else ""


def repair_one(lattice: Lattice, rows: list[tuple]) -> tuple:
    """The result's columns behind conv_id, for rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        if not _SAID.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if text.rstrip(_BLANKS)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    initials = [role[:1] for _, role, _ in rows]
    cost, letters = lattice.solve([(_kind(i), f) for i, f in zip(initials, faults)])
    repaired, state = [], START
    for at, said in enumerate(letters):
        for letter in said:
            if letter == "D":
                continue
            _, role, text = rows[at] if letter != "I" else (None, "", "")
            if letter != "K":
                role = ROLE[state]
            state = NEXT[role[:1]][state]
            repaired.append({"role": role, "text": text})
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return (len(rows), gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, "".join(letters), repaired)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lattice = Lattice()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    said = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    types = [pa.int64()] * 8 + [pa.string(), said]
    for batch in batches:
        lists = batch.column("rows")
        flat = lists.flatten()
        fields = [flat.field(k).to_pylist() for k in range(3)]
        at, out = 0, []
        for conv, n in zip(batch.column("conv_id").to_pylist(), lists.value_lengths().to_pylist()):
            out.append((conv, *repair_one(lattice, list(zip(*(f[at:at + n] for f in fields))))))
            at += n
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def repair(conversations: DataFrame, times: Column | int = 1) -> DataFrame:
    """Per conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role, text).

    ``times`` tells how often each row of the table counts; conversations all of whose rows count 0 times are returned too.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    row = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.array_repeat(row, F.lit(times).cast("int")).alias("rows"))
    return rows.groupBy("conv_id").agg(F.flatten(F.collect_list("rows")).alias("rows")).mapInArrow(_repaired, SCHEMA)


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The table with a fixed fifth of its rows damaged, and how often each of them counts then."""
    name = F.concat(*[F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    marked = conversations.select("conv_id", "turn", "role", text.alias("text"), (F.crc32(name) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault"), times


def report(conversations: DataFrame) -> DataFrame:
    done = repair(*damage(conversations))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
