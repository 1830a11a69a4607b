"""Conversation repair against a shortest-path search over whole conversations."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from assayline.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) of the least edits by (cost, audit), by best-first search over whole
    conversations. Rows are (role, text, fault)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        if (at, state) in done:
            continue
        done.add((at, state))
        step = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[step]
        heapq.heappush(queue, (cost + 5, audit + "I", at, step, (*lines, f"{name}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        extra = 5 if fault == "truncated" else 0
        if role[:1] and role[:1] in after[state]:
            heapq.heappush(queue, (cost + extra, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
        heapq.heappush(queue, (cost + extra + 1, audit + "R", at + 1, step, (*lines, f"{name}:{text}")))


def judged(rows):
    """What the query returns for the rows (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faulty = set(), []
    for _, role, text in rows:
        ended = text.rstrip(BLANKS)
        if not ended:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if ended[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for r, _, _ in faulty]
    cost, audit, lines = cheapest(faulty)
    kinds = [f for _, _, f in faulty]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(named.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows):
        found[conv].append((turn, role, text))
    return {conv: judged(turns) for conv, turns in found.items()}


def repaired(rows):
    """The same from the operator, without the damage."""
    turns, report = repair.repair(rows)
    hashes = {r.conv_id: r.sha256 for r in repair.digests(turns).collect()}
    return {
        r.conv_id: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")],
                    hashes.get(r.conv_id, hashlib.sha256(b"").hexdigest()))
        for r in report.collect()
    }


def by_conversation(rows):
    found = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        found.setdefault(conv, []).append((turn, role, text))
    return {conv: judged(turns) for conv, turns in found.items()}


def test_query_equals_a_search_over_whole_conversations(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, folder).collect()}
    assert found == expected(rows)


def random_rows(seed, conversations, longest):
    pick = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        roles = pick.choice([["user", "assistant"], ["user", "assistant", "system", "tool", "", None, "agent"]])
        texts = ["One.", "two", "", " \n", "Why?", "no end \t", None, "a!", "x"] + [f"{i}." for i in range(longest)]
        turn = 0
        for _ in range(pick.randint(1, longest)):
            turn += pick.choice([1, 1, 1, 3])
            rows.append((conv, turn, pick.choice(roles), pick.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [2, 256])
def test_random_conversations_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = random_rows(block, 25, 24)
    assert repaired(spark.createDataFrame(rows, SCHEMA)) == by_conversation(rows)


def test_nulls_repeats_and_ties(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(repair, "COPIES", 2)
    rows = [(1, None, None, None), (1, None, "user", "Hello."), (2, 5, "user", "A."), (3, None, "system", "S.")]
    rows += [(4, 0, "user", "Again.")] * 23 + [(4, 1, "assistant", "Once.")]
    rows += [(None, 0, "user", "u."), (None, 1, "assistant", "v.")]
    rows += [(5, 0, "assistant", "long " * 50_000 + "."), (6, 3, "user", "")]
    found = repaired(spark.createDataFrame(rows, SCHEMA).withColumn("alone", F.lit(1)).withColumn("__d1", F.lit("x")))
    assert found == by_conversation(rows)
    assert found[4][6] == "K" + "D" * 22 + "K" and found[None][6] == "KK"


def test_empty_table(spark):
    turns, report = repair.repair(spark.createDataFrame([], SCHEMA))
    assert turns.count() == 0 and report.count() == 0 and repair.digests(turns).count() == 0


def test_each_suffix_is_computed_once(monkeypatch):
    import pyarrow as pa

    signatures = sorted(s[::-1] for s in ["ua", "sua", "dua", "uaua", "Suaua", "a", ""])
    made = []
    plain = repair.node
    monkeypatch.setattr(repair, "node", lambda symbol, after: made.append(1) or plain(symbol, after))
    batch = pa.record_batch({"after": pa.array([repair.FINISH] * len(signatures)), "backwards": pa.array(signatures)})
    list(repair._walk(iter([batch.slice(0, 3), batch.slice(3)])))
    assert len(made) == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
