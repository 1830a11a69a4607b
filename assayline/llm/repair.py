"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A row's symbol says what an edit of it may cost: a row that must go (blank, or a repeat of an earlier
role and text), or its role's initial, as a capital if its text is cut short. A conversation's
symbols in turn order are its signature. Edits are Delete (2), Insert of an empty turn (5), Keep (0) and
Rerole (1), with 5 more for a kept row that is cut short; the result must read ``(s?(ua)+)?``.

Distinct signatures, sorted from their ends, are walked as one automaton whose nodes are
the distinct suffixes: a signature shares all nodes of its longest common suffix with the one
before it, so cost-to-go, least audit and last grammar state are computed once per node and grammar
state, whatever number of conversations shares it (once more for each range the sort is cut into). Of
edits of equal cost the ASCII-least initial wins; inserts stand before the row they precede, so no audit of a
block is the beginning of another one.

A conversation may hold a good part of all rows, so no step sees one whole: rows are sorted by
range, blocks of at most ``BLOCK`` of them are signatures of their own, a block's costs between grammar
states come from the same automaton, and only these are chained along a conversation
(block by block from its end). Rows that repeat are counted before they are shuffled.

Rows are taken by turn (null first), then role, then a hash of role and text. Null role or text is one
space. Null ids form one conversation. An empty table gives empty results; other columns are ignored. The
audit of a conversation and each text must fit in memory; its repaired text is hashed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.columns import SPACES, join_on, salted
from assayline.session import materialise

BLOCK = 256  # rows of a signature at most
COPIES = 8  # of a repeated row that stand for one row of a block
SALTS = 16

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: Grammar states: start, after system, after user, after assistant.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: What a reroled or inserted turn must be in each state, and the state after it.
WANTED = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
#: Edits that finish a conversation from each state.
FINISH = "finish"
_FINISHED = ((0, 10, 5, 0), ("", "II", "I", ""), (0, 3, 3, 3))


def node(symbol: str, after: tuple) -> tuple:
    """Cost-to-go, audit and last state of a row and all after it, for each state before it."""
    costs, audits, ends = after
    extra, role = (CUT_SHORT, symbol.lower()) if symbol.isupper() else (0, symbol)
    plain = []
    for state in range(4):
        best = (DELETE + costs[state], "D" + audits[state], ends[state])
        if symbol != "d":
            to = WANTED[state][1]
            best = min(best, (REROLE + extra + costs[to], "R" + audits[to], ends[to]))
            to = MOVES.get((state, role))
            if to is not None:
                best = min(best, (KEEP + extra + costs[to], "K" + audits[to], ends[to]))
        plain.append(best)
    found = []
    for state in range(4):
        once = WANTED[state][1]
        twice = WANTED[once][1]
        options = [plain[state]]
        for count, to in ((1, once), (2, twice)):
            cost, audit, end = plain[to]
            options.append((count * INSERT + cost, "I" * count + audit, end))
        found.append(min(options))
    return tuple(zip(*found))


def _terminal(after: str) -> tuple:
    """``after`` is FINISH, or the costs from each state on, for a block that others follow."""
    if after == FINISH:
        return _FINISHED
    return tuple(map(int, after.split(","))), ("",) * 4, (0, 1, 2, 3)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures sorted by (after, reversed signature): the path to the last one is kept, and a new one
    starts from their common suffix."""
    last_after, last, path = None, "", []
    for batch in batches:
        out = []
        for after, backwards in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if after != last_after:
                last_after, last, path = after, "", [_terminal(after)]
            shared = 0
            for a, b in zip(last, backwards):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for symbol in backwards[shared:]:
                path.append(node(symbol, path[-1]))
            last = backwards
            out.append(path[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)] + [
                pa.array([list(x[i]) for x in out], pa.list_(k))
                for i, k in enumerate((pa.int64(), pa.string(), pa.int32()))
            ],
            ["after", "backwards", "costs", "audits", "ends"],
        )


def _automaton(wanted: DataFrame) -> DataFrame:
    """``(after, backwards, costs, audits, ends)`` of the distinct rows of ``wanted``."""
    ranged = wanted.distinct().repartitionByRange("after", "backwards").sortWithinPartitions("after", "backwards")
    return ranged.mapInArrow(
        _walk, "after string, backwards string, costs array<bigint>, audits array<string>, ends array<int>"
    )


def faults(role: Column, text: Column) -> Column:
    """``blank``, ``cut`` (short) or null, for non-null values."""
    ended = F.rtrim(text, F.lit(SPACES))
    return F.when(ended == "", "blank").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "cut")


def _keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, __turn, role, text, __d1, __d2); the digests tell rows of a turn apart."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    given = rows.select("conv_id", F.col("turn").alias("__turn"), role, text)
    return given.withColumn("__d1", F.xxhash64("role", "text")).withColumn("__d2", F.xxhash64(F.lit(1), "text", "role"))


_ROW = ["conv_id", "__turn", "__d1", "__d2"]


def _marked(keyed: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n``, their fault, and whether they are the first of their role
    and text."""
    initial = F.left("role", F.lit(1))
    narrow = keyed.select(
        *_ROW, "role", faults(F.col("role"), F.col("text")).alias("fault"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
    )
    rows = materialise(narrow.groupBy(*_ROW, "role", "fault", "initial").agg(F.count("*").alias("n")), "turns")
    least = rows.groupBy("conv_id", "__d1", "__d2").agg(F.min(F.struct("__turn")).alias("at"))
    first = least.select("conv_id", F.col("at.__turn").alias("__turn"), "__d1", "__d2", F.lit(True).alias("first"))
    return join_on(rows, first, _ROW, "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _statistics(marked: DataFrame) -> DataFrame:
    blank, ahead = F.col("fault") == "blank", F.col("first").cast("int")
    known = F.max("__turn") - F.min("__turn") + 1 - F.countDistinct("__turn")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return marked.groupBy("conv_id").agg(
        F.coalesce(known, F.lit(0)).cast("long").alias("gaps"),
        total(F.when(blank, F.col("n"))).alias("blank"),
        total(F.when(blank, 0).otherwise(F.col("n") - ahead)).alias("duplicate"),
        total(F.when(F.col("fault") == "cut", ahead)).alias("truncated"),
    )


def _blocks(marked: DataFrame) -> DataFrame:
    """``(conv_id, block, backwards, rows, illegal, head, tail)``: the rows of a conversation in order, cut
    where the sorted table is cut every ``BLOCK`` rows. ``rows`` are (symbols, keys of the row)."""
    symbol = F.when((F.col("fault") == "blank") | ~F.col("first"), "d").when(
        F.col("fault") == "cut", F.upper("initial")
    ).otherwise(F.col("initial"))
    # a row and its further copies, which are repeats: at most COPIES of them in one piece
    more = F.col("n") - 1
    pieces = marked.withColumn("symbol", symbol).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(more / COPIES).cast("bigint")))
    )
    held = F.least(F.lit(COPIES), more - (F.col("piece") - 1) * COPIES).cast("int")
    symbols = F.when(F.col("piece") == 0, F.col("symbol")).otherwise(F.repeat(F.lit("d"), held))
    order = ["conv_id", "__turn", "role", "__d1", "__d2", "piece"]
    placed = pieces.select(*order, "initial", symbols.alias("symbols")).repartitionByRange(*order)
    placed = placed.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = materialise(placed, "placed").groupBy("conv_id", (F.col("place") / BLOCK).cast("bigint").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "symbols", "initial", "__turn", "__d1", "__d2"))).alias("rows")
    )
    initials = F.col("rows.initial")
    pairs = F.zip_with(initials, F.slice(initials, F.lit(2), F.size("rows")), lambda a, b: F.concat(a, b))
    inner = F.aggregate("rows", F.lit(0), lambda n, r: n + F.length(r["symbols"]) - 1)
    return rows.select(
        "conv_id", "block", F.reverse(F.array_join("rows.symbols", "")).alias("backwards"), "rows",
        (F.size(F.filter(pairs, lambda p: ~_legal(p))) + inner).alias("illegal"),
        F.get(initials, F.lit(0)).alias("head"), F.element_at(initials, -1).alias("tail"),
    )


def _legal(pair: Column) -> Column:
    return pair.isin("su", "ua", "au")


def _chain_costs(blocks: list[tuple]) -> list[tuple]:
    """For blocks (number, costs[state before][state after]) of a conversation: (number, after, what
    ``after`` leaves out)."""
    after, base, out = FINISH, 0, []
    for number, between in sorted(blocks, reverse=True):
        out.append((number, after, base))
        costs = _FINISHED[0] if after == FINISH else tuple(map(int, after.split(",")))
        now = [min(between[s][e] + costs[e] for e in range(4)) for s in range(4)]
        base += min(now)
        after = ",".join(str(min(c - min(now), NEVER)) for c in now)
    return out


def _by_conversation(batches: Iterator[pa.RecordBatch], columns: list[str], whole) -> Iterator[pa.RecordBatch]:
    """The conversation and ``columns`` from the tuples that ``whole`` makes of the rows of each
    conversation, which come one after the other."""
    kind = pa.null()

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.column(0).type
            yield from zip(*[c.to_pylist() for c in batch.columns])

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        made = whole(r[1:] for r in group)
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv] * len(made), kind), *(pa.array(x) for x in zip(*made))], ["conv_id", *columns]
        )


def _along(blocks: DataFrame) -> DataFrame:
    """Dealt out by conversation, in the order of their blocks."""
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")


#: Costs after a block that allow one grammar state at its end only.
_ONLY = [",".join("0" if s == e else str(NEVER) for s in range(4)) for e in range(4)]


def _after(blocks: DataFrame, kind: str) -> DataFrame:
    """``(conv_id, block, after, base)`` of the blocks of long conversations: what follows each. Only
    the costs between a block's grammar states meet along a conversation."""
    asked = blocks.select("backwards", F.explode(F.array(*map(F.lit, _ONLY))).alias("after")).distinct()
    costs = _automaton(asked.select("after", "backwards")).groupBy("backwards").agg(
        F.map_from_entries(F.collect_list(F.struct("after", "costs"))).alias("costs")
    )
    between = F.array(*[F.col("costs")[after] for after in _ONLY])
    met = blocks.select("conv_id", "block", "backwards").join(costs, "backwards")

    def chain(rows: Iterator[tuple]) -> list[tuple]:
        return _chain_costs([(number, list(zip(*by_end))) for number, by_end in rows])

    return _along(met.select("conv_id", "block", between.alias("between"))).mapInArrow(
        lambda batches: _by_conversation(batches, ["block", "after", "base"], chain),
        f"conv_id {kind}, block bigint, after string, base bigint",
    )


def _starts(solved: DataFrame, kind: str) -> DataFrame:
    """``(conv_id, block, start)`` of the blocks of long conversations: the grammar state each starts in."""

    def chain(rows: Iterator[tuple]) -> list[tuple]:
        state, out = 0, []
        for number, ends in rows:
            out.append((number, state))
            state = ends[state]
        return out

    return _along(solved.select("conv_id", "block", "ends")).mapInArrow(
        lambda batches: _by_conversation(batches, ["block", "start"], chain),
        f"conv_id {kind}, block bigint, start bigint",
    )


def _solve(blocks: DataFrame, kind: str) -> DataFrame:
    """``blocks`` with ``start``, ``audit`` and ``cost``, the cost from its start on to the end of the conversation."""
    after = _after(blocks.where("not alone"), kind)
    joined = join_on(blocks.drop("rows"), after, ["conv_id", "block"], "left")
    asked = materialise(joined.fillna({"after": FINISH, "base": 0}), "signatures")
    # a signature may be that of a third of all conversations: it meets them in parts
    answers = salted(_automaton(asked.select("after", "backwards")), SALTS)
    parts = asked.withColumn("salt", F.pmod(F.xxhash64("conv_id", "block"), F.lit(SALTS)))
    solved = materialise(
        parts.join(answers, ["after", "backwards", "salt"]).drop("salt", "after", "backwards"), "solved"
    )
    starts = _starts(solved.where("not alone"), kind)
    started = join_on(solved, starts, ["conv_id", "block"], "left").withColumn(
        "start", F.coalesce("start", F.lit(0)).cast("int")
    )
    return started.withColumn("audit", F.get("audits", "start")).withColumn(
        "cost", F.get("costs", "start") + F.col("base")
    ).drop("audits", "costs", "ends", "base")


def _report(statistics: DataFrame, solved: DataFrame) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct("block", "audit", "cost", "illegal", "head", "tail")))
    gathered = solved.groupBy("conv_id").agg(held.alias("held"))
    seams = F.zip_with("held.tail", F.slice("held.head", F.lit(2), F.size("held")), lambda a, b: F.concat(a, b))
    inner = F.aggregate("held.illegal", F.lit(0).cast("long"), lambda n, x: n + x)
    whole = gathered.select(
        "conv_id", (inner + F.size(F.filter(seams, lambda p: ~_legal(p)))).alias("illegal"),
        F.col("held")[0]["cost"].alias("cost"), F.array_join("held.audit", "").alias("audit"),
    )
    return join_on(statistics, whole, ["conv_id"])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that stay or are new, from the rows of a block, its audit and its first state."""
    for batch in batches:
        owner, out = [], []
        for number, (block, rows, audit, state) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:5]])):
            each = ((symbol, row) for row in rows for symbol in row["symbols"])
            for at, edit in enumerate(audit):
                key, role, to = (None, None, None), None, None
                if edit != "I":
                    symbol, row = next(each)
                    key = row["__turn"], row["__d1"], row["__d2"]
                    to = MOVES.get((state, symbol.lower()))
                if edit == "D":
                    continue
                if edit != "K":
                    role, to = WANTED[state]
                state = to
                owner.append(number)
                out.append((block, at, edit, role, *key))
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), batch.column(2).type.value_type.field("__turn").type, pa.int64(), pa.int64()]
        who = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(who), batch.column(5).take(who)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["conv_id", "alone", "block", "at", "edit", "role", "__turn", "__d1", "__d2"],
        )


def _repaired(keyed: DataFrame, blocks: DataFrame, solved: DataFrame) -> DataFrame:
    kinds = dict(keyed.dtypes)
    answers = solved.select("conv_id", "block", "audit", "start")
    decided = join_on(blocks.select("conv_id", "block", "rows", "alone"), answers, ["conv_id", "block"]).select(
        "conv_id", "block", "rows", "audit", "start", "alone"
    )
    edits = materialise(decided.mapInArrow(_decisions, (
        f"conv_id {kinds['conv_id']}, alone boolean, block bigint, at int, edit string, role string, "
        f"__turn {kinds['__turn']}, __d1 bigint, __d2 bigint"
    )), "edits")
    texts = keyed.groupBy(*_ROW).agg(F.first("role").alias("was"), F.first("text").alias("text"))
    both = join_on(edits.where("edit <> 'I'"), texts, _ROW).select(
        "conv_id", "alone", "block", "at", "edit", F.coalesce("role", "was").alias("role"), "text"
    )
    new = edits.where("edit = 'I'").select("conv_id", "alone", "block", "at", "edit", "role", F.lit("").alias("text"))
    return both.unionAll(new)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and the report.

    Turns: ``(conv_id, alone, block, at, edit, role, text)`` in the order of (block, at) within a
    conversation; ``alone`` marks conversations of one block. Report: ``(conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit)`` of every conversation.
    """
    keyed = _keyed(rows)
    kind = dict(keyed.dtypes)["conv_id"]
    marked = materialise(_marked(keyed), "marked")
    blocks = _blocks(marked)
    alone = blocks.groupBy("conv_id").agg((F.count("*") == 1).alias("alone"))
    blocks = materialise(join_on(blocks, alone, ["conv_id"]), "blocks")
    solved = materialise(_solve(blocks, kind), "audits")
    return _repaired(keyed, blocks, solved), _report(_statistics(marked), solved)


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, sha256)`` of the lines ``role:text`` of every conversation that has turns left; a long
    conversation's blocks are hashed one after the other."""
    line = F.concat("role", F.lit(":"), "text")
    pieces = materialise(turns.groupBy("conv_id", "alone", "block").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("at", line.alias("line"))))["line"], "\n").alias("piece")
    ), "pieces")

    def whole(rows: Iterator[tuple]) -> list[tuple]:
        found = hashlib.sha256()
        for number, (_, piece) in enumerate(rows):
            found.update((b"\n" if number else b"") + piece.encode())
        return [(found.hexdigest(),)]

    kind = dict(turns.dtypes)["conv_id"]
    long = _along(pieces.where("not alone").select("conv_id", "block", "piece")).mapInArrow(
        lambda batches: _by_conversation(batches, ["sha256"], whole), f"conv_id {kind}, sha256 string"
    )
    return pieces.where("alone").select("conv_id", F.sha2("piece", 256).alias("sha256")).unionAll(long)
