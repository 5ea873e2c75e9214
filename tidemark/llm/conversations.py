"""Conversations made to alternate: the cheapest edits, the least of them by letters.

A conversation's rows, by turn, are kept, given another role, deleted, or joined
by inserted ones, until the initials of their roles read (s?(ua)+)?. A row that
is blank or repeats an earlier one must go; one that ends without a full stop
costs 1 more if it stays.

A node is a row number with a state: nothing yet, after s, after u, after a. A
cost programme from the last row back gives each node the cost of its cheapest
rest; an arc is optimal if its cost and the rest of its end make that up. The
nodes are ranked by their letters: first by one letter, then by two, four, eight
and so on, the rank by twice the length being a node's rank with the rank where
its doubled pointer leads. Letter and rank of the end choose each node's arc, and
a path of known length doubles by the pointer of that length.

Rows are cut into blocks of BLOCK rows, so that no task holds a conversation. A
block's costs are a matrix between the states before and after it (min, +); the
matrices of a conversation, one small row for a block, are chained from the last
back. Ranks and paths are then found in each block for every state that may enter
it, and a second chain over the blocks tells which does. The arcs of one node all
bear different letters, so what follows a block never decides a choice in it.
The hash of a conversation is one value over all its text and is fed row by row.

Defined results: a NULL conv_id is a conversation of its own; NULL turns come
first; a NULL role or text is one space; rows of one turn follow each other by
the MD5 of role:text, and equal ones are copies; a role whose initial is not s, u or a
cannot stay, and s only in front; a conversation that lost all rows has an empty
audit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sliced import running_number
from tidemark.session import materialize

BLOCK = 4096  # rows of a conversation that are edited together
GROUP_ROWS = 1 << 16  # rows of all blocks that are held at once
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1  # costs
STATES, START, SYSTEM, USER, ASSISTANT = 4, 0, 1, 2, 3
#: the state after the next user's or assistant's row, whichever is due
NEXT = np.array([USER, USER, ASSISTANT, USER])
LETTERS = np.array(list("DIKR"))
_D, _I, _K, _R = range(4)
_NEVER = 1 << 28
#: cheapest rest after the last row, and how many rows that inserts
AFTER_LAST = np.array([0, 2 * INSERT, INSERT, 0])
LAST_INSERTS = (0, 2, 1, 0)

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = ("s", "u", "a")


def _joined(a: DataFrame, b: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Rows of a with those of b where a's columns equal b's, NULL with NULL; b's columns of ``on`` go."""
    named = b.withColumnsRenamed({c: f"__{c}" for c in on.values()})
    same = [a[left].eqNullSafe(F.col(f"__{right}")) for left, right in on.items()]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return a.join(named, condition, how).drop(*[f"__{c}" for c in on.values()])


# -- rows and their faults -------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after dropping, emptying, repeating and renaming some by a hash."""
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    h = F.crc32(F.concat_ws(":", named["conv_id"], named["turn"]).cast("binary")) % 20
    held = rows.select("conv_id", "turn", named["role"].alias("role"), named["text"].alias("text"), h.alias("h")).where("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.col("role"), F.lit(":"), F.col("text")).cast("binary")))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, initial, pos, fault): rows without their texts, numbered in order, with the first fault of each."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    own = F.when(blank, BLANK).when(~whole, TRUNCATED).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    told = rows.select("conv_id", "turn", _digest().alias("digest"), initial.alias("initial"), own.alias("own"), "copies")
    # copies of a row are counted, so a text said very often is one row to what follows
    counted = told.groupBy("conv_id", "turn", "digest").agg(
        F.sum("copies").cast("int").alias("copies"), F.min("initial").alias("initial"), F.min("own").alias("own")
    )
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = counted.groupBy("conv_id", "digest").agg(F.min(turn).alias("first"))
    joined = _joined(counted, first, {c: c for c in ("conv_id", "digest")}).select(
        "conv_id", "turn", "digest", "initial", "own", F.col("turn").eqNullSafe(F.col("first.turn")).alias("is_first"),
        F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("lead"),  # the digest's order as a number
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    numbered = running_number(joined, ["conv_id"], ["turn", "lead", "digest", "copy"], "number")
    again = ~F.col("is_first") | (F.col("copy") > 1)
    fault = F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own"))
    return numbered.select("conv_id", "turn", "digest", "initial", (F.col("number") - 1).cast("long").alias("pos"), fault.alias("fault"))


# -- blocks -----------------------------------------------------------------------------

# a row is one letter: 3 * (place of its initial in INITIALS, 3 for others) + (0 whole, 1 must go, 2 truncated)
_CODES = 12
_initial, _flaw = np.arange(_CODES) // 3, np.arange(_CODES) % 3
_REROLE_COST = np.where(_flaw == 1, _NEVER, REROLE + UNFINISHED * (_flaw == 2))
_KEEP_TO = np.array([[{(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}.get((i, s), -1) for s in range(STATES)] for i in _initial])
_KEEP_COST = np.where((_KEEP_TO < 0) | (_flaw == 1)[:, None], _NEVER, UNFINISHED * (_flaw == 2)[:, None])
_KEEP_TO = np.maximum(_KEEP_TO, 0)


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, block, first, codes): a letter for each of at most ``size`` rows, and the number of the first."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.col("initial")), F.lit(0)).cast("int")
    place = F.when(place == 0, len(INITIALS)).otherwise(place - 1)
    flaw = F.when(F.col("fault").isin(BLANK, DUPLICATE), 1).when(F.col("fault") == TRUNCATED, 2).otherwise(0)
    coded = rows.select(
        "conv_id", F.floor(F.col("pos") / size).alias("block"), "pos", F.char(F.lit(65) + 3 * place + flaw).alias("code")
    )
    listed = coded.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("listed"))
    first = (F.col("block") * size).alias("first")
    return listed.select("conv_id", "block", first, F.array_join(F.col("listed.code"), "").alias("codes"))


def _laid_out(codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all blocks end to end, where each block begins, and how long it is."""
    lengths = np.array([len(c) for c in codes])
    flat = np.frombuffer("".join(codes).encode(), np.uint8).astype(np.int64) - 65
    return flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths


def _step(code: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Costs of the cheapest rests before rows with these codes; rest[n, state, ...] after them."""
    some = np.arange(len(code))[:, None]
    extra = (slice(None), slice(None), *[None] * (rest.ndim - 2))
    cost = np.minimum(DELETE + rest, rest[some, _KEEP_TO[code]] + _KEEP_COST[code][extra])
    cost = np.minimum(cost, rest[:, NEXT] + _REROLE_COST[code][(slice(None), *[None] * (rest.ndim - 1))])
    for _ in range(2):  # a third insert in one place would be a pair for nothing
        cost = np.minimum(cost, INSERT + cost[:, NEXT])
    return cost


def block_matrices(codes: list[str]) -> np.ndarray:
    """[block, state before, state after]: the cheapest edits of each block's rows."""
    flat, begin, lengths = _laid_out(codes)
    cost = np.broadcast_to(np.where(np.eye(STATES, dtype=bool), 0, _NEVER), (len(codes), STATES, STATES)).copy()
    order = np.argsort(-lengths, kind="stable")
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        held = order[: int(np.searchsorted(-lengths[order], -t, "left"))]
        cost[held] = np.minimum(_step(flat[begin[held] + t], cost[held]), _NEVER)
    return cost


def block_costs(codes: list[str], after: np.ndarray) -> np.ndarray:
    """Costs of the cheapest rests of all nodes [row, state]; each block has a row more than rows."""
    flat, begin, lengths = _laid_out(codes)
    top = begin + np.arange(len(codes))  # where a block's nodes begin
    cost = np.zeros((len(flat) + len(codes), STATES), np.int64)
    cost[top + lengths] = after
    order = np.argsort(-lengths, kind="stable")
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        held = order[: int(np.searchsorted(-lengths[order], -t, "left"))]
        cost[top[held] + t] = _step(flat[begin[held] + t], cost[top[held] + t + 1])
    return cost


def least_arcs(codes: list[str], cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter and end of the arc that each node [row * STATES + state] takes; nodes after a block end in themselves."""
    flat, begin, lengths = _laid_out(codes)
    n = len(cost)
    top = begin + np.arange(len(codes))
    last = np.zeros(n, bool)
    last[top + lengths] = True
    code = np.zeros(n, np.int64)
    code[~last] = flat
    row = np.arange(n)[:, None]
    after = np.minimum(row + 1, n - 1)
    states = np.arange(STATES)[None, :]
    # [row, state, letter]
    end_row = np.stack([after + 0 * states, row + 0 * states, after + 0 * states, after + 0 * states], 2)
    end_state = np.stack([states + 0 * row, NEXT[None, :] + 0 * row, _KEEP_TO[code], NEXT[None, :] + 0 * row], 2)
    price = np.stack([0 * end_row[:, :, 0] + DELETE, 0 * end_row[:, :, 0] + INSERT, _KEEP_COST[code], _REROLE_COST[code][:, None] + 0 * states], 2)
    optimal = (price + cost[end_row, end_state] == cost[:, :, None]) & (price < _NEVER) & ~last[:, None, None]
    ends = (end_row * STATES + end_state).reshape(n * STATES, 4)
    optimal, last = optimal.reshape(n * STATES, 4), np.repeat(last, STATES)
    own = np.arange(n * STATES)
    letter = optimal.argmax(1)  # letters ascend
    ahead = np.where(last, own, ends[own, letter])
    rank = np.where(last, 0, letter + 1)
    # ranks by 1, 2, 4 ... letters, until every pointer has left its block
    while not last[ahead].all():
        _, rank = np.unique(rank * (len(rank) + 5) + rank[ahead], return_inverse=True)
        ahead = ahead[ahead]
    score = np.where(optimal, np.arange(4) * (len(rank) + 5) + rank[ends], np.iinfo(np.int64).max)
    chosen = score.argmin(1)
    return np.where(last, -1, chosen), np.where(last, own, ends[own, chosen])


def paths_from(first: np.ndarray, ahead: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The nodes on the path from each node of ``first`` to its end, by doubled pointers."""
    path, jump = first[:, None], ahead
    while not last[path[:, -1]].all():
        path = np.concatenate([path, jump[path]], 1)
        jump = jump[jump]
    stop = last[path].argmax(1)
    return [p[:s] for p, s in zip(path, stop)]


def edited_blocks(codes: list[str], after: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """For each block and state before it: letters of the edits, the state they end in and the cost of the rest."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in codes]
    _, begin, lengths = _laid_out(codes)
    # blocks of like length go together, so that paths of one length are doubled at once
    cost = block_costs(codes, after)
    letter, ahead = least_arcs(codes, cost)
    last = letter < 0
    top = (begin + np.arange(len(codes))) * STATES
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(size):
        held = np.flatnonzero(size == k)
        first = (top[held][:, None] + np.arange(STATES)).ravel()
        paths = paths_from(first, ahead, last)
        for j, (node, path) in enumerate(zip(first, paths)):
            end = int(ahead[path[-1]] if len(path) else node)
            audit = "".join(LETTERS[letter[path]])
            out[held[j // STATES]].append((audit, end % STATES, int(cost[node // STATES, node % STATES])))
    return out


# -- the plan of a conversation -----------------------------------------------------------


def _mapped(df: DataFrame, step, schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def _with(df: DataFrame, drop: str, step, **columns: str) -> DataFrame:
    """The frame without a column and with new ones that ``step`` makes of a batch."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = step(batch)
        kept = [f for f in batch.schema.names if f != drop]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], [*kept, *columns])

    schema = df.drop(drop).schema
    for name, kind in columns.items():
        schema = schema.add(name, df.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType)
    return _mapped(df, whole, schema)


def _per_conversation(df: DataFrame, *columns: str) -> DataFrame:
    """(conv_id, blocks): a small row for each block, in order."""
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("blocks"))


def _groups(codes: list[str]) -> Iterator[slice]:
    """Blocks of GROUP_ROWS rows at most together."""
    low, held = 0, 0
    for i, c in enumerate(codes):
        if held and held + len(c) > GROUP_ROWS:
            yield slice(low, i)
            low, held = i, 0
        held += len(c)
    if low < len(codes):
        yield slice(low, len(codes))


def _summaries(batch: pa.RecordBatch) -> list[pa.Array]:
    codes = batch.column("codes").to_pylist()
    matrices = np.concatenate([block_matrices(codes[g]) for g in _groups(codes)])
    illegal = []
    for c in codes:
        initial = (np.frombuffer(c.encode(), np.uint8) - 65) // 3
        illegal.append(int((~_LEGAL[initial[:-1], initial[1:]]).sum()))
    ends = pa.array([c[0] + c[-1] for c in codes], pa.string())
    return [pa.array(matrices.reshape(len(codes), -1).tolist(), pa.list_(pa.int32())), pa.array(illegal, pa.int64()), ends]


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au


def _tails(batch: pa.RecordBatch) -> list[pa.Array]:
    """Costs after each block, and the illegal neighbours of the conversation."""
    tails, illegal = [], []
    for blocks in batch.column("blocks").to_pylist():
        rest, held = AFTER_LAST, []
        for block in reversed(blocks):
            held.append(rest.tolist())
            rest = (np.array(block["matrix"]).reshape(STATES, STATES) + rest).min(1)
        tails.append(held[::-1])
        places = [[(ord(x) - 65) // 3 for x in block["ends"]] for block in blocks]
        borders = sum(not _LEGAL[a[1], b[0]] for a, b in zip(places, places[1:]))
        illegal.append(sum(block["illegal"] for block in blocks) + int(borders))
    return [pa.array(tails, pa.list_(pa.list_(pa.int64()))), pa.array(illegal, pa.int64())]


def _edits(batch: pa.RecordBatch) -> list[pa.Array]:
    codes, tails = batch.column("codes").to_pylist(), np.array(batch.column("tail").to_pylist(), np.int64)
    got = [e for g in _groups(codes) for e in edited_blocks(codes[g], tails[g])]
    return [pa.array([[e[k] for e in block] for block in got], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))]


def _entries(batch: pa.RecordBatch) -> list[pa.Array]:
    """The state before each block, and the inserts after the last."""
    entries, added = [], []
    for blocks in batch.column("blocks").to_pylist():
        state, held = START, []
        for block in blocks:
            held.append(state)
            state = block["exits"][state]
        entries.append(held)
        added.append(LAST_INSERTS[state])
    return [pa.array(entries, pa.list_(pa.int32())), pa.array(added, pa.int32())]


def _lines(batch: pa.RecordBatch) -> list[pa.Array]:
    """The rows that stay or come: their number in the conversation, or none, and the role they get, or none."""
    out = []
    for first, state, audit, codes in zip(*[batch.column(c).to_pylist() for c in ("first", "entry", "audit", "codes")]):
        at, lines = 0, []
        for i, x in enumerate(audit):
            if x != "D":
                due = int(NEXT[state])
                new = None if x == "K" else "user" if due == USER else "assistant"
                lines.append({"line": i, "pos": None if x == "I" else first + at, "new_role": new})
                state = int(_KEEP_TO[ord(codes[at]) - 65, state]) if x == "K" else due
            at += x != "I"
        out.append(lines)
    return [pa.array(out, pa.list_(pa.struct([("line", pa.int64()), ("pos", pa.int64()), ("new_role", pa.string())])))]


def edits_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, block, first, codes, entry, audit, cost, illegal): the edits of each block; cost and illegal are the conversation's."""
    blocks = materialize(blocks_of(rows, size), "conversation-blocks")
    summaries = _with(blocks, "codes", _summaries, matrix="array<int>", illegal="long", ends="string")
    chained = _with(_per_conversation(summaries, "matrix", "illegal", "ends"), "blocks", _tails, tails="array<array<long>>", illegal="long")
    tails = chained.select("conv_id", "illegal", F.posexplode("tails").alias("number", "tail"))
    joined = _joined(blocks, tails, {"conv_id": "conv_id", "block": "number"})
    edited = _with(
        joined, "tail", _edits, audits="array<string>", exits="array<int>", costs="array<long>"
    )
    edited = materialize(edited, "conversation-edits")
    path = _with(_per_conversation(edited, "exits"), "blocks", _entries, entries="array<int>", added="int")
    entries = path.select("conv_id", "added", F.size("entries").alias("n"), F.posexplode("entries").alias("number", "entry"))
    known = _joined(edited, entries, {"conv_id": "conv_id", "block": "number"})
    is_last = F.col("block") == F.col("n") - 1
    audit = F.concat(F.get("audits", F.col("entry")), F.when(is_last, F.repeat(F.lit("I"), F.col("added"))).otherwise(""))
    return materialize(
        known.select(
            "conv_id", "block", "first", "codes", "entry", audit.alias("audit"),
            F.get("costs", F.lit(START)).alias("cost"), "illegal",
        ),
        "conversation-audits",
    )


def repaired(texts: DataFrame, rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, block, line, role, text): the rows of the repaired conversations; ``line`` orders a block's.

    ``texts`` is what ``with_faults`` read. Copies are deleted, so a row that stays is found by its digest.
    """
    lines = _with(edits.select("conv_id", "block", "first", "codes", "entry", "audit"), "codes", _lines, lines="array<struct<line: long, pos: long, new_role: string>>")
    lines = lines.select("conv_id", "block", F.explode("lines").alias("l")).select("conv_id", "block", "l.*")
    placed = _joined(lines, rows.select("conv_id", "pos", "turn", "digest"), {"conv_id": "conv_id", "pos": "pos"}, "left")
    told = texts.withColumn("digest", _digest()).groupBy("conv_id", "turn", "digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    joined = _joined(placed, told, {c: c for c in ("conv_id", "turn", "digest")}, "left")
    return joined.select(
        "conv_id", "block", "line", F.coalesce("new_role", "role").alias("role"),
        F.when(F.col("pos").isNull(), "").otherwise(F.col("text")).alias("text"),
    )


def hashes(lines: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` joined by line ends, fed row by row in order."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "block", "line")]
    told = lines.withColumn("told", F.concat("role", F.lit(":"), "text"))
    placed = told.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = (), None

        def done(names, sums) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(sums, pa.string())], ["conv_id", "sha256"])

        for batch in batches:
            kind, names, sums = batch.schema.field("conv_id").type, [], []
            for conv, told in zip(batch.column("conv_id").to_pylist(), batch.column("told").to_pylist()):
                if (conv,) != now:
                    if running is not None:
                        names.append(now[0])
                        sums.append(running.hexdigest())
                    now, running = (conv,), hashlib.sha256(told.encode())
                else:
                    running.update(b"\n" + told.encode())
            yield done(names, sums)
        if running is not None:
            yield done([now[0]], [running.hexdigest()])

    return placed.mapInArrow(run, placed.select("conv_id").schema.add("sha256", "string"))


def repair(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """A report on every conversation: faults found, the cheapest edits and a hash of what they give."""
    everyone = conversations.select("conv_id").distinct()
    texts = damaged(conversations)
    rows = materialize(with_faults(texts), "conversation-rows")
    edits = edits_of(rows, size)
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = rows.groupBy("conv_id").agg(
        turns.cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(c) for k, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))],
    )
    audits = edits.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit"),
        F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"), F.max("illegal").alias("illegal"),
    )
    sums = hashes(repaired(texts, rows, edits))
    out = everyone
    for part in (counts, audits, sums):
        out = _joined(out, part, {"conv_id": "conv_id"}, "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
