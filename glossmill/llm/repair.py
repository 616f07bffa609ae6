"""Repair of conversations: the cheapest edits that give a lawful order of speakers, and of these the least by name.

A lawful conversation is empty, or a system message at will and then one or
more pairs of user and assistant.  Edits are Keep (0), Rerole to user or
assistant (2), Delete (3) and Insert of an empty message (2); blank and
repeated messages have to go, and one cut short costs 1 more where it stays.

What has been said decides what may follow, so a conversation is a graph of
nodes (message, state), with an edit for each arc, and a state is where a
letter leads.  A backward pass gives each node its cost to the end; arcs that
lie on a cheapest way are optimal.  Optimal arcs are ranked by the audit, the
letters of the edits, that begins with them: by the first letter, then by the
first 2, 4, 8 ... letters, each rank made of the arc's own and that of the
best arc where its pointer leads, and pointers doubling with the length.  The
ranks choose a node's arc, and doubled pointers give the least way.

Rows are ordered by ranges and gathered to blocks of bounded size, so a
conversation may span any number of blocks and tasks.  Such blocks first give
a table of costs from any state to any other; tables are multiplied per task,
and tasks' products per conversation.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefilter, store

#: Messages, and bytes of text, of a block; a single message may be longer.
ROWS, BYTES = 4096, 1 << 19
#: Blocks whose arcs are ranked at a time.
TOGETHER = 128
FAR = 1 << 40
#: States: nothing said, system, user, assistant; where a new user or assistant message leads from each, and who it is.
NEXT, SAYS = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: What the end of a conversation costs in each state: pairs are completed by inserted messages.
END = (0, 4, 2, 0)
START = (0, FAR, FAR, FAR)
#: Edits in the order of their initials; 0 is the end of an audit.
EDITS = "\0DIKR"
#: Bits of a message's code: 0 to 3 its role's initial (none, s, u, a), and its fault.
BLANK, REPEATED, SHORT, ABSENT = 4, 8, 16, 32
SUMMARY = "blank long, duplicate long, truncated long, illegal long, cost long"


def kept_state(state: int, initial: int) -> int | None:
    """Where a message that is kept leads; None where it may not stand."""
    if initial == 1:
        return 1 if state == 0 else None
    if initial == 2:
        return 2 if state != 2 else None
    return 3 if initial == 3 and state == 2 else None


def arcs(state: int, code: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits of a message."""
    found = [(1, 3, state)]
    if not code & (BLANK | REPEATED):
        more = 1 if code & SHORT else 0
        if (kept := kept_state(state, code & 3)) is not None:
            found.append((3, more, kept))
        found.append((4, 2 + more, NEXT[state]))
    return found


#: Of each code and state; the codes of a message that isn't absent are below 32.
ARCS = [[arcs(state, code) for state in range(4)] for code in range(32)]


def costs(codes: bytes, end=END) -> list[list[int]]:
    """The cost to the end from each state before each message; `end`, the last row, has those after all of them."""
    out = [list(end)]
    for code in reversed(codes):
        after, of = out[-1], ARCS[code]
        own = [min(cost + after[to] for _, cost, to in of[state]) for state in range(4)]
        out.append([min(own[s], 2 + own[NEXT[s]], 4 + own[NEXT[NEXT[s]]]) for s in range(4)])
    return out[::-1]


def table_of(codes: bytes) -> list[int]:
    """The least cost from each state before the messages to each after them: 16 numbers, a row for each state before."""
    columns = [costs(codes, [0 if s == to else FAR for s in range(4)])[0] for to in range(4)]
    return [min(columns[to][s], FAR) for s in range(4) for to in range(4)]


def least_audits(blocks: list[tuple[bytes, list[int], list[int]]]) -> list[list[list[int]]]:
    """For blocks (codes, costs after them, states to begin with): the letters of the least cheapest edits from each of these states.

    All blocks' optimal arcs are ranked together.
    """
    import numpy as np

    owner, letter, target, begins, base = [], [], [], [], 0
    for codes, end, states in blocks:
        to_end = costs(codes, end)
        for i, code in enumerate(codes):
            here, after, of = to_end[i], to_end[i + 1], ARCS[code]
            for state in range(4):
                node, cost = base + 4 * i + state, here[state]
                for name, own, to in of[state]:
                    if own + after[to] == cost:
                        owner.append(node)
                        letter.append(name)
                        target.append(node - state + 4 + to)
                if 2 + here[NEXT[state]] == cost:
                    owner.append(node)
                    letter.append(2)
                    target.append(node - state + NEXT[state])
        last = base + 4 * len(codes)
        for state in range(4):  # the end, where audits stop
            owner.append(last + state)
            letter.append(0)
            target.append(last + state)
        begins.append([base + state for state in states])
        base = last + 4
    owner, rank, target = np.array(owner), np.array(letter), np.array(target)
    name, following, ended = rank.copy(), target.copy(), rank == 0

    def best() -> "np.ndarray":
        """The arc of least rank of each node."""
        order = np.lexsort((rank, owner))
        first = np.ones(len(order), bool)
        first[1:] = owner[order][1:] != owner[order][:-1]
        out = np.zeros(base, np.int64)
        out[owner[order][first]] = order[first]
        return out

    while True:
        then = best()[following]  # the best arc after the letters seen so far
        rank = np.unique(rank * (len(rank) + 1) + rank[then], return_inverse=True)[1]
        following = following[then]
        if ended[then].all():
            break
    chosen = best()
    jumps = [chosen[target]]
    while not ended[jumps[-1]].all():
        jumps.append(jumps[-1][jumps[-1]])
    ways = chosen[np.array([node for own in begins for node in own])][:, None]
    for jump in reversed(jumps):
        ways = np.stack([ways, jump[ways]], axis=2).reshape(len(ways), -1)
    found = iter([[x for x in row if x] for row in name[ways].tolist()])
    return [[next(found) for _ in own] for own in begins]


def walked(codes: bytes, audit: list[int], state: int) -> tuple[int, int]:
    """(cost, state) after the edits."""
    at = cost = 0
    for name in audit:
        if name == 2:
            cost, state = cost + 2, NEXT[state]
        else:
            own, state = next((own, to) for letter, own, to in ARCS[codes[at]][state] if letter == name)
            cost, at = cost + own, at + 1
    return cost, state


def ordered_blocks(messages: DataFrame, conv: str, turn: str, role: str, text: str, absent: str | None, most: int = ROWS) -> DataFrame:
    """(conv, part, block, codes, roles, texts, first, last, turns): runs of up to `most` messages of a conversation, in order.

    part and block number the blocks in order, block within its part.  Texts
    of messages that have to go are left out.  first and last are the least
    and greatest turn, turns the number of different ones.
    """
    own = messages.select(store.column(conv).alias("conv"), store.column(turn).cast("long").alias("turn"), F.coalesce(store.column(role), F.lit(" ")).alias("role"), F.coalesce(store.column(text), F.lit(" ")).alias("text"), (store.column(absent) if absent else F.lit(False)).alias("absent"))
    numbered = store.stage(own.withColumn("row", F.monotonically_increasing_id()), "messages")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    digest = F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)
    slim = numbered.where(~F.col("absent") & ~blank).select("conv", digest.alias("digest"), F.struct("turn", "row").alias("at"))
    firsts = slim.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    again = store.stage(slim.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where(F.col("at") != F.col("first")).select("conv", F.col("at.turn").alias("turn"), F.col("at.row").alias("row")), "again")
    initial = F.coalesce(F.create_map(*[F.lit(x) for x in ("s", 1, "u", 2, "a", 3)])[F.substring("role", 1, 1)], F.lit(0))
    code = F.when(F.col("absent"), ABSENT).otherwise(initial + F.when(blank, BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), SHORT).otherwise(0))
    rest = prefilter.without(numbered.withColumn("code", code), [F.col("row")], again.select("row"))
    gone = again.join(numbered.select(F.col("row").alias("r"), "role", "text", initial.alias("initial")), F.col("row") == F.col("r"))
    stays = F.col("code").bitwiseAND(F.lit(BLANK | ABSENT)) == 0
    rows = rest.select("conv", "turn", "role", "text", "row", "code", stays.alias("stays"))
    rows = rows.union(gone.select("conv", "turn", "role", "text", "row", F.col("initial") + REPEATED, F.lit(False)))
    order = ["conv", "turn", "role", "text", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", F.when(F.col("stays"), F.col("text")).alias("text"), "code")

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made, kind = TaskContext.get().partitionId(), 0, None
        here = codes = roles = texts = turns = size = None

        def block():
            nonlocal made
            known = [t for t in turns if t is not None]
            row = [[here], [part], [made], [bytes(codes)], [roles], [texts], [min(known, default=None)], [max(known, default=None)], [len(set(known))]]
            kinds = [kind, pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        ready, waiting = [], 0
        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 256):
                for c, t, r, x, k in zip(*(column.to_pylist() for column in whole.slice(at, 256).columns), strict=True):
                    if codes is not None and (c != here or len(codes) >= most or size >= BYTES):
                        ready.append(block())
                        waiting, codes = waiting + size, None
                        if len(ready) >= 1024 or waiting >= 8 * BYTES:
                            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                            ready, waiting = [], 0
                    if codes is None:
                        here, codes, roles, texts, turns, size = c, bytearray(), [], [], [], 0
                    if k != ABSENT:
                        codes.append(k)
                        roles.append(r)
                        texts.append(x or "")
                        turns.append(t)
                        size += len(x or "")
        if codes is not None:
            ready.append(block())
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]

    names = ["conv", "part", "block", "codes", "roles", "texts", "first", "last", "turns"]
    kind = dict(messages.dtypes)[conv]
    return store.stage(ranged.mapInArrow(gather, f"conv {kind}, part int, block long, codes binary, roles array<string>, texts array<string>, first long, last long, turns long"), "blocks")


def multiplied(left: list[int], right: list[int]) -> list[int]:
    """The product of two tables of costs."""
    return [min(FAR, *(left[4 * s + m] + right[4 * m + to] for m in range(4))) for s in range(4) for to in range(4)]


def scanned(tables: DataFrame, seed: tuple, backward: bool) -> DataFrame:
    """From (conv, part, block, m) of blocks in order: (part, block, v), the costs that meet a block from before it, or backward from after it.

    seed are the costs at the conversation's own start or end.  A task's blocks
    are gathered per conversation, and then at most a row of each task.
    """

    def passed(v: list[int], m: list[int]) -> list[int]:
        if backward:
            return [min(FAR, *(m[4 * s + to] + v[to] for to in range(4))) for s in range(4)]
        return [min(FAR, *(v[s] + m[4 * s + to] for s in range(4))) for to in range(4)]

    def totals(batches):
        import pyarrow as pa
        from functools import reduce

        for batch in batches:
            made = [reduce(multiplied, [x["m"] for x in own]) for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], ["conv", "part", "blocks", "m"])

    def vectors(column: int, seeds: int | None, name: str):
        def rows(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for k, own in enumerate(batch.column(column).to_pylist()):
                    v, found = list(seed) if seeds is None else batch.column(seeds)[k].as_py(), []
                    for x in reversed(own) if backward else own:
                        found.append({name: x[name], "v": v})
                        v = passed(v, x["m"])
                    out.append(found)
                key = pa.int32() if name == "part" else pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([(name, key), ("v", pa.list_(pa.int64()))])))], [batch.schema.names[0], "found"])

        return rows

    kind = dict(tables.dtypes)["conv"]
    of_task = tables.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("blocks"))
    of_task = store.stage(of_task.mapInArrow(totals, f"conv {kind}, part int, blocks array<struct<block: long, m: array<long>>>, m array<long>"), "tables")
    of_all = of_task.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("parts"))
    outer = of_all.mapInArrow(vectors(1, None, "part"), f"conv {kind}, found array<struct<part: int, v: array<long>>>").select(F.col("conv").alias("c"), F.inline("found")).withColumnRenamed("part", "p")
    joined = of_task.join(outer, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("part", "blocks", "v")
    return joined.mapInArrow(vectors(1, 2, "block"), "part int, found array<struct<block: long, v: array<long>>>").select("part", F.inline("found"))


def tables(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, m) from (conv, part, block, codes)."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            made = [table_of(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], ["conv", "part", "block", "m"])

    return blocks.select("conv", "part", "block", "codes").mapInArrow(rows, f"conv {dict(blocks.dtypes)['conv']}, part int, block long, m array<long>")


def ways(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, m) from (conv, part, block, codes, after): m has cost 0 where the least audit leads from each state."""

    def rows(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                batch, made = whole.slice(at, 16), []
                given = [(codes, after, [0, 1, 2, 3]) for codes, after in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
                for (codes, _, _), audits in zip(given, least_audits(given), strict=True):
                    ends = [walked(codes, audit, state)[1] for state, audit in enumerate(audits)]
                    made.append([0 if ends[s] == to else FAR for s in range(4) for to in range(4)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], ["conv", "part", "block", "m"])

    return blocks.select("conv", "part", "block", "codes", "after").mapInArrow(rows, f"conv {dict(blocks.dtypes)['conv']}, part int, block long, m array<long>")


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None, most: int = ROWS) -> DataFrame:
    """Repaired blocks of conversations, in the order of (conv, part, block), stored.

    edits are the letters of the cheapest edits, the ASCII-least of equal
    cost; roles and texts are those of the repaired messages; before them come
    whole, which says that the block is its conversation, and the counts of
    SUMMARY, first, last, turns, opens and closes, the codes of the first and
    last message.  Messages are taken by turn, nulls first, then role and
    text; equal rows are repeats of the first.  Null roles and texts are one
    space, so null texts are blank; null conversations are one.  Rows for
    which the boolean column `absent` is true only name their conversation.
    Blank comes before repeated, and that before cut short.  An empty table
    gives none.  Other columns are left out.
    """
    blocks = ordered_blocks(messages, conv, turn, role, text, absent, most)
    counted = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("part", "block")).alias("last"))
    several = store.stage(counted.where("n > 1").drop("n"), "several")
    plain = lambda kind: F.lit(None).cast(kind)
    if several.isEmpty():
        given = blocks.select("*", plain("array<long>").alias("after"), plain("array<long>").alias("before"), F.lit(True).alias("closing"))
    else:
        likely, others = prefilter.split(blocks, [F.col("conv")], several.select("conv"))
        slim, _ = prefilter.split(blocks.select("conv", "part", "block", "codes"), [F.col("conv")], several.select("conv"))
        named = several.select(F.col("conv").alias("c"), F.col("last").alias("end"))
        closing = (F.struct("part", "block") == F.col("end")).alias("closing")
        long_ = store.stage(slim.join(named, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "part", "block", "codes", closing), "long")
        after = store.stage(scanned(tables(long_), END, True).withColumnRenamed("v", "after"), "after")
        before = scanned(ways(long_.join(after, ["part", "block"])), START, False).withColumnRenamed("v", "before")
        met = store.stage(after.join(before, ["part", "block"]).join(long_.select("part", "block", "closing"), ["part", "block"]), "met")
        given = likely.join(met, ["part", "block"], "left").select(*blocks.columns, "after", "before", F.coalesce("closing", F.lit(True)).alias("closing"))
        given = given.union(others.select(*blocks.columns, plain("array<long>"), plain("array<long>"), F.lit(True)))

    def rows(batches):
        import pyarrow as pa

        longs, strings = pa.int64(), pa.list_(pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                _, _, _, codes, roles, texts, _, _, _, after, before, closing = (c.to_pylist() if k > 2 else None for k, c in enumerate(batch.columns))
                begin = [0 if b is None else b.index(0) for b in before]
                given = [(c, END if a is None else a, [s]) for c, a, s in zip(codes, after, begin, strict=True)]
                out = []
                for (own, _, (state,)), (audit,), r, x, last in zip(given, least_audits(given), roles, texts, closing, strict=True):
                    out.append(repaired(own, audit, state, r, x, last))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), strings, strings, longs, longs, longs, longs, longs, pa.int32(), pa.int32()], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([a is None for a in after]), *batch.columns[6:9], *columns], names)

    fields = f"conv {dict(blocks.dtypes)['conv']}, part int, block long, whole boolean, first long, last long, turns long, edits string, roles array<string>, texts array<string>, {SUMMARY}, opens int, closes int"
    names = [f.strip().split(" ")[0] for f in fields.split(", ")]
    return store.stage(given.mapInArrow(rows, fields), "repaired")


def repaired(codes: bytes, audit: list[int], state: int, roles: list[str], texts: list[str], last: bool) -> tuple:
    """(edits, roles, texts, counts of SUMMARY, codes of the first and last message) of a block; `last` blocks are completed at their end."""
    said, words, at, cost = [], [], 0, 0

    def insert():
        nonlocal state, cost
        said.append(SAYS[state])
        words.append("")
        state, cost = NEXT[state], cost + 2

    for name in audit:
        if name == 2:
            insert()
            continue
        if name != 1:
            said.append(roles[at] if name == 3 else SAYS[state])
            words.append(texts[at])
        own, state = next((own, to) for letter, own, to in ARCS[codes[at]][state] if letter == name)
        cost, at = cost + own, at + 1
    letters = "".join(EDITS[k] for k in audit)
    while last and END[state]:
        insert()
        letters += "I"
    lawful = {(1, 2), (2, 3), (3, 2)}
    illegal = sum((a & 3, b & 3) not in lawful for a, b in zip(codes, codes[1:]))  # noqa: B905
    faults = [sum(1 for c in codes if c & bit) for bit in (BLANK, REPEATED, SHORT)]
    return letters, said, words, *faults, illegal, cost, codes[0] & 3 if codes else None, codes[-1] & 3 if codes else None


def conversations(repaired_blocks: DataFrame) -> DataFrame:
    """(conv, part, block, position, role, text): the repaired messages, position from 0 in each block."""
    zipped = F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "m")
    return repaired_blocks.select("conv", "part", "block", zipped).select("conv", "part", "block", "position", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def summaries(repaired_blocks: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    A digest is one run over its text, so a conversation's blocks, each one
    row, pass through a task in order, one at a time; a conversation without
    messages has zeros, an empty audit and the hash of nothing.
    """

    def rows(batches):
        import hashlib

        import pyarrow as pa

        kind, state, ready = None, None, []

        def closed():
            gaps = 0 if state["first"] is None else state["last"] - state["first"] + 1 - state["turns"]
            return (state["conv"], gaps, *state["counts"], "".join(state["audit"]), state["hash"].hexdigest())

        def batch_of(found):
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(batch.num_rows):
                conv, whole, first, last, turns, edits, roles, texts, *counts, opens, closes = (c[k].as_py() for c in batch.columns)
                if state is None or whole or conv != state["conv"] or state["whole"]:
                    if state:
                        ready.append(closed())
                        if len(ready) >= 1024:
                            yield batch_of(ready)
                            ready = []
                    state = {"conv": conv, "whole": whole, "first": None, "last": None, "turns": 0, "counts": [0] * 5, "audit": [], "hash": hashlib.sha256(), "said": False, "closes": None}
                if opens is not None and state["closes"] is not None:
                    counts[3] += (state["closes"], opens) not in {(1, 2), (2, 3), (3, 2)}
                state["closes"] = state["closes"] if closes is None else closes
                if first is not None:
                    state["turns"] += turns - (state["last"] == first)
                    state["first"], state["last"] = first if state["first"] is None else state["first"], last
                state["counts"] = [a + b for a, b in zip(state["counts"], counts, strict=True)]
                state["audit"].append(edits)
                for role, text in zip(roles, texts, strict=True):
                    state["hash"].update((("\n" if state["said"] else "") + f"{role}:{text}").encode())
                    state["said"] = True
        if state:
            ready.append(closed())
        if ready:
            yield batch_of(ready)

    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    fields = f"conv {dict(repaired_blocks.dtypes)['conv']}, gaps long, {SUMMARY}, audit string, repaired_sha256 string"
    columns = ["conv", "whole", "first", "last", "turns", "edits", "roles", "texts", *[f.split(" ")[0] for f in SUMMARY.split(", ")], "opens", "closes"]
    single = repaired_blocks.where("whole").select(*columns)
    several = repaired_blocks.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "block").select(*columns)
    return single.mapInArrow(rows, fields).union(several.mapInArrow(rows, fields))
