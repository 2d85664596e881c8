"""Repairing conversations: the cheapest edits by a Viterbi search in chunks that are fixed up until they agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import Staging

Batches = Iterator[pa.RecordBatch]

#: Rows of a conversation that one chunk holds.
CHUNK = 256
#: Fix-up passes before chunks that do not come to agree are settled by their transfer matrices.
PASSES = 8

# What counts as blank, and what a whole text ends in.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

# A state is the last role so far: none, system, user, assistant. A row's code has its role in the low
# two bits (0: another role), one bit for rows that must go and one for truncated ones.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
MUST_GO, TRUNCATED = 4, 8
#: The role that an insertion or a new role gives after each state.
FOLLOWING = (USER, USER, ASSISTANT, USER)
#: Costs to the end of a conversation from each state, when all rows are used.
AT_END = (0, 4, 2, 0)


@dataclass(frozen=True)
class Repair:
    """``turns``: the repaired rows, ``conv_id, place, nth, edit, role, text`` (order: place, nth).

    ``audits``: one row per conversation, ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit``.
    """

    turns: DataFrame
    audits: DataFrame


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copy_col: str | None = None,
    chunk: int = CHUNK,
) -> Repair:
    """The cheapest edits that give every conversation the roles ``(s?(ua)+)?``, by their initials.

    Keep costs 0, a new role (user or assistant) 2, deletion 3, an empty row of the user
    or the assistant 2; a truncated row that stays costs 1. Blank rows and rows whose
    role and text came before must be deleted. Of equally cheap edits those go whose
    initials (K, R, D, I in order) are least in ASCII.

    Rows are sorted by conversation and turn (null turns first, equal turns by role and
    text, then ``copy_col``) over ranges that cut long conversations, numbered, and cut
    into chunks of at most ``chunk`` rows. Costs to the end run backwards through each
    chunk, which at first guesses the costs behind it. In fix-up passes a chunk takes
    over those of its successor; the old and the new costs are followed row by row only
    until they differ by a constant, since then all before it is known. Passes go on
    until no chunk changes; what still does after some passes (rows that fix no role)
    is settled by products of transfer matrices, in as many rounds as the chain has
    doublings. Then each chunk traces its edits for every state it can be entered in,
    and the states are composed by doubling as well.

    Null role and text are one blank, so such text is blank and such a role must change.
    Rows without conversation are one conversation. Repeated rows are duplicates. An
    empty table gives empty results.
    """
    staging = Staging(rows.sparkSession, "conversations")
    placed = _placed(rows, conv_col, turn_col, role_col, text_col, copy_col, staging)
    faults = staging.keep(_faults(placed))
    pieces = staging.keep(_pieces(faults, chunk))
    linked = staging.keep(_linked(pieces))
    behind = _behind(linked, staging)
    entries = _entries(linked, behind, staging)
    known = linked.join(behind, "start").join(entries, "start", "left")
    kind = dict(placed.dtypes)["conv_id"]
    traced = staging.keep(
        known.select("start", "conv_id", "next", "codes", "behind", "entry").mapInArrow(
            _trace,
            f"start long, conv_id {kind}, audit string, cost long, "
            "edits array<struct<place:long,nth:int,edit:string,role:string>>",
        )
    )
    edits = traced.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    texts = placed.select("place", F.col("role").alias("own_role"), "text")
    staying = edits.where("edit <> 'I'").join(texts, "place")
    turns = staying.select(
        "conv_id", "place", "nth", "edit", F.coalesce("role", "own_role").alias("role"), "text"
    ).unionByName(edits.where("edit = 'I'").withColumn("text", F.lit("")))
    return Repair(turns, _audits(faults, linked, traced))


def _placed(
    rows: DataFrame,
    conv_col: str,
    turn_col: str,
    role_col: str,
    text_col: str,
    copy_col: str | None,
    staging: Staging,
) -> DataFrame:
    """The rows numbered without gaps in order of conversation and turn, staged."""
    plain = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
        (F.col(copy_col) if copy_col else F.lit(0)).alias("copy"),
    ).withColumn("key", F.xxhash64("text"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "key", "copy")]
    sorted_rows = staging.keep(
        plain.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("id"))
    )
    # The ids rise from range to range: an offset per range closes the gaps. One row per range
    # reaches the driver.
    part = F.shiftright("id", 33)
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    offsets, total = [], 0
    for size in sorted(sizes):
        offsets.append((size.part, total))
        total += size.n
    spark = rows.sparkSession
    table = spark.createDataFrame(offsets, "part long, offset long")
    return sorted_rows.join(F.broadcast(table), part == F.col("part")).select(
        "conv_id",
        "turn",
        "role",
        "text",
        (F.col("offset") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("place"),
    )


def _faults(placed: DataFrame) -> DataFrame:
    """``conv_id, turn, place, initial, fault`` of each row, without its text."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = placed.select(
        "conv_id",
        "turn",
        "place",
        F.col("role").substr(1, 1).alias("initial"),
        F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)).alias("same"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"),
    )
    # A partial minimum finds the first of equal rows; joining it on its place meets no hot key.
    firsts = rows.groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("place")
    judged = rows.drop("same").join(firsts.withColumn("first", F.lit(True)), "place", "left")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(F.col("cut"), "truncated")
    )
    return judged.select("conv_id", "turn", "place", "initial", fault.alias("fault"))


def _pieces(faults: DataFrame, chunk: int) -> DataFrame:
    """The chunks, ``start, stop, conv_id, codes``: at most ``chunk`` rows of one conversation."""
    role = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER)
    role = role.when(F.col("initial") == "a", ASSISTANT).otherwise(NONE)
    fault = (
        F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO)
        .when(F.col("fault") == "truncated", TRUNCATED)
        .otherwise(0)
    )
    coded = faults.select(
        "conv_id",
        "place",
        F.floor(F.col("place") / chunk).alias("chunk"),
        (role + fault).cast("byte").alias("code"),
    )
    grouped = coded.groupBy("conv_id", "chunk").agg(
        F.min("place").alias("start"),
        (F.max("place") + 1).alias("stop"),
        F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"),
    )
    return grouped.select("start", "stop", "conv_id", F.col("rows.code").alias("codes"))


def _linked(pieces: DataFrame) -> DataFrame:
    """The chunks with ``next``, the start of the same conversation's next one, and ``illegal`` pairs."""
    after = pieces.select(
        F.col("start").alias("next"), F.col("conv_id").alias("_conv"), F.col("codes")[0].alias("_code")
    )
    same = (F.col("stop") == F.col("next")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    joined = pieces.join(after, same, "left")
    initials = F.transform(
        F.when(F.col("next").isNotNull(), F.array_append("codes", F.col("_code"))).otherwise(
            F.col("codes")
        ),
        lambda code: code.bitwiseAND(3),
    )
    legal = [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER]
    pairs = F.zip_with(
        F.slice(initials, F.lit(1), F.size(initials) - 1),
        F.slice(initials, F.lit(2), F.size(initials) - 1),
        lambda a, b: a * 4 + b,
    )
    illegal = F.size(F.filter(pairs, lambda pair: ~pair.isin(legal)))
    return joined.select("start", "conv_id", "next", "codes", illegal.cast("long").alias("illegal"))


# Costs from behind


def _behind(linked: DataFrame, staging: Staging) -> DataFrame:
    """``start, behind``: for each chunk the costs to the end from its last row on, but for a constant."""
    schema = "start long, next long, codes array<byte>, behind array<int>, front array<int>, changed boolean"
    guessed = staging.keep(linked.select("start", "next", "codes").mapInArrow(_guess, schema))
    ends = guessed.where("next IS NULL")
    chained = guessed.where("next IS NOT NULL")
    for _ in range(PASSES):
        if chained.where("changed").isEmpty():
            return ends.unionByName(chained).select("start", "behind")
        fronts = ends.unionByName(chained).select(
            F.col("start").alias("next"), F.col("front").alias("arriving")
        )
        fixed = chained.join(fronts, "next").select("start", "next", "codes", "behind", "front", "arriving")
        chained = staging.keep(fixed.mapInArrow(_fix_up, schema))
    matrices = staging.keep(
        chained.select("start", "next", "codes").mapInArrow(
            _transfer, "start long, next long, value array<long>"
        )
    )
    # Products over chains: each ends in a last chunk, whose costs are exact.
    product = """transform(sequence(0, 15), k -> array_min(transform(sequence(0, 3), j ->
        value[int(k / 4) * 4 + j] + further[j * 4 + k % 4])))"""
    suffixes = _doubled(matrices, product, staging, until="next")
    exact = ends.select(F.col("start").alias("last"), F.col("front").alias("final"))
    applied = suffixes.join(exact, "last").select(
        "start",
        F.expr(
            "transform(sequence(0, 3), s -> int(array_min(transform(sequence(0, 3), t -> "
            "value[s * 4 + t] + final[t])) - value[15]))"
        ).alias("front"),
    )
    fronts = applied.unionByName(ends.select("start", "front"))
    arrived = chained.select("start", "next").join(
        fronts.select(F.col("start").alias("next"), F.col("front").alias("behind")), "next"
    )
    return ends.select("start", "behind").unionByName(arrived.select("start", "behind"))


def _doubled(links: DataFrame, product: str, staging: Staging, until: str) -> DataFrame:
    """``start, value, last``: for each link the product of all values along its chain.

    ``value`` and the value ``further`` along are combined by the expression. Each
    round doubles the length of what a row covers, and a row is joined by its key once.
    ``last`` is the key at which the chain leaves the links.
    """
    current = links
    while True:
        ahead = current.select(
            F.col("start").alias(until), F.col("value").alias("further"), F.col(until).alias("_beyond")
        )
        joined = current.join(ahead, until, "left")
        step = joined.select(
            "start",
            F.coalesce("_beyond", until).alias(until),
            F.expr(f"if(further IS NULL, value, {product})").alias("value"),
            F.col("further").isNotNull().alias("moved"),
        )
        current = staging.keep(step)
        if current.where("moved").isEmpty():
            return current.select("start", "value", F.col(until).alias("last"))
        current = current.drop("moved")


def _row_before(costs: list[int], code: int) -> list[int]:
    """Costs to the end from each state before a row, from those after it."""
    if code & MUST_GO:
        return [DELETE + c for c in costs]
    here = [DELETE + c for c in costs]
    cut = CUT if code & TRUNCATED else 0
    role = code & 3
    for state in range(4):
        given = REROLE + cut + costs[FOLLOWING[state]]
        if given < here[state]:
            here[state] = given
        if role and (role == FOLLOWING[state] or (state == NONE and role == SYSTEM)):
            kept = KEEP + cut + costs[role]
            if kept < here[state]:
                here[state] = kept
    user = min(here[USER], INSERT + here[ASSISTANT])
    assistant = min(here[ASSISTANT], INSERT + here[USER])
    return [min(here[NONE], INSERT + user), min(here[SYSTEM], INSERT + user), user, assistant]


def _front(codes: list[int], behind: list[int]) -> list[int]:
    costs = behind
    for code in reversed(codes):
        costs = _row_before(costs, code)
    return costs


def _level(costs: list[int]) -> list[int]:
    """The costs but for a constant."""
    least = min(costs)
    return [c - least for c in costs]


def _lists(column: pa.Array) -> list[list[int]]:
    return column.to_pylist()


INTS = pa.list_(pa.int32())


def _states(batch: pa.RecordBatch, behind: list, front: list, changed: list) -> pa.RecordBatch:
    rest = [batch.column(n) for n in ("start", "next", "codes")]
    own = [pa.array(behind, INTS), pa.array(front, INTS), pa.array(changed, pa.bool_())]
    return pa.RecordBatch.from_arrays(
        [*rest, *own], ["start", "next", "codes", "behind", "front", "changed"]
    )


def _guess(batches: Batches) -> Batches:
    """Costs through each chunk as if the conversation ended with it."""
    for batch in batches:
        fronts = [_level(_front(c, list(AT_END))) for c in _lists(batch.column("codes"))]
        n = batch.num_rows
        yield _states(batch, [list(AT_END)] * n, fronts, [True] * n)


def _fix_up(batches: Batches) -> Batches:
    for batch in batches:
        columns = (_lists(batch.column(n)) for n in ("codes", "behind", "front", "arriving"))
        behind, front, changed = [], [], []
        for codes, old, old_front, arriving in zip(*columns, strict=True):
            new_front = fixed_front(codes, old, old_front, arriving)
            behind.append(arriving)
            front.append(new_front)
            changed.append(new_front != old_front)
        yield _states(batch, behind, front, changed)


def fixed_front(codes: list[int], old: list[int], old_front: list[int], new: list[int]) -> list[int]:
    """The level costs in front of a chunk, for new ones behind it.

    Old and new costs run side by side until they differ by a constant only.
    """
    for code in reversed(codes):
        if _level(old) == _level(new):
            return old_front
        old, new = _row_before(old, code), _row_before(new, code)
    return _level(new)


def _transfer(batches: Batches) -> Batches:
    """Costs through each chunk from each state in front of it to each state behind it, row by row."""
    far = 1 << 20
    for batch in batches:
        values = []
        for codes in _lists(batch.column("codes")):
            ends = [[0 if t == s else far for s in range(4)] for t in range(4)]
            fronts = [_front(codes, _inserted(end)) for end in ends]
            values.append([fronts[t][s] for s in range(4) for t in range(4)])
        rest = [batch.column("start"), batch.column("next"), pa.array(values, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rest, ["start", "next", "value"])


def _inserted(costs: list[int]) -> list[int]:
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[NONE], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


# Tracing


def _entries(linked: DataFrame, behind: DataFrame, staging: Staging) -> DataFrame:
    """``start, entry``: the state in which chunks that follow another one are entered."""
    chained = linked.where("next IS NOT NULL").select("start", "next", "codes").join(behind, "start")
    maps = staging.keep(
        chained.mapInArrow(_exits, "start long, next long, value array<int>")
    )
    # Against the chain: what a chunk leaves in, after all chunks before it. A first chunk is entered
    # in no state, and has no row to be joined with.
    backward = maps.select(F.col("next").alias("start"), F.col("start").alias("previous"), "value")
    whole = _doubled(backward, "transform(further, s -> value[s])", staging, until="previous")
    return whole.select("start", F.col("value")[NONE].alias("entry"))


def _exits(batches: Batches) -> Batches:
    for batch in batches:
        columns = (_lists(batch.column(n)) for n in ("codes", "behind"))
        values = []
        for codes, behind in zip(*columns, strict=True):
            costs = _all_costs(codes, behind)
            values.append([trace(codes, costs, state, False)[1] for state in range(4)])
        rest = [batch.column("start"), batch.column("next"), pa.array(values, INTS)]
        yield pa.RecordBatch.from_arrays(rest, ["start", "next", "value"])


def _all_costs(codes: list[int], behind: list[int]) -> list[list[int]]:
    """Costs to the end before each row, and behind the last one."""
    costs = [behind]
    for code in reversed(codes):
        costs.append(_row_before(costs[-1], code))
    return costs[::-1]


def trace(
    codes: list[int], costs: list[list[int]], state: int, to_end: bool
) -> tuple[list[tuple[int, str, int]], int]:
    """The edits, ``(row, initial, role)``, from a state at the first row on, and the state they leave.

    Insertions behind the last row are made only where the conversation ends. In each
    state an initial leads to one other state, so the least initial that keeps the cost
    is the start of the least audit.
    """
    edits = []
    row = 0
    while True:
        here, following = costs[row], FOLLOWING[state]
        if row == len(codes):
            if not to_end or here[state] == 0:
                return edits, state
            edits.append((row, "I", following))
            state = following
            continue
        code, after = codes[row], costs[row + 1]
        role = code & 3
        cut = CUT if code & TRUNCATED else 0
        if DELETE + after[state] == here[state]:
            edits.append((row, "D", NONE))
        elif INSERT + here[following] == here[state]:
            edits.append((row, "I", following))
            state = following
            continue
        elif (
            role
            and (role == following or (state == NONE and role == SYSTEM))
            and KEEP + cut + after[role] == here[state]
        ):
            edits.append((row, "K", NONE))
            state = role
        else:
            edits.append((row, "R", following))
            state = following
        row += 1


def _trace(batches: Batches) -> Batches:
    entry_kind = pa.list_(
        pa.struct(
            [("place", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("role", pa.string())]
        )
    )
    prices = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    for batch in batches:
        names = ("start", "next", "codes", "behind", "entry")
        audits, prices_paid, listed = [], [], []
        for start, following, codes, behind, entry in zip(
            *(_lists(batch.column(n)) for n in names), strict=True
        ):
            costs = _all_costs(codes, behind)
            edits, _ = trace(codes, costs, entry or NONE, following is None)
            audits.append("".join(e for _, e, _ in edits))
            cut = sum(e in "KR" and bool(codes[row] & TRUNCATED) for row, e, _ in edits)
            prices_paid.append(sum(prices[e] for _, e, _ in edits) + CUT * cut)
            listed.append(
                [
                    {"place": start + row, "nth": nth, "edit": e, "role": ROLES[role]}
                    for nth, (row, e, role) in enumerate(edits)
                    if e != "D"
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("start"),
                batch.column("conv_id"),
                pa.array(audits, pa.string()),
                pa.array(prices_paid, pa.int64()),
                pa.array(listed, entry_kind),
            ],
            ["start", "conv_id", "audit", "cost", "edits"],
        )


# Totals


def _audits(faults: DataFrame, linked: DataFrame, traced: DataFrame) -> DataFrame:
    def count(name: str) -> Column:
        return F.count_if(F.col("fault") == name).alias(name)

    # Turns are counted apart by a grouping of their own, so that a long conversation is one row a task.
    by_turn = faults.groupBy("conv_id", "turn").agg(*map(count, ("blank", "duplicate", "truncated")))
    turns = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    by_fault = by_turn.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *sums)
    pieces = linked.select("start", "illegal").join(traced.drop("edits"), "start")
    letters = F.array_sort(F.collect_list(F.struct("start", "audit")))
    by_piece = pieces.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(letters["audit"], "").alias("audit"),
    )
    joined = by_fault.join(by_piece.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.drop("_conv")


def digest_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of each conversation's ``role:text``, joined by newlines.

    A digest reads a text from its start to its end, so the rows of one conversation
    pass one task, sorted, one after the other; none is kept.
    """
    def digest(batches: Batches) -> Batches:
        conv: object = None
        state = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done: list[tuple] = []
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
            for own, role, text in zip(*columns, strict=True):
                if state is None or own != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield _digests(done, kind)
        if state is not None:
            yield _digests([(conv, state.hexdigest())], kind)

    rows = turns.select("conv_id", "place", "nth", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth")
    return rows.mapInArrow(digest, f"conv_id {dict(turns.dtypes)['conv_id']}, repaired_sha256 string")


def _digests(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    convs, digests = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(convs, kind), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"]
    )
