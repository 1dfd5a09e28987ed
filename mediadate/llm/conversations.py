"""Repair of conversation structure by dynamic programming over a grammar.

Every row is a symbol: its role's initial and its fault. Symbol sequences are cut into blocks, and equal
blocks are one, however many conversations hold them. A task that gets a range of distinct blocks builds a
Re-Pair grammar of them: pairs that stand next to each other twice become rules until there is none. Each
rule has one min-plus transfer matrix over the states of ``(s?(ua)+)?``, whose cells hold a cost and the
audit as a rope; it is the product of the matrices of its two sides, evaluated once, bottom-up. A block's
matrix is the product over what is left of it, a conversation's the product over its blocks.

Cells take the least cost, then the ASCII-least audit. That order survives products: two audits of one
cell cover the same rows, so one cannot be a prefix of the other without more insertions, which cost more.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import join_lookup, partitions, settle

# Edit costs, the other roles' names, and the legal neighbors by their initials.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"
LEGAL = ("su", "ua", "au")

TURN_BITS = 10
GROUP_ROWS = 1 << 12
TASK_SYMBOLS = 1 << 18
LOOKUP_BYTES = 32 << 20
BATCH_BYTES = 4 << 20

# States: nothing yet, after s, after u, after a. The first and the last may end a conversation.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
DEAD = "d"


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by ``crc32('conv_id:turn') % 20``; nulls but the ids' are one space.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 sets role user.
    """
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(F.col("fault") == 4, USER).otherwise(one("role"))
    marked = rows.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0")
    changed = marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    return changed.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


# --- ropes and matrices

def flat(rope) -> str:
    """The text of a rope; a rope is a text or a pair of ropes with their joint length."""
    parts, stack = [], [rope]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        else:
            stack += (node[1], node[0])
    return "".join(parts)


def joined(left, right):
    if not left or not right:
        return left or right
    size = (len(left) if isinstance(left, str) else left[2]) + (len(right) if isinstance(right, str) else right[2])
    return left + right if size <= 32 and isinstance(left, str) and isinstance(right, str) else (left, right, size)


def before(one, two) -> bool:
    """Whether the first rope's text is ASCII-less; shared nodes at one place are passed over."""
    left, right = [one], [two]
    while left and right:
        a, b = left.pop(), right.pop()
        if a is b:
            continue
        if not isinstance(a, str) and (isinstance(b, str) or a[2] >= b[2]):
            left += (a[1], a[0])
            right.append(b)
        elif not isinstance(b, str):
            right += (b[1], b[0])
            left.append(a)
        else:
            size = min(len(a), len(b))
            if a[:size] != b[:size]:
                return a[:size] < b[:size]
            if a[size:]:
                left.append(a[size:])
            if b[size:]:
                right.append(b[size:])
    return bool(right) and not left


def better(new: tuple, old: tuple | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and before(new[1], old[1]))


def product(one: dict, two: dict) -> dict:
    """Min-plus product of matrices ``{(from, to): (cost, audit rope)}``."""
    result: dict = {}
    for (start, middle), (cost, audit) in one.items():
        for end in STATES:
            step = two.get((middle, end))
            if step is None:
                continue
            total, old = cost + step[0], result.get((start, end))
            if old is None or total <= old[0]:
                new = total, joined(audit, step[1])
                if better(new, old):
                    result[start, end] = new
    return result


def insertions() -> dict:
    """What insertions alone reach; two more insertions lead to the same state and are never cheaper."""
    cells = {(state, state): (0, "") for state in STATES}
    for state in STATES:
        one = NEXT[state]
        cells[state, one] = INSERT, "I"
        if NEXT[one] != state:
            cells[state, NEXT[one]] = 2 * INSERT, "II"
    return cells


def symbol_matrix(symbol: str) -> dict:
    """Insertions, then one edit of the row: s, u, a, o (another role), in capitals if truncated, d if it has to go."""
    cells = {(state, state): (DELETE, "D") for state in STATES}
    if symbol != DEAD:
        more, role = TRUNCATED if symbol.isupper() else 0, symbol.lower()
        for state in STATES:
            goal = NEXT[state]
            keeps = role == ("a" if goal == AFTER_A else "u")
            cells[state, goal] = (more, "K") if keeps else (REROLE + more, "R")
        if role == "s":
            cells[START, AFTER_S] = more, "K"
    return product(insertions(), cells)


def pack(matrix: dict) -> str:
    return ",".join(f"{matrix[cell][0]}:{flat(matrix[cell][1])}" if cell in matrix else "" for cell in itertools.product(STATES, STATES))


def unpack(text: str) -> dict:
    cells = {}
    for cell, part in zip(itertools.product(STATES, STATES), text.split(",")):
        if part:
            cost, audit = part.split(":")
            cells[cell] = int(cost), audit
    return cells


# --- grammar

def re_pair(sequences: list[np.ndarray], symbols: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (rule k is symbol ``symbols + k``) and the sequences written with them.

    A round counts all neighbors and replaces the most frequent pairs, none of which shares a symbol
    with another, so that no two occurrences overlap; equal symbols in a run are paired from its start.
    """
    rules: list[tuple[int, int]] = []
    ends = np.cumsum([len(sequence) + 1 for sequence in sequences])
    text = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    for sequence, end in zip(sequences, ends):
        text[end - 1 - len(sequence) : end - 1] = sequence
    while len(text) > 1:
        left, right = text[:-1], text[1:]
        valid = (left >= 0) & (right >= 0)
        pairs, counts = np.unique((left[valid] << 32) | right[valid], return_counts=True)
        chosen, used = [], set()
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] < 2:
                break
            pair = int(pairs[k]) >> 32, int(pairs[k]) & 0xFFFFFFFF
            if used.isdisjoint(pair):
                used.update(pair)
                chosen.append(pair)
            if len(used) >= 512 or len(chosen) * 64 > len(counts):
                break
        if not chosen:
            break
        codes = np.array([a << 32 | b for a, b in chosen], np.int64)
        order = np.argsort(codes)
        here = np.where(valid, (left << 32) | right, -1)
        place = np.minimum(np.searchsorted(codes[order], here), len(codes) - 1)
        hit = codes[order][place] == here
        # In a run of one symbol every pair would overlap the next: take every second one.
        start = hit & ~np.concatenate([[False], hit[:-1]])
        index = np.arange(len(hit))
        hit &= (index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0
        spots = np.nonzero(hit)[0]
        text = text.copy()
        text[spots] = symbols + len(rules) + order[place[spots]]
        rules += chosen
        text = np.delete(text, spots + 1)
    cuts = np.nonzero(text == -1)[0]
    return rules, [part[part >= 0] for part in np.split(text, cuts + 1)[: len(sequences)]]


SYMBOLS = "suaoSUAO" + DEAD


def block_matrices(blocks: list[str]) -> list[dict]:
    """The transfer matrix of every block, through one grammar of all of them."""
    codes = {ord(symbol): k for k, symbol in enumerate(SYMBOLS)}
    table = np.zeros(128, np.int64)
    for letter, code in codes.items():
        table[letter] = code
    sequences = [table[np.frombuffer(block.encode("ascii"), np.uint8)] for block in blocks]
    rules, written = re_pair(sequences, len(SYMBOLS))
    matrices = [symbol_matrix(symbol) for symbol in SYMBOLS]
    for left, right in rules:
        matrices.append(product(matrices[left], matrices[right]))
    result = []
    for sequence in written:
        matrix = matrices[sequence[0]]
        for code in sequence[1:]:
            matrix = product(matrix, matrices[code])
        result.append(matrix)
    return result


def grammar_matrices(blocks: DataFrame) -> DataFrame:
    """``seq, matrix`` of the distinct blocks; neighbors in their order share a task and its grammar."""
    distinct = settle(blocks.select("seq").distinct())
    symbols = distinct.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]

    def work(batches):
        for batch in batches:
            sequences = batch.column(0).to_pylist()
            packed = [pack(matrix) for matrix in block_matrices(sequences)]
            yield pa.RecordBatch.from_arrays([pa.array(sequences, pa.string()), pa.array(packed, pa.string())], ["seq", "matrix"])

    return distinct.repartitionByRange(1 + symbols // TASK_SYMBOLS, "seq").sortWithinPartitions("seq").mapInArrow(work, "seq string, matrix string")


# --- rows, blocks, conversations

def _key(name: str = "conv_id") -> Column:
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def _digest() -> Column:
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def _faulted(rows: DataFrame) -> DataFrame:
    """Distinct rows of conversations, without texts: n (how often), kind and whether role and text came at an earlier turn."""
    kind = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "k").otherwise("t")
    narrow = rows.select(_key().alias("conv"), "conv_id", "turn", "role", _digest().alias("digest"), kind.alias("kind"))
    counted = settle(narrow.groupBy("conv", "conv_id", "turn", "role", "digest", "kind").agg(F.count(F.lit(1)).alias("n")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    same = counted.where("kind <> 'b'").groupBy("conv", "role", "digest").agg(F.count(F.lit(1)).alias("_turns"), F.min(turn).alias("_first"))
    same = settle(same.where("_turns > 1").drop("_turns"))
    met = join_lookup(counted, same, ["conv", "role", "digest"], "turn", "left")
    return met.withColumn("later", F.coalesce(F.col("_first") < turn, F.lit(False))).drop("_first")


def _grouped(rows: DataFrame) -> DataFrame:
    """``conv, conv_id, rows``: runs of neighboring rows, in order, of bounded length.

    A run holds the rows of 1,024 turns. One of more than 4,096 rows is cut by turn and by the leading
    bits of the texts' digests, by which rows of one turn are ordered.
    """
    placed = rows.withColumn("block", F.shiftright("turn", TURN_BITS))
    large = settle(placed.groupBy("conv", "block").count().where(F.col("count") > GROUP_ROWS).withColumn("large", F.lit(True)))
    if large.limit(1).count() == 0:
        cut = placed.withColumns({"part": F.lit(None).cast("long"), "cell": F.lit(0).cast("long")})
    else:
        known = F.coalesce("block", F.lit(-(1 << 62)))
        bits = F.ceil(F.log2(F.col("count") / GROUP_ROWS)).cast("int") + 1
        lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        met = join_lookup(placed.withColumn("_block", known), large.withColumn("_block", known).drop("block"), ["conv", "_block"], "digest", "left")
        cell = F.expr("coalesce(shiftright(lead, 32 - least(bits, 30)), 0L)")
        met = met.withColumns({"bits": bits, "lead": F.when(F.col("large"), lead)})
        cut = met.withColumns({"part": F.when(F.col("large"), F.col("turn")), "cell": cell})
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "role", "kind", "n", "later")
    return cut.groupBy("conv", "conv_id", "block", "part", "cell").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("conv", "conv_id", "rows")


BLOCK = "known boolean, turn long, digest binary, seq string, blank long, duplicate long, truncated long, illegal long, head string, tail string, last_turn long, turns long"


def _describe(rows: list[dict]) -> tuple:
    seq, turns, last, initials = [], 0, None, []
    blank = duplicate = truncated = illegal = 0
    for row in rows:
        n, kind, initial = row["n"], row["kind"], row["role"][:1]
        illegal += n - 1
        initials.append(initial)
        if row["known"] and (not turns or row["turn"] != last):
            turns, last = turns + 1, row["turn"]
        if kind == "b":
            blank += n
            seq.append(DEAD * n)
        elif row["later"]:
            duplicate += n
            seq.append(DEAD * n)
        else:
            duplicate += n - 1
            symbol = initial if initial and initial in "sua" else "o"
            if kind == "t":
                truncated += 1
                symbol = symbol.upper()
            seq.append(symbol + DEAD * (n - 1))
    illegal += sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
    first = rows[0]
    return (first["known"], first["turn"], first["digest"], "".join(seq), blank, duplicate, truncated, illegal, initials[0], initials[-1], last, turns)


def conversation_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of symbols with counts of faults and what adjoining blocks need."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            described = [_describe(one) for one in batch.column(2).to_pylist()]
            if described:
                kinds = [pa.bool_(), pa.int64(), pa.binary(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = [pa.array(column, one) for column, one in zip(zip(*described), kinds)]
                names = [part.split()[0] for part in BLOCK.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["conv", "conv_id", *names])

    return _grouped(_faulted(rows)).mapInArrow(work, f"conv string, conv_id {kind}, {BLOCK}")


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Conversation:
    """Sums up the blocks of a conversation, in order, and hands out the edits of its rows."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.tail = None
        self.vector = {(START, START): (0, "")}

    def add(self, block: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + block[name])
        if self.tail is not None:
            self.illegal += self.tail + block["head"] not in LEGAL
        self.tail = block["tail"]
        if block["turns"]:
            first = block["first_turn"]
            self.turns += block["turns"] - (first == self.last)
            self.first, self.last = first if self.first is None else self.first, block["last_turn"]
        self.vector = product(self.vector, unpack(block["matrix"]))

    def finish(self) -> dict:
        ends = product(self.vector, insertions())
        cost, audit = None, None
        for state in (START, AFTER_A):
            new = ends.get((START, state))
            if new is not None and better(new, None if cost is None else (cost, audit)):
                cost, audit = new
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": flat(audit)}


def edited(audit: str, rows):
    """``edit, role, text`` of the repaired rows, for the ``role, text`` of a conversation's rows in order."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER_S if role[:1] == "s" else NEXT[state]
        else:
            state = NEXT[state]
            role = USER if state == AFTER_U else ASSISTANT
        yield edit, role, text


def repair_conversations(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Repaired conversations of rows ``conv_id, turn, role, text`` (role and text not null).

    Every conversation has a row with place 0, which holds ``gaps, blank, duplicate, truncated, illegal, cost,
    audit``, and then its repaired rows in order: place from 1, edit, role, text. ``known`` adds conversations
    (``conv_id``) that may have no rows. Rows follow each other by turn, null turns first; rows of one turn by
    a digest of their texts, then role, so that repeated rows are neighbors. A null conv_id is a conversation
    like others. Texts of any length pass through as single cells; empty tables give empty results, and other
    columns are not read. Blocks of a long conversation are built and solved by many tasks; only its repaired
    rows pass one task, as a stream, as their order and any digest of all of them ask for.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = settle(conversation_blocks(rows))
    matrices = settle(grammar_matrices(blocks))
    size = matrices.agg(F.coalesce(F.sum(F.length("seq") + F.length("matrix")), F.lit(0))).first()[0]
    solved = join_lookup(blocks, matrices, ["seq"], "conv") if size <= LOOKUP_BYTES else join_lookup(blocks, matrices, ["seq"], "conv", at_most=0)
    counts = [F.col(name) for name in ("blank", "duplicate", "truncated", "illegal", "head", "tail", "last_turn", "turns", "matrix")]
    summed = solved.select(
        "conv", "conv_id", F.lit(1).alias("step"), "known", "turn", "digest", F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*counts).alias("block"),
    )
    texts = rows.select(
        _key().alias("conv"), "conv_id", F.lit(2).alias("step"), F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"),
        _digest().alias("digest"), "role", "text", F.lit(None).cast(summed.schema["block"].dataType).alias("block"),
    )
    every = summed.unionByName(texts)
    if known is not None:
        ids = known.select("conv_id").distinct().select(_key().alias("conv"), "conv_id", F.lit(0).alias("step"))
        every = every.unionByName(ids, allowMissingColumns=True)
    dealt = every.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "step", "known", "turn", "digest", "role")

    def stream(batches):
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def work(batches):
        out, size, id_type = [], 0, pa.null()

        def typed():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(1).type
                yield batch

        for _, own in itertools.groupby(stream(typed()), key=lambda row: row[0]):
            whole, first = Conversation(), None
            for row in own:
                conv_id = row[1]
                if row[2] == 1:
                    whole.add(row[8] | {"first_turn": row[4]})
                elif row[2] == 2:
                    first = row
                    break
            told = whole.finish()
            out.append((conv_id, 0, None, None, None, *(told[name] for name in SUMMARY), told["audit"]))
            rest = ((row[6], row[7]) for row in itertools.chain([first], own)) if first else ()
            for place, (edit, role, text) in enumerate(edited(told["audit"], rest), 1):
                out.append((conv_id, place, edit, role, text, *[None] * (len(SUMMARY) + 1)))
                size += len(text)
                if size > BATCH_BYTES or len(out) > 10_000:
                    yield _result(out, id_type)
                    out, size = [], 0
        if out:
            yield _result(out, id_type)

    schema = f"conv_id {kind}, place long, edit string, role string, text string, {', '.join(f'{name} long' for name in SUMMARY)}, audit string"
    return dealt.mapInArrow(work, schema)


def _result(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(SUMMARY), pa.string()]
    names = ["conv_id", "place", "edit", "role", "text", *SUMMARY, "audit"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


def digest_repaired(repaired: DataFrame) -> DataFrame:
    """The summary rows of ``repair_conversations``, read as they come, with the SHA-256 of the repaired rows.

    It covers ``role:text`` of the rows, joined by line feeds; without rows it is the empty text's.
    """
    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in repaired.schema if field.name in ("conv_id", *SUMMARY, "audit"))

    def work(batches):
        head, digest = None, None
        for batch in batches:
            done = []
            for place, role, text, *summary in zip(*(column.to_pylist() for column in batch.columns)):
                if place == 0:
                    if head is not None:
                        done.append((*head, digest.hexdigest()))
                    head, digest = summary, hashlib.sha256()
                else:
                    digest.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
            if done:
                yield finished(done, batch.schema)
        if head is not None:
            yield finished([(*head, digest.hexdigest())], batch.schema)

    def finished(rows, schema):
        fields = [*list(schema)[3:], pa.field("repaired_sha256", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), fields)], [field.name for field in fields])

    return repaired.select("place", "role", "text", "conv_id", *SUMMARY, "audit").mapInArrow(work, f"{kinds}, repaired_sha256 string")
