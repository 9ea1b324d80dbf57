"""Conversations damaged and repaired by the cheapest edits, by dynamic programming with checkpoints at the square root.

Roles of a repaired conversation are an optional system turn and then user and assistant in turn, ending with the assistant. Rows are kept, given the role that is due,
deleted, or empty ones are put in; `Edits` has the costs. Of all cheapest repairs the one whose letters (D, I, K, R) come first in ASCII is taken.

A conversation may hold any share of all rows, so no task has one whole:
  1. Rows without their texts (a digest instead) are dealt by range of conversation and turn. A conversation's rows in a part are cut into blocks of
     the square root of their number.
  2. Each block gives a 4 x 4 matrix of the costs from each state before it to each state after it (states: see `NEXT`).
  3. Backwards over the blocks of a conversation, one vector is kept at the end of each: the cost of all that follows from each state. These are
     the only checkpoints.
  4. Each block is computed again from its checkpoint and tells, for each state before it, the state in which the walk leaves it.
  5. Forwards over the blocks these lead to the state in which each is entered.
  6. Each block is computed again and emits its rows' letters.
  7. Letters and texts meet in order of the conversation, and one pass over each partition makes its counts, letters and digest. A SHA-256 has no parts, so the
     texts of one conversation pass through one task, a row at a time.
Steps 3 and 5 read blocks, the root of the rows, and keep one vector; 2, 4 and 6 keep one block.

Defined results: null roles, texts, keys and turns are one space (for the key of the damage) and a null turn comes first; rows of one turn are in order of role and
digest; equal rows stay, the first of them counts as the original; roles other than system, user and assistant have the initial that they begin with,
and an empty one has none and can't be kept; a null conv_id is a conversation; an empty table gives an empty result; other columns don't matter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.llm.textbuf import arrow_map
from darkslide.operators.ranking import deal_by_group
from darkslide.plans.session import materialize

_SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 50
#: States: nothing yet, after system, after user, after assistant. What follows each, and the state that the next role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: State after a kept row, by state and initial.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = {"su", "ua", "au"}


def with_inserts(v: list[int]) -> tuple[int, ...]:
    """Costs from each state where empty rows may come first."""
    return tuple(min(v[q], INSERT + v[NEXT[q]], 2 * INSERT + v[NEXT[NEXT[q]]]) for q in range(4))


#: Cost of the end, from each state.
END = with_inserts([0, NEVER, NEVER, 0])


def row_costs(code: str, after: tuple[int, ...]) -> list[dict[str, int]]:
    """For each state, the cost of each letter that a row can take and all that follows. A code is an initial and a fault (b, d, t, o)."""
    initial, fault = code
    out = []
    for q in range(4):
        c = {"D": DELETE + after[q]}
        if fault not in "bd":
            late = TRUNCATED * (fault == "t")
            if initial in KEPT[q]:
                c["K"] = KEEP + late + after[KEPT[q][initial]]
            c["R"] = REROLE + late + after[NEXT[q]]
        out.append(c)
    return out


def step_back(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return with_inserts([min(c.values()) for c in row_costs(code, after)])


def backwards(codes: str, extra: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a block (codes of two letters each) from those after it. extra: rows that are deleted in any case."""
    for i in range(len(codes) - 2, -1, -2):
        after = step_back(codes[i : i + 2], after)
    return tuple(min(NEVER, x + DELETE * extra) for x in after)


#: Codes of blocks whose results are remembered: most conversations are short and alike.
SHORT = 40


def remembered(f: Callable) -> Callable:
    cached = lru_cache(1 << 14)(f)

    @wraps(f)
    def either(codes: str, *rest: object) -> object:
        return (cached if len(codes) <= SHORT else f)(codes, *rest)

    return either


@remembered
def matrix(codes: str, extra: int) -> tuple[tuple[int, ...], ...]:
    """matrix[q][r]: least cost of a block from state q before it to state r after it."""
    columns = [backwards(codes, extra, with_inserts([0 if r == x else NEVER for x in range(4)])) for r in range(4)]
    return tuple(zip(*columns, strict=True))


def through(m: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a block of matrix m (row by row)."""
    return tuple(min(m[4 * q + r] + after[r] for r in range(4)) for q in range(4))


@remembered
def walked(codes: str, after: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """The letters of each row of a block (with those put in before it) that is entered in a state, and the state after it: always the first
    letter in ASCII of those that cost no more than the best."""
    ahead = [after]
    for i in range(len(codes) - 2, -1, -2):
        ahead.append(step_back(codes[i : i + 2], ahead[-1]))
    letters = []
    for i in range(0, len(codes), 2):
        best, costs, own = ahead.pop(), row_costs(codes[i : i + 2], ahead[-1]), ""
        while True:
            if costs[state]["D"] == best[state]:
                own += "D"
            elif INSERT + best[NEXT[state]] == best[state]:
                own += "I"
                state = NEXT[state]
                continue
            elif costs[state].get("K") == best[state]:
                own += "K"
                state = KEPT[state][codes[i]]
            else:
                own += "R"
                state = NEXT[state]
            break
        letters.append(own)
    return letters, state


def closing(state: int) -> str:
    """Letters of the rows that are put in at the end."""
    out = ""
    while END[state]:
        out, state = out + "I", NEXT[state]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows that are left after damage."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("_c"))
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    role = F.when(F.col("_c") == 4, "user").otherwise(F.col("role"))
    return rows.where("_c <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_c") == 3, 2).otherwise(1).cast("long").alias("copies"))


def keyed(rows: DataFrame) -> DataFrame:
    """rows with d, a digest of role and text."""
    return rows.withColumn("d", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


ORDER = ["turn", "role", "d"]


def outlines(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, d, code, n: distinct rows with their initial and fault, without their texts, and how many they stand for.

    The first row of a role and text in a conversation is found by a minimum, which is aggregated before it is shuffled, so one that fills a
    conversation is no single task."""
    end = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("o")
    slim = keyed(rows).select("conv_id", "turn", "role", "d", fault.alias("fault"), "copies")
    slim = materialize(slim.groupBy("conv_id", "turn", "role", "d").agg(F.min("fault").alias("fault"), F.sum("copies").alias("n")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = slim.groupBy(F.col("conv_id").alias("_conv"), F.col("d").alias("_d")).agg(F.min(when).alias("_first"))
    both = slim.join(first, slim["conv_id"].eqNullSafe(first["_conv"]) & (slim["d"] == first["_d"]))
    again = (F.col("fault") != "b") & ~when.eqNullSafe(F.col("_first"))
    initial = F.rpad(F.left("role", F.lit(1)), 1, "\0")
    return both.select("conv_id", *ORDER, F.concat(initial, F.when(again, "d").otherwise(F.col("fault"))).alias("code"), "n")


def blocks(outline: DataFrame) -> DataFrame:
    """conv_id, part, block, items (in order), codes, extra, m (matrix). A block has at most the root of the rows that the conversation has in its part."""
    dealt = deal_by_group(outline, ["conv_id"], [F.col(c) for c in ORDER])
    run = Window.partitionBy("_part", "conv_id")
    place = F.row_number().over(run.orderBy(*ORDER)) - 1
    length = F.ceil(F.sqrt(F.count("*").over(run)))
    numbered = dealt.withColumns({"r": place, "block": F.floor(place / length).cast("long")})
    items = F.sort_array(F.collect_list(F.struct("r", *ORDER, "code", "n")))
    grouped = numbered.groupBy("conv_id", F.col("_part").alias("part"), "block").agg(items.alias("items"))
    codes = F.array_join(F.transform("items", lambda x: x["code"]), "")
    extra = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["n"] - 1)
    flat = lambda x: [y for row in matrix(x["codes"], x["extra"]) for y in row]
    with_matrix = _add(grouped.withColumns({"codes": codes, "extra": extra}), "m", T.ArrayType(T.LongType()), lambda: flat)
    return materialize(with_matrix, "turn-blocks")


def _add(df: DataFrame, name: str, kind: T.DataType, run: Callable[[], Callable[[dict], object]]) -> DataFrame:
    """df with a column that a function makes of each row; run() makes that function for one task, which may remember the rows before."""
    inputs = ["conv_id", "codes", "extra", "m", "after", "exits"]
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = {T.LongType(): pa.int64(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}[kind]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = run()
        for batch in batches:
            have = [c for c in inputs if c in batch.schema.names]
            made = pa.array([value(x) for x in batch.select(have).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return arrow_map(df, task, schema)


def _of_conversation(first: object, go_on: Callable[[object, dict], tuple[object, object]]) -> Callable[[], Callable[[dict], object]]:
    """For rows sorted by conversation: a value for each row and what is handed on to the next; a conversation starts with `first`."""

    def start() -> Callable[[dict], object]:
        now = [object(), first]

        def value(row: dict) -> object:
            if row["conv_id"] != now[0]:
                now[:] = row["conv_id"], first
            out, now[1] = go_on(now[1], row)
            return out

        return value

    return start


BLOCK = ["conv_id", "part", "block"]


def _beside(cut: DataFrame, cols: list[str], found: DataFrame) -> DataFrame:
    """found with columns of its blocks."""
    names = {c: f"_{c}" for c in BLOCK}
    c = cut.select(*BLOCK, *cols).withColumnsRenamed(names)
    on = found["conv_id"].eqNullSafe(c["_conv_id"]) & (found["part"] == c["_part"]) & (found["block"] == c["_block"])
    return found.join(c, on).drop(*names.values())


def entered(cut: DataFrame) -> DataFrame:
    """BLOCK, after (the checkpoint at a block's end), state (in which the walk enters it), for blocks with their matrix m."""
    many, one = T.ArrayType(T.LongType()), T.LongType()
    from_end = cut.select(*BLOCK, "m").repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").desc(), F.col("block").desc())
    marked = _add(from_end, "after", many, _of_conversation(END, lambda v, x: (list(v), through(x["m"], v)))).drop("m")
    exits = lambda x: [walked(x["codes"], tuple(x["after"]), q)[1] for q in range(4)]
    led = _add(_beside(cut, ["codes"], marked), "exits", many, lambda: exits).drop("codes")
    from_start = led.repartition("conv_id").sortWithinPartitions(*BLOCK)
    return _add(from_start, "state", one, _of_conversation(START, lambda q, x: (q, x["exits"][q]))).drop("exits")


def lettered(cut: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, turn, role, d, code, n, letters of every distinct row."""
    texts = ["role", "d", "code"]
    schema = T.StructType([found.schema["conv_id"], T.StructField("turn", T.LongType()), *(T.StructField(c, T.StringType()) for c in texts), T.StructField("n", T.LongType()), T.StructField("letters", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            ends = items.offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                # some 10,000 rows at a time, one block at least
                to = max(at + 1, min(batch.num_rows, int(ends.searchsorted(ends[at] + 10_000))))
                some = batch.slice(at, to - at)
                letters = [y for x in some.select(["codes", "after", "state"]).to_pylist() for y in walked(x["codes"], tuple(x["after"]), x["state"])[0]]
                flat = some.column("items").flatten()
                conv = some.column("conv_id").take(pa.array([i for i, n in enumerate(ends[at + 1 : to + 1] - ends[at:to]) for _ in range(n)], pa.int64()))
                yield pa.RecordBatch.from_arrays([conv, *(flat.field(c) for c in ("turn", *texts, "n")), pa.array(letters, pa.string())], schema.names)
                at = to

    return arrow_map(_beside(cut, ["items", "codes"], found), task, schema)


class Report:
    """Counts, letters and digest of one conversation whose rows come in order."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.low, self.high, self.turns, self.last_turn = conv_id, None, None, 0, None
        self.faults, self.illegal, self.before = dict.fromkeys("bdto", 0), 0, None
        self.state, self.cost, self.letters, self.digest, self.empty, self.waits = START, 0, bytearray(), hashlib.sha256(), True, None

    def put(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + role.encode() + b":" + text.encode())
        self.empty = False

    def outline(self, turn: int | None, role: str, code: str, n: int, letters: str) -> None:
        """A distinct row, before its text; n - 1 repeats are deleted."""
        if turn is not None and turn != self.last_turn:
            self.low, self.high, self.turns, self.last_turn = turn if self.low is None else self.low, turn, self.turns + 1, turn
        initial, fault = role[:1], code[1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.before = initial
        self.faults[fault] += 1
        self.faults["b" if fault == "b" else "d"] += n - 1
        for x in letters:
            self.letters += x.encode()
            if x == "I":
                self.state = NEXT[self.state]
                self.put(ROLE_OF[self.state], "")
                self.cost += INSERT
            elif x == "D":
                self.cost += DELETE
            else:
                self.state = KEPT[self.state][initial] if x == "K" else NEXT[self.state]
                self.cost += (KEEP if x == "K" else REROLE) + TRUNCATED * (fault == "t")
                self.waits = role if x == "K" else ROLE_OF[self.state]
        self.letters += b"D" * (n - 1)
        self.cost += DELETE * (n - 1)

    def text(self, text: str) -> None:
        if self.waits is not None:
            self.put(self.waits, text)
            self.waits = None

    def result(self) -> tuple:
        for x in closing(self.state):
            self.letters += x.encode()
            self.state = NEXT[self.state]
            self.put(ROLE_OF[self.state], "")
            self.cost += INSERT
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, self.letters.decode(), self.digest.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def reports(rows: Iterator[dict]) -> Iterator[tuple]:
    now = None
    for x in rows:
        if now is None or x["conv_id"] != now.conv_id:
            if now is not None:
                yield now.result()
            now = Report(x["conv_id"])
        if x["kind"] == 1:
            now.outline(x["turn"], x["role"], x["code"], x["n"], x["letters"])
        elif x["kind"] == 2:
            now.text(x["text"])
    if now is not None:
        yield now.result()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of a table (conv_id, turn, role, text)."""
    left = damaged(conversations)
    cut = blocks(outlines(left))
    found = lettered(cut, entered(cut))
    nothing = lambda kind: F.lit(None).cast(kind)
    keys = conversations.select("conv_id").distinct().select("conv_id", nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("d"), F.lit(0).alias("kind"))
    lines = found.withColumn("kind", F.lit(1))
    texts = keyed(left).select("conv_id", *ORDER, F.lit(2).alias("kind"), "text")
    rows = lines.unionByName(keys, True).unionByName(texts, True).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "kind")
    kind = conversations.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def stream() -> Iterator[dict]:
            for batch in batches:
                kinds[:] = [batch.schema.field("conv_id").type]
                yield from (x for a in range(0, batch.num_rows, 1024) for x in batch.slice(a, 1024).to_pylist())

        some: list[tuple] = []
        types = lambda: [kinds[0], *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types(), strict=True)], names=schema.names)
        for row in reports(stream()):
            some.append(row)
            if len(some) == 4096:
                yield pack()
                some.clear()
        if some:
            yield pack()

    return arrow_map(rows, task, schema)
