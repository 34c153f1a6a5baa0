"""Chat formatting (operator 11): conversations as windows of whole turns under a token budget, chosen by prefix sums of turn tokens; the system
turn is retained, a limited history repeated, and repeated targets are masked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import checkpoint_dir, give_back
from .packing import encoder_of, vocabulary_paths

#: Tokens of a window, and of the turns before it that it repeats.
BUDGET, HISTORY = 2048, 256
#: Budgets between two places where the choice of windows starts anew, so that a conversation of any length is split.
SEGMENT = 64
#: A text that is encoded at once.
ENCODED_BYTES = 1 << 20
NO_ID = -(1 << 63)

# The template. A control string inside a role or a text gets a backslash after its first character, a backslash another one.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)
PAIR = re.compile(r"\\(\\?)")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])(?=/?s>|/?INST\])", r"$1\\")


def unescape(text: str) -> str:
    return PAIR.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(text)]


MEASURED = "pid int, conv long, nth long, before long, tokens long, target boolean, system boolean, head string, body string"


def measured(rows: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """Turns in order, dealt by ranges of (conversation, turn), so that a conversation of any length spans partitions; with the tokens of
    each formatted turn, and the turns and tokens that the same conversation has before it in the same partition."""
    schema = pa.schema([("pid", pa.int32()), ("conv", pa.int64()), ("nth", pa.int64()), ("before", pa.int64()), ("tokens", pa.int64()), ("target", pa.bool_()), ("system", pa.bool_()), ("head", pa.string()), ("body", pa.string())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pid = encoder_of(*vocabulary), TaskContext.get().partitionId()
        now, nth, before = None, 0, 0
        for batch in batches:
            c = batch.to_pydict()
            sizes, some, held = [], [], 0
            for h, b in zip(c["head"], c["body"], strict=True):
                some.append(f"{h}{b}{CLOSE}".encode())
                held += len(some[-1])
                if held >= ENCODED_BYTES:
                    sizes += map(len, encoder.encode(some))
                    some, held = [], 0
            sizes += map(len, encoder.encode(some)) if some else []
            places, starts = [], []
            for conv, n in zip(c["conv"], sizes, strict=True):
                if conv != now:
                    now, nth, before = conv, 0, 0
                places.append(nth)
                starts.append(before)
                nth, before = nth + 1, before + n
            yield pa.record_batch([pa.array([pid] * len(sizes), pa.int32()), pa.array(c["conv"], pa.int64()), pa.array(places, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(c[k], schema.field(k).type) for k in ("target", "system", "head", "body"))], schema=schema)
        give_back()

    keys = ["conv", "turn", "role", "mark"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    return ordered.select("conv", (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system"), head.alias("head"), escape(F.col("text")).alias("body")).mapInArrow(count, MEASURED).checkpoint()


def placed(turns: DataFrame) -> DataFrame:
    """turns with seq and start: turns and tokens of the whole conversation before each."""
    totals = turns.groupBy("conv", "pid").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    many = totals.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1")
    w = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.join(many, "conv", "left_semi").select("conv", "pid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(w), F.lit(0)).alias("t0"))
    # a range of rows shares at most its first and its last conversation with others: two rows for each partition
    out = turns.join(F.broadcast(shifts), ["conv", "pid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("conv", (F.col("nth") + zero("n0")).alias("seq"), (F.col("before") + zero("t0")).alias("start"), "tokens", "target", "system", "head", "body")


def _segments(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns dealt by (conversation, segment): its own (kind 2), those of the segment before that may be repeated (1), the system turn (0)."""
    length = SEGMENT * budget
    t = turns.withColumn("seg", F.floor(F.col("start") / length))
    near = (F.col("start") >= (F.col("seg") + 1) * length - history) & (F.col("tokens") <= history)
    place = lambda seg, kind: F.struct(seg.alias("seg"), F.lit(kind).alias("kind"))
    spread = F.when(near, F.array(place(F.col("seg"), 2), place(F.col("seg") + 1, 1))).otherwise(F.array(place(F.col("seg"), 2)))
    rest = ["seq", "tokens", "target", "system", "head", "body"]
    own = t.select("conv", F.explode(spread).alias("p"), *rest).select("conv", "p.seg", "p.kind", *rest)
    # the system turn for each further segment; very many of these are dealt by blocks of them
    later = t.where("seg > 0").groupBy("conv", "seg").agg(F.lit(0).alias("kind")).withColumn("block", F.floor(F.col("seg") / 1024))
    first = t.where((F.col("seq") == 0) & F.col("system") & (F.col("tokens") * 2 <= budget)).select("conv", *rest)
    blocks = later.select("conv", "block").distinct()
    again = later.join(first.join(blocks, "conv"), ["conv", "block"]).select("conv", "seg", "kind", *rest)
    return own.unionByName(again).repartition("conv", "seg").sortWithinPartitions("conv", "seg", "kind", "seq")


WINDOWS = "conv long, segment long, window int, text string, loss array<struct<start:int,stop:int>>, n_tokens long, first_turn long, n_repeated int, over_budget boolean"
WINDOW_ROWS = pa.schema([("conv", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("n_tokens", pa.int64()), ("first_turn", pa.int64()), ("n_repeated", pa.int32()), ("over_budget", pa.bool_())])


def choose(tokens: list[int], system: int, first: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(oldest repeated turn, first new turn, end) of each window over turns of which those before ``first`` can only be repeated.

    system: tokens of a retained turn that comes before all of these, or 0. Prefix sums decide: a window takes new turns while the budget
    lasts, one at least; the history is what fits into ``history`` and leaves room for the first new turn.
    """
    prefix = [0]
    for n in tokens:
        prefix.append(prefix[-1] + n)
    at = first
    while at < len(tokens):
        old = at
        while old > 0 and prefix[at] - prefix[old - 1] <= history and system + prefix[at + 1] - prefix[old - 1] <= budget:
            old -= 1
        end = at + 1
        while end < len(tokens) and system + prefix[end + 1] - prefix[old] <= budget:
            end += 1
        yield old, at, end
        at = end


def _windows(key: tuple[int, int], rows: list[dict], budget: int, history: int) -> Iterator[tuple]:
    retained, turns = [], rows
    if rows[0]["kind"] == 0 or (rows[0]["seq"] == 0 and rows[0]["system"] and rows[0]["tokens"] * 2 <= budget):
        retained, turns = rows[:1], rows[1:]
    own = next((k for k, r in enumerate(turns) if r["kind"] == 2), len(turns))
    # a turn too long to be repeated is not here; what lies before it can't be repeated either
    turns = [r for k, r in enumerate(turns) if k >= own or r["seq"] == turns[own]["seq"] - own + k] if own < len(turns) else []
    own = next((k for k, r in enumerate(turns) if r["kind"] == 2), 0)
    spans = list(choose([r["tokens"] for r in turns], sum(r["tokens"] for r in retained), own, budget, history))
    if not spans and retained and retained[0]["kind"] == 2:
        spans = [(0, 0, 0)]  # a system turn alone
    for k, (old, at, end) in enumerate(spans):
        fresh = k == 0 and bool(retained) and retained[0]["kind"] == 2
        parts, loss, length = [], [], 0
        for j, r in [*((-1, r) for r in retained), *zip(range(old, end), turns[old:end], strict=True)]:
            parts += [r["head"], r["body"], CLOSE]
            if r["target"] and j >= at:
                loss.append({"start": length + len(r["head"]), "stop": length + len(r["head"]) + len(r["body"])})
            length += len(r["head"]) + len(r["body"]) + len(CLOSE)
        n = sum(r["tokens"] for r in [*retained, *turns[old:end]])
        first = retained[0]["seq"] if fresh else turns[at]["seq"]
        yield (*key, k, "".join(parts), loss, n, first, at - old + len(retained) - fresh, n > budget)


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Windows of conversations: conv_id, segment, window (their order), text, loss (spans of assistant texts in code points), n_tokens,
    first_turn (number of the first new turn), n_repeated (turns of an earlier window, which come first), over_budget.

    Turns go by turn number, nulls first, equal ones by role and text; repeated rows stay. A null text or role is empty; a null
    conversation id is a conversation of its own. A turn longer than the budget is a window of its own, whole. The system turn is the
    first one, if its role says so and it takes at most half of the budget; a longer one isn't repeated. Every turn is new in one window,
    where alone it is under the loss. Columns of other names are not read. An empty table gives none.

    A conversation is dealt by ranges of its turns and then by segments of ``SEGMENT`` budgets, where the choice of windows starts anew
    with the history before; so a conversation with most of the rows is many groups.
    """
    checkpoint_dir(rows.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = rows.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = placed(measured(r.withColumn("mark", F.xxhash64("text")), vocabulary or vocabulary_paths()))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            key, held = None, []
            for batch in batches:
                for row in batch.to_pylist():
                    if (row["conv"], row["seg"]) != key:
                        if held:
                            yield from _windows(key, held, budget, history)
                        key, held = (row["conv"], row["seg"]), []
                    held.append(row)
            if held:
                yield from _windows(key, held, budget, history)

        out, size = [], 0
        for w in groups():
            out.append(w)
            size += len(w[3])
            if size >= 4 * ENCODED_BYTES:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), WINDOW_ROWS, strict=True)], schema=WINDOW_ROWS)
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), WINDOW_ROWS, strict=True)], schema=WINDOW_ROWS)
        give_back()

    made = _segments(turns, budget, history).mapInArrow(build, WINDOWS)
    return made.withColumn("conv", F.nullif("conv", F.lit(NO_ID))).withColumnRenamed("conv", "conv_id")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """READ: what the windows of each conversation say, parsed from their texts: turns that are new, and what is under the loss.

    A digest runs over a conversation from its first turn to its last, so its windows pass through one task, in order and one batch at
    a time; nothing but the state of two digests is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done() -> pa.RecordBatch:
            conv, n, turns, chars, loss, length, count = state
            return pa.record_batch([pa.array([conv], pa.int64()), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([length]), pa.array([count])], names)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        yield done()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                new = parse(row["text"])[row["n_repeated"] :]
                state[1] += len(new)
                state[2].update("".join(f"{r}\n{t}\n" for r, t in new).encode())
                for s in row["loss"]:
                    target = unescape(row["text"][s["start"] : s["stop"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(row["text"])
                state[6] += 1
        if state is not None:
            yield done()

    dealt = windows.select("conv_id", "segment", "window", "text", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return dealt.mapInArrow(read, READ)


PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: digests of what the formatted conversations, and one of control strings, read back as."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))))
