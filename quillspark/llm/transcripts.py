"""Chat formatting: transcripts parsed by a hidden Markov model, then written as canonical turns.

The hidden states of a transcript's lines are role and place (the first line of a turn or a later
one). A line's observation joins its speaker marker with a few features of its text. Counts of
labelled lines give the model; Viterbi's path gives the roles. Transcripts are dealt out by ranges
of (conversation, line), so that a very long one is spread over many tasks: every fragment's
best-path matrix is small, and only those of fragments that share a conversation are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut

ROLES = ("system", "user", "assistant")
#: Names that transcripts give to the roles (fixed values).
NAMES = {"system": ("system", "instructions", "context"), "user": ("user", "human", "q", "question", "prompt"), "assistant": ("assistant", "ai", "bot", "a", "answer", "gpt", "model")}
#: Markers: none, one for each role, a name that is not known.
_MARKER = r"^[\s#*>\[(|<]*+([A-Za-z][A-Za-z ]{0,18})[\s\])*|>]*+:\s*+(?:\*\*)?\s*+"
STATES, MARKERS, FEATURES = 2 * len(ROLES), len(ROLES) + 2, 12
TRAIN_LINES = 200_000
NEVER = -1e30


def marker_of(line: Column) -> Column:
    """0 without a speaker marker, the role's number from 1 on, or 4 for a speaker of unknown name."""
    name = F.lower(F.trim(F.regexp_extract(line, _MARKER, 1)))
    out = F.when(name == "", 0)
    for k, role in enumerate(ROLES, 1):
        out = out.when(name.isin(*NAMES[role]), k)
    # A word before a colon may be plain text, which the model weighs.
    return out.otherwise(len(ROLES) + 1)


def content_of(line: Column) -> Column:
    """The line without the marker of a known speaker."""
    known = (marker_of(line) > 0) & (marker_of(line) <= len(ROLES))
    return F.when(known, F.regexp_replace(line, _MARKER, "")).otherwise(line)


def observation(line: Column) -> Column:
    """The number of a line's marker and features together."""
    text = content_of(line)
    length = F.when(F.length(text) < 40, 0).when(F.length(text) < 160, 1).otherwise(2)
    asks = F.when(text.rlike(r"\?\s*$"), 1).otherwise(0)
    starts = F.when(text.rlike(r"^\s*(?:[-*•`]|\d+[.)]|[a-z])"), 1).otherwise(0)
    return (marker_of(line) * FEATURES + length * 4 + asks * 2 + starts).cast("int")


def lines_of(transcripts: DataFrame, id_col: str, order_cols: list[str], text_col: str, label: Column | None = None) -> DataFrame:
    """(conv_id, place, line, role): the lines of each row in order; place sorts them within a transcript."""
    split = F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"\r?\n", -1)
    keys = [F.col(f"`{c}`") for c in order_cols]
    rows = transcripts.select(F.col(f"`{id_col}`").cast("string").alias("conv_id"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64(F.col(f"`{text_col}`")).alias("k")).alias("row"), (label if label is not None else F.lit(None).cast("string")).alias("role"), F.posexplode(split).alias("n", "line"))
    return rows.select("conv_id", F.struct("row", "n").alias("place"), "line", "role", "n")


class Model:
    """Log probabilities of the next state and of the observation in it; beyond STATES lies the state before the first line."""

    def __init__(self, first: np.ndarray, then: np.ndarray, seen: np.ndarray):
        log = [np.log((x + 0.1) / (x + 0.1).sum(-1, keepdims=True)) for x in (first, then, seen)]
        self.then = np.full((STATES + 1, STATES + 1), NEVER)
        self.then[STATES, :STATES], self.then[:STATES, :STATES] = log[0], log[1]
        self.seen = np.vstack((log[2], np.full(seen.shape[1], NEVER)))

    def step(self, obs: int) -> np.ndarray:
        """From each state (row) to each next one with this observation."""
        return self.then + self.seen[:, obs]


def begin() -> np.ndarray:
    """The weights of the states before a transcript's first line."""
    return np.where(np.arange(STATES + 1) == STATES, 0.0, NEVER)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best paths' weights over two runs of lines, one after the other."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def learn(lines: DataFrame) -> Model:
    """A model counted from labelled lines (conv_id, place, role, line), up to about TRAIN_LINES of them, whole conversations by hash."""
    known = lines.filter(F.col("role").isin(*ROLES))
    total = known.count()
    rate = min(1.0, TRAIN_LINES / max(1, total))
    sample = known.filter(F.pmod(F.xxhash64(F.lit("train"), "conv_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    role = F.when(F.col("role") == ROLES[0], 0).when(F.col("role") == ROLES[1], 1).otherwise(2)
    state = (role * 2 + F.when(F.col("n") == 0, 0).otherwise(1)).cast("int")
    order = Window.partitionBy("conv_id").orderBy("place")
    rows = sample.select(state.alias("s"), F.lag(state).over(order).alias("before"), observation(F.col("line")).alias("o"))
    first, then, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, MARKERS * FEATURES))
    for r in rows.groupBy("before", "s", "o").count().collect():  # a bounded number of kinds
        seen[r.s, r.o] += r["count"]
        if r.before is None:
            first[r.s] += r["count"]
        else:
            then[r.before, r.s] += r["count"]
    return Model(first, then, seen)


def _runs(ids: list) -> Iterator[tuple[int, int]]:
    at = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[at]:
            yield at, k
            at = k


def _ends(model: Model):
    """A fragment's first and last conversation: the best-path matrix of its lines there, and whether they are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, key, frag, several = None, None, None, None, False
        for batch in batches:
            ids, obs = batch.column("conv_id").to_pylist(), batch.column("obs").to_numpy()
            for a, b in _runs(ids):
                frag = batch.column("frag")[0].as_py()
                part = _tree([model.step(o) for o in obs[a:b]])
                if now is not None and ids[a] == key:
                    now = join(now, part)
                else:
                    if now is not None:
                        head, several = (head or (key, now)), True
                    key, now = ids[a], part
        if now is not None:
            head = head or (key, now)
            yield pa.RecordBatch.from_pydict({"frag": [frag], "head": [head[0]], "head_m": [head[1].ravel().tolist()], "tail": [key], "tail_m": [now.ravel().tolist()], "several": [several]}, schema=pa.schema([("frag", pa.int32()), ("head", pa.string()), ("head_m", pa.list_(pa.float64())), ("tail", pa.string()), ("tail_m", pa.list_(pa.float64())), ("several", pa.bool_())]))

    return run


def _tree(parts: list[np.ndarray]) -> np.ndarray:
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _decoded(model: Model, enter: dict[int, np.ndarray], leave: dict[int, np.ndarray]):
    """Viterbi's path over each conversation's lines in a fragment; enter: the best weights of the states before its first, leave: those that its last line's states have ahead."""
    steps = [model.step(o) for o in range(model.seen.shape[1])]

    def path(obs: np.ndarray, weight: np.ndarray, ahead: np.ndarray) -> list[int]:
        back = np.empty((len(obs), STATES + 1), np.int8)
        for k, o in enumerate(obs):
            moves = weight[:, None] + steps[o]
            back[k] = moves.argmax(0)
            weight = moves.max(0)
            weight -= weight.max()
        state = int((weight + ahead).argmax())
        out = [state]
        for k in range(len(obs) - 1, 0, -1):
            state = int(back[k][state])
            out.append(state)
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, frag, first, flat = [], None, True, np.zeros(STATES + 1)

        def done(last: bool) -> pa.RecordBatch:
            nonlocal held, first
            table = pa.Table.from_batches(held).combine_chunks()
            states = path(table.column("obs").to_numpy(), enter.get(frag, begin()) if first else begin(), leave.get(frag, flat) if last else flat)
            held, first = [], False
            rest = [c for c in table.schema.names if c not in ("obs", "frag")]
            return table.select(rest).append_column("state", pa.array(states, pa.int32())).to_batches()[0]

        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            for a, b in _runs(ids):
                frag = batch.column("frag")[0].as_py()
                if held and held[-1].column("conv_id")[0].as_py() != ids[a]:
                    yield done(False)
                held.append(batch.slice(a, b - a))
        if held:
            yield done(True)

    return run


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, place, line, role, starts, canonical) for each line (conv_id, place, line): its role, whether it begins a turn, and how it is written.

    A turn is written as <|role|> on a line of its own and its lines without the marker.

    Ties between paths go to the lower state. A null conv_id is a conversation of its own. No lines
    give an empty result. At most two small matrices of each partition go through the driver.
    """
    spark = lines.sparkSession
    bound_batches(spark)
    rows = lines.select(F.coalesce("conv_id", F.lit("\0")).alias("conv_id"), "place", "line", observation(F.col("line")).alias("obs"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(parts, "conv_id", "place").sortWithinPartitions("conv_id", "place").withColumn("frag", F.spark_partition_id()))
    ends = dealt.select("conv_id", "obs", "frag").mapInArrow(_ends(model), "frag int, head string, head_m array<double>, tail string, tail_m array<double>, several boolean").orderBy("frag").collect()
    square = lambda m: np.array(m).reshape(STATES + 1, STATES + 1)
    enter, leave, weight, open_ = {}, {}, begin(), None
    for r in ends:
        into = weight if r["head"] == open_ else begin()
        enter[r.frag] = into
        weight = (begin()[:, None] + square(r.tail_m) if r.several else into[:, None] + square(r.head_m)).max(0)
        open_ = r["tail"]
    ahead, open_ = np.zeros(STATES + 1), None
    for r in reversed(ends):
        leave[r.frag] = ahead if r["tail"] == open_ else np.zeros(STATES + 1)
        ahead = (square(r.head_m) + (0 if r.several else leave[r.frag])).max(1)
        open_ = r["head"]
    kind = dealt.schema
    schema = f"conv_id string, place {kind['place'].dataType.simpleString()}, line string, state int"
    out = dealt.mapInArrow(_decoded(model, enter, leave), schema)
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.shiftright("state", 1) + 1)
    starts = F.col("state") % 2 == 0
    turn = F.when(starts, F.concat(F.lit("<|"), role, F.lit("|>\n"), content_of(F.col("line")))).otherwise(content_of(F.col("line")))
    return out.select(F.nullif("conv_id", F.lit("\0")).alias("conv_id"), "place", "line", role.alias("role"), starts.alias("starts"), turn.alias("canonical"))
