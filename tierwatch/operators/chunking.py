"""Greedy token-budget chunking, distributed.

Semantics per key, rows in order: a row joins the current chunk unless the
chunk is non-empty and ``tokens_so_far + row_tokens > budget``, in which
case it starts a new chunk; an oversized row therefore gets its own chunk.

The rule is a left-to-right scan, so a key's rows cannot simply be split.
Instead:

1. range-partition on (key, order) and sort within partitions: a hot key
   becomes many partitions; the result is checkpointed, so partitions and
   their order are fixed;
2. every partition is summarised as a transfer function *incoming carry ->
   outgoing carry*, where a carry is (key, state, chunk number) of the row
   before.  Only a partition that lies inside one key depends on its carry:
   its function is a step function of the state (0..budget+1) with at most
   budget + 2 steps.  Any other partition has a constant outcome;
3. the functions compose associatively, so a tree of blocks of ``FAN``
   partitions composes them upwards and hands the carries downwards: no task
   sees more than FAN functions and the depth is the logarithm of the
   partitions;
4. every partition is relabelled from its carry.

Steps 2 and 4 read Arrow batches one after the other and keep only the carry
(step 2: and one step function) between them.  The rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, ship_package

#: Partitions or blocks that one task of the tree composes.
FAN = 64


class Carry(NamedTuple):
    """The chunk of the row before: its key, its tokens so far (at most
    budget + 1: states beyond the budget behave alike) and its number."""
    key: str
    state: int
    chunk: int


class Part(NamedTuple):
    """Transfer function of consecutive rows.  ``last``, ``state`` and
    ``chunk`` are the outcome when the first row starts a chunk.  When all
    rows have one key, a chunk carried in with state s ends in front of step
    k, the first whose ``reach`` exceeds budget - s; then the state is
    ``ends[k]`` and ``starts[k]`` chunks have started.  Beyond all steps the
    carried chunk goes on with ``total`` more tokens.  Rows of several keys
    have no steps: their outcome is the same for every carry."""
    first: str
    last: str
    state: int
    chunk: int
    total: int
    reach: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


_NONE = np.empty(0, dtype=np.int64)


def label(keys: list, tokens: list, carry: Carry | None, budget: int) -> tuple[list[int], Carry | None]:
    """Chunk number of every row and the carry after the last one."""
    key, state, chunk = carry or (None, 0, 0)
    out = []
    for k, t in zip(keys, tokens):
        if k != key:
            key, state, chunk = k, t, 0
        elif state + t > budget:
            state, chunk = t, chunk + 1
        else:
            state += t
        state = min(state, budget + 1)
        out.append(chunk)
    return out, carry if key is None else Carry(key, state, chunk)


def steps_of(key: str, tokens: list, budget: int) -> Part:
    """The transfer function of rows of one key."""
    t = np.asarray(tokens, dtype=np.int64)
    m, cap = len(t), budget + 1
    sums = np.concatenate([[0], np.cumsum(t)])
    after = np.maximum(np.searchsorted(sums, sums[:-1] + budget, side="right") - 1, np.arange(1, m + 1)).tolist()
    ends, starts = [0] * m, [1] * m                       # a chunk started at row j, backwards
    for j in range(m - 1, -1, -1):
        n = after[j]
        if n < m:
            ends[j], starts[j] = ends[n], starts[n] + 1
        else:
            ends[j] = min(int(sums[m] - sums[j]), cap)
    return _part(key, key, ends[0], starts[0] - 1, int(sums[m]), sums[1:], np.array(ends), np.array(starts), budget)


def _part(first, last, state, chunk, total, reach, ends, starts, budget) -> Part:
    """Steps up to the first that every state takes, each outcome once."""
    reach, at = np.unique(reach, return_index=True)       # of equal reaches only the first is ever taken
    ends, starts = ends[at], starts[at]
    w = int(np.searchsorted(reach, budget, side="right")) + 1
    reach, ends, starts = reach[:w], ends[:w], starts[:w]
    keep = np.ones(len(reach), dtype=bool)
    keep[:-1] = (ends[1:] != ends[:-1]) | (starts[1:] != starts[:-1])
    return Part(first, last, int(state), int(chunk), min(int(total), budget + 1), reach[keep], ends[keep], starts[keep])


def _through(p: Part, states: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(states after, chunks started) for chunks of p's key carried in."""
    at = np.searchsorted(p.reach, budget - states, side="right")
    hit = at < len(p.reach)
    at = np.minimum(at, len(p.reach) - 1)
    return (np.where(hit, p.ends[at], np.minimum(states + p.total, budget + 1)), np.where(hit, p.starts[at], 0))


def apply(p: Part, carry: Carry | None, budget: int) -> Carry:
    if carry is None or carry.key != p.first or not len(p.reach):
        return Carry(p.last, p.state, p.chunk)
    state, started = _through(p, np.array([carry.state]), budget)
    return Carry(p.last, int(state[0]), carry.chunk + int(started[0]))


def compose(a: Part, b: Part, budget: int) -> Part:
    """The transfer function of a's rows followed by b's."""
    out = apply(b, Carry(a.last, a.state, a.chunk), budget)
    if not (len(a.reach) and len(b.reach) and a.first == b.first):
        return Part(a.first, out.key, out.state, out.chunk, 0, _NONE, _NONE, _NONE)
    ends, started = _through(b, a.ends, budget)
    reach, starts = a.reach, a.starts + started
    if a.total <= budget:                                  # small states pass a: then b's steps decide
        reach = np.concatenate([reach, a.total + b.reach])
        ends, starts = np.concatenate([ends, b.ends]), np.concatenate([starts, b.starts])
    return _part(a.first, out.key, out.state, out.chunk, a.total + b.total, reach, ends, starts, budget)


def summarize(batches, budget: int) -> Part | None:
    """The transfer function of (keys, tokens) batches in order."""
    whole = carry = None
    for keys, tokens in batches:
        if not keys:
            continue
        if (whole is None or len(whole.reach)) and keys[0] == keys[-1]:
            part = steps_of(keys[0], tokens, budget)
        else:                                              # several keys: only the outcome counts
            out = label(keys, tokens, None, budget)[1]
            part = Part(keys[0], out.key, out.state, out.chunk, 0, _NONE, _NONE, _NONE)
        carry = label(keys, tokens, carry, budget)[1]
        whole = part if whole is None else compose(whole, part, budget)._replace(
            last=carry.key, state=carry.state, chunk=carry.chunk)
    return whole


_PART_SCHEMA = ("_pid int, first string, last string, state bigint, chunk bigint, total bigint, "
                "reach array<bigint>, ends array<bigint>, starts array<bigint>")
_CARRY_SCHEMA = "_pid int, c_key string, c_state bigint, c_chunk bigint"


def _part_rows(pids, parts) -> pd.DataFrame:
    return pd.DataFrame([(pid, *p) for pid, p in zip(pids, parts)], columns=["_pid", *Part._fields])


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[int, Part]]:
    for row in pdf.sort_values("_pid")[["_pid", *Part._fields]].itertuples(index=False, name=None):
        yield row[0], Part(*row[1:6], *(np.asarray(x, dtype=np.int64) for x in row[6:]))


def _block(level: DataFrame, fan: int) -> DataFrame:
    return level.withColumn("_block", F.floor(F.col("_pid") / fan).cast("int"))


def _carries(level: DataFrame, n: int, budget: int, fan: int) -> DataFrame:
    """(_pid, carry into it) for all but the first of n transfer functions."""

    def up(key, pdf):
        whole = None
        for _, p in _parts(pdf):
            whole = p if whole is None else compose(whole, p, budget)
        return _part_rows([key[0]], [whole])

    def down(key, pdf, into):
        carry, out = None, []
        if len(into):
            carry = Carry(into["c_key"].iloc[0], int(into["c_state"].iloc[0]), int(into["c_chunk"].iloc[0]))
        for pid, p in _parts(pdf):
            if carry is not None:
                out.append((pid, *carry))
            carry = apply(p, carry, budget)
        return pd.DataFrame(out, columns=["_pid", "c_key", "c_state", "c_chunk"])

    if n > fan:                                            # read twice: upwards and downwards
        level = level.checkpoint(eager=False)
        blocks = _block(level, fan).groupBy("_block").applyInPandas(up, _PART_SCHEMA)
        into = _carries(blocks, -(-n // fan), budget, fan)
    else:
        into = level.sparkSession.createDataFrame([], _CARRY_SCHEMA)
    # a block without carry still hands one from member to member
    return (_block(level, fan).groupBy("_block").cogroup(into.groupBy("_pid"))
            .applyInPandas(lambda key, pdf, c: down(key, pdf, c), _CARRY_SCHEMA))


def chunk(df: DataFrame, key: str, order: str, tokens: str, budget: int,
          name: str = "chunk_id", num_partitions: int | None = None, fan: int = FAN) -> DataFrame:
    """``df`` plus ``name``: the 0-based chunk index of each row within its key."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Internal key, never null: "v" + key, or "n" for a null key.
    ikey = F.when(F.col(key).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("v"), F.col(key).cast("string")))
    by = [F.col("_key").asc_nulls_last(), F.col(order).asc_nulls_last()]
    ranged = (df.withColumn("_key", ikey)
              .withColumn("_tok", F.coalesce(F.col(tokens).cast("long"), F.lit(0)))
              .repartitionByRange(n, *by).sortWithinPartitions(*by)
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))

    def summary(batches):
        pid = []

        def columns():
            for b in batches:
                pid[:] = b["_pid"].to_pylist()[:1] or pid
                yield b["_key"].to_pylist(), b["_tok"].to_pylist()
        part = summarize(columns(), budget)
        if part is not None:
            yield pa.RecordBatch.from_pandas(_part_rows(pid, [part]), schema=to_arrow, preserve_index=False)

    lists = pa.list_(pa.int64())
    to_arrow = pa.schema([("_pid", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("state", pa.int64()),
                          ("chunk", pa.int64()), ("total", pa.int64()), ("reach", lists), ("ends", lists), ("starts", lists)])
    parts = ranged.select("_pid", "_key", "_tok").mapInArrow(summary, _PART_SCHEMA)

    # At most one carry a partition, so its size is bounded by their number; a
    # broadcast join leaves partitions and their order as they are.
    joined = ranged.join(F.broadcast(_carries(parts, n, budget, fan)), "_pid", "left")
    kept = [*df.columns]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def relabel(batches):
        carry = begun = None
        for b in batches:
            if not b.num_rows:
                continue
            if not begun:
                begun, got = True, [b[c][0].as_py() for c in ("c_key", "c_state", "c_chunk")]
                carry = Carry(*got) if got[0] is not None else None
            ids, carry = label(b["_key"].to_pylist(), b["_tok"].to_pylist(), carry, budget)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(ids, pa.int64())], names=[*kept, name])

    return joined.mapInArrow(relabel, schema)
