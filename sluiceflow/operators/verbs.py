"""The dataflow verbs: split, run, map, combine, top, match, and row filters."""

from __future__ import annotations

import queue
import subprocess
import tempfile
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial, reduce
from itertools import chain
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceflow.operators.ordered import numbered, running_total
from sluiceflow.session import PARTITION_BYTES, REPLICATE_LIMIT, at_most, input_bytes, materialize

KEY_BLOCK = 500
# Salts over which inputs are dealt when the keys are many; more for larger inputs.
LEAST_SALTS = 8


def replicated_if_small(df: DataFrame, limit: int = REPLICATE_LIMIT, settle: bool = False) -> DataFrame:
    """Mark `df` for broadcast when a count shows it is small; else leave it to a shuffled join.

    With `settle` a table that is costly to compute is written first, so that
    counting it does not compute it a second time.
    """
    if settle:
        df = materialize(df, "settled")
    return F.broadcast(df) if at_most(df, limit) else df


def split_by_size(df: DataFrame, order_by: Sequence[str], size: Column, split_size: int, name: str = "chunk") -> DataFrame:
    """Number the chunk each row starts in when rows are laid end to end in order."""
    run = running_total(df, order_by, {"__end": size})
    begin = F.col("__end") - size
    return run.withColumn(name, (F.floor(begin / split_size) + 1).cast("bigint")).drop("__end")


def split_by_count(df: DataFrame, order_by: Sequence[str], rows: int, name: str = "chunk") -> DataFrame:
    """Number chunks of `rows` rows each."""
    placed = numbered(df, order_by, "__row")
    return placed.withColumn(name, F.floor((F.col("__row") - 1) / rows).cast("bigint")).drop("__row")


def combine(*parts: DataFrame) -> DataFrame:
    """All rows of all parts."""
    return reduce(DataFrame.unionByName, parts)


def threshold(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.where(F.col(column) <= F.lit(limit))


def before_deadline(df: DataFrame, reexecute: Column, execute: Column, now: Column) -> DataFrame:
    """Rows with no deadline, or one that has not passed."""
    return df.where((reexecute <= 0) | (execute <= 0) | (now < execute))


def route(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The target of the first rule that holds."""
    chosen = F.lit(otherwise)
    for condition, target in reversed(rules):
        chosen = F.when(condition, F.lit(target)).otherwise(chosen)
    return chosen


def exclude(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(replicated_if_small(listed.select(*keys).distinct(), settle=True), keys, "left_anti")


def top(df: DataFrame, number: int, score: str | Column, *ties: str | Column) -> DataFrame:
    """The `number` rows with the greatest score; each task sends only its own best rows on."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (score, *ties)]
    return df.orderBy(*[c.desc() for c in columns]).limit(number)


def take_first(df: DataFrame, number: int, *order_by: str) -> DataFrame:
    return df.orderBy(*order_by).limit(number)


def match(scores: DataFrame, key: str, score: str) -> DataFrame:
    """The key with the greatest score; the smallest key among equals."""
    return scores.orderBy(F.col(score).desc(), F.col(key).asc()).limit(1)


def match_within(scores: DataFrame, group: Sequence[str], key: str, score: str) -> DataFrame:
    """`match` per group, combined inside each task before any row is shuffled."""
    rank = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    return scores.groupBy(*group).agg(
        F.min_by(F.col(key), rank).alias(key), F.min_by(F.col(score), rank).alias(score)
    )


def fan_out(
    inputs: DataFrame, keys: DataFrame, order_by: Sequence[str], limit: int = REPLICATE_LIMIT
) -> DataFrame:
    """Every input with every key, plus the key's position and the number of keys.

    Keys travel in blocks of bounded size. A key table of few rows and bytes goes to every
    executor and the inputs do not move. A larger one is joined on (salt,
    block): inputs are dealt over the salts, so no task holds all of them.
    """
    total, small = keys.count(), at_most(keys, limit)
    blocks = -(-total // KEY_BLOCK)
    if small:
        placed = keys.withColumn("file_id", F.row_number().over(Window.orderBy(*order_by)).cast("bigint"))
    else:
        placed = numbered(keys, order_by, "file_id")
    member = F.struct(*[F.col(c) for c in keys.columns], F.col("file_id"))
    packed = placed.groupBy(F.floor((F.col("file_id") - 1) / KEY_BLOCK).cast("int").alias("__block")).agg(
        F.collect_list(member).alias("__keys")
    )
    spread = inputs.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    if small:
        joined = spread.join(F.broadcast(packed), "__block")
    else:
        salts = max(LEAST_SALTS, input_bytes(inputs) // PARTITION_BYTES)
        salted = packed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = spread.withColumn("__salt", F.pmod(F.xxhash64(*inputs.columns), F.lit(salts)).cast("int"))
        joined = dealt.join(salted, ["__salt", "__block"])
    return joined.select(*inputs.columns, F.inline("__keys")).withColumn("num_files", F.lit(total).cast("bigint"))


def run(
    df: DataFrame,
    application: Callable[..., pd.DataFrame | Iterator[pd.DataFrame]],
    schema: str,
    params: Mapping | None = None,
) -> DataFrame:
    """Apply a user function to batches of rows; it may return one frame, several or none."""
    settings = dict(params or {})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = application(batch, settings)
            if isinstance(result, pd.DataFrame):
                yield result
            elif result is not None:
                yield from result

    return df.mapInPandas(apply, schema)


# Bytes of answers that may wait for the task that reads them; then the program waits.
WAITING_BLOCKS, BLOCK_BYTES = 16, 1 << 16


def pipe_through(
    df: DataFrame, column: str, command: Sequence[str], retry: Sequence[str] | None = None, name: str = "line"
) -> DataFrame:
    """Feed a text column to an external program, one per task, and read its output lines.

    The program may answer line by line or only at the end of its input: a thread
    feeds it while another reads, and neither input nor output is held whole. A
    null is an empty line, and a task without rows starts no program. When it
    exits with status 1 and `retry` is given, that command gets the task's rows
    once more, which are kept in a file meanwhile, and what the first one
    answered is not used. Any other failure fails the task.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = ("".join(f"{'' if pd.isna(v) else v}\n" for v in batch[column]).encode() for batch in batches if len(batch))
        first = next(texts, None)
        if first is None:
            return
        fed = chain([first], texts)
        if retry is None:
            yield from _frames(_answers(command, fed), name)
            return
        # Whether to use the answers is known only at their end.
        with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as told:
            try:
                for block in _answers(command, _noted(fed, given)):
                    told.write(block)
            except ProgramError as error:
                if error.status != 1:
                    raise
                given.seek(0)
                yield from _frames(_answers(retry, iter(partial(given.read, BLOCK_BYTES), b"")), name)
                return
            told.seek(0)
            yield from _frames(iter(partial(told.read, BLOCK_BYTES), b""), name)

    return df.select(column).mapInPandas(apply, f"{name} string")


class ProgramError(RuntimeError):
    def __init__(self, command: Sequence[str], status: int, said: bytes):
        super().__init__(f"{command[0]} failed with {status}: {said!r}")
        self.status = status


def _noted(texts: Iterator[bytes], file: IO[bytes]) -> Iterator[bytes]:
    for text in texts:
        file.write(text)
        yield text


def _frames(blocks: Iterator[bytes], name: str) -> Iterator[pd.DataFrame]:
    """The lines of the blocks; the last one may lack its end."""
    rest = b""
    for block in blocks:
        *whole, rest = (rest + block).split(b"\n")
        if whole:
            yield pd.DataFrame({name: [line.decode("utf-8", "replace").removesuffix("\r") for line in whole]})
    if rest:
        yield pd.DataFrame({name: [rest.decode("utf-8", "replace")]})


def _answers(command: Sequence[str], texts: Iterator[bytes]) -> Iterator[bytes]:
    """What a program writes while it is fed.

    Spark's iterator stays in the task's own thread. Others write to the program, read its answers into a queue of
    bounded length, and hold the end of what it says on errors. All texts are taken, also when it ends before.
    """
    process = subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    waiting: queue.Queue[bytes | None] = queue.Queue(WAITING_BLOCKS)
    feed: queue.Queue[bytes | None] = queue.Queue(1)
    said = bytearray()

    def read() -> None:
        while block := process.stdout.read1(BLOCK_BYTES):
            waiting.put(block)
        waiting.put(None)

    def complain() -> None:
        while block := process.stderr.read1(BLOCK_BYTES):
            said.extend(block)
            del said[:-500]

    def write() -> None:
        try:
            while (text := feed.get()) is not None:
                process.stdin.write(text)
            process.stdin.close()
        except OSError:  # it stopped reading, which its status explains
            while feed.get() is not None:
                pass

    threads = [threading.Thread(target=f, daemon=True) for f in (read, complain, write)]
    for thread in threads:
        thread.start()
    try:
        for text in chain(texts, [None]):
            while True:
                try:
                    feed.put(text, timeout=0.01)
                    break
                except queue.Full:
                    pass
                # The program may wait for room for its answers.
                while not waiting.empty():
                    block = waiting.get()
                    if block is None:
                        waiting.put(None)
                        break
                    yield block
        while (block := waiting.get()) is not None:
            yield block
        status = process.wait()
        threads[1].join()
        if status:
            raise ProgramError(command, status, bytes(said))
    finally:
        if process.poll() is None:
            process.kill()
            process.wait()
        ends_by = time.monotonic() + 2
        # Threads that still wait on a queue, when the task was left early.
        for thread in threads:
            while thread.is_alive() and time.monotonic() < ends_by:
                while not waiting.empty():
                    waiting.get()
                if feed.empty():
                    feed.put(None)
                thread.join(0.01)
