"""Ordered pre/post-processing commands around a batch, as ``DataFrame.transform`` functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridweave.operators.catalog import no_clash

PRE = "pre"
POST = "post"


class WorkflowProcessingError(RuntimeError):
    """A command failed; the message names the command and the stage."""


@dataclass(frozen=True)
class Command:
    name: str
    fn: Callable[[DataFrame], DataFrame]
    stages: tuple[str, ...] = (PRE, POST)
    fails: Column | None = None


def pre_command(fn: Callable[[DataFrame], DataFrame], name: str | None = None, fails: Column | None = None) -> Command:
    return Command(name or fn.__name__, fn, (PRE,), fails)


def post_command(fn: Callable[[DataFrame], DataFrame], name: str | None = None, fails: Column | None = None) -> Command:
    return Command(name or fn.__name__, fn, (POST,), fails)


def run_hooks(df: DataFrame, stage: str, commands: Sequence[Command], force: bool = False) -> DataFrame:
    """Apply ``commands`` in order.

    A command not made for ``stage`` raises ``TypeError``; a failing command raises
    ``WorkflowProcessingError`` naming it.  Plans are lazy: analysis errors surface here, run-time
    errors when the result is computed - ``force=True`` computes each step's result once
    (``count``) so a failure is tied to its command.
    """
    if stage not in (PRE, POST):
        raise ValueError(f"unknown stage {stage!r}")
    for cmd in commands:
        if not isinstance(cmd, Command) or stage not in cmd.stages:
            raise TypeError(f"The command {getattr(cmd, 'name', cmd)} is not a {stage}-process command")
        try:
            df = cmd.fn(df)
            if force:
                df.count()
        except Exception as exc:  # noqa: BLE001
            raise WorkflowProcessingError(
                f"Command '{cmd.name}' failed during the {stage}-process stage: {exc}") from exc
    return df


#: Column of :func:`mark_failures` that names the first command a row failed at.
FAILED = "failed_command"


def mark_failures(df: DataFrame, stage: str, commands: Sequence[Command]) -> tuple[DataFrame, Observation]:
    """Apply ``commands`` as :func:`run_hooks` does and set the rows they fail on apart, in one pass.

    A command's ``fails`` is a condition on the rows it gives (null: the row passes).  Every row gets
    ``failed_command``, the name of the first command it failed at (null: none); it goes through the
    later commands all the same, so a command must carry that column along: one that loses it, or
    that a frame brings along itself, is refused.  The observation counts ``rows`` and the failures of every
    command by its name, and has its values once an action (a write, say) has run over the whole frame.  Names
    of commands that fail rows must differ.
    """
    no_clash(df, [FAILED])
    names = [c.name for c in commands if isinstance(c, Command) and c.fails is not None]
    if len({"rows", *names}) <= len(names):
        raise ValueError(f"commands that fail rows need names of their own, and not 'rows': {names}")
    df = df.withColumn(FAILED, F.lit(None).cast("string"))
    for cmd in commands:
        df = run_hooks(df, stage, [cmd])
        if FAILED not in df.columns:
            raise WorkflowProcessingError(f"Command '{cmd.name}' loses the column {FAILED}")
        if cmd.fails is not None:
            bad = F.col(FAILED).isNull() & F.coalesce(cmd.fails, F.lit(False))
            df = df.withColumn(FAILED, F.when(bad, F.lit(cmd.name)).otherwise(F.col(FAILED)))
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"),
                      *[F.count_if(F.coalesce(F.col(FAILED) == name, F.lit(False))).alias(name) for name in names]), seen
