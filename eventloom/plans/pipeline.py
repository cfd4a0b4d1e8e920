"""Pipelines: a list of stages, checked before anything runs, then one lazy plan."""

from __future__ import annotations

import difflib
import inspect
import re
import time
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations
from ..model import stamp
from ..operators import core
from ..sources import files, sinks
from .state import State


class PipelineError(ValueError):
    pass


@dataclass
class Context:
    spark: SparkSession
    order: str = "seq"
    state: str | None = None
    today: date = field(default_factory=lambda: datetime.now(timezone.utc).date())


def _diff(df: DataFrame, ctx: Context, key: str, fields: list, only: list = (), ignore: list = (), emit_initial: bool = False, remember: bool = False, namespace: str = "diff", errors: str = "type") -> DataFrame:
    """Changes since the last run. The first run only remembers, unless told to emit; state is written once. Rows that report a failure (the column
    `errors` is "error") are no news of their key: they pass by, with change "error", and neither state nor comparison sees them."""
    if not ctx.state:
        raise PipelineError("diff needs a state folder")
    state = State(ctx.spark, f"{ctx.state}/{namespace}")
    failed = None
    if errors in df.columns:
        wrong = F.coalesce(F.col(errors) == "error", F.lit(False))
        failed, df = df.filter(wrong), df.filter(~wrong)
    rows = df.groupBy(key).agg(F.min_by(F.struct(*fields), ctx.order).alias("r")).select(key, "r.*") if ctx.order in df.columns else df.select(key, *fields).dropDuplicates([key])
    old = state.load()
    if old is None:
        out = core.diff(rows.limit(0), rows, key, tuple(fields), only=tuple(only))
        out = out if emit_initial else out.limit(0)
        state.save(rows)
    else:
        out = core.diff(old, rows, key, tuple(fields), tuple(ignore), tuple(only), remember=remember)
        state.save(core.union_first(key, rows, old) if remember else rows, keep=3)
    return out if failed is None else out.unionByName(failed.select(key, F.lit("error").alias("change")), allowMissingColumns=True)


#: name -> (function of (df, ctx, **options), needs all rows)
STAGES = {
    "select": (lambda df, ctx, fields: core.select(df, *fields), False),
    "filter": (lambda df, ctx, expr=None, field=None, eq=None, ne=None, gt=None, lt=None, contains=None: core.where(df, expr, field, eq, ne, gt, lt, contains), False),
    "map": (lambda df, ctx, set=(), drop=(): core.assign(df, *set, drop=tuple(drop)), False),
    "grep": (lambda df, ctx, patterns, field=(), regex=False, substring=False, case_sensitive=False, invert=False: core.grep(df, *patterns, field=tuple(field), regex=regex, substring=substring, case_sensitive=case_sensitive, invert=invert), False),
    "extract": (lambda df, ctx, what, field=("title", "summary", "text"), into=None, keep_case=False: core.extract(df, what, tuple(field), into, keep_case), False),
    "dedupe": (lambda df, ctx, by=(): core.dedupe(df, *by, order=ctx.order), True),
    "sort": (lambda df, ctx, by=("timestamp",), reverse=False: core.sort(df, *by, reverse=reverse, order=ctx.order), True),
    "limit": (lambda df, ctx, count: core.limit(df, count, ctx.order), False),
    "count": (lambda df, ctx, by, every=None, top=None, distinct=None, time="timestamp": core.count(df, by, durations.parse(every) if every else None, top, distinct, time, ctx.order), True),
    "trend": (lambda df, ctx, history=6, min_count=3, min_change=100.0: core.trend(df, history, min_count, min_change), True),
    "diff": (_diff, True),
}

MACRO = re.compile(r"\$\{(TODAY|YESTERDAY|YEAR|DAYS_AGO_(\d+))\}")


def expand(value, today: date):
    """Date macros in all texts of a specification."""
    if isinstance(value, dict):
        return {k: expand(v, today) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, today) for v in value]
    if not isinstance(value, str):
        return value

    def day(m):
        if m[1] == "YEAR":
            return str(today.year)
        return (today - timedelta(days=int(m[2]) if m[2] else m[1] == "YESTERDAY")).isoformat()

    return MACRO.sub(day, value)


def register(name: str, f, whole: bool = False) -> None:
    """A stage of one's own; built-in names win."""
    STAGES.setdefault(name, (f, whole))


def check(stages: list[dict]) -> list[tuple[str, dict]]:
    """Stages as (name, options), or an error that says which name or option is wrong and what it may have meant."""
    out = []
    for i, stage in enumerate(stages):
        stage = {stage: {}} if isinstance(stage, str) else stage
        if len(stage) != 1:
            raise PipelineError(f"stage {i + 1}: one operator, not {list(stage)}")
        ((name, options),) = stage.items()
        if name not in STAGES:
            near = difflib.get_close_matches(name, STAGES, 1)
            raise PipelineError(f"stage {i + 1}: no operator {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        known = [p for p in inspect.signature(STAGES[name][0]).parameters if p not in ("df", "ctx")]
        for o in options or {}:
            if o not in known:
                near = difflib.get_close_matches(o, known, 1)
                raise PipelineError(f"{name}: no option {o!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        out.append((name, dict(options or {})))
    return out


def build(df: DataFrame, stages: list[dict], ctx: Context) -> DataFrame:
    """The plan of all stages. A stream may not meet an operator that needs all rows, unless a limit ends it first."""
    bounded = not df.isStreaming
    for name, options in check(stages):
        run, whole = STAGES[name]
        if whole and not bounded and name not in ("dedupe", "count"):
            raise PipelineError(f"{name} needs all rows, but the source has no end; put a limit before it")
        bounded = bounded or name == "limit"
        df = stamp(run(df, ctx, **options), name)
    return df


def load(text: str, today: date | None = None) -> dict:
    """A specification from YAML (or JSON, which is YAML)."""
    import yaml

    spec = yaml.safe_load(text)
    for k in set(spec) - {"sources", "operators", "outputs", "name", "every", "state", "order"}:
        raise PipelineError(f"unknown key {k!r}")
    return expand(spec, today or datetime.now(timezone.utc).date())


def run(spark: SparkSession, spec: dict, state: str | None = None) -> DataFrame:
    """Sources, merged; operators; then every output gets the rows."""
    dfs = [files.read(spark, **s["file"]) for s in spec["sources"]]
    out = build(core.union(*dfs), spec.get("operators", []), Context(spark, spec.get("order", "seq"), state or spec.get("state")))
    for o in spec.get("outputs", []):
        ((kind, options),) = o.items()
        {"jsonl": sinks.jsonl, "csv": sinks.csv, "table": sinks.insert_or_ignore, "json": sinks.json_array}[kind](out, **options)
    return out


def watch(spark: SparkSession, text, every: str, rounds: int | None = None, sleep=time.sleep) -> list[Exception]:
    """Run again and again, reading the specification anew; a failed run does not end the watch. text: a function that gives it."""
    errors, n = [], 0
    while rounds is None or n < rounds:
        try:
            run(spark, load(text()))
        except Exception as e:  # noqa: BLE001  the next run may succeed
            errors.append(e)
        n += 1
        if rounds is None or n < rounds:
            sleep(durations.parse(every))
    return errors


def backfill(df: DataFrame, start: date, end: date, days: int, stages: list[dict], ctx: Context, time: str, key: str) -> DataFrame:
    """The stages, without diff and limit, over back-to-back windows of so many days: each row is in one window, a key counts once.

    One plan with a window column for all windows, not one run for each."""
    t = F.to_date(F.col(time))
    rows = df.filter((t >= F.lit(start)) & (t < F.lit(end))).withColumn("window", F.date_add(F.lit(start), (F.floor(F.datediff(t, F.lit(start)) / days) * days).cast("int")))
    rows = core.dedupe(rows, key, order=ctx.order)
    return build(rows, [s for s in stages if (s if isinstance(s, str) else next(iter(s))) not in ("diff", "limit")], ctx)
