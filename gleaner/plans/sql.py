"""SQL text over the registered tables, read-only."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.plans import names

#: Seconds after which a typed statement is ended.
SECONDS = 300

# --- Fixed values -----------------------------------------------------------
# Plans of statements that run something and still only read, by the start of their names.
READING_COMMANDS = ("Describe", "Show", "Explain")
# ----------------------------------------------------------------------------

_PLANS = "org.apache.spark.sql.catalyst.plans.logical"


class ReadOnly(ValueError):
    """The statement is not one that only reads."""


def _nodes(plan):
    """The plan, what stands in its ``WITH`` list, and everything below."""
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        named = plan.cteRelations()
        for i in range(named.size()):
            yield from _nodes(named.apply(i)._2())


def check_read_only(spark: SparkSession, statement: str) -> None:
    """Accept what Spark's parser takes for a query or for a describing command; refuse any command or write in it."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as problem:  # noqa: BLE001
        raise ReadOnly(f"not a statement: {str(problem).splitlines()[0][:200]}") from None
    kinds = [spark._jvm.java.lang.Class.forName(f"{_PLANS}.{name}") for name in ("Command", "ParsedStatement")]
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if any(kind.isInstance(node) for kind in kinds) and not name.startswith(READING_COMMANDS):
            raise ReadOnly(f"only reading statements run here: {statement.strip()[:60]}")


def run_sql(spark: SparkSession, statement: str, rows: int | None = S.SQL_ROWS) -> DataFrame:
    """Rows of a reading statement, the first 50 unless told otherwise.

    Besides Spark's functions a statement may use the names of :mod:`gleaner.plans.names`.
    """
    statement = names.respelled(statement)
    names.define(spark, statement)
    check_read_only(spark, statement)
    result = spark.sql(statement)
    return result if rows is None else result.limit(rows)


_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


def try_sql(spark: SparkSession, statement: str, rows: int = S.SQL_ROWS, seconds: float = SECONDS) -> DataFrame | str:
    """The rows of :func:`run_sql`, fetched; an error, at run time too, becoming the text a chat would show.

    At most ``rows`` rows come to the driver. A statement that runs longer than ``seconds`` is ended: its
    jobs are a group of their own, which is cancelled.
    """
    context, group, over = spark.sparkContext, f"typed-{uuid.uuid4().hex}", threading.Event()

    def end() -> None:
        over.set()
        context.cancelJobGroup(group)

    clock = threading.Timer(seconds, end)
    before = [context.getLocalProperty(name) for name in _GROUP]
    context.setJobGroup(group, statement[:100], interruptOnCancel=True)
    try:
        result = run_sql(spark, statement, rows)
        clock.start()
        return spark.createDataFrame(result.collect(), result.schema)
    except Exception as problem:  # noqa: BLE001
        return f"SQL error: ended after {seconds:g} seconds" if over.is_set() else f"SQL error: {problem}"
    finally:
        clock.cancel()
        for name, value in zip(_GROUP, before):
            context.setLocalProperty(name, value)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Column, type and row count of every table."""
    parts = []
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("rows"))
        columns = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in df.dtypes])
        parts.append(counted.select(F.lit(name).alias("table_name"), F.explode(columns).alias("_c"), "rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("table_name", "_c.column", "_c.type", "rows")
