"""A guarded SELECT surface: statements are judged by their parsed and by their resolved plan, not by their text.

Everything is let through by list: kinds of plan nodes, functions, and tables. A name is a table unless a WITH clause
that is in scope defines it, and within its own definition it isn't yet. A statement that passes is resolved in a
session of its own that knows the allowed tables alone and reads no files by name, and what its plan reads at the
bottom must be what those tables read. It runs under a timer that cancels its jobs.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

ALLOWED = ("products", "product_extraction", "product_embedding", "ingredients_dict")
MAX_ROWS = 20
#: A statement that takes longer is cancelled.
SECONDS = 30.0
#: Parsed nodes that only read, filter, group, join and order.
NODES = frozenset(
    "Project Filter Aggregate UnresolvedHaving Sort Distinct GlobalLimit LocalLimit Offset Join Union Except Intersect SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith WithWindowDefinition OneRowRelation".split()
)
#: Parsed expressions that name no function and yet change what a statement means.
FORBIDDEN = frozenset("Collate UnresolvedCollation".split())
#: Leaves of a resolved plan that read nothing.
EMPTY = frozenset("OneRowRelation CTERelationRef".split())
FUNCTIONS = frozenset(
    "abs any array_contains array_distinct array_join array_max array_min array_size array_sort arrays_overlap avg between bool_and bool_or bround ceil char_length coalesce concat concat_ws "
    "contains corr count count_if current_date current_timestamp date_trunc datediff dense_rank element_at endswith every exists explode filter first first_value floor from_unixtime greatest if ifnull "
    "ilike instr isnotnull isnull lag last last_value lead least left len length like ln log lower lpad ltrim map_keys map_values max max_by mean median min min_by mod month now nullif nvl "
    "percent_rank percentile position pow power rank regexp_count regexp_extract regexp_like regexp_replace replace rlike right round row_number rpad rtrim sign size "
    "sort_array split split_part sqrt startswith std stddev substr substring sum to_date transform trim try_divide upper variance when year".split()
)


class RejectedSQL(ValueError):
    """A statement that the guard doesn't let through."""


class StatementTimeout(RuntimeError):
    """A statement that was cancelled because it took too long."""


def _seq(items) -> list:
    return [items.apply(k) for k in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(node) -> Iterator:
    todo = _seq(node.expressions())
    while todo:
        expression = todo.pop()
        yield expression
        todo += _seq(expression.children())


def _check(plan, tables: frozenset[str], scope: frozenset[str]) -> int:
    """Tables that are read, counted, or RejectedSQL; scope holds the names that WITH clauses have defined."""
    kind = _kind(plan)
    if kind not in NODES:
        raise RejectedSQL(f"{kind} is not allowed")
    for expression in _expressions(plan):
        what = _kind(expression)
        if what in FORBIDDEN:
            raise RejectedSQL(f"{what} is not allowed")
        if what == "UnresolvedFunction":
            name = ".".join(_seq(expression.nameParts())).lower()
            if name not in FUNCTIONS:
                raise RejectedSQL(f"function not allowed: {name}")
    if kind == "UnresolvedRelation":
        parts = [part.lower() for part in _seq(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in scope | tables:
            raise RejectedSQL(f"table not allowed: {'.'.join(parts)}")
        return int(parts[0] not in scope)
    read = 0
    if kind == "UnresolvedWith":
        if plan.allowRecursion():
            raise RejectedSQL("recursion is not allowed")
        for relation in _seq(plan.cteRelations()):
            name = relation._1().lower()
            if not re.fullmatch(r"\w+", name):
                raise RejectedSQL(f"not a plain name: {name}")
            read += _check(relation._2(), tables, scope)
            scope |= {name}
    for below in [*_seq(plan.children()), *_seq(plan.subqueries())]:
        read += _check(below, tables, scope)
    return read


def validate_sql(spark: SparkSession, query: str, tables: tuple[str, ...] = ALLOWED) -> str:
    """The statement without its final semicolon, or RejectedSQL that says why.

    Let through is one SELECT (or WITH ... SELECT) over the allowed tables with a literal LIMIT at the top.
    """
    text = query.strip().rstrip(";").strip()
    if not text:
        raise RejectedSQL("empty statement")
    if not re.match(r"(?is)^\s*(select|with)\b", text):
        raise RejectedSQL("only SELECT is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise RejectedSQL("the statement can't be parsed") from e
    if not _check(plan, frozenset(tables), frozenset()):
        raise RejectedSQL("no table is read")
    while _kind(plan) == "UnresolvedWith":
        plan = plan.child()
    if _kind(plan) != "GlobalLimit" or _kind(plan.limitExpr()) != "Literal":
        raise RejectedSQL(f"LIMIT is missing: ask for at most {MAX_ROWS} rows")
    return text


def _leaves(plan) -> Iterator:
    """What a resolved plan reads, subqueries of its expressions included."""
    below = [*_seq(plan.children()), *_seq(plan.subqueries())]
    if not _seq(plan.children()):
        yield plan
    for node in below:
        yield from _leaves(node)


class GuardedSession:
    """A session of its own in which the allowed tables are the only ones, and files can't be read by name.

    tables holds DataFrames by name; the caller's temporary views stay unknown to it, and its own to the caller.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.tables = tuple(name.lower() for name in tables)
        self._read = []
        of_rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
        for name, frame in tables.items():
            plan = frame._jdf.queryExecution().analyzed()
            self._read += list(_leaves(plan))
            of_rows(self.spark._jsparkSession, plan).createOrReplaceTempView(name)

    def resolve(self, query: str) -> DataFrame:
        """The statement's rows, not started yet, or RejectedSQL."""
        text = validate_sql(self.spark, query, self.tables)
        try:
            out = self.spark.sql(text)
        except Exception as e:
            raise RejectedSQL(f"the statement can't be resolved: {str(e).splitlines()[0]}") from e
        for leaf in _leaves(out._jdf.queryExecution().analyzed()):
            if _kind(leaf) not in EMPTY and not any(leaf.sameResult(own) for own in self._read):
                raise RejectedSQL(f"not an allowed table: {_kind(leaf)}")
        return out

    def run(self, query: str, rows: int = MAX_ROWS, seconds: float = SECONDS) -> DataFrame:
        """At most rows rows of the statement, fetched; StatementTimeout if that takes longer than seconds.

        Its jobs bear a tag by which the timer cancels them and no others; the session stays as usable as before.
        """
        out = self.resolve(query).limit(rows)
        context, tag, over = self.spark.sparkContext, f"guarded-{uuid.uuid4().hex}", threading.Event()

        def cancel() -> None:
            over.set()
            while not done.wait(0.2):  # a job may start just after the others were cancelled
                context.cancelJobsWithTag(tag)

        done = threading.Event()
        timer = threading.Timer(seconds, cancel)
        context.addJobTag(tag)
        timer.start()
        try:
            fetched = out.collect()
        except Exception as e:
            if over.is_set():
                raise StatementTimeout(f"cancelled after {seconds} s") from e
            raise
        finally:
            done.set()
            timer.cancel()
            context.removeJobTag(tag)
        return self.spark.createDataFrame(fetched, out.schema)


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame], rows: int = MAX_ROWS, seconds: float = SECONDS) -> DataFrame:
    return GuardedSession(spark, tables).run(query, rows, seconds)
