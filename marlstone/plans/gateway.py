"""A read-only door for ad-hoc SQL: one query, a time limit, a row limit that says when it cut."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Collection
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROWS, SECONDS = 1000, 5.0
#: The kinds of node that a parsed query may consist of; whatever else Spark's parser gives (commands, inserts below a
#: FROM, scripts, EXECUTE IMMEDIATE, TRANSFORM) is refused.
READS = frozenset("""
Aggregate AsOfJoin Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project
Range RelationTimeTravel Sample Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrdinal UnresolvedRelation UnresolvedSubqueryColumnAliases
UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Window WithWindowDefinition
""".split())
#: Groups of built-in functions that only work out values, and those of the mixed group that do; table functions that make rows.
GROUPS = frozenset("""
agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs
math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs xml_funcs
""".split())
PLAIN = frozenset("assert_true equal_null nvl nvl2 typeof uuid version monotonically_increasing_id spark_partition_id bitmap_count current_timezone".split())
TABLES = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
#: Expressions of a parsed query that name something only later.
_LATER = ("UnresolvedIdentifier", "NamedParametersQuery", "PosParametersQuery")


@dataclass(frozen=True)
class Answer:
    ok: bool
    rows: tuple[dict, ...] = ()
    truncated: bool = False
    error: str = ""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Reader:
    """What a parsed query does that isn't reading known relations by known functions."""

    def __init__(self, spark: SparkSession, relations: Collection[str] | None):
        self.spark, self.relations = spark, None if relations is None else {r.lower() for r in relations}
        self.gateway, self.named = spark.sparkContext._gateway, set()
        self.registry = spark._jsparkSession.sessionState().functionRegistry()

    def _is(self, x, name: str) -> bool:
        return is_instance_of(self.gateway, x, f"org.apache.spark.sql.catalyst.{name}")

    def _function(self, parts: list[str], tables: bool) -> str | None:
        name = parts[-1].lower()
        if len(parts) != 1:
            return "functions of a catalog aren't answered"
        if tables:
            return None if name in TABLES else f"the table function {name} isn't answered"
        info = self.registry.lookupFunction(self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        known = info.isDefined() and info.get().getClassName().startswith("org.apache.spark.sql.catalyst.expressions.")
        return None if known and (info.get().getGroup() in GROUPS or name in PLAIN) else f"the function {name} isn't answered"

    def _relation(self, parts: list[str]) -> str | None:
        if len(parts) != 1:
            return "only relations of one-part names are read"
        name = parts[0].lower()
        if name in self.named:
            return None
        known = self.spark.catalog.tableExists(f"`{name.replace('`', '``')}`") if self.relations is None else name in self.relations
        return None if known else f"there is no relation {parts[0]}"

    def refusal(self, plan) -> str | None:
        """Why the query isn't answered, or null. All nodes are seen: those below, those of common table expressions and of
        subqueries, and every expression with its parts."""
        todo, nodes = [plan], []
        while todo:
            x = todo.pop()
            nodes.append(x)
            todo += _items(x.children())
            if self._is(x, "plans.logical.LogicalPlan"):
                todo += [i for i in _items(x.innerChildren()) if hasattr(i, "nodeName")] + _items(x.expressions())
                if x.nodeName() == "UnresolvedWith":
                    self.named |= {c._1().lower() for c in _items(x.cteRelations())}
            elif self._is(x, "expressions.PlanExpression"):
                todo.append(x.plan())
        if self.named and self.relations is not None and any(self.spark.catalog.tableExists(f"`{n.replace('`', '``')}`") and n not in self.relations for n in self.named):
            return "a common table expression has the name of a relation that isn't read"
        return next((r for r in map(self._one, nodes) if r), None)

    def _one(self, x) -> str | None:
        name = x.nodeName()
        if self._is(x, "plans.logical.LogicalPlan"):
            if name not in READS:
                return f"only queries are answered, not {name}"
            if name == "UnresolvedRelation":
                return self._relation(_items(x.multipartIdentifier()))
            return self._function(_items(x.name()), True) if name == "UnresolvedTableValuedFunction" else None
        if any(n in name for n in _LATER):
            return "names that are worked out aren't answered"
        if self._is(x, "analysis.UnresolvedFunction"):
            return self._function(_items(x.nameParts()), False)
        return self._function([x.name().funcName()], True) if self._is(x, "analysis.UnresolvedGenerator") else None


def _shown(row: dict, raw: list[str]) -> dict:
    """Bytes that are JSON are shown as what they say, others as text."""
    for c in raw:
        try:
            row[c] = row[c] if row[c] is None else json.loads(row[c])
        except ValueError:
            pass
    return row


def query(spark: SparkSession, sql: str, rows: int = ROWS, seconds: float = SECONDS, relations: Collection[str] | None = None) -> Answer:
    """Rows as JSON values, times in UTC. Only a plan of reads alone is run; a late one is cancelled, its analysis included.

    It may read ``relations`` (the session's tables and views, if none are given) by one-part names, and call built-in
    functions that work out values: none that runs code by name, reads a file or is the user's own."""
    tag = f"gateway-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        if odd := _Reader(spark, relations).refusal(plan):
            return Answer(False, error=odd)
        found = spark.sql(sql).limit(rows + 1)
        raw = [f.name for f in found.schema if f.dataType.typeName() == "binary"]
        if len(set(found.columns)) == len(found.columns):
            found = found.withColumns({c: F.decode(F.col(f"`{c}`"), "UTF-8") for c in raw})
        got = found.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "ignoreNullFields": "false"}).alias("j")).collect()
    except Exception as e:  # the parser's, the analyser's and the timer's refusals are answers here
        return Answer(False, error=str(e).splitlines()[0])
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return Answer(True, tuple(_shown(json.loads(r.j), raw) for r in got[:rows]), len(got) > rows)
