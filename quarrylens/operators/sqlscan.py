"""Conditions of SQL statements: WHERE predicates and join conditions with their tables, operators and positions.

A tokenizer and a descent over SELECT, UPDATE and DELETE, run on Arrow batches. What counts:
comparisons, BETWEEN, IN, IS [NOT] NULL, [NOT] LIKE; NOT is kept only for the last two; a comparison's left column wins, else its
right one, its operator as written; AND and OR are flattened; predicates' subqueries are not entered; CTE bodies, HAVING, GROUP and
ORDER are not read; subqueries in FROM are read after the outer WHERE. Positions start at 0 in each extracted expression.
A text that can't be read gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"[^"]*"|`[^`]*`|\[[^\]]*\]|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|:[A-Za-z_]\w*|\?\d*|<>|!=|>=|<=|\|\||.""", re.DOTALL)
_STOP = {"WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "SET", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ON", "USING", "OFFSET", "FETCH", "FOR", "RETURNING"}
_JOINS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL"}
_COMPARE = {"=", "<>", "!=", ">", ">=", "<", "<="}


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.isspace() and not t.startswith(("--", "/*"))]


def _name(token: str) -> str:
    return token.strip("\"`[]")


class _Scan:
    """One pass over a statement; ``where`` and ``joins`` collect (table, column, operator, position[, right table, right column])."""

    def __init__(self, sql: str):
        self.t = tokens(sql.strip().rstrip(";"))
        self.i = 0
        self.where: list[tuple] = []
        self.joins: list[tuple] = []
        self.where_text: str | None = None
        self.names: dict[str, str] = {}

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].upper() if self.i + k < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1]

    def until(self, words: set[str], end: int) -> int:
        """Place of the first of ``words`` outside parentheses from here, or ``end``."""
        depth = 0
        for k in range(self.i, end):
            if self.t[k] == "(":
                depth += 1
            elif self.t[k] == ")":
                depth -= 1
            elif depth == 0 and self.t[k].upper() in words:
                return k
        return end

    def close(self, k: int) -> int:
        """Place after the parenthesis that ends the one at ``k``."""
        depth = 0
        for j in range(k, len(self.t)):
            depth += (self.t[j] == "(") - (self.t[j] == ")")
            if depth == 0:
                return j + 1
        raise ValueError("unbalanced parentheses")

    def statement(self) -> None:
        if self.peek() == "WITH":  # the bodies of CTEs are not read
            self.i = self.until({"SELECT", "UPDATE", "DELETE"}, len(self.t))
        if self.peek() == "UPDATE":
            self.update()
        elif self.peek() == "DELETE":
            self.delete()
        else:
            self.query(len(self.t))

    def query(self, end: int) -> None:
        while self.i < end:
            if self.peek() == "(":
                stop = self.close(self.i)
                self.i += 1
                self.query(stop - 1)
                self.i = stop
            else:
                self.select(min(end, self.until({"UNION", "INTERSECT", "EXCEPT", "MINUS"}, end)))
            if self.i < end and self.peek() in {"UNION", "INTERSECT", "EXCEPT", "MINUS"}:
                self.i += 1
                if self.peek() in {"ALL", "DISTINCT"}:
                    self.i += 1
            else:
                self.i = max(self.i, self.until({"UNION", "INTERSECT", "EXCEPT", "MINUS"}, end))
                if self.i >= end:
                    return
                self.i += 1
                if self.peek() in {"ALL", "DISTINCT"}:
                    self.i += 1

    def select(self, end: int) -> None:
        self.i = self.until({"FROM"}, end) + 1
        if self.i > end:
            self.i = end
            return
        default, nested, ons = self.sources(end)
        self.conditions(end, default)
        self.finish(nested, ons, end)

    def finish(self, nested: list[tuple[int, int]], ons: list[tuple[int, int]], end: int) -> None:
        for a, b in ons:
            self.join_conditions(a, b)
        for a, b in nested:
            held, self.i = self.i, a
            self.query(b)
            self.i = held
        self.i = end

    def source(self, end: int, nested: list[tuple[int, int]]) -> str:
        if self.peek() == "(":
            stop = self.close(self.i)
            nested.append((self.i + 1, stop - 1))
            self.i, table = stop, ""
        else:
            table = _name(self.take())
            while self.peek() == "." and self.i < end:
                self.i += 1
                table = _name(self.take())
        alias = table
        if self.peek() == "AS":
            self.i += 1
        if self.i < end and re.match(r"[\w\"`\[]", self.t[self.i]) and self.peek() not in _STOP:
            alias = _name(self.take())
        self.names[alias.lower()] = table or alias
        return alias

    def sources(self, end: int) -> tuple[str, list, list]:
        nested: list[tuple[int, int]] = []
        ons: list[tuple[int, int]] = []
        default = self.source(end, nested)
        while self.i < end and (self.peek() == "," or self.peek() in _JOINS or self.peek() == "OUTER"):
            if self.peek() == ",":
                self.i += 1
                self.source(end, nested)
                continue
            while self.peek() in _JOINS | {"OUTER"}:
                self.i += 1
            self.source(end, nested)
            if self.peek() == "ON":
                a = self.i + 1
                self.i = self.until(_STOP - {"ON", "FOR"}, end) if self.until(_STOP - {"ON", "FOR"}, end) > a else a
                ons.append((a, min(self.i, self._comma(a))))
            elif self.peek() == "USING":
                self.i = self.close(self.i + 1)
        return default, nested, ons

    def _comma(self, a: int) -> int:
        held, self.i = self.i, a
        found = self.until({","}, held)
        self.i = held
        return found

    def conditions(self, end: int, default: str) -> None:
        self.i = self.until({"WHERE"}, end)
        if self.i >= end:
            return
        a = self.i + 1
        self.i = a
        b = self.until({"GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH", "FOR", "RETURNING"}, end)
        if self.where_text is None:
            self.where_text = _spaced(self.t[a:b])
        for k, (table, column, operator) in enumerate(self.predicates(a, b)):
            self.where.append((self.names.get((table or default).lower(), table or default), column, operator, k))

    def predicates(self, a: int, b: int) -> Iterator[tuple[str, str, str]]:
        for x, y in self.split(a, b):
            while x < y and self.t[x].upper() == "NOT":
                x += 1
            if x < y and self.t[x] == "(" and self.close(x) == y and self.t[x + 1].upper() != "SELECT":
                yield from self.predicates(x + 1, y - 1)
                continue
            if x < y and self.t[x].upper() == "EXISTS":
                continue
            yield from self.predicate(x, y)

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Parts between AND and OR outside parentheses; the AND of a BETWEEN stays."""
        out, depth, start, between = [], 0, a, False
        for k in range(a, b):
            word = self.t[k].upper()
            depth += (word == "(") - (word == ")")
            if depth:
                continue
            if word == "BETWEEN":
                between = True
            elif word == "AND" and between:
                between = False
            elif word in ("AND", "OR"):
                out.append((start, k))
                start = k + 1
        return [*out, (start, b)]

    def column(self, a: int, b: int) -> tuple[str, str] | None:
        part = self.t[a:b]
        if len(part) == 1 and re.match(r"[A-Za-z_\"`\[]", part[0]) and part[0].upper() not in {"NULL", "TRUE", "FALSE"}:
            return "", _name(part[0])
        if len(part) >= 3 and len(part) % 2 and all(x == "." for x in part[1::2]) and re.match(r"[A-Za-z_\"`\[]", part[0]):
            return _name(part[-3]), _name(part[-1])
        return None

    def predicate(self, a: int, b: int) -> Iterator[tuple[str, str, str]]:
        depth = 0
        for k in range(a, b):
            word = self.t[k].upper()
            depth += (word == "(") - (word == ")")
            if depth:
                continue
            if word in _COMPARE:
                found = self.column(a, k) or self.column(k + 1, b)
                if found:
                    yield *found, word
                return
            if word in ("BETWEEN", "IN", "LIKE", "IS"):
                negated = k > a and self.t[k - 1].upper() == "NOT"
                found = self.column(a, k - negated)
                if found:
                    if word == "IS":
                        word = "IS NOT NULL" if k + 1 < b and self.t[k + 1].upper() == "NOT" else "IS NULL"
                    elif word == "LIKE" and negated:
                        word = "NOT LIKE"
                    yield *found, word
                return

    def join_conditions(self, a: int, b: int) -> None:
        k = 0
        for x, y in self.split(a, b):
            while x < y and self.t[x] == "(" and self.close(x) == y:
                x, y = x + 1, y - 1
            at = next((j for j in range(x, y) if self.t[j] in _COMPARE), None)
            if at is not None and (left := self.column(x, at)) and (right := self.column(at + 1, y)):
                table = lambda c: self.names.get(c[0].lower(), c[0])
                self.joins.append((table(left), left[1], self.t[at], k, table(right), right[1]))
                k += 1

    def update(self) -> None:
        end = len(self.t)
        self.i += 1
        default, nested, ons = self.sources(self.until({"SET"}, end))
        self.i = self.until({"FROM", "WHERE"}, end)
        if self.peek() == "FROM":
            self.i += 1
            _, more, also = self.sources(self.until({"WHERE"}, end))
            nested, ons = nested + more, ons + also
        self.conditions(end, default)
        self.finish(nested, ons, end)

    def delete(self) -> None:
        end = len(self.t)
        self.i += 1
        if self.peek() != "FROM":
            self.i = self.until({"FROM"}, end)
        self.i += 1
        default, nested, ons = self.sources(self.until({"WHERE"}, end))
        self.conditions(end, default)
        self.finish(nested, ons, end)


def _spaced(part: list[str]) -> str:
    text = " ".join(part)
    return re.sub(r"\s*\.\s*", ".", re.sub(r"\(\s+", "(", re.sub(r"\s+([,)])", r"\1", text)))


def scan(sql: str | None) -> _Scan | None:
    """A statement's scan; null if it can't be read, or nests deeper than the interpreter's stack."""
    try:
        s = _Scan(sql or "")
        s.statement()
        return s
    except (IndexError, ValueError, RecursionError):
        return None


CONDITIONS = "query_id long, kind string, table_name string, column_name string, operator string, position int, right_table string, right_column string"


def conditions(queries: DataFrame, id_col: str = "query_id", sql_col: str = "sql") -> DataFrame:
    """A row for each condition of each statement; kind is WHERE or JOIN, and a join's left side is table_name, column_name."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, sql in zip(pdf["i"], pdf["s"], strict=True):
                s = scan(sql)
                if s is not None:
                    out += [(i, "WHERE", *w, None, None) for w in s.where] + [(i, "JOIN", *j) for j in s.joins]
            yield pd.DataFrame(out, columns=["query_id", "kind", "table_name", "column_name", "operator", "position", "right_table", "right_column"])

    return queries.select(F.col(id_col).cast("long").alias("i"), F.col(sql_col).alias("s")).mapInPandas(run, CONDITIONS)


@F.pandas_udf(StringType())
def where_text(sql: pd.Series) -> pd.Series:
    """Text of a statement's WHERE; of set operations the first branch's that has one."""
    return pd.Series([s.where_text if (s := scan(x)) else None for x in sql], dtype=object)


def where_clause(conditions: DataFrame) -> DataFrame:
    """(query_id, clause): the conditions in order as ``column operator ?`` joined by AND."""
    rows = conditions.filter("kind = 'WHERE'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "column_name", "operator"))).alias("cs"))
    return rows.select("query_id", F.array_join(F.transform("cs", lambda c: F.concat(c["column_name"], F.lit(" "), c["operator"], F.lit(" ?"))), " AND ").alias("clause"))


def first_condition(conditions: DataFrame) -> DataFrame:
    """(query_id, column_name): that of the least position; of equal ones the least name."""
    return conditions.filter("kind = 'WHERE'").groupBy("query_id").agg(F.min_by("column_name", F.struct("position", "column_name")).alias("column_name"))


def find_condition(conditions: DataFrame, column: str) -> DataFrame:
    """(query_id, operator): the first condition on ``column``, case ignored."""
    return conditions.filter((F.col("kind") == "WHERE") & (F.lower("column_name") == column.lower())).groupBy("query_id").agg(F.min_by("operator", "position").alias("operator"))


def first_table(sql):
    """The first name after FROM, its last dotted part, quotes off."""
    found = F.regexp_extract(sql, r"(?i)\bfrom\s+([\w.\"`\[\]]+)", 1)
    return F.nullif(F.translate(F.element_at(F.split(found, r"\."), -1), '"`[]', ""), F.lit(""))


def resolved(conditions: DataFrame, entities: DataFrame) -> DataFrame:
    """Conditions with entity names (entities: entity, table_name) replaced by their tables, case ignored."""
    e = entities.select(F.lower("entity").alias("e"), F.col("table_name").alias("t"))
    out = conditions.join(e, F.lower("table_name") == F.col("e"), "left").withColumn("table_name", F.coalesce("t", "table_name")).drop("e", "t")
    return out.join(e, F.lower("right_table") == F.col("e"), "left").withColumn("right_table", F.coalesce("t", "right_table")).drop("e", "t")


def derived_conditions(methods: DataFrame) -> DataFrame:
    """(query_id, table_name, column_name, operator, position): one = for each parameter of a query without a statement. methods(query_id, table_name, params array)."""
    return methods.select("query_id", "table_name", F.posexplode("params").alias("position", "column_name")).filter("column_name IS NOT NULL").select("query_id", "table_name", "column_name", F.lit("=").alias("operator"), "position")
