"""Lineage of single SQL statements, from their tokens.

A statement is read leniently: what isn't understood is skipped up to the next clause, never fatal. Queries become scopes (the
sources of a FROM clause, with CTEs and derived tables inside them) and items (spans of tokens with their column references).
Columns are resolved one step (to the source as named) and through CTEs and derived tables down to stored tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from headwater.functions.rules import FAMILY_OF
from headwater.operators.lexer import Token, routine_statements, tokens

SNIPPET, EXPRESSION = 500, 200
UNKNOWN = "unknown"

_AGGREGATES = {n for n, f in FAMILY_OF.items() if f in ("aggregate", "advanced_aggregate", "array_aggregate")}
_WINDOWS = {n for n, f in FAMILY_OF.items() if f == "window_function"}
_SET_OPS = {"UNION", "INTERSECT", "EXCEPT", "MINUS"}
_CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "QUALIFY", "LIMIT", "WINDOW", "CONNECT", "START", "SAMPLE", "FETCH", "OFFSET", "RETURNING", "INTO", "MODEL", "FOR", "OPTION", "ON", "SET", "USING", "WHEN", "VALUES", "OUTPUT"}
_JOINS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL", "APPLY", "LATERAL", "STRAIGHT_JOIN"}
_NOT_ALIAS = _CLAUSES | _JOINS | _SET_OPS | {"AS", "PIVOT", "UNPIVOT", "TABLESAMPLE", "WITH", "SELECT", "AND", "OR", "BY", "END", "THEN", "ELSE", "MATCH_RECOGNIZE"}
#: Words that are no columns where a column could stand.
_NOT_COLUMN = _NOT_ALIAS | {
    "CASE", "WHEN", "NOT", "NULL", "IS", "IN", "LIKE", "ILIKE", "RLIKE", "BETWEEN", "EXISTS", "DISTINCT", "ALL", "ANY", "SOME", "ASC", "DESC", "OVER", "PARTITION", "ROWS", "RANGE", "PRECEDING", "FOLLOWING", "UNBOUNDED", "CURRENT", "ROW",
    "TRUE", "FALSE", "INTERVAL", "ESCAPE", "COLLATE", "AT", "TIME", "ZONE", "NULLS", "FIRST", "LAST", "TOP", "PERCENT", "FILTER", "WITHIN", "KEEP", "IGNORE", "RESPECT", "CURRENT_DATE", "CURRENT_TIMESTAMP", "CURRENT_TIME", "SYSDATE",
    "SYSTIMESTAMP", "CURRENT_USER", "USER", "PRIOR", "LEVEL", "ROWNUM", "YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DATE", "TIMESTAMP", "DEFAULT", "SEPARATOR", "FORMAT", "NAMED", "TITLE",
}
#: Of these, words that are also in use as names of columns.
_SOFT = {"YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DATE", "TIMESTAMP", "FORMAT", "TITLE", "LEVEL", "FIRST", "LAST", "TIME", "ZONE", "ROW", "RANGE", "FILTER"}
#: Functions in FROM that give the parts of a column.
_UNNESTING = {"FLATTEN", "UNNEST", "EXPLODE", "OPENJSON", "JSON_TABLE", "STRING_SPLIT", "SPLIT_TO_TABLE", "STRTOK_SPLIT_TO_TABLE", "JSONB_ARRAY_ELEMENTS", "JSON_ARRAY_ELEMENTS", "JSONB_EACH", "JSON_EACH"}
_DATE_PARTS = {"DATEADD", "DATEDIFF", "DATEPART", "DATENAME", "DATE_PART", "TIMESTAMPADD", "TIMESTAMPDIFF", "DATETRUNC"}


#: Stands between a name and a path into it while a reference is taken apart.
_PATH = "\x00"


def _path(text: str) -> str:
    return _PATH + text.lstrip(":")


def _column(name: str) -> str:
    """A column without the path into it."""
    return name.partition(":")[0].lower()


def unquote(name: str) -> str:
    return name.strip('[]"`')


@dataclass
class Item:
    name: str | None
    text: str
    refs: list[tuple[str | None, str]]
    functions: list[str]
    has_case: bool = False
    has_arithmetic: bool = False
    has_cast: bool = False
    has_concat: bool = False
    has_window: bool = False
    has_json: bool = False
    has_array: bool = False
    has_literal_only: bool = False
    is_star: bool = False
    star_of: str | None = None
    variants: list[tuple[str | None, str]] = field(default_factory=list)
    subqueries: list[Query] = field(default_factory=list)

    @property
    def is_direct(self) -> bool:
        return len(self.refs) == 1 and not (self.functions or self.has_case or self.has_arithmetic or self.has_cast or self.has_concat or self.subqueries or self.variants or self.has_window or self.has_json or self.has_array)

    @property
    def is_aggregate(self) -> bool:
        return any(f in _AGGREGATES for f in self.functions) and not (self.has_window and not any(f in _AGGREGATES for f in self.functions))

    def transform(self) -> str:
        """Kind of transformation: the first that applies."""
        f = self.functions
        if self.is_star or self.is_direct:
            return "direct"
        if self.has_literal_only:
            return "literal"
        if any(x in _WINDOWS for x in f) or self.has_window:
            return "window_function"
        if any(x in _AGGREGATES for x in f):
            return "aggregate"
        if self.has_case:
            return "case"
        if self.variants and not f:
            return "variant_access"
        if self.has_json or f and f[0].startswith(("JSONB_", "JSON_")) and f[0] not in FAMILY_OF:
            return "jsonb_operation"
        if self.has_array or f and f[0] in ("UNNEST", "ARRAY_APPEND", "ARRAY_LENGTH", "ARRAY_REMOVE", "ARRAY_CAT", "ARRAY_TO_STRING", "STRING_TO_ARRAY"):
            return "array_operation"
        if f and f[0] in ("COALESCE", "NVL", "IFNULL", "ISNULL"):
            return "coalesce"
        if self.has_arithmetic:
            return "arithmetic"
        if self.has_cast or f and f[0] in ("CAST", "TRY_CAST", "CONVERT", "TRY_CONVERT"):
            return "cast"
        if self.has_concat or f and f[0] == "CONCAT":
            return "concat"
        if f and f[0] in ("SUBSTR", "SUBSTRING"):
            return "substring"
        if f:
            return FAMILY_OF.get(f[0], "geospatial" if f[0].startswith("ST_") else "function")
        return "subquery" if self.subqueries else "expression"


@dataclass
class Source:
    alias: str | None
    table: str | None = None
    query: Query | None = None
    function: str | None = None
    inputs: list[tuple[str | None, str]] = field(default_factory=list)  # columns a function is given


@dataclass
class Query:
    items: list[Item] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    ctes: dict[str, Query] = field(default_factory=dict)
    cte_columns: dict[str, list[str]] = field(default_factory=dict)
    branches: list[Query] = field(default_factory=list)
    filters: list[Query] = field(default_factory=list)
    set_op: str | None = None
    into: str | None = None
    outer: Query | None = None
    text: str = ""


class Parser:
    def __init__(self, sql: str):
        self.sql, self.ts = sql, tokens(sql)

    # ---- helpers over spans of tokens [i, end)
    def up(self, i: int) -> str:
        return self.ts[i].upper if 0 <= i < len(self.ts) else ""

    def text(self, i: int, end: int) -> str:
        return self.sql[self.ts[i].start : self.ts[end - 1].end] if i < end else ""

    def match(self, i: int, end: int) -> int:
        """Index behind the bracket that closes the one at i."""
        depth = 0
        while i < end:
            if self.ts[i].kind == "op":
                if self.ts[i].text == "(":
                    depth += 1
                elif self.ts[i].text == ")":
                    depth -= 1
                    if depth == 0:
                        return i + 1
            i += 1
        return end

    def find(self, i: int, end: int, words: set[str]) -> int:
        """First token at this level that is one of the words, or end. CASE ... END counts as one level."""
        cases = 0
        while i < end:
            t = self.ts[i]
            if t.kind == "op" and t.text == "(":
                i = self.match(i, end)
                continue
            w = t.upper
            if w == "CASE":
                cases += 1
            elif w == "END" and cases:
                cases -= 1
            elif not cases and w in words and t.kind != "string" and (i == 0 or self.ts[i - 1].text != "."):
                return i
            i += 1
        return end

    def commas(self, i: int, end: int) -> list[tuple[int, int]]:
        spans, start = [], i
        while i < end:
            t = self.ts[i]
            if t.kind == "op" and t.text == "(":
                i = self.match(i, end)
                continue
            if t.kind == "op" and t.text == ",":
                spans.append((start, i))
                start = i + 1
            i += 1
        if start < end:
            spans.append((start, end))
        return spans

    def is_name(self, i: int) -> bool:
        return i < len(self.ts) and self.ts[i].kind in ("word", "name")

    def name(self, i: int, end: int) -> tuple[str | None, int]:
        """A dotted name and the index behind it."""
        if i >= end or not self.is_name(i):
            return None, i
        parts = [unquote(self.ts[i].text)]
        i += 1
        while i < end and self.ts[i].text == ".":
            if i + 1 < end and self.is_name(i + 1):
                parts.append(unquote(self.ts[i + 1].text))
                i += 2
            elif i + 1 < end and self.ts[i + 1].text == ".":
                i += 1
            else:
                break
        return ".".join(parts), i

    # ---- queries
    def query(self, i: int, end: int, outer: Query | None = None) -> Query:
        """A query with its CTEs and set operations."""
        while i < end and self.ts[i].text == "(" and self.match(i, end) == end:
            i, end = i + 1, end - 1
        q = Query(outer=outer, text=self.text(i, end))
        if self.up(i) == "WITH":
            i = self.ctes(i, end, q)
        op = self.find(i, end, _SET_OPS)
        if op < end:
            q.set_op = self.up(op)
            at = i
            while at < end:
                op = self.find(at, end, _SET_OPS)
                q.branches.append(self.query(at, op, q))
                at = op + 1
                if self.up(at) in ("ALL", "DISTINCT"):
                    at += 1
            return q
        if self.up(i) in ("SELECT", "SEL"):
            self.select(i + 1, end, q)
        elif self.up(i) == "VALUES":
            q.items = []
        elif self.ts[i : i + 1] and self.ts[i].text == "(":
            k = self.match(i, end)
            q.branches.append(self.query(i + 1, k - 1 if k < end or self.ts[k - 1].text == ")" else k, q))
        return q

    def ctes(self, i: int, end: int, q: Query) -> int:
        i += 1
        if self.up(i) == "RECURSIVE":
            i += 1
        while i < end:
            name, j = self.name(i, end)
            if name is None:
                break
            columns: list[str] = []
            if j < end and self.ts[j].text == "(":
                k = self.match(j, end)
                columns = [unquote(self.ts[a].text) for a, b in self.commas(j + 1, k - 1) if a < b]
                j = k
            while j < end and self.up(j) in ("AS", "NOT", "MATERIALIZED"):
                j += 1
            if j >= end or self.ts[j].text != "(":
                break
            k = self.match(j, end)
            q.cte_columns[name.lower()] = columns
            q.ctes[name.lower()] = Query(outer=q)  # known inside itself if it is recursive
            q.ctes[name.lower()] = self.query(j + 1, k - 1, q)
            q.ctes[name.lower()].into = name
            i = k
            if i < end and self.ts[i].text == ",":
                i += 1
                continue
            break
        return i

    def select(self, i: int, end: int, q: Query) -> None:
        while self.up(i) in ("DISTINCT", "ALL"):
            i += 1
        if self.up(i) == "TOP":
            i = self.match(i + 1, end) if i + 1 < end and self.ts[i + 1].text == "(" else i + 2
            if self.up(i) == "PERCENT":
                i += 1
            if self.up(i) == "WITH" and self.up(i + 1) == "TIES":
                i += 2
        stop = self.find(i, end, _CLAUSES - {"FOR", "ON", "SET", "USING", "WHEN", "OPTION", "START", "SAMPLE", "VALUES", "OUTPUT"})
        for a, b in self.commas(i, stop):
            q.items.append(self.item(a, b, q))
        i = stop
        if self.up(i) in ("INTO", "BULK"):
            name, j = self.name(i + 1, end)
            if name and not name.startswith((":", "@")):
                q.into = name
            i = self.find(j, end, {"FROM"})
        if self.up(i) == "FROM":
            stop = self.find(i + 1, end, _CLAUSES - {"FROM", "ON", "FOR", "USING", "VALUES", "SET", "INTO", "WHEN", "OUTPUT"})
            self.sources(i + 1, stop, q)
            i = stop
        q.filters += self.subqueries(i, end, q)

    def subqueries(self, i: int, end: int, q: Query) -> list[Query]:
        found = []
        while i < end:
            if self.ts[i].text == "(" and self.ts[i].kind == "op":
                k = self.match(i, end)
                if self.up(i + 1) in ("SELECT", "WITH", "SEL"):
                    found.append(self.query(i + 1, k - 1, q))
                    i = k
                    continue
            i += 1
        return found

    def sources(self, i: int, end: int, q: Query) -> None:
        """The FROM clause: names, derived tables and functions at its level, with their aliases."""
        expect = True
        while i < end:
            t, w = self.ts[i], self.up(i)
            if t.text == "," and t.kind == "op" or w in ("JOIN", "APPLY"):
                expect, i = True, i + 1
                continue
            if w in _JOINS or w == "ONLY":
                i += 1
                continue
            if w in ("ON", "USING"):
                stop = self.find(i + 1, end, {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL", ","})
                q.filters += self.subqueries(i + 1, stop, q)
                i = stop
                continue
            if not expect:
                i = self.match(i, end) if t.text == "(" else i + 1
                continue
            expect = False
            if t.text == "(":
                k = self.match(i, end)
                if self.up(i + 1) in ("SELECT", "WITH", "SEL", "VALUES") or i + 1 < end and self.ts[i + 1].text == "(" and self._leads_to_query(i + 1, k):
                    sub = self.query(i + 1, k - 1, q)
                    alias, i = self.alias(k, end)
                    q.sources.append(Source(alias, query=sub))
                else:  # joins in brackets
                    self.sources(i + 1, k - 1, q)
                    i = k
                continue
            if self.is_name(i):
                name, j = self.name(i, end)
                if j < end and self.ts[j].text == "(" and self.ts[i].kind == "word":
                    k = self.match(j, end)
                    alias, i = self.alias(k, end)
                    inner = name.upper() in ("TABLE", "LATERAL") and k - j > 2
                    fn = unquote(self.ts[j + 1].text) if inner and self.is_name(j + 1) else name
                    q.sources.append(Source(alias, function=fn, inputs=self.expression(j + 1, k - 1, q).refs))
                    continue
                if j < end and self.ts[j].text == "@" or j < end and self.ts[j].text.startswith("@") and self.ts[j].start == self.ts[j - 1].end:
                    j += 1  # database link
                alias, i = self.alias(j, end)
                q.sources.append(Source(alias, table=name))
                continue
            i += 1

    def _leads_to_query(self, i: int, end: int) -> bool:
        while i < end and self.ts[i].text == "(":
            i += 1
        return self.up(i) in ("SELECT", "WITH", "SEL")

    def alias(self, i: int, end: int) -> tuple[str | None, int]:
        if self.up(i) == "AS":
            i += 1
        if i < end and self.is_name(i) and (self.ts[i].kind == "name" or self.up(i) not in _NOT_ALIAS):
            alias = unquote(self.ts[i].text)
            i += 1
            if i < end and self.ts[i].text == "(":  # column names of a derived table, or hints
                i = self.match(i, end)
            return alias, i
        return None, i

    def item(self, i: int, end: int, q: Query) -> Item:
        """One item of a select list, or the right side of an assignment."""
        name, stop = None, end
        if end - i >= 2 and self.ts[i + 1].text == "=" and self.is_name(i) and self.ts[i].kind in ("word", "name"):  # alias = expression
            name, i = unquote(self.ts[i].text), i + 2
        as_at = self.find(i, end, {"AS"})
        if as_at < end and as_at + 1 < end and as_at + 2 == end:
            name, stop = unquote(self.ts[as_at + 1].text), as_at
        elif end - i >= 2 and self.is_name(end - 1) and self.ts[end - 2].text not in (".", "::") and self.ts[end - 2].kind != "op" and self.up(end - 1) not in _NOT_COLUMN and self.up(end - 2) not in _NOT_COLUMN - {"END", "NULL"}:
            name, stop = unquote(self.ts[end - 1].text), end - 1
        elif end - i >= 2 and self.is_name(end - 1) and self.ts[end - 2].text == ")" and self.up(end - 1) not in _NOT_COLUMN:
            name, stop = unquote(self.ts[end - 1].text), end - 1
        it = self.expression(i, stop, q)
        it.name = name or (it.refs[0][1] if it.is_direct else None)
        return it

    def expression(self, i: int, end: int, q: Query) -> Item:
        it = Item(None, self.text(i, end), [], [])
        n = 0
        depth_over: list[int] = []
        skip_type = False
        begin = i
        while i < end:
            t, w = self.ts[i], self.up(i)
            n += 1
            if t.kind == "op":
                if t.text == "(" and self.up(i + 1) in ("SELECT", "WITH", "SEL"):
                    k = self.match(i, end)
                    it.subqueries.append(self.query(i + 1, k - 1, q))
                    i = k
                    continue
                if t.text == "*" and (i == begin or self.ts[i - 1].text == ".") and i + 1 == end:
                    it.is_star = True
                    it.star_of = unquote(self.ts[i - 2].text) if i - 2 >= begin else None
                elif t.text in "+-*/%" and i > begin and not (self.ts[i - 1].kind == "op" and self.ts[i - 1].text in ("(", ",")) and self.up(i - 1) not in _NOT_COLUMN and not (t.text == "+" and self.ts[i + 1 : i + 2] and self.ts[i + 1].text == ")"):
                    it.has_arithmetic = it.has_arithmetic or not self._beside_string(i)
                    it.has_concat = it.has_concat or t.text == "+" and self._beside_string(i)
                elif t.text == "||":
                    it.has_concat = True
                elif t.text in ("->", "->>"):
                    it.has_json = True
                elif t.text == "::":
                    it.has_cast = True
                    _, i = self.name(i + 1, end)
                    if i < end and self.ts[i].text == "(":
                        i = self.match(i, end)
                    continue
                i += 1
                continue
            if t.kind in ("string", "number"):
                i += 1
                continue
            if w == "AS" and t.kind == "word":  # type of a cast
                _, i = self.name(i + 1, end)
                if i < end and self.ts[i].text == "(":
                    i = self.match(i, end)
                continue
            if w == "CASE":
                it.has_case = True
            if w == "OVER":
                it.has_window = True
            if w == "ARRAY" and i + 1 < end and self.ts[i + 1].text.startswith("["):
                it.has_array = True
                i += 1
                continue
            name, j = self.name(i, end)
            if j < end and self.ts[j].text == "=>":  # name of an argument
                i = j + 1
                continue
            if j < end and self.ts[j].text == "(" and t.kind == "word" and w not in ("IN", "AND", "OR", "NOT", "EXISTS", "OVER", "THEN", "ELSE", "WHEN", "ANY", "ALL", "BETWEEN", "LIKE", "FILTER", "GROUP", "CASE", "DISTINCT"):
                fn = name.upper().split(".")[-1]
                it.functions.append(fn)
                if fn in ("CAST", "TRY_CAST", "CONVERT", "TRY_CONVERT"):
                    it.has_cast = True
                i = j + 1
                if fn in ("CONVERT", "TRY_CONVERT") and self.is_name(i):  # CONVERT(type, value)
                    _, k = self.name(i, end)
                    if k < end and self.ts[k].text == "(":
                        k = self.match(k, end)
                    if k < end and self.ts[k].text == ",":
                        i = k + 1
                elif fn in _DATE_PARTS and self.is_name(i):
                    i += 1
                elif fn == "EXTRACT" and self.up(i + 1) == "FROM":
                    i += 2
                continue
            is_word_column = t.kind == "name" or "." in name or w not in _NOT_COLUMN or w in _SOFT and self._stands_alone(i)
            if is_word_column and name and not name.startswith(("@", "#")):
                if j < end and self.ts[j].text.startswith(":") and self.ts[j].text != "::" and self.ts[j].kind == "word" and self.ts[j].start == self.ts[j - 1].end:
                    start, j = j, j + 1
                    while j < end and (self.ts[j].text in (".", "[", "]") or self.ts[j - 1].text in (".", "[")):
                        j += 1
                    name += _path(self.text(start, j))
                    it.variants.append(self._ref(name))
                if name.startswith(":"):
                    name = name[1:]
                ref = self._ref(name)
                if ref not in it.refs:
                    it.refs.append(ref)
            i = j if j > i else i + 1
        it.has_literal_only = not (it.refs or it.functions or it.subqueries or it.is_star) and n > 0
        return it

    def _stands_alone(self, i: int) -> bool:
        """Whether a word that may be a unit or type is a name here: not beside a literal, as in DATE '2024-01-01' or INTERVAL '1' DAY."""
        before, behind = self.ts[i - 1] if i else None, self.ts[i + 1] if i + 1 < len(self.ts) else None
        return not (before and (before.kind in ("string", "number") or before.upper in ("INTERVAL", "TO")) or behind and (behind.kind == "string" or behind.upper == "TO"))

    def _beside_string(self, i: int) -> bool:
        return self.ts[i - 1].kind == "string" or i + 1 < len(self.ts) and self.ts[i + 1].kind == "string"

    @staticmethod
    def _ref(name: str) -> tuple[str | None, str]:
        """Qualifier and column; a path into a variant stays with the column."""
        name, _, path = name.partition(_PATH)
        head, _, last = name.rpartition(".")
        return (head or None), last + (f":{path}" if path else "")


# ---- resolution
def find_cte(q: Query | None, name: str) -> Query | None:
    while q is not None:
        if name.lower() in q.ctes:
            return q.ctes[name.lower()]
        q = q.outer
    return None


def _cte_names(q: Query | None, name: str) -> list[str]:
    while q is not None:
        if name.lower() in q.cte_columns:
            return q.cte_columns[name.lower()]
        q = q.outer
    return []


def all_tables(q: Query, seen: set[int] | None = None) -> list[str]:
    """Stored tables that a query reads anywhere, in order, without CTEs; table functions as FUNCTION:name."""
    seen = seen if seen is not None else set()
    if id(q) in seen:
        return []
    seen.add(id(q))
    out: list[str] = []
    for sub in [*q.ctes.values(), *q.branches]:
        out += all_tables(sub, seen)
    for s in q.sources:
        if s.query is not None:
            out += all_tables(s.query, seen)
        elif s.function is not None:
            if s.function.upper() not in FAMILY_OF and s.function.upper() not in ("UNNEST", "TABLE", "JSON_TABLE", "OPENJSON", "STRING_SPLIT"):
                out.append(f"FUNCTION:{s.function}")
        elif s.table and find_cte(q, s.table) is None and s.table.upper() != "DUAL":
            out.append(s.table)
    for it in q.items:
        for sub in it.subqueries:
            out += all_tables(sub, seen)
    for sub in q.filters:
        out += all_tables(sub, seen)
    return list(dict.fromkeys(out))


def _scope(q: Query, qualifier: str | None, column: str) -> list[Source]:
    """Sources that a reference may mean: by alias or name, else the only one."""
    here: Query | None = q
    while here is not None:
        if qualifier:
            want = qualifier.lower()
            for s in here.sources:
                own = (s.alias or s.table or "").lower()
                if own == want or s.table and (s.table.lower() == want or s.table.lower().rsplit(".", 1)[-1] == want):
                    return [s]
        else:
            having = [s for s in here.sources if _column(column) in [c.lower() for c in output_names(_inner(here, s), here, s)]]
            if len(having) == 1:
                return having
            if len(here.sources) == 1:
                return here.sources
        here = here.outer if qualifier else None
    return []


def _inner(q: Query, s: Source) -> Query | None:
    return s.query if s.query is not None else find_cte(q, s.table) if s.table else None


def output_names(inner: Query | None, q: Query | None = None, s: Source | None = None) -> list[str]:
    if inner is None:
        return []
    if q is not None and s is not None and s.table:
        listed = _cte_names(q, s.table)
        if listed:
            return listed
    first = inner
    while first.branches:
        first = first.branches[0]
    return [it.name or f"column_{i + 1}" for i, it in enumerate(first.items)]


def _branches(q: Query) -> list[Query]:
    return [x for b in q.branches for x in _branches(b)] if q.branches else [q]


def item_sources(it: Item, q: Query) -> list[tuple[str, str, str | None]]:
    """Sources of an item, one step: table, column, CTE. Columns of derived tables are followed, those of CTEs named."""
    out: list[tuple[str, str, str | None]] = []
    refs = [*it.refs]
    if it.is_star:
        for s in q.sources:
            if it.star_of is None or (s.alias or s.table or "").lower().rsplit(".", 1)[-1] == it.star_of.lower():
                refs.append((s.alias or s.table, "*"))
    for qualifier, column in refs:
        found = _scope(q, qualifier, column)
        if not found:
            out.append((UNKNOWN if qualifier is None else qualifier, column, None))
        for s in found:
            if s.query is not None:
                for b in _branches(s.query):
                    inner = _named(b, column)
                    out += item_sources(inner, b) if inner else ([] if column != "*" else [x for i2 in b.items for x in item_sources(i2, b)])
            elif s.function is not None and s.function.upper() in _UNNESTING and s.inputs:
                # What comes out of the function is part of what went in.
                inside = Query(sources=[x for x in q.sources if x is not s], ctes=q.ctes, cte_columns=q.cte_columns, outer=q.outer)
                path = column.partition(":")[2]
                out += item_sources(Item(None, "", [(a, c + (f":{path}" if path else "")) for a, c in s.inputs], []), inside)
            elif s.function is not None:
                out.append((f"FUNCTION:{s.function}", column, None))
            elif find_cte(q, s.table) is not None:
                out.append((s.table, column, s.table))
            else:
                out.append((s.table, column, None))
    for sub in it.subqueries:
        for b in _branches(sub):
            for i2 in b.items:
                out += item_sources(i2, b)
    return list(dict.fromkeys(out))


def _named(q: Query, column: str, listed: list[str] | None = None) -> Item | None:
    names, column = [n.lower() for n in listed] if listed else [], _column(column)
    if column in names and names.index(column) < len(q.items):
        return q.items[names.index(column)]
    return next((i for i in q.items if (i.name or "").lower() == column), None) or next((i for i in q.items if i.is_star), None)


def base_sources(it: Item, q: Query, seen: frozenset[int] = frozenset()) -> list[tuple[str, str]]:
    """Sources of an item down to stored tables, through CTEs. An item that leads back to itself, in a recursive CTE, adds none."""
    out: list[tuple[str, str]] = []
    if id(it) in seen:
        return out
    seen |= {id(it)}
    for table, column, cte in item_sources(it, q):
        inner = find_cte(q, table) if cte else None
        if inner is None:
            out.append((table, column))
            continue
        for b in _branches(inner):
            if column == "*":
                out += [x for i2 in b.items for x in base_sources(i2, b, seen)]
                continue
            hit = _named(b, column, _cte_names(q, table))
            if hit is not None and hit.is_star:
                out += [(t, column if c == "*" else c) for t, c in base_sources(hit, b, seen)]
            elif hit is not None:
                out += base_sources(hit, b, seen)
    return list(dict.fromkeys(out))


# ---- statements
@dataclass
class Column:
    name: str
    ordinal: int
    transform: str
    expression: str
    is_aggregate: bool
    is_calculated: bool
    is_placeholder: bool
    sources: list[tuple[str, str, str | None]]
    resolved: list[tuple[str, str]]


@dataclass
class Statement:
    kind: str = "UNKNOWN"
    subtype: str | None = None
    target: str | None = None
    sources: list[str] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)
    ctes: list[tuple[str, list[str], list[str], str]] = field(default_factory=list)
    returning: list[str] = field(default_factory=list)
    body: list[Statement] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _columns(q: Query, names: list[str] | None = None) -> list[Column]:
    out: list[Column] = []
    heads = _branches(q)
    for i, it in enumerate(heads[0].items):
        label = names[i] if names and i < len(names) else it.name or ("*" if it.is_star else f"column_{i + 1}")
        srcs, base = [], []
        for b in heads:
            if i < len(b.items):
                srcs += item_sources(b.items[i], b)
                base += base_sources(b.items[i], b)
        kind = it.transform()
        out.append(Column(label, i, kind, it.text[:EXPRESSION], it.is_aggregate, kind not in ("direct", "literal"), not (names and i < len(names)) and it.name is None and not it.is_star, list(dict.fromkeys(srcs)), list(dict.fromkeys(base))))
    return out


def _collect_ctes(q: Query) -> list[tuple[str, list[str], list[str], str]]:
    return [(c.into or n, _cte_names(q, n) or output_names(c), all_tables(c), c.text[:SNIPPET]) for n, c in q.ctes.items()]


def parse_statement(sql: str, columns: bool = True) -> Statement:
    """Lineage of one statement. Text that is no statement gives kind UNKNOWN; nothing raises for its content.

    Without columns those of a query aren't resolved, which is most of the work where only its tables are wanted.
    """
    p = Parser(sql)
    st, end = Statement(), len(p.ts)
    if not end:
        return st
    i, outer = 0, None
    if p.up(0) == "WITH":
        outer = Query(text=sql)
        i = p.ctes(0, end, outer)
        st.ctes = _collect_ctes(outer)
    word = p.up(i)
    word = {"SEL": "SELECT", "INS": "INSERT", "UPD": "UPDATE", "DEL": "DELETE"}.get(word, word)
    if word == "SELECT" or i < end and p.ts[i].text == "(":
        q = p.query(i, end, outer)
        st.kind, st.subtype = "SELECT", q.set_op
        into = q.into or next((b.into for b in _branches(q) if b.into), None)
        if into:
            st.target, st.subtype = into, "SELECT_INTO"
        st.columns, st.sources = _columns(q) if columns else [], _plus_ctes(all_tables(q), outer, q)
        st.ctes = st.ctes or _collect_ctes(q)
        if outer is None and not st.ctes:
            st.ctes = _collect_ctes(q)
    elif word == "INSERT":
        _insert(p, i, end, outer, st)
    elif word == "UPDATE":
        _update(p, i, end, outer, st)
    elif word == "DELETE":
        st.kind = "DELETE"
        j = i + 2 if p.up(i + 1) == "FROM" else i + 1
        st.target, j = p.name(j, end)
        alias, j = p.alias(j, end)
        q = Query(outer=outer)
        at = p.find(j, end, {"USING", "FROM"})
        if at < end:
            stop = p.find(at + 1, end, {"WHERE", "RETURNING"})
            p.sources(at + 1, stop, q)
            real = next((s.table for s in q.sources if s.alias and st.target and s.alias.lower() == st.target.lower()), None)
            st.target = real or st.target
        q.filters += p.subqueries(j, end, q)
        st.sources = [t for t in _plus_ctes(all_tables(q), outer, q) if t != st.target]
    elif word == "MERGE":
        _merge(p, i, end, outer, st)
    elif word in ("CREATE", "REPLACE", "ALTER", "DROP", "TRUNCATE", "CALL", "EXEC", "EXECUTE", "COPY"):
        _create(p, i, end, outer, st, word)
    elif word in ("BEGIN", "DECLARE", "DO", "IF"):
        st.kind, st.subtype = "COMMAND", "PLSQL_BLOCK" if word in ("BEGIN", "DECLARE") else f"{word}_BLOCK"
        _body(p, st, False)
    at = p.find(0, end, {"RETURNING"})
    if at < end and st.kind in ("INSERT", "UPDATE", "DELETE", "MERGE"):
        stop = p.find(at + 1, end, {"INTO", ";"})
        st.returning = [p.text(a, b) for a, b in p.commas(at + 1, stop) if a < b]
        if st.subtype is None:
            st.subtype = "WITH_RETURNING"
    return st


def _plus_ctes(tables: list[str], outer: Query | None, q: Query) -> list[str]:
    used = [t for c in (outer.ctes.values() if outer else []) for t in all_tables(c)]
    return list(dict.fromkeys([*used, *tables]))


def _insert(p: Parser, i: int, end: int, outer: Query | None, st: Statement) -> None:
    st.kind = "INSERT"
    if p.up(i + 1) == "ALL" or p.up(i + 1) == "FIRST":
        _insert_all(p, i, end, outer, st)
        return
    j = i + 1
    while p.up(j) in ("INTO", "OVERWRITE", "TABLE"):
        j += 1
    st.target, j = p.name(j, end)
    names: list[str] = []
    if j < end and p.ts[j].text == "(" and p.up(j + 1) not in ("SELECT", "WITH", "SEL"):
        k = p.match(j, end)
        names = [unquote(p.ts[b - 1].text) for a, b in p.commas(j + 1, k - 1) if a < b]
        j = k
    at = p.find(j, end, {"SELECT", "SEL", "WITH", "VALUES", "EXEC", "EXECUTE"})
    if at == end and j < end and p.ts[j].text == "(":
        at = j
    word = p.up(at)
    conflict = p.find(j, end, {"CONFLICT"})
    stop = conflict - 1 if conflict < end else p.find(at + 1, end, {"RETURNING"}) if at < end else end
    if word == "VALUES":
        st.subtype = "INSERT_VALUES"
        st.columns = [Column(n, k, "literal", "", False, False, False, [], []) for k, n in enumerate(names)]
        q = Query(outer=outer)
        st.sources = [t for x in p.subqueries(at, end, q) for t in all_tables(x)]
    elif at < end and word not in ("EXEC", "EXECUTE"):
        q = p.query(at, stop, outer)
        st.subtype = "INSERT_SELECT"
        st.columns, st.sources = _columns(q, names), _plus_ctes(all_tables(q), outer, q)
        st.ctes = st.ctes or _collect_ctes(q)
    if conflict < end:
        st.subtype = "UPSERT"


def _insert_all(p: Parser, i: int, end: int, outer: Query | None, st: Statement) -> None:
    """INSERT ALL and INSERT FIRST: the first target is the statement's own, the others are statements in its body."""
    at = p.find(i, end, {"SELECT", "WITH"})
    q = p.query(at, end, outer)
    rows, tables = Query(outer=outer, sources=[Source(None, query=q)]), all_tables(q)
    parts: list[Statement] = []
    j = p.find(i, at, {"INTO"})
    while j < at:
        part = Statement("INSERT", "INSERT_ALL", sources=list(tables))
        part.target, k = p.name(j + 1, at)
        nxt = p.find(k, at, {"INTO"})
        names: list[str] = []
        if k < nxt and p.ts[k].text == "(":
            m = p.match(k, nxt)
            names = [unquote(p.ts[b - 1].text) for a, b in p.commas(k + 1, m - 1) if a < b]
            k = m
        v = p.find(k, nxt, {"VALUES"})
        if v + 1 < nxt:
            for n, (a, b) in enumerate(p.commas(v + 2, p.match(v + 1, nxt) - 1)):
                it = p.expression(a, b, rows)
                kind = it.transform()
                part.columns.append(Column(names[n] if n < len(names) else f"column_{n + 1}", n, kind, it.text[:EXPRESSION], it.is_aggregate, kind not in ("direct", "literal"), n >= len(names), item_sources(it, rows), base_sources(it, rows)))
        else:
            part.columns = _columns(q, names)
        parts.append(part)
        j = nxt
    if parts:
        st.target, st.columns, st.body = parts[0].target, parts[0].columns, parts[1:]
    st.subtype, st.sources = "INSERT_ALL", tables


def _assignments(p: Parser, i: int, end: int, q: Query, st: Statement, kind: str | None, target_alias: set[str]) -> None:
    for a, b in p.commas(i, end):
        eq = p.find(a, b, {"="})
        if eq >= b:
            continue
        left, _ = p.name(a, eq)
        if left is None:
            continue
        it = p.expression(eq + 1, b, q)
        srcs = item_sources(it, q)
        tr = kind or it.transform()
        st.columns.append(Column(left.rsplit(".", 1)[-1], len(st.columns), tr, it.text[:EXPRESSION], it.is_aggregate, tr not in ("direct", "literal"), False, srcs, base_sources(it, q)))
        for sub in it.subqueries:
            st.sources += all_tables(sub)


def _update(p: Parser, i: int, end: int, outer: Query | None, st: Statement) -> None:
    st.kind = "UPDATE"
    target, j = p.name(i + 1, end)
    alias, j = p.alias(j, end)
    q = Query(outer=outer)
    set_at = p.find(j, end, {"SET"})
    if p.up(j) == "FROM":  # UPDATE t FROM s SET
        p.sources(j + 1, set_at, q)
    stop = p.find(set_at + 1, end, {"FROM", "WHERE", "RETURNING", "OUTPUT", "OPTION"})
    at = p.find(stop, end, {"FROM"})
    if at < end:
        p.sources(at + 1, p.find(at + 1, end, {"WHERE", "RETURNING", "OPTION"}), q)
    real = next((s.table for s in q.sources if s.alias and target and s.alias.lower() == target.lower()), None)
    st.target = real or target
    if not any(s.table == st.target for s in q.sources):
        q.sources.append(Source(alias or target, table=st.target))
    _assignments(p, set_at + 1, stop, q, st, None, set())
    q.filters += p.subqueries(stop, end, q)
    st.sources = [t for t in dict.fromkeys([*_plus_ctes(all_tables(q), outer, q), *st.sources]) if t != st.target]


def _merge(p: Parser, i: int, end: int, outer: Query | None, st: Statement) -> None:
    st.kind = st.subtype = "MERGE"
    j = i + 2 if p.up(i + 1) == "INTO" else i + 1
    st.target, j = p.name(j, end)
    alias, j = p.alias(j, end)
    q = Query(outer=outer)
    using = p.find(j, end, {"USING"})
    on = p.find(using + 1, end, {"ON"})
    p.sources(using + 1, on, q)
    st.sources = [t for t in _plus_ctes(all_tables(q), outer, q) if t != st.target]
    q.sources.append(Source(alias or st.target, table=st.target))
    at = on
    while True:
        at = p.find(at + 1, end, {"UPDATE", "INSERT"})
        if at >= end:
            return
        stop = p.find(at + 1, end, {"WHEN", "WHERE", "OUTPUT", "DELETE"})
        if p.up(at) == "UPDATE":
            _assignments(p, p.find(at, stop, {"SET"}) + 1, stop, q, st, "merge_update", set())
        else:
            k = at + 1
            names: list[str] = []
            if k < stop and p.ts[k].text == "(":
                m = p.match(k, stop)
                names = [unquote(p.ts[b - 1].text) for a, b in p.commas(k + 1, m - 1) if a < b]
                k = m
            v = p.find(k, stop, {"VALUES"})
            if v + 1 < stop:
                m = p.match(v + 1, stop)
                for n, (a, b) in enumerate(p.commas(v + 2, m - 1)):
                    it = p.expression(a, b, q)
                    label = names[n] if n < len(names) else f"column_{n + 1}"
                    st.columns.append(Column(label, len(st.columns), "merge_insert", it.text[:EXPRESSION], False, not it.is_direct, False, item_sources(it, q), base_sources(it, q)))
        at = stop - 1 if stop < end else end


_WITH_BODY = ("PROCEDURE", "PROC", "FUNCTION", "TRIGGER", "PACKAGE", "MACRO", "TASK")
_DOLLAR = re.compile(r"\$\w*\$")


def body_statements(sql: str, header: bool = True) -> list[str]:
    """The statements in a routine's text, in blocks, brackets or dollar quotes or not."""
    sql = _DOLLAR.sub(" ", sql)
    ts = tokens(sql)
    return [sql[ts[a].start : ts[b - 1].end] for a, b in routine_statements(ts, header)]


#: Words that run a statement given as a string, and how such a string starts.
_RUNS = {"EXEC", "EXECUTE", "IMMEDIATE", "SP_EXECUTESQL", "SYSEXECSQL", "PREPARE"}
_STATEMENT = re.compile(r"(?is)\s*(?:SELECT|SEL|INSERT|UPDATE|DELETE|MERGE|WITH|CREATE|REPLACE|TRUNCATE|BEGIN|DECLARE)\b.")
#: Statements as strings within routines in JavaScript and Python.
_EMBEDDED = re.compile(r"(?s)(?:\bsqlText\s*:|\.sql\(|\.execute\()\s*(\"{3}|'{3}|[\"'`])(.+?)\1")


def dynamic_strings(ts: Sequence[Token]) -> list[int]:
    """Places of strings that are run as statements: given to EXEC, IMMEDIATE and the like, or to a variable where there are such words."""
    if not any(t.kind == "word" and t.upper in _RUNS for t in ts):
        return []
    found = []
    for i, t in enumerate(ts):
        if t.kind != "string" or not _STATEMENT.match(constant(t.text)):
            continue
        k = i - 1
        while k > 0 and ts[k].text == "(":
            k -= 1
        before = ts[k].upper if k >= 0 else ""
        name, set_at = (ts[k - 1].text, ts[k - 2].upper if k > 1 else "") if k > 0 else ("", "")
        is_variable = before == ":=" or before == "=" and (name.startswith("@") or set_at == "SET" and (k < 3 or ts[k - 3].text == ";" or ts[k - 3].upper in ("BEGIN", "THEN", "ELSE", "DO")))
        typed = before == "=" and any(x.kind == "word" and x.text.startswith("@") for x in ts[max(0, k - 6) : k]) and any(x.upper == "DECLARE" for x in ts[max(0, k - 8) : k])
        if before in _RUNS or is_variable or typed:
            found.append(i)
    return found


def constant(text: str) -> str:
    """What a string literal holds."""
    return text.lstrip("NnEe").strip("'").replace("''", "'")


def dynamic_statements(sql: str) -> list[str]:
    """Statements that stand as constant strings in a text that runs such strings; of one put together, the constant beginning."""
    text = _DOLLAR.sub(" ", sql)
    ts = tokens(text)
    return [constant(ts[i].text) for i in dynamic_strings(ts)] + [m.group(2) for m in _EMBEDDED.finditer(text) if _STATEMENT.match(m.group(2))]


def _is_variable(name: str, statement: str, routine: str) -> bool:
    """Whether SELECT INTO fills a variable: one of several, or one that is declared with a type or assigned."""
    if "." in name or name.startswith("#"):
        return False
    one = re.escape(name)
    declared = rf"(?i)(?<!\bFROM)(?<!\bJOIN)(?<!\bINTO)(?<!\bUPDATE)\s{one}(?:\s*:=|\s+(?:IN\s+|OUT\s+|CONSTANT\s+)*[\w.]+(?:%\w+)?(?:\s*\([\d, ]*\))?\s*(?:;|:=|,|\)|DEFAULT\b))"
    return bool(re.search(rf"(?i)\bINTO\s+{one}\s*,", statement) or re.search(declared, routine))


def _body(p: Parser, st: Statement, header: bool = True) -> None:
    """The statements of a routine's body, each with its own target; their tables count as read by the routine too."""
    for text in [*body_statements(p.sql, header), *dynamic_statements(p.sql)]:
        try:
            inner = parse_statement(text)
        except Exception as e:  # the other statements still count
            st.errors.append(f"{type(e).__name__}: {e}"[:200])
            continue
        if inner.subtype == "SELECT_INTO" and _is_variable(inner.target, text, p.sql):
            inner.target, inner.subtype = None, None
        own = [inner] if inner.kind != "COMMAND" or inner.subtype == "TRUNCATE" else []
        nested = [] if inner.kind == "COMMAND" and inner.subtype in ("EXEC", "EXECUTE", "CALL", "DYNAMIC") else inner.body  # those come by themselves
        for x in [*own, *nested]:
            st.body.append(x)
            st.sources += [t for t in x.sources if t not in st.sources]
            x.body = []


#: Names under which a trigger sees the rows of its table.
_TRIGGER_ROWS = {"inserted", "deleted", "new", "old", ":new", ":old"}


def _of_table(st: Statement, table: str) -> None:
    """Puts the trigger's table where its rows are read under other names."""
    real = lambda t: table if t.lower() in _TRIGGER_ROWS else t
    st.sources = list(dict.fromkeys(map(real, st.sources)))
    for c in st.columns:
        c.sources = list(dict.fromkeys((real(t), x, cte) for t, x, cte in c.sources))
        c.resolved = list(dict.fromkeys((real(t), x) for t, x in c.resolved))
        if table not in st.sources and any(t == table for t, _, _ in c.sources):
            st.sources.append(table)


def _copy(p: Parser, i: int, end: int, st: Statement) -> None:
    """COPY INTO a table from a stage, or the other way round."""
    st.subtype = "COPY_INTO" if p.up(i + 1) == "INTO" else "COPY"
    at = p.find(i, end, {"FROM"})
    if at + 1 < end:
        if p.ts[at + 1].text == "(":
            q = p.query(at + 1, p.match(at + 1, end))
            st.sources, st.columns = all_tables(q), _columns(q)
        else:
            name, _ = p.name(at + 1, end)
            st.sources = [name] if name else []


_CREATABLE = ("TABLE", "VIEW", "PROCEDURE", "PROC", "FUNCTION", "TRIGGER", "PACKAGE", "MACRO", "INDEX", "SCHEMA", "DATABASE", "SEQUENCE", "TASK", "STREAM", "PIPE", "STAGE", "TYPE", "SYNONYM")


def _create(p: Parser, i: int, end: int, outer: Query | None, st: Statement, word: str) -> None:
    st.kind = {"REPLACE": "CREATE", "EXEC": "COMMAND", "EXECUTE": "COMMAND", "CALL": "COMMAND", "COPY": "COMMAND", "TRUNCATE": "COMMAND"}.get(word, word)
    if st.kind == "COMMAND":
        st.target, _ = p.name(i + 2 if p.up(i + 1) in ("TABLE", "INTO") else i + 1, end)
        st.subtype = word
        if word in ("EXEC", "EXECUTE", "CALL"):
            for text in dynamic_statements(p.sql):
                inner = parse_statement(text)
                st.body += [inner, *inner.body]
                inner.body = []
                st.sources += [t for t in inner.sources if t not in st.sources]
            if st.target is not None and st.target.upper() in ("IMMEDIATE", "SP_EXECUTESQL", "DBC.SYSEXECSQL", "SYSEXECSQL"):
                st.target, st.subtype = None, "DYNAMIC"
        if word == "COPY":
            _copy(p, i, end, st)
        return
    at = p.find(i + 1, min(end, i + 12), set(_CREATABLE))
    what = "PROCEDURE" if p.up(at) == "PROC" else p.up(at)
    before = {p.up(k) for k in range(i, at)}
    j = at + 1
    while p.up(j) in ("IF", "NOT", "EXISTS", "BODY"):
        j += 1
    st.target, j = p.name(j, end)
    st.subtype = f"{st.kind}_{'MATERIALIZED_' if 'MATERIALIZED' in before and what == 'VIEW' else ''}{what or 'OTHER'}"
    if what == "TABLE" and before & {"TEMPORARY", "TEMP"} and "GLOBAL" in before:
        st.subtype = "CREATE_GLOBAL_TEMP_TABLE"
    if what in _WITH_BODY:
        _body(p, st)
        if what == "TRIGGER":
            table, _ = p.name(p.find(j, end, {"ON"}) + 1, end)
            for x in [*st.body, st] if table else []:
                _of_table(x, table)
                st.sources += [t for t in x.sources if t not in st.sources]
        return
    if what not in ("TABLE", "VIEW") or st.kind != "CREATE":
        return
    names: list[str] = []
    if j < end and p.ts[j].text == "(" and p.up(j + 1) not in ("SELECT", "WITH", "SEL"):
        k = p.match(j, end)
        for a, b in p.commas(j + 1, k - 1):
            if a < b and p.is_name(a) and p.up(a) not in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "INDEX", "KEY", "LIKE"):
                names.append(unquote(p.ts[a].text))
                if what == "TABLE":
                    st.columns.append(Column(names[-1], len(st.columns), "definition", p.text(a + 1, b)[:EXPRESSION], False, False, False, [], []))
        j = k
    q_at = p.find(j, end, {"SELECT", "SEL", "WITH"})
    as_at = p.find(j, end, {"AS"})
    if as_at < end and as_at + 1 < end and p.ts[as_at + 1].text == "(" and p._leads_to_query(as_at + 1, end):
        q_at = as_at + 1
    if q_at < end and as_at < end and as_at < q_at:
        stop = p.match(q_at, end) if p.ts[q_at].text == "(" else end
        q = p.query(q_at, stop, outer)
        st.columns, st.sources, st.ctes = _columns(q, names), all_tables(q), _collect_ctes(q)
        if what == "TABLE":
            st.subtype = "CTAS"
