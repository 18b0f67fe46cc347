"""What routines take, return, read, write and call, from the tokens of their definitions and the lineage of their statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.operators import lexer, parser

#: Prefixes of the systems' own routines, which count as no calls.
SYSTEM_CALLS = re.compile(r"(?i)^(?:sp_|xp_|fn_|sys\.|dbms_|utl_)")

#: Functions with a FROM of their own.
_FROM_CALLS = {"EXTRACT", "TRIM", "SUBSTRING", "OVERLAY"}
#: Words that end the condition of a join.
_BEHIND_ON = (parser._CLAUSES | parser._JOINS | parser._SET_OPS | {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH", "CREATE", "ALTER", "DROP", "TRUNCATE", "EXEC", "EXECUTE", "CALL", "PERFORM", "DECLARE", "IF", "BEGIN", "END", "THEN", "ELSE", "LOOP", "WHILE", "RETURN", "PRINT"}) - {"ON"}
_NO_TABLES = {"select", "values", "set", "where", "table", "only", "lateral", "unnest", "dual", "as", "on", "of", "or"}
#: Words that end the header of a routine, and those that end what it returns.
_BODY_STARTS = {"AS", "IS", "BEGIN", "DECLARE"}
_RETURN_ENDS = _BODY_STARTS | {"LANGUAGE", "WITH", "RETURN", "IMMUTABLE", "STABLE", "VOLATILE", "STRICT", "DETERMINISTIC", "PIPELINED", "SECURITY", "SQL", "EXECUTE", "CALLED", "NOT", "RUNTIME_VERSION", "COMMENT"}
_HEADER_ENDS = _RETURN_ENDS | {"RETURNS", "FOR"}
_MODES = {"IN", "OUT", "INOUT", "OUTPUT", "VARIADIC", "READONLY"}


class _Tables:
    """Tables in FROM, JOIN and USING of a routine's text: their names in lower case, and the aliases by position."""

    def __init__(self, body: str):
        self.p = p = parser.Parser(re.sub(r"\$\w*\$", " ", body))  # a body in dollar quotes is SQL
        self.reads: list[str] = []
        self.aliases: list[tuple[int, str, str]] = []
        self.taken: set[int] = set()
        own_from: list[bool] = []
        dynamic = set(parser.dynamic_strings(p.ts))
        for i, t in enumerate(p.ts):
            before = p.up(i - 1)
            if t.text == "(":
                own_from.append(before in _FROM_CALLS)
            elif t.text == ")" and own_from:
                own_from.pop()
            elif i in dynamic:
                self.reads += _Tables(parser.constant(t.text)).reads
            if t.kind != "word" or before == ".":
                continue
            w = t.upper
            if w in ("FROM", "JOIN", "USING") and not (w == "FROM" and (own_from[-1:] == [True] or before == "DISTINCT" or before in ("DELETE", "DEL"))):
                self._list(i + 1, len(p.ts), w != "USING")
            elif w in ("FROM", "INTO", "UPDATE", "TABLE", "CALL", "EXEC", "EXECUTE", "PERFORM"):
                self._one(i + 2 if p.up(i + 1) == "ONLY" else i + 1)

    def _one(self, i: int) -> tuple[str | None, int]:
        """The table at i with its alias, and the index behind both."""
        name, j = self.p.name(i, len(self.p.ts))
        if name is None:
            return None, i
        self.taken.update(range(i, j))
        table, end = name.lower(), len(self.p.ts)
        if self.p.ts[j : j + 1] and self.p.ts[j].text == "(" and self.p.ts[i - 1].upper in ("FROM", "JOIN", ","):  # a table function
            j = self.p.match(j, end)
        if self.p.up(j) != "WITH":
            alias, j = self.p.alias(j, end)
            self.aliases.append((i, (alias or table.rsplit(".", 1)[-1]).lower(), table))
        if self.p.up(j) == "WITH" and self.p.up(j + 1) == "(":  # hints
            j = self.p.match(j + 1, end)
        return table, j

    def _list(self, i: int, end: int, brackets: bool) -> None:
        """The tables from i on that commas separate, also behind derived tables and the conditions of joins."""
        p = self.p
        while i < end:
            while p.up(i) in ("ONLY", "LATERAL"):
                i += 1
            if i < end and p.ts[i].text == "(":
                k = p.match(i, end)
                if brackets and p.is_name(i + 1) and p.up(i + 1) not in ("SELECT", "WITH", "SEL", "VALUES"):
                    self._list(i + 1, k - 1, True)
                _, i = p.alias(k, end)
            else:
                table, i = self._one(i)
                if table is None:
                    return
                if table not in _NO_TABLES:
                    self.reads.append(table)
            if p.up(i) == "ON":
                i = self._behind_condition(i + 1, end)
            if i >= end or p.ts[i].text != ",":
                return
            i += 1

    def _behind_condition(self, i: int, end: int) -> int:
        cases = 0
        while i < end:
            t, w = self.p.ts[i], self.p.up(i)
            if t.text == "(":
                i = self.p.match(i, end)
                continue
            if w == "CASE":
                cases += 1
            elif w == "END" and cases:
                cases -= 1
            elif not cases and (t.text in (")", ",", ";") or w in _BEHIND_ON and t.kind == "word" and not (w in ("LEFT", "RIGHT") and self.p.up(i + 1) == "(")):
                return i
            i += 1
        return i


    def column_refs(self) -> list[str]:
        """References to columns as table.column, once for each time: names with a qualifier, and the columns an INSERT lists.

        A qualifier is resolved by the aliases of its own statement. DELETE statements, variables, tables and functions give none.
        """
        p, out = self.p, []
        for first, end in lexer.routine_statements(p.ts):
            if p.up(first) in ("DELETE", "DEL", "CALL", "EXEC", "EXECUTE", "PERFORM", "CREATE", "ALTER", "DROP", "TRUNCATE"):
                continue
            names = {alias: table for i, alias, table in self.aliases if first <= i < end}
            i, target = first, None
            while i < end:
                if p.up(i) == "INTO" and p.up(i - 1) in ("INSERT", "INS"):
                    target, j = p.name(i + 1, end)
                    if target and j < end and p.ts[j].text == "(" and p.up(j + 1) not in ("SELECT", "WITH", "SEL", "VALUES"):
                        k = p.match(j, end)
                        out += [f"{target}.{parser.unquote(p.ts[b - 1].text)}".lower() for a, b in p.commas(j + 1, k - 1) if a < b]
                        i = k
                        continue
                if not p.is_name(i):
                    i += 1
                    continue
                name, j = p.name(i, end)
                if "." in name and i not in self.taken and not name.startswith("@") and not (j < end and p.ts[j].text == "("):
                    qualifier, _, column = name.lower().rpartition(".")
                    out.append(f"{names.get(qualifier, qualifier)}.{column}")
                i = max(j, i + 1)
        return out


def _split(p: parser.Parser, i: int, end: int) -> list[tuple[int, int]]:
    return [(a, b) for a, b in p.commas(i, end) if a < b]


def _type(p: parser.Parser, i: int, end: int) -> tuple[str, int]:
    """A data type at i, with its length or as table.column%TYPE, and the index behind it."""
    name, j = p.name(i, end)
    while name and j < end and p.ts[j].text == "%" and p.is_name(j + 1):
        name, j = f"{name}%{p.ts[j + 1].text}", j + 2
    if j < end and p.ts[j].text == "(":
        k = p.match(j, end)
        name, j = f"{name}{p.text(j, k)}", k
    return name or "", j


def _header(p: parser.Parser) -> tuple[str, int, int]:
    """Kind of a routine, the index behind its name and that of its body."""
    end = len(p.ts)
    at = p.find(0, min(end, 12), set(parser._WITH_BODY))
    _, i = p.name(at + 1, end)
    body = p.find(i, end, _BODY_STARTS)
    while body < end and p.up(body) == "AS" and p.up(body - 1) in ("EXECUTE", "EXEC"):
        body = p.find(body + 1, end, _BODY_STARTS)
    dollar = next((k for k in range(i, min(body, end)) if p.ts[k].kind == "string" and p.ts[k].text.startswith("$")), body)
    return ("PROCEDURE" if p.up(at) == "PROC" else p.up(at)), i, min(body, dollar)


def signature(sql: str) -> dict:
    """Kind, parameters, return type, output columns and body of a routine's definition.

    Parameters: ordinal, name, data_type, is_output, default_value. Output columns are those a table function declares, else
    those of the query it returns.
    """
    p = parser.Parser(sql)
    kind, i, body = _header(p)
    out = {"kind": kind, "params": [], "return_type": None, "is_table_valued": False, "output_columns": [], "body": sql[p.ts[body].end :].strip() if body < len(p.ts) and p.ts[body].kind == "word" else p.text(body, len(p.ts))}
    stop = min(p.find(i, body, _HEADER_ENDS), body)
    first, last = (i + 1, p.match(i, stop) - 1) if i < stop and p.ts[i].text == "(" else (i, stop)
    for a, b in _split(p, first, last) if kind != "TRIGGER" else []:
        words = {p.up(k) for k in range(a, b)}
        while a < b and p.up(a) in _MODES:
            a += 1
        if not p.is_name(a):
            continue
        j = a + 1
        while j < b and p.up(j) in _MODES | {"AS"}:
            j += 1
        kind_, j = _type(p, j, b)
        eq = p.find(j, b, {"=", "DEFAULT", ":="})
        stop_ = p.find(eq, b, {"OUT", "OUTPUT", "READONLY"})
        out["params"].append({"ordinal": len(out["params"]), "name": p.ts[a].text, "data_type": kind_, "is_output": bool(words & {"OUT", "OUTPUT", "INOUT"}), "default_value": p.text(eq + 1, stop_) or None if eq < b else None})
    at = p.find(stop, body, {"RETURNS", "RETURN"})
    if at < body:
        end = p.find(at + 1, body, _RETURN_ENDS)
        out["return_type"] = p.text(at + 1, end) or None
        table = p.find(at + 1, end, {"TABLE", "SETOF"})
        out["is_table_valued"] = table < end
        if table + 1 < end and p.ts[table + 1].text == "(":
            for a, b in _split(p, table + 2, p.match(table + 1, end) - 1):
                if p.up(a) not in ("PRIMARY", "UNIQUE", "CONSTRAINT", "CHECK"):
                    out["output_columns"].append({"name": parser.unquote(p.ts[a].text), "data_type": _type(p, a + 1, b)[0]})
    return out


def _calls(p: parser.Parser) -> list[str]:
    """Names behind EXEC, CALL and PERFORM but for the system's own routines, variables and strings."""
    found = []
    for i, t in enumerate(p.ts):
        if t.upper in ("EXEC", "EXECUTE", "CALL", "PERFORM") and t.kind == "word":
            j = i + 1
            while p.up(j) in ("PROCEDURE", "FUNCTION") or p.is_name(j) and p.ts[j].text.startswith("@") and j + 1 < len(p.ts) and p.ts[j + 1].text == "=":
                j += 2 if p.ts[j].text.startswith("@") else 1
            name, _ = p.name(j, len(p.ts))
            if name and not name.startswith(("@", ":")) and p.up(j) not in ("IMMEDIATE", "AS", "ON") and not SYSTEM_CALLS.match(name):
                found.append(name.lower())
    return sorted(set(found))


def _temps(text: str) -> list[str]:
    return sorted({m.group(1).lower() for d in rules.DIALECTS for m in re.finditer(rules.TEMP_OBJECT[d], text)})


def scan(sql: str) -> dict:
    """All facts of a routine's definition; every table and column in lower case.

    writes are targets of INSERT, UPDATE, DELETE, MERGE and TRUNCATE, creates those of CREATE TABLE and SELECT INTO. Columns read
    are the sources of what is written or returned; an updated column counts as read and written. Tables read are those in
    FROM, JOIN and USING, without CTEs; a table that is only deleted from isn't read.
    """
    sql = lexer.without_comments(sql)
    text = re.sub(r"\$\w*\$", " ", sql)
    st, tables, own = parser.parse_statement(sql), _Tables(text), signature(sql)
    low = lambda xs: sorted({x.lower() for x in xs if x})
    col = lambda t, c: f"{t}.{c}".lower()
    writes = {"INSERT", "UPDATE", "DELETE", "MERGE"}
    targets = [b for b in st.body if b.kind in writes or b.subtype == "TRUNCATE"]
    made = low(b.target for b in st.body if b.subtype in ("SELECT_INTO", "CTAS") or (b.subtype or "").startswith("CREATE_"))
    changed = [(b, c) for b in st.body if b.kind in writes and b.target for c in b.columns]
    is_update = lambda b, c: b.kind == "UPDATE" or c.transform == "merge_update"
    read = [col(t, x) for b in st.body for c in b.columns for t, x in c.resolved if t != parser.UNKNOWN]
    updated = low(col(b.target, c.name) for b, c in changed if is_update(b, c))
    written = low(col(b.target, c.name) for b, c in changed if not is_update(b, c))
    outputs = own.pop("output_columns")
    if not outputs and own["is_table_valued"]:
        outputs = [{"name": c.name, "data_type": None} for b in st.body if b.kind == "SELECT" and b.target is None for c in b.columns]
    ctes = {n.lower() for b in st.body for n, *_ in b.ctes}
    reads = set(tables.reads) - ctes
    if own["kind"] == "TRIGGER":  # its table's rows have other names there
        reads = reads - parser._TRIGGER_ROWS | {t.lower() for t in st.sources}
    kinds = [c.transform for b in st.body for c in b.columns]
    ws = tables.p
    ends = [k for k, t in enumerate(ws.ts) if t.text == ";" and t.kind == "op"]
    spans = zip([-1, *ends], [*ends, len(ws.ts)])
    own.pop("body")
    return own | {
        "output_columns": outputs,
        "reads": sorted(reads), "writes": low(b.target for b in targets), "creates": made, "temps": _temps(text), "calls": _calls(ws), "column_refs": tables.column_refs(),
        "columns_read": low([*read, *updated]), "columns_written": low([*written, *updated]), "columns_updated": updated,
        "n_statements": sum(len(ws.text(a + 1, b)) > 5 for a, b in spans), "n_joins": sum(t.upper == "JOIN" and t.kind == "word" for t in ws.ts), "n_subqueries": sum(t.text == "(" and ws.up(k + 1) == "SELECT" and ws.up(k - 1) not in ("AS", "RETURN") for k, t in enumerate(ws.ts)),
        "n_ctes": len(ctes), "n_aggregates": kinds.count("aggregate"), "n_windows": kinds.count("window_function"), "n_calculations": sum(k not in ("direct", "literal", "definition", "aggregate", "window_function") for k in kinds),
        "error": "; ".join(st.errors)[:200] or None,
    }


_LISTS = ("reads", "writes", "creates", "temps", "calls", "column_refs", "columns_read", "columns_written", "columns_updated")
_COUNTS = ("n_statements", "n_joins", "n_subqueries", "n_ctes", "n_aggregates", "n_windows", "n_calculations")
SCAN = "struct<kind: string, params: array<struct<ordinal: int, name: string, data_type: string, is_output: boolean, default_value: string>>, return_type: string, is_table_valued: boolean, output_columns: array<struct<name: string, data_type: string>>, " + "".join(f"{c}: array<string>, " for c in _LISTS) + "".join(f"{c}: int, " for c in _COUNTS) + "error: string>"
_FIELDS = ("kind", "params", "return_type", "is_table_valued", "output_columns", *_LISTS, *_COUNTS, "error")
_NOTHING = {"kind": "", "params": [], "return_type": None, "is_table_valued": False, "output_columns": [], "error": None} | {c: [] for c in _LISTS} | dict.fromkeys(_COUNTS, 0)


def _safe_scan(sql: str | None) -> dict:
    try:
        return scan(sql) if sql else _NOTHING
    except Exception as e:  # one bad definition must not fail a job
        return _NOTHING | {"error": f"{type(e).__name__}: {e}"[:200]}


def scanned(definition: Column) -> Column:
    """The facts of ``scan`` as a struct; empty ones for null. A definition that can't be read has its error."""

    @F.pandas_udf(SCAN)
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_safe_scan(b) for b in batch], columns=list(_FIELDS))

    return facts(definition)


def signatures(definition: Column) -> Column:
    """Parameters of a routine as an array of structs: ordinal, name, data_type, is_output, default_value."""

    @F.pandas_udf("array<struct<ordinal: int, name: string, data_type: string, is_output: boolean, default_value: string>>")
    def params(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: [] if b is None else signature(lexer.without_comments(b))["params"])

    return params(definition)


def routine_facts(routines: DataFrame) -> DataFrame:
    """Facts per routine. routines: name, definition. Result: name, the fields of ``scan`` and the complexity.

    Null definitions have empty facts.
    """
    rows = routines.select("name", F.explode(F.array("definition")).alias("d")).select("name", scanned(F.col("d")).alias("scan")).select("name", "scan.*")
    rows = rows.withColumn("n_parameters", F.size("params")).withColumn("n_outputs", F.size(F.filter("params", lambda p: p["is_output"])))
    score = complexity(F.col("n_statements"), F.col("n_parameters"), F.size("reads"), F.size("writes"), F.size("column_refs"), F.size("temps"), F.size("calls"), F.col("n_outputs"))
    return rows.withColumn("complexity", score)


def complexity(statements: Column, params: Column, reads: Column, writes: Column, column_refs: Column, temps: Column, calls: Column, outputs: Column) -> Column:
    """Complexity of a routine; above 15 it counts as complex. The weights and the bound of statements."""
    return F.round(F.least(statements * 0.5, F.lit(10.0)) + params * 0.3 + reads * 0.2 + writes * 0.5 + column_refs * 0.1 + temps * 0.4 + calls * 0.6 + outputs * 0.4, 2)


def access_matrix(facts: DataFrame) -> DataFrame:
    """Per table, the routines that read and that write it."""
    r = facts.select("name", F.explode("reads").alias("table_name"), F.lit("R").alias("a"))
    w = facts.select("name", F.explode("writes").alias("table_name"), F.lit("W").alias("a"))
    pick = lambda a: F.array_sort(F.collect_set(F.when(F.col("a") == a, F.col("name"))))
    return r.unionByName(w).groupBy("table_name").agg(pick("R").alias("read_by"), pick("W").alias("written_by"))


def call_edges(facts: DataFrame) -> DataFrame:
    """src calls dst."""
    return facts.select(F.lower("name").alias("src"), F.explode("calls").alias("dst"))
