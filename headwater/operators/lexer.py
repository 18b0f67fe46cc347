"""Tokens of SQL in five dialects, and what needs no more than tokens: removing comments and splitting statements."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, name (quoted), string, number, op, comment
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


_TOKEN = re.compile(
    r"""(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<dollar>\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z))
      |(?P<string>[NnEe]?'(?:[^']|'')*(?:'|\Z))
      |(?P<name>"(?:[^"]|"")*"|\[[^\]\n]*\]|`[^`]*`)
      |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      |(?P<word>[^\W\d][\w$\#]*|(?:@{1,2}|\#{1,2}|:)[^\W\d][\w$\#]*)
      |(?P<op>::|->>|->|<=|>=|<>|!=|\|\||=>|:=|[^\s])""",
    re.S | re.X,
)


#: Tokens of the last few texts, for the steps of an analysis read the same text.
_RECENT: dict[tuple[str, bool], tuple[Token, ...]] = {}


def tokens(sql: str, comments: bool = False) -> tuple[Token, ...]:
    """Tokens of a text. A [ after a word, number or closing bracket is a subscript and no quote."""
    recent = _RECENT.get((sql, comments))
    if recent is not None:
        return recent
    out: list[Token] = []
    at, search, add = 0, _TOKEN.search, out.append
    while m := search(sql, at):
        kind, text, end = m.lastgroup, m.group(), m.end()
        if kind == "name" and text[0] == "[" and out and out[-1].end == m.start() and out[-1].text not in (".", "(", ","):
            kind, text, end = "op", "[", m.start() + 1
        elif kind == "tag" or kind == "dollar":
            kind = "string"
        if kind != "comment" or comments:
            add(Token(kind, text, m.start(), end))
        at = end
    if len(_RECENT) >= 4:
        _RECENT.clear()
    _RECENT[sql, comments] = tuple(out)
    return _RECENT[sql, comments]


def without_comments(sql: str) -> str:
    keep, at = [], 0
    for t in tokens(sql, comments=True):
        if t.kind == "comment":
            keep.append(sql[at : t.start])
            at = t.end
    return "".join(keep) + sql[at:]


#: Words that start a statement where a line does.
_STARTS = {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH", "CREATE", "ALTER", "DROP", "TRUNCATE", "REPLACE", "EXEC", "EXECUTE", "CALL", "DECLARE"}
_CREATES = {"CREATE", "ALTER", "REPLACE"}
_ROUTINES = {"PROCEDURE", "PROC", "FUNCTION", "TRIGGER", "PACKAGE", "MACRO", "TASK"}
#: Words after which a statement word goes on with the same statement.
_GOES_ON = {"AS", "FOR", "ON", "THEN", "UNION", "ALL", "EXCEPT", "INTERSECT", "MINUS", "OR", "AFTER", "BEFORE", "OF", "EXPLAIN", "RETURN", "USING", "IS", "BEGIN", "ELSE"}


def statements(sql: str, dialect: str = "tsql") -> list[str]:
    """Statements of a text, without comments at their ends and without the semicolon."""
    out: list[str] = []
    ts = tokens(sql)
    # Only T-SQL does without semicolons; elsewhere a line starts a statement if it creates something.
    starts = _STARTS if dialect == "tsql" else _CREATES
    first, depth, blocks, routine, started_with = 0, 0, 0, False, ""
    begins = _begins_ahead(ts)
    # package: its own block is open; bodies: nested routines and the routine itself whose BEGIN is still to come; header: of a routine;
    # bare: the body is no block, so in T-SQL it goes on to the end of the batch.
    package, bodies, header, bare = False, 0, False, False

    def close(upto: int) -> None:
        if first < upto:
            text = sql[ts[first].start : ts[upto - 1].end].strip()
            if text:
                out.append(text)

    for i, t in enumerate(ts):
        if i == first:
            routine, blocks, depth, started_with = False, 0, 0, t.upper
            package, bodies, header, bare = False, 0, False, False
        if t.kind == "op":
            if t.text == "(":
                depth += 1
            elif t.text == ")":
                depth = max(0, depth - 1)
            elif t.text == ";" and depth == 0:
                header = header and blocks <= 0 and not (package or bodies)
                open_body = bodies > 0 and begins[i] or bare and not _starts_routine(ts, i + 1)
                if blocks <= 0 and not (routine and open_body):
                    close(i)
                    first = i + 1
            continue
        if t.kind == "string" and t.text.startswith("$"):  # the body
            bodies, header = 0, False
        if t.kind != "word" or depth:
            continue
        w = t.upper
        if w in _ROUTINES and i - first <= 6 and started_with in ("CREATE", "REPLACE", "ALTER"):
            routine = header = True
        elif routine and w in ("PROCEDURE", "FUNCTION") and (package or bodies or blocks > 0):
            header = True
        elif header and w in ("AS", "IS", "DECLARE") and ts[i - 1].upper not in ("EXECUTE", "EXEC"):
            header, bare = False, bare or dialect == "tsql" and not (i + 1 < len(ts) and (_is_begin(ts, i + 1) or ts[i + 1].kind == "string"))
            if any(x.upper == "PACKAGE" for x in ts[first : first + 6]) and not package:
                package, blocks = True, blocks + 1
            else:
                bodies += 1
        if _is_begin(ts, i):
            header = False
            if package and blocks == 1 and not bodies:  # statements of the package itself, which its END closes
                continue
            bodies = max(0, bodies - 1)
            blocks += 1
        elif w == "CASE":
            blocks += 1
        elif w == "END" and (i + 1 >= len(ts) or ts[i + 1].upper not in ("IF", "LOOP", "WHILE", "FOR", "REPEAT")):
            blocks -= 1
        new_line = i > first and "\n" in sql[ts[i - 1].end : t.start]
        if new_line and w in starts and not routine and blocks <= 0 and ts[i - 1].upper not in _GOES_ON and ts[i - 1].text not in ("(", ",") and not _continues(ts, first, i, w):
            close(i)
            first, routine, started_with = i, False, w
    close(len(ts))
    return out


def _is_begin(ts: Sequence[Token], i: int) -> bool:
    return ts[i].upper == "BEGIN" and (i + 1 >= len(ts) or ts[i + 1].upper not in ("TRANSACTION", "TRAN", "WORK", ";"))


def _starts_routine(ts: Sequence[Token], i: int) -> bool:
    return i < len(ts) and ts[i].upper in ("CREATE", "REPLACE", "ALTER") and any(t.upper in _ROUTINES for t in ts[i + 1 : i + 7])


def _begins_ahead(ts: Sequence[Token]) -> list[bool]:
    """For each token, whether a BEGIN follows before the next routine is created."""
    ahead, out = False, [False] * len(ts)
    for i in range(len(ts) - 1, -1, -1):
        out[i] = ahead
        if _is_begin(ts, i):
            ahead = True
        elif ts[i].upper in ("CREATE", "REPLACE", "ALTER") and (i == 0 or ts[i - 1].text in (";", "/") or ts[i - 1].upper == "END") and _starts_routine(ts, i):
            ahead = False
    return out


#: Words that start a statement within a routine.
_IN_BODY = _STARTS - {"DECLARE", "REPLACE"} | {"SEL", "INS", "UPD", "DEL", "PERFORM"}
#: Words of control that end the statement before them.
_CONTROL = {"BEGIN", "IF", "ELSIF", "ELSEIF", "LOOP", "WHILE", "EXCEPTION", "DECLARE", "RETURN", "PRINT", "RAISE", "END"}


def routine_statements(ts: Sequence[Token], header: bool = True) -> list[tuple[int, int]]:
    """Spans of tokens of the statements in a routine's text, in blocks or brackets or not; statements of control are left out, and
    so is all up to the body if there is a header."""
    spans: list[tuple[int, int]] = []
    # lead: the first word of the statement, behind its WITH clause if it has one.
    first, lead, inner, depth, cases, head = -1, -1, 0, 0, 0, header

    def close(upto: int) -> None:
        nonlocal first, cases
        if 0 <= first < upto:
            spans.append((first, upto))
        first, cases = -1, 0

    for i, t in enumerate(ts):
        if t.kind == "op":
            if t.text == "(":
                depth += 1
            elif t.text == ")":
                depth -= 1
                if first >= 0 and depth < inner:
                    close(i)
            elif t.text == ";" and depth <= (inner if first >= 0 else depth):
                close(i)
            continue
        if t.kind != "word" or first >= 0 and depth > inner or i and ts[i - 1].text == ".":
            continue
        w, before = t.upper, ts[i - 1].upper if i else ""
        if head:  # up to the body
            head = w not in ("AS", "IS", "BEGIN", "DECLARE")
            continue
        if w == "CASE" and first >= 0:
            cases += 1
        elif w == "END" and cases:
            cases -= 1
        elif cases:
            continue
        elif w in _CONTROL and not (w in ("IF", "LOOP") and ts[lead].upper in ("CREATE", "DROP", "ALTER")) or w in ("THEN", "ELSE") and ts[lead].upper != "MERGE":
            close(i)
        elif w in _IN_BODY and first >= 0 and (before in _GOES_ON or ts[lead].upper != "MERGE" and _continues(ts, lead, i, w)):
            if ts[lead].upper == "WITH":
                lead = i
        elif w in _IN_BODY:
            if first < 0 and w == "EXECUTE" and ts[i + 1 : i + 2] and ts[i + 1].upper == "AS":
                continue
            if first < 0 or not (w == "WITH" and ts[i + 1 : i + 2] and (ts[i + 1].text == "(" or ts[i + 1].upper in ("TIES", "CHECK", "NO", "DATA"))):
                close(i)
                first, lead, inner = i, i, depth
    close(len(ts))
    return spans


def _continues(ts: Sequence[Token], first: int, i: int, word: str) -> bool:
    """Whether a statement word belongs to the statement that is open: the query of an INSERT, CTE, view or MERGE branch."""
    opener = ts[first].upper
    body = {t.upper for t in ts[first:i] if t.kind == "word"}
    if opener == "WITH":
        return word in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE") and not body & {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"} or _only_in_brackets(ts, first, i)
    if opener == "INSERT":
        return word in ("SELECT", "WITH", "EXEC", "EXECUTE") and "VALUES" not in body and not _at_depth0(ts, first, i, {"SELECT"})
    if opener == "MERGE":
        return word in ("UPDATE", "INSERT", "DELETE")
    if opener in ("CREATE", "REPLACE", "ALTER"):
        return word in ("SELECT", "WITH") and (ts[i - 1].upper == "AS" or "WITH" in body and not _at_depth0(ts, first, i, {"SELECT"}))
    return False


def _at_depth0(ts: Sequence[Token], first: int, i: int, words: set[str]) -> bool:
    depth = 0
    for t in ts[first:i]:
        if t.text == "(" and t.kind == "op":
            depth += 1
        elif t.text == ")" and t.kind == "op":
            depth -= 1
        elif depth == 0 and t.upper in words:
            return True
    return False


def _only_in_brackets(ts: Sequence[Token], first: int, i: int) -> bool:
    return not _at_depth0(ts, first, i, {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"})
