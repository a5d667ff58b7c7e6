"""Secret scan: base patterns, and literals assigned to sensitively named targets.

Base spans are found by three patterns (``BASE``). Beyond them a lexer splits
each line that assigns something into names, string literals, bare values and
operators, and reads name-literal pairs from source and configuration syntax
(``name = "a" + OTHER``, ``name: value``, ``"name": "value"``, ``name => 'v'``,
also inside brackets, with a type as in ``name: str = "a"`` or ``char name[] = "a"``,
and of a subscripted key, ``x["name"] = "a"``). A value may stand on the next line
unless that line assigns something itself.
Literals of a name are kept as its constants and follow it through later
assignments and concatenations, as a graph of values each of which is looked at once for a
risk, so the work stays in proportion to the text. A literal is reported as kind ``lexed`` if the
target's name is sensitive, the literal looks like a secret, and no span found
before overlaps it.

Defined cases: null text counts as empty and has no spans; spans are in code
points, end exclusive; rows that repeat an id are scanned alike; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Fixed values of the contract: the kinds in order, their patterns, the least length (of the value for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of AKIA[A-Z0-9]+ of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f]+ of 24 characters or more
LEXED = "lexed"

_LEXEME = re.compile(r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][\w$.-]*)|(?P<op>:=|=>|==|[=:+,;()\[\]{}])|(?P<bare>[^\s"'=:+,;]+)""", re.ASCII)
#: A bare value that begins with a bracket.
_BRACKETED = re.compile(r"""[(\[{][^\s"'=:+,;]+""", re.ASCII)
_ASSIGNS = ("=", ":", ":=", "=>")
_OPENS, _CLOSES = ("(", "[", "{"), (")", "]", "}")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Parts of a name and how sensitive they make it; pairs count if both parts are there.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.7, "pin": 0.5}
SENSITIVE_PAIRS = {("api", "key"): 0.9, ("private", "key"): 0.9, ("access", "key"): 0.9, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("client", "secret"): 1.0}
#: Parts that say the value is about a secret but none.
HARMLESS = {"file", "path", "url", "uri", "type", "count", "length", "len", "size", "max", "min", "name", "field", "label", "hint", "policy", "expires", "expiry", "ttl", "id", "regex", "pattern"}
THRESHOLD = 0.5


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    have = set(parts)
    best = max([SENSITIVE.get(p, 0.0) for p in parts] + [w for pair, w in SENSITIVE_PAIRS.items() if have.issuperset(pair)], default=0.0)
    return best * (0.4 if have & HARMLESS else 1.0)


def strength(literal: str) -> float:
    """From 0 to 1: long enough, without spaces, of mixed characters."""
    if len(literal) < 6 or any(c.isspace() for c in literal) or literal.startswith(("${", "{{", "<", "%(")):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(any(test(c) for c in literal) for test in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum()))
    return min(1.0, entropy / 3) * (1.0 if kinds >= 2 else 0.5)


def _lexed(line: str, at: int) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of the tokens; a bare value ends before a bracket that closes one opened before it."""
    tokens, depth, k = [], 0, 0
    while m := _LEXEME.search(line, k):
        value, k = m[0], m.end()
        depth += (value in _OPENS) - (value in _CLOSES and depth > 0)
        if m.lastgroup == "bare":
            keep, spare = len(value), min(depth, sum(map(value.count, _CLOSES)) - sum(map(value.count, _OPENS)))
            while spare > 0 and keep > 1 and value[keep - 1] in _CLOSES:
                keep, spare = keep - 1, spare - 1
            value = value[:keep]
            k = m.start() + keep
        tokens.append((m.lastgroup, at + m.start(), at + m.start() + len(value), value))
    return tokens


def _statements(text: str):
    """Tokens of each line that assigns something, with the lines on which its value goes on."""
    at, pending = 0, []
    for line in text.split("\n"):
        assigns = "=" in line or ":" in line
        tokens = _lexed(line, at) if assigns or pending else []
        at += len(line) + 1
        if pending and not tokens:
            continue
        if pending and any(t[0] == "op" and t[3] in _ASSIGNS for t in tokens):
            yield pending
            pending = []
        tokens = pending + tokens
        last = len(tokens) - 1
        while last > 0 and tokens[last][3] in ("(", "\\"):
            last -= 1
        if last > 0 and tokens[last][0] == "op" and tokens[last][3] in (*_ASSIGNS, "+"):
            pending = [t for t in tokens if t[3] != "\\"]
        else:
            pending = []
            yield tokens
    yield pending


def _target(tokens: list, k: int) -> tuple[str, int] | None:
    """The name that is assigned at k, and where its value begins."""
    kind, _, _, name = tokens[k]
    if kind not in ("name", "text"):
        return None
    at, what = k + 1, lambda i: tokens[i][3] if i < len(tokens) else ""
    while kind == "name" and what(at) == "[":
        if what(at + 1) == "]":
            at += 2
        elif what(at + 2) == "]":
            name, at = what(at + 1) if tokens[at + 1][0] == "text" else name, at + 3
        else:
            return None
    if at >= len(tokens) or tokens[at][0] != "op" or tokens[at][3] not in _ASSIGNS:
        return None
    if what(at) == ":":  # name: type = value
        end = at + 1
        while end < min(len(tokens), at + 16) and (tokens[end][0] in ("name", "bare") or what(end) in ("[", "]") or what(end) == "," and what(end - 1) != "]"):
            end += 1
        if end > at + 1 and tokens[at + 1][0] == "name" and what(end) == "=" and (end == at + 2 or what(at + 2) in ("[", "|") or what(at + 2)[:1] in ("<", "&")):
            at = end
    return name.strip("\"'"), at + 1


class Value:
    """What a name holds: literals of its own, and the values of the names in its expression."""

    __slots__ = ("literals", "parts", "risk")

    def __init__(self):
        self.literals, self.parts, self.risk = [], [], 0.0


def _pairs(text: str):
    """(name, its value) in order."""
    constants: dict[str, Value] = {}
    for tokens in _statements(text):
        k = 0
        while k + 2 < len(tokens):
            target = _target(tokens, k)
            if target is None:
                k += 1
                continue
            (name, k), held = target, Value()
            while k < len(tokens):
                kind, start, end, value = tokens[k]
                if value in _OPENS and kind == "op":
                    m = _BRACKETED.match(text, start)
                    after = k + 1
                    while m and after < len(tokens) and tokens[after][1] < m.end():
                        after += 1
                    if m and not (after < len(tokens) and tokens[after][3] in _ASSIGNS):
                        held.literals.append(m.span())
                        k = after - 1
                    elif m or value == "{":
                        break
                    else:
                        k += 1
                        continue
                elif kind == "text":
                    held.literals.append((start + 1, end - 1))
                elif kind == "name" and value in constants:
                    held.parts.append(constants[value])
                elif kind in ("name", "bare"):
                    held.literals.append((start, end))
                else:
                    break
                k += 1
                if k < len(tokens) and tokens[k][3] == "+":
                    k += 1
                else:
                    break
            if held.literals or held.parts:
                constants[name] = held
                yield name, held


def _reached(held: Value, risk: float):
    """Literals that reach a name so sensitive; values that as great a risk has reached before are not looked at again."""
    todo = [held]
    while todo:
        value = todo.pop()
        if value.risk < risk:
            value.risk = risk
            yield from value.literals
            todo += value.parts


class Taken:
    """Spans that meet no other: their begins and ends in order."""

    def __init__(self, spans):
        self.begins, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.begins.append(start)
                self.ends.append(end)

    def take(self, start: int, end: int) -> bool:
        """Whether the span was free; now it is not."""
        at = bisect.bisect_right(self.ends, start)
        if start >= end or at < len(self.begins) and self.begins[at] < end:
            return False
        self.begins.insert(at, start)
        self.ends.insert(at, end)
        return True


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind."""
    text = text or ""
    assigns = "=" in text or ":" in text
    found = []
    if assigns:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    if assigns:
        taken = Taken((s, e) for s, e, _ in found)
        for name, held in _pairs(text):
            if (risk := sensitivity(name)) >= THRESHOLD:
                found += [(s, e, 3) for s, e in _reached(held, risk) if risk * strength(text[s:e]) >= THRESHOLD and taken.take(s, e)]
    return [(s, e, (*KINDS, LEXED)[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
