"""Secret scanning: fixed patterns and an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = "literal"``, ``"name": "literal"``, ``name: bare``,
``name := 'literal'``, ``a="x" b="y"``) into pairs of a target name and literals.  A right side that is a name stands
for the value last assigned to it in the text (constant propagation), and literals joined by ``+`` count
together.  Each literal is scored by how sensitive its target's name is and by whether the literal looks random;
a constant that reaches a sensitive name later is thereby found where it is written.

Only lines that hold an assignment sign are lexed, so prose costs a search for that sign.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .flattext import slices
from .names import other_columns_apart

KINDS = ("assign", "access", "hex", "named")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run of 18 or 16 characters is the greedy match of the pattern with +, kept if long enough: no part of a
# dropped run could be long enough either.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_REST = r"""(?P<quote>["'])|(?P<op>:=|=>|==|!=|<=|>=|[:=+])|(?P<stop>[,;(){}\[\]<>])|(?P<name>[A-Za-z_$][\w.$-]*+)|(?P<bare>[^\s"'=:;,(){}\[\]<>+]++)"""
_STRING = {q: rf"(?P<str{k}>{q}(?:[^{q}\\\n]|\\.)*+{q})" for k, q in enumerate("\"'")}
#: By the quotes that may still open a string.
_TOKEN = {quotes: re.compile("|".join([*(_STRING[q] for q in quotes), _REST]), re.A) for quotes in ("\"'", "'", '"', "")}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How sensitive a word in a target's name is. Fixed values.
NAME_WEIGHT = {
    "apikey": 0.9, "auth": 0.6, "bearer": 0.8, "cert": 0.5, "cred": 0.8, "credential": 0.9, "credentials": 0.9, "dsn": 0.6,
    "key": 0.5, "pass": 0.8, "passphrase": 1.0, "passwd": 1.0, "password": 1.0, "private": 0.5, "pwd": 0.9, "secret": 0.9,
    "session": 0.4, "sig": 0.4, "signature": 0.4, "token": 0.8, "webhook": 0.5,
}
#: Words that mark a literal as a placeholder. Fixed values.
PLACEHOLDER = re.compile(r"example|changeme|placeholder|redacted|your[_-]|dummy|sample|xxxx|\*\*\*|<|\$\{|^(?:null|none|true|false|todo)$", re.I)


def base_spans(text: str) -> list[tuple[int, str, int, tuple[int, int]]]:
    """(start, kind, end, span of the secret itself) of the fixed patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "assign", m.end(), m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.span()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end(), m.span()) for m in _HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """1 minus the product of what the name's words leave over."""
    rest = 1.0
    for word in _PART.findall(name):
        rest *= 1.0 - NAME_WEIGHT.get(word.lower(), 0.0)
    return 1.0 - rest


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: its entropy against that of 16 random characters."""
    if len(value) < 8 or " " in value or PLACEHOLDER.search(value):
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values()) * n
    kinds = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 64.0) * (1.0 if kinds >= 2 else 0.5)


def tokens(line: str, start: int = 0) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of a line's tokens.

    A quote that no later one closes isn't the start of a string, nor is any after it in its line, as it would meet
    the same escapes: so a line is read once, whatever is in it.
    """
    out, quotes, at = [], "\"'", 0
    while m := _TOKEN[quotes].search(line, at):
        at = m.end()
        if m.lastgroup == "quote":
            quotes = quotes.replace(m.group(), "")
        else:
            out.append(("str" if m.lastgroup.startswith("str") else m.lastgroup, m.group(), start + m.start(), start + at))
    return out


class Value:
    """The right side of an assignment: spans of its literals, the constants in it, and the most that any scores.

    Constants are referred to, not copied, so that a chain of assignments takes no more room than its text.
    """

    __slots__ = ("spans", "parts", "score", "told")

    def __init__(self, literals: list[tuple[str, int, int]], parts: list[Value]) -> None:
        self.spans = [(a, b) for _, a, b in literals]
        self.parts = list({id(p): p for p in parts}.values())
        self.score = max([literal_score("".join(t for t, _, _ in literals)) if literals else 0.0, *(p.score for p in parts)])
        self.told = False

    def tell(self) -> Iterator[tuple[int, int]]:
        """The spans of this value and of its constants; of one that has told them before, none."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.told:
                value.told = True
                yield from value.spans
                todo += value.parts


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(target name, value) in the order of the text, constants propagated.

    Literals joined by ``+`` are scored together, and a constant by itself, once.
    """
    known: dict[str, Value] = {}
    start = 0
    for line in text.split("\n"):
        if "=" in line or ":" in line:
            found = tokens(line, start)
            k = 1
            while k < len(found):
                kind, sign, _, _ = found[k]
                if kind != "op" or sign not in ("=", ":", ":=", "=>") or found[k - 1][0] not in ("name", "str", "bare"):
                    k += 1
                    continue
                name = found[k - 1][1].strip("\"'")
                if sign == ":" and k + 2 < len(found) and found[k + 1][0] == "name" and found[k + 2][1] == "=":
                    k += 2  # a type stands between the name and the sign
                literals, parts, k = [], [], k + 1
                while k < len(found):
                    kind, part, a, b = found[k]
                    if kind == "str":
                        literals.append((part[1:-1], a + 1, b - 1))
                    elif kind in ("name", "bare"):
                        run = [part]
                        while k + 1 < len(found) and found[k + 1][0] in ("name", "bare") and found[k + 1][2] == b:
                            k, b = k + 1, found[k + 1][3]  # a bare value runs on
                            run.append(found[k][1])
                        part = "".join(run)
                        if part in known:
                            parts.append(known[part])
                        else:
                            literals.append((part, a, b))
                    else:
                        break
                    k += 1
                    if k < len(found) and found[k][1] == "+":
                        k += 1
                    else:
                        break
                if literals or parts:
                    known[name] = Value(literals, parts)
                    yield name, known[name]
        start += len(line) + 1


def named_spans(text: str, threshold: float) -> list[tuple[int, str, int, tuple[int, int]]]:
    """Literals whose target's name and look make a secret likely."""
    if "=" not in text and ":" not in text:
        return []
    found = set()
    for name, value in assignments(text):
        target = name_score(name)
        if target >= threshold and target * value.score >= threshold:
            found.update(value.tell())
    return [(a, "named", b, (a, b)) for a, b in found if b > a]


def spans(text: str, threshold: float = 0.5) -> list[tuple[int, str, int, tuple[int, int]]]:
    """All spans by start, then kind; a named literal inside a pattern's span isn't told again."""
    base, more = base_spans(text), named_spans(text, threshold)
    if base and more:  # a span that starts no later and ends no earlier holds it
        starts = sorted((x[0], x[2]) for x in base)
        reach = list(accumulate((b for _, b in starts), max))
        more = [x for x in more if not (k := bisect_right(starts, (x[0], math.inf))) or reach[k - 1] < x[2]]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _told(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b, _ in found)


def scan(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_named, base_sha256, spans.

    Null text counts as empty; an empty text has no spans and the digest of the empty string.  Rows are judged one
    by one, so repeated rows and null ids pass through.  Positions are code points, ends exclusive.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_named", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spans(t or "", threshold) for t in batch.column("text").to_pylist()]
            counts = [[sum(x[1] == kind for x in row) for row in found] for kind in KINDS]
            base = [hashlib.sha256(_told([x for x in row if x[1] != "named"]).encode()).hexdigest() for row in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array([_told(row) for row in found], pa.string())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]", threshold: float = 0.5) -> str:
    """The text with every secret replaced; overlapping ones share a mark."""
    out, end = [], 0
    for a, b in sorted(x[3] for x in spans(text, threshold)):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join(out) + text[end:]


@other_columns_apart()
def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with secrets replaced in the text; all columns stay, null stays null, rows are treated one by one, repeated ones alike.

    An empty table stays empty; very long texts are lexed one at a time; names of other columns don't matter.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            clean = [t if t is None else redacted(t, threshold=threshold) for t in batch.column(text).to_pylist()]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
