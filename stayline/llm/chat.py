"""Chat formatting by compiled templates.

The template language has text, ``{{ expression }}`` and the tags ``for x in list``,
``if`` / ``elif`` / ``else``, ``set`` and ``generation``, with ``{%-`` and ``-%}`` trimming
blanks. Expressions are names, literals, attributes of dictionaries, ``==``, ``!=``,
``+``, ``and``, ``or``, ``not``, ``in`` and filters from a fixed table. There are no calls, no
attributes of Python objects and no loops but over given lists, so a template can neither
reach the interpreter nor run for ever. A template is parsed into a syntax tree, constant
parts are folded, and the tree becomes Python closures. Text that a ``generation`` block
writes is recorded as spans of the output: that is the loss mask.

The control strings of the production template are escaped inside roles and texts with a
backslash, which is itself doubled, so ``parse`` reads every turn back from the output.

Defined results: rows of one conversation are ordered by turn, then role and text (null
before all); null roles and texts count as empty; rows without a ``conv_id`` are one
conversation; repeated rows are repeated turns. An empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Strings with a meaning in the output.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: One turn: its role between the two marks, its text, its end.
TEMPLATE = """{%- for m in messages -%}
<s>[INST]{{ m.role | escape }}[/INST]
{%- if m.role == "assistant" -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
</s>
{%- endfor -%}"""

_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_MARKS = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS)), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape, "trim": lambda x: x.strip(), "lower": lambda x: x.lower(),
    "upper": lambda x: x.upper(), "length": len,
}


class TemplateError(ValueError):
    """The template is not in the language, or uses what it may not."""


# Syntax tree: expressions.


@dataclass(frozen=True)
class Constant:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Filtered:
    of: Any
    name: str


@dataclass(frozen=True)
class Operation:
    sign: str
    parts: tuple


# Syntax tree: statements.


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple
    rest: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[+|.()]))", re.DOTALL)
_LITERALS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        found = _TOKEN.match(source, at)
        if not found:
            raise TemplateError(f"not understood: {source[at:]!r}")
        kind, value = found.lastgroup, found[found.lastgroup]
        if kind == "text":
            value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL)
        out.append((kind, int(value) if kind == "number" else value))
        at = found.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression, loosest binding first."""

    def __init__(self, source: str):
        self.tokens = _tokens(source)

    def whole(self):
        value = self.any_of()
        if self.tokens:
            raise TemplateError(f"left over: {self.tokens}")
        return value

    def take(self, *wanted: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "text" and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def chain(self, below: Callable, *signs: str):
        value = below()
        while sign := self.take(*signs):
            value = Operation(sign, (value, below()))
        return value

    def any_of(self):
        return self.chain(self.all_of, "or")

    def all_of(self):
        return self.chain(self.negated, "and")

    def negated(self):
        return Operation("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        return self.chain(self.summed, "==", "!=", "in")

    def summed(self):
        return self.chain(self.filtered, "+")

    def filtered(self):
        value = self.single()
        while self.take("|"):
            value = Filtered(value, self.word(FILTERS))
        return value

    def word(self, known=None) -> str:
        kind, value = self.tokens.pop(0) if self.tokens else ("end", "")
        if kind != "name" or known is not None and value not in known:
            raise TemplateError(f"not allowed here: {value!r}")
        return value

    def single(self):
        if self.take("("):
            value = self.any_of()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return value
        kind, value = self.tokens.pop(0) if self.tokens else ("end", "")
        if kind in ("text", "number"):
            return Constant(value)
        if kind != "name":
            raise TemplateError(f"not allowed here: {value!r}")
        if value in _LITERALS:
            return Constant(_LITERALS[value])
        node = Name(value)
        while self.take("."):
            node = Field(node, self.word())
        return node


_TAG = re.compile(r"(\s*\{%-|\{%|\s*\{\{-|\{\{)(.*?)(-%\}\s*|%\}|-\}\}\s*|\}\})", re.DOTALL)


class _Template:
    """Recursive descent over the pieces of a template."""

    def __init__(self, source: str):
        self.pieces: list[tuple[str, str]] = []
        at = 0
        for found in _TAG.finditer(source):
            if found.start() > at:
                self.pieces.append(("text", source[at:found.start()]))
            self.pieces.append(("tag" if "%" in found[1] else "value", found[2].strip()))
            at = found.end()
        if at < len(source):
            self.pieces.append(("text", source[at:]))

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Statements up to one of the tags ``ends``, and that tag."""
        out = []
        while self.pieces:
            kind, what = self.pieces.pop(0)
            if kind == "text":
                out.append(Write(Constant(what)))
            elif kind == "value":
                out.append(Write(_Expression(what).whole()))
            else:
                word, _, rest = what.partition(" ")
                if word in ends:
                    return tuple(out), what
                out.append(self.statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def statement(self, word: str, rest: str):
        if word == "generation" and not rest:
            return Generation(self.body("endgeneration")[0])
        if word == "set" and (found := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.*)", rest, re.DOTALL)):
            return Set(found[1], _Expression(found[2]).whole())
        if word == "for" and (found := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)):
            return For(found[1], _Expression(found[2]).whole(), self.body("endfor")[0])
        if word == "if":
            branches, tag = [], f"if {rest}"
            while not tag.startswith(("else", "endif")):
                test = _Expression(tag.partition(" ")[2]).whole()
                inner, tag = self.body("elif", "else", "endif")
                branches.append((test, inner))
            last = self.body("endif")[0] if tag.startswith("else") else ()
            return If(tuple(branches), last)
        raise TemplateError(f"not a tag: {word} {rest}")


_OPERATIONS: dict[str, Callable] = {
    "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "+": lambda x, y: x + y,
    "in": lambda x, y: x in y, "not": lambda x: not x,
    "and": lambda x, y: x and y, "or": lambda x, y: x or y,
}


def fold(node):
    """The tree with constant expressions worked out, dead branches gone and neighbouring
    constant texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for part in map(fold, node):
            parts = part if isinstance(part, tuple) else (part,)
            for p in parts:
                constant = isinstance(p, Write) and isinstance(p.value, Constant)
                if constant and out and isinstance(out[-1], Write) and isinstance(out[-1].value, Constant):
                    out[-1] = Write(Constant(_shown(out[-1].value.value) + _shown(p.value.value)))
                else:
                    out.append(p)
        return tuple(out)
    if isinstance(node, Operation):
        parts = tuple(map(fold, node.parts))
        if all(isinstance(p, Constant) for p in parts):
            return Constant(_OPERATIONS[node.sign](*(p.value for p in parts)))
        return Operation(node.sign, parts)
    if isinstance(node, Filtered):
        of = fold(node.of)
        return Constant(FILTERS[node.name](of.value)) if isinstance(of, Constant) else Filtered(of, node.name)
    if isinstance(node, Write):
        return Write(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        branches = []
        for test, body in node.branches:
            test, body = fold(test), fold(body)
            if isinstance(test, Constant):
                if test.value:
                    return If(tuple(branches), body) if branches else body
                continue
            branches.append((test, body))
        return If(tuple(branches), fold(node.rest)) if branches else fold(node.rest)
    return node


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


class Output:
    """Text written so far and the spans of it that generation blocks wrote."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _evaluator(node) -> Callable[[dict], Any]:
    if isinstance(node, Constant):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of, name = _evaluator(node.of), node.name

        def field(scope):
            value = of(scope)
            return value.get(name) if isinstance(value, dict) else None

        return field
    if isinstance(node, Filtered):
        of, work = _evaluator(node.of), FILTERS[node.name]
        return lambda scope: work(of(scope))
    parts = [_evaluator(p) for p in node.parts]
    if node.sign == "not":
        return lambda scope: not parts[0](scope)
    left, right = parts
    if node.sign == "and":
        return lambda scope: left(scope) and right(scope)
    if node.sign == "or":
        return lambda scope: left(scope) or right(scope)
    work = _OPERATIONS[node.sign]
    return lambda scope: work(left(scope), right(scope))


def _writer(node) -> Callable[[dict, Output], None]:
    if isinstance(node, tuple):
        steps = [_writer(n) for n in node]

        def run(scope, out):
            for step in steps:
                step(scope, out)

        return run
    if isinstance(node, Write):
        if isinstance(node.value, Constant):
            text = _shown(node.value.value)
            return lambda scope, out: out.write(text)
        value = _evaluator(node.value)
        return lambda scope, out: out.write(_shown(value(scope)))
    if isinstance(node, Set):
        name, value = node.name, _evaluator(node.value)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if isinstance(node, Generation):
        body = _writer(node.body)

        def generation(scope, out):
            begin = out.length
            body(scope, out)
            out.spans.append((begin, out.length))

        return generation
    if isinstance(node, For):
        name, over, body = node.name, _evaluator(node.over), _writer(node.body)

        def loop(scope, out):
            values = over(scope) or ()
            if not isinstance(values, (list, tuple)):
                raise TemplateError("only lists can be looped over")
            for value in values:
                body(scope | {name: value}, out)

        return loop
    branches = [(_evaluator(t), _writer(b)) for t, b in node.branches]
    rest = _writer(node.rest)

    def choose(scope, out):
        for test, body in branches:
            if test(scope):
                return body(scope, out)
        return rest(scope, out)

    return choose


def compiled(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the formatted text and its generation spans."""
    write = _writer(fold(_Template(template).body()[0]))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        write({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that ``TEMPLATE`` formatted."""
    turns, role, begin = [], None, 0
    for mark in _MARKS.finditer(formatted):
        if mark[0] == "[INST]":
            begin = mark.end()
        elif mark[0] == "[/INST]":
            role, begin = unescape(formatted[begin:mark.start()]), mark.end()
        elif mark[0] == "</s>":
            turns.append((role, unescape(formatted[begin:mark.start()])))
    return turns


#: Most turns that are rendered at once.
PART_TURNS = 2048
SCHEMA = "conv_id long, part long, formatted string, spans array<struct<start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FLUSH = 1 << 22


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Conversations as ``conv_id``, ``part``, ``formatted`` text and the ``spans`` (in code
    points) under its loss mask. Takes ``conv_id``, ``turn``, ``role``, ``text``.

    Rows are dealt out by ranges of (conversation, turn), so a conversation that holds a
    third of all rows is rendered by many tasks. What one task has of a conversation is a
    part, of ``PART_TURNS`` turns at most; nearly all conversations have one. The texts of
    the parts, in order, are the conversation's text, which asks of a template that it
    treats each turn by itself.
    """
    compiled(template)  # a bad template fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, task = compiled(template), TaskContext.get().partitionId()
        done: list[tuple] = []
        held: list[dict] = []
        number = size = 0
        current: Any = None

        def close() -> None:
            nonlocal number, size
            if held:
                text, spans = render(held)
                done.append((current, task << 32 | number, text, [{"start": x, "end": y} for x, y in spans]))
                held.clear()
                number, size = number + 1, size + len(text)

        def flush() -> pa.RecordBatch:
            nonlocal size
            kinds = (pa.int64(), pa.int64(), pa.string(), _SPANS)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*done), kinds)],
                ["conv_id", "part", "formatted", "spans"])
            done.clear()
            size = 0
            return batch

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current or len(held) >= PART_TURNS:
                    close()
                    if size > _FLUSH:
                        yield flush()
                current = conv
                held.append({"role": role, "text": text})
        close()
        if done:
            yield flush()

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role"), blank("text"))
    order = ("conv_id", "turn", "role", "text")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


class _Digest:
    """What the parts of one conversation say, read back one after the other."""

    def __init__(self):
        self.turns = self.masked_chars = self.chars = 0
        self.whole, self.masked = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, spans: list[dict]) -> None:
        for role, said in parse(text):
            self.whole.update(f"{role}\n{said}\n".encode())
            self.turns += 1
        for span in spans:
            said = unescape(text[span["start"]:span["end"]])
            self.masked.update(said.encode())
            self.masked_chars += len(said)
        self.chars += len(text)

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.whole.hexdigest(), self.masked_chars, self.masked.hexdigest(), self.chars


_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def digests(parts: DataFrame) -> DataFrame:
    """What ``formatted`` output says when read back: turns, and text under the loss mask.

    A digest runs over a conversation's text in order, so its parts meet in one task, which
    holds one part at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
                if digest is None or conv != current:
                    if digest:
                        rows.append(digest.row(current))
                    current, digest = conv, _Digest()
                digest.read(text, spans)
            yield _digest_batch(rows)
        if digest:
            yield _digest_batch([digest.row(current)])

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_DIGESTS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _DIGESTS)], schema=_DIGESTS)
