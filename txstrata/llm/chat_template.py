"""A compiler for a sandboxed template language, and chat formatting with it.

``{{ expression }}`` prints; ``{% for x in xs %}``, ``{% if %}`` with ``elif``
and ``else``, ``{% set x = expression %}`` and ``{% generation %}`` (marking
text to be learned) are the statements; ``{# #}`` is a comment, and ``-`` next
to a mark strips white space.  Expressions have literals, names, fields of
mappings (``m.role``, ``m["role"]``), ``+ ~ == != < <= > >= in not in and or
not``, conditionals and the filters listed in FILTERS.  Names resolve to given
variables only: no attribute of a Python object can be reached and nothing
else can be called.  Source is parsed to a syntax tree, constants are folded,
and the tree becomes Python closures that yield text and generation marks one
by one, so long conversations are rendered without being held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from enum import Enum
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Mark(Enum):
    """Generation marks in a stream of text."""

    BEGIN = 1
    END = 2


class TemplateError(ValueError):
    """A template that the language does not allow, or a value it cannot print."""


# Syntax tree


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: object
    key: object


@dataclass
class Op:
    name: str
    args: list


@dataclass
class Emit:
    value: object


@dataclass
class Branch:
    cases: list  # (condition, body)
    other: list


@dataclass
class Loop:
    target: str
    over: object
    body: list


@dataclass
class Assign:
    target: str
    value: object


@dataclass
class Generation:
    body: list


# Scanning and parsing

_MARKS = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\],=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, i, source = [], 0, source.rstrip()
    while i < len(source):
        m = _TOKEN.match(source, i)
        if not m:
            raise TemplateError(f"unexpected {source[i : i + 10]!r}")
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "num":
            out.append(("const", int(text)))
        elif kind == "str":
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        else:
            out.append(("word" if kind == "name" and text.lower() in _WORDS else kind, text.lower() if text.lower() in _WORDS else text))
        i = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def take(self, *wanted: str) -> str | None:
        kind, text = self.tokens[self.at]
        if kind in ("op", "word") and text in wanted:
            self.at += 1
            return str(text)
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text} expected, not {self.tokens[self.at][1]!r}")

    def whole(self):
        tree = self.choice()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        value = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            return Op("choose", [condition, value, self.choice()])
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", [left, self.both()])
        return left

    def both(self):
        left = self.negation()
        while self.take("and"):
            left = Op("and", [left, self.negation()])
        return left

    def negation(self):
        return Op("not", [self.negation()]) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.joined()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                left = Op(op, [left, self.joined()])
            elif self.take("not"):
                self.need("in")
                left = Op("not", [Op("in", [left, self.joined()])])
            else:
                return left

    def joined(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Op(op, [left, self.filtered()])
        return left

    def filtered(self):
        left = self.primary()
        while True:
            if self.take("|"):
                kind, name = self.tokens[self.at]
                if kind != "name" or name not in FILTERS:
                    raise TemplateError(f"no such filter: {name!r}")
                self.at += 1
                left = Op(f"|{name}", [left])
            elif self.take("."):
                kind, name = self.tokens[self.at]
                if kind != "name":
                    raise TemplateError("a field's name is expected")
                self.at += 1
                left = Field(left, Const(name))
            elif self.take("["):
                left = Field(left, self.choice())
                self.need("]")
            else:
                return left

    def primary(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name":
            return Name(str(value))
        if (kind, value) == ("op", "("):
            tree = self.choice()
            self.need(")")
            return tree
        if kind == "word" and value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[str(value)])
        raise TemplateError(f"unexpected {value!r}")


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "print" | "tag", content); white space next to ``-`` is gone."""
    i, strip = 0, False
    while True:
        m = _MARKS.search(source, i)
        text = source[i : m.start() if m else len(source)]
        if strip:
            text = text.lstrip()
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not m:
            return
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = source.find(close, m.end())
        if end < 0:
            raise TemplateError(f"{m[0]} is not closed")
        inner = source[m.end() : end]
        strip = close != "#}" and inner.endswith("-")
        if close != "#}":
            yield ("print" if close == "}}" else "tag"), (inner[:-1] if strip else inner).strip()
        i = end + 2


def parse(source: str) -> list:
    """The syntax tree of a template: a list of statements."""
    pieces = list(_pieces(source))
    at = 0

    def body(*stops: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                out.append(Emit(Const(text)))
            elif kind == "print":
                out.append(Emit(_Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in stops:
                    return out, text
                out.append(statement(word, rest.strip()))
        if stops:
            raise TemplateError(f"{stops[-1]} is missing")
        return out, ""

    def statement(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            return Loop(m[1], _Expression(m[2]).whole(), body("endfor")[0])
        if word == "if":
            cases, condition = [], _Expression(rest).whole()
            while True:
                inner, stop = body("elif", "else", "endif")
                cases.append((condition, inner))
                if stop.startswith("elif"):
                    condition = _Expression(stop[4:]).whole()
                    continue
                return Branch(cases, body("endif")[0] if stop == "else" else [])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set {rest}")
            return Assign(m[1], _Expression(m[2]).whole())
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"no such statement: {word}")

    return body()[0]


# Evaluation

FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0,
    "escape": lambda v: escape(_text(v)),
}


def _text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (str, int, float)):
        return str(v)
    raise TemplateError(f"{type(v).__name__} can't be printed")


def _field(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _ordered(f: Callable) -> Callable:
    def compare(a, b):
        try:
            return f(a, b)
        except TypeError:
            raise TemplateError("values of different kinds have no order") from None

    return compare


_STRICT: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
    "in": lambda a, b: a in b if isinstance(b, (dict, list, tuple)) or isinstance(a, str) and isinstance(b, str) else False,
    "not": lambda a: not a, "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if type(a) is type(b) and isinstance(a, (str, int)) else _text(a) + _text(b),
}


def fold(tree):
    """The same tree with constant expressions computed, texts joined and dead branches gone."""
    if isinstance(tree, list):
        out: list = []
        for node in map(fold, tree):
            for n in node if isinstance(node, list) else [node]:
                if isinstance(n, Emit) and isinstance(n.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(_text(out[-1].value.value) + _text(n.value.value)))
                elif not (isinstance(n, Emit) and isinstance(n.value, Const) and not _text(n.value.value)):
                    out.append(n)
        return out
    if isinstance(tree, Op):
        args = [fold(a) for a in tree.args]
        if tree.name == "choose" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if tree.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (tree.name == "and") else args[0]
        if all(isinstance(a, Const) for a in args) and tree.name not in ("and", "or", "choose"):
            f = FILTERS[tree.name[1:]] if tree.name[0] == "|" else _STRICT[tree.name]
            return Const(f(*[a.value for a in args]))
        return Op(tree.name, args)
    if isinstance(tree, Field):
        return Field(fold(tree.of), fold(tree.key))
    if isinstance(tree, Emit):
        return Emit(fold(tree.value))
    if isinstance(tree, Branch):
        cases = []
        for condition, inner in ((fold(c), fold(b)) for c, b in tree.cases):
            if isinstance(condition, Const):
                if condition.value:
                    return Branch(cases, inner) if cases else inner
                continue
            cases.append((condition, inner))
        other = fold(tree.other)
        return Branch(cases, other) if cases else other
    if isinstance(tree, Loop):
        return Loop(tree.target, fold(tree.over), fold(tree.body))
    if isinstance(tree, Assign):
        return Assign(tree.target, fold(tree.value))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    return tree


def _value(tree) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda env, v=tree.value: v
    if isinstance(tree, Name):
        return lambda env, n=tree.name: env.get(n)
    if isinstance(tree, Field):
        of, key = _value(tree.of), _value(tree.key)
        return lambda env: _field(of(env), key(env))
    args = [_value(a) for a in tree.args]
    if tree.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if tree.name == "or":
        return lambda env: args[0](env) or args[1](env)
    if tree.name == "choose":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    f = FILTERS[tree.name[1:]] if tree.name[0] == "|" else _STRICT[tree.name]
    if len(args) == 1:
        return lambda env: f(args[0](env))
    return lambda env: f(args[0](env), args[1](env))


def _looped(items: Iterable) -> Iterator[tuple[object, dict]]:
    """Items with ``loop``, one ahead, so that the last is known without holding all."""
    items, i = iter(items), 0
    ahead = next(items, Mark.END)
    while ahead is not Mark.END:
        item, ahead = ahead, next(items, Mark.END)
        yield item, {"index": i + 1, "index0": i, "first": i == 0, "last": ahead is Mark.END}
        i += 1


def _body(statements: list) -> Callable[[dict], Iterator]:
    steps = [_statement(s) for s in statements]

    def run(env: dict) -> Iterator:
        for step in steps:
            yield from step(env)

    return run


def _statement(s) -> Callable[[dict], Iterable]:
    if isinstance(s, Emit):
        if isinstance(s.value, Const):
            text = _text(s.value.value)
            return lambda env: (text,)
        value = _value(s.value)
        return lambda env: (_text(value(env)),)
    if isinstance(s, Branch):
        cases, other = [(_value(c), _body(b)) for c, b in s.cases], _body(s.other)
        return lambda env: next((b for c, b in cases if c(env)), other)(env)
    if isinstance(s, Loop):
        over, inner = _value(s.over), _body(s.body)

        def loop(env: dict) -> Iterator:
            for item, at in _looped(over(env) or ()):
                yield from inner({**env, s.target: item, "loop": at})

        return loop
    if isinstance(s, Assign):
        value = _value(s.value)

        def assign(env: dict) -> tuple:
            env[s.target] = value(env)
            return ()

        return assign
    inner = _body(s.body)

    def generation(env: dict) -> Iterator:
        yield Mark.BEGIN
        yield from inner(env)
        yield Mark.END

    return generation


def compile_template(source: str) -> Callable[[dict], Iterator]:
    """A function from variables to a stream of texts and generation marks."""
    run = _body(fold(parse(source)))
    return lambda variables: run(dict(variables))


# The format

#: Control strings of the format below; in a text they are broken by a backslash.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))

CHAT = """{%- for m in messages -%}
{{ '<s>' }}
{%- if m.role == 'user' -%}{{ '[INST] ' ~ (m.text|escape) ~ ' [/INST]' }}
{%- elif m.role == 'assistant' -%}{% generation %}{{ m.text|escape }}{% endgeneration %}
{%- else -%}{{ '[ROLE]' ~ (m.role|escape) ~ '[/ROLE]' ~ (m.text|escape) }}
{%- endif -%}
{{ '</s>' }}
{%- endfor -%}"""


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of control strings."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return re.sub(r"\\(\\?)", r"\1", text)


_TURN = re.compile(r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)|(?P<assistant>.*?))</s>", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a conversation, or a run of whole turns, in the format above."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["text"])))
        else:
            out.append(("assistant", unescape(m["assistant"])))
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


# Conversations

#: A conversation goes out in segments of whole turns of about so many characters.
SEGMENT = 1 << 20


@dataclass
class _Segment:
    texts: list = field(default_factory=list)
    spans: list = field(default_factory=list)
    size: int = 0


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Ids and message streams of rows that are ordered by conversation."""
    from itertools import groupby

    rows = ((i, {"turn": t, "role": r or "", "text": x or ""}) for b in batches for i, t, r, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda x: x[0]):
        yield key, (m for _, m in group)


def format_conversations(turns: DataFrame, template: str = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Conversations formatted by a template: id, segment, formatted text, spans to be learned (code points).

    Turns are taken by number, then role, then text.  A conversation has one
    segment unless it is longer than ``segment``; then it is cut after the
    template's own pieces that end a turn (``</s>``), so memory is bounded
    whatever a conversation holds.  Null roles and texts are empty ones, rows
    with a null id form one conversation, repeated rows are turns one by one, an
    empty table gives none, and further columns are ignored, whatever their names.
    """
    ordered = turns.select(
        turns[id_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text")
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "segment", "formatted", "spans"]
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        render = compile_template(template)
        out: list[tuple] = []
        held = 0

        def flush():
            ids, numbers, texts, spans = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], kind)], names)

        for key, messages in _conversations(batches):
            now, number, begin = _Segment(), 0, 0
            for piece in render({"messages": messages}):
                if piece is Mark.BEGIN:
                    begin = now.size
                elif piece is Mark.END:
                    now.spans.append((begin, now.size))
                else:
                    now.texts.append(piece)
                    now.size += len(piece)
                    if now.size >= segment and piece.endswith("</s>"):
                        out.append((key, number, "".join(now.texts), now.spans))
                        held += now.size
                        now, number = _Segment(), number + 1
                        yield flush()
                        out, held = [], 0
            if now.size or not number:
                out.append((key, number, "".join(now.texts), now.spans))
                held += now.size
            if held >= segment:
                yield flush()
                out, held = [], 0
            for _ in messages:  # a template need not read them all
                pass
        if out:
            yield flush()

    return ordered.mapInArrow(run, "conv_id long, segment long, formatted string, spans array<struct<begin:long,end:long>>").select(F.col("conv_id").alias(id_col), "segment", "formatted", "spans")


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Counts and digests of turns and learned text, read back from formatted conversations.

    ``in_order`` tells that the rows come straight from
    :func:`format_conversations`, which gives a conversation's segments one
    after another in one task, so they needn't be shuffled again.
    """
    ordered = formatted.select(F.col(id_col).alias("conv_id"), "segment", "formatted", "spans")
    if not in_order:
        ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[tuple] = []
        key, started = None, False
        for i, _, text, spans in rows():
            if not started or i != key:
                if started:
                    out.append((key, n, turns.hexdigest(), learned, loss.hexdigest(), size))
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                key, started, n, learned, size, turns, loss = i, True, 0, 0, 0, sha256(), sha256()
            size += len(text)
            for role, said in read_turns(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            for s in spans:
                plain = unescape(text[s["begin"] : s["end"]])
                learned += len(plain)
                loss.update(plain.encode())
        if started:
            out.append((key, n, turns.hexdigest(), learned, loss.hexdigest(), size))
            yield batch_of(out)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv_id", id_col)
