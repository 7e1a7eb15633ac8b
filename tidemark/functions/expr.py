"""The condition language: text to tree to Spark column.

A tree is made by operator precedence, then compiled against typed bindings: a name is bound to a column and its type,
and every operator picks its Spark form by the operands' types. What the types already show to be wrong is an error when
the expression is compiled; what only a row can show (a missing key, a division by zero, an index out of range, null
where a value is needed) raises in that row, or gives null with on_error="null".

Arrays and maps have one element type; numbers are longs or doubles.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.faults import ExpressionError, ExpressionEvaluation, ExpressionSyntax, UnknownFunction, UnknownVariable
from tidemark.functions.scalars import duration_seconds, parse_duration

NEST = 64
KEYWORDS = {"and", "or", "not", "in", "true", "false", "null"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "0": "\0"}
TOKEN = re.compile(
    r"""\s*(?:(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<op>==|!=|<=|>=|//|\?\?|[-+<>*/%()\[\],.]))"""
)


@dataclass(frozen=True)
class Node:
    """kind: literal, list, name, attribute, index, call, unary, logical, coalesce, binary. value: literal, name or operator."""

    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()
    at: int = 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and render(self) == render(other)

    def __hash__(self) -> int:
        return hash(render(self))


# Text to tree --------------------------------------------------------------------------------------------------------


def _tokens(source: str) -> list[tuple[str, str, int]]:
    if not isinstance(source, str):
        raise ExpressionSyntax("an expression is a string")
    out, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = TOKEN.match(source, at)
        start = at + len(source[at:]) - len(source[at:].lstrip())
        if m is None:
            what = "string is not closed" if source[start] in "'\"" else f"unexpected {source[start]!r}"
            raise ExpressionSyntax(what, source, start)
        at, kind = m.end(), m.lastgroup
        if kind == "number" and at < end and re.match(r"\w", source[at]):
            raise ExpressionSyntax("number runs into a name", source, at)
        if kind == "word" and m[kind] in KEYWORDS:
            kind = "op" if m[kind] in ("and", "or", "not", "in") else "constant"
        out.append((kind, m[m.lastgroup], start))
    return [*out, ("end", "", len(source))]


def _unquote(text: str, source: str, at: int) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in ESCAPES:
            raise ExpressionSyntax(f"unknown escape \\{m[1]}", source, at + m.start())
        return ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, text[1:-1])


#: Binding strength of operators that stand between two operands; all join to the left.
BINDS = {"or": 1, "and": 2, **dict.fromkeys(["==", "!=", "<", "<=", ">", ">=", "in", "not in"], 4), "??": 5, "+": 6, "-": 6, "*": 7, "/": 7, "//": 7, "%": 7}
NOT, SIGN = 3, 8


class _Reader:
    def __init__(self, source: str):
        self.source, self.tokens, self.i, self.depth = source, _tokens(source), 0, 0

    def peek(self, ahead: int = 0) -> str:
        kind, text, _ = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return text if kind == "op" else ""

    def take(self, *texts: str) -> bool:
        if self.peek() in texts and self.peek():
            self.i += 1
            return True
        return False

    def fail(self, message: str):
        raise ExpressionSyntax(message, self.source, self.tokens[self.i][2])

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"expected {text!r}")

    def inside(self) -> Node:
        self.depth += 1
        if self.depth > NEST:
            self.fail(f"nested deeper than {NEST}")
        found = self.read(0)
        self.depth -= 1
        return found

    def read(self, floor: int) -> Node:
        left = self.prefix(floor)
        while True:
            op, at = self.peek(), self.tokens[self.i][2]
            width = 1
            if op == "not" and self.peek(1) == "in":
                op, width = "not in", 2
            if BINDS.get(op, 0) <= floor:
                return left
            self.i += width
            right = self.read(BINDS[op])
            kind = "logical" if op in ("and", "or") else "coalesce" if op == "??" else "binary"
            left = Node(kind, op, (left, right), at)

    def prefix(self, floor: int) -> Node:
        at = self.tokens[self.i][2]
        if floor < NOT and self.take("not"):
            return Node("unary", "not", (self.read(NOT - 1),), at)
        if self.peek() in ("-", "+"):
            minus = self.peek() == "-"
            self.i += 1
            operand = self.prefix(SIGN)
            return Node("unary", "-", (operand,), at) if minus else operand
        return self.postfix(self.atom())

    def postfix(self, node: Node) -> Node:
        while True:
            at = self.tokens[self.i][2]
            if self.take("."):
                kind, text, _ = self.tokens[self.i]
                if kind not in ("word", "constant") and text not in KEYWORDS:
                    self.fail("expected a name after '.'")
                self.i += 1
                node = Node("attribute", text, (node,), at)
            elif self.take("["):
                node = Node("index", None, (node, self.read(0)), at)
                self.need("]")
            elif self.peek() == "(":
                if node.kind != "name":
                    self.fail("only a name can be called")
                self.i += 1
                node = Node("call", node.value, self.items(")", self.read), node.at)
            else:
                return node

    def items(self, close: str, read: Callable[..., Node]) -> tuple[Node, ...]:
        out: list[Node] = []
        if self.take(close):
            return ()
        while True:
            out.append(read(0) if read == self.read else read())
            if not self.take(","):
                self.need(close)
                return tuple(out)
            if self.peek() == close:
                self.fail("trailing comma")

    def atom(self) -> Node:
        kind, text, at = self.tokens[self.i]
        if kind == "op" and text == "(":
            self.i += 1
            found = self.inside()
            self.need(")")
            return found
        if kind == "op" and text == "[":
            self.i += 1
            return Node("list", None, self.items("]", self.inside), at)
        if kind in ("op", "end"):
            self.fail("expression is empty" if len(self.tokens) == 1 else f"unexpected {text!r}" if text else "unexpected end")
        self.i += 1
        if kind == "word":
            return Node("name", text, (), at)
        if kind == "number":
            return Node("literal", float(text) if re.search(r"[.eE]", text) else int(text), (), at)
        if kind == "string":
            return Node("literal", _unquote(text, self.source, at), (), at)
        return Node("literal", {"true": True, "false": False, "null": None}[text], (), at)


@functools.lru_cache(maxsize=4096)
def parse(source: str) -> Node:
    reader = _Reader(source)
    found = reader.read(0)
    if reader.tokens[reader.i][0] != "end":
        reader.fail(f"unexpected {reader.tokens[reader.i][1]!r}")
    return found


# Trees ---------------------------------------------------------------------------------------------------------------


def walk(node: Node) -> Iterator[Node]:
    yield node
    for p in node.parts:
        yield from walk(p)


def depth(node: Node) -> int:
    return 1 + max(map(depth, node.parts), default=0)


def variables(node: Node) -> list[str]:
    return list(dict.fromkeys(n.value for n in walk(node) if n.kind == "name"))


def called(node: Node) -> list[str]:
    return list(dict.fromkeys(n.value for n in walk(node) if n.kind == "call"))


def references(node: Node, root: str) -> list[str]:
    """Names read from a root, as root.name or root["name"]."""
    found = []
    for n in walk(node):
        if n.parts and n.parts[0].kind == "name" and n.parts[0].value == root:
            if n.kind == "attribute":
                found.append(n.value)
            elif n.kind == "index" and n.parts[1].kind == "literal" and isinstance(n.parts[1].value, str):
                found.append(n.parts[1].value)
    return list(dict.fromkeys(found))


def render(node: Node) -> str:
    """Source that gives the same tree, all operations in parentheses."""
    p = [render(x) for x in node.parts]
    if node.kind == "literal":
        v = node.value
        if isinstance(v, str):
            return "'" + "".join({c: "\\" + k for k, c in ESCAPES.items() if c != '"'}.get(c, c) for c in v) + "'"
        return {True: "true", False: "false", None: "null"}[v] if v is None or isinstance(v, bool) else repr(v)
    if node.kind == "name":
        return str(node.value)
    if node.kind == "list":
        return f"[{', '.join(p)}]"
    if node.kind == "attribute":
        return f"{p[0]}.{node.value}"
    if node.kind == "index":
        return f"{p[0]}[{p[1]}]"
    if node.kind == "call":
        return f"{node.value}({', '.join(p)})"
    return f"({node.value} {p[0]})" if node.kind == "unary" else f"({p[0]} {node.value} {p[1]})"


# Tree to column ------------------------------------------------------------------------------------------------------

NULL, BOOL, LONG, DOUBLE, TEXT = T.NullType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


@dataclass(frozen=True)
class Value:
    """A column and its type; literal holds a constant's value, so that it can be checked while compiling."""

    col: Column
    type: T.DataType
    literal: object = None


def bind(column: Column | str, kind: T.DataType | str) -> Value:
    """A binding from a column and its Spark type; whole numbers become longs, other numbers doubles."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    column = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return Value(column.cast("long"), LONG)
    if isinstance(kind, (T.FloatType, T.DecimalType)):
        return Value(column.cast("double"), DOUBLE)
    return Value(column, kind)


def environment(df) -> dict[str, Value]:
    """Bindings of a DataFrame's columns by name."""
    return {f.name: bind(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.DoubleType)):
        return "number"
    names = {T.NullType: "null", T.BooleanType: "boolean", T.StringType: "string", T.ArrayType: "list", T.MapType: "object", T.StructType: "object"}
    return names.get(type(t), t.simpleString())


def truthy(v: Value) -> Column:
    """False for null, false, 0, and what is empty."""
    k = kind_of(v.type)
    if k == "null":
        return F.lit(False)
    if isinstance(v.type, T.StructType):
        return v.col.isNotNull() if v.type.fields else F.lit(False)
    test = {"boolean": lambda: v.col, "number": lambda: v.col != 0, "string": lambda: F.length(v.col) > 0}.get(k, lambda: F.size(v.col) > 0)()
    return F.coalesce(test, F.lit(False))


class Compiler:
    """Compiles trees against bindings. functions: more functions, name -> callable on Values."""

    def __init__(self, bindings: dict[str, Value], functions: dict[str, Callable[..., Value]] | None = None, on_error: str = "raise"):
        if on_error not in ("raise", "null"):
            raise ValueError("on_error is raise or null")
        self.bindings, self.functions, self.on_error, self.source = bindings, {**BUILTINS, **(functions or {})}, on_error, ""

    def compile(self, source: str) -> Value:
        self.source = source
        return self.visit(parse(source))

    def test(self, source: str) -> Column:
        """Whether the expression holds."""
        return truthy(self.compile(source))

    def fail(self, message: str, node: Node, kind: type[ExpressionError] = ExpressionEvaluation):
        raise kind(message, self.source, node.at)

    def guard(self, good: Column, value: Column, t: T.DataType, message: str, node: Node) -> Column:
        """value where good holds; elsewhere the error, or null."""
        bad = F.lit(None).cast(t) if self.on_error == "null" else F.raise_error(F.lit(f"{message} (at {node.at})")).cast(t)
        return F.when(F.coalesce(good, F.lit(False)), value).otherwise(bad)

    def common(self, a: Value, b: Value, node: Node) -> T.DataType:
        if a.type == b.type or kind_of(b.type) == "null":
            return a.type
        if kind_of(a.type) == "null":
            return b.type
        if kind_of(a.type) == kind_of(b.type) == "number":
            return DOUBLE
        if kind_of(a.type) == kind_of(b.type) == "list":
            return T.ArrayType(self.common(Value(a.col, a.type.elementType), Value(b.col, b.type.elementType), node))
        self.fail(f"no common type of {kind_of(a.type)} and {kind_of(b.type)}", node)

    def visit(self, node: Node) -> Value:
        return getattr(self, "_" + node.kind)(node)

    def _literal(self, node: Node) -> Value:
        v = node.value
        t = NULL if v is None else BOOL if isinstance(v, bool) else LONG if isinstance(v, int) else DOUBLE if isinstance(v, float) else TEXT
        return Value(F.lit(v).cast(t) if v is not None else F.lit(None), t, v)

    def _list(self, node: Node) -> Value:
        items = [self.visit(p) for p in node.parts]
        if not items:
            return Value(F.array(), T.ArrayType(NULL))
        t = functools.reduce(lambda a, b: Value(a.col, self.common(a, b, node)), items).type
        return Value(F.array(*[i.col.cast(t) for i in items]), T.ArrayType(t))

    def _name(self, node: Node) -> Value:
        if node.value not in self.bindings:
            self.fail(f"unknown name {node.value!r}", node, UnknownVariable)
        return self.bindings[node.value]

    def _member(self, target: Value, key: str, node: Node) -> Value:
        if isinstance(target.type, T.StructType):
            if key not in target.type.names:
                self.fail(f"no key {key!r} (there are: {', '.join(sorted(target.type.names)) or 'none'})", node)
            inner = bind(target.col.getField(key), target.type[key].dataType)
            return Value(self.guard(target.col.isNotNull(), inner.col, inner.type, f"cannot read {key!r} of null", node), inner.type)
        if isinstance(target.type, T.MapType):
            t = target.type.valueType
            inner = bind(F.try_element_at(target.col, F.lit(key)), t)
            return Value(self.guard(F.map_contains_key(target.col, key), inner.col, inner.type, f"no key {key!r}", node), inner.type)
        self.fail(f"cannot read {key!r} of {kind_of(target.type)}", node)

    def _attribute(self, node: Node) -> Value:
        return self._member(self.visit(node.parts[0]), node.value, node)

    def _index(self, node: Node) -> Value:
        target, key = map(self.visit, node.parts)
        if kind_of(target.type) == "object":
            if isinstance(key.literal, str):
                return self._member(target, key.literal, node)
            if isinstance(target.type, T.MapType) and kind_of(key.type) == kind_of(target.type.keyType):
                inner = bind(F.try_element_at(target.col, key.col), target.type.valueType)
                return Value(self.guard(F.map_contains_key(target.col, key.col), inner.col, inner.type, "no such key", node), inner.type)
            self.fail("this object needs a literal key", node)
        if kind_of(target.type) not in ("list", "string"):
            self.fail(f"cannot index {kind_of(target.type)}", node)
        if not isinstance(key.type, T.LongType):
            self.fail("an index is an integer", node)
        size = F.size(target.col) if kind_of(target.type) == "list" else F.length(target.col)
        place = F.when(key.col >= 0, key.col + 1).otherwise(key.col + size + 1).cast("int")
        if kind_of(target.type) == "list":
            inner = bind(F.try_element_at(target.col, F.when(place != 0, place).otherwise(F.lit(1))), target.type.elementType)
        else:
            inner = Value(F.substring(target.col, place, F.lit(1)), TEXT)
        return Value(self.guard((key.col >= -size) & (key.col < size), inner.col, inner.type, "index is out of range", node), inner.type)

    def _call(self, node: Node) -> Value:
        if node.value not in self.functions:
            self.fail(f"unknown function {node.value!r}", node, UnknownFunction)
        low, high = ARITY.get(node.value, (0, None))
        if not low <= len(node.parts) <= (len(node.parts) if high is None else high):
            self.fail(f"{node.value}() takes {low if low == high else f'{low} to {high}'} arguments", node)
        values = [self.visit(p) for p in node.parts]
        try:
            return self.functions[node.value](_Context(self, node), *values)
        except ExpressionError as e:
            self.fail(e.message, node)

    def _unary(self, node: Node) -> Value:
        v = self.visit(node.parts[0])
        if node.value == "not":
            return Value(~truthy(v), BOOL)
        if kind_of(v.type) != "number":
            self.fail(f"unary '-' needs a number, got {kind_of(v.type)}", node)
        return Value(-v.col, v.type, -v.literal if v.literal is not None else None)

    def _logical(self, node: Node) -> Value:
        a, b = map(self.visit, node.parts)
        t = self.common(a, b, node)
        first, second = (b, a) if node.value == "and" else (a, b)
        return Value(F.when(truthy(a), first.col.cast(t)).otherwise(second.col.cast(t)), t)

    def _coalesce(self, node: Node) -> Value:
        a, b = map(self.visit, node.parts)
        t = self.common(a, b, node)
        return Value(F.coalesce(a.col.cast(t), b.col.cast(t)), t)

    def equal(self, a: Value, b: Value) -> Column:
        ka, kb = kind_of(a.type), kind_of(b.type)
        if ka == "null" or kb == "null":
            return a.col.isNull() & b.col.isNull()
        if ka != kb or ka == "list" and kind_of(a.type.elementType) != kind_of(b.type.elementType):
            return a.col.isNull() & b.col.isNull()
        if isinstance(a.type, T.MapType):
            pairs = lambda v: F.array_sort(F.map_entries(v.col))
            return pairs(a).eqNullSafe(pairs(b))
        return a.col.eqNullSafe(b.col)

    def within(self, a: Value, b: Value, node: Node) -> Column:
        k = kind_of(b.type)
        if k == "string":
            if kind_of(a.type) != "string":
                self.fail("'in' on a string needs a string", node)
            return self.guard(a.col.isNotNull() & b.col.isNotNull(), F.contains(b.col, a.col), BOOL, "'in' on null", node)
        if isinstance(b.type, T.StructType):
            return a.col.isin(*b.type.names) if b.type.names else F.lit(False)
        if isinstance(b.type, T.MapType):
            return self.guard(b.col.isNotNull(), F.map_contains_key(b.col, a.col), BOOL, "'in' on null", node)
        if k == "list":
            one = Value(a.col, a.type)
            found = F.exists(b.col, lambda x: self.equal(one, Value(x, b.type.elementType)))
            return self.guard(b.col.isNotNull(), found, BOOL, "'in' on null", node)
        self.fail(f"'in' does not apply to {k}", node)

    def _binary(self, node: Node) -> Value:
        a, b = map(self.visit, node.parts)
        op, ka, kb = node.value, kind_of(a.type), kind_of(b.type)
        if op in ("==", "!="):
            same = self.equal(a, b)
            return Value(same if op == "==" else ~same, BOOL)
        if op in ("in", "not in"):
            found = self.within(a, b, node)
            return Value(found if op == "in" else ~found, BOOL)
        there = a.col.isNotNull() & b.col.isNotNull()
        if op in ("<", "<=", ">", ">="):
            if ka != kb or ka not in ("number", "string"):
                self.fail(f"cannot compare {ka} with {kb} using {op!r}", node)
            found = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
            return Value(self.guard(there, found, BOOL, "cannot compare null", node), BOOL)
        if op == "+" and ka == kb and ka in ("string", "list"):
            t = a.type if ka == "string" else T.ArrayType(self.common(Value(a.col, a.type.elementType), Value(b.col, b.type.elementType), node))
            return Value(self.guard(there, F.concat(a.col.cast(t), b.col.cast(t)), t, "'+' on null", node), t)
        if not ka == kb == "number":
            self.fail(f"operator {op!r} does not apply to {ka} and {kb}", node)
        t = LONG if isinstance(a.type, T.LongType) and isinstance(b.type, T.LongType) else DOUBLE
        x, y = a.col.cast(t), b.col.cast(t)
        if op in "+-*":
            return Value(self.guard(there, {"+": x + y, "-": x - y, "*": x * y}[op], t, f"{op!r} on null", node), t)
        safe = F.when(y != 0, y)
        if op == "/":
            t, found = DOUBLE, x.cast("double") / safe.cast("double")
        else:
            found = _floor_div(x, safe, t) if op == "//" else _floor_mod(x, safe, t)
        return Value(self.guard(there & (y != 0), found, t, "division by zero", node), t)


def _floor_mod(x: Column, y: Column, t: T.DataType) -> Column:
    rest = x % y
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest).cast(t)


def _floor_div(x: Column, y: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DoubleType):
        return F.floor((x - _floor_mod(x, y, t)) / y + F.lit(0.5)).cast("double")
    whole = F.call_function("div", x, y)
    return F.when((x % y != 0) & ((x < 0) != (y < 0)), whole - 1).otherwise(whole).cast("long")


# Functions -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Context:
    compiler: Compiler
    node: Node

    def need(self, good: bool, message: str) -> None:
        if not good:
            raise ExpressionError(f"{self.node.value}() {message}")

    def guard(self, good: Column, value: Column, t: T.DataType, message: str) -> Value:
        return Value(self.compiler.guard(good, value, t, f"{self.node.value}() {message}", self.node), t)


def _len(c, v):
    k = kind_of(v.type)
    c.need(k in ("null", "string", "list", "object"), f"does not apply to {k}")
    if k == "null":
        return Value(F.lit(0).cast("long"), LONG)
    if isinstance(v.type, T.StructType):
        return Value(F.lit(len(v.type.names)).cast("long"), LONG)
    return Value(F.coalesce(F.length(v.col) if k == "string" else F.size(v.col), F.lit(0)).cast("long"), LONG)


def _loosely_equal(a: Value, b: Value) -> Column:
    """Equality that takes true for 1."""
    number = lambda v: v.col.cast("double") if kind_of(v.type) in ("number", "boolean") else v.col
    if {kind_of(a.type), kind_of(b.type)} <= {"number", "boolean"}:
        return number(a).eqNullSafe(number(b))
    return a.col.eqNullSafe(b.col) if kind_of(a.type) == kind_of(b.type) else a.col.isNull() & b.col.isNull()


def _contains(c, h, n):
    k = kind_of(h.type)
    c.need(k in ("null", "string", "list", "object"), f"does not apply to {k}")
    if k == "null":
        return Value(F.lit(False), BOOL)
    if k == "string":
        c.need(kind_of(n.type) == "string", "on a string needs a string")
        found = F.contains(h.col, n.col)
    elif k == "list":
        found = F.exists(h.col, lambda x: _loosely_equal(n, Value(x, h.type.elementType)))
    else:
        found = n.col.isin(*h.type.names) if isinstance(h.type, T.StructType) else F.map_contains_key(h.col, n.col)
    return Value(F.coalesce(found, F.lit(False)), BOOL)


def _has(c, h, k):
    if isinstance(h.type, T.MapType):
        return Value(F.coalesce(F.map_contains_key(h.col, k.col), F.lit(False)), BOOL)
    if isinstance(h.type, T.StructType):
        return Value(k.col.isin(*h.type.names) if h.type.names else F.lit(False), BOOL)
    if kind_of(h.type) == "list" and isinstance(k.type, T.LongType):
        return Value(F.coalesce((k.col >= -F.size(h.col)) & (k.col < F.size(h.col)), F.lit(False)), BOOL)
    return Value(F.lit(False), BOOL)


def _get(c, h, k, fallback=None):
    fallback = fallback or Value(F.lit(None), NULL)
    if isinstance(h.type, T.StructType) and isinstance(k.literal, str) and k.literal in h.type.names:
        inner = bind(h.col.getField(k.literal), h.type[k.literal].dataType)
    elif isinstance(h.type, T.MapType):
        inner = bind(F.try_element_at(h.col, k.col), h.type.valueType)
    elif kind_of(h.type) == "list" and isinstance(k.type, T.LongType):
        at = F.when(k.col >= 0, k.col + 1).otherwise(k.col).cast("int")
        inner = bind(F.try_element_at(h.col, at), h.type.elementType)
    else:
        return fallback
    t = c.compiler.common(inner, fallback, c.node)
    there = h.col.isNotNull() if isinstance(h.type, T.StructType) else _has(c, h, k).col
    return Value(F.when(there, inner.col.cast(t)).otherwise(fallback.col.cast(t)), t)


def _keys(c, v):
    c.need(kind_of(v.type) == "object", f"needs an object, got {kind_of(v.type)}")
    if isinstance(v.type, T.StructType):
        return Value(F.array(*[F.lit(n) for n in sorted(v.type.names)]), T.ArrayType(TEXT))
    return c.guard(v.col.isNotNull(), F.array_sort(F.map_keys(v.col)), T.ArrayType(v.type.keyType), "needs an object, got null")


def _values(c, v):
    c.need(isinstance(v.type, T.MapType), "needs an object of one type")
    found = F.transform(F.array_sort(F.map_keys(v.col)), lambda k: F.element_at(v.col, k))
    return c.guard(v.col.isNotNull(), found, T.ArrayType(v.type.valueType), "needs an object, got null")


def _sorted(c, v):
    if kind_of(v.type) == "string":
        return c.guard(v.col.isNotNull(), F.array_sort(F.filter(F.split(v.col, ""), lambda x: x != "")), T.ArrayType(TEXT), "needs a list")
    c.need(kind_of(v.type) == "list", f"needs a list, got {kind_of(v.type)}")
    return c.guard(v.col.isNotNull(), F.array_sort(v.col), v.type, "needs a list")


def _sum(c, v):
    c.need(kind_of(v.type) == "list", f"needs a list, got {kind_of(v.type)}")
    c.need(kind_of(v.type.elementType) in ("number", "null"), "needs numbers")
    good = v.col.isNotNull() & ~F.exists(v.col, lambda x: x.isNull())
    return c.guard(good, F.aggregate(v.col, F.lit(0.0), lambda a, x: a + x.cast("double")), DOUBLE, "needs numbers")


def _extreme(pick):
    def call(c, v):
        c.need(kind_of(v.type) == "list", f"needs a list, got {kind_of(v.type)}")
        return c.guard(F.size(v.col) > 0, pick(v.col), v.type.elementType, "of an empty list is undefined")

    return call


def _int(c, v):
    k = kind_of(v.type)
    c.need(k in ("boolean", "number", "string"), f"does not apply to {k}")
    if k == "string":
        trimmed = _trimmed(v.col)
        clean = F.regexp_replace(trimmed, "_", "")
        return c.guard(trimmed.rlike(r"^[+-]?\d+(_\d+)*$"), clean.try_cast("long"), LONG, "cannot read this text")
    return c.guard(v.col.isNotNull(), v.col.cast("long"), LONG, "does not apply to null")


def _number(c, v):
    k = kind_of(v.type)
    c.need(k in ("boolean", "number", "string"), f"does not apply to {k}")
    found = _trimmed(v.col).try_cast("double") if k == "string" else v.col.cast("double")
    return c.guard(found.isNotNull(), found, DOUBLE, "cannot read this value")


def text_of(v: Value) -> Column:
    """Text of a scalar: nothing for null, whole numbers without a point."""
    k = kind_of(v.type)
    if k == "null":
        return F.lit("")
    if isinstance(v.type, T.DoubleType):
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e18)
        found = F.when(whole, v.col.cast("decimal(38,0)").cast("string")).otherwise(v.col.cast("string"))
    else:
        found = v.col.cast("string")
    return F.coalesce(found, F.lit(""))


def _string(c, v):
    c.need(kind_of(v.type) in ("null", "boolean", "number", "string"), "needs a scalar here")
    return Value(text_of(v), TEXT)


def _coalesce_of(c, *vs):
    t = functools.reduce(lambda a, b: Value(a.col, c.compiler.common(a, b, c.node)), vs).type
    return Value(F.coalesce(*[v.col.cast(t) for v in vs]), t)


def _join(c, v, sep=None):
    c.need(kind_of(v.type) == "list", f"needs a list, got {kind_of(v.type)}")
    c.need(sep is None or kind_of(sep.type) == "string", "separator must be a string")
    texts = F.transform(v.col, lambda x: text_of(Value(x, v.type.elementType)))
    return c.guard(v.col.isNotNull(), _joined(texts, sep.col if sep else F.lit(",")), TEXT, "needs a list")


def _joined(texts: Column, sep: Column) -> Column:
    return F.aggregate(
        texts, F.struct(F.lit("").alias("s"), F.lit(True).alias("first")),
        lambda a, x: F.struct(F.when(a["first"], x).otherwise(F.concat(a["s"], sep, x)).alias("s"), F.lit(False).alias("first")), lambda a: a["s"],
    )


def _texts(*vs):
    return all(kind_of(v.type) == "string" for v in vs)


def _there(*vs):
    return functools.reduce(lambda a, b: a & b, [v.col.isNotNull() for v in vs])


def _split(c, v, sep=None):
    sep = sep or Value(F.lit(","), TEXT, ",")
    c.need(_texts(v, sep), "needs two strings")
    quoted = F.concat(F.lit("\\Q"), F.replace(sep.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return c.guard(_there(v, sep) & (sep.col != ""), F.split(v.col, quoted, -1), T.ArrayType(TEXT), "separator must not be empty")


def _trimmed(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _on_text(fn, t=TEXT):
    def call(c, *vs):
        c.need(_texts(*vs), "needs " + ("a string" if len(vs) == 1 else "strings"))
        return c.guard(_there(*vs), fn(*[v.col for v in vs]), t, "needs a string, got null")

    return call


def _replaced(s: Column, old: Column, new: Column) -> Column:
    every = F.concat(new, _joined(F.filter(F.split(s, ""), lambda x: x != ""), new), F.when(s == "", F.lit("")).otherwise(new))
    return F.when(old == "", every).otherwise(F.replace(s, old, new))


def _round(c, v, digits=None):
    number = _number(c, v)
    places = 0 if digits is None else digits.literal
    c.need(isinstance(places, int) and not isinstance(places, bool), "needs a literal number of places")
    # Halves of the binary value go to even; decimals of it are exact, so nothing else is a half.
    exact = number.col.cast("decimal(38,18)")
    return Value(F.bround(number.col if abs(places) > 15 else exact, places).cast("double"), DOUBLE)


def _some(test):
    def call(c, v):
        c.need(kind_of(v.type) == "list", f"needs a list, got {kind_of(v.type)}")
        return c.guard(v.col.isNotNull(), test(v.col, lambda x: truthy(Value(x, v.type.elementType))), BOOL, "needs a list")

    return call


def _count(c, v, w):
    if kind_of(v.type) == "string":
        c.need(kind_of(w.type) == "string", "on a string needs a string")
        cut = F.length(F.replace(v.col, w.col, F.lit("")))
        found = F.when(w.col == "", F.length(v.col) + 1).otherwise((F.length(v.col) - cut) / F.greatest(F.lit(1), F.length(w.col)))
        return c.guard(_there(v, w), found.cast("long"), LONG, "does not apply to null")
    c.need(kind_of(v.type) == "list", f"does not apply to {kind_of(v.type)}")
    hits = F.size(F.filter(v.col, lambda x: _loosely_equal(w, Value(x, v.type.elementType))))
    return c.guard(v.col.isNotNull(), hits.cast("long"), LONG, "does not apply to null")


def _duration(c, v):
    if kind_of(v.type) == "number":
        return Value(v.col.cast("double"), DOUBLE)
    c.need(kind_of(v.type) == "string", f"does not apply to {kind_of(v.type)}")
    if isinstance(v.literal, str):
        try:
            return Value(F.lit(parse_duration(v.literal)), DOUBLE)
        except ValueError as e:
            raise ExpressionError(str(e)) from e
    return Value(duration_seconds(v.col), DOUBLE)


#: Least and most arguments; no most means any number.
ARITY = {
    "len": (1, 1), "contains": (2, 2), "get": (2, 3), "has": (2, 2), "keys": (1, 1), "values": (1, 1), "sorted": (1, 1), "sum": (1, 1), "min": (1, 1),
    "max": (1, 1), "int": (1, 1), "number": (1, 1), "string": (1, 1), "bool": (1, 1), "coalesce": (1, None), "is_null": (1, 1), "join": (1, 2),
    "split": (1, 2), "lower": (1, 1), "upper": (1, 1), "trim": (1, 1), "starts_with": (2, 2), "ends_with": (2, 2), "replace": (3, 3), "round": (1, 2),
    "abs": (1, 1), "any": (1, 1), "all": (1, 1), "count": (2, 2), "duration": (1, 1),
}

BUILTINS: dict[str, Callable[..., Value]] = {
    "len": _len, "contains": _contains, "get": _get, "has": _has, "keys": _keys, "values": _values, "sorted": _sorted, "sum": _sum,
    "min": _extreme(F.array_min), "max": _extreme(F.array_max), "int": _int, "number": _number, "string": _string,
    "bool": lambda c, v: Value(truthy(v), BOOL), "coalesce": _coalesce_of, "is_null": lambda c, v: Value(v.col.isNull(), BOOL), "join": _join, "split": _split,
    "lower": _on_text(F.lower), "upper": _on_text(F.upper), "trim": _on_text(_trimmed), "starts_with": _on_text(F.startswith, BOOL),
    "ends_with": _on_text(F.endswith, BOOL), "replace": _on_text(_replaced), "round": _round, "abs": lambda c, v: Value(F.abs(_number(c, v).col), DOUBLE),
    "any": _some(F.exists), "all": _some(F.forall), "count": _count, "duration": _duration,
}


def compile_expression(source: str, bindings: dict[str, Value], on_error: str = "raise") -> Column:
    return Compiler(bindings, on_error=on_error).compile(source).col
