"""Compile Python expressions to columns."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from . import scalar as S


class ExpressionError(ValueError):
    """The expression cannot be compiled; the message says which part."""


@dataclass(frozen=True)
class Value:
    """A compiled part: its column, its kind (bool, int, float, str or other), and whether it may be missing."""

    col: Column
    kind: str
    nullable: bool = True
    python: Any = None
    categories: tuple | None = None

    @property
    def number(self) -> Value:
        return Value(self.col.cast("int"), "int", self.nullable) if self.kind == "bool" else self


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.IntegralType):
        return "int"
    return "str" if isinstance(t, T.StringType) else "other"


def literal(x: Any) -> Value:
    kind = "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "str" if isinstance(x, str) else "other"
    if isinstance(x, Mapping):
        return Value(F.create_map(*[F.lit(v) for kv in x.items() for v in kv]), "other", False, x)
    if isinstance(x, (list, tuple)) and x:
        return Value(F.array(*[F.lit(v) for v in x]), "other", False, x)
    return Value(F.lit(x), kind, x is None, x)


#: Finds what a name means: (name,) for a bare name, (node, name) for a dotted one; None if unknown.
Resolver = Callable[[tuple[str, ...]], Value | None]

_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_MODULES = {"np", "numpy", "math"}
_CONSTANTS = {"nan": S.NAN, "inf": S.INF, "pi": 3.141592653589793, "e": 2.718281828459045}


#: A comment that opens with this word and a colon holds the expression that is compiled instead of the one before it.
OVERRIDE = "flow"


class Compiler:
    """Compiles expressions against a resolver.

    ``lookup`` handles calls on nodes that are not column functions: get, reverse, max and constant-bound subscripts.
    ``override_mark`` is the word that lets a comment replace its expression (None: no comment does).
    ``error_model`` is "numpy" (division by zero gives infinities and NaN) or "python" (it is an error).
    """

    def __init__(self, resolve: Resolver, *, functions: Mapping[str, Callable] | None = None, lookup: Callable[[str, str, tuple, str | None], Value | None] | None = None, is_node: Callable[[str], bool] = lambda name: False, error_model: str = "numpy", override_mark: str | None = OVERRIDE):
        self.resolve, self.functions, self.lookup, self.is_node, self.error_model = resolve, dict(functions or {}), lookup, is_node, error_model
        self.override_mark = override_mark

    def __call__(self, expression: str | float | bool) -> Value:
        if not isinstance(expression, str):
            return literal(expression)
        text = override(expression, self.override_mark)
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as e:
            raise ExpressionError(f"{text!r} is not an expression: {e.msg}") from e
        return self.visit(tree.body)

    def visit(self, n: ast.AST) -> Value:
        method = getattr(self, f"visit_{type(n).__name__}", None)
        if method is None:
            raise ExpressionError(f"{type(n).__name__} is not supported: {ast.unparse(n)}")
        return method(n)

    # --- names ---

    def named(self, *path: str) -> Value | None:
        return self.resolve(path)

    def visit_Constant(self, n: ast.Constant) -> Value:
        return literal(n.value)

    def visit_Name(self, n: ast.Name) -> Value:
        found = self.named(n.id)
        if found is None:
            raise KeyError(n.id)
        return found

    def visit_Attribute(self, n: ast.Attribute) -> Value:
        if isinstance(n.value, ast.Name):
            if n.value.id in _MODULES and n.attr in _CONSTANTS:
                return literal(_CONSTANTS[n.attr])
            if (found := self.named(n.value.id, n.attr)) is not None:
                return found
            raise KeyError(f"{n.value.id}.{n.attr}")
        raise ExpressionError(f"no such attribute: {ast.unparse(n)}")

    def visit_Subscript(self, n: ast.Subscript) -> Value:
        keys = _constants(n.slice)
        if isinstance(n.value, ast.Name) and self.is_node(n.value.id) and keys is not None:
            if len(keys) == 1:
                found = self.named(n.value.id, keys[0])
            else:
                found = self.lookup(n.value.id, keys[0], tuple(keys[1:]), None) if self.lookup else None
            if found is None:
                raise KeyError(f"{n.value.id}[{keys[0]!r}]")
            return found
        base = self.visit(n.value)
        if isinstance(base.python, Mapping) and keys is not None and len(keys) == 1 and keys[0] in base.python:
            return literal(base.python[keys[0]])
        if isinstance(base.python, (list, tuple)) and keys is not None and isinstance(keys[0], int):
            return literal(base.python[keys[0]])
        if isinstance(base.python, Mapping):
            sample = next(iter(base.python.values()))
            return Value(F.try_element_at(base.col, self.visit(n.slice).col), literal(sample).kind)
        if isinstance(base.python, (list, tuple)):
            return Value(F.get(base.col, self.visit(n.slice).col), literal(base.python[0]).kind)
        raise ExpressionError(f"cannot subscript {ast.unparse(n.value)}")

    # --- operators ---

    def visit_UnaryOp(self, n: ast.UnaryOp) -> Value:
        v = self.visit(n.operand)
        if isinstance(n.op, ast.Not):
            return Value(~self.truth(v), "bool", False)
        if isinstance(n.op, ast.Invert):
            return Value(~v.col, "bool", v.nullable) if v.kind == "bool" else Value(F.bitwise_not(v.col), "int", v.nullable)
        v = v.number
        if isinstance(n.op, ast.USub) and isinstance(v.python, (int, float)):
            return literal(-v.python)
        return Value(-v.col, v.kind, v.nullable) if isinstance(n.op, ast.USub) else v

    def visit_BinOp(self, n: ast.BinOp) -> Value:
        a, b = self.visit(n.left), self.visit(n.right)
        op = type(n.op)
        nullable = a.nullable or b.nullable
        if op in (ast.BitAnd, ast.BitOr, ast.BitXor):
            if a.kind == b.kind == "bool":
                x, y = self.truth(a), self.truth(b)
                return Value({ast.BitAnd: x & y, ast.BitOr: x | y, ast.BitXor: x != y}[op], "bool", False)
            x, y = a.number.col, b.number.col
            return Value({ast.BitAnd: x.bitwiseAND(y), ast.BitOr: x.bitwiseOR(y), ast.BitXor: x.bitwiseXOR(y)}[op], "int", nullable)
        if "str" in (a.kind, b.kind):
            raise ExpressionError(f"arithmetic on text: {ast.unparse(n)}")
        a, b = a.number, b.number
        whole = a.kind == b.kind == "int"
        kind = "int" if whole else "float"
        if op is ast.Add:
            return Value(a.col + b.col, kind, nullable)
        if op is ast.Sub:
            return Value(a.col - b.col, kind, nullable)
        if op is ast.Mult:
            return Value(a.col * b.col, kind, nullable)
        if op is ast.Div:
            if self.error_model == "python" or isinstance(b.python, (int, float)) and b.python:
                return Value(a.col.cast("double") / b.col.cast("double"), "float", nullable)
            return Value(S.divide(a.col, b.col), "float", nullable)
        if op is ast.FloorDiv:
            return Value(S.floor_divide(a.col, b.col, whole), kind, nullable)
        if op is ast.Mod:
            return Value(S.modulo(a.col, b.col, whole), kind, nullable)
        if op is ast.Pow:
            return Value(F.pow(a.col, b.col), "float", nullable)
        if op in (ast.LShift, ast.RShift) and isinstance(b.python, int):
            return Value(F.shiftleft(a.col, b.python) if op is ast.LShift else F.shiftright(a.col, b.python), "int", nullable)
        raise ExpressionError(f"operator {op.__name__} is not supported")

    def truth(self, v: Value) -> Column:
        if v.kind == "bool":
            return F.coalesce(v.col, F.lit(False)) if v.nullable else v.col
        if v.kind in ("int", "float"):
            return F.coalesce(v.col != 0, F.lit(False))
        raise ExpressionError("text has no truth value")

    def visit_BoolOp(self, n: ast.BoolOp) -> Value:
        parts = [self.truth(self.visit(v)) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if isinstance(n.op, ast.And) else (out | p)
        return Value(out, "bool", False)

    def compare(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            options = b.python if isinstance(b.python, (list, tuple)) else None
            if options is None:
                raise ExpressionError("'in' needs a list of constants")
            hit = F.coalesce(a.col.isin(list(options)), F.lit(False))
            return hit if isinstance(op, ast.In) else ~hit
        if (a.kind == "str") != (b.kind == "str"):
            raise ExpressionError("text is compared with something else")
        if a.kind == "bool" != b.kind or b.kind == "bool" != a.kind:
            a, b = a.number, b.number
        guard = None
        for v in (a, b):
            if v.kind == "float" and v.python is None:
                guard = ~F.isnan(v.col) if guard is None else guard & ~F.isnan(v.col)
            elif isinstance(v.python, float) and v.python != v.python:
                guard = F.lit(False)
        x = (a.col == b.col) if isinstance(op, (ast.Eq, ast.NotEq)) else getattr(a.col, _COMPARE[type(op)])(b.col)
        x = x & guard if guard is not None else x
        x = F.coalesce(x, F.lit(False)) if a.nullable or b.nullable else x
        return ~x if isinstance(op, ast.NotEq) else x

    def visit_Compare(self, n: ast.Compare) -> Value:
        sides = [self.visit(n.left), *[self.visit(x) for x in n.comparators]]
        out = None
        for op, a, b in zip(n.ops, sides, sides[1:], strict=False):
            c = self.compare(op, a, b)
            out = c if out is None else out & c
        return Value(out, "bool", False)

    def visit_IfExp(self, n: ast.IfExp) -> Value:
        return self.choose(self.visit(n.test), self.visit(n.body), self.visit(n.orelse))

    def choose(self, test: Value, a: Value, b: Value) -> Value:
        if a.kind != b.kind:
            a, b = a.number, b.number
        kind = a.kind if a.kind == b.kind else "float" if {a.kind, b.kind} <= {"int", "float"} else "other"
        return Value(F.when(self.truth(test), a.col).otherwise(b.col), kind, a.nullable or b.nullable)

    def visit_List(self, n: ast.List) -> Value:
        values = _constants(n)
        if values is None:
            raise ExpressionError("lists hold constants only")
        return literal(list(values))

    visit_Tuple = visit_List

    # --- calls ---

    def visit_Call(self, n: ast.Call) -> Value:
        keywords = {k.arg: k.value for k in n.keywords}
        if isinstance(n.func, ast.Name):
            return self.function(n.func.id, n.args, keywords)
        if isinstance(n.func, ast.Attribute):
            owner = n.func.value
            if isinstance(owner, ast.Name) and owner.id in _MODULES:
                return self.function(n.func.attr, n.args, keywords)
            if isinstance(owner, ast.Name) and self.is_node(owner.id) and n.func.attr in ("get", "reverse", "max"):
                return self.on_node(owner.id, n.func.attr, n.args, keywords)
            return self.method(n.func.attr, self.visit(owner), n.args, keywords)
        raise ExpressionError(f"cannot call {ast.unparse(n.func)}")

    def on_node(self, node: str, name: str, args: list, keywords: dict) -> Value:
        key = _constants(args[0])[0]
        if name == "get":
            default = args[1] if len(args) > 1 else keywords.get("default")
            try:
                found = self.named(node, key)
            except KeyError:
                found = None
            if found is not None:
                return found
            if default is None:
                raise KeyError(f"{node}.{key}")
            return self.visit(default)
        back = self.lookup(node, key, (), "reverse") if self.lookup else None
        if back is None:
            raise KeyError(f"{node}.{key}")
        if name == "reverse":
            return back
        forth = self.named(node, key)
        a, b = forth.col, back.col
        if forth.kind == "float":
            out = F.when(F.isnan(a) | a.isNull(), b).when(F.isnan(b) | b.isNull(), a).otherwise(F.greatest(a, b))
        else:
            out = F.greatest(a, b)
        return Value(out, forth.kind, True)

    def function(self, name: str, args: list, keywords: dict) -> Value:
        if name in self.functions:
            out = self.functions[name](*[self.visit(a).col for a in args], **{k: self.visit(v).col for k, v in keywords.items()})
            return out if isinstance(out, Value) else Value(out, "float")
        if name == "where":
            return self.choose(*[self.visit(a) for a in args])
        if name in ("clip", "piece"):
            bounds = [self.visit(a) for a in args[1:]]
            low = bounds[0] if bounds else self.visit(keywords["lower"]) if "lower" in keywords else None
            high = bounds[1] if len(bounds) > 1 else self.visit(keywords["upper"]) if "upper" in keywords else None
            return self.bounded(name, self.visit(args[0]), low, high)
        values = [self.visit(a).number for a in args]
        nullable = any(v.nullable for v in values)
        if name == "hard_sigmoid":
            return Value(S.hard_sigmoid(*[v.col for v in values]), "float", nullable)
        if name in ("max", "min", "maximum", "minimum", "fmax", "fmin"):
            if len(values) < 2:
                raise ExpressionError(f"{name} needs two or more values")
            out = values[0].col
            for v in values[1:]:
                out = S.larger(out, v.col) if "max" in name else S.smaller(out, v.col)
            return Value(out, "int" if all(v.kind == "int" for v in values) else "float", nullable)
        if name in ("isnan", "isna"):
            return Value(S.is_missing(values[0].col, values[0].kind == "float"), "bool", False)
        if name in ("power", "pow"):
            return Value(F.pow(values[0].col, values[1].col), "float", nullable)
        if name in ("divide", "true_divide"):
            return Value(S.divide(values[0].col, values[1].col), "float", nullable)
        if name in ("mod", "remainder", "floor_divide"):
            whole = all(v.kind == "int" for v in values)
            f = S.floor_divide if name == "floor_divide" else S.modulo
            return Value(f(values[0].col, values[1].col, whole), "int" if whole else "float", nullable)
        if name in S.BINARY:
            return Value(S.BINARY[name](*[v.col.cast("double") for v in values]), "float", nullable)
        if name in ("int", "float", "bool"):
            return self.cast(self.visit(args[0]), name)
        if name in S.UNARY:
            keeps = name in ("abs", "absolute", "square", "negative") and values[0].kind == "int"
            x = values[0].col if keeps else values[0].col.cast("double")
            return Value(S.UNARY[name](x), "int" if keeps or name in ("floor", "ceil") else "float", nullable)
        raise ExpressionError(f"no function {name}")

    def bounded(self, name: str, x: Value, low: Value | None, high: Value | None) -> Value:
        low, high = (None if v is None or v.kind == "other" and v.python is None else v for v in (low, high))
        kind = "float" if "float" in {v.kind for v in (x, low, high) if v is not None} else "int"
        f = S.clip if name == "clip" else S.piece
        return Value(f(x.number.col, low and low.col, high and high.col), kind, x.nullable)

    def cast(self, v: Value, to: str) -> Value:
        spark = {"int": "long", "float": "double", "bool": "boolean", "str": "string"}.get(to, to)
        kind = {"long": "int", "int": "int", "double": "float", "float": "float", "boolean": "bool", "string": "str"}.get(spark, "other")
        return Value(v.col.cast(spark), kind, v.nullable)

    def method(self, name: str, x: Value, args: list, keywords: dict) -> Value:
        if name == "clip":
            values = [self.visit(a) for a in args]
            low = values[0] if values else self.visit(keywords["lower"]) if "lower" in keywords else None
            high = values[1] if len(values) > 1 else self.visit(keywords["upper"]) if "upper" in keywords else None
            return self.bounded("clip", x, low, high)
        if name == "isin":
            options = self.visit(args[0]).python
            return Value(F.coalesce(x.col.isin(list(options)), F.lit(False)), "bool", False)
        if name == "between":
            a, b = self.visit(args[0]), self.visit(args[1])
            return Value(self.compare(ast.GtE(), x, a) & self.compare(ast.LtE(), x, b), "bool", False)
        if name in ("isna", "isnull", "isnan"):
            return Value(S.is_missing(x.col, x.kind == "float"), "bool", False)
        if name == "fillna":
            v = self.visit(args[0])
            return Value(F.when(S.is_missing(x.col, x.kind == "float"), v.col).otherwise(x.col), x.kind, v.nullable)
        if name == "astype":
            target = args[0].id if isinstance(args[0], ast.Name) else _constants(args[0])[0] if _constants(args[0]) else args[0].attr
            return self.cast(x, {"int32": "int", "int64": "long", "float32": "float", "float64": "double"}.get(target, target) if target not in ("int", "float") else target)
        if name == "apply":
            f = args[0]
            return self.function(f.id if isinstance(f, ast.Name) else f.attr, [_Done(x), *args[1:]], keywords)
        if name == "max" and args == []:
            return x
        raise ExpressionError(f"no method {name}")

    def visit__Done(self, n: _Done) -> Value:
        return n.value


class _Done(ast.AST):
    """A part that is compiled already."""

    def __init__(self, value: Value):
        super().__init__()
        self.value = value


def _constants(n: ast.AST) -> list | None:
    try:
        v = ast.literal_eval(n)
    except (ValueError, TypeError, SyntaxError):
        return None
    return list(v) if isinstance(v, (tuple, list)) else [v]


def override(expression: str, mark: str | None = OVERRIDE) -> str:
    """The expression after the mark in a comment, if there is one; other comments and marks in text mean nothing."""
    if mark is None or "#" not in expression:
        return expression
    try:
        for t in tokenize.generate_tokens(io.StringIO(expression).readline):
            if t.type == tokenize.COMMENT and (found := re.match(rf"#\s*{re.escape(mark)}\s*:\s*(.+)$", t.string)):
                return found[1]
    except (tokenize.TokenError, SyntaxError):
        pass  # the parser will say what is wrong
    return expression
