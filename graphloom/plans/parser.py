"""The algebraic text language: operators nested as calls, and path patterns.

A recursive-descent parser over one token pattern.  Keywords are read where they are expected, so labels and
properties may be named like them.  ``-`` belongs to a name only in labels and types, so ``$0.a-1`` subtracts.
"""

from __future__ import annotations

import re

from graphloom.errors import QueryProcessingError
from graphloom.plans import logical as L
from graphloom.plans.expr import TYPES, Call, Lit, Op, Param, Var

TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*')|(?P<float>\d+\.\d+)|(?P<int>\d+(?![A-Za-z_]))|(?P<var>\$\d+)|(?P<param>\?\w+)|(?P<name>\w+)|(?P<sym>\|\||&&|==|!=|<>|<=|>=|<-|->|::|\.\.|[()\[\]{},:.*+\-/%<>=!]))")
AGGREGATES = ("count", "sum", "avg", "min", "max", "pcount")


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, bool]] = []
        at = 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise QueryProcessingError(f"cannot read {text[at:].strip()[:20]!r}")
            # whether white space stands before it: names with a minus are one word
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup) > at))
            at = m.end()
        self.at = 0

    # tokens

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in texts and self.tokens[self.at][0] != "str"

    def kind(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else None

    def fail(self, what: str):
        got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
        raise QueryProcessingError(f"expected {what}, found {got}")

    def take(self, *texts: str) -> str:
        if not self.peek(*texts):
            self.fail(" or ".join(texts))
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, *texts: str) -> bool:
        found = self.peek(*texts)
        self.at += found
        return found

    def of(self, kind: str) -> str:
        if self.kind() != kind:
            self.fail(kind)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def string(self) -> str:
        return self.of("str")[1:-1]

    def integer(self) -> int:
        return int(self.of("int"))

    def var(self) -> int:
        return int(self.of("var")[1:])

    def name(self, dashes: bool = False) -> str:
        if self.kind() not in ("name", "int"):
            self.fail("a name")
        out = self.tokens[self.at][1]
        self.at += 1
        while dashes and self.peek("-") and not self.tokens[self.at][2] and self.kind(1) in ("name", "int") and not self.tokens[self.at + 1][2]:
            out += "-" + self.tokens[self.at + 1][1]
            self.at += 2
        return out

    def listed(self, item) -> tuple:
        self.take("[")
        out = [item()]
        while self.accept(","):
            out.append(item())
        self.take("]")
        return tuple(out)

    # operators

    def query(self) -> L.Plan:
        plan = self.operator()
        if self.at < len(self.tokens):
            self.fail("the end")
        return plan

    def operator(self) -> L.Plan:
        name = self.of("name")
        read = getattr(self, f"op_{name.lower()}", None)
        if read is None or name.lower() not in OPERATORS:
            raise QueryProcessingError(f"unknown operator {name}")
        self.take("(")
        plan = read()
        self.take(")")
        return plan

    def input(self) -> L.Plan:
        self.take(",")
        return self.operator()

    def op_nodescan(self):
        if self.peek("["):
            return L.NodeScan(self.listed(self.string))
        return L.NodeScan((self.string(),)) if self.kind() == "str" else L.NodeScan()

    def op_indexscan(self):
        label = self.string()
        self.take(",")
        key = self.string()
        self.take(",")
        return L.IndexScan((label,), key, self.value().value)

    def op_project(self):
        items = self.listed(self.projection)
        return L.Project(self.input(), items)

    def op_limit(self):
        n = self.integer()
        return L.Limit(self.input(), n)

    def op_crossjoin(self):
        left = self.operator()
        return L.Join(left, self.input(), "cross")

    def _join(self, how):
        cond = self.expression()
        left = self.input()
        return L.Join(left, self.input(), how, cond)  # adaptive execution picks the join by the sides' sizes

    def op_hashjoin(self):
        return self._join("inner")

    op_join = op_hashjoin

    def op_leftouterjoin(self):
        return self._join("left")

    def op_foreachrelationship(self):
        direction = self.take("FROM", "TO", "ALL")
        self.take(",")
        type_ = self.string().lstrip(":")
        low = high = None
        pos = -1
        self.take(",")
        if self.kind() == "int":
            low = self.integer()
            self.take(",")
            high = self.integer()
            self.take(",")
        if self.kind() == "var":
            pos = self.var()
            self.take(",")
        return L.Foreach(self.operator(), direction, type_, low, high, pos)

    def op_expand(self):
        direction = self.take("IN", "OUT")
        self.take(",")
        label = self.string()
        return L.Expand(self.input(), direction, (label,) if label else None)

    def op_aggregate(self):
        aggs = self.listed(self.aggregate)
        return L.Aggregate(self.input(), aggs)

    def op_groupby(self):
        keys = self.listed(self.typed_var)
        self.take(",")
        aggs = self.listed(self.aggregate)
        return L.GroupBy(self.input(), keys, aggs)

    def op_union(self):
        left = self.operator()
        return L.Union((left, self.input()))

    def op_distinct(self):
        return L.Distinct(self.operator())

    def op_filter(self):
        cond = self.expression()
        return L.Filter(self.input(), cond)

    def op_sort(self):
        def key():
            v = self.typed_var()
            return v, self.take("DESC", "ASC") == "DESC"

        keys = self.listed(key)
        return L.Sort(self.input(), keys)

    def op_create(self):
        self.take("(")
        if self.kind() == "var":
            src = self.var()
            self.take(")")
            self.take("-")
            self.take("[")
            if not self.peek(":"):
                self.name()
            self.take(":")
            type_, props = self.name(True), self.properties()
            self.take("]")
            self.take("->")
            self.take("(")
            dst = self.var()
            self.take(")")
            return L.CreateRel(self.input(), src, dst, type_, props)
        self.name()
        self.take(":")
        label, props = self.name(True), self.properties()
        self.take(")")
        return L.CreateNode(label, props, self.input() if self.peek(",") else None)

    def op_removenode(self):
        return L.Remove(self.operator(), "node")

    def op_detachnode(self):
        return L.Remove(self.operator(), "detach")

    def op_removerelationship(self):
        return L.Remove(self.operator(), "rel")

    def op_algorithm(self):
        self.take("[")
        name = self.name()
        self.take(",")
        mode = self.take("TUPLE", "SET")
        args = []
        while self.accept(","):
            args.append(self.value().value)
        self.take("]")
        return L.Algorithm(self.input(), name, mode, tuple(args))

    # path patterns

    def op_match(self):
        self.bound: dict[str, int] = {}
        name, label, props = self.node_pattern()
        plan = L.NodeScan((label,))
        if name:
            self.bound[name] = 0
        if props:
            plan = L.Filter(plan, self.equalities(0, props))
        at = 0
        while not self.peek(")"):
            at += 2
            plan = self.path_component(plan, at)
        return plan

    def node_pattern(self):
        self.take("(")
        name = None if self.peek(":") else self.name()
        self.take(":")
        label, props = self.name(True), self.properties()
        self.take(")")
        return name, label, props

    def path_component(self, plan, at: int):
        """One relationship and its node, at bindings ``at - 1`` and ``at``; a node's name met before means that node."""
        left = self.take("<-", "->", "-")
        self.take("[")
        if not self.peek(":"):
            named = self.name()
            if named in self.bound:
                raise QueryProcessingError(f"{named} is bound already")
            self.bound[named] = -1
        self.take(":")
        type_ = self.name(True)
        low = high = None
        if self.accept("*"):
            low = self.integer()
            self.take("..")
            high = self.integer() if self.kind() == "int" else None
        self.take("]")
        right = self.take("<-", "->", "-")
        name, label, props = self.node_pattern()
        direction = {("-", "->"): "FROM", ("<-", "-"): "TO", ("-", "-"): "ALL"}.get((left, right))
        if direction is None:
            raise QueryProcessingError(f"{left}[:{type_}]{right} has no direction")
        plan = L.Foreach(plan, direction, type_, low, high)
        plan = L.HasLabel(plan, (label,)) if direction == "ALL" else L.Expand(plan, "OUT" if direction == "FROM" else "IN", (label,))
        if name in self.bound:
            before = self.bound[name]
            if before < 0:
                raise QueryProcessingError(f"{name} is a relationship")
            plan = L.Filter(plan, lambda env: env.ident(before) == env.ident(at))
        elif name:
            self.bound[name] = at
        return L.Filter(plan, self.equalities(-1, props)) if props else plan

    def properties(self) -> dict:
        out: dict = {}
        if self.accept("{"):
            while True:
                key = self.name()
                self.take(":")
                out[key] = self.value().value
                if not self.accept(","):
                    break
            self.take("}")
        return out

    @staticmethod
    def equalities(index: int, props: dict):
        out = None
        for key, value in props.items():
            e = Op("==", (Var(index, key), Lit(value)))
            out = e if out is None else Op("&&", (out, e))
        return out

    # expressions

    def value(self):
        if self.kind() == "str":
            return Lit(self.string())
        minus = -1 if self.accept("-") else 1
        if self.kind() == "float":
            return Lit(minus * float(self.of("float")))
        return Lit(minus * self.integer())

    def typed_var(self) -> Var:
        index = self.var()
        key = self.name() if self.accept(".") else None
        self.take(":")
        type_ = self.name()
        if type_ not in TYPES and type_ != "qresult":
            raise QueryProcessingError(f"unknown type {type_}")
        return Var(index, key, type_)

    def projection(self):
        return self.typed_var() if self.kind() == "var" else self.call(True)

    def aggregate(self):
        func = self.take(*AGGREGATES)
        self.take("(")
        arg = self.projection()
        self.take(")")
        return func, arg

    def call(self, typed: bool = False):
        space = self.take("pb", "udf")
        self.take("::")
        name = self.name()
        self.take("(")
        args = []
        while not self.peek(")"):
            args.append(self.typed_var() if self.kind() == "var" else self.value())
            if not self.accept(","):
                break
        self.take(")")
        return Call(space, name, tuple(args))

    LEVELS = ((("||", "or"), "||"), (("&&", "and"), "&&"), (("==", "=", "!=", "<>"), None), (("<", "<=", ">", ">="), None), (("+", "-"), None), (("*", "/", "%"), None))
    SPELLED = {"=": "==", "<>": "!="}

    def expression(self, level: int = 0):
        if level == len(self.LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        ops, fixed = self.LEVELS[level]
        while self.peek(*ops):
            op = self.take(*ops)
            left = Op(fixed or self.SPELLED.get(op, op), (left, self.expression(level + 1)))
        return left

    def unary(self):
        if self.accept("!", "not"):
            return Op("!", (self.unary(),))
        if self.accept("("):
            e = self.expression()
            self.take(")")
            return e
        if self.kind() == "var":
            index = self.var()
            return Var(index, self.name() if self.accept(".") else None)
        if self.kind() == "param":
            return Param(self.of("param")[1:])
        return self.call() if self.peek("pb", "udf") else self.value()


OPERATORS = {n[3:] for n in dir(Parser) if n.startswith("op_")}


def parse(text: str) -> L.Plan:
    return Parser(text).query()
