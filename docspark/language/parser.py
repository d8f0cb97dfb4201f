"""Parser of expressions and statements.

Operators are reduced one kind at a time over the whole list of operands, from the tightest kind
to the loosest, each from left to right: ``10 - 5 + 2`` is ``10 - (5 + 2)``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from .lexer import ParseError, Token, tokenize
from .nodes import (
    Array, At, Binary, Call, Command, CreateIndex, Delete, Document, DropCollection, DropIndex, Every, Follow, Group, Insert, Lambda, Lit, Member, Node, Param, Path, Pragma,
    Projection, Quantified, RenameCollection, Select, Update, Where, default_name,
)

COMPARISONS = ("LIKE", "BETWEEN", "IN", ">", ">=", "<", "<=", "!=", "=")
#: From the tightest to the loosest.
PRECEDENCE = ("%", "/", "*", "+", "-", *COMPARISONS, *(f"ANY {c}" for c in COMPARISONS), *(f"ALL {c}" for c in COMPARISONS), "AND", "OR")
LAMBDAS = ("MAP", "FILTER", "SORT")
AUTO_IDS = {"GUID": "GUID", "INT": "INT", "LONG": "LONG", "OBJECTID": "OBJECTID"}


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.k = text, tokenize(text), 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.k = min(self.k + 1, len(self.tokens) - 1)
        return t

    def fail(self, what: str = "") -> ParseError:
        t = self.now
        return ParseError(f"unexpected {t.text or 'end'!r} at {t.at}{': ' + what if what else ''} in {self.text!r}")

    def op(self, s: str) -> bool:
        return self.now.kind == "op" and self.now.text == s

    def word(self, *names: str) -> bool:
        return self.now.kind == "word" and self.now.text.upper() in names

    def accept(self, s: str) -> bool:
        if self.op(s) or self.word(s):
            self.take()
            return True
        return False

    def expect(self, s: str) -> Token:
        if not (self.op(s) or self.word(s)):
            raise self.fail(f"expected {s}")
        return self.take()

    def name(self) -> str:
        if self.now.kind != "word":
            raise self.fail("expected a name")
        return self.take().text

    def integer(self) -> int:
        if self.now.kind != "int":
            raise self.fail("expected a whole number")
        return self.take().value

    # expressions
    def operator(self) -> str | None:
        t = self.now
        if t.kind == "op" and t.text in ("%", "/", "*", "+", "-", ">", ">=", "<", "<=", "!=", "="):
            self.take()
            return t.text
        if self.word("LIKE", "BETWEEN", "IN", "AND", "OR"):
            return self.take().text.upper()
        if self.word("ANY", "ALL"):
            after = self.ahead()
            if after.text.upper() in COMPARISONS:
                kind = self.take().text.upper()
                return f"{kind} {self.take().text.upper()}"
        return None

    def expression(self, scope: str = "$") -> Node:
        operands, ops = [self.term(scope)], []
        while (op := self.operator()) is not None:
            ops.append(op)
            right = self.term(scope)
            if op.endswith("BETWEEN"):
                self.expect("AND")
                right = Array((right, self.term(scope)))
            operands.append(right)
        for kind in PRECEDENCE:
            k = 0
            while k < len(ops):
                if ops[k] == kind:
                    operands[k : k + 2] = [self.combine(ops.pop(k), operands[k], operands[k + 1])]
                else:
                    k += 1
        return operands[0]

    @staticmethod
    def combine(op: str, left: Node, right: Node) -> Node:
        return Quantified(op[:3], op[4:], left, right) if op[:4] in ("ANY ", "ALL ") else Binary(op, left, right)

    def term(self, scope: str) -> Node:
        t = self.now
        if t.kind == "op" and t.text in "+-" and self.ahead().kind in ("int", "double"):
            self.take()
            value = self.take().value
            return Lit(-value if t.text == "-" else value)
        if t.kind in ("int", "double", "string"):
            return Lit(self.take().value)
        if t.kind == "op":
            if t.text == "*":
                return self.source()
            if t.text == "{":
                return self.document(scope)
            if t.text == "[":
                self.take()
                return Array(tuple(self.items("]", scope)))
            if t.text == "(":
                self.take()
                inner = self.expression(scope)
                self.expect(")")
                return self.more(Group(inner))
            if t.text == "@":
                after = self.ahead()
                if after.kind in ("int", "word") and not after.spaced:
                    self.take()
                    return self.more(Param(self.take().text))
                return self.path(scope)
            if t.text == "$":
                return self.path(scope)
        if t.kind == "word":
            if self.word("TRUE", "FALSE", "NULL"):
                return Lit({"TRUE": True, "FALSE": False, "NULL": None}[self.take().text.upper()])
            if self.ahead().kind == "op" and self.ahead().text == "(":
                return self.call(scope)
            return self.path(scope)
        raise self.fail()

    def items(self, end: str, scope: str) -> list[Node]:
        out = []
        if self.accept(end):
            return out
        while True:
            out.append(self.expression(scope))
            if self.accept(end):
                return out
            self.expect(",")

    def call(self, scope: str) -> Node:
        name = self.take().text.upper()
        self.expect("(")
        if name in LAMBDAS:
            source = self.expression(scope)
            self.expect("=>")
            # over *, the element is a whole document
            body = self.expression("@")
            order = None
            if name == "SORT" and self.accept(","):
                order = self.expression(scope)
            self.expect(")")
            return self.more(Lambda(name, source, body, order))
        return self.more(Call(name, tuple(self.items(")", scope))))

    def more(self, node: Node) -> Node:
        steps: list = []
        self.steps(steps)
        return Follow(node, tuple(steps)) if steps else node

    def key(self) -> str:
        if self.now.kind in ("word", "string"):
            return str(self.take().value)
        raise self.fail("expected a field name")

    def document(self, scope: str) -> Document:
        self.expect("{")
        fields = []
        while not self.op("}"):
            at = self.k
            key = self.key() if not self.op("$") else self.take().text
            if self.accept(":"):
                value = self.expression(scope)
            else:  # { a } is { a: a }
                value = Path(scope, (Member(key),)) if self.tokens[at].text != "$" else Path("$")
            fields.append((key, value))
            if not self.accept(","):
                break
        self.expect("}")
        return Document(tuple(fields))

    def source(self) -> Node:
        self.expect("*")
        steps: list = []
        if self.op(".") and not self.now.spaced:
            self.take()
            steps.append(Member(self.key()) if not self.op("[") else self.bracket_member())
            self.steps(steps)
        elif self.op("[") and not self.now.spaced:
            self.steps(steps)
        return Path("*", tuple(steps))

    def bracket_member(self) -> Member:
        self.expect("[")
        if self.now.kind != "string":
            raise self.fail("expected a quoted field name")
        name = self.take().value
        self.expect("]")
        return Member(name)

    def path(self, scope: str) -> Path:
        steps: list = []
        if self.op("$") or self.op("@"):
            scope = self.take().text
        else:
            steps.append(Member(self.take().text))
        self.steps(steps)
        return Path(scope, tuple(steps))

    def steps(self, steps: list) -> None:
        while not self.now.spaced:
            if self.op(".") and (self.ahead().kind in ("word", "string") or self.ahead().text == "["):
                self.take()
                if self.op("["):
                    steps.append(self.bracket_member())
                else:
                    steps.append(Member(str(self.take().value)))
            elif self.op("["):
                self.take()
                if self.op("*") and self.ahead().text == "]":
                    self.take()
                    steps.append(Every())
                elif self.now.kind == "int" and self.ahead().text == "]":
                    steps.append(At(Lit(self.take().value)))
                elif self.op("-") and self.ahead().kind == "int":
                    self.take()
                    steps.append(At(Lit(-self.take().value)))
                else:
                    inner = self.expression("@")
                    steps.append(At(inner) if isinstance(inner, Param) else Where(inner))
                self.expect("]")
            else:
                return

    # projections
    def projection(self) -> Projection:
        fields: list[tuple[str, Node]] = []
        names: set[str] = set()
        counter = 1
        while True:
            node = self.expression()
            if self.word("FROM", "INTO") or self.now.kind == "end" or self.op(";") or self.op(","):
                alias = default_name(node)
            else:
                self.accept("AS")
                alias = self.name()
            if alias.lower() in names:
                alias, counter = f"{alias}{counter}", counter + 1
            names.add(alias.lower())
            fields.append((alias, node))
            if not self.accept(","):
                break
        only = fields[0][1]
        if len(fields) == 1 and (only == Path("$") or isinstance(only, Document) or (isinstance(only, Call) and only.name == "EXTEND")):
            return Projection(tuple(fields), only)
        return Projection(tuple(fields))

    # statements
    def collection(self) -> tuple[str, object]:
        name = self.name()
        options = None
        if self.accept("("):
            options = self.value()
            self.expect(")")
        return name, options

    def value(self) -> object:
        """A constant of extended JSON."""
        return constant(self.expression())

    def auto_id(self) -> str:
        if self.accept(":"):
            kind = self.name().upper()
            if kind not in AUTO_IDS:
                raise ParseError(f"unknown kind of id {kind}")
            return kind
        return "OBJECTID"

    def select(self, explain: bool = False) -> Select:
        self.expect("SELECT")
        q = Select(self.projection(), explain=explain)
        if self.accept("INTO"):
            q.into, q.into_options = self.collection()
            q.auto_id = self.auto_id()
        if self.accept("FROM"):
            q.source, q.options = self.collection()
        elif self.now.kind != "end" and not self.op(";"):
            raise self.fail()
        if self.accept("INCLUDE"):
            q.includes = [self.expression()]
            while self.accept(","):
                q.includes.append(self.expression())
        if self.accept("WHERE"):
            q.where = [self.expression()]
        if self.word("GROUP"):
            self.take()
            self.expect("BY")
            q.group_by = self.expression()
        if self.accept("HAVING"):
            q.having = self.expression()
        if self.word("ORDER"):
            self.take()
            self.expect("BY")
            q.order_by = self.expression()
            q.descending = self.accept("DESC")
            if not q.descending:
                self.accept("ASC")
        if self.accept("LIMIT"):
            q.limit = self.integer()
        if self.accept("OFFSET"):
            q.offset = self.integer()
        if self.accept("FOR"):
            self.expect("UPDATE")
            q.for_update = True
        return q

    def statement(self) -> object:
        t = self.now.text.upper()
        if t == "SELECT":
            out = self.select()
        elif t == "EXPLAIN":
            self.take()
            out = self.select(explain=True)
        elif t == "INSERT":
            self.take()
            self.expect("INTO")
            name, auto = self.name(), self.auto_id()
            self.expect("VALUES")
            docs = [self.value()]
            while self.accept(","):
                docs.append(self.value())
            out = Insert(name, docs, auto)
        elif t == "UPDATE":
            self.take()
            name = self.name()
            self.expect("SET")
            if self.op("{"):
                doc: Node = self.document("$")
            else:
                fields = []
                while True:
                    key = self.key()
                    self.expect("=")
                    fields.append((key, self.expression()))
                    if not self.accept(","):
                        break
                doc = Document(tuple(fields))
            out = Update(name, doc, self.expression() if self.accept("WHERE") else None)
        elif t == "DELETE":
            self.take()
            name = self.name()
            out = Delete(name, self.expression() if self.accept("WHERE") else None)
        elif t == "CREATE":
            self.take()
            unique = self.accept("UNIQUE")
            self.expect("INDEX")
            name = self.name()
            self.expect("ON")
            collection = self.name()
            self.expect("(")
            start = self.now.at
            node = self.expression()
            text = self.text[start : self.now.at].strip()
            self.expect(")")
            out = CreateIndex(name, collection, node, text, unique)
        elif t == "DROP":
            self.take()
            if self.accept("INDEX"):
                collection = self.name()
                self.expect(".")
                out = DropIndex(collection, self.name())
            else:
                self.expect("COLLECTION")
                out = DropCollection(self.name())
        elif t == "RENAME":
            self.take()
            self.expect("COLLECTION")
            name = self.name()
            self.expect("TO")
            out = RenameCollection(name, self.name())
        elif t == "PRAGMA":
            self.take()
            name = self.name().upper()
            assign = self.accept("=")
            out = Pragma(name, self.value() if assign else None, assign)
        elif t in ("BEGIN", "COMMIT", "ROLLBACK", "CHECKPOINT", "REBUILD"):
            self.take()
            if t == "BEGIN" and self.word("TRANS", "TRANSACTION"):
                self.take()
            out = Command(t, self.value() if t == "REBUILD" and self.op("{") else None)
        else:
            raise self.fail("expected a statement")
        self.accept(";")
        return out

    def end(self) -> None:
        if self.now.kind != "end":
            raise self.fail()


def constant(node: Node) -> object:
    """The value of literals, documents and arrays of literals; single-key extended forms are decoded."""
    if isinstance(node, Lit):
        return node.value
    if isinstance(node, Group):
        return constant(node.inner)
    if isinstance(node, Array):
        return [constant(x) for x in node.items]
    if isinstance(node, Document):
        return decode({k: constant(v) for k, v in node.fields})
    raise ParseError("only constants are allowed here")


def decode(doc: dict) -> object:
    """A document, or the value that an extended JSON form such as {"$date": "..."} stands for."""
    if len(doc) == 1 and isinstance(v := next(iter(doc.values())), (str, int, float)):
        match next(iter(doc)):
            case "$oid":
                return str(v)
            case "$guid":
                return str(v).lower()
            case "$date":
                at = dt.datetime.fromisoformat(str(v).replace("Z", "+00:00"))
                at = at if at.tzinfo else at.replace(tzinfo=dt.UTC)
                return at.replace(microsecond=at.microsecond // 1000 * 1000)
            case "$numberLong":
                return int(v)
            case "$numberDecimal":
                return Decimal(str(v))
            case "$binary":
                import base64

                return base64.b64decode(str(v))
            case "$minValue" | "$maxValue":
                return None
    return doc


def parse_expression(text: str) -> Node:
    p = _Parser(text)
    node = p.expression()
    p.end()
    return node


def parse_projection(text: str) -> Projection:
    p = _Parser(text)
    out = p.projection()
    p.end()
    return out


def parse_statement(text: str) -> object:
    """The first statement of ``text``; what follows its semicolon isn't read."""
    p = _Parser(text)
    out = p.statement()
    if p.tokens[p.k - 1].text != ";":
        p.end()
    return out
