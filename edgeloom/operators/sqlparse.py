"""A tolerant parser for the parts of SQL that say which tables are joined, and how.

It runs inside Python workers, so statements are parsed where their files are read and none goes to the driver. Only
FROM, WHERE, ON, USING, WITH, set operations and select lists are understood; other clauses are walked for subqueries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from edgeloom.functions.canonical import SPELLED

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>[rRbBxX]?'(?:[^'\\]|\\.|'')*')|(?P<quoted>`(?:[^`]|``)*`|"(?:[^"\\]|\\.|"")*")|(?P<bracket>\[[A-Za-z_][^\]\n,()']*\])|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d][\w$]*)|(?P<holder>\$\{[^}]*\}|\{\{.*?\}\}|\{[^}]*\}|[:@?]\w+|%s\b|\?)|(?P<op>\|>|<=>|<>|!=|==|<=|>=|\|\||->|=>|::|[-+*/%=<>(),.;\[\]:&|^~!])|(?P<other>.)""",
    re.S,
)
#: Words that end an expression or an alias.
ENDS = set("from where group having order limit union intersect except minus on using join inner left right full cross natural outer semi anti lateral when then else end and or as window qualify sort distribute cluster set values into tablesample pivot unpivot matched fetch offset returning for asof apply".split())
#: Tokens after an operand with which it goes on: as a comparison, as a larger operand; and those after a relation.
COMPARING = frozenset(["=", "==", "<>", "!=", "<", ">", "<=", ">=", "<=>", "not", "is", "between", "in", "like", "ilike", "rlike", "regexp"])
AFTER = frozenset(["::", "[", ".", "over", "filter", "within"])
JOINERS = ("join", "inner", "left", "right", "full", "cross", "natural", "outer", "semi", "anti", "asof")
JOINING = frozenset([",", "lateral", *JOINERS])


class SqlError(ValueError):
    pass


class Token:
    """low is a word's text in lower case, else the text: only words can be equal to a keyword, only operators to one."""

    __slots__ = ("kind", "text", "low", "line")

    def __init__(self, kind: str, text: str, line: int):
        self.kind, self.text, self.line = kind, text, line
        self.low = text.lower() if kind == "word" else text


@dataclass
class Relation:
    parts: tuple[str, ...] = ()  # of a table's name
    query: Query | None = None
    alias: str = ""
    kind: str = ""  # of the join that brings it
    on: tuple | None = None
    using: list[str] = field(default_factory=list)
    line: int = 0
    lateral: bool = False
    group: list[Relation] = field(default_factory=list)  # joins in parentheses, whose names are seen outside
    span: int = 1  # relations from this one on that its join brings

    @property
    def key(self) -> str:
        return self.alias or (self.parts[-1].lower() if self.parts else "")


@dataclass
class Query:
    """A SELECT, or with branches a set operation over queries."""

    relations: list[Relation] = field(default_factory=list)
    items: list[tuple[tuple, str]] = field(default_factory=list)
    where: tuple | None = None
    ctes: dict[str, Query] = field(default_factory=dict)
    branches: list[Query] = field(default_factory=list)
    inner: list[Query] = field(default_factory=list)  # queries inside expressions
    merge: tuple | None = None
    recursive: bool = False  # a CTE that may name itself


def tokens_of(text: str) -> list[Token]:
    return [Token(m.lastgroup, m.group(), 1) for m in TOKEN.finditer(text) if m.lastgroup != "space"]


def statements(text: str, line: int = 1) -> list[tuple[str, list[Token]]]:
    """The statements of a script, each with its tokens; semicolons in quotes and comments don't count."""
    out, begin, own = [], 0, []
    for m in TOKEN.finditer(text):
        kind, said = m.lastgroup, m.group()
        if said == ";":
            if own:
                out.append((text[begin : m.start()], own))
            begin, own = m.end(), []
        elif kind != "space":
            own.append(Token(kind, said, line))
        if "\n" in said:
            line += said.count("\n")
    if own:
        out.append((text[begin:], own))
    return out


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens = tokens
        self.end = Token("end", "", tokens[-1].line if tokens else 0)
        self.i = 0
        self.inner: list[Query] = []

    # tokens
    def peek(self, k: int = 0) -> Token:
        try:
            return self.tokens[self.i + k]
        except IndexError:
            return self.end

    def word(self, *words: str) -> bool:
        try:
            return self.tokens[self.i].low in words
        except IndexError:
            return False

    def op(self, text: str) -> bool:
        try:
            return self.tokens[self.i].low == text
        except IndexError:
            return False

    def take(self, *texts: str) -> bool:
        try:
            found = self.tokens[self.i].low in texts
        except IndexError:
            return False
        self.i += found
        return found

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SqlError(f"line {self.peek().line}: expected {text}, found {self.peek().text[:30] or 'the end'}")

    def name(self) -> str | None:
        t = self.peek()
        if t.kind in ("word", "quoted", "bracket", "holder"):
            self.i += 1
            return t.text if t.kind == "word" else re.sub(r"\W+", "_", t.text) if t.kind == "holder" else t.text[1:-1]
        return None

    # queries
    def statement(self) -> Query | None:
        """The query of a statement; a MERGE is one over its two relations; None if it has no query."""
        if self.word("merge"):
            return self.merge()
        while self.peek().kind != "end" and not (self.word("select", "with") or (self.word("from") and not self.i) or self.op("(")):
            self.i += 1
        if self.op("("):  # a column list of an INSERT, or a query in parentheses
            if not (self.peek(1).kind == "word" and self.peek(1).low in ("select", "with", "from", "(")):
                self.skip_group()
                return self.statement()
        if self.peek().kind == "end":
            return None
        query = self.query()
        while self.peek().kind != "end":  # what follows a query holds subqueries at most
            if self.op("(") and self.peek(1).kind == "word" and self.peek(1).low in ("select", "with"):
                self.i += 1
                self.inner.append(self.query())
            self.i += 1
        query.inner += self.inner
        self.inner = []
        return query

    def skip_group(self) -> None:
        self.need("(")
        depth = 1
        while depth and self.peek().kind != "end":
            depth += self.op("(") - self.op(")")
            self.i += 1

    def merge(self) -> Query:
        self.i += 1
        self.take("into")
        target = self.relation()
        self.need("using")
        source = self.relation()
        self.need("on")
        condition = self.expression()
        q = Query(relations=[target, source], inner=self.inner)
        q.merge = condition
        return q

    def query(self) -> Query:
        outer, self.inner = self.inner, []
        ctes: dict[str, Query] = {}
        if self.take("with"):
            recursive = self.take("recursive")
            while True:
                name = (self.name() or "").lower()
                if self.op("("):
                    self.skip_group()
                self.need("as")
                self.take("not")
                self.take("materialized")
                self.need("(")
                ctes[name] = self.query()
                ctes[name].recursive = recursive
                self.need(")")
                if not self.take(","):
                    break
            if self.word("insert", "merge", "update", "delete"):
                while self.peek().kind != "end" and not self.word("select", "from"):
                    self.i += 1
        first = self.core()
        branches = [first]
        while self.take("union", "intersect", "except", "minus"):
            self.take("all", "distinct")
            if self.take("by"):
                self.take("name")
            branches.append(self.core())
        self.tail()
        q = first if len(branches) == 1 else Query(branches=branches)
        q.ctes = ctes | q.ctes
        q.inner = q.inner + self.inner
        self.inner = outer
        return q

    def core(self) -> Query:
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        q = Query()
        kept, self.inner = self.inner, []
        if self.word("values"):
            self.tail()
        elif self.word("from"):  # FROM first
            self.i += 1
            self.relations(q)
            if self.take("select"):
                self.items(q)
        else:
            self.need("select")
            self.take("distinct", "all")
            self.items(q)
            if self.take("from"):
                self.relations(q)
        if self.take("where"):
            q.where = self.expression()
        while self.word("group", "having", "window", "qualify", "sort", "distribute", "cluster"):
            self.clause()
        while self.take("|>"):
            q = self.piped(q)
        q.inner, self.inner = q.inner + self.inner, kept
        return q

    def piped(self, q: Query) -> Query:
        """A query with one more pipe operator. What gives new columns or a new name encloses what was before."""
        over = lambda alias="": Query(relations=[Relation(query=q, alias=alias, line=self.peek().line)])
        if self.word(*JOINERS, "lateral") or self.op(","):
            q = q if not q.items and not q.branches else over()
            self.joins(q)
        elif self.take("where"):
            q = q if not q.items and not q.branches else over()
            e = self.expression()
            q.where = e if q.where is None else ("and", q.where, e)
        elif self.take("as"):
            q.items = q.items or [(("star",), "")]
            q = over((self.name() or "").lower())
        elif self.word("select", "extend", "aggregate"):
            kind = self.peek().low
            self.i += 1
            q = q if not q.items and not q.branches else over()
            if kind == "extend":
                q.items.append((("star",), ""))
            if kind != "aggregate" or not self.word("group"):
                self.take("distinct", "all")
                self.items(q)
            if kind == "aggregate" and self.take("group"):
                self.need("by")
                self.items(q)
        elif self.take("union", "intersect", "except", "minus"):
            self.take("all", "distinct")
            q = Query(branches=[q, self.core()])
        else:  # an operator that keeps or only drops columns and rows
            depth = 0
            while self.peek().kind != "end" and (depth or not (self.op("|>") or self.op(")"))):
                if self.op("(") and self.peek(1).kind == "word" and self.peek(1).low in ("select", "with"):
                    self.i += 1
                    self.inner.append(self.query())
                    self.need(")")
                    continue
                depth += self.op("(") - self.op(")")
                self.i += 1
        return q

    def clause(self) -> None:
        """Walks over a clause up to the next one, keeping the queries inside it."""
        self.i += 1
        depth = 0
        while self.peek().kind != "end":
            if self.op("(") and self.peek(1).kind == "word" and self.peek(1).low in ("select", "with"):
                self.i += 1
                self.inner.append(self.query())
                self.need(")")
                continue
            depth += self.op("(") - self.op(")")
            if depth < 0 or (not depth and (self.op("|>") or self.word("union", "intersect", "except", "minus", "order", "limit", "having", "window", "qualify", "sort", "distribute", "cluster", "group", "fetch", "offset") or self.op(";"))):
                return
            self.i += 1

    def tail(self) -> None:
        while self.word("order", "limit", "offset", "fetch", "values", "sort", "distribute", "cluster", "for"):
            self.clause()

    def items(self, q: Query) -> None:
        while True:
            e = self.expression()
            while e[0] == "star" and self.word("except", "exclude", "replace", "rename") and self.peek(1).text == "(":
                self.i += 1
                self.skip_group()
            alias = ""
            if self.take("as"):
                alias = self.name() or ""
                if self.op("("):
                    self.skip_group()
            elif self.peek().kind in ("word", "quoted", "bracket") and self.peek().low not in ENDS:
                alias = self.name() or ""
            q.items.append((e, alias.lower() or (e[-1].lower() if e[0] == "col" else "")))
            if not self.take(","):
                return

    def relations(self, q: Query) -> None:
        self.add(q, self.relation())
        self.joins(q)

    def add(self, q: Query, r: Relation) -> None:
        """A relation or, for joins in parentheses, its first one with the others behind it."""
        if r.group:
            first = r.group[0]
            first.kind, first.on, first.using, first.span = r.kind, r.on, r.using, len(r.group)
            q.relations += r.group
        else:
            q.relations.append(r)

    def joins(self, q: Query) -> None:
        while True:
            if self.peek().low not in JOINING:
                return
            if self.take(","):
                r = self.relation()
                r.kind = "lateral" if r.lateral else ","
            elif self.word("cross", "outer") and self.peek(1).low == "apply":
                kind = "cross" if self.word("cross") else "left"
                self.i += 2
                r = self.relation()
                r.kind, r.lateral = kind, True
            elif self.word("lateral") and self.peek(1).text != "(":
                self.i += 1
                self.take("view")
                self.take("outer")
                self.expression()
                while self.peek().kind in ("word", "quoted") and (self.peek().low not in ENDS or self.word("as")):
                    self.i += 1
                    self.take(",")
                continue
            elif self.word(*JOINERS):
                words = []
                while self.word(*JOINERS):
                    words.append(self.peek().low)
                    self.i += 1
                if words[-1] != "join":
                    raise SqlError(f"line {self.peek().line}: expected join")
                r = self.relation()
                r.kind = " ".join(w for w in words if w != "join") or "inner"
                if self.take("on"):
                    r.on = self.expression()
                elif self.take("using"):
                    self.need("(")
                    while not self.take(")"):
                        r.using.append((self.name() or "").lower())
                        self.take(",")
            elif self.word("lateral"):
                r = self.relation()
                r.kind = "lateral"
            else:
                return
            self.add(q, r)

    def relation(self) -> Relation:
        r = Relation(line=self.peek().line)
        r.lateral = self.take("lateral")
        self.take("only")
        joined = False
        if self.op("("):
            k = next(k for k in range(1, len(self.tokens)) if self.peek(k).text != "(")
            at, inner = self.i, list(self.inner)
            joined = self.peek(k).low not in ("select", "with", "from", "values")
            if not joined:
                try:
                    self.i += 1
                    r.query = self.query()
                    self.need(")")
                except SqlError:  # more than a query in the parentheses
                    if k == 1:
                        raise
                    self.i, self.inner, joined = at, inner, True
            if joined:
                self.i += 1
                r.query = Query(items=[(("star",), "")])
                self.relations(r.query)
                self.need(")")
        else:
            parts = [self.name()]
            if parts[0] is None:
                raise SqlError(f"line {r.line}: expected a table, found {self.peek().text[:30] or 'the end'}")
            while self.take("."):
                parts.append(self.name() or "")
            if self.op("("):  # a function that returns a table
                self.skip_group()
                parts = []
            r.parts = tuple(p.lower() for p in parts)
        if self.take("tablesample"):
            self.skip_group()
        while self.word("pivot", "unpivot"):
            self.i += 1
            self.skip_group()
        if self.take("as"):
            r.alias = (self.name() or "").lower()
        elif self.peek().kind in ("word", "quoted", "bracket") and self.peek().low not in ENDS:
            r.alias = (self.name() or "").lower()
        if r.alias and self.op("("):
            self.skip_group()
        if joined and not r.alias:
            r.group, r.query = r.query.relations, None
        return r

    # expressions
    def expression(self) -> tuple:
        return self.either()

    def either(self) -> tuple:
        xs = [self.both()]
        while self.take("or"):
            xs.append(self.both())
        return xs[0] if len(xs) == 1 else ("or", *(y for x in xs for y in (x[1:] if x[0] == "or" else (x,))))

    def both(self) -> tuple:
        xs = [self.negated()]
        while self.take("and"):
            xs.append(self.negated())
        return xs[0] if len(xs) == 1 else ("and", *(y for x in xs for y in (x[1:] if x[0] == "and" else (x,))))

    def negated(self) -> tuple:
        if self.take("not", "!"):
            return ("not", self.negated())
        return self.compared()

    def compared(self) -> tuple:
        a = self.sum()
        while True:
            t = self.peek()
            if t.low not in COMPARING:
                return a
            if t.kind == "op" and t.text in ("=", "==", "<>", "!=", "<", ">", "<=", ">=", "<=>"):
                self.i += 1
                self.take("any", "all", "some")
                a = ("bin", SPELLED.get(t.text, t.text), a, self.sum())
                continue
            negative = self.word("not") and self.peek(1).kind == "word" and self.peek(1).low in ("in", "between", "like", "ilike", "rlike", "regexp")
            if negative:
                self.i += 1
            if self.take("is"):
                no = self.take("not")
                if self.take("distinct"):
                    self.need("from")
                    b = ("bin", "IS NOT DISTINCT FROM", a, self.sum())
                    a = b if no else ("not", b)
                    continue
                self.i += 1  # null, true, false
                a = ("null", a) if self.tokens[self.i - 1].low == "null" else ("bin", "=", a, ("lit", self.tokens[self.i - 1].text.upper()))
                a = ("not", a) if no else a
                continue
            if self.take("between"):
                lo = self.sum()
                self.need("and")
                found = ("between", a, lo, self.sum())
            elif self.take("in"):
                self.need("(")
                if self.word("select", "with"):
                    found = ("in", a, ("query", self.nested()))
                else:
                    items = []
                    while not self.op(")"):
                        items.append(self.expression())
                        if not self.take(","):
                            break
                    found = ("in", a, *items)
                self.need(")")
            elif self.word("like", "ilike", "rlike", "regexp"):
                op = self.peek().text.upper()
                self.i += 1
                found = ("like", op, a, self.sum())
            else:
                return a
            a = ("not", found) if negative else found

    def sum(self) -> tuple:
        a = self.term()
        while self.word("+", "-", "||", "&", "|", "^"):
            op = self.peek().text
            self.i += 1
            a = ("bin", op, a, self.term())
        return a

    def term(self) -> tuple:
        a = self.unary()
        while self.word("*", "/", "%", "div"):
            op = self.peek().text
            self.i += 1
            a = ("bin", op, a, self.unary())
        return a

    def unary(self) -> tuple:
        if self.take("-", "+", "~"):
            x = self.unary()
            return ("lit", f"-{x[1]}") if x[0] == "lit" and self.tokens[self.i - 2].text == "-" else ("func", "NEG", x) if x[0] != "lit" else x
        x = self.primary()
        while True:
            t = self.peek()
            if t.low not in AFTER and t.kind != "holder":
                return x
            if self.take("::"):
                x = ("cast", x, self.type())
            elif self.take("["):
                x = ("func", "ELEMENT", x, self.expression())
                self.need("]")
            elif self.op(".") and x[0] not in ("col", "star", "lit"):
                self.i += 1
                self.name()
            elif x[0] != "lit" and self.peek().kind == "holder" and self.peek().text[0] == ":":  # a path into JSON
                self.i += 1
            elif self.word("over", "filter", "within"):
                while self.word("over", "filter", "within", "group"):
                    self.i += 1
                if self.op("("):
                    x = ("case", "OVER", x, *self.walked())
                else:
                    self.name()
            else:
                return x

    def walked(self) -> list[tuple]:
        """The columns inside parentheses whose contents aren't understood."""
        self.need("(")
        depth, out = 1, []
        while depth:
            t = self.peek()
            if t.kind == "end":
                raise SqlError("unclosed parenthesis")
            if self.op("(") and self.peek(1).kind == "word" and self.peek(1).low in ("select", "with"):
                self.i += 1
                self.inner.append(self.query())
                self.need(")")
                continue
            depth += self.op("(") - self.op(")")
            if t.kind == "word" and self.peek(1).text == "." and self.peek(2).kind in ("word", "quoted"):
                out.append(("col", t.text.lower(), self.peek(2).text.strip('`"').lower()))
                self.i += 2
            self.i += 1
        return out

    def type(self) -> str:
        text = self.name() or ""
        if self.op("("):
            begin = self.i
            self.skip_group()
            text += "".join(t.text for t in self.tokens[begin : self.i])
        elif self.op("<"):
            depth = 0
            while True:
                depth += self.peek().text.count("<") - self.peek().text.count(">")
                text += self.peek().text
                self.i += 1
                if depth <= 0 or self.peek().kind == "end":
                    break
        return text

    def nested(self) -> Query:
        q = self.query()
        self.inner.append(q)
        return q

    def primary(self) -> tuple:
        t = self.peek()
        if self.take("("):
            if self.word("select", "with"):
                x: tuple = ("query", self.nested())
            else:
                xs = [self.expression()]
                while self.take(","):
                    xs.append(self.expression())
                x = xs[0] if len(xs) == 1 else ("func", "", *xs)
            self.need(")")
            return x
        if t.kind in ("string", "number"):
            self.i += 1
            return ("lit", t.text)
        if self.take("*"):
            return ("star",)
        if t.kind == "word":
            low, after = t.low, self.peek(1)
            if low in ("null", "true", "false"):
                self.i += 1
                return ("lit", low.upper())
            if low == "exists" and after.text == "(":
                self.i += 2
                x = ("query", self.nested())
                self.need(")")
                return x
            if low == "case":
                self.i += 1
                xs = []
                while not self.take("end"):
                    if self.peek().kind == "end":
                        raise SqlError("unclosed case")
                    if not self.take("when", "then", "else"):
                        xs.append(self.expression())
                return ("case", "CASE", *xs)
            if low in ("cast", "try_cast") and after.text == "(":
                self.i += 2
                x = self.expression()
                self.need("as")
                x = ("cast", x, self.type())
                self.need(")")
                return x
            if low == "interval":
                self.i += 1
                said = ["INTERVAL"]
                while self.peek().kind in ("string", "number") or self.op("-") or (self.peek().kind == "word" and self.peek().low not in ENDS and (self.peek(-1).kind in ("string", "number") or said[-1] == "TO" or self.word("to"))):
                    said.append(self.peek().text.strip("'").upper())
                    self.i += 1
                units = [w[:-1] if w.endswith("S") and w.isalpha() else w for w in said]
                return ("lit", " ".join(units).replace("- ", "-"))
            if low in ("date", "timestamp") and after.kind == "string":
                self.i += 2
                return ("lit", f"{low.upper()} {after.text}")
            if after.text == "(" and after.kind == "op":
                self.i += 2
                self.take("distinct", "all")
                args: list[tuple] = []
                while not self.op(")"):
                    if self.word("select", "with"):
                        args.append(("query", self.nested()))
                    else:
                        args.append(self.argument())
                    if not (self.take(",") or self.word("from", "for", "order", "separator", "as", "ignore", "respect", "in")):
                        break
                    if self.word("order", "separator", "ignore", "respect", "as", "from", "for", "in"):
                        self.i += 1
                        self.take("by", "nulls")
                self.need(")")
                return ("func", t.text, *args)
            if low in ENDS and low not in ("left", "right", "end", "set", "values"):
                raise SqlError(f"line {t.line}: unexpected {t.text}")
        first = self.name()
        if first is None:
            raise SqlError(f"line {t.line}: unexpected {t.text[:30] or 'end'}")
        parts = [first.lower()]
        while self.op("."):
            self.i += 1
            if self.take("*"):
                return ("star", *parts)
            if self.peek().kind == "number":
                parts.append(self.peek().text)
                self.i += 1
            else:
                parts.append((self.name() or "").lower())
        if len(parts) > 1 and self.op("(") and self.peek().kind == "op":  # a function with a dotted name
            return ("func", ".".join(parts), *self.walked())
        if t.kind == "quoted" and t.text[0] == '"' and len(parts) == 1:
            return ("lit", t.text)
        if t.kind == "holder" and len(parts) == 1:
            return ("lit", t.text)
        return ("col", *parts)

    def argument(self) -> tuple:
        if self.op("(") and any(self.peek(k).text == "->" for k in range(2, 8)):
            while not self.take("->"):
                self.i += 1
        x = self.expression()
        if self.take("->", "=>"):
            x = self.expression()
        if self.word("asc", "desc"):
            self.i += 1
        return x
