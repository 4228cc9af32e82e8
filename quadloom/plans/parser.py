"""SPARQL 1.1 Query and Update: text to algebra.

Algebra nodes and expressions are small tuples whose first item names them:
  patterns  (unit,) (bgp, triples) (join, a, b) (optional, a, b, condition) (union, a, b) (minus, a, b)
            (filter, e, a) (extend, a, var, e) (values, vars, rows) (graph, term, a) (select, Query)
  triples   (s, p, o), p a term or a path: (pred, iri) (inv, x) (seq, x, y) (alt, x, y) (plus, x)
            (star, x) (maybe, x) (not, forward iris, backward iris)
  expressions  (var, name) (term, t) (op, name, args) (call, iri, args) (exists, pattern, negated)
            (agg, name, distinct, expression or None, separator)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..terms import OWL, RDF, RDFS, XSD, Blank, Iri, Literal, QueryError, Var, resolve

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
      |(?P<string>\"{3}(?:(?:"|"")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
      |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      |(?P<var>[?$][A-Za-z0-9_\u00b7-\U000effff]+)
      |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
      |(?P<number>(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)
      |(?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
      |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
      |(?P<punct>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?])""",
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", "\\": "\\", '"': '"', "'": "'"}
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
FUNCTIONS = set(
    "STR LANG LANGMATCHES DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER "
    "YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512 COALESCE IF STRLANG STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE".split()
)


def unescape(text: str) -> str:
    def one(m):
        c = m[1]
        if c[0] in "uU" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c not in ESCAPES:
            raise QueryError(f"bad escape \\{c}")
        return ESCAPES[c]

    return ESCAPE.sub(one, text) if "\\" in text else text


@dataclass
class Query:
    form: str
    pattern: tuple = ("unit",)
    select: list | None = None  # (var name, expression or None); None is *
    distinct: bool = False
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)
    group: list | None = None  # (var name, expression or None)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    froms: list | None = None
    named: list | None = None
    base: str | None = None


def variables(pattern) -> set[str]:
    """Names of the variables that a pattern can bind."""
    kind = pattern[0]
    if kind == "bgp":
        return {t.name for s, p, o in pattern[1] for t in (s, p, o) if isinstance(t, Var)}
    if kind in ("join", "union", "optional"):
        return variables(pattern[1]) | variables(pattern[2])
    if kind == "minus":
        return variables(pattern[1])
    if kind == "filter":
        return variables(pattern[2])
    if kind == "extend":
        return variables(pattern[1]) | {pattern[2]}
    if kind == "values":
        return set(pattern[1])
    if kind == "graph":
        return variables(pattern[2]) | ({pattern[1].name} if isinstance(pattern[1], Var) else set())
    if kind == "select":
        q = pattern[1]
        return {v for v, _ in q.select} if q.select is not None else visible(q.pattern)
    if kind == "frame":
        return set(pattern[1].scope)
    return set()


def visible(pattern) -> set[str]:
    """As `variables`, without those that stand for blank nodes."""
    return {v for v in variables(pattern) if not v.startswith("_")}


def has_aggregate(e) -> bool:
    if not isinstance(e, tuple):
        return False
    if e[0] == "agg":
        return True
    return any(has_aggregate(x) for part in e[1:] for x in (part if isinstance(part, list) else [part])) if e[0] in ("op", "call") else False


def expression_variables(e) -> set[str]:
    if e[0] == "var":
        return {e[1]}
    if e[0] in ("op", "call"):
        return set().union(*[expression_variables(x) for x in e[2]]) if e[2] else set()
    if e[0] == "agg":
        return expression_variables(e[3]) if e[3] else set()
    return set()


def plain_variables(e) -> set[str]:
    """Variables of an expression outside of its aggregates."""
    if e[0] == "agg":
        return set()
    if e[0] in ("op", "call"):
        return set().union(*[plain_variables(x) for x in e[2]]) if e[2] else set()
    return expression_variables(e)


class Parser:
    def __init__(self, text: str, base: str | None = None, prefixes: dict[str, str] | None = None):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.fresh = 0, base, 0
        self.prefixes = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL} | (prefixes or {})
        self.labels: dict[str, Var] = {}
        self.template = False

    # -- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "word" else ""

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.toks[self.at - 1] if self.at <= len(self.toks) else ("end", "")

    def punct(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind == "punct" and text in texts:
            self.at += 1
            return text
        return None

    def is_punct(self, *texts: str, ahead: int = 0) -> bool:
        kind, text = self.peek(ahead)
        return kind == "punct" and text in texts

    def want(self, text: str) -> None:
        if not self.punct(text):
            raise QueryError(f"expected {text!r}, found {self.peek()[1]!r}")

    def accept(self, *words: str) -> bool:
        if all(self.word(n) == w for n, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.accept(word):
            raise QueryError(f"expected {word}, found {self.peek()[1]!r}")

    def fresh_var(self) -> Var:
        self.fresh += 1
        return Var(f"_b{self.fresh}")

    # -- prologue
    def prologue(self) -> None:
        while True:
            if self.accept("PREFIX"):
                kind, text = self.take()
                if kind != "pname" or not text.endswith(":"):
                    raise QueryError("bad prefix")
                self.prefixes[text[:-1]] = self.iri_ref()
            elif self.accept("BASE"):
                self.base = self.iri_ref()
            else:
                return

    def iri_ref(self) -> str:
        kind, text = self.take()
        if kind != "iri":
            raise QueryError(f"expected an IRI, found {text!r}")
        return resolve(self.base, re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text[1:-1]))

    def iri(self) -> Iri:
        if self.peek()[0] == "iri":
            return Iri(self.iri_ref())
        kind, text = self.take()
        if kind != "pname":
            raise QueryError(f"expected an IRI, found {text!r}")
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise QueryError(f"unknown prefix {prefix}:")
        return Iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    # -- queries
    def query(self) -> Query:
        self.prologue()
        q = self.select() if self.word() == "SELECT" else self.construct() if self.word() == "CONSTRUCT" else self.ask() if self.word() == "ASK" else self.describe() if self.word() == "DESCRIBE" else None
        if q is None:
            raise QueryError(f"no query form: {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise QueryError(f"left over: {self.peek()[1]!r}")
        q.base = self.base
        return q

    def datasets(self, q: Query) -> None:
        while self.accept("FROM"):
            q.froms, q.named = q.froms or [], q.named or []
            if self.accept("NAMED"):
                q.named.append(self.iri().value)
            else:
                q.froms.append(self.iri().value)

    def ask(self) -> Query:
        self.need("ASK")
        q = Query("ask")
        self.datasets(q)
        self.accept("WHERE")
        q.pattern = self.group()
        self.modifiers(q)
        return q

    def describe(self) -> Query:
        self.need("DESCRIBE")
        q = Query("describe")
        if not self.punct("*"):
            while self.peek()[0] in ("var", "iri", "pname"):
                q.describe.append(Var(self.take()[1][1:]) if self.peek()[0] == "var" else self.iri())
        self.datasets(q)
        if self.accept("WHERE") or self.is_punct("{"):
            q.pattern = self.group()
        self.modifiers(q)
        return q

    def construct(self) -> Query:
        self.need("CONSTRUCT")
        q = Query("construct")
        if self.is_punct("{"):
            q.template = self.triples_template()
            self.datasets(q)
            self.accept("WHERE")
            q.pattern = self.group()
        else:
            self.datasets(q)
            self.need("WHERE")
            at = self.at
            q.template = self.triples_template()
            self.at = at
            self.labels = {}
            q.pattern = self.group()
        self.modifiers(q)
        return q

    def triples_template(self) -> list:
        self.want("{")
        was, self.template, labels = self.template, True, self.labels
        self.labels = {}
        out: list = []
        while not self.punct("}"):
            self.triples_same_subject(out)
            if not self.punct("."):
                self.want("}")
                break
        self.template, self.labels = was, labels
        return out

    def select(self, sub: bool = False) -> Query:
        self.need("SELECT")
        q = Query("select")
        q.distinct = self.accept("DISTINCT")
        if not q.distinct:
            self.accept("REDUCED")
        if not self.punct("*"):
            q.select = []
            while True:
                if self.peek()[0] == "var":
                    q.select.append((self.take()[1][1:], None))
                elif self.punct("("):
                    e = self.expression()
                    self.need("AS")
                    q.select.append((self.var_name(), e))
                    self.want(")")
                else:
                    break
            if not q.select:
                raise QueryError("SELECT of nothing")
        if not sub:
            self.datasets(q)
        self.accept("WHERE")
        q.pattern = self.group()
        self.modifiers(q)
        self.check_scope(q)
        return q

    def var_name(self) -> str:
        kind, text = self.take()
        if kind != "var":
            raise QueryError(f"expected a variable, found {text!r}")
        return text[1:]

    def modifiers(self, q: Query) -> None:
        if self.accept("GROUP", "BY"):
            q.group = []
            while True:
                if self.peek()[0] == "var":
                    q.group.append((self.take()[1][1:], None))
                elif self.punct("("):
                    e = self.expression()
                    q.group.append((self.var_name() if self.accept("AS") else self.fresh_var().name, e))
                    self.want(")")
                elif self.peek()[0] in ("iri", "pname") or self.word() in FUNCTIONS:
                    q.group.append((self.fresh_var().name, self.primary()))
                else:
                    break
            if not q.group:
                raise QueryError("GROUP BY of nothing")
        if self.accept("HAVING"):
            while self.is_punct("(") or self.peek()[0] in ("iri", "pname") or self.word() in FUNCTIONS | AGGREGATES | {"EXISTS", "NOT"}:
                q.having.append(self.primary())
            if not q.having:
                raise QueryError("HAVING of nothing")
        if self.accept("ORDER", "BY"):
            while True:
                if self.word() in ("ASC", "DESC"):
                    down = self.take()[1].upper() == "DESC"
                    self.want("(")
                    q.order.append((self.expression(), down))
                    self.want(")")
                elif self.peek()[0] == "var":
                    q.order.append((("var", self.take()[1][1:]), False))
                elif self.is_punct("(") or self.peek()[0] in ("iri", "pname") or self.word() in FUNCTIONS | AGGREGATES:
                    q.order.append((self.primary(), False))
                else:
                    break
            if not q.order:
                raise QueryError("ORDER BY of nothing")
        for _ in range(2):
            if self.accept("LIMIT"):
                q.limit = self.integer()
            elif self.accept("OFFSET"):
                q.offset = self.integer()
        if self.accept("VALUES"):
            # joined before projection and slicing, as part of the query's pattern
            q.pattern = ("join", q.pattern, self.data_block())

    def integer(self) -> int:
        kind, text = self.take()
        if kind != "number" or not text.isdigit():
            raise QueryError(f"expected a whole number, found {text!r}")
        return int(text)

    def check_scope(self, q: Query) -> None:
        inside = visible(q.pattern)
        if q.select is None:
            if q.group is not None:
                raise QueryError("SELECT * with GROUP BY")
            return
        names = [v for v, _ in q.select]
        if len(set(names)) < len(names):
            raise QueryError("a variable is selected twice")
        for v, e in q.select:
            if e is not None and v in inside:
                raise QueryError(f"?{v} is bound already")
        grouped = q.group is not None or any(e is not None and has_aggregate(e) for _, e in q.select) or any(map(has_aggregate, q.having))
        if grouped:
            keys = {v for v, _ in q.group or []}
            for v, e in q.select:
                free = {v} if e is None else plain_variables(e)
                if free - keys:
                    raise QueryError(f"?{sorted(free - keys)[0]} is neither grouped nor aggregated")
                if e is not None:
                    keys |= {v}

    # -- graph patterns
    def group(self) -> tuple:
        self.want("{")
        if self.word() == "SELECT":
            q = self.select(sub=True)
            self.want("}")
            return ("select", q)
        whole: tuple = ("unit",)
        filters: list = []
        triples: list = []

        def flush():
            nonlocal whole, triples
            if triples:
                whole = join(whole, ("bgp", triples))
                triples = []

        while not self.punct("}"):
            if self.accept("FILTER"):
                filters.append(self.constraint())
            elif self.accept("OPTIONAL"):
                flush()
                right = self.group()
                condition = None
                if right[0] == "filter":  # its condition sees both sides
                    condition, right = right[1], right[2]
                whole = ("optional", whole, right, condition)
            elif self.accept("MINUS"):
                flush()
                whole = ("minus", whole, self.group())
            elif self.accept("BIND"):
                flush()
                self.want("(")
                e = self.expression()
                self.need("AS")
                v = self.var_name()
                self.want(")")
                if v in variables(whole):
                    raise QueryError(f"?{v} is bound already")
                whole = ("extend", whole, v, e)
            elif self.accept("VALUES"):
                flush()
                whole = join(whole, self.data_block())
            elif self.accept("GRAPH"):
                flush()
                g = Var(self.var_name()) if self.peek()[0] == "var" else self.iri()
                whole = join(whole, ("graph", g, self.group()))
            elif self.word() == "SERVICE":
                raise QueryError("SERVICE isn't supported")
            elif self.is_punct("{"):
                flush()
                side = self.group()
                while self.accept("UNION"):
                    side = ("union", side, self.group())
                # a nested group's filter sees that group alone, so it must not become its parent's
                whole = ("join", whole, side) if side[0] == "filter" else join(whole, side)
            else:
                self.triples_same_subject(triples)
                if self.is_punct("}") or self.word() in ("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH") or self.is_punct("{"):
                    continue
                self.want(".")
                continue
            self.punct(".")
        flush()
        for e in filters:
            whole = ("filter", ("op", "&&", [whole[1], e]), whole[2]) if whole[0] == "filter" and e is not filters[0] else ("filter", e, whole)
        return whole

    def constraint(self):
        if self.is_punct("("):
            self.want("(")
            e = self.expression()
            self.want(")")
            return e
        return self.primary()

    def data_block(self) -> tuple:
        if self.peek()[0] == "var":
            names = [self.var_name()]
            self.want("{")
            rows = []
            while not self.punct("}"):
                rows.append([self.data_value()])
            return ("values", names, rows)
        self.want("(")
        names = []
        while not self.punct(")"):
            names.append(self.var_name())
        self.want("{")
        rows = []
        while not self.punct("}"):
            self.want("(")
            row = []
            while not self.punct(")"):
                row.append(self.data_value())
            if len(row) != len(names):
                raise QueryError("a VALUES row has another length than its variables")
            rows.append(row)
        return ("values", names, rows)

    def data_value(self):
        if self.accept("UNDEF"):
            return None
        return self.term()

    # -- triples
    def term(self):
        kind, text = self.peek()
        if kind in ("iri", "pname"):
            return self.iri()
        if kind == "string":
            self.take()
            body = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "lang":
                return Literal(body, RDF + "langString", self.take()[1][1:].lower())
            if self.punct("^^"):
                return Literal(body, self.iri().value)
            return Literal(body)
        sign = ""
        if kind == "punct" and text in "+-" and self.peek(1)[0] == "number":
            sign = self.take()[1]
            kind, text = self.peek()
        if kind == "number":
            self.take()
            dt = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return Literal((sign if sign == "-" else "") + text, XSD + dt)
        if kind == "word" and text in ("true", "false"):
            self.take()
            return Literal(text, XSD + "boolean")
        raise QueryError(f"expected a term, found {text!r}")

    def node(self, out: list):
        """A subject or object, with the triples that its shorthand stands for."""
        kind, text = self.peek()
        if kind == "var":
            self.take()
            return Var(text[1:])
        if kind == "bnode":
            self.take()
            if self.template:
                return Blank(text[2:])
            return self.labels.setdefault(text, Var("_n" + text[2:]))
        if self.punct("["):
            me = self.new_node()
            if not self.punct("]"):
                self.properties(me, out)
                self.want("]")
            return me
        if self.punct("("):
            if self.punct(")"):
                return Iri(RDF + "nil")
            first = at = self.new_node()
            while True:
                out.append((at, Iri(RDF + "first"), self.node(out)))
                if self.punct(")"):
                    out.append((at, Iri(RDF + "rest"), Iri(RDF + "nil")))
                    return first
                then = self.new_node()
                out.append((at, Iri(RDF + "rest"), then))
                at = then
        return self.term()

    def new_node(self):
        v = self.fresh_var()
        return Blank(v.name) if self.template else v

    def triples_same_subject(self, out: list) -> None:
        shorthand = self.is_punct("[", "(")
        s = self.node(out)
        if shorthand and (self.is_punct(".", "}") or self.peek()[0] == "end"):
            return
        if isinstance(s, Literal):
            raise QueryError("a literal can't be a subject")
        self.properties(s, out)

    def properties(self, s, out: list) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.node(out)
                out.append((s, p, o))
                if not self.punct(","):
                    break
            if not self.punct(";"):
                return
            while self.punct(";"):
                pass
            if self.is_punct(".", "}", "]") or self.peek()[0] == "end":
                return

    def verb(self):
        kind, text = self.peek()
        if kind == "var":
            self.take()
            return Var(text[1:])
        if self.template:
            return self.plain_verb()
        path = self.path()
        return Iri(path[1]) if path[0] == "pred" else path

    def plain_verb(self) -> Iri:
        if self.peek() == ("word", "a"):
            self.take()
            return Iri(RDF + "type")
        return self.iri()

    def path(self):
        x = self.path_sequence()
        while self.punct("|"):
            x = ("alt", x, self.path_sequence())
        return x

    def path_sequence(self):
        x = self.path_element()
        while self.punct("/"):
            x = ("seq", x, self.path_element())
        return x

    def path_element(self):
        if self.punct("^"):
            return inverse(self.path_suffix())
        return self.path_suffix()

    def path_suffix(self):
        if self.punct("("):
            x = self.path()
            self.want(")")
        elif self.punct("!"):
            x = self.negated()
        else:
            x = ("pred", self.plain_verb().value)
        kind = {"*": "star", "+": "plus", "?": "maybe"}.get(self.punct("*", "+", "?") or "")
        return (kind, x) if kind else x

    def negated(self):
        ahead, back = [], []

        def one():
            (back if self.punct("^") else ahead).append(self.plain_verb().value)

        if self.punct("("):
            if not self.is_punct(")"):
                one()
                while self.punct("|"):
                    one()
            self.want(")")
        else:
            one()
        return ("not", ahead, back)

    # -- expressions
    def expression(self):
        x = self.conjunction()
        while self.punct("||"):
            x = ("op", "||", [x, self.conjunction()])
        return x

    def conjunction(self):
        x = self.relation()
        while self.punct("&&"):
            x = ("op", "&&", [x, self.relation()])
        return x

    def relation(self):
        x = self.sum()
        sign = self.punct("=", "!=", "<", ">", "<=", ">=")
        if sign:
            return ("op", sign, [x, self.sum()])
        if self.accept("IN"):
            return ("op", "in", [x, *self.arguments()])
        if self.accept("NOT", "IN"):
            return ("op", "!", [("op", "in", [x, *self.arguments()])])
        return x

    def arguments(self) -> list:
        self.want("(")
        out = []
        if not self.punct(")"):
            out.append(self.expression())
            while self.punct(","):
                out.append(self.expression())
            self.want(")")
        return out

    def sum(self):
        x = self.product()
        while True:
            sign = self.punct("+", "-")
            if not sign:
                return x
            x = ("op", sign, [x, self.product()])

    def product(self):
        x = self.unary()
        while True:
            sign = self.punct("*", "/")
            if not sign:
                return x
            x = ("op", sign, [x, self.unary()])

    def unary(self):
        if self.punct("!"):
            return ("op", "!", [self.unary()])
        if self.punct("-"):
            return ("op", "neg", [self.unary()])
        if self.punct("+"):
            return ("op", "pos", [self.unary()])
        return self.primary()

    def primary(self):
        kind, text = self.peek()
        if self.punct("("):
            e = self.expression()
            self.want(")")
            return e
        if kind == "var":
            self.take()
            return ("var", text[1:])
        if kind in ("iri", "pname"):
            name = self.iri()
            if self.is_punct("("):
                return ("call", name.value, self.arguments())
            return ("term", name)
        if kind == "word":
            w = text.upper()
            if w == "EXISTS":
                self.take()
                return ("exists", self.group(), False)
            if w == "NOT" and self.word(1) == "EXISTS":
                self.at += 2
                return ("exists", self.group(), True)
            if w in AGGREGATES:
                return self.aggregate(w)
            if w == "CAST":
                self.take()
                self.want("(")
                e = self.expression()
                self.need("AS")
                dt = self.iri().value
                self.want(")")
                return ("call", dt, [e])
            if w in FUNCTIONS:
                self.take()
                return ("op", w, self.arguments())
        return ("term", self.term())

    def aggregate(self, name: str):
        self.take()
        self.want("(")
        distinct, sep, e = self.accept("DISTINCT"), " ", None
        if name == "COUNT" and self.punct("*"):
            pass
        else:
            e = self.expression()
        if name == "GROUP_CONCAT" and self.punct(";"):
            self.need("SEPARATOR")
            self.want("=")
            sep = self.term().value
        self.want(")")
        return ("agg", name, distinct, e, sep)


def inverse(x):
    """A path walked backwards; the turn is pushed inwards."""
    kind = x[0]
    if kind == "pred":
        return ("inv", x)
    if kind == "inv":
        return x[1]
    if kind == "seq":
        return ("seq", inverse(x[2]), inverse(x[1]))
    if kind == "alt":
        return ("alt", inverse(x[1]), inverse(x[2]))
    if kind == "not":
        return ("not", x[2], x[1])
    return (kind, inverse(x[1]))


def join(a, b):
    """Join with the unit pattern folded and neighbouring basic patterns made one."""
    if a[0] == "unit":
        return b
    if b[0] == "unit":
        return a
    if a[0] == b[0] == "bgp":
        return ("bgp", [*a[1], *b[1]])
    return ("join", a, b)


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes=prefixes).query()


# -- updates
@dataclass
class Update:
    kind: str  # insert_data delete_data modify add copy move create clear drop load
    delete: list = field(default_factory=list)  # (graph term or None, s, p, o)
    insert: list = field(default_factory=list)
    pattern: tuple = ("unit",)
    scope: str | None = None  # WITH
    using: list | None = None
    using_named: list | None = None
    source: str | None = None
    target: str | None = None  # an IRI, DEFAULT, NAMED or ALL
    silent: bool = False


class UpdateParser(Parser):
    def updates(self) -> list[Update]:
        out: list[Update] = []
        data_labels: set[str] = set()
        self.prologue()
        while self.peek()[0] != "end":
            u = self.one()
            if u.kind == "insert_data":
                used = {t.label for q in u.insert for t in q[1:] if isinstance(t, Blank) and not t.label.startswith("_b")}
                if used & data_labels:
                    raise QueryError("a blank node label is used in two operations")
                data_labels |= used
            out.append(u)
            if not self.punct(";"):
                break
            self.prologue()
        if self.peek()[0] != "end":
            raise QueryError(f"left over: {self.peek()[1]!r}")
        return out

    def one(self) -> Update:
        if self.accept("INSERT", "DATA"):
            return Update("insert_data", insert=self.quads(no_vars=True))
        if self.accept("DELETE", "DATA"):
            return Update("delete_data", delete=self.quads(no_vars=True, no_blanks=True))
        if self.word() == "DELETE" and self.word(1) == "WHERE":
            self.at += 2
            delete = self.quads(no_blanks=True)
            return Update("modify", delete=delete, pattern=quads_pattern(delete))
        for w in ("ADD", "COPY", "MOVE"):
            if self.accept(w):
                silent = self.accept("SILENT")
                a = self.graph_or_default()
                self.need("TO")
                return Update(w.lower(), source=a, target=self.graph_or_default(), silent=silent)
        if self.accept("CREATE"):
            silent = self.accept("SILENT")
            self.need("GRAPH")
            return Update("create", target=self.iri().value, silent=silent)
        for w in ("CLEAR", "DROP"):
            if self.accept(w):
                silent = self.accept("SILENT")
                if self.word() in ("DEFAULT", "NAMED", "ALL"):
                    return Update("clear", target=self.take()[1].upper(), silent=silent)
                self.need("GRAPH")
                return Update("clear", target=self.iri().value, silent=silent)
        if self.accept("LOAD"):
            silent = self.accept("SILENT")
            a = self.iri().value
            b = "DEFAULT"
            if self.accept("INTO"):
                self.need("GRAPH")
                b = self.iri().value
            return Update("load", source=a, target=b, silent=silent)
        u = Update("modify")
        if self.accept("WITH"):
            u.scope = self.iri().value
        any_ = False
        if self.accept("DELETE"):
            u.delete, any_ = self.quads(no_blanks=True), True
        if self.accept("INSERT"):
            u.insert, any_ = self.quads(), True
        if not any_:
            raise QueryError(f"no update: {self.peek()[1]!r}")
        while self.accept("USING"):
            u.using, u.using_named = u.using or [], u.using_named or []
            if self.accept("NAMED"):
                u.using_named.append(self.iri().value)
            else:
                u.using.append(self.iri().value)
        self.need("WHERE")
        u.pattern = self.group()
        return u

    def graph_or_default(self) -> str:
        if self.accept("DEFAULT"):
            return "DEFAULT"
        self.accept("GRAPH")
        return self.iri().value

    def quads(self, no_vars: bool = False, no_blanks: bool = False) -> list:
        self.want("{")
        was, self.template = self.template, True
        out: list = []
        while not self.punct("}"):
            triples: list = []
            if self.accept("GRAPH"):
                g = Var(self.var_name()) if self.peek()[0] == "var" else self.iri()
                self.want("{")
                while not self.punct("}"):
                    self.triples_same_subject(triples)
                    if not self.punct("."):
                        self.want("}")
                        break
                out += [(g, *t) for t in triples]
                self.punct(".")
            else:
                self.triples_same_subject(triples)
                out += [(None, *t) for t in triples]
                if not self.punct(".") and not self.is_punct("}") and self.word() != "GRAPH":
                    raise QueryError(f"expected '.', found {self.peek()[1]!r}")
        self.template = was
        for q in out:
            if no_vars and any(isinstance(t, Var) for t in q):
                raise QueryError("data may hold no variables")
            if no_blanks and any(isinstance(t, Blank) for t in q):
                raise QueryError("a deletion may hold no blank nodes")
        return out


def quads_pattern(quads: list) -> tuple:
    whole: tuple = ("unit",)
    for g, s, p, o in quads:
        one: tuple = ("bgp", [(s, p, o)])
        whole = join(whole, one if g is None else ("graph", g, one))
    return whole


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[Update]:
    return UpdateParser(text, prefixes=prefixes).updates()
