"""A SELECT front-end: SPARQL text to an algebra, and the algebra to a DataFrame over the triple table.

Basic patterns are joins of predicate scans, constants are filters on them; OPTIONAL is a left join, UNION a union, MINUS and NOT EXISTS are anti-joins,
EXISTS a semi-join, a SELECT within a pattern is a table of its own; repeated paths are closures or searches by an automaton. Catalyst orders the joins and pushes the filters. Variables are columns; a row's kind of term isn't kept, so
values compare as text, and as numbers where both are numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators import paths
from graphwright.operators.closure import closure

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')(?P<tail>@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]+))?
    |(?P<var>[?$]\w+)|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<name>[\w-]*:[\w.-]*\w|[\w-]*:)|(?P<word>[A-Za-z_]\w*)|(?P<mark>&&|\|\||!=|<=|>=|[{}().;,*=<>!+/|^?-])""",
    re.X,
)
_UPDATES = {"INSERT", "DELETE", "DROP", "CREATE", "CLEAR", "LOAD", "COPY", "MOVE", "ADD"}


class QueryError(ValueError):
    """A query that can't be read or isn't a SELECT."""


@dataclass
class Group:
    """What stands between braces: triples, then parts in order, and filters for the whole."""

    parts: list[tuple] = field(default_factory=list)
    filters: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    names: list[str]
    columns: list[tuple[str, tuple | None]]
    distinct: bool
    where: Group
    group: list[str]
    order: list[tuple[tuple, bool]]
    limit: int | None
    offset: int
    having: list[tuple] = field(default_factory=list)


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                kind = "string" if m["string"] else m.lastgroup
                self.tokens.append((kind, m["string"] if kind == "string" else m[0]))
            at = m.end()
        self.at, self.prefixes = 0, {}

    def see(self, *words: str) -> bool:
        return self.at < len(self.tokens) and (self.tokens[self.at][1].upper() in words or self.tokens[self.at][0] in words)

    def take(self, *words: str) -> str:
        if self.at >= len(self.tokens) or (words and not self.see(*words)):
            raise QueryError(f"expected {' or '.join(words) or 'more'}, found {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def query(self) -> Query:
        while self.see("PREFIX", "BASE"):
            if self.take().upper() == "PREFIX":
                name = self.take("name")
                self.prefixes[name[:-1]] = self.take("iri")[1:-1]
            else:
                self.take("iri")
        if self.see(*_UPDATES):
            raise QueryError("only queries are allowed, not updates")
        out = self.select()
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def select(self) -> Query:
        self.take("SELECT")
        distinct = bool(self.see("DISTINCT", "REDUCED") and self.take())
        columns: list[tuple[str, tuple | None]] = []
        while not self.see("WHERE", "{"):
            if self.see("*"):
                self.take()
            elif self.see("var"):
                columns.append((self.take()[1:], None))
            else:
                self.take("(")
                value = self.expression()
                self.take("AS")
                columns.append((self.take("var")[1:], value))
                self.take(")")
        if self.see("WHERE"):
            self.take()
        where = self.braces()
        group: list[str] = []
        order: list[tuple[tuple, bool]] = []
        limit, offset = None, 0
        having: list[tuple] = []
        while self.see("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
            word = self.take().upper()
            if word == "VALUES":
                where.parts.append(self.values())
            elif word == "GROUP":
                self.take("BY")
                while self.see("var", "("):
                    if self.see("("):
                        self.take()
                        value = self.expression()
                        self.take("AS")
                        where.parts.append(("bind", self.tokens[self.at][1][1:], value))
                        group.append(self.take("var")[1:])
                        self.take(")")
                    else:
                        group.append(self.take()[1:])
            elif word == "HAVING":
                having.append(self.bracket())
                while self.see("("):
                    having.append(self.bracket())
            elif word == "ORDER":
                self.take("BY")
                while self.see("var", "ASC", "DESC", "("):
                    down = self.see("DESC")
                    if self.see("ASC", "DESC"):
                        self.take()
                    if self.see("("):
                        order.append((self.bracket(), down))
                    else:
                        order.append((("var", self.take()[1:]), False))
            elif word == "LIMIT":
                limit = int(self.take("number"))
            else:
                offset = int(self.take("number"))
        return Query([], columns, distinct, where, group, order, limit, offset, having)

    def values(self) -> tuple:
        """Rows of constants for some variables; None for UNDEF."""
        one = self.see("var")
        names = []
        if not one:
            self.take("(")
        while self.see("var") and not (one and names):
            names.append(self.take()[1:])
        if not one:
            self.take(")")
        self.take("{")
        rows = []
        while not self.see("}"):
            if not one:
                self.take("(")
            row = []
            while len(row) < len(names):
                row.append(None if self.see("UNDEF") and self.take() else self.term()[1])
            if not one:
                self.take(")")
            rows.append(tuple(row))
        self.take("}")
        return ("values", names, rows)

    def braces(self) -> Group:
        self.take("{")
        out = Group()
        while not self.see("}"):
            if self.see("OPTIONAL"):
                self.take()
                out.parts.append(("optional", self.braces()))
            elif self.see("MINUS"):
                self.take()
                out.parts.append(("minus", self.braces()))
            elif self.see("VALUES"):
                self.take()
                out.parts.append(self.values())
            elif self.see("FILTER"):
                self.take()
                out.filters.extend(_conjuncts(self.primary() if not self.see("(") else self.bracket()))
            elif self.see("BIND"):
                self.take()
                self.take("(")
                value = self.expression()
                self.take("AS")
                out.parts.append(("bind", self.take("var")[1:], value))
                self.take(")")
            elif self.see("{") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1].upper() == "SELECT":
                self.take()
                out.parts.append(("select", self.select()))
                self.take("}")
            elif self.see("{"):
                groups = [self.braces()]
                while self.see("UNION"):
                    self.take()
                    groups.append(self.braces())
                out.parts.append(("union", groups))
            else:
                self.triples(out)
            if self.see("."):
                self.take()
        self.take("}")
        return out

    def triples(self, out: Group) -> None:
        s = self.term()
        while True:
            p = self.path()
            while True:
                out.parts.append(("triple", s, p, self.term()))
                if not self.see(","):
                    break
                self.take()
            if not self.see(";"):
                return
            while self.see(";"):
                self.take()
            if self.see(".", "}"):
                return

    def path(self) -> tuple:
        if self.see("var"):
            return self.term()
        out = [self.path_sequence()]
        while self.see("|"):
            self.take()
            out.append(self.path_sequence())
        return out[0] if len(out) == 1 else ("alternative", out)

    def path_sequence(self) -> tuple:
        step = self.path_step()
        if self.see("/"):
            self.take()
            return ("sequence", step, self.path_sequence())
        return step

    def path_step(self) -> tuple:
        if self.see("^"):
            self.take()
            return ("inverse", self.path_step())
        if self.see("!"):
            self.take()
            step = ("negated", self.negated())
        elif self.see("("):
            self.take()
            step = self.path()
            self.take(")")
        else:
            step = self.predicate()
        if self.see("+", "*", "?"):
            mark = self.take()
            step = ("repeat", step, mark != "+", mark != "?")
        return step

    def predicate(self) -> tuple:
        if self.see("A"):
            self.take()
            return ("iri", "rdf:type")
        return self.term()

    def negated(self) -> list[tuple[str, bool]]:
        """The predicates that a step excludes, and which of them against the arrow."""
        many = self.see("(") and self.take()
        out = []
        while not (many and self.see(")")):
            back = bool(self.see("^") and self.take())
            out.append((self.predicate()[1], back))
            if not many:
                return out
            if self.see("|"):
                self.take()
        self.take(")")
        return out

    def term(self) -> tuple:
        if self.see("var"):
            return ("var", self.take()[1:])
        if self.see("iri"):
            return ("iri", self.short(self.take()[1:-1]))
        if self.see("string"):
            return ("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.take()[1:-1]))
        if self.see("number"):
            return ("literal", self.take())
        if self.see("TRUE", "FALSE"):
            return ("literal", self.take().lower())
        prefix, _, local = self.take("name").partition(":")
        return ("iri", self.short(self.prefixes[prefix] + local) if prefix in self.prefixes else f"{prefix}:{local}")

    def short(self, iri: str) -> str:
        from graphwright.sources.turtle import PREFIXES

        for prefix, space in sorted([*PREFIXES.items(), *((p, s) for p, s in self.prefixes.items() if p == "oc")], key=lambda x: -len(x[1])):
            if iri.startswith(space):
                return f"{prefix}:{iri[len(space):]}"
        return iri

    def bracket(self) -> tuple:
        self.take("(")
        out = self.expression()
        self.take(")")
        return out

    def expression(self) -> tuple:
        out = self.conjunction()
        while self.see("||"):
            self.take()
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self) -> tuple:
        out = self.comparison()
        while self.see("&&"):
            self.take()
            out = ("and", out, self.comparison())
        return out

    def comparison(self) -> tuple:
        left = self.sum()
        if self.see("=", "!=", "<", ">", "<=", ">="):
            return (self.take(), left, self.sum())
        if self.see("IN", "NOT"):
            no = self.see("NOT") and self.take()
            self.take("IN")
            self.take("(")
            terms = [self.expression()]
            while self.see(","):
                self.take()
                terms.append(self.expression())
            self.take(")")
            return ("not", ("in", left, terms)) if no else ("in", left, terms)
        return left

    def sum(self) -> tuple:
        out = self.product()
        while self.see("+", "-") or (self.see("number") and self.tokens[self.at][1][0] in "+-"):
            if self.see("number"):  # a sign that the number took
                mark, value = self.tokens[self.at][1][0], self.tokens[self.at][1][1:]
                self.tokens[self.at] = ("number", value)
            else:
                mark = self.take()
            out = (mark, out, self.product())
        return out

    def product(self) -> tuple:
        out = self.primary()
        while self.see("*", "/"):
            out = (self.take(), out, self.primary())
        return out

    def primary(self) -> tuple:
        if self.see("!"):
            self.take()
            return ("not", self.primary())
        if self.see("-", "+"):
            return ("-" if self.take() == "-" else "+", ("literal", "0"), self.primary())
        if self.see("EXISTS"):
            self.take()
            return ("exists", self.braces())
        if self.see("NOT"):
            self.take()
            self.take("EXISTS")
            return ("not", ("exists", self.braces()))
        if self.see("("):
            return self.bracket()
        if self.see("word") and not self.see("TRUE", "FALSE"):
            name = self.take().upper()
            self.take("(")
            distinct = bool(self.see("DISTINCT") and self.take())
            arguments: list[tuple] = []
            while not self.see(")"):
                arguments.append(("star",) if self.see("*") and self.take() else self.expression())
                if self.see(","):
                    self.take()
            self.take(")")
            return ("call", name, distinct, arguments)
        return self.term()


def _conjuncts(e: tuple) -> list[tuple]:
    """The parts that all have to hold."""
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _pattern(e: tuple) -> tuple[Group, bool] | None:
    """The group of an EXISTS, and whether it must hold; None for another expression."""
    if e[0] == "not" and (inner := _pattern(e[1])):
        return inner[0], not inner[1]
    return (e[1], True) if e[0] == "exists" else None


def _value(e: tuple, have: list[str]) -> Column:
    kind = e[0]
    if kind in ("+", "-", "*", "/"):
        a, b = (_value(x, have).try_cast("double") for x in e[1:])
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[kind]
    if kind == "exists":
        raise QueryError("EXISTS must hold by itself, not within another condition than &&")
    if kind == "var":
        return F.col(e[1]) if e[1] in have else F.lit(None).cast("string")
    if kind in ("iri", "literal"):
        return F.lit(e[1])
    if kind == "not":
        return ~_value(e[1], have)
    if kind in ("and", "or"):
        a, b = _value(e[1], have), _value(e[2], have)
        return a & b if kind == "and" else a | b
    if kind == "in":
        return reduce(lambda x, y: x | y, [_value(e[1], have) == _value(t, have) for t in e[2]])
    if kind in ("=", "!=", "<", ">", "<=", ">="):
        a, b = _value(e[1], have), _value(e[2], have)
        x, y = a.try_cast("double"), b.try_cast("double")
        both = x.isNotNull() & y.isNotNull()
        compare = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[kind]
        plain = compare(a.cast("string"), b.cast("string"))
        return plain if "iri" in (e[1][0], e[2][0]) else F.when(both, compare(x, y)).otherwise(plain)
    if kind == "call":
        _, name, _, args = e
        values = [_value(a, have) for a in args if a != ("star",)]
        functions = {
            "CONTAINS": lambda a, b: F.contains(a, b),
            "STRSTARTS": lambda a, b: F.startswith(a, b),
            "STRENDS": lambda a, b: F.endswith(a, b),
            "LCASE": F.lower,
            "UCASE": F.upper,
            "STR": lambda a: a.cast("string"),
            "STRLEN": F.length,
            "BOUND": lambda a: a.isNotNull(),
            "COALESCE": F.coalesce,
            "IF": lambda c, a, b: F.when(c, a).otherwise(b),
            "CONCAT": lambda *a: F.concat(*[x.cast("string") for x in a]),
            "ABS": lambda a: F.abs(a.try_cast("double")),
            "CEIL": lambda a: F.ceil(a.try_cast("double")),
            "FLOOR": lambda a: F.floor(a.try_cast("double")),
            "ROUND": lambda a: F.floor(a.try_cast("double") + 0.5),
            "SUBSTR": lambda a, i, *n: F.substring(a, i.try_cast("int"), *[x.try_cast("int") for x in n]) if n else F.substring(a, i.try_cast("int"), F.length(a)),
            "STRBEFORE": lambda a, b: F.when(F.contains(a, b), F.split_part(a, b, F.lit(1))).otherwise(F.lit("")),
            "STRAFTER": lambda a, b: F.when(F.contains(a, b), F.substring(a, F.locate(args[1][1], a) + F.length(b), F.length(a))).otherwise(F.lit("")),
        }
        if name == "REGEX":
            flags = args[2][1] if len(args) > 2 else ""
            return values[0].rlike((f"(?{flags})" if flags else "") + args[1][1])
        if name in functions:
            return functions[name](*values)
        raise QueryError(f"{name} isn't known")
    raise QueryError(f"{kind} isn't an expression")


_AGGREGATES = {"COUNT": F.count, "SUM": lambda c: F.sum(c.try_cast("double")), "AVG": lambda c: F.avg(c.try_cast("double")), "MIN": F.min, "MAX": F.max, "SAMPLE": F.min}


def _apart(e: tuple, made: list[tuple]) -> tuple:
    """An expression with its aggregates replaced by variables; `made` gets them."""
    if not isinstance(e, tuple):
        return [_apart(x, made) for x in e] if isinstance(e, list) else e
    if e and e[0] == "call" and e[1] in _AGGREGATES:
        made.append(e)
        return ("var", f"_agg{len(made) - 1}")
    return tuple(_apart(x, made) for x in e)


def _variables(e) -> set[str]:
    """The variables that an expression names."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "var":
        return {e[1]}
    return set().union(*map(_variables, e)) if isinstance(e, (tuple, list)) else set()


class Planner:
    """Plans over one triple table; closures are made once for each predicate.

    The graphs of the table are read as one: a triple that several of them have counts once, unless `merged` says that none repeats.
    """

    def __init__(self, t: DataFrame, merged: bool = False):
        self.t = t if merged else t.select("s", "p", "o", "o_kind", "o_dt", "o_lang").distinct()
        self.closures: dict[str, DataFrame] = {}

    def path(self, s: tuple, p: tuple, o: tuple) -> DataFrame:
        """(s, o, s_literal, o_literal) of a path of any length. With a node given at one end only what that node reaches is searched, not all pairs."""
        plain = F.lit(False)
        if s[0] == "var" and o[0] == "var":
            key = repr(p)
            if key not in self.closures:
                if p[1][0] == "iri" and p[3] and not p[2]:
                    edges = self.t.where((F.col("p") == p[1][1]) & (F.col("o_kind") != "literal")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
                    ends = self.t.where((F.col("p") == p[1][1]) & (F.col("o_kind") == "literal")).select(F.col("s").alias("end"), "o").distinct()
                    pairs = closure(edges)
                    # a literal ends a path
                    last = pairs.join(ends, F.col("dst") == F.col("end")).select("src", "o").union(ends).distinct().select(F.col("src").alias("s"), "o", plain.alias("s_literal"), F.lit(True).alias("o_literal"))
                    self.closures[key] = pairs.select(F.col("src").alias("s"), F.col("dst").alias("o"), plain.alias("s_literal"), plain.alias("o_literal")).union(last)
                else:
                    self.closures[key] = paths.search(self.t, p).toDF("s", "s_literal", "o", "o_literal").select("s", "o", "s_literal", "o_literal")
            return self.closures[key]
        start = lambda n: self.t.sparkSession.createDataFrame([(n[1], n[0] == "literal")], "node string, literal boolean")
        if s[0] != "var":
            return paths.search(self.t, p, start(s)).toDF("s", "s_literal", "o", "o_literal")
        return paths.search(self.t, ("inverse", p), start(o)).toDF("o", "o_literal", "s", "s_literal")

    def pairs(self, s: tuple, p: tuple, o: tuple) -> DataFrame:
        """(s, s_literal, o, o_literal) of a path, repeats included; `s` and `o` say where a search may start from."""
        kind, any_ = p[0], ("var", "")
        columns = ["s", "s_literal", "o", "o_literal"]
        one = [F.col("s"), F.lit(False).alias("s_literal"), F.col("o"), (F.col("o_kind") == "literal").alias("o_literal")]
        if kind == "sequence":
            first, then = self.pairs(s, p[1], any_).toDF("s", "s_literal", "m", "m_literal"), self.pairs(any_, p[2], o).toDF("m", "m_literal", "o", "o_literal")
            return first.join(then, ["m", "m_literal"]).select(columns)
        if kind == "alternative":
            return reduce(DataFrame.union, [self.pairs(s, x, o) for x in p[1]])
        if kind == "inverse":
            return self.pairs(o, p[1], s).toDF("o", "o_literal", "s", "s_literal").select(columns)
        if kind == "negated":
            sides = []
            for back in (False, True):
                names = [n for n, i in p[1] if i == back]
                if names or (not back and not p[1]):
                    rows = (self.t.where(~F.col("p").isin(*names)) if names else self.t).select(*one)
                    sides.append(rows.toDF("o", "o_literal", "s", "s_literal").select(columns) if back else rows)
            return reduce(DataFrame.union, sides)
        if kind == "repeat":
            return self.path(s, p, o).select(columns)
        return self.t.where(F.col("p") == p[1]).select(*one)

    def scan(self, s: tuple, p: tuple, o: tuple) -> DataFrame:
        simple = p[0] in ("iri", "var")
        if simple:
            rows, places = self.t, [("s", s), ("p", p), ("o", o)]
        else:
            rows, places = self.pairs(s, p, o), [("s", s), ("o", o)]
        out: dict[str, str] = {}
        for column, term in places:
            if term[0] == "var":
                if term[1] in out:
                    rows = rows.where(F.col(column) == F.col(out[term[1]]))
                else:
                    out[term[1]] = column
            else:
                rows = rows.where(F.col(column) == term[1])
                literal = F.col(f"{column}_literal") if not simple else (F.col("o_kind") == "literal") if column == "o" else F.lit(False)
                rows = rows.where(literal == (term[0] == "literal"))
        return rows.select(*[F.col(c).alias(v) for v, c in out.items()] or [F.lit(1).alias("_")])

    @staticmethod
    def join(a: tuple[DataFrame, set[str]], b: tuple[DataFrame, set[str]], how: str = "inner", filters: list[tuple] = ()) -> tuple[DataFrame, set[str]]:
        """Rows that agree on shared variables, and the variables that may be unbound in them.

        A variable that may be unbound agrees with anything where it is. Filters hold for pairs, as those of an OPTIONAL do. Sides that share
        no variable that is always bound would be paired row by row, which is refused; a pattern without variables only has to hold.
        """
        (x, open_x), (y, open_y) = a, b
        if y.columns == ["_"]:
            return (x.join(y.limit(1).select(F.lit(1).alias("_holds")), F.lit(True), how).drop("_holds"), open_x)
        if x.columns == ["_"]:
            return (y.join(x.limit(1).select(F.lit(1).alias("_holds")), F.lit(True), how).drop("_holds"), open_y)
        shared = [c for c in x.columns if c in y.columns]
        loose = [c for c in shared if c in open_x | open_y]
        if len(loose) == len(shared):
            raise QueryError("patterns must share a variable that is bound in both")
        new = [c for c in y.columns if c not in shared]
        y = y.select(*[F.col(c).alias(f"_of_{c}") for c in shared], *new)
        same = F.lit(True)
        for c in shared:
            equal = F.col(c) == F.col(f"_of_{c}")
            same = same & (equal | F.col(c).isNull() | F.col(f"_of_{c}").isNull() if c in loose else equal)
        for f in filters:
            same = same & F.coalesce(_value(f, [*x.columns, *new]), F.lit(False))
        out = x.join(y, same, how).select(*[F.coalesce(c, f"_of_{c}").alias(c) if c in loose else F.col(c) for c in x.columns], *new)
        bound = {c for c in loose if how == "inner" and not (c in open_x and c in open_y)}
        return out, ((open_x | open_y) - bound) | (set(new) if how == "left" else set())

    @staticmethod
    def without(a: tuple[DataFrame, set[str]], b: tuple[DataFrame, set[str]]) -> tuple[DataFrame, set[str]]:
        """MINUS: rows that agree with none of the others in the variables that both bind, and bind one at least. Variables in common that may be unbound are tried one after the other, so each test has a key."""
        (x, open_x), (y, open_y) = a, b
        shared = [c for c in x.columns if c in y.columns and not c.startswith("_")]
        loose = [c for c in shared if c in open_x | open_y]
        firm = [c for c in shared if c not in loose]
        other = y.select(*[F.col(c).alias(f"_of_{c}") for c in shared]).distinct()
        for key in [None] if firm else loose:
            same = F.lit(True)
            for c in shared:
                equal = F.col(c) == F.col(f"_of_{c}")
                same = same & (equal if c in firm or c == key else equal | F.col(c).isNull() | F.col(f"_of_{c}").isNull())
            x = x.join(other, same, "left_anti")
        return x, open_x

    def tested(self, a: tuple[DataFrame, set[str]], g: Group, holds: bool) -> tuple[DataFrame, set[str]]:
        """EXISTS or NOT EXISTS: rows with, or without, a row of the group that agrees; its filters see the row's variables. A group that shares none is there for all rows or for none."""
        x, open_x = a
        found = self.group(g, filtered=False)
        if found is None:
            raise QueryError("EXISTS asks for nothing")
        y, open_y = found
        how = "left_semi" if holds else "left_anti"
        patterns = [f for f in g.filters if _pattern(f)]
        for f in patterns:
            y, open_y = self.tested((y, open_y), *_pattern(f))
        filters = [f for f in g.filters if f not in patterns]
        shared = [c for c in x.columns if c in y.columns and not c.startswith("_")]
        loose = [c for c in shared if c in open_x | open_y]
        inner = [f for f in filters if _variables(f) <= set(y.columns)]
        for f in inner:
            y = y.where(_value(f, y.columns))
        outer = [f for f in filters if f not in inner]
        if not shared and outer:
            raise QueryError("EXISTS must share a variable with what it is a condition of")
        if not shared:
            return x.join(y.limit(1).select(F.lit(1).alias("_holds")), F.lit(True), how), open_x
        if len(loose) == len(shared):
            raise QueryError("EXISTS must share a variable that is bound in both")
        y = y.select(*[F.col(c).alias(f"_of_{c}") if c in shared else F.col(c) for c in y.columns])
        same = F.lit(True)
        for c in shared:
            equal = F.col(c) == F.col(f"_of_{c}")
            same = same & (equal | F.col(c).isNull() | F.col(f"_of_{c}").isNull() if c in loose else equal)
        for f in outer:
            same = same & F.coalesce(_value(f, [*x.columns, *(c for c in y.columns if not c.startswith("_of_"))]), F.lit(False))
        return x.join(y, same, how), open_x

    def ordered(self, parts: list[tuple]) -> list[tuple]:
        """Parts with neighbouring triples in an order in which each shares a variable with what comes before, as far as there is one."""
        out, left, seen = [], list(parts), set()
        while left:
            n = next((i for i, p in enumerate(left) if p[0] != "triple"), len(left))
            i = next((i for i in range(n) if not seen or _variables(left[i][1:]) & seen), 0) if n else 0
            part = left.pop(i)
            seen |= _variables(part[1:]) if part[0] == "triple" else set()
            out.append(part)
        return out

    def group(self, g: Group, filtered: bool = True) -> tuple[DataFrame, set[str]] | None:
        """A group's rows, and the variables that may be unbound in them."""
        out: tuple[DataFrame, set[str]] | None = None
        for part in self.ordered(g.parts):
            if part[0] == "triple":
                rows = (self.scan(*part[1:]), set())
                out = rows if out is None else self.join(out, rows)
            elif part[0] == "optional":
                rows = self.group(part[1], filtered=False)
                out = rows if out is None else self.join(out, rows, "left", part[1].filters)
            elif part[0] == "union":
                sides = [self.group(x) for x in part[1]]
                rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x for x, _ in sides])
                missing = {c for c in rows.columns for x, _ in sides if c not in x.columns}
                rows = (rows, missing.union(*(x for _, x in sides)))
                out = rows if out is None else self.join(out, rows)
            elif part[0] == "values":
                names = part[1]
                rows = (self.t.sparkSession.createDataFrame(part[2], ", ".join(f"`{n}` string" for n in names)), {n for i, n in enumerate(names) if any(r[i] is None for r in part[2])})
                if out is not None and not set(names) & set(out[0].columns):
                    out = (out[0].crossJoin(F.broadcast(rows[0])), out[1] | rows[1])  # rows of the query's text
                else:
                    out = rows if out is None else self.join(out, rows)
            elif part[0] == "select":
                rows = self.select(part[1])
                out = rows if out is None else self.join(out, rows)
            elif part[0] == "minus":
                rows = self.group(part[1])
                if out is not None and rows is not None and set(out[0].columns) & set(rows[0].columns) - {"_"}:
                    out = self.without(out, rows)
            else:
                df, loose = out if out is not None else (self.t.sparkSession.range(1).select(F.lit(1).alias("_")), set())
                out = df.withColumn(part[1], _value(part[2], df.columns).cast("string")), loose
        if out is not None and filtered:
            for f in g.filters:
                if pattern := _pattern(f):
                    out = self.tested(out, *pattern)
                else:
                    out = out[0].where(_value(f, out[0].columns)), out[1]
        return out

    def run(self, q: Query) -> DataFrame:
        return self.select(q)[0]

    def select(self, q: Query) -> tuple[DataFrame, set[str]]:
        """The rows of a query, and the variables that may be unbound in them."""
        found = self.group(q.where)
        if found is None:
            raise QueryError("nothing is asked for")
        rows, open_ = found
        names = [c for c in rows.columns if not c.startswith("_")]
        made: list[tuple[str, tuple]] = []
        columns, having = [(n, e and _apart(e, made)) for n, e in q.columns], [_apart(e, made) for e in q.having]
        order = [(_apart(e, made), down) for e, down in q.order]
        plain = [(n, e) for n, e in columns if e]
        if made or q.group:
            given = {f"_agg{i}" for i in range(len(made))} | set(q.group)
            loose = {n for n, e in columns if not e}.union(*(_variables(e) for _, e in plain), *map(_variables, having)) - given - {n for n, _ in plain}
            if loose:
                raise QueryError(f"not grouped by: {', '.join(sorted(loose))}")
            sums = []
            for i, (_, function, distinct, args) in enumerate(made):
                column = F.lit(1) if args == [("star",)] else _value(args[0], rows.columns)
                sums.append((F.count_distinct(column) if distinct and function == "COUNT" else _AGGREGATES[function](column)).alias(f"_agg{i}"))
            rows = rows.groupBy(*q.group).agg(*sums) if sums else rows.select(*q.group).distinct()
        for name, e in plain:
            rows = rows.withColumn(name, _value(e, rows.columns))
        for e in having:
            rows = rows.where(_value(e, rows.columns))
        counts = {n for n, e in plain if e[0] == "var" and e[1].startswith("_agg") and made[int(e[1][4:])][1] == "COUNT"}
        open_ = open_ | {n for n, _ in plain if n not in counts}
        wanted = [n for n, _ in q.columns] or names
        for n in (n for n in wanted if n not in rows.columns):
            rows = rows.withColumn(n, F.lit(None).cast("string"))
            open_ = open_ | {n}
        keys = [(f"_key{i}", _value(e, rows.columns), down) for i, (e, down) in enumerate(order)]
        if q.distinct:  # of rows that become one the first in order counts
            rows = rows.withColumns({k: v for k, v, _ in keys}) if keys else rows
            rows = rows.groupBy(*wanted).agg(*[(F.max if down else F.min)(k).alias(k) for k, _, down in keys]) if keys else rows.select(*wanted).distinct()
            rows = rows.orderBy(*[F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for k, _, down in keys]) if keys else rows
        elif keys:
            rows = rows.orderBy(*[v.desc_nulls_last() if down else v.asc_nulls_first() for _, v, down in keys])
        rows = rows.select(*wanted)
        if q.limit is not None and not q.order:
            rows = rows.orderBy(*wanted)  # a limit without an order is any row; a fixed order makes it the same one each time
        if q.offset:
            rows = rows.offset(q.offset)
        return (rows.limit(q.limit) if q.limit is not None else rows), open_ & set(wanted)


def select(t: DataFrame, text: str, merged: bool = False) -> DataFrame:
    """The rows of a SELECT query over a triple table. Updates are refused by their form, not by words in the text. `merged`: no triple repeats."""
    return Planner(t, merged).run(Parser(text).query())


def show(rows: DataFrame, kind: str = "table") -> str:
    """All rows as a table, as JSON, or as `variable: value` lines; a text for people, so a query should have its own limit."""
    import json

    found = [r.asDict() for r in rows.toLocalIterator()]
    if kind == "json":
        return json.dumps(found, ensure_ascii=False, indent=2)
    if kind == "lines":
        return "\n\n".join("\n".join(f"{k}: {v}" for k, v in r.items()) for r in found)
    cells = [rows.columns, *[["" if v is None else str(v) for v in r.values()] for r in found]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in [cells[0], ["-" * w for w in widths], *cells[1:]])
