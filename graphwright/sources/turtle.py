"""Turtle: a parser, a reader that gives the triple table, and a writer.

A file is one row of a whole-text read, parsed where it lies; files are the unit of parallelism, since prefixes and blank nodes are a file's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.triples import SCHEMA, distinct_triples

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Prefixes that full terms are written with in the triple table, besides a file's own base of `oc:`.
PREFIXES = {"rdf": RDF, "xsd": XSD, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "dcterms": "http://purl.org/dc/terms/", "skos": "http://www.w3.org/2004/02/skos/core#", "sh": "http://www.w3.org/ns/shacl#"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<name>(?:[A-Za-z\u00c0-\U000effff][\w.\-]*)?:(?:(?:[\w:\-%]|\\.)(?:(?:[\w:.\-%]|\\.)*(?:[\w:\-%]|\\.))?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    """A text that isn't Turtle."""


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


class Parser:
    """One text. Terms are (kind, value, datatype, language)."""

    def __init__(self, text: str, base: str = "", namespaces: dict[str, str] | None = None):
        self.text, self.base, self.prefixes = text, base, {}
        self.known = sorted(({**PREFIXES, **(namespaces or {})}).items(), key=lambda x: -len(x[1]))
        self.tokens = self._scan()
        self.next: tuple[str, str, int] | None = next(self.tokens, None)
        self.made, self.out = 0, []

    def _scan(self) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise TurtleError(f"line {self.text.count(chr(10), 0, at) + 1}: unexpected {self.text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], at
            at = m.end()

    def _take(self, *wanted: str) -> str:
        if self.next is None or (wanted and self.next[1] not in wanted and self.next[0] not in wanted):
            where = self.text.count("\n", 0, self.next[2]) + 1 if self.next else "end"
            raise TurtleError(f"line {where}: expected {' or '.join(wanted)}, found {self.next[1] if self.next else 'nothing'!r}")
        token = self.next[1]
        self.next = next(self.tokens, None)
        return token

    def _sees(self, *wanted: str) -> bool:
        return self.next is not None and (self.next[1] in wanted or self.next[0] in wanted)

    def _short(self, iri: str) -> str:
        for prefix, space in self.known:
            if space and iri.startswith(space):
                return f"{prefix}:{iri[len(space):]}"
        return iri

    def _iri(self) -> tuple[str, str]:
        if self._sees("iri"):
            iri = _unescape(self._take()[1:-1])
            return "iri", self._short(urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", iri) else iri)
        prefix, _, local = self._take("name").partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"prefix {prefix}: isn't declared")
        return "iri", self._short(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    def _blank(self) -> tuple[str, str]:
        self.made += 1
        return "bnode", f"_:b{self.made}"

    def _add(self, s, p: str, o) -> None:
        self.out.append((s[1], s[0], p, *o))

    def _node(self) -> tuple[str, str]:
        """A subject, or an object that isn't a literal."""
        if self._sees("bnode"):
            return "bnode", "_:n" + self._take()[2:]
        if self._sees("["):
            self._take()
            node = self._blank()
            if not self._sees("]"):
                self._properties(node)
            self._take("]")
            return node
        if self._sees("("):
            self._take()
            items = []
            while not self._sees(")"):
                items.append(self._object())
            self._take()
            rest = ("iri", "rdf:nil")
            for item in reversed(items):
                node = self._blank()
                self._add(node, "rdf:first", item)
                self._add(node, "rdf:rest", (rest[1], rest[0], None, None))
                rest = node
            return rest
        return self._iri()

    def _object(self) -> tuple[str, str, str | None, str | None]:
        """(value, kind, datatype, language)."""
        if self._sees("long", "short"):
            token = self._take()
            cut = 3 if token[:3] in ('"""', "'''") and len(token) >= 6 else 1
            value = _unescape(token[cut:-cut])
            if self._sees("lang"):
                return value, "literal", "rdf:langString", self._take()[1:].lower()
            if self._sees("^^"):
                self._take()
                return value, "literal", self._iri()[1], None
            return value, "literal", "xsd:string", None
        if self._sees("number"):
            token = self._take()
            kind = "double" if "e" in token.lower() else "decimal" if "." in token else "integer"
            return token, "literal", f"xsd:{kind}", None
        if self._sees("true", "false"):
            return self._take(), "literal", "xsd:boolean", None
        kind, value = self._node()
        return value, kind, None, None

    def _properties(self, subject) -> None:
        while True:
            predicate = "rdf:type" if self._sees("a") and self._take() else self._iri()[1]
            while True:
                self._add(subject, predicate, self._object())
                if not self._sees(","):
                    break
                self._take()
            while self._sees(";"):
                self._take()
                if self._sees(".", "]", ";"):
                    continue
                break
            else:
                return
            if self._sees(".", "]"):
                return

    def parse(self) -> list[tuple]:
        """(s, s_kind, p, o, o_kind, o_dt, o_lang) of each statement."""
        while self.next is not None:
            if self._sees("directive"):
                word = self._take()
                if word.lower().endswith("prefix"):
                    prefix = self._take("name")[:-1]
                    self.prefixes[prefix] = urljoin(self.base, self._take("iri")[1:-1])
                    if prefix == "oc":
                        self.known.insert(0, ("oc", self.prefixes[prefix]))
                else:
                    self.base = urljoin(self.base, self._take("iri")[1:-1])
                if word.startswith("@"):
                    self._take(".")
                continue
            listed = self._sees("[")
            subject = self._node()
            if not (listed and self._sees(".")):
                self._properties(subject)
            self._take(".")
        return self.out


def parse(text: str, base: str = "") -> list[tuple]:
    """The statements of a Turtle text."""
    return Parser(text, base).parse()


def read_turtle(spark: SparkSession, *paths: str) -> DataFrame:
    """The triple table of Turtle files; graph_id is the file's path, and blank nodes are its own. A text that isn't Turtle ends the job with its path."""
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    found = parse(text)
                except TurtleError as e:
                    raise TurtleError(f"{path}: {e}") from e
                local = lambda kind, term, path=path: f"{term}@{path}" if kind == "bnode" else term
                yield pa.RecordBatch.from_pylist([{"graph_id": path, "s": local(sk, s), "s_kind": sk, "p": p, "o": local(k, o), "o_kind": k, "o_dt": dt, "o_lang": lang} for s, sk, p, o, k, dt, lang in found], schema=pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")]))

    return distinct_triples(files.mapInArrow(batches, SCHEMA))


def term(column: str, kind: str, dt: str | None = None, lang: str | None = None):
    """A term as Turtle text: prefixed names as they are, other IRIs in angle brackets, literals escaped."""
    c = F.col(column)
    iri = F.when(c.rlike("^(rdf|rdfs|owl|xsd|dcterms|skos|sh|oc):[A-Za-z0-9_-]+$"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    out = F.when(F.col(kind) == "iri", iri).when(F.col(kind) == "bnode", F.concat(F.lit("_:"), F.regexp_replace(F.regexp_replace(c, "^_:", ""), "[^A-Za-z0-9]", "_")))
    if dt is None:
        return out
    quoted = c
    for plain, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(escape))
    quoted = F.concat(F.lit('"'), quoted, F.lit('"'))
    tagged = F.when(F.col(lang).isNotNull(), F.concat(quoted, F.lit("@"), F.col(lang))).when(F.col(dt).isNotNull() & ~F.col(dt).isin("xsd:string", "rdf:langString"), F.concat(quoted, F.lit("^^"), F.col(dt))).otherwise(quoted)
    return F.when(F.col(kind) == "literal", tagged).otherwise(out)


def render(t: DataFrame) -> DataFrame:
    """(graph_id, line): a statement a line, sorted by nothing; lines of a graph make a Turtle text after `header`."""
    line = F.concat_ws(" ", term("s", "s_kind"), F.when(F.col("p") == "rdf:type", F.lit("a")).otherwise(term("p", "_p")), term("o", "o_kind", "o_dt", "o_lang"), F.lit("."))
    return t.withColumn("_p", F.lit("iri")).select("graph_id", line.alias("line"))


def header(base: str) -> str:
    return "".join(f"@prefix {p}: <{space}> .\n" for p, space in {**PREFIXES, "oc": base}.items())


def write_turtle(t: DataFrame, path: str, base: str) -> None:
    """A folder of Turtle for each graph under `path`; each file begins with the prefixes, so it stands alone."""
    top = header(base)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import defaultdict

        texts: dict[str, list[str]] = defaultdict(list)
        for batch in rows:
            for graph, line in zip(batch.column("graph_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                texts[graph].append(line)
        for graph, lines in texts.items():
            yield pa.RecordBatch.from_pydict({"graph_id": [graph], "value": [top + "\n".join(sorted(lines))]})

    render(t).repartition("graph_id").mapInArrow(batches, "graph_id string, value string").write.partitionBy("graph_id").text(path)


def imports(spark: SparkSession, root: str) -> list[str]:
    """The files that a manifest imports, directly or not, level by level, each once; the manifest first. Missing files are skipped.

    Follows owl:imports as statements, all of a list; https imports stand for the file of that name beside the importer. A level of files is
    read by one job, in which each file's imports are found where it lies; what goes to the driver is their names.
    """
    from graphwright.sources.files import existing

    found: dict[str, None] = {}
    todo = existing(spark, [root])
    while todo:
        found |= dict.fromkeys(todo)
        links = read_turtle(spark, *todo).where("p = 'owl:imports' and o_kind = 'iri'").select(F.col("graph_id").alias("path"), "o").orderBy("path", "o").collect()
        named = [f"{r.path.rsplit('/', 1)[0]}/{r.o.rsplit('/', 1)[-1]}" if r.o.startswith("http") else r.o.removeprefix("file://") for r in links]
        todo = [p for p in existing(spark, list(dict.fromkeys(named))) if p not in found and p.removeprefix("file://") not in found]
    return list(found)


def load(spark: SparkSession, root: str) -> DataFrame:
    """The triple table of a folder: what system/index.enabled.ttl imports, or else what system/index.ttl does, or else all Turtle files below it.

    No file at all is an error (FileNotFoundError).
    """
    from graphwright.sources.files import existing

    for manifest in (f"{root}/system/index.enabled.ttl", f"{root}/system/index.ttl"):
        if existing(spark, [manifest]):
            return read_turtle(spark, *imports(spark, manifest))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ttl").load(root).select("path") if existing(spark, [root]) else None
    paths = [r.path for r in files.orderBy("path").collect()] if files is not None else []
    if not paths:
        raise FileNotFoundError(f"no ontology below {root}")
    return read_turtle(spark, *paths)
