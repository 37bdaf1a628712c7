"""Validation of graphs by shapes: a table of constraints, one plan for each kind.

A constraint is (shape, target, path, kind, argument, severity, message). A target is a class, `*predicate` for what it points to, `^predicate` for what has it, or `=node`. A path is a
predicate, or `^predicate` against the arrow. Kinds: min and max (counts), datatype, iri, node (kinds of node), class, in, value (one that must be there), pattern,
shortest and longest (characters), least and most (numbers), or (any of several paths).

`read` takes the constraints from a graph of shapes, so shapes are data; `vocabulary` is the graph of this vocabulary's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.catalog import superclasses
from graphwright.operators.triples import SCHEMA, TYPE
from graphwright.sources.scratch import drop, stored

#: Constraints, and values of their lists, that a graph of shapes may have; they travel with the plan.
MOST_CONSTRAINTS, MOST_VALUES = 10_000, 100_000


@dataclass(frozen=True)
class Constraint:
    shape: str
    target: str
    path: str
    kind: str
    argument: object = None
    severity: str = "Violation"

    @property
    def message(self) -> str:
        return f"{self.path}: {self.kind} {self.argument}"


# The constraints on skills, payloads, knowledge and content.
CONSTRAINTS = (
    Constraint("Skill", "oc:Skill", "oc:resolvesIntent", "min", 1),
    Constraint("Skill", "oc:Skill", "oc:resolvesIntent", "datatype", "xsd:string"),
    Constraint("Skill", "oc:Skill", "oc:requiresState", "iri"),
    Constraint("Skill", "oc:Skill", "oc:yieldsState", "iri"),
    Constraint("Skill", "oc:Skill", "oc:handlesFailure", "iri"),
    Constraint("Skill", "oc:Skill", "oc:impartsKnowledge", "class", "oc:KnowledgeNode"),
    Constraint("Skill", "oc:Skill", "oc:impartsKnowledge", "min", 1, "Warning"),
    Constraint("Skill", "oc:Skill", "oc:dependsOnSkill", "class", "oc:Skill", "Warning"),
    Constraint("Skill", "oc:Skill", "oc:isUserInvocable", "datatype", "xsd:boolean"),
    Constraint("ExecutableSkill", "oc:ExecutableSkill", "oc:hasPayload", "min", 1),
    Constraint("ExecutableSkill", "oc:ExecutableSkill", "oc:hasPayload", "max", 1),
    Constraint("DeclarativeSkill", "oc:DeclarativeSkill", "oc:hasPayload", "max", 0),
    Constraint("Payload", "oc:ExecutionPayload", "oc:code|oc:executionPath", "or"),
    Constraint("Payload", "oc:ExecutionPayload", "oc:executor", "min", 1),
    Constraint("Payload", "oc:ExecutionPayload", "oc:executor", "max", 1),
    Constraint("Payload", "oc:ExecutionPayload", "oc:executor", "in", ("shell", "python", "node", "claude_tool")),
    Constraint("Payload", "oc:ExecutionPayload", "oc:timeout", "datatype", "xsd:integer"),
    Constraint("State", "*oc:requiresState", "rdfs:label", "min", 1, "Warning"),
    Constraint("KnowledgeNode", "oc:KnowledgeNode", "oc:directiveContent", "min", 1),
    Constraint("KnowledgeNode", "oc:KnowledgeNode", "oc:directiveContent", "max", 1),
    Constraint("KnowledgeNode", "oc:KnowledgeNode", "oc:appliesToContext", "min", 1, "Warning"),
    Constraint("KnowledgeNode", "oc:KnowledgeNode", "oc:hasRationale", "min", 1, "Warning"),
    Constraint("KnowledgeNode", "oc:KnowledgeNode", "oc:severityLevel", "in", ("CRITICAL", "HIGH", "MEDIUM", "LOW")),
    Constraint("CodeExample", "oc:CodeExample", "oc:codeContent", "min", 1),
    Constraint("Table", "oc:Table", "oc:tableMarkdown", "min", 1),
    Constraint("Flowchart", "oc:Flowchart", "oc:flowchartType", "in", ("graphviz", "mermaid")),
    Constraint("Template", "oc:Template", "oc:templateType", "in", ("prompt", "output", "boilerplate")),
    Constraint("Paragraph", "oc:Paragraph", "oc:textContent", "min", 1),
    Constraint("BulletList", "oc:BulletList", "oc:hasItem", "class", "oc:BulletItem"),
    Constraint("WorkflowStep", "oc:WorkflowStep", "oc:stepOrder", "datatype", "xsd:integer"),
)


def validate(t: DataFrame, subclasses: list[tuple[str, str]], constraints: tuple[Constraint, ...] = CONSTRAINTS) -> DataFrame:
    """(shape, focus, path, kind, value, severity, message) of each violation.

    Counts of all paths of all targets come from one join and one aggregation; the table of constraints is a local one.
    Classes include their subclasses; nothing else is inferred. subclasses: (sub, super) pairs of a vocabulary, a map within the plan.
    """
    up = F.create_map(*[x for c, above in superclasses(subclasses).items() for x in (F.lit(c), F.array(*map(F.lit, above)))])
    given = t.where(F.col("p") == TYPE).select(F.col("s").alias("focus"), F.col("o").alias("c"))
    typed = given.select("focus", F.explode(F.coalesce(F.element_at(up, F.col("c")), F.array("c"))).alias("target")).distinct()
    objects, subjects, nodes = ([c.target[1:] for c in constraints if c.target[0] == mark] for mark in "*^=")
    for names, end, mark in ((objects, "o", "*"), (subjects, "s", "^")):
        if names:
            typed = typed.union(t.where(F.col("p").isin(*names)).select(F.col(end).alias("focus"), F.concat(F.lit(mark), "p").alias("target")).distinct())
    if nodes:
        typed = typed.union(t.sparkSession.createDataFrame([(n, f"={n}") for n in set(nodes)], "focus string, target string"))
    rows = [(i, c.shape, c.target, path, c.kind, c.severity, c.message, c.argument if isinstance(c.argument, int) else None, c.argument if isinstance(c.argument, str) else None, list(c.argument) if isinstance(c.argument, tuple) else None) for i, c in enumerate(constraints) for path in c.path.split("|")]
    table = F.broadcast(t.sparkSession.createDataFrame(rows, "constraint int, shape string, target string, path string, kind string, severity string, message string, number int, name string, names array<string>"))
    checked = typed.join(table, "target")
    asked = {p for c in constraints for p in c.path.split("|")}
    values = t.where(F.col("p").isin(*asked)).select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), "o_kind", "o_dt")
    if back := [p[1:] for p in asked if p.startswith("^")]:
        values = values.union(t.where(F.col("p").isin(*back)).select("o", F.concat(F.lit("^"), "p"), "s", "s_kind", F.lit(None).cast("string")))
    values = values.distinct()
    found = checked.join(values, ["focus", "path"], "left")
    counted = F.col("value").isNotNull() & ((F.col("kind") != "value") | (F.col("value") == F.col("name")))
    counts = found.where("kind in ('min', 'max', 'or', 'value')").groupBy("constraint", "shape", "focus", "kind", "severity", "message", "number").agg(F.count_if(counted).alias("n"), F.min("path").alias("path"))
    wrong = counts.where("(kind = 'min' and n < number) or (kind = 'max' and n > number) or (kind in ('or', 'value') and n = 0)")
    out = wrong.select("shape", "focus", "path", "kind", F.col("n").cast("string").alias("value"), "severity", "message")
    each = found.where("value is not null")
    datatype = F.coalesce("o_dt", F.when(F.col("o_kind") == "literal", F.lit("xsd:string")), F.lit("none"))
    bad = ((F.col("kind") == "datatype") & (datatype != F.col("name"))) | ((F.col("kind") == "iri") & (F.col("o_kind") != "iri")) | ((F.col("kind") == "in") & ~F.array_contains("names", F.col("value")))
    number, plain = F.col("value").try_cast("double"), F.col("o_kind") != "bnode"
    bad = bad | ((F.col("kind") == "node") & ~F.array_contains("names", F.col("o_kind"))) | ((F.col("kind") == "pattern") & ~(plain & F.regexp_like("value", F.col("name"))))
    bad = bad | ((F.col("kind") == "shortest") & ~(plain & (F.length("value") >= F.col("number")))) | ((F.col("kind") == "longest") & ~(plain & (F.length("value") <= F.col("number"))))
    bad = bad | ((F.col("kind") == "least") & ~F.coalesce(number >= F.col("name").try_cast("double"), F.lit(False))) | ((F.col("kind") == "most") & ~F.coalesce(number <= F.col("name").try_cast("double"), F.lit(False)))
    out = out.union(each.where(bad).select("shape", "focus", "path", "kind", "value", "severity", "message"))
    members = typed.select(F.col("focus").alias("value"), F.col("target").alias("name"))
    return out.union(each.where("kind = 'class'").join(members, ["value", "name"], "left_anti").select("shape", "focus", "path", "kind", "value", "severity", "message"))


def conforms(violations: DataFrame) -> bool:
    """Whether nothing worse than a warning was found."""
    return violations.where("severity = 'Violation'").isEmpty()


# The shapes of the vocabulary. A class, then each of its paths with least and most number of values, what they are, and a warning where it is no more than that.
SHAPES: dict[str, list[tuple]] = {
    "Skill": [
        ("resolvesIntent", 1, None, None), ("generatedBy", None, 1, "string"), ("requiresState", None, None, "IRI"), ("yieldsState", None, None, "IRI"), ("handlesFailure", None, None, "IRI"),
        ("impartsKnowledge", None, None, "KnowledgeNode"), ("hasCategory", None, 1, "string"), ("hasVersion", None, 1, "string"), ("hasLicense", None, 1, "string"), ("hasAuthor", None, 1, "string"),
        ("hasPackageName", None, 1, "string"), ("isUserInvocable", None, 1, "boolean"), ("hasArgumentHint", None, 1, "string"), ("hasAllowedTool", None, None, "string"), ("hasAlias", None, None, "string"),
        ("dependsOnSkill", None, None, "Skill", "Warning"), ("impartsKnowledge", 1, None, None, "Warning"),
    ],
    "ExecutableSkill": [("hasPayload", 1, 1, "ExecutionPayload")],
    "DeclarativeSkill": [("hasPayload", None, 0, None)],
    "ExecutionPayload": [("executor", 1, 1, ("shell", "python", "node", "claude_tool")), ("code", None, 1, "string"), ("executionPath", None, 1, "string"), ("timeout", None, 1, "integer"), (("code", "executionPath"), 1, None, None)],
    "State": [("rdfs:label", 1, 1, None, "Warning")],
    "KnowledgeNode": [("directiveContent", 1, 1, "string"), ("appliesToContext", None, 1, "string", "Warning"), ("hasRationale", None, 1, "string", "Warning"), ("severityLevel", None, 1, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))],
    "CodeExample": [("codeLanguage", 1, None, "string"), ("codeContent", 1, None, "string")],
    "Table": [("tableMarkdown", 1, None, "string")],
    "Flowchart": [("flowchartSource", 1, None, "string"), ("flowchartType", 1, None, ("graphviz", "mermaid"))],
    "Template": [("templateContent", 1, None, "string"), ("templateType", None, 1, ("prompt", "output", "boilerplate"))],
    "Section": [("sectionTitle", 1, None, "string"), ("sectionLevel", 1, None, "integer"), ("sectionOrder", 1, None, "integer")],
    "Paragraph": [("textContent", 1, None, "string"), ("contentOrder", 1, None, "integer")],
    "BulletList": [("hasItem", 1, None, "BulletItem")],
    "BulletItem": [("itemText", 1, None, "string"), ("itemOrder", 1, None, "integer")],
    "BlockQuote": [("quoteContent", 1, None, "string"), ("contentOrder", 1, None, "integer"), ("quoteAttribution", None, 1, "string")],
    "HTMLBlock": [("htmlContent", 1, None, "string"), ("contentOrder", 1, None, "integer")],
    "FrontmatterBlock": [("rawYaml", 1, None, "string"), ("contentOrder", 1, None, "integer")],
}
CONTENT = tuple(list(SHAPES)[list(SHAPES).index("CodeExample") :])
#: Classes whose shapes also hold for what a predicate points to.
POINTED_AT = {"KnowledgeNode": "oc:impartsKnowledge"}


def vocabulary(spark: SparkSession, *classes: str) -> DataFrame:
    """The shapes of some classes of the vocabulary, or of all, as a triple table."""
    rows: list[tuple] = []
    blanks = iter(range(1_000_000))

    def say(s: str, p: str, o, kind: str = "iri", dt: str | None = None) -> None:
        rows.append(("shapes", s, "bnode" if s.startswith("_:") else "iri", p, str(o), kind, dt, None))

    def listed(values: list[tuple]) -> str:
        cells = [f"_:l{next(blanks)}" for _ in values]
        for i, value in enumerate(values):
            say(cells[i], "rdf:first", *value)
            say(cells[i], "rdf:rest", *((cells[i + 1], "bnode") if i + 1 < len(cells) else ("rdf:nil",)))
        return cells[0]

    full = lambda name: name if ":" in name else f"oc:{name}"
    for name in classes or SHAPES:
        shape = f"oc:{name}Shape"
        say(shape, TYPE, "sh:NodeShape")
        say(shape, "sh:targetClass", f"oc:{name}")
        if name in POINTED_AT:
            say(shape, "sh:targetObjectsOf", POINTED_AT[name])
        for path, least, most, what, *severity in SHAPES[name]:
            if isinstance(path, tuple):
                sides = []
                for one in path:
                    sides.append((f"_:b{next(blanks)}", "bnode"))
                    say(sides[-1][0], "sh:path", full(one))
                    say(sides[-1][0], "sh:minCount", least, "literal", "xsd:integer")
                say(shape, "sh:or", listed(sides), "bnode")
                continue
            node = f"_:b{next(blanks)}"
            say(shape, "sh:property", node, "bnode")
            say(node, "sh:path", full(path))
            for p, n in (("sh:minCount", least), ("sh:maxCount", most)):
                if n is not None:
                    say(node, p, n, "literal", "xsd:integer")
            if isinstance(what, tuple):
                say(node, "sh:datatype", "xsd:string")
                say(node, "sh:in", listed([(v, "literal", "xsd:string") for v in what]), "bnode")
            elif what == "IRI":
                say(node, "sh:nodeKind", "sh:IRI")
            elif what:
                say(node, "sh:datatype" if what in ("string", "integer", "boolean") else "sh:class", f"xsd:{what}" if what in ("string", "integer", "boolean") else full(what))
            if severity:
                say(node, "sh:severity", f"sh:{severity[0]}")
    return spark.createDataFrame(rows, SCHEMA)


def lists(g: DataFrame) -> DataFrame:
    """(head, n, o, o_kind): the members of each RDF list of a graph, counted from 0.

    Pointer doubling: each cell points to the one before it, then to the one before that one's, and so on, so the rounds are the logarithm of the longest list. A list that
    runs in a circle is an error.
    """
    cells = g.where("p = 'rdf:first'").select(F.col("s").alias("cell"), "o", "o_kind")
    back = g.where("p = 'rdf:rest'").select(F.col("o").alias("cell"), F.col("s").alias("to"))
    ahead = stored(cells.select("cell").distinct().join(back, "cell", "left").select("cell", F.coalesce("to", "cell").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("n")))
    while True:
        further = ahead.join(ahead.select(F.col("cell").alias("to"), F.col("to").alias("beyond"), F.col("n").alias("more")), "to")
        new = stored(further.select("cell", F.col("beyond").alias("to"), (F.col("n") + F.col("more")).alias("n"), (F.col("more") > 0).alias("moved")))
        most, moved = new.agg(F.max("n"), F.count_if("moved")).first()
        if moved and most > 2 * new.count():
            raise ValueError("a list of the shapes runs in a circle")
        drop(ahead)
        ahead = new.drop("moved")
        ahead.stored_at = new.stored_at
        if not moved:
            return ahead.select("cell", F.col("to").alias("head"), "n").join(cells, "cell").select("head", "n", "o", "o_kind")


def read(g: DataFrame) -> tuple[Constraint, ...]:
    """The constraints of a graph of shapes. Shapes or properties that are `sh:deactivated` are left out; what isn't known is an error, not skipped.

    Constraints are few: more than MOST_CONSTRAINTS, or MOST_VALUES values of their lists, are an error.
    """
    facts = g.where("p like 'sh:%'").select("s", "p", "o", "o_kind").distinct()
    if facts.count() > 20 * MOST_CONSTRAINTS:
        raise ValueError("too many shapes")
    said: dict[str, dict[str, list[str]]] = {}
    for r in facts.orderBy("s", "p", "o").toLocalIterator():
        said.setdefault(r.s, {}).setdefault(r.p, []).append(r.o)
    members: dict[str, list[str]] = {}
    if any(p in ("sh:in", "sh:or") for one in said.values() for p in one):
        found = lists(g)
        if found.count() > MOST_VALUES:
            raise ValueError("too many values in lists of shapes")
        for r in found.orderBy("head", "n").toLocalIterator():
            members.setdefault(r.head, []).append(r.o)
    out: list[Constraint] = []
    marks = {"sh:targetClass": "", "sh:targetObjectsOf": "*", "sh:targetSubjectsOf": "^", "sh:targetNode": "="}
    kinds = {"sh:IRI": ("iri",), "sh:BlankNode": ("bnode",), "sh:Literal": ("literal",), "sh:BlankNodeOrIRI": ("bnode", "iri"), "sh:BlankNodeOrLiteral": ("bnode", "literal"), "sh:IRIOrLiteral": ("iri", "literal")}
    simple = {"sh:datatype": "datatype", "sh:class": "class", "sh:hasValue": "value", "sh:minInclusive": "least", "sh:maxInclusive": "most"}
    counts = {"sh:minCount": "min", "sh:maxCount": "max", "sh:minLength": "shortest", "sh:maxLength": "longest"}
    ignored = {"sh:path", "sh:severity", "sh:message", "sh:name", "sh:description", "sh:order", "sh:group", "sh:flags", "sh:deactivated", "sh:defaultValue"}

    def path(node: dict[str, list[str]]) -> str:
        at = node["sh:path"][0]
        return "^" + said[at]["sh:inversePath"][0] if "sh:inversePath" in said.get(at, {}) else at

    for shape, node in said.items():
        targets = [mark + o for p, mark in marks.items() for o in node.get(p, [])]
        if node.get("sh:deactivated") == ["true"]:
            continue
        if unknown := {p for p in node if targets and p not in {*marks, "sh:property", "sh:or", *ignored}}:
            raise ValueError(f"{shape}: {', '.join(sorted(unknown))} isn't known")
        name = shape.split(":")[-1].removesuffix("Shape")
        for target in targets:
            for one in node.get("sh:or", []):
                sides = [said[m] for m in members.get(one, [])]
                if any({p for p in s if p not in ignored} != {"sh:minCount"} or s["sh:minCount"] != ["1"] for s in sides):
                    raise ValueError(f"{shape}: sh:or takes paths that must be there")
                out.append(Constraint(name, target, "|".join(path(s) for s in sides), "or", None, (node.get("sh:severity") or ["sh:Violation"])[0].split(":")[-1]))
            for property_ in node.get("sh:property", []):
                rule = said[property_]
                severity = (rule.get("sh:severity") or ["sh:Violation"])[0].split(":")[-1]
                if rule.get("sh:deactivated") == ["true"]:
                    continue
                for p, values in rule.items():
                    for value in values:
                        if p in counts:
                            kind, argument = counts[p], int(value)
                        elif p in simple:
                            kind, argument = simple[p], value
                        elif p == "sh:pattern":
                            flags = (rule.get("sh:flags") or [""])[0]
                            kind, argument = "pattern", (f"(?{flags})" if flags else "") + value
                        elif p == "sh:nodeKind":
                            kind, argument = ("iri", None) if value == "sh:IRI" else ("node", kinds[value])
                        elif p == "sh:in":
                            kind, argument = "in", tuple(members.get(value, ()))
                        elif p in ignored:
                            continue
                        else:
                            raise ValueError(f"{shape}: {p} isn't known")
                        out.append(Constraint(name, target, path(rule), kind, argument, severity))
    if len(out) > MOST_CONSTRAINTS:
        raise ValueError("too many constraints")
    return tuple(out)
