"""Inference by rules to a fixpoint, with equality, and violations of axioms.

Rounds are semi-naive: rules are applied to what the last round added, and joined with all that is known where they need two facts. Nodes that are the
same, stated or by functional properties, are one class with one representative: facts hold of representatives, and a table has
the members, so that a class of n nodes has n rows and not n times its facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.catalog import superclasses
from graphwright.operators.closure import closure, closure_rounds, representatives
from graphwright.operators.triples import TYPE, facts
from graphwright.sources.scratch import drop, stored, together

# The axioms of the vocabulary.
INVERSES = {"oc:dependsOn": "oc:enables", "oc:dependsOnSkill": "oc:enablesSkill", "oc:extends": "oc:isExtendedBy", "oc:derivedFromSection": "oc:isSourceOf", "oc:correctAlternative": "oc:isAlternativeTo", "oc:appliesToStep": "oc:hasStepConstraint"}
SYMMETRIC = ("oc:contradicts",)
TRANSITIVE = ("oc:extends",)
SUB_PROPERTIES = {"oc:impartsKnowledge": "oc:inheritsKnowledge"}
CHAINS = {"oc:inheritsKnowledge": ("oc:extends", "oc:impartsKnowledge")}
DOMAINS = {"oc:impartsKnowledge": ("oc:Skill", "oc:KnowledgeNode"), "oc:extends": ("oc:Skill", "oc:Skill")}
ASYMMETRIC = ("oc:impartsKnowledge", "oc:dependsOn", "oc:dependsOnSkill")
IRREFLEXIVE = ("oc:impartsKnowledge",)
DISJOINT = (("oc:ExecutableSkill", "oc:DeclarativeSkill"),)
SAME = "owl:sameAs"


@dataclass(frozen=True)
class Axioms:
    """What holds of properties and classes. `equivalent` pairs of properties imply each other."""

    inverses: Sequence[tuple[str, str]] = tuple(INVERSES.items())
    symmetric: Sequence[str] = SYMMETRIC
    transitive: Sequence[str] = TRANSITIVE
    sub_properties: Sequence[tuple[str, str]] = tuple(SUB_PROPERTIES.items())
    equivalent: Sequence[tuple[str, str]] = ()
    chains: Sequence[tuple[str, tuple[str, str]]] = tuple(CHAINS.items())
    domains: Sequence[tuple[str, tuple[str, str]]] = tuple(DOMAINS.items())
    functional: Sequence[str] = ()
    inverse_functional: Sequence[str] = ()
    equivalent_classes: Sequence[tuple[str, str]] = ()


VOCABULARY = Axioms()


def _links(t: DataFrame) -> DataFrame:
    return t.where("o_kind <> 'literal'").select("s", "p", "o").distinct()


def inverse(links: DataFrame) -> DataFrame:
    """Both ways of inverse properties."""
    other = INVERSES | {b: a for a, b in INVERSES.items()}
    names = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
    return links.where(F.col("p").isin(*other)).select(F.col("o").alias("s"), names[F.col("p")].alias("p"), F.col("s").alias("o"))


def symmetric(links: DataFrame) -> DataFrame:
    """Symmetric properties the other way."""
    return links.where(F.col("p").isin(*SYMMETRIC)).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def sub_properties(links: DataFrame) -> DataFrame:
    """What holds by a property that is part of another."""
    names = F.create_map(*[F.lit(x) for pair in SUB_PROPERTIES.items() for x in pair])
    return links.where(F.col("p").isin(*SUB_PROPERTIES)).select("s", names[F.col("p")].alias("p"), "o")


def chains(links: DataFrame) -> DataFrame:
    """What follows from two properties one after the other."""
    out = None
    for made, (first, then) in CHAINS.items():
        a, b = facts_of(links, first, "s", "m"), facts_of(links, then, "m", "o")
        rows = a.join(b, "m").select("s", F.lit(made).alias("p"), "o")
        out = rows if out is None else out.union(rows)
    return out.distinct()


def facts_of(links: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return links.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def transitive(links: DataFrame) -> DataFrame:
    """Transitive properties, closed."""
    out = None
    for p in TRANSITIVE:
        rows = closure(facts_of(links, p, "src", "dst")).select(F.col("src").alias("s"), F.lit(p).alias("p"), F.col("dst").alias("o"))
        out = rows if out is None else out.union(rows)
    return out


def types(links: DataFrame, subclasses: list[tuple[str, str]]) -> DataFrame:
    """Types from domains, ranges and superclasses. subclasses: (sub, super) pairs of a vocabulary."""
    up = F.create_map(*[x for c, above in superclasses(subclasses).items() for x in (F.lit(c), F.array(*map(F.lit, above)))])
    given = facts_of(links, TYPE, "s", "c")
    for p, (domain, range_) in DOMAINS.items():
        rows = links.where(F.col("p") == p)
        given = given.union(rows.select("s", F.lit(domain))).union(rows.select("o", F.lit(range_)))
    return given.distinct().select("s", F.lit(TYPE).alias("p"), F.explode(F.coalesce(F.element_at(up, F.col("c")), F.array("c"))).alias("o")).distinct()


#: How a link was made, where that spares work: by a transitive property's closure, by the one inverse of its property, or by the chain of that number from CHAIN on.
CLOSED, TURNED, CHAIN = 1, 2, 3


def _follow(new: DataFrame, known: DataFrame, axioms: Axioms, subclasses: list[tuple[str, str]], first: bool) -> tuple[DataFrame, set[str]]:
    """(s, p, o, by): what follows from new links, alone or with one of the known, which have the new ones among them, and the properties that it may have. One scan of the new ones gives all
    that follows from a single link. At `first` all links are new, and transitive properties are closed.

    What can only give known links is left out: a link turned round again; classes of the ends of a link of a closure, which its first and last edge have; and a property that is inherited along a
    transitive one (a chain that makes its own second part) handed on again, since the transitive one leads from the start.
    """
    at = F.col("p")
    both = list(dict.fromkeys([*axioms.inverses, *[(b, a) for a, b in axioms.inverses], *[(p, p) for p in axioms.symmetric]]))
    below = [*axioms.sub_properties, *axioms.equivalent, *[(b, a) for a, b in axioms.equivalent]]
    up = superclasses([*subclasses, *axioms.equivalent_classes, *[(b, a) for a, b in axioms.equivalent_classes]])
    # of each property: what is made of it (subject, property, object), how, and the links it isn't made of
    single: dict[str, list[Column]] = {}

    def made(of: str, s: str, p: str, o: str, by: int | None = None, unless: int = 0) -> None:
        single.setdefault(of, []).append(F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o"), F.lit(by).cast("int").alias("by"), F.lit(unless).alias("unless")))

    for a, b in both:
        made(a, "o", b, "s", TURNED if [y for x, y in both if x == b] == [a] else None, TURNED)
    for a, b in below:
        made(a, "s", b, "o")
    for p, (domain, range_) in axioms.domains:
        for end, c in (("s", domain), ("o", range_)):
            if c:
                made(p, end, TYPE, c, unless=CLOSED)
    chains = [(m, f, t, CHAIN + i if m == t and f in axioms.transitive else None) for i, (m, (f, t)) in enumerate(axioms.chains)] + [(p, p, p, None) for p in axioms.transitive if not first]
    names = {*single, TYPE, *[x for _, f, t, _ in chains for x in (f, t)]}
    here = {(r.p, r.by) for r in new.where(at.isin(*names)).select("p", "by").distinct().collect()}
    present, rows, targets = {p for p, _ in here}, [], set()
    if single and present & {*single}:
        rules = F.create_map(*[x for of, rs in single.items() for x in (F.lit(of), F.array(*rs))])
        one = new.where(at.isin(*single)).select("s", "o", "by", F.explode(rules[at]).alias("r")).where("by is null or by <> r.unless")
        end = lambda c: F.when(c == "s", F.col("s")).when(c == "o", F.col("o")).otherwise(c)
        rows.append(one.select(end(F.col("r.s")).alias("s"), "r.p", end(F.col("r.o")).alias("o"), "r.by"))
        targets |= {b for a, b in [*both, *below] if a in present} | {TYPE for p, _ in axioms.domains if p in present}
    none = F.lit(None).cast("int").alias("by")
    if up and TYPE in present:
        above = F.create_map(*[x for c, more in up.items() for x in (F.lit(c), F.array(*map(F.lit, more)))])
        rows.append(new.where((at == TYPE) & F.col("o").isin(*up)).select("s", "p", F.explode(F.element_at(above, F.col("o"))).alias("o"), none))
        targets.add(TYPE)
    for name, head, tail, by in chains:
        own = lambda df: df.where(F.coalesce(F.col("by") != by, F.lit(True))) if by else df  # noqa: B023, E731
        sides = [(new, known)] * (head in present) + [(known, new)] * (not first and any(p == tail and (by is None or b != by) for p, b in here))
        for a, b in sides:
            rows.append(facts_of(a, head, "s", "m").join(facts_of(own(b), tail, "m", "o"), "m").select("s", F.lit(name).alias("p"), "o", F.lit(by).cast("int").alias("by")))
            targets.add(name)
    if not rows:
        return new.where("false"), targets
    return reduce(DataFrame.union, rows).groupBy("s", "p", "o").agg(F.min("by").alias("by")), targets


def _equal(new: DataFrame, known: DataFrame, axioms: Axioms) -> DataFrame:
    """(src, dst): nodes that new links make the same: stated, or objects of a functional property of one subject, or subjects of an inverse functional one of one object. Each with the least, so no group has all its pairs."""
    rows = [new.where(F.col("p") == SAME).select(F.col("s").alias("src"), F.col("o").alias("dst"))]
    for names, key, value in ((axioms.functional, "s", "o"), (axioms.inverse_functional, "o", "s")):
        if names:
            touched = new.where(F.col("p").isin(*names)).select("p", key).distinct()
            of = known.where(F.col("p").isin(*names)).join(touched, ["p", key])
            least = of.groupBy("p", key).agg(F.min(value).alias("least"), F.max(value).alias("most")).where("least <> most")
            rows.append(of.join(least, ["p", key]).where(F.col(value) != F.col("least")).select(F.col(value).alias("src"), F.col("least").alias("dst")))
    return reduce(DataFrame.union, rows).distinct()


def fixpoint(t: DataFrame, subclasses: list[tuple[str, str]], axioms: Axioms = VOCABULARY) -> tuple[DataFrame, DataFrame, list[int]]:
    """(s, p, o) of representatives, (node, representative) of nodes that are the same as others, and how many links each round added.

    A representative is the least node of its class. Links of other members are moved to it, and links so moved count as new, since a rule may join them now. Stated equality is in the
    second table only. Literals take part in nothing.
    """
    plain = lambda links: links.select("s", "p", "o", F.lit(None).cast("int").alias("by"))
    new = stored(plain(_links(t)))
    tables, closed, same, edges, added, first = [new], [], None, None, [], True
    every = lambda: reduce(DataFrame.union, [together(*tables), *closed])
    while True:
        while True:  # links moved to a representative may make more nodes the same
            known = every()
            equal = _equal(new, known, axioms).where("src <> dst")
            equal = stored(equal if edges is None else equal.join(edges, ["src", "dst"], "left_anti"))
            if equal.isEmpty():
                break
            edges = equal if edges is None else stored(edges.union(equal))
            same = stored(representatives(edges))
            moved = known
            for end in ("s", "o"):
                names = same.where("node <> representative").select(F.col("node").alias(end), "representative")
                moved = moved.join(names, end, "left").withColumn(end, F.coalesce("representative", end)).drop("representative")
            moved = stored(plain(moved.select("s", "p", "o").distinct()))
            # the moved links, and those of the new ones that stayed
            new = stored(plain(moved.join(known, ["s", "p", "o"], "left_anti").select("s", "p", "o").union(new.join(moved, ["s", "p", "o"], "left_semi").select("s", "p", "o")).distinct()))
            tables, closed = [moved], []
        if first:
            for p in axioms.transitive:
                _, *more = closure_rounds(facts_of(known, p, "src", "dst"))
                if more:
                    closed.append(together(*more).select(F.col("src").alias("s"), F.lit(p).alias("p"), F.col("dst").alias("o"), F.lit(CLOSED).alias("by")))
                counts = [table.count() for table in more]
                added = [sum(x) for x in zip_longest(added, counts, fillvalue=0)]
            new = known = every()
        follows, targets = _follow(new, known, axioms, subclasses, first)
        # only links of properties that were made can be known already
        follows = stored(follows.join(known.where(F.col("p").isin(*targets)), ["s", "p", "o"], "left_anti"))
        first, n = False, follows.count()
        if not n:
            drop(follows)
            break
        added.append(n)
        new = follows
        tables.append(follows)
    members = same if same is not None else known.sparkSession.createDataFrame([], "node string, representative string")
    return every().where(F.col("p") != SAME).select("s", "p", "o"), members, added


def infer(t: DataFrame, subclasses: list[tuple[str, str]], axioms: Axioms = VOCABULARY) -> DataFrame:
    """(s, p, o): all links of a graph and what the rules add, to the fixpoint; of nodes that are the same those of the representative."""
    return fixpoint(t, subclasses, axioms)[0]


def violations(t: DataFrame) -> DataFrame:
    """(kind, s, p, o): links against asymmetric, irreflexive and disjoint axioms."""
    links = _links(t)
    some = links.where(F.col("p").isin(*ASYMMETRIC))
    back = some.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    out = some.join(back, ["s", "p", "o"], "left_semi").select(F.lit("asymmetric").alias("kind"), "s", "p", "o")
    out = out.union(links.where(F.col("p").isin(*IRREFLEXIVE) & (F.col("s") == F.col("o"))).select(F.lit("irreflexive"), "s", "p", "o"))
    for a, b in DISJOINT:
        both = facts(t, TYPE, "s", "c").where(F.col("c").isin(a, b)).distinct().groupBy("s").agg(F.count("*").alias("n")).where("n = 2")
        out = out.union(both.select(F.lit("disjoint"), "s", F.lit(a), F.lit(b)))
    return out
