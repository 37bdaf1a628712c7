"""Queries of inference, shapes, links, security and registries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.operators import catalog, links, reason, registry, security, shapes
from graphwright.operators.triples import facts
from graphwright.plans import sparql
from graphwright.queries.graph import query, table
from graphwright.sources import star_graph as sg


def _links(spark, sf_dir) -> DataFrame:
    return sg.old_graph(spark, sf_dir).where("o_kind <> 'literal'").select("s", "p", "o")


@query("SELECT dst AS s, 'oc:isExtendedBy' AS p, src AS o FROM ups UNION ALL SELECT dst, 'oc:enablesSkill', src FROM deps")
def rsn_inverse(spark, sf_dir):
    """Inverse links."""
    return reason.inverse(_links(spark, sf_dir))


@query("SELECT dst AS s, 'oc:contradicts' AS p, src AS o FROM ups WHERE length(src) % 2 = 0")
def rsn_symmetric(spark, sf_dir):
    """Symmetric links the other way; some inheritance serves as contradiction."""
    rows = facts(sg.old_graph(spark, sf_dir), "oc:extends", "s", "o").where("length(s) % 2 = 0").select("s", F.lit("oc:contradicts").alias("p"), "o")
    return reason.symmetric(rows)


@query(", n AS (SELECT count(*) AS n FROM part) SELECT DISTINCT src AS s, 'oc:inheritsKnowledge' AS p, 'oc:kn_' || doc_id AS o FROM documents, n, ups WHERE dst = 'oc:skill_' || (doc_id % n)")
def rsn_chain(spark, sf_dir):
    """Knowledge inherited by one step."""
    return reason.chains(sg.graph(spark, sf_dir).where("o_kind <> 'literal'").select("s", "p", "o"))


_FIX = """, l AS (SELECT s, 'rdf:type' AS p, 'oc:Skill' AS o FROM k UNION SELECT s, 'rdf:type', CASE WHEN p_size % 2 = 0 THEN 'oc:ExecutableSkill' ELSE 'oc:DeclarativeSkill' END FROM k
  UNION SELECT src, 'oc:extends', dst FROM ups UNION SELECT src, 'oc:dependsOnSkill', dst FROM deps UNION SELECT s, 'oc:requiresState', requires FROM k UNION SELECT s, 'oc:yieldsState', yields FROM k UNION SELECT s, 'oc:hasRequirement', requirement FROM k
  UNION SELECT requirement, 'rdf:type', ['oc:RequirementTool', 'oc:RequirementFile', 'oc:RequirementEnv'][p_size % 3 + 1] FROM k),
n AS (SELECT count(*) AS n FROM part), i AS (SELECT 'oc:skill_' || (doc_id % n) AS s, 'oc:kn_' || doc_id AS o, doc_id FROM documents, n)"""


@query(_FIX + """, x AS (SELECT src, dst FROM ups), e AS (SELECT src, dst FROM x UNION SELECT e.src, x.dst FROM e JOIN x ON e.dst = x.src),
h AS (SELECT s, o FROM i UNION SELECT e.src, i.o FROM e JOIN i ON e.dst = i.s),
kinds AS (SELECT doc_id, ['oc:NormativeRule', 'oc:StrategicInsight', 'oc:ResilienceTactic', 'oc:ExecutionPhysics', NULL][doc_id % 5 + 1] AS d, ['oc:Standard', 'oc:Heuristic', 'oc:KnownIssue', 'oc:SideEffect', 'oc:Procedure'][doc_id % 5 + 1] AS kind FROM documents),
a AS (SELECT * FROM l UNION SELECT src, 'oc:extends', dst FROM e UNION SELECT dst, 'oc:isExtendedBy', src FROM e UNION SELECT dst, 'oc:enablesSkill', src FROM deps
  UNION SELECT s, 'oc:impartsKnowledge', o FROM i UNION SELECT s, 'oc:inheritsKnowledge', o FROM h UNION SELECT o, 'rdf:type', 'oc:KnowledgeNode' FROM i
  UNION SELECT 'oc:kn_' || doc_id, 'rdf:type', unnest([d, kind]) FROM kinds)
SELECT p, CASE WHEN p = 'rdf:type' THEN o ELSE '' END AS class, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT s) AS BIGINT) AS subjects FROM a WHERE o IS NOT NULL GROUP BY ALL""")
def rsn_fixpoint(spark, sf_dir):
    """All links that hold, counted by property and class: inherited knowledge along any number of extensions, inverses and types."""
    axioms = reason.Axioms(chains=[("oc:inheritsKnowledge", ("oc:extends", "oc:inheritsKnowledge"))], domains=[("oc:impartsKnowledge", ("oc:Skill", "oc:KnowledgeNode")), ("oc:extends", ("oc:Skill", "oc:Skill"))])
    found = reason.infer(sg.graph(spark, sf_dir), catalog.class_tree(), axioms)
    return found.groupBy("p", F.when(F.col("p") == "rdf:type", F.col("o")).otherwise("").alias("class")).agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query(""", tie AS (SELECT a.yields AS x, b.yields AS y FROM k a JOIN k b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 9 = 0 AND a.yields <> b.yields), b AS (SELECT x, y FROM tie UNION SELECT y, x FROM tie),
c(x, y) AS (SELECT x, y FROM b UNION SELECT x, x FROM b UNION SELECT c.x, b.y FROM c JOIN b ON c.y = b.x), r AS (SELECT x AS node, min(y) AS representative FROM c GROUP BY x),
z AS (SELECT a.s AS node, least(a.s, b.s) AS representative FROM k a JOIN k b ON b.p_partkey = a.p_partkey + 1 AND a.p_partkey % 9 = 0 OR b.p_partkey = a.p_partkey - 1 AND b.p_partkey % 9 = 0)
SELECT node, representative FROM r UNION SELECT node, representative FROM z""")
def rsn_same(spark, sf_dir):
    """Every ninth skill is the same as the next one, and a skill yields one state: so states are the same too, and whole classes of them."""
    t = sg.old_graph(spark, sf_dir).where("p in ('oc:yieldsState', 'oc:requiresState')")
    k = F.col("p_partkey")
    ninth = table(spark, sf_dir, "part").select(k).where(k % 9 == 0)
    next_ = table(spark, sf_dir, "part").select((k - 1).alias("p_partkey"))
    ties = ninth.join(next_, "p_partkey").select(F.concat(F.lit("oc:skill_"), k.cast("string")).alias("s"), F.concat(F.lit("oc:skill_"), (k + 1).cast("string")).alias("o"))
    ties = ties.select(F.lit("old").alias("graph_id"), "s", F.lit("iri").alias("s_kind"), F.lit(reason.SAME).alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return reason.fixpoint(t.union(ties), [], reason.Axioms(functional=["oc:yieldsState"]))[1]


@query("SELECT 'ExecutableSkill' AS shape, s AS focus, 'oc:hasPayload' AS path, '0' AS value FROM k WHERE skill_type = 'executable'")
def shacl_min_count(spark, sf_dir):
    """Executable skills have no payload in this graph."""
    wanted = tuple(c for c in shapes.CONSTRAINTS if c.shape == "ExecutableSkill")
    return shapes.validate(sg.old_graph(spark, sf_dir), catalog.class_tree(), wanted).select("shape", "focus", "path", "value")


@query("SELECT s AS focus, tier AS value FROM k WHERE tier NOT IN ('official', 'local')")
def shacl_in(spark, sf_dir):
    """Values outside a list."""
    wanted = (shapes.Constraint("Tier", "oc:Skill", "oc:trustTier", "in", ("official", "local")),)
    return shapes.validate(sg.old_graph(spark, sf_dir), catalog.class_tree(), wanted).select("focus", "value")


@query("SELECT s AS focus, 'oc:skill_' || (p_partkey // 2) AS value FROM k WHERE p_partkey > 0 AND (SELECT p_size % 2 FROM part q WHERE q.p_partkey = k.p_partkey // 2) = 1")
def shacl_class(spark, sf_dir):
    """Parents that aren't executable."""
    wanted = (shapes.Constraint("Parent", "oc:Skill", "oc:extends", "class", "oc:ExecutableSkill"),)
    return shapes.validate(sg.old_graph(spark, sf_dir), catalog.class_tree(), wanted).select("focus", "value")


#: Content in the order of its shapes: class, path, value, datatype, and the one that is wrong.
_CONTENT = [
    ("CodeExample", "codeLanguage", "python", "xsd:string", "xsd:integer"), ("CodeExample", "codeContent", "x = 1", "xsd:string", "xsd:integer"),
    ("Table", "tableMarkdown", "| a |", "xsd:string", "rdf:langString"), ("Flowchart", "flowchartSource", "a->b", "xsd:string", "xsd:integer"), ("Flowchart", "flowchartType", "mermaid", "xsd:string", "xsd:token"),
    ("Template", "templateContent", "hi", "xsd:string", "xsd:integer"), ("Template", "templateType", "prompt", "xsd:string", "xsd:integer"), ("Section", "sectionTitle", "T", "xsd:string", "xsd:integer"),
    ("Section", "sectionLevel", "1", "xsd:integer", "xsd:string"), ("Section", "sectionOrder", "2", "xsd:integer", "xsd:long"), ("Paragraph", "textContent", "words", "xsd:string", "xsd:integer"),
    ("Paragraph", "contentOrder", "3", "xsd:integer", "xsd:string"), ("BulletList", "hasItem", "oc:c_7", "iri", ""), ("BulletItem", "itemText", "one", "xsd:string", "xsd:integer"), ("BulletItem", "itemOrder", "4", "xsd:integer", "xsd:string"),
    ("BlockQuote", "quoteContent", "said", "xsd:string", "xsd:integer"), ("BlockQuote", "contentOrder", "5", "xsd:integer", "xsd:string"), ("BlockQuote", "quoteAttribution", "me", "xsd:string", "xsd:integer"),
    ("HTMLBlock", "htmlContent", "<p>", "xsd:string", "rdf:HTML"), ("HTMLBlock", "contentOrder", "6", "xsd:integer", "xsd:string"), ("FrontmatterBlock", "rawYaml", "a: 1", "xsd:string", "xsd:integer"), ("FrontmatterBlock", "contentOrder", "0", "xsd:integer", "xsd:string"),
]


@query("""WITH plan(i, class, path, value, good, wrong, least, most, listed) AS (VALUES (0, 0, 'codeLanguage', 'python', 'string', 'integer', 1, 99, NULL), (1, 0, 'codeContent', 'x = 1', 'string', 'integer', 1, 99, NULL), (2, 1, 'tableMarkdown', '| a |', 'string', 'x', 1, 99, NULL),
(3, 2, 'flowchartSource', 'a->b', 'string', 'x', 1, 99, NULL), (4, 2, 'flowchartType', 'mermaid', 'string', 'x', 1, 99, 'graphviz mermaid'), (5, 3, 'templateContent', 'hi', 'string', 'x', 1, 99, NULL), (6, 3, 'templateType', 'prompt', 'string', 'x', 0, 1, 'prompt output boilerplate'),
(7, 4, 'sectionTitle', 'T', 'string', 'x', 1, 99, NULL), (8, 4, 'sectionLevel', '1', 'integer', 'x', 1, 99, NULL), (9, 4, 'sectionOrder', '2', 'integer', 'x', 1, 99, NULL), (10, 5, 'textContent', 'words', 'string', 'x', 1, 99, NULL), (11, 5, 'contentOrder', '3', 'integer', 'x', 1, 99, NULL),
(12, 6, 'hasItem', 'oc:c_7', NULL, NULL, 1, 99, NULL), (13, 7, 'itemText', 'one', 'string', 'x', 1, 99, NULL), (14, 7, 'itemOrder', '4', 'integer', 'x', 1, 99, NULL), (15, 8, 'quoteContent', 'said', 'string', 'x', 1, 99, NULL), (16, 8, 'contentOrder', '5', 'integer', 'x', 1, 99, NULL),
(17, 8, 'quoteAttribution', 'me', 'string', 'x', 0, 1, NULL), (18, 9, 'htmlContent', '<p>', 'string', 'x', 1, 99, NULL), (19, 9, 'contentOrder', '6', 'integer', 'x', 1, 99, NULL), (20, 10, 'rawYaml', 'a: 1', 'string', 'x', 1, 99, NULL), (21, 10, 'contentOrder', '0', 'integer', 'x', 1, 99, NULL)),
named(class, shape) AS (SELECT i, ['CodeExample', 'Table', 'Flowchart', 'Template', 'Section', 'Paragraph', 'BulletList', 'BulletItem', 'BlockQuote', 'HTMLBlock', 'FrontmatterBlock'][i + 1] FROM range(11) r(i)),
x AS (SELECT 'oc:c_' || doc_id AS focus, doc_id // 11 + i AS turn, plan.* FROM documents JOIN plan ON class = doc_id % 11),
v AS (SELECT focus, class, path, unnest([value, CASE WHEN turn % 7 = 2 THEN value || '2' END]) AS value, CASE WHEN turn % 5 = 1 THEN wrong ELSE good END AS dt, good, listed FROM x WHERE turn % 4 <> 0),
n AS (SELECT focus, class, path, least, most, CASE WHEN turn % 4 = 0 THEN 0 WHEN turn % 7 = 2 THEN 2 ELSE 1 END AS n FROM x)
SELECT shape, focus, 'oc:' || path AS path, kind, value FROM named JOIN (
  SELECT class, focus, path, 'min' AS kind, CAST(n AS VARCHAR) AS value FROM n WHERE n < least UNION ALL SELECT class, focus, path, 'max', CAST(n AS VARCHAR) FROM n WHERE n > most
  UNION ALL SELECT class, focus, path, 'datatype', value FROM v WHERE value IS NOT NULL AND dt <> good UNION ALL SELECT class, focus, path, 'in', value FROM v WHERE value IS NOT NULL AND NOT list_contains(string_split(listed, ' '), value)
  UNION ALL SELECT class, focus, path, 'class', value FROM v WHERE class = 6 AND value IS NOT NULL AND value NOT IN (SELECT 'oc:c_' || doc_id FROM documents WHERE doc_id % 11 = 7)) USING (class)""", skills=False)
def shacl_content(spark, sf_dir):
    """Violations of the eleven shapes of content, whose constraints are read from their graph."""
    found = shapes.validate(sg.content_nodes(table(spark, sf_dir, "documents"), _CONTENT), catalog.class_tree(), shapes.read(shapes.vocabulary(spark, *shapes.CONTENT)))
    return found.select("shape", "focus", "path", "kind", "value")


@query("""SELECT shape, path, kind, severity, CAST(n AS BIGINT) AS n FROM (
  SELECT 'ExecutableSkill' AS shape, 'oc:hasPayload' AS path, 'min' AS kind, 'Violation' AS severity, count(*) AS n FROM k WHERE skill_type = 'executable'
  UNION ALL SELECT 'Skill', 'oc:impartsKnowledge', 'min', 'Warning', count(*) - (SELECT count(DISTINCT doc_id % (SELECT count(*) FROM part)) FROM documents) FROM k) WHERE n > 0""")
def shacl_vocabulary(spark, sf_dir):
    """Violations of all shapes of the vocabulary in the graph of skills and knowledge, counted by constraint."""
    found = shapes.validate(sg.graph(spark, sf_dir), catalog.class_tree(), shapes.read(shapes.vocabulary(spark)))
    return found.groupBy("shape", "path", "kind", "severity").agg(F.count("*").alias("n"))


@query("""SELECT severity, shape, CAST(n AS BIGINT) AS n FROM (
  SELECT 'Violation' AS severity, 'ExecutableSkill' AS shape, count(*) AS n FROM k WHERE skill_type = 'executable'
  UNION ALL SELECT 'Warning', 'Skill', count(*) - (SELECT count(DISTINCT doc_id % (SELECT count(*) FROM part)) FROM documents) + (SELECT count(*) FROM k WHERE p_partkey % 20 >= 5 AND p_partkey = 0) FROM k
  UNION ALL SELECT 'Warning', 'State', count(DISTINCT requires) FROM k
  UNION ALL SELECT 'Warning', 'KnowledgeNode', count(*) FROM documents) WHERE n > 0""")
def shacl_summary(spark, sf_dir):
    """Violations of all constraints by severity and shape."""
    return shapes.validate(sg.graph(spark, sf_dir), catalog.class_tree()).groupBy("severity", "shape").agg(F.count("*").alias("n"))


@query(
    "SELECT doc_id AS id, threat_type, CAST(pattern AS INTEGER) AS pattern, match FROM (SELECT doc_id, unnest(["
    + ", ".join("struct_pack(threat_type := '{}', pattern := {}, match := regexp_extract(text, '{}', {}))".format(kind, i, p.replace("'", "''"), security.group(p)) for kind, ps in security.PATTERNS.items() for i, p in enumerate(ps))
    + "], recursive := true) FROM documents) WHERE match <> ''",
    skills=False,
)
def sec_scan(spark, sf_dir):
    """Threats in normalised documents; the SQL doesn't normalise, and agrees where no text hides a match."""
    return security.scan(table(spark, sf_dir, "documents"))


@query("""SELECT node, section, CAST(shared AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY shared DESC, section) AS i FROM (
  SELECT node, section, count(DISTINCT word) AS shared FROM
    (SELECT s_suppkey AS node, unnest(list_distinct(list_filter(regexp_split_to_array(lower(context), '[^\\p{L}\\p{N}_]+'), lambda w: w <> ''))) AS word FROM (SELECT s_suppkey, p_name || ' ' || p_type AS context FROM supplier JOIN part ON p_partkey = s_suppkey * 3))
    JOIN (SELECT p_partkey AS section, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name)) USING (word) GROUP BY node, section) WHERE shared >= 2) WHERE i = 1""", skills=False)
def link_derived_section(spark, sf_dir):
    """Contexts and titles that share words: suppliers stand for contexts and parts for titles. Parts of one name are one title, with the least key, as the first of equals wins."""
    part = table(spark, sf_dir, "part")
    contexts = table(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey") * 3).select(F.col("s_suppkey").alias("node"), F.lit(1).alias("scope"), F.concat_ws(" ", "p_name", "p_type").alias("context"))
    titles = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("section")).withColumn("scope", F.lit(1))
    return links.best_sections(contexts, titles)


_LOCK = ", lock AS (SELECT p_brand AS package_id, id AS skill_id, tier AS trust_tier, p_partkey % 10 = 0 AS enabled, p_partkey FROM k), need AS (SELECT 'part-' || substr(src, 10) AS skill_id, 'part-' || substr(dst, 10) AS needs FROM ups)"


def _lock(spark, sf_dir):
    wide = catalog.skills(sg.old_graph(spark, sf_dir))
    lock = wide.select("package_id", F.col("id").alias("skill_id"), "trust_tier", (F.regexp_replace("id", "part-", "").cast("bigint") % 10 == 0).alias("enabled"))
    cut = lambda c: F.concat(F.lit("part-"), F.substring(c, 10, 20))
    needs = facts(sg.old_graph(spark, sf_dir), "oc:extends", "src", "dst").select(cut("src").alias("skill_id"), cut("dst").alias("needs"))
    return lock, needs


@query(_LOCK + ", up(skill_id) AS (SELECT 'part-77' UNION SELECT needs FROM need JOIN up USING (skill_id)) SELECT package_id, skill_id, enabled OR skill_id IN (SELECT skill_id FROM up) AS enabled FROM lock")
def reg_enable_closure(spark, sf_dir):
    """A skill enabled with all it needs."""
    lock, needs = _lock(spark, sf_dir)
    return registry.enable(lock, needs, spark.createDataFrame([("part-77",)], "skill_id string")).select("package_id", "skill_id", "enabled")


@query(_LOCK + ", down(skill_id) AS (SELECT 'part-5' UNION SELECT need.skill_id FROM need JOIN down ON needs = down.skill_id JOIN lock ON lock.skill_id = need.skill_id AND lock.enabled) SELECT package_id, skill_id, enabled AND skill_id NOT IN (SELECT skill_id FROM down) AS enabled FROM lock")
def reg_disable_closure(spark, sf_dir):
    """A skill disabled with the enabled ones that need it."""
    lock, needs = _lock(spark, sf_dir)
    return registry.disable(lock, needs, spark.createDataFrame([("part-5",)], "skill_id string")).select("package_id", "skill_id", "enabled")


@query("SELECT DISTINCT id AS skill_id, 'part-' || substr(dst, 10) AS needs FROM k JOIN (FROM ups UNION FROM deps) ON src = s UNION SELECT id, 'new-thing-' || p_partkey FROM k WHERE p_partkey % 7 = 0")
def reg_relations(spark, sf_dir):
    """What skills extend or depend on by three predicates; some depend on skills that aren't there, on texts and on other terms."""
    k = F.col("p_partkey")
    node, none = F.concat(F.lit("oc:skill_"), k.cast("string")), F.lit(None).cast("string")
    more = F.array(F.struct(F.concat(F.lit("oc:skill_new_thing_"), k.cast("string")).alias("o"), F.lit("iri").alias("o_kind")), F.struct(F.lit("oc:skill_text").alias("o"), F.lit("literal").alias("o_kind")), F.struct(F.lit("oc:Other").alias("o"), F.lit("iri").alias("o_kind")))
    rows = table(spark, sf_dir, "part").where(k % 7 == 0).select(node.alias("s"), F.inline(more)).select(F.lit("old").alias("graph_id"), "s", F.lit("iri").alias("s_kind"), F.lit("oc:dependsOn").alias("p"), "o", "o_kind", none.alias("o_dt"), none.alias("o_lang"))
    return registry.skill_relations(sg.old_graph(spark, sf_dir).union(rows))


_TWO = ", lock AS (SELECT pkg AS package_id, id AS skill_id, CASE pkg WHEN 'mine' THEN 'community' WHEN 'other' THEN 'official' ELSE 'local' END AS trust_tier, p_partkey % 10 <> 3 AS enabled, p_partkey FROM k, (VALUES ('mine'), ('other'), ('third')) v(pkg) WHERE pkg <> 'mine' OR p_partkey % 2 = 0), need AS (SELECT 'part-' || substr(src, 10) AS skill_id, 'part-' || substr(dst, 10) AS needs FROM ups)"


def _packages(spark, sf_dir, enabled):
    """Skills in three packages, half of them in the first."""
    _, needs = _lock(spark, sf_dir)
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat(F.lit("part-"), k.cast("string")).alias("skill_id"), F.explode(F.array(F.lit("mine"), F.lit("other"), F.lit("third"))).alias("package_id")).where((F.col("package_id") != "mine") | (k % 2 == 0))
    tier = F.when(F.col("package_id") == "mine", "community").when(F.col("package_id") == "other", "official").otherwise("local")
    return rows.select("package_id", "skill_id", tier.alias("trust_tier"), enabled(k).alias("enabled")), needs


@query(_TWO + ", up(skill_id) AS (SELECT id FROM k WHERE p_partkey IN (44, 77) UNION SELECT needs FROM need JOIN up USING (skill_id)) SELECT package_id, skill_id, skill_id IN (SELECT skill_id FROM up) AND package_id = CASE WHEN p_partkey % 2 = 0 THEN 'mine' ELSE 'other' END AS enabled FROM lock")
def reg_enable_package(spark, sf_dir):
    """Two skills of a package enabled with all they need: of the package where it has them, else of the best tier."""
    lock, needs = _packages(spark, sf_dir, lambda k: F.lit(False))
    return registry.enable(lock, needs, spark.createDataFrame([("mine", "part-44"), ("mine", "part-77")], "package_id string, skill_id string")).select("package_id", "skill_id", "enabled")


@query(_TWO + ", gone(package_id, skill_id) AS (SELECT 'mine', 'part-4' UNION SELECT l.package_id, l.skill_id FROM gone JOIN need ON needs = gone.skill_id JOIN lock l ON l.skill_id = need.skill_id AND l.enabled) SELECT lock.package_id, lock.skill_id, enabled AND gone.skill_id IS NULL AS enabled FROM lock LEFT JOIN gone USING (package_id, skill_id)")
def reg_disable_package(spark, sf_dir):
    """A skill of one package disabled, with the enabled ones of all packages that need it; a disabled link in the chain stops it."""
    lock, needs = _packages(spark, sf_dir, lambda k: k % 10 != 3)
    return registry.disable(lock, needs, spark.createDataFrame([("mine", "part-4")], "package_id string, skill_id string")).select("package_id", "skill_id", "enabled")


@query(""", p AS (SELECT 'author-' || (p_partkey % 7) || '/pack-' || p_partkey AS package_id, 'pack-' || p_partkey AS short, p_partkey FROM k),
r AS (SELECT unnest([short || '/tool', package_id || '/tool', short || '/none', 'author-1/tool']) AS ref, package_id, p_partkey FROM p)
SELECT DISTINCT ref, package_id, 4 AS level, 1::BIGINT AS n FROM r WHERE ref LIKE '%/tool' AND ref <> 'author-1/tool' AND p_partkey % 3 <> 0""")
def reg_resolve_skills(spark, sf_dir):
    """References to skills by the short or the whole name of their package; every third package lacks the skill."""
    k = F.col("p_partkey")
    short = F.concat(F.lit("pack-"), k.cast("string"))
    whole = F.concat(F.lit("author-"), (k % 7).cast("string"), F.lit("/"), short)
    packs = table(spark, sf_dir, "part").select(k, short.alias("short"), whole.alias("package_id"))
    refs = packs.select(F.explode(F.array(F.concat("short", F.lit("/tool")), F.concat("package_id", F.lit("/tool")), F.concat("short", F.lit("/none")), F.lit("author-1/tool"))).alias("ref"))
    return registry.resolve_packages(refs, packs, packs.where(k % 3 != 0).select("package_id", F.lit("tool").alias("skill_id")))


@query("SELECT s_suppkey AS package_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT -1, 'new', NULL", skills=False)
def reg_upsert(spark, sf_dir):
    """Registry entries, every second one renewed and one added."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("package_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = old.where("package_id % 2 = 0").select("package_id", F.lit("new").alias("name")).union(spark.createDataFrame([(-1, "new")], "package_id long, name string"))
    return registry.upsert(old, new)


@query("""SELECT ref, package_id, CAST(level AS INTEGER) AS level, CAST(n AS BIGINT) AS n FROM (SELECT *, min(level) OVER (PARTITION BY ref) AS best, count(*) OVER (PARTITION BY ref, level) AS n FROM (
  SELECT ref, package_id, 1 AS level FROM r JOIN p ON ref = package_id UNION ALL SELECT ref, package_id, 2 FROM r JOIN p ON ref = split_part(package_id, '/', 1)
  UNION ALL SELECT ref, package_id, 3 FROM r JOIN p ON ref = split_part(package_id, '/', 2) UNION ALL SELECT ref, package_id, 4 FROM r JOIN p ON starts_with(ref, package_id || '/')))  WHERE level = best""".replace(" r ", " (SELECT DISTINCT unnest(['nation-' || n_nationkey, n_name, 'region-' || n_regionkey || '/nation-' || n_nationkey || '/skill', 'region-' || n_regionkey]) AS ref FROM nation) r ").replace(" p ", " (SELECT 'region-' || n_regionkey || '/nation-' || n_nationkey AS package_id FROM nation) p "), skills=False)
def reg_resolve(spark, sf_dir):
    """References to packages of nations in regions."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("n"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("r"), "n_name")
    refs = nation.select(F.explode(F.array("n", "n_name", F.concat_ws("/", "r", "n", F.lit("skill")), "r")).alias("ref"))
    return registry.resolve_packages(refs, nation.select(F.concat_ws("/", "r", "n").alias("package_id")))


# --- query text -------------------------------------------------------------------------------------------


@query("SELECT s, p_name AS n, CASE WHEN p_partkey > 0 THEN 'oc:skill_' || (p_partkey // 2) END AS parent FROM k WHERE skill_type = 'executable' AND contains(p_name, 'ring') AND tier IN ('official', 'local')")
def sparql_optional_filter(spark, sf_dir):
    """Query text with a type, an OPTIONAL and filters."""
    return sparql.select(sg.old_graph(spark, sf_dir), "SELECT ?s ?n ?parent WHERE { ?s a oc:ExecutableSkill ; oc:nature ?n ; oc:trustTier ?t . OPTIONAL { ?s oc:extends ?parent } FILTER(CONTAINS(?n, \"ring\") && ?t IN (\"official\", \"local\")) }", merged=True)


@query("SELECT p_type AS c, CAST(count(*) AS BIGINT) AS n FROM k WHERE lower(p_name) LIKE '%widget%' GROUP BY p_type")
def sparql_group_count(spark, sf_dir):
    """Query text with an aggregate."""
    return sparql.select(sg.old_graph(spark, sf_dir), "SELECT ?c (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s oc:hasCategory ?c . ?s oc:resolvesIntent ?i FILTER(LCASE(?i) = \"widget\") } GROUP BY ?c", merged=True)


@query(", p(src, dst) AS (SELECT src, dst FROM ups UNION SELECT p.src, ups.dst FROM p JOIN ups ON p.dst = ups.src) SELECT dst AS a, 'part-' || substr(dst, 10) AS id FROM p WHERE src = 'oc:skill_777' ORDER BY a LIMIT 5")
def sparql_path(spark, sf_dir):
    """Query text with a path of any length, an order and a limit."""
    return sparql.select(sg.old_graph(spark, sf_dir), "SELECT ?a ?id WHERE { oc:skill_777 oc:extends+ ?a . ?a dcterms:identifier ?id } ORDER BY ?a LIMIT 5", merged=True)


@query("SELECT s, 'needs' AS role, requires AS state FROM k WHERE p_type = 'PROMO' UNION ALL SELECT s, 'gives', yields FROM k WHERE p_type = 'PROMO'")
def sparql_union(spark, sf_dir):
    """Query text with UNION and BIND."""
    return sparql.select(sg.old_graph(spark, sf_dir), "SELECT ?s ?role ?state WHERE { ?s oc:hasCategory \"PROMO\" . { ?s oc:requiresState ?state . BIND(\"needs\" AS ?role) } UNION { ?s oc:yieldsState ?state . BIND(\"gives\" AS ?role) } }", merged=True)


def _select(spark, sf_dir, text: str):
    return sparql.select(sg.old_graph(spark, sf_dir), text, merged=True)


@query(", p(o) AS (SELECT b.s FROM k a JOIN k b ON b.yields = a.requires WHERE a.s = 'oc:skill_7' UNION SELECT b.s FROM p JOIN k a ON a.s = p.o JOIN k b ON b.yields = a.requires) SELECT o FROM p")
def sparql_path_sequence(spark, sf_dir):
    """What a skill needs first, step by step: a repeated sequence with a step against the arrow."""
    return _select(spark, sf_dir, "SELECT ?o WHERE { oc:skill_7 (oc:requiresState/^oc:yieldsState)+ ?o }")


@query(", e AS (FROM ups UNION FROM deps), p(s) AS (SELECT 'oc:skill_3' UNION SELECT src FROM p JOIN e ON dst = p.s) SELECT p.s, id FROM p JOIN k ON k.s = p.s")
def sparql_path_alternative(spark, sf_dir):
    """What leads to a skill by either of two predicates, searched from its end."""
    return _select(spark, sf_dir, "SELECT ?s ?id WHERE { ?s (oc:extends|oc:dependsOnSkill)* oc:skill_3 . ?s dcterms:identifier ?id }")


@query("""SELECT o, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_type AS o FROM k WHERE s = 'oc:skill_10' UNION ALL SELECT p_name FROM k WHERE s = 'oc:skill_10' UNION ALL SELECT dst FROM deps WHERE src = 'oc:skill_10'
UNION ALL SELECT dst FROM ups WHERE src = 'oc:skill_10' UNION ALL SELECT requires FROM k WHERE s = 'oc:skill_10' UNION ALL SELECT yields FROM k WHERE s = 'oc:skill_10' UNION ALL SELECT requirement FROM k WHERE s = 'oc:skill_10'
UNION ALL SELECT intent FROM intents WHERE s = 'oc:skill_10' UNION ALL SELECT p_brand FROM k WHERE s = 'oc:skill_10' UNION ALL SELECT src FROM deps WHERE dst = 'oc:skill_10') GROUP BY o""")
def sparql_path_negated(spark, sf_dir):
    """All that a skill says but three predicates, and what says anything of it but one."""
    return _select(spark, sf_dir, "SELECT ?o (COUNT(*) AS ?n) WHERE { oc:skill_10 !(rdf:type|dcterms:identifier|oc:trustTier|^oc:extends) ?o } GROUP BY ?o")


@query("SELECT s, s AS o FROM k WHERE p_type = 'PROMO' UNION SELECT s, dst FROM k JOIN ups ON src = s WHERE p_type = 'PROMO'")
def sparql_path_optional(spark, sf_dir):
    """Skills of a category, and what they extend: one step or none."""
    return _select(spark, sf_dir, "SELECT ?s ?o WHERE { ?s oc:hasCategory \"PROMO\" . ?s oc:extends? ?o }")


@query("SELECT s, id AS i FROM k WHERE s NOT IN (SELECT src FROM deps JOIN k ON k.s = dst WHERE tier = 'official') AND NOT (p_size % 2 = 0 AND p_type = 'PROMO')")
def sparql_not_exists(spark, sf_dir):
    """Skills that depend on none of a tier, less some of a category."""
    return _select(spark, sf_dir, "SELECT ?s ?i WHERE { ?s dcterms:identifier ?i FILTER NOT EXISTS { ?s oc:dependsOnSkill ?d . ?d oc:trustTier ?t FILTER(?t = \"official\") } MINUS { ?s a oc:ExecutableSkill ; oc:hasCategory \"PROMO\" } MINUS { ?x oc:hasAlias ?y } }")


@query("SELECT DISTINCT a.s, a.p_type AS c FROM k a JOIN deps ON src = a.s JOIN k b ON b.s = dst AND b.p_type = a.p_type WHERE a.tier = 'local'")
def sparql_exists(spark, sf_dir):
    """Skills that depend on one of their own category: the filter within sees the variable without."""
    return _select(spark, sf_dir, "SELECT DISTINCT ?s ?c WHERE { ?s oc:hasCategory ?c ; oc:trustTier \"local\" FILTER(EXISTS { ?s oc:dependsOnSkill ?d . ?d oc:hasCategory ?e FILTER(?e = ?c) } && STRLEN(?c) > 0) }")


@query(", v(tier, p_type) AS (VALUES ('official', 'PROMO'), ('local', 'ECONOMY'), ('verified', NULL)) SELECT s, k.tier AS t, k.p_type AS c FROM k JOIN v ON k.tier = v.tier AND (v.p_type IS NULL OR k.p_type = v.p_type)")
def sparql_values(spark, sf_dir):
    """Skills by pairs of a tier and a category, one of them any."""
    return _select(spark, sf_dir, "SELECT ?s ?t ?c WHERE { ?s oc:trustTier ?t ; oc:hasCategory ?c VALUES (?t ?c) { (\"official\" \"PROMO\") (\"local\" \"ECONOMY\") (\"verified\" UNDEF) } }")


@query("SELECT requires AS state, CAST(count(*) AS BIGINT) AS n, count(DISTINCT p_type) / count(*) AS share FROM k GROUP BY requires HAVING count(*) > 4 AND count(DISTINCT p_type) * 2 > 4")
def sparql_having(spark, sf_dir):
    """States that more than four skills of more than two categories require, and how many categories a skill."""
    return _select(spark, sf_dir, "SELECT ?state (COUNT(?s) AS ?n) (COUNT(DISTINCT ?c) / COUNT(?s) AS ?share) WHERE { ?s oc:requiresState ?state ; oc:hasCategory ?c } GROUP BY ?state HAVING (COUNT(?s) > 4 && COUNT(DISTINCT ?c) * 2 > 4)")


@query(", m AS (SELECT requires AS state, count(*) AS n FROM k GROUP BY requires ORDER BY n DESC, state LIMIT 10) SELECT s, state, CAST(n AS BIGINT) AS n FROM m JOIN k ON yields = state")
def sparql_subselect(spark, sf_dir):
    """Who yields the ten states that most skills require."""
    return _select(spark, sf_dir, "SELECT ?s ?state ?n WHERE { { SELECT ?state (COUNT(*) AS ?n) WHERE { ?x oc:requiresState ?state } GROUP BY ?state ORDER BY DESC(?n) ?state LIMIT 10 } ?s oc:yieldsState ?state }")


@query("SELECT id AS i, (length(p_name) + length(p_type)) / 2 - 1 AS x FROM k WHERE length(p_name) * 2 - 3 > length(p_type) + 12")
def sparql_arithmetic(spark, sf_dir):
    """Sums and products of lengths, in a column and in a condition."""
    return _select(spark, sf_dir, "SELECT ?i ((STRLEN(?n) + STRLEN(?c)) / 2 -1 AS ?x) WHERE { ?s dcterms:identifier ?i ; oc:nature ?n ; oc:hasCategory ?c FILTER(STRLEN(?n) * 2 - 3 > STRLEN(?c) + 12) }")
