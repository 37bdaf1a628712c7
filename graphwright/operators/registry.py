"""The algebra of package registries: references, closures, precedence, and merging documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.operators.catalog import TIERS
from graphwright.operators.closure import reached
from graphwright.operators.triples import facts, of_class
from graphwright.sources.scratch import stored


def tier_rank(tier: Column) -> Column:
    """Place of a trust tier in the order of preference; 5 for one that isn't known."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), tier)
    return F.when(place > 0, place).otherwise(5)


def resolve_packages(references: DataFrame, packages: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """(ref, package_id, level, n) for each reference: 1 a package's id, 2 an author's packages (no slash), 3 the end of an id, any number of its
    segments, 4 a skill in a package. n counts the packages on the best level; more than 1 on level 3 is ambiguous.

    A skill's package comes first in the reference, by its id or by an end that only it has; the shortest such beginning counts. With `skills` (package_id, skill_id) a package must
    have the skill that the rest names, else the reference has no row.
    """
    ids = packages.select("package_id").distinct()
    segments = F.split("package_id", "/")
    ends = F.when(F.size(segments) > 1, F.transform(F.sequence(F.lit(2), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"))).otherwise(F.array().cast("array<string>"))
    keys = ids.select("package_id", F.explode(F.concat(F.array(
        F.struct(F.lit(1).alias("level"), F.col("package_id").alias("key")),
        F.struct(F.lit(2).alias("level"), F.when(F.contains("package_id", F.lit("/")), F.substring_index("package_id", "/", 1)).alias("key")),
    ), F.transform(ends, lambda e: F.struct(F.lit(3).alias("level"), e.alias("key"))))).alias("k")).select("package_id", "k.*").where("key is not null")
    wanted = references.select("ref").distinct()
    parts = F.split("ref", "/")
    begins = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(parts, 1, i), "/").alias("key"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("skill_id"))))
    prefixes = wanted.select("ref", F.inline(begins))
    # a package by its id, else by an end that no other has
    named = keys.where("level in (1, 3)").groupBy("key").agg(F.min(F.when(F.col("level") == 1, F.col("package_id"))).alias("whole"), F.min("package_id").alias("package_id"), F.count("*").alias("n"))
    named = named.where("whole is not null or n = 1").select("key", F.coalesce("whole", "package_id").alias("package_id"))
    of_skills = prefixes.join(named, "key").groupBy("ref").agg(F.min(F.struct("at", "package_id", "skill_id")).alias("b")).select("ref", "b.package_id", "b.skill_id")
    if skills is not None:
        of_skills = of_skills.join(skills.select("package_id", "skill_id"), ["package_id", "skill_id"], "left_semi")
    found = wanted.join(keys, F.col("ref") == F.col("key")).select("ref", "package_id", "level")
    found = found.union(of_skills.select("ref", "package_id", F.lit(4).alias("level")))
    best = Window.partitionBy("ref")
    return found.withColumn("best", F.min("level").over(best)).where("level = best").withColumn("n", F.count("*").over(best)).drop("best")


# The relations that closures of a registry follow.
FOLLOWED = ("oc:extends", "oc:dependsOnSkill", "oc:dependsOn")


def skill_relations(t: DataFrame) -> DataFrame:
    """(skill_id, needs): what each skill extends or depends on, by any of three predicates, each once; the dependencies of `enable` and `disable`.

    A target without an identifier counts by its node's name, if that is a skill's, with hyphens for underscores; other terms and texts count nowhere, nor do skills without an identifier.
    """
    ids = facts(t, "dcterms:identifier", "node", "id").groupBy("node").agg(F.min("id").alias("id"))
    own = of_class(t, "oc:Skill").join(ids.withColumnRenamed("node", "s"), "s").select("s", F.col("id").alias("skill_id"))
    links = t.where(F.col("p").isin(*FOLLOWED)).select("s", F.col("o").alias("node"), "o_kind").distinct().join(own, "s")
    named = F.when((F.col("o_kind") == "iri") & F.contains("node", F.lit("skill_")) & F.col("node").rlike("(^oc:|#)skill_"), F.translate(F.regexp_extract("node", "(?:^oc:|#)skill_(.*)$", 1), "_", "-"))
    return links.join(ids, "node", "left").select("skill_id", F.coalesce("id", named).alias("needs")).where("needs is not null").distinct()


def _with_packages(rows: DataFrame) -> DataFrame:
    """A null package where rows tell none."""
    return rows if "package_id" in rows.columns else rows.withColumn("package_id", F.lit(None).cast("string"))


def enable(lock: DataFrame, dependencies: DataFrame, wanted: DataFrame) -> DataFrame:
    """`lock` (package_id, skill_id, trust_tier, enabled) with the wanted skills (skill_id, package_id), and all they need, enabled.

    A package asked for is the first choice at each step of what its skills need; else, or without one, that of the best tier, then the first id. A null skill asks for all of the package. dependencies: (skill_id, needs), and package_id where
    what a skill needs differs by package.
    """
    held = lock.select("package_id", "skill_id", "trust_tier").dropDuplicates(["package_id", "skill_id"])
    best = held.groupBy("skill_id").agg(F.min(F.struct(tier_rank(F.col("trust_tier")), "package_id"))["package_id"].alias("other"))
    needs = _with_packages(dependencies).where("needs is not null").select(F.col("package_id").alias("of"), "skill_id", "needs").distinct()
    asked = _with_packages(wanted).select(F.col("package_id").alias("first"), "skill_id")
    every = asked.where("skill_id is null and first is not null").select("first").join(held.select(F.col("package_id").alias("first"), "skill_id"), "first")
    front = stored(asked.where("skill_id is not null").union(every.select("first", "skill_id")).distinct())
    own = held.select(F.col("package_id").alias("first"), "skill_id", F.col("package_id").alias("mine"))
    known = found = None
    while True:
        # which package each is taken from
        taken = stored(front.join(own, ["first", "skill_id"], "left").join(best, "skill_id").select("first", "skill_id", F.coalesce("mine", "other").alias("package_id")))
        found, known = taken if found is None else found.union(taken), front if known is None else known.union(front)
        onward = taken.join(needs, "skill_id").where(F.col("of").isNull() | (F.col("of") == F.col("package_id"))).select("first", F.col("needs").alias("skill_id")).distinct()
        same = F.col("n.skill_id").eqNullSafe(F.col("k.skill_id")) & F.col("n.first").eqNullSafe(F.col("k.first"))
        front = stored(onward.alias("n").join(known.alias("k"), same, "left_anti"))
        if front.isEmpty():
            break
    chosen = found.select("package_id", "skill_id").distinct().withColumn("now", F.lit(True))
    return lock.join(chosen, ["package_id", "skill_id"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)) | F.coalesce("now", F.lit(False))).select(lock.columns)


def disable(lock: DataFrame, dependencies: DataFrame, unwanted: DataFrame) -> DataFrame:
    """`lock` with the unwanted skills (skill_id, package_id), and all enabled ones that need them, disabled. Without a package a skill goes from all; a null skill stands for all of a package.

    Those that need a skill are found by its id, in whatever package they are, but only through skills that are enabled.
    """
    needs = _with_packages(dependencies).where("needs is not null").select(F.col("package_id").alias("of"), "skill_id", "needs").distinct()
    held = lock.select("package_id", "skill_id", F.coalesce("enabled", F.lit(False)).alias("on")).distinct()
    asked = _with_packages(unwanted).select(F.col("package_id").alias("p"), F.col("skill_id").alias("s"))
    first = held.join(asked, (F.col("p").isNull() | (F.col("p") == F.col("package_id"))) & (F.col("s") == F.col("skill_id")), "left_semi")
    first = first.union(held.join(asked.where("s is null and p is not null"), F.col("p") == F.col("package_id"), "left_semi"))
    front = known = stored(first.select("package_id", "skill_id").distinct())
    users = stored(held.where("on").join(needs, "skill_id").where(F.col("of").isNull() | (F.col("of") == F.col("package_id"))).select("package_id", "skill_id", "needs").distinct())
    while True:
        new = users.join(front.select(F.col("skill_id").alias("needs")), "needs", "left_semi").select("package_id", "skill_id").distinct()
        front = stored(new.join(known, ["package_id", "skill_id"], "left_anti"))
        if front.isEmpty():
            break
        known = known.union(front)
    gone = known.withColumn("gone", F.lit(True))
    return lock.join(gone, ["package_id", "skill_id"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)) & F.col("gone").isNull()).select(lock.columns)


def enabled_paths(lock: DataFrame) -> DataFrame:
    """Module paths of enabled skills, sorted."""
    return lock.where("enabled").select("module_path").distinct().orderBy("module_path")


def upsert(old: DataFrame, new: DataFrame, key: str = "package_id") -> DataFrame:
    """Rows by key: a new row's values win, what it lacks stays, and old rows without a new one stay."""
    a, b = (df.select(F.col(key), *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key]) for side, df in (("old", old), ("new", new)))
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    value = lambda c: F.coalesce(*[F.col(f"{side}_{c}") for side, df in (("new", new), ("old", old)) if c in df.columns]).alias(c)
    return a.join(b, key, "full").select(*[F.col(key) if c == key else value(c) for c in names])


def sync_local(lock: DataFrame, found: DataFrame) -> DataFrame:
    """The skills found (skill_id, module_path): those of a known path keep `enabled` and aliases, new ones are enabled."""
    known = lock.select("module_path", "enabled", "aliases")
    return found.join(known, "module_path", "left").withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def first_source(entries: DataFrame) -> DataFrame:
    """One entry (package_id, source_order, trust_tier, source_tier) for each package: its first source's; the source's tier if it has none."""
    order = Window.partitionBy("package_id").orderBy("source_order")
    return entries.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n").withColumn("trust_tier", F.coalesce("trust_tier", "source_tier"))


def replace_source(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Sources with those of the same name replaced."""
    return sources.join(new.select("name"), "name", "left_anti").unionByName(new)


def merge_intents(files: DataFrame) -> DataFrame:
    """(intent, embedding, skills) from (file_ord, intent, embedding, skills): skills are united and sorted, the first file's embedding stays."""
    return files.where("intent is not null").groupBy("intent").agg(F.min_by("embedding", "file_ord").alias("embedding"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("skills")))).alias("skills"))


def package_manifest(lock: DataFrame) -> DataFrame:
    """(package_id, json): skills and modules of each package, sorted and distinct."""
    grouped = lock.groupBy("package_id").agg(F.array_sort(F.collect_set(F.struct("skill_id", "module_path", "enabled"))).alias("skills"), F.array_sort(F.collect_set("module_path")).alias("modules"))
    return grouped.select("package_id", F.to_json(F.struct("package_id", "modules", "skills")).alias("json"))


def text_search(skills: DataFrame, query: str) -> DataFrame:
    """Skills with a text in any of their id, qualified id, aliases, intents and description, in any case."""
    fields = [F.array_join(c, " ") if kind.startswith("array") else F.col(c) for c, kind in skills.dtypes if c in ("id", "qualified_id", "aliases", "intents", "description")]
    return skills.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.lower())))


def sibling_dependencies(skills: DataFrame) -> DataFrame:
    """(package_id, skill_id, siblings, standalone) of skills (package_id, skill_id, needs array): what each needs of its own package, in its order, and whether that is nothing."""
    wanted = skills.select("package_id", "skill_id", F.posexplode("needs").alias("n", "need"))
    known = skills.select("package_id", F.col("skill_id").alias("need")).distinct()
    found = wanted.join(known, ["package_id", "need"], "left_semi").groupBy("package_id", "skill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "need"))), lambda x: x["need"]).alias("siblings"))
    rows = skills.select("package_id", "skill_id").join(found, ["package_id", "skill_id"], "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>")))
    return rows.withColumn("standalone", F.size("siblings") == 0)


def install_closure(skills: DataFrame, package_id: str, skill_id: str) -> DataFrame:
    """(skill_id): a skill of a package and all that it needs of that package, directly or not."""
    own = skills.where(F.col("package_id") == package_id)
    ids = own.select(F.col("skill_id").alias("need"))
    edges = own.select("skill_id", F.explode("needs").alias("need")).join(ids, "need", "left_semi")
    return reached(edges, own.where(F.col("skill_id") == skill_id).select("skill_id"), "skill_id", "need").withColumnRenamed("node", "skill_id")


def install(lock: DataFrame, manifests: DataFrame, package_id: str, skill_id: str | None = None) -> DataFrame:
    """`lock` (package_id, skill_id, module_path, trust_tier, enabled) after a package, or one skill of it, is installed.

    manifests: (package_id, skill_id, path, trust_tier, source_tier, source_order), skills of packages by source; the first source that has the package counts, and its tier where the
    package has none. Rows of the package are replaced by the manifest's; a skill that was enabled stays so. With a skill, only that is added, enabled, and others of the
    package keep their rows. A name that isn't there is an error (LookupError).
    """
    rows = manifests.where(F.col("package_id") == package_id)
    first = rows.agg(F.min("source_order").alias("source_order"))
    rows = rows.join(first, "source_order", "left_semi")
    if skill_id is not None:
        rows = rows.where(F.col("skill_id") == skill_id)
    if rows.isEmpty():
        raise LookupError(f"not found: {package_id}" + (f"/{skill_id}" if skill_id else ""))
    was = lock.select("package_id", "skill_id", F.col("enabled").alias("was"))
    new = rows.join(was, ["package_id", "skill_id"], "left").select("package_id", "skill_id", F.concat_ws("/", F.lit("author"), "package_id", "path").alias("module_path"), F.coalesce("trust_tier", "source_tier").alias("trust_tier"), F.coalesce(F.lit(True) if skill_id is not None else F.col("was"), F.lit(False)).alias("enabled"))
    gone = lock.where(F.col("package_id") == package_id) if skill_id is None else lock.where((F.col("package_id") == package_id) & (F.col("skill_id") == skill_id))
    return lock.join(gone.select("package_id", "skill_id"), ["package_id", "skill_id"], "left_anti").select(new.columns).union(new)


def modules_of(modules: DataFrame, skill_path: str) -> DataFrame:
    """Module paths (module) of one skill: those below the folder of its own, which is among them."""
    folder = skill_path.rsplit("/", 1)[0] + "/" if "/" in skill_path else ""
    return modules.where(F.startswith("module", F.lit(folder)) | (F.col("module") == skill_path))
