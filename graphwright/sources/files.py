"""Folders of documents, registry documents and embeddings, and what is written back."""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions.terms import BASE

# Folders that a scan leaves out, beside hidden ones.
IGNORED = ("__pycache__", "node_modules", "venv", "dist", "build", "target")
# Types of files, and the endings that have them.
TYPES = {
    "text/plain": ("txt", "ini", "cfg", "env"), "text/markdown": ("md",), "text/html": ("html",), "text/css": ("css",), "text/csv": ("csv",),
    "text/x-python": ("py",), "text/x-shellscript": ("sh",), "text/javascript": ("js",), "text/typescript": ("ts",),
    "application/json": ("json",), "application/x-yaml": ("yaml", "yml"), "application/toml": ("toml",), "application/xml": ("xml",), "application/pdf": ("pdf",),
    **{f"application/vnd.openxmlformats-officedocument.{kind}": (ending,) for kind, ending in (("wordprocessingml.document", "docx"), ("spreadsheetml.sheet", "xlsx"), ("presentationml.presentation", "pptx"))},
    "image/png": ("png",), "image/jpeg": ("jpg", "jpeg"), "image/gif": ("gif",), "image/svg+xml": ("svg",), "image/x-icon": ("ico",),
}
MIME = {ending: kind for kind, endings in TYPES.items() for ending in endings}
INTENTS = "model string, dimension int, intents array<struct<intent:string, embedding:array<float>, skills:array<string>>>"
LOCK = "packages map<string, struct<package_id:string, version:string, trust_tier:string, source:string, skills:array<struct<skill_id:string, module_path:string, enabled:boolean, aliases:array<string>>>>>"


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, size, sha256, mime, rule) of each file below a root, those with a backslash in their path, and ignored and hidden ones left out. Rule A: a SKILL.md; B: other
    Markdown outside reference/; C: assets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.col("path"), "^(file:)?/*" + root.strip("/") + "/", "")
    rows = files.select("path", relative.alias("relative"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    parts = F.split("relative", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = rows.where(~F.exists(parts, lambda p: F.startswith(p, F.lit("."))) & ~F.exists(folders, lambda p: p.isin(*IGNORED)) & ~F.contains("relative", F.lit("\\")))
    mime = mime_type(F.col("relative"))
    return rows.withColumn("mime", mime).withColumn("rule", rule(F.col("relative"))).orderBy("relative")


def mime_type(path: Column) -> Column:
    """The type of a file by its ending, in any case of letters."""
    name = F.substring_index(path, "/", -1)
    ending = F.when(F.contains(F.substring(name, 2, 1_000_000), F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])[ending], F.lit("application/octet-stream"))


def rule(path: Column) -> Column:
    """A, B or C; see `directory`."""
    name = F.substring_index(path, "/", -1)
    return F.when(name == "SKILL.md", "A").when(F.endswith(name, F.lit(".md")) & ~path.rlike("(^|/)reference/"), "B").otherwise("C")


def skill_folders(files: DataFrame) -> DataFrame:
    """First-level folders with a SKILL.md at any depth, sorted."""
    return files.where("rule = 'A'").select(F.substring_index("relative", "/", 1).alias("folder")).distinct().orderBy("folder")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of some paths, in any file system that Spark knows, that exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, path in at if path.getFileSystem(conf).exists(path)]


def intents(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_ord, intent, embedding, skills) of intents documents, each a path or, for a folder, every intents.json below it but for those in system/ and embeddings/.

    Embeddings have unit length. The first document with a dimension sets it; vectors of another are left out. Documents are numbered in order of their paths.
    """
    from graphwright.operators.search import normalise

    found: list[str] = []
    for path in paths:
        if path.endswith(".json"):
            found.append(path)
        else:
            below = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "intents.json").load(path).select("path")
            found += [r.path for r in below.where(~F.col("path").rlike("/(system|embeddings)/")).orderBy("path").collect()]
    rows = spark.read.schema(INTENTS).option("multiLine", True).json(list(dict.fromkeys(found))).select(F.input_file_name().alias("path"), "dimension", "intents")
    heads = sorted((r.path, r.dimension) for r in rows.select("path", "dimension").distinct().collect())
    numbers = F.broadcast(spark.createDataFrame([(p, i) for i, (p, _) in enumerate(heads, 1)], "path string, file_ord int"))
    dimension = next((d for _, d in heads if d is not None), None)
    flat = rows.join(numbers, "path").select("file_ord", F.explode("intents").alias("i")).select("file_ord", "i.*")
    return flat.where(F.size("embedding") == F.lit(dimension)).withColumn("embedding", normalise(F.col("embedding")))


def lock(spark: SparkSession, path: str) -> DataFrame:
    """Installed skills of a lock document, a row each."""
    packages = spark.read.schema(LOCK).option("multiLine", True).json(path).select(F.explode("packages").alias("key", "package"))
    return packages.select(F.coalesce("package.package_id", "key").alias("package_id"), "package.version", "package.trust_tier", "package.source", F.explode("package.skills").alias("s")).select("package_id", "version", "trust_tier", "source", "s.*")


def newest(snapshots: DataFrame, keep: int = 10, time: str = "ts") -> DataFrame:
    """The snapshots to keep, the newest first."""
    return snapshots.orderBy(F.desc(time)).limit(keep)


def base_snapshot(snapshots: DataFrame, time: str = "ts") -> DataFrame:
    """The one to compare with: the second newest, or the only one."""
    best = snapshots.orderBy(F.desc(time)).limit(2)
    return best.orderBy(time).limit(1)


def script_paths(text: Column, old: str, new: str) -> Column:
    """Script paths of a compiled text moved from one folder to another."""
    return F.regexp_replace(text, "(?<=[\"'\\s])" + old.rstrip("/") + "/", new.rstrip("/") + "/")


def write_intents(rows: DataFrame, path: str, model: str, dimension: int) -> None:
    """Intents as JSON lines of one document each, (intent, embedding, skills), in order of intents."""
    rows.select(F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "intent", "embedding", "skills").repartitionByRange("intent").sortWithinPartitions("intent").write.json(path)


def root_folder(given: str | None = None, environment: dict[str, str] | None = None, start: str = ".", home: str | None = None, variables: tuple[str, ...] = ("GRAPHWRIGHT_ROOT", "GRAPHWRIGHT_HOME"), name: str = "ontologies") -> str | None:
    """The folder of compiled graphs on the driver: the one given; else one that a variable names; else a folder `name` here or above, or in the home folder, with a
    Turtle file within three levels; None if there is none."""
    environment = dict(os.environ) if environment is None else environment
    if given:
        return given
    for variable in variables:
        if environment.get(variable):
            return environment[variable]
    here = Path(start).resolve()
    for place in [*(p / name for p in (here, *here.parents)), Path(home or Path.home()) / name]:
        if any(next(place.glob("/".join(["*"] * k + ["*.ttl"])), None) for k in range(3)):
            return str(place)
    return None


def save_atomic(text: str, path: str, backups: str | None = None, keep: int = 5, now: datetime | None = None) -> None:
    """Write a text on the driver: the file that stands there is copied to backups/skills_<time>.ttl, the new one written beside it and renamed, and all but the newest `keep` copies go."""
    at = Path(path)
    folder = Path(backups) if backups else at.parent / "backups"
    folder.mkdir(parents=True, exist_ok=True)
    if at.exists():
        shutil.copy2(at, folder / f"skills_{(now or datetime.now()):%Y%m%d_%H%M%S}.ttl")
    written = at.with_suffix(".ttl.tmp")
    written.write_text(text, encoding="utf-8")
    os.replace(written, at)
    for old in sorted(folder.glob("skills_*.ttl"))[:-keep]:
        old.unlink()


def index_manifest(modules: DataFrame, core: str | None = None, base: str = BASE, created: str | None = None) -> str:
    """Turtle text that imports modules (path): the core first, if given, then each by its file address, sorted. The list is as long as there are modules."""
    links = [f"<{core}>"] if core else []
    links += [f"<file://{r.path}>" for r in modules.select("path").distinct().orderBy("path").toLocalIterator()]
    lines = ["@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix dcterms: <http://purl.org/dc/terms/> .", "", f"<{base.rstrip('#')}> a owl:Ontology"]
    lines += [f'  dcterms:created "{created}"'] * bool(created) + [f"  owl:imports {link}" for link in links]
    return "\n".join(lines[:3] + [" ;\n".join(lines[3:]) + " ."]) + "\n"


def write_report(rows: DataFrame, path: str) -> None:
    """A table as JSON, one document a row, where all executors can write."""
    rows.write.mode("overwrite").json(path)


def compile_errors(results: DataFrame) -> DataFrame:
    """(id, kind, message, ts) of results (id, kind, message, ts) that failed: the side output of a run, to be appended to a log."""
    return results.where("message is not null").select("id", F.coalesce("kind", F.lit("error")).alias("kind"), "message", "ts")


def append_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("append").json(path)


def schema_resource(most: int = 4096) -> str:
    """The vocabulary in brief, as JSON of at most `most` bytes: classes with what they fall under, and predicates."""
    from graphwright.operators import catalog, reason

    text = json.dumps({"prefix": "oc", "base": BASE, "skills": ["Skill", "ExecutableSkill", "DeclarativeSkill"], "knowledge": catalog.DIMENSIONS, "operational": catalog.OPERATIONAL, "inverse": reason.INVERSES, "transitive": reason.TRANSITIVE, "symmetric": reason.SYMMETRIC}, separators=(",", ":"))
    if len(text.encode()) > most:
        raise ValueError(f"the schema takes over {most} bytes")
    return text


def benchmark_tasks(tasks: DataFrame, allow: list[str] | None = None, skip: list[str] | None = None, compiled: DataFrame | None = None, seed: int | None = None, skip_first: int = 0, most: int | None = None) -> DataFrame:
    """Tasks (task_id, skills array) to run: allowed, not skipped, with skills, all of them compiled (skill_id) if that is asked for; in order of ids, or of
    their hashes with a seed, then from `skip_first` on and `most` of them."""
    rows = tasks.where(F.size("skills") > 0)
    rows = rows.where(F.col("task_id").isin(allow)) if allow else rows
    rows = rows.where(~F.col("task_id").isin(skip)) if skip else rows
    if compiled is not None:
        missing = rows.select("task_id", F.explode("skills").alias("skill_id")).join(compiled, "skill_id", "left_anti").select("task_id")
        rows = rows.join(missing, "task_id", "left_anti")
    rows = rows.orderBy(*([F.xxhash64("task_id", F.lit(seed))] if seed is not None else []), "task_id").offset(skip_first)
    return rows.limit(most) if most is not None else rows


def flat_toml(text: str) -> dict[str, dict[str, object]]:
    """Sections of a flat TOML text: strings, numbers, booleans and lists of them; what stands before the first section is under an empty name."""
    def value(raw: str) -> object:
        raw = raw.strip()
        if raw.startswith("[") and raw.endswith("]"):
            return [value(x) for x in raw[1:-1].split(",") if x.strip()]
        if raw[:1] in "\"'" and raw[-1:] == raw[:1] and len(raw) > 1:
            return raw[1:-1]
        if raw in ("true", "false"):
            return raw == "true"
        for number in (int, float):
            try:
                return number(raw)
            except ValueError:
                continue
        return raw

    out: dict[str, dict[str, object]] = {"": {}}
    now = ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            now = line.strip("[]").strip()
            out.setdefault(now, {})
        elif "=" in line and not line.startswith("#"):
            key, raw = line.split("=", 1)
            out[now][key.strip()] = value(raw)
    return out if out[""] else {k: v for k, v in out.items() if k}
