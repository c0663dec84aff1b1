"""Project scans: manifests and file lists become concepts and links.

Files are read as rows; each manifest is parsed by one Python function inside an Arrow map (manifests are small and
few, TOML has no parser in the JVM).
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod")
MAX_DEPS = 15
# File names of entry points, configurations and scripts.
ENTRYPOINTS = ("main.rs", "lib.rs", "main.py", "__main__.py", "app.py", "index.ts", "index.js", "main.ts", "main.go", "server.ts", "server.js")
CONFIGS = (
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".gitlab-ci.yml", ".travis.yml", "Jenkinsfile", ".eslintrc.json", ".prettierrc", "tsconfig.json",
    "rustfmt.toml", "clippy.toml", "ruff.toml", ".pre-commit-config.yaml",
)
SCRIPTS = r"(?:^|/)(?:Makefile|justfile|Taskfile\.yml)$|(?:^|/)scripts/[^/]+\.(?:sh|py|ts|js)$"


def parse_manifest(name: str, text: str) -> dict:
    """name, version, description, deps [(name, version)], members [patterns]; empty for a manifest that can't be read."""
    out = {"name": None, "version": None, "description": None, "deps": [], "members": []}
    version = lambda v: v if isinstance(v, str) else str(v.get("version", "*")) if isinstance(v, dict) else "*"
    try:
        if name == "package.json":
            d = json.loads(text)
            spaces = d.get("workspaces") or []
            deps = {**(d.get("devDependencies") or {}), **(d.get("dependencies") or {})}
            out |= {k: d.get(k) for k in ("name", "version", "description")}
            out |= {"deps": [(k, deps[k]) for k in [*(d.get("dependencies") or {}), *(d.get("devDependencies") or {})]], "members": spaces.get("packages", []) if isinstance(spaces, dict) else spaces}
        elif name == "go.mod":
            out["name"] = next(iter(re.findall(r"^module\s+(\S+)", text, re.M)), None)
            block = "\n".join(re.findall(r"require\s*\((.*?)\)", text, re.S))
            out["deps"] = [(p.rpartition("/")[2], v) for p, v in re.findall(r"^\s*([^\s/]\S*)\s+(v\S+)", block, re.M)]
        else:
            d = tomllib.loads(text)
            if name == "Cargo.toml":
                own, space = d.get("package", {}), d.get("workspace", {})
                deps = space.get("dependencies") or d.get("dependencies") or {}
                out |= {k: own.get(k) if isinstance(own.get(k), str) else None for k in ("name", "version", "description")}
                out |= {"deps": [(k, version(v)) for k, v in deps.items()], "members": space.get("members", [])}
            else:
                own = d.get("project") or d.get("tool", {}).get("poetry") or {}
                listed = own.get("dependencies") or []
                out |= {k: own.get(k) for k in ("name", "version", "description")}
                if isinstance(listed, dict):
                    out["deps"] = [(k, version(v)) for k, v in listed.items() if k.lower() != "python"]
                else:
                    out["deps"] = [(m[1], m[2].strip() or "*") for m in (re.match(r"\s*([A-Za-z0-9._-]+)(.*)", x) for x in listed) if m]
    except (ValueError, tomllib.TOMLDecodeError, AttributeError):
        pass
    return out


ENTRY = "kind string, name string, detail string, parent string, rank int"


def scan(files: DataFrame, project: str) -> DataFrame:
    """rows (path, content) relative to the project's root -> (kind, name, detail, parent): identity, dependency, module,
    entrypoint, config, script. Of several root manifests the first in MANIFESTS that has any counts."""
    manifest = F.regexp_extract("path", r"([^/]+)$", 1)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                m = parse_manifest(name, text or "")
                rank = MANIFESTS.index(name)
                label = " ".join(x for x in (m["name"], m["version"]) if x)
                rows.append(("identity" if not folder else "member", m["name"] or folder, "; ".join(x for x in (label, m["description"]) if x), folder, rank))
                if not folder:
                    rows += [("dependency", k, str(v), "", rank) for k, v in m["deps"][:MAX_DEPS]]
                    rows += [("pattern", p, "", "", rank) for p in m["members"]]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "name", "detail", "parent", "rank"), r, strict=True)) for r in rows], schema=pa.schema([("kind", pa.string()), ("name", pa.string()), ("detail", pa.string()), ("parent", pa.string()), ("rank", pa.int32())]))

    parsed = files.filter(manifest.isin(*MANIFESTS)).select("path", "content").mapInArrow(parse, ENTRY)
    first = parsed.filter("kind in ('identity', 'dependency', 'pattern')").groupBy("kind").agg(F.min("rank").alias("rank"))
    chosen = parsed.join(F.broadcast(first), ["kind", "rank"])  # three rows
    identity = chosen.filter("kind = 'identity'").select("kind", F.coalesce(F.nullif("name", F.lit("")), F.lit(project)).alias("name"), "detail", F.lit(None).cast("string").alias("parent"))
    deps = chosen.filter("kind = 'dependency'").select("kind", "name", "detail", F.lit(project).alias("parent"))
    patterns = chosen.filter("kind = 'pattern'").select(F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("name", r"/\*+$", "/[^/]+"), r"\.", r"\\."), F.lit("$")).alias("rx"))
    members = parsed.filter("kind = 'member'").join(patterns, F.expr("parent rlike rx"), "left_semi").select(F.lit("module").alias("kind"), F.col("parent").alias("name"), "detail", F.lit(project).alias("parent"))
    src = files.select(F.regexp_extract("path", r"^src/([^/]+)/", 1).alias("name")).filter("name != ''").distinct().select(F.lit("module").alias("kind"), "name", F.lit("source folder").alias("detail"), F.lit(project).alias("parent"))
    src = src.join(members.select(F.lit(1).alias("_m")).limit(1), F.lit(True), "left_anti")  # only without workspace members
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    at = F.when(F.regexp_replace(folder, r"/?src$", "") == "", project).otherwise(F.regexp_replace(folder, r"/?src$", ""))
    entry = files.filter(base.isin(*ENTRYPOINTS)).select(F.lit("entrypoint").alias("kind"), F.col("path").alias("name"), F.lit("").alias("detail"), at.alias("parent"))
    config = files.filter(base.isin(*CONFIGS) | F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$")).select(F.lit("config").alias("kind"), F.col("path").alias("name"), F.lit("").alias("detail"), F.lit(project).alias("parent"))
    script = files.filter(F.col("path").rlike(SCRIPTS)).select(F.lit("script").alias("kind"), F.col("path").alias("name"), F.lit("").alias("detail"), F.lit(project).alias("parent"))
    out = identity
    for part in (deps, members, src, entry, config, script):
        out = out.unionByName(part)
    return out


RELATION = {"dependency": "depends_on", "module": "part_of", "entrypoint": "part_of", "config": "part_of", "script": "part_of"}


def graph_of(entries: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, links) of a scan: entry points hang under their module if there is one, else under the project."""
    concepts = entries.select(F.lit(project).alias("memoir_id"), F.when(F.col("kind") == "identity", project).otherwise(F.col("name")).alias("name"), F.concat_ws(": ", "kind", F.nullif("detail", F.lit(""))).alias("definition"), F.array(F.struct(F.lit("kind").alias("namespace"), F.col("kind").alias("value"))).alias("labels"))
    modules = entries.filter("kind = 'module'").select(F.col("name").alias("module"))
    linked = entries.filter("kind != 'identity'").join(modules, F.col("parent") == F.col("module"), "left")
    target = F.when(F.col("kind") == "entrypoint", F.coalesce("module", F.lit(project))).otherwise(project)
    depends = F.col("kind") == "dependency"
    links = linked.select(F.when(depends, project).otherwise(F.col("name")).alias("source"), F.when(depends, F.col("name")).otherwise(target).alias("target"), F.when(depends, "depends_on").otherwise("part_of").alias("relation"))
    return concepts, links


def read_project(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) relative to the folder, contents of manifests only. Spark's listing passes over names that start with a dot; the
    known ones among these are named to it. Empty files are passed over too."""
    jvm, folder = spark._jvm, folder.rstrip("/")
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    hidden = [f"{folder}/{n}" for n in (".github/workflows", *[c for c in CONFIGS if c.startswith(".")])]
    paths = [folder, *[p for p in hidden if fs.exists(jvm.org.apache.hadoop.fs.Path(p))]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    root = folder.split("://")[-1]
    path = F.regexp_replace("path", rf"^.*?{re.escape(root)}/", "")
    return files.select(path.alias("path"), F.when(F.col("path").rlike(rf"/(?:{'|'.join(MANIFESTS)})$"), F.decode("content", "utf-8")).alias("content"))
