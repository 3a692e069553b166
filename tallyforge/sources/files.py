"""Sources of code: a folder, a file, a text in memory, or any table of (project, path, content)."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..frontend import extensions, language_of

SOURCES = "project string, path string, content binary"


class UnsupportedLanguage(ValueError):
    """A path whose extension no language has."""

    def __init__(self, path: str):
        super().__init__(f"{path}: unsupported language; give a file with one of these extensions: {', '.join(extensions())}")


Rules = list[tuple[re.Pattern, bool, bool]]


def _rules(*paths: str) -> Rules:
    """(pattern, negated, for folders only) of ignore files, those that exist."""
    out = []
    for path in paths:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                lines = f.read().splitlines()
        except OSError:
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:].removeprefix("\\")
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            parts = [re.escape(x) if x == "**" else fnmatch.translate(x).removesuffix(r"\Z").removesuffix(r"\z").removeprefix("(?s:").removesuffix(")").replace(".*", "[^/]*") for x in line.lstrip("/").split("/")]
            body = "/".join(parts).replace(re.escape("**") + "/", "(?:.*/)?").replace("/" + re.escape("**"), "/.*")
            out.append((re.compile(f"(?:{'' if anchored else '(?:.*/)?'}{body})$"), negated, only_dirs))
    return out


def _global_ignore() -> str:
    """The user's own ignore file: core.excludesFile, or git/ignore in the configuration folder."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    try:
        own = subprocess.run(["git", "config", "--global", "--get", "core.excludesFile"], capture_output=True, text=True, timeout=30).stdout.strip()
    except (OSError, subprocess.TimeoutExpired):
        own = ""
    return os.path.expanduser(own) if own else os.path.join(home, "git", "ignore")


def _around(root: str) -> list[tuple[str, Rules]]:
    """(folder, rules) of what holds for root from outside, the weakest first: the user's file, the working copy's exclude
    file, the ignore files of the folders above. .gitignore files count inside a working copy only, up to its top."""
    folders = _above(root)
    top = next((f for f in folders if os.path.exists(os.path.join(f, ".git"))), None)
    out = [(top, _rules(_global_ignore())), (top, _rules(os.path.join(top, ".git", "info", "exclude")))] if top else []
    for f in reversed(folders[1:]):
        inside = top is not None and (f + os.sep).startswith(top.rstrip(os.sep) + os.sep)
        out.append((f, _rules(*[os.path.join(f, n) for n in ([".gitignore"] if inside else []) + [".ignore"]])))
    return [(f, r) for f, r in out if r]


def walk(root: str) -> list[str]:
    """Relative paths of the supported files under root, hidden and ignored ones left out, sorted by component. Of rules
    that match, the one of the nearest folder counts, and in it the last one; .ignore goes before .gitignore."""
    found: list[str] = []
    root = os.path.realpath(root)
    git = any(os.path.exists(os.path.join(f, ".git")) for f in _above(root))

    def visit(folder: str, rules: list[tuple[str, Rules]]) -> None:
        rules = [*rules, (folder, _rules(*[os.path.join(folder, n) for n in ([".gitignore"] if git or os.path.exists(os.path.join(folder, ".git")) else []) + [".ignore"]]))]
        for e in sorted(os.scandir(folder), key=lambda x: x.name):
            if e.name.startswith("."):
                continue
            is_dir, ignored = e.is_dir(follow_symlinks=False), False
            for base, own in rules:
                path = os.path.relpath(e.path, base)
                for rx, negated, only_dirs in own:
                    if rx.match(path) and (is_dir or not only_dirs):
                        ignored = not negated
            if ignored:
                continue
            if is_dir:
                visit(e.path, rules)
            elif e.is_file() and language_of(e.name):
                found.append(os.path.relpath(e.path, root))

    visit(root, _around(root))
    return sorted(found, key=lambda p: p.split(os.sep))


def _above(folder: str) -> list[str]:
    """The folder and all above it."""
    out = [folder]
    while (up := os.path.dirname(out[-1])) != out[-1]:
        out.append(up)
    return out


def targets(path: str) -> list[tuple[str, str]]:
    """(absolute path, relative path) of what a folder or a single file holds."""
    path = os.path.realpath(path)
    if os.path.isfile(path):
        if not language_of(path):
            raise UnsupportedLanguage(path)
        return [(path, os.path.basename(path))]
    if not os.path.isdir(path):
        raise FileNotFoundError(f"{path}: no such file or directory; check the path")
    return [(os.path.join(path, p), p) for p in walk(path)]


def default_project_name(path: str) -> str:
    """A folder's name, or a file's name without its extension."""
    path = os.path.realpath(path)
    name = os.path.basename(path)
    return os.path.splitext(name)[0] if os.path.isfile(path) else name or "project"


def git_info(path: str) -> tuple[str | None, str | None]:
    """(remote address, commit) of the working copy around path, where there is one."""
    folder = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))

    def ask(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() or None if done.returncode == 0 else None

    return ask("remote", "get-url", "origin"), ask("rev-parse", "HEAD")


def from_path(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Files of a folder (or one file) that the driver and the executors can read, as (project, path, content).

    The driver lists paths only; the tasks read the files. A file that can't be read has null content.
    """
    return from_paths(spark, targets(path), project or default_project_name(path))


def from_paths(spark: SparkSession, listed: list[tuple[str, str]], project: str) -> DataFrame:
    """Listed files (place, path in the project) as (project, path, content), read by the tasks."""
    paths = spark.createDataFrame([(project, r, a) for a, r in listed], "project string, path string, place string")
    if listed:
        paths = paths.repartition(min(len(listed), spark.sparkContext.defaultParallelism * 4))

    def load(batches):
        import pandas as pd

        for pdf in batches:
            content = []
            for p in pdf["place"]:
                try:
                    with open(p, "rb") as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            yield pd.DataFrame({"project": pdf["project"], "path": pdf["path"], "content": content})

    return paths.mapInPandas(load, SOURCES)


def from_binary_files(spark: SparkSession, path: str, project: str, glob: str | None = None) -> DataFrame:
    """Files under any path that Spark can list (an object store), without ignore rules."""
    from pyspark.sql import functions as F

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    base = path.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    return df.select(F.lit(project).alias("project"), rel.alias("path"), "content")


def from_text(spark: SparkSession, filename: str, source: str) -> DataFrame:
    """One text; the project is the file's name without its extension."""
    if not language_of(filename):
        raise UnsupportedLanguage(filename)
    return spark.createDataFrame([(os.path.splitext(os.path.basename(filename))[0], filename, source.encode())], SOURCES)
