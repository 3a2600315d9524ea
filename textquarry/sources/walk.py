"""Directory trees as rows, without what ignore rules leave out.

The tree is walked level by level: the directories of a level are a DataFrame, dealt over tasks that list them, read the
ignore files in them and decide on what they hold; the directories that are kept, with the rules that hold below them, are
the next level.  So a tree with one large branch is dealt as evenly as any other, ignored directories are never listed,
and each level is written before the next begins.  The tree has to be mounted alike on all executors.

One entry is decided by the first of these that says anything: globs given as overrides (with the opposite sense; where
some include, files that none matches go), .rgignore, .ignore, .gitignore, info/exclude, the user's global excludes, extra files.  Of one
kind the nearest directory decides, within a file the last line that matches.  Names with a dot before them are
hidden, unless a rule includes them again.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ignore import parse_rules
from ..plans.shared import written
from . import git

SCHEMA = "path string, name string, type string, depth int, size long, device long, inode decimal(20,0), error string"
LEVEL = SCHEMA + ", below string"
FILES = {"custom": ".rgignore", "ignore": ".ignore", "git": ".gitignore"}
KINDS = ("custom", "ignore", "git", "exclude")


@dataclass
class Options:
    """What to leave out.  max_depth 1 is the root's children, 0 nothing; display_root is the path under which the rg dialect
    sees entries; git_global_file stands for the user's own excludes; partitions is how many tasks a level has at most (by default four a core,
    or one for so many directories)."""

    root: str = "."
    hidden: bool = False
    git_ignore: bool = True
    ignore_files: bool = True
    git_exclude: bool = True
    git_global: bool = True
    parents: bool = True
    require_git: bool = True
    follow_symlinks: bool = False
    yield_directories: bool = True
    max_depth: int | None = None
    ignore_case: str = "auto"
    dialect: str = "git"
    display_root: str = ""
    globs: list[str] = field(default_factory=list)
    glob_case_insensitive: bool = False
    extra_ignore_files: list[str] = field(default_factory=list)
    git_global_file: str | None = None
    native_paths: bool = False
    partitions: int | None = None


@lru_cache(maxsize=4096)
def compiled(text: str, dialect: str, icase: bool) -> tuple:
    """(pattern, by name alone, for directories alone, negated, on bytes) of an ignore file's rules, the last first."""
    out = []
    for r in parse_rules(text, "", dialect, icase):
        python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", r.regex).replace(r"\z", r"\Z")
        out.append((re.compile(python, re.ASCII), r.basename_only, r.dir_only, r.negated, r.bytewise))
    return tuple(reversed(out))


def told(text: str, path: str, is_dir: bool, dialect: str, icase: bool) -> bool | None:
    """Whether the rules of a file ignore (True) or include (False) the path below it; None where none matches."""
    for pattern, by_name, dir_only, negated, on_bytes in compiled(text, dialect, icase):
        subject = path.rpartition("/")[2] if by_name else path
        if on_bytes:
            subject = subject.encode("utf-8", "surrogateescape").decode("latin-1")
        if (is_dir or not dir_only) and pattern.match(subject):
            return not negated
    return None


@dataclass
class Above:
    """What holds below a directory: groups (kind, base, prefix, text), nearest first; the repository's base, if there is one."""

    groups: list[tuple[str, str, str, str]] = field(default_factory=list)
    in_git: bool = False
    repo: list[str] | None = None  # its base and prefix

    def below(self, o: Options, folder: str, base: str, prefix: str = "", load: bool = True) -> Above:
        """The same for this folder: its own files come first, and a repository's root ends the reach of outer git rules."""
        here_git = git.has_git(folder)
        own = []
        for kind, name in FILES.items():
            if load and (o.git_ignore if kind == "git" else o.ignore_files):
                if (text := git.read(os.path.join(folder, name))) is not None:
                    own.append((kind, base, prefix, text))
        if load and o.git_exclude and here_git and (file := git.exclude_file(folder)) and (text := git.read(file)) is not None:
            own.append(("exclude", base, prefix, text))
        outer = [g for g in self.groups if not here_git or g[0] not in ("git", "exclude")]
        return Above(own + outer, self.in_git or here_git, [base, prefix] if here_git else self.repo)


@dataclass
class Judge:
    """The rules that hold everywhere, and the verdict on one entry."""

    o: Options
    icase: bool
    everywhere: str | None
    extra: str

    def shown(self, path: str) -> str:
        """The path as the rg dialect sees it."""
        out = "/".join(x for x in (self.o.display_root.rstrip("/") if self.o.display_root != "/" else "", path) if x)
        out = out.removeprefix("./")
        return out[1:] if out.startswith("/") and "/" in out[1:] else out

    def ignores(self, above: Above, path: str, is_dir: bool) -> bool:
        o, rg = self.o, self.o.dialect == "rg"
        if o.globs:
            verdict = told("\n".join(o.globs), self.shown(path) if rg else path, is_dir, o.dialect, o.glob_case_insensitive)
            if verdict is not None:
                return not verdict
            if not is_dir and any(not g.startswith("!") for g in o.globs):
                return True
        verdict, by_git = None, above.in_git or not o.require_git
        for kind in KINDS:
            if kind in ("git", "exclude") and not by_git:
                continue
            for _, base, prefix, text in (g for g in above.groups if g[0] == kind):
                rel = prefix + path if prefix else path[len(base) + 1 :] if base else path
                verdict = told(text, rel, is_dir, o.dialect, self.icase)
                if verdict is not None:
                    break
            if verdict is not None:
                break
        if verdict is None and self.everywhere is not None and by_git:
            base, prefix = above.repo or ("", "")
            rel = prefix + path if prefix else path[len(base) + 1 :] if base else path
            verdict = told(self.everywhere, self.shown(path) if rg else rel, is_dir, o.dialect, self.icase)
        if verdict is None and self.extra:
            verdict = told(self.extra, self.shown(path) if rg else path, is_dir, o.dialect, self.icase)
        hidden = path.rpartition("/")[2].startswith(".")
        return bool(verdict) or verdict is None and hidden and not o.hidden


def entry(o: Options, path: str, depth: int) -> tuple[list, str | None]:
    """A row without what lies below, and the type.  A link is one unless followed to something that is there."""
    full = os.path.join(o.root, path) if depth else o.root
    name, kind, info, error = os.path.basename(path), None, None, None
    try:
        info = os.lstat(full)
        if stat.S_ISLNK(info.st_mode) and o.follow_symlinks and os.path.exists(full):
            info = os.stat(full)
        kinds = ((stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"), (stat.S_ISLNK, "symlink"))
        kind = next((k for test, k in kinds if test(info.st_mode)), "other")
    except OSError as problem:
        error = problem.strerror
    said = os.path.join(o.root, path) if o.native_paths and depth else path
    return [said, name, kind, depth, info and info.st_size, info and info.st_dev, info and Decimal(info.st_ino), error], kind


def listed(judge: Judge, path: str, depth: int, above: Above, seen: list) -> Iterator[list]:
    """The rows of a directory's entries that aren't ignored; those of directories to go into say what holds below."""
    o = judge.o
    full = os.path.join(o.root, path) if path else o.root
    try:
        names = sorted(os.listdir(full))
        info = os.stat(full)
    except OSError as problem:
        yield [path, os.path.basename(path), "directory", depth, None, None, None, problem.strerror, None]
        return
    seen = [*seen, [info.st_dev, info.st_ino]]
    here = above.below(o, full, path)
    for name in names:
        child = f"{path}/{name}" if path else name
        row, kind = entry(o, child, depth + 1)
        is_dir = kind == "directory"
        if judge.ignores(here, child, is_dir):
            continue
        down = None
        if is_dir and os.path.islink(os.path.join(full, name)):
            try:
                target = os.stat(os.path.join(full, name))
            except OSError:
                continue
            if [target.st_dev, target.st_ino] in seen:
                continue
        if is_dir and (o.max_depth is None or depth + 1 < o.max_depth):
            down = json.dumps([child, depth + 1, asdict(here), seen])
        yield [*row, down]


def tasks_for(spark: SparkSession, n: int, each: int = 256) -> int:
    """Tasks for n directories or files: all cores several times over, and more where there are very many."""
    return max(1, 4 * spark.sparkContext.defaultParallelism, -(-n // each))


def walk(spark: SparkSession, root: str, **options) -> DataFrame:
    """Entries under the root that aren't ignored: files, directories, links; those that can't be read carry an error.

    Options are the fields of Options.  A root that is a file is one row of depth 0; a missing one is a row with an error; an
    empty directory gives none.
    """
    o = Options(root=root, **options)
    if not os.path.isdir(root):
        path = os.path.basename(root)
        return spark.createDataFrame([entry(Options(**{**asdict(o), "root": root}), path, 0)[0]], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    if o.max_depth == 0:
        return none
    above, here = Above(), os.path.abspath(root)
    folders = [here]
    while (up := os.path.dirname(folders[-1])) != folders[-1]:
        folders.append(up)
    for folder in reversed(folders[1:]):  # without parents only whether they are in a repository
        above = above.below(o, folder, "", os.path.relpath(here, folder) + "/", o.parents)
    file = (o.git_global_file or git.global_excludes()) if o.git_global else None
    judge = Judge(o, git.ignores_case(o.ignore_case, root), git.read(file) if file else None, "\n".join(filter(None, map(git.read, o.extra_ignore_files))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for said in batch.column(0).to_pylist():
                path, depth, up, seen = json.loads(said)
                rows = list(listed(judge, path, depth, Above([tuple(g) for g in up["groups"]], up["in_git"], up["repo"]), seen))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)

    levels, frontier, n = none, spark.createDataFrame([(json.dumps(["", 0, asdict(above), []]),)], "below string"), 1
    while n:
        level = written(frontier.repartition(min(n, o.partitions or tasks_for(spark, n))).mapInArrow(run, LEVEL))
        levels = levels.unionByName(level.drop("below"))
        frontier = level.where("below is not null").select("below")
        n = frontier.count()
    return levels if o.yield_directories else levels.where("type <> 'directory' or type is null")


NAMES = [x.split()[0] for x in LEVEL.split(", ")]
TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.decimal128(20, 0), pa.string(), pa.string()]


def list_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """Paths of files, in the order of their bytes."""
    files = walk(spark, root, **options).where("type = 'file'").select("path")
    return files.orderBy(F.col("path").cast("binary"))
