"""Walks with ignore files: which rules are loaded, where they hold, and which wins."""

import os

import pytest

from textquarry.sources import git
from textquarry.sources.walk import list_files, walk

#: name: (files and their text, folders with a .git, options, expected files)
SPECS = {
    "basic": ({".gitignore": "*.o\n/top\n", "a.o": "", "b.c": "", "top": "", "s/top": "", "s/c.o": ""}, [""], {}, ["b.c", "s/top"]),
    "no repository": ({".gitignore": "*.o\n", "a.o": ""}, [], {}, ["a.o"]),
    "none required": ({".gitignore": "*.o\n", "a.o": "", "b": ""}, [], {"require_git": False}, ["b"]),
    "hidden": ({".gitignore": "!.env\n!.shown/\n", ".env": "", ".hid": "", ".dir/x": "", ".shown/y": "", "v": ""}, [""], {}, [".env", ".shown/y", "v"]),
    "hidden too": ({".h": "", "v": ""}, [], {"hidden": True}, [".h", "v"]),
    "kind before depth": ({".ignore": "*.x\n", "s/.gitignore": "!*.x\n", "s/a.x": "", "b.y": ""}, [""], {}, ["b.y"]),
    "custom first": ({".rgignore": "!a.x\n", ".ignore": "*.x\n", "a.x": "", "b.x": ""}, [], {}, ["a.x"]),
    "nearest first": ({".ignore": "*.x\n", "s/.ignore": "!k.x\n", "s/k.x": "", "s/l.x": ""}, [], {}, ["s/k.x"]),
    "nested repository": ({".gitignore": "*.log\n", ".ignore": "*.tmp\n", "a.log": "", "s/b.log": "", "s/c.tmp": "", "s/.gitignore": "*.dat\n", "s/d.dat": "", "e.dat": ""}, ["", "s"], {}, ["e.dat", "s/b.log"]),
    "excludes": ({".git/info/exclude": "x\n", "x": "", "s/x": "", "y": ""}, [""], {}, ["y"]),
    "excludes off": ({".git/info/exclude": "x\n", "x": ""}, [""], {"git_exclude": False}, ["x"]),
    "globs": ({".gitignore": "i.c\n", "a.c": "", "b.c": "", "a.h": "", "i.c": "", "s/c.c": "", "skip/d.c": ""}, [""], {"globs": ["*.c", "!b*", "!skip/"]}, ["a.c", "i.c", "s/c.c"]),
    "glob case": ({"a.C": "", "b.h": ""}, [], {"globs": ["*.c"], "glob_case_insensitive": True}, ["a.C"]),
    "pruned": ({".ignore": "d/\n!d/x\n", "d/x": "", "e": ""}, [], {}, ["e"]),
    "rg braces": ({".ignore": "{a,b}.x\n", "a.x": "", "c.x": ""}, [], {"dialect": "rg"}, ["c.x"]),
    "rg bang": ({".ignore": "*.x\n!\n", "a.x": "", ".h": ""}, [], {"dialect": "rg", "ignore_files": True}, [".h", ".ignore", "a.x"]),
    "case": ({".gitignore": "*.LOG\n", "a.log": "", "b": ""}, [""], {"ignore_case": "insensitive"}, ["b"]),
    "case of config": ({".gitignore": "*.LOG\n", ".git/config": "[core]\n\tignorecase = true\n", "a.log": "", "b": ""}, [""], {}, ["b"]),
    "crlf and mark": ({".ignore": "\ufeffa\r\nb\r\n", "a": "", "b": "", "c": ""}, [], {}, ["c"]),
    "rules off": ({".gitignore": "a\n", ".ignore": "b\n", "a": "", "b": ""}, [""], {"git_ignore": False, "ignore_files": False}, ["a", "b"]),
}


def make(root, files, repos):
    for repo in repos:
        (root / repo / ".git" / "info").mkdir(parents=True, exist_ok=True)
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    return str(root)


@pytest.mark.parametrize("name", SPECS)
def test_tree(spark, tmp_path, name):
    files, repos, options, want = SPECS[name]
    root = make(tmp_path / "r", files, repos)
    got = list_files(spark, root, **{"git_global": False, "parents": False, **options})
    assert [r["path"] for r in got.collect()] == want


def test_parents(spark, tmp_path):
    make(tmp_path, {".gitignore": "*.o\n/in/x\n", ".ignore": "y\n", "in/a.o": "", "in/x": "", "in/y": "", "in/s/x": ""}, [""])
    got = lambda **o: [r["path"] for r in list_files(spark, str(tmp_path / "in"), git_global=False, **o).collect()]
    assert got() == ["s/x"]
    assert got(parents=False) == ["a.o", "s/x", "x", "y"]


def test_everywhere(spark, tmp_path):
    root = make(tmp_path / "r", {"ga": "", "s/ga": "", "s/gb": "", "ia": "", "s/ia": "", "s/ib": ""}, [""])
    make(tmp_path, {"g": "/ga\ns/gb\n", "e": "/ia\ns/ib\n"}, [])
    how = {"git_global_file": str(tmp_path / "g"), "extra_ignore_files": [str(tmp_path / "e")], "parents": False}
    assert [r["path"] for r in list_files(spark, root, **how).collect()] == ["s/ga", "s/ia"]
    assert [r["path"] for r in list_files(spark, f"{root}/s", **how, dialect="rg", display_root="s").collect()] == ["ga", "ia"]


def test_levels_and_rows(spark, tmp_path):
    root = make(tmp_path / "r", {f"d/{i}/f{i}": "x" for i in range(5)}, [])
    os.symlink(f"{root}/d", f"{root}/d/0/up")
    followed = walk(spark, root, follow_symlinks=True, parents=False, git_global=False)
    assert sorted(r["path"] for r in followed.where("type = 'file'").collect()) == [f"d/{i}/f{i}" for i in range(5)]
    assert {r["type"] for r in walk(spark, root, yield_directories=False).collect()} == {"file", "symlink"}
    assert walk(spark, root, native_paths=True).where(f"path = '{root}/d'").count() == 1


def test_config():
    text = '; c\n[core "sub"]\nignorecase = false\n[CORE] bare\n\tIgnoreCase = "tr" ue ; c\nx = a\\tb  c # d\nx="q # r"\n'
    assert git.config_value(text, "core", "ignorecase") == "tr ue" and git.config_value(text, "core", "bare") == "true"
    assert git.config_value(text, "core", "x") == "q # r" and git.config_value(text, "user", "x") is None


def test_gitfile(tmp_path):
    make(tmp_path, {"main/.git/info/exclude": "x", "main/.git/worktrees/w/commondir": "../..\n", "w/.git": f"gitdir: {tmp_path}/main/.git/worktrees/w\n"}, [])
    assert os.path.samefile(git.exclude_file(str(tmp_path / "w")), tmp_path / "main/.git/info/exclude")
    assert git.repository_of(str(tmp_path / "w" / "deep")) == str(tmp_path / "w")


def test_global_excludes(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    assert git.global_excludes() == f"{tmp_path}/.config/git/ignore"
    make(tmp_path, {".config/git/config": "[core]\nexcludesFile = /e\n"}, [])
    assert git.global_excludes() == "/e"
    make(tmp_path, {".gitconfig": "[core]\nexcludesfile = ~/mine\n"}, [])
    assert git.global_excludes() == f"{tmp_path}/mine"
