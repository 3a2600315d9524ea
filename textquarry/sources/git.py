"""What a git repository says about ignoring: where it is, its config values, its excludes.  Small helpers for the driver and for tasks."""

from __future__ import annotations

import os
import re

LINE = re.compile(
    r"""[ \t]*(?:\[(?P<section>[^\]]*)\][ \t]*)?           # a section may stand before a key
        (?:(?P<key>[A-Za-z0-9-]+)[ \t]*(?:=(?P<value>.*)|(?P<bare>[\r#;].*|\Z)))?""",
    re.X | re.S,
)
PART = re.compile(r'"|\\(?P<escaped>.)|(?P<space>[ \t]+)|(?P<end>[#;\r])|(?P<text>[^"\\ \t#;\r]+|.)', re.S)
ESCAPES = {"n": "\n", "t": "\t", "b": "\b"}


def read(path: str) -> str | None:
    """The text of a file, undecodable bytes as surrogates; None where it can't be read."""
    try:
        with open(path, encoding="utf-8", errors="surrogateescape", newline="") as file:
            return file.read()
    except OSError:
        return None


def unquoted(raw: str) -> str:
    """A config value: quotes keep blanks and comment marks, blanks around go, those within become single characters each."""
    out, blanks, quoted = "", 0, False
    for m in PART.finditer(raw):
        if m[0] == '"':
            quoted = not quoted
            continue
        if m["end"] and (not quoted or m["end"] == "\r"):
            break
        if m["space"] and not quoted:
            blanks += len(m[0]) if out else 0
            continue
        piece = ESCAPES.get(m["escaped"], m["escaped"]) if m["escaped"] else m[0]
        out, blanks = out + " " * blanks + piece, 0
    return out


def config_value(text: str, section: str, key: str) -> str | None:
    """The last value of section.key, case-insensitively; ``true`` for a key alone.  Subsections are other sections."""
    found, inside = None, False
    for line in text.split("\n"):
        m = LINE.match(line)
        if m["section"] is not None:
            inside = m["section"].lower() == section.lower()
        if inside and m["key"] and m["key"].lower() == key.lower():
            found = "true" if m["value"] is None else unquoted(m["value"])
    return found


def config_bool(value: str) -> bool | None:
    low = value.strip().lower()
    if low in ("true", "yes", "on") or re.fullmatch(r"-?\d+", low) and int(low):
        return True
    return False if low in ("false", "no", "off", "", "0") else None


def has_git(folder: str) -> bool:
    return os.path.exists(os.path.join(folder, ".git"))


def git_dirs(folder: str) -> tuple[str, str] | None:
    """The git folder and the common folder of the repository at this root; .git may be a file that names the former."""
    dot = os.path.join(folder, ".git")
    if os.path.isdir(dot):
        own = dot
    else:
        said = (read(dot) or "").strip()
        if not said.startswith("gitdir:"):
            return None
        own = os.path.join(folder, said.removeprefix("gitdir:").strip())
    shared = (read(os.path.join(own, "commondir")) or "").strip()
    return own, os.path.join(own, shared) if shared else own


def repository_of(path: str) -> str | None:
    """The nearest folder at or above path that has a .git."""
    path = os.path.abspath(path)
    while not has_git(path):
        above = os.path.dirname(path)
        if above == path:
            return None
        path = above
    return path


def ignores_case(mode: str, root: str) -> bool:
    """mode: sensitive, insensitive, or auto: what the repository's config says, and sensitive where it says nothing."""
    if mode != "auto":
        return mode == "insensitive"
    repo = repository_of(root)
    dirs = repo and git_dirs(repo)
    value = dirs and config_value(read(os.path.join(dirs[1], "config")) or "", "core", "ignorecase")
    return bool(value and config_bool(value))


def exclude_file(folder: str) -> str | None:
    dirs = git_dirs(folder)
    return dirs and os.path.join(dirs[1], "info", "exclude")


def global_excludes() -> str | None:
    """The user's excludes file: as ~/.gitconfig names it, else as the XDG config does, else the XDG ignore file."""
    home = os.environ.get("HOME")
    xdg = os.environ.get("XDG_CONFIG_HOME") or (home and os.path.join(home, ".config"))
    for config in (home and os.path.join(home, ".gitconfig"), xdg and os.path.join(xdg, "git", "config")):
        value = config and config_value(read(config) or "", "core", "excludesfile")
        if value:
            return os.path.expanduser(value)
    return xdg and os.path.join(xdg, "git", "ignore")
