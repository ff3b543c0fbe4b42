"""Index rules: which scanned entries a catalog keeps."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T

#: Snapshot and system image folders.
SNAPSHOT_PATHS = ("/snap", "/nix/store", "/var/lib/flatpak/repo")
SNAPSHOT_FOLDERS = (".snapshots", ".zfs", "timeshift/snapshots", "timeshift-btrfs/snapshots", ".local/share/containers/storage", ".local/share/flatpak/repo")
MOST_ROOTS, MOST_TYPES = 256, 1024
PSEUDO = ("/proc", "/sys", "/dev", "/run")


@dataclass(frozen=True)
class Rules:
    roots: tuple[str, ...] = ("/",)
    excluded_folders: tuple[str, ...] = ()
    included_folders: tuple[str, ...] = ()
    exclude_snapshots: bool = True
    exclude_hidden: bool = False
    excluded_types: tuple[str, ...] = ()
    excluded_files: tuple[str, ...] = ()
    included_files: tuple[str, ...] = ()
    own: tuple[str, ...] = ()  # the engine's own folders

    def checked(self) -> Rules:
        """These rules with roots in order, none inside another, and types with their dot; ValueError where they can't be used."""
        if len(self.roots) > MOST_ROOTS:
            raise ValueError(f"At most {MOST_ROOTS} roots can be indexed")
        if len(self.excluded_types) > MOST_TYPES:
            raise ValueError(f"At most {MOST_TYPES} file types can be excluded")
        for folder in (*self.roots, *self.excluded_folders, *self.included_folders):
            if not folder.startswith("/") or "\0" in folder or {".", ".."} & set(folder.split("/")):
                raise ValueError(f"Not an absolute folder without . and ..: {folder}")
        roots = [r.rstrip("/") or "/" for r in sorted(set(self.roots))]
        if any(_inside(r, p) for r in roots for p in PSEUDO):
            raise ValueError("A root lies in a pseudo file system")
        kept = [r for r in roots if not any(r != o and _inside(r, o) for o in roots)]
        types = [file_type(t) for t in self.excluded_types]
        if None in types:
            raise ValueError("Not a file type: " + self.excluded_types[types.index(None)])
        for g in (*self.excluded_files, *self.included_files):
            re.compile(glob_regex(g).replace(r"\z", r"\Z"))
        return replace(self, roots=tuple(dict.fromkeys(kept)), excluded_types=tuple("." + t for t in types))


def _inside(path: str, folder: str) -> bool:
    return folder == "/" or path == folder or path.startswith(folder + "/")


def file_type(text: str) -> str | None:
    """An excluded file type as it is kept: lower-cased, without * and the first dot; None if it can't be one."""
    t = text.strip().lower()
    t = t.removeprefix("*").removeprefix(".")
    bad = not t or len(t) > 64 or t[0] == "." or t[-1] == "." or ".." in t or re.search(r"[\s/\0*?\[\];]", t)
    return None if bad else t


def normalized_roots(paths: list[str]) -> list[str]:
    """Folders on this machine without links and without those inside others; ValueError where one can't be a root."""
    found = sorted({os.path.realpath(p, strict=True) for p in paths})
    for p in found:
        if not os.path.isdir(p):
            raise ValueError(f"Not a folder: {p}")
    if not found:
        raise ValueError("There is no root")
    return list(Rules(roots=tuple(found)).checked().roots)


def glob_regex(glob: str) -> str:
    """A file glob in which * and ? stop at separators and ** does not."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", r"\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[4:-2] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"(?s)^{out}" + r"\z"


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def below_root(path: Column, roots: tuple[str, ...]) -> Column:
    """Path relative to its root; empty for a root itself."""
    out = path
    for r in roots:
        out = F.when(T.within(path, r), F.regexp_replace(F.substring(path, F.lit(len(r) + 1), F.length(path)), "^/", "")).otherwise(out)
    return out


def _shut_out(path: Column, rules: Rules) -> tuple[Column, Column]:
    """(the path is or lies in an excluded folder that no exception opens, it never is listed) for checked rules."""
    relative = below_root(path, rules.roots)
    excluded = [T.within(path, e) for e in rules.excluded_folders]
    if rules.exclude_hidden:
        excluded.append(relative.rlike(r"(^|/)[.]"))
    if rules.exclude_snapshots:
        excluded += [T.within(path, p) for p in SNAPSHOT_PATHS if not any(_inside(r, p) for r in rules.roots)]
        excluded.append(relative.rlike("(^|/)(" + "|".join(map(re.escape, SNAPSHOT_FOLDERS)) + ")(/|$)"))
    exception = _any([T.within(path, e) for e in rules.included_folders])
    return _any(excluded) & ~exception, _any([T.within(path, p) for p in (*PSEUDO, *rules.own)])


def entered(path: Column, rules: Rules) -> Column:
    """A scan goes into this folder: no rule shuts it out, or an exception lies below it."""
    rules = rules.checked()
    shut, never = _shut_out(path, rules)
    leads = _any([F.lit(e).startswith(F.concat(path, F.lit("/"))) for e in rules.included_folders])
    return (~shut | leads) & ~never


def kept(scanned: DataFrame, rules: Rules) -> DataFrame:
    """Rows of a scan (path string, kind) that the rules list: exclusions hold for all below them, exceptions win, globs and types are for files."""
    rules = rules.checked()
    path, relative = F.col("path"), below_root(F.col("path"), rules.roots)
    name = F.regexp_extract(path, "(?s)([^/]*)$", 1)
    shut, never = _shut_out(path, rules)
    lower = T.ascii_lower(name)
    typed = _any([lower.endswith(t) & (F.length(name) > len(t)) for t in rules.excluded_types])
    match = lambda globs: _any([name.rlike(glob_regex(g)) | relative.rlike(glob_regex(g)) for g in globs])
    file = F.col("kind") != "folder"
    unwanted = file & (typed | match(rules.excluded_files))
    if rules.included_files:
        unwanted = unwanted | (file & ~match(rules.included_files))
    return scanned.where(_any([T.within(path, r) for r in rules.roots]) & ~never & ~shut & ~unwanted)


def added_paths(old: Rules, new: Rules) -> list[str] | None:
    """Paths to scan when only roots, exclusions or exceptions were added; None if all must be scanned."""
    fields = ("roots", "excluded_folders", "included_folders")
    same = replace(old, **{f: getattr(new, f) for f in fields}) == new
    if not same or any(set(getattr(old, f)) - set(getattr(new, f)) for f in fields):
        return None
    return sorted({p for f in fields for p in set(getattr(new, f)) - set(getattr(old, f))})


def excluding(rules: Rules, paths: list[str]) -> Rules:
    """The rules with selected folders excluded too, those inside others left out."""
    folders = sorted({*rules.excluded_folders, *(p.rstrip("/") for p in paths)})
    return replace(rules, excluded_folders=tuple(f for f in folders if not any(f != o and _inside(f, o) for o in folders)))
