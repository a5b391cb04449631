"""Where code comes from: the repository around a root, read from its files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from pathlib import Path


def scrub(url: str | None) -> str | None:
    """A remote's url without the user and secret before its host."""
    return re.sub(r"^([^/]*?://)[^/]*@", r"\1", url) if url else url


def short_commit(commit: str | None) -> str | None:
    """The first 12 digits of a commit."""
    return commit[:12] if commit else None


def repository(path: str) -> dict:
    """root, branch, commit_sha and remote of the repository around a path; nulls where there is none."""
    none = {"root": None, "branch": None, "commit_sha": None, "remote": None}
    here = Path(path)
    for folder in (here, *here.parents):
        git = folder / ".git"
        if git.is_file():  # a worktree
            target = git.read_text(errors="replace").partition("gitdir:")[2].strip()
            git = (folder / target).resolve() if target else git
        if git.is_dir():
            return none | {"root": str(folder)} | _head(git)
    return none


def below(path: str, skip: Callable[[str], bool]) -> tuple[list[dict], list[str]]:
    """(repositories that begin below a local folder, symbolic links below it); folders that skip() takes aren't entered."""
    repositories, links = [], []
    for folder, folders, files in os.walk(path):
        if folder != path and (".git" in folders or ".git" in files):
            repositories.append(repository(folder))
        links += [os.path.join(folder, n) for n in folders + files if os.path.islink(os.path.join(folder, n))]
        folders[:] = [n for n in folders if n != ".git" and not skip(os.path.join(folder, n))]
    return repositories, links


def _head(git: Path) -> dict:
    read = lambda p: p.read_text(errors="replace") if p.is_file() else ""
    common = git / read(git / "commondir").strip() if (git / "commondir").is_file() else git
    head, branch, commit = read(git / "HEAD").strip(), None, None
    if head.startswith("ref:"):
        ref = head[4:].strip()
        branch = ref.removeprefix("refs/heads/")
        commit = read(git / ref).strip() or read(common / ref).strip()
        if not commit:
            packed = re.search(rf"^([0-9a-f]{{40,64}}) {re.escape(ref)}$", read(common / "packed-refs"), re.M)
            commit = packed[1] if packed else None
    elif re.fullmatch(r"[0-9a-f]{40,64}", head):
        commit = head
    origin = re.search(r'\[remote "origin"\][^\[]*?^\s*url\s*=\s*(\S+)', read(common / "config"), re.M | re.S)
    return {"branch": branch, "commit_sha": commit or None, "remote": scrub(origin[1]) if origin else None}
