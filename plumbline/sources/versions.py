"""What a snapshot says of its version-control state, read from the files of a repository's folder."""

from __future__ import annotations

import re
import shutil
import subprocess
from pathlib import Path

_SHA = re.compile(r"[0-9a-f]{40,64}")


def _folder(path: str) -> Path | None:
    """The repository's own folder at ``path`` or above; of a linked work tree the folder that it names."""
    for at in (Path(path).resolve(), *Path(path).resolve().parents):
        own = at / ".git"
        if own.is_dir():
            return own
        if own.is_file() and (named := re.match(r"gitdir:\s*(.+)", own.read_text())):
            return (at / named[1].strip()).resolve()
    return None


def _resolve(own: Path, name: str) -> str | None:
    """The commit that a reference names, as a file of its own or among the packed ones."""
    shared = own / "commondir"
    homes = [own, (own / shared.read_text().strip()).resolve()] if shared.is_file() else [own]
    for home in homes:
        if (home / name).is_file():
            return (home / name).read_text().strip()
        packed = home / "packed-refs"
        if packed.is_file():
            for line in packed.read_text().splitlines():
                sha, _, ref = line.partition(" ")
                if ref == name and _SHA.fullmatch(sha):
                    return sha
    return None


def _origin(own: Path) -> str | None:
    shared = own / "commondir"
    config = ((own / shared.read_text().strip()).resolve() if shared.is_file() else own) / "config"
    if not config.is_file():
        return None
    section = re.search(r'^\[remote "origin"\]\n((?:[ \t]+.*\n?)*)', config.read_text(), re.M)
    url = re.search(r"^\s*url\s*=\s*(\S+)", section[1], re.M) if section else None
    return url[1] if url else None


def _is_dirty(path: str) -> bool | None:
    """Whether the work tree differs from its commit; None where no client is at hand to say so."""
    if shutil.which("git") is None:
        return None
    done = subprocess.run(["git", "-C", path, "status", "--porcelain"], capture_output=True, text=True, timeout=60, check=False)
    return bool(done.stdout.strip()) if done.returncode == 0 else None


def repository_state(path: str) -> dict[str, object] | None:
    """``commit_sha, short_sha, branch_name, remote_url, is_dirty`` of the repository around ``path``, None for none.

    Without a branch the name is ``detached-`` and the first seven digits of the commit. A repository without any
    commit has none of the two.
    """
    own = _folder(path)
    if own is None or not (own / "HEAD").is_file():
        return None
    head = (own / "HEAD").read_text().strip()
    named = re.fullmatch(r"ref:\s*(\S+)", head)
    sha = _resolve(own, named[1]) if named else head
    branch = named[1].removeprefix("refs/heads/") if named else f"detached-{head[:7]}"
    return {"commit_sha": sha, "short_sha": sha[:7] if sha else None, "branch_name": branch if sha else None, "remote_url": _origin(own), "is_dirty": _is_dirty(str(Path(path)))}
