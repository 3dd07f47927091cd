"""Where a scan starts: git metadata, configuration files and their precedence."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

#: Variables that build systems set, in the order in which they count.
BRANCH_VARIABLES = ("TOPOLAKE_BRANCH", "GITHUB_REF_NAME", "CI_COMMIT_BRANCH", "BRANCH_NAME")
COMMIT_VARIABLES = ("TOPOLAKE_COMMIT_SHA", "GITHUB_SHA", "CI_COMMIT_SHA", "GIT_COMMIT")


@dataclass
class Settings:
    root: str = "."
    project: str | None = None
    excludes: list[str] = field(default_factory=list)
    disabled_rules: list[str] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    overrides: dict[str, dict] = field(default_factory=dict)
    only: list[str] | None = None
    refine: bool = False
    hub: str | None = None
    token: str | None = None


def repository_file(text: str | None) -> dict:
    """Parts of a repository's TOML; malformed text counts as none."""
    try:
        data = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return {}
    scanner = data.get("scanner", {})
    return {
        "project": scanner.get("project_slug"), "refine": bool(scanner.get("ml_refine", False)), "excludes": list(scanner.get("exclude", {}).get("paths", [])),
        "disabled_rules": list(scanner.get("patterns", {}).get("disabled", [])), "rules": list(data.get("patterns", [])), "overrides": dict(data.get("services", {})),
    }


def global_file(path: Path) -> dict:
    try:
        data = json.loads(path.read_text())
    except (OSError, ValueError):
        return {}
    return {k: data[k] for k in ("hub", "token") if k in data}


def merged(arguments: dict, environment: dict, repository: dict, user: dict) -> Settings:
    """Arguments before environment before repository before user file; refinement is on where any asks for it."""
    layers = [arguments, environment, repository, user]
    out = Settings()
    for name in out.__dataclass_fields__:
        found = [v for layer in layers if (v := layer.get(name)) not in (None, [], {})]
        if found:
            setattr(out, name, found[0])
    out.refine = any(layer.get("refine") for layer in layers)
    return out


def only_plugins(text: str | None) -> list[str] | None:
    return [p.strip() for p in text.split(",") if p.strip()] if text else None


def _ref(git: Path, name: str) -> str | None:
    loose = git / name
    if loose.exists():
        return loose.read_text().strip()
    packed = git / "packed-refs"
    rows = packed.read_text().splitlines() if packed.exists() else []
    return next((r.split()[0] for r in rows if r.endswith(" " + name)), None)


def git_context(root: str, environment: dict[str, str] | None = None) -> dict[str, str | None]:
    """remote, repo_name, branch and commit; a commit of None asks for the content hash."""
    env, git = os.environ if environment is None else environment, Path(root) / ".git"
    remotes = dict(re.findall(r'\[remote "([^"]+)"\][^\[]*?url\s*=\s*(\S+)', (git / "config").read_text())) if (git / "config").exists() else {}
    remote = remotes.get("origin") or next(iter(remotes.values()), None)
    head = (git / "HEAD").read_text().strip() if (git / "HEAD").exists() else ""
    ref = head.removeprefix("ref: ") if head.startswith("ref: ") else None
    branch = ref.removeprefix("refs/heads/") if ref else None
    commit = _ref(git, ref) if ref else head or None
    first = lambda names: next((env[n] for n in names if env.get(n)), None)
    name = re.sub(r"\.git$", "", re.split(r"[/:]", remote.rstrip("/"))[-1]) if remote else Path(root).resolve().name
    return {"remote": remote, "repo_name": name, "branch": branch or first(BRANCH_VARIABLES) or "detached", "commit": commit or first(COMMIT_VARIABLES)}


def site_packages(root: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Directories of installed libraries by language, where there are any."""
    env, base = os.environ if environment is None else environment, Path(root)
    homes = [base / d for d in ("venv", ".venv", "env")] + ([Path(env["VIRTUAL_ENV"])] if env.get("VIRTUAL_ENV") else [])
    found = {"python": next((str(p) for h in homes for p in sorted(h.glob("lib/python*/site-packages"))), None), "node": str(base / "node_modules") if (base / "node_modules").is_dir() else None, "ruby": next((str(p) for p in sorted(base.glob("vendor/bundle/ruby/*/gems"))), None)}
    return {k: v for k, v in found.items() if v}


def library_dir(language: str, home: str, dep: str) -> str | None:
    """Where a library's sources lie."""
    base = Path(home)
    if language == "ruby":
        return next((str(p) for p in sorted(base.glob(f"{dep}-*"))), None)
    path = base / (dep.replace("-", "_") if language == "python" else dep)
    return str(path) if path.is_dir() else None
