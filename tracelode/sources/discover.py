"""Input manifests (TOML) and file discovery by recursive globs."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class InputDefinition:
    id: str
    source: str = "session"
    active: bool = True
    roots: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=lambda: ["**/*.jsonl"])
    exclude: list[str] = field(default_factory=list)
    follow_symlinks: bool = False
    format: str = "claude"
    index_reasoning: bool = False


def load_inputs(directory: str) -> list[InputDefinition]:
    """Active inputs of all *.inputs.toml files; unknown keys are ignored."""
    out = []
    for path in sorted(Path(directory).expanduser().glob("*.inputs.toml")):
        for d in tomllib.loads(path.read_text(encoding="utf-8")).get("inputs", []):
            found, decode = d.get("discover", {}), d.get("decode", {})
            out.append(
                InputDefinition(
                    d["id"], d.get("source", "session"), d.get("active", True), found.get("roots", []), found.get("include", ["**/*.jsonl"]), found.get("exclude", []),
                    found.get("follow_symlinks", False), decode.get("format") or "claude", decode.get("index_reasoning", False),
                )
            )
    return [d for d in out if d.active]


def active_inputs(directory: str, session_dirs: list[str] | None = None) -> list[InputDefinition]:
    """Declared inputs, else one implied by the session folders, else none."""
    return load_inputs(directory) or ([InputDefinition("sessions", roots=session_dirs, exclude=["**/subagents/**"])] if session_dirs else [])


def glob_regex(pattern: str) -> re.Pattern[str]:
    """** matches any number of path segments, * and ? stay inside one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return re.compile(out + r"\Z")


def discover(d: InputDefinition) -> list[str]:
    """Files below the roots, in order, each once; links that leave a root or form loops are not followed."""
    include, exclude, found = [glob_regex(p) for p in d.include], [glob_regex(p) for p in d.exclude], {}
    for root in (os.path.realpath(os.path.expanduser(r)) for r in d.roots):
        seen: set[str] = set()
        for folder, folders, files in os.walk(root, followlinks=d.follow_symlinks):
            real = os.path.realpath(folder)
            if real in seen or not (real + "/").startswith(root + "/"):
                folders.clear()
                continue
            seen.add(real)
            for name in files:
                path = os.path.join(folder, name)
                rel = os.path.relpath(path, root)
                if any(g.match(rel) for g in include) and not any(g.match(path) or g.match(rel) for g in exclude):
                    found.setdefault(os.path.realpath(path), path)
    return sorted(found.values())
