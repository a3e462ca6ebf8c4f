"""Workspace configuration: reading, validation, merge with defaults, exclude patterns."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

SEVERITIES = ("error", "warning", "info", "off")
THRESHOLDS = ("componentTsLines", "componentTemplateLines", "serviceTsLines", "serviceMixedMinLines", "serviceMixedMinSignals")


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = ()
    thresholds: dict = field(default_factory=lambda: dict(zip(THRESHOLDS, (200, 200, 200, 120, 3))))
    rules: dict = field(default_factory=dict)
    output_dir: str = ".corvane"


def merged(user: object, base: Config = Config()) -> Config:
    """Valid parts of a parsed document over defaults: exclude paths replace, thresholds and rules merge by key; anything of
    a wrong type is left out, rules of unknown codes are kept."""
    if not isinstance(user, dict):
        return base
    out = base
    paths = user.get("exclude", {}).get("paths") if isinstance(user.get("exclude"), dict) else None
    if isinstance(paths, list):
        out = replace(out, exclude=tuple(p.strip() for p in paths if isinstance(p, str) and p.strip()))
    limits = user.get("thresholds")
    if isinstance(limits, dict):
        ok = {k: v for k, v in limits.items() if k in THRESHOLDS and isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v < float("inf")}
        out = replace(out, thresholds={**out.thresholds, **ok})
    rules = user.get("rules")
    if isinstance(rules, dict):
        out = replace(out, rules={**out.rules, **{k: v for k, v in rules.items() if v in SEVERITIES and isinstance(v, str)}})
    report = user.get("report")
    if isinstance(report, dict) and isinstance(report.get("outputDir"), str) and report["outputDir"].strip():
        out = replace(out, output_dir=report["outputDir"].strip())
    return out


def read(path: str) -> Config:
    """A missing or broken file is the default."""
    try:
        with open(path, encoding="utf-8") as f:
            return merged(json.load(f))
    except (OSError, ValueError):
        return Config()


def ts_paths(root: str) -> tuple[str | None, dict[str, list[str]] | None]:
    """baseUrl and paths of a workspace's tsconfig.json (comments and last commas allowed); (None, None) where there are none."""
    try:
        with open(os.path.join(root, "tsconfig.json"), encoding="utf-8") as f:
            bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", f.read(), flags=re.S)
        got = json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)).get("compilerOptions", {})
    except (OSError, ValueError, AttributeError):
        return None, None
    base, paths = (got.get("baseUrl"), got.get("paths")) if isinstance(got, dict) else (None, None)
    ok = {k: [t for t in v if isinstance(t, str)] for k, v in paths.items() if isinstance(v, list)} if isinstance(paths, dict) else None
    return base if isinstance(base, str) else None, ok


def output_dir(root: str, wanted: str, default: str = ".corvane") -> str:
    """The report folder: inside the workspace and not the workspace itself, else the default."""
    inside = os.path.normpath(os.path.join("/", wanted)) if wanted and not os.path.isabs(wanted) else "/"
    norm = os.path.normpath(wanted) if wanted else "."
    ok = bool(wanted) and not os.path.isabs(wanted) and norm not in (".", "") and not norm.startswith("..") and inside != "/"
    return os.path.join(root, norm if ok else default)


def clean(path: str) -> str:
    p = path.strip().replace("\\", "/")
    p = p[2:] if p.startswith("./") else p
    return p[1:] if p.startswith("/") else p


def glob_regex(pattern: str) -> str:
    """** is anything, * and ? stay within a folder; the whole path must match."""
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.sub(r"([\\.\[\]{}()+\-^$|])", r"\\\1", p) for p in parts) + "$"


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """One condition for all patterns: prefixes end at a slash, patterns with * or ? are regular expressions."""
    out = F.lit(False)
    for raw in patterns:
        p = clean(raw)
        if not p:
            continue
        if "*" in p or "?" in p:
            out = out | path.rlike(glob_regex(p))
        else:
            prefix = p.rstrip("/")
            out = out | (path == prefix) | path.startswith(prefix + "/")
    return out


def is_excluded(path: str, patterns: tuple[str, ...]) -> bool:
    """The same for one path, on the driver."""
    c = clean(path)
    for p in filter(None, map(clean, patterns)):
        if "*" in p or "?" in p:
            if re.search(glob_regex(p), c):
                return True
        elif c == p.rstrip("/") or c.startswith(p.rstrip("/") + "/"):
            return True
    return False
