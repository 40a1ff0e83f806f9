"""Configuration: sources, dictionary of key words, settings. Read on the driver, never a DataFrame of size."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

FETCH_METHODS = ("rss", "html", "playwright", "github", "huggingface")


@dataclass
class Settings:
    crawler: dict[str, Any] = field(default_factory=dict)
    ai: dict[str, Any] = field(default_factory=dict)
    report: dict[str, Any] = field(default_factory=dict)
    sources: list[dict[str, Any]] = field(default_factory=list)


def _yaml(path: Path) -> dict:
    return (yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.exists() else {}


def checked(source: dict[str, Any]) -> dict[str, Any]:
    made = {"category": "", "fetch_method": "rss", "enabled": True, "base_url": "", **source}
    if not made.get("key"):
        raise ValueError("a source needs a key")
    if made["fetch_method"] not in FETCH_METHODS:
        raise ValueError(f"fetch method not known: {made['fetch_method']}")
    return made


def load(folder: str | Path = "config", sources_file: str | Path | None = None) -> Settings:
    """Settings of a folder. The sources file is the given one, there or in the folder, else its own or the example."""
    folder = Path(folder)
    tries = [Path(sources_file), folder / sources_file] if sources_file else [folder / "sources.yaml", folder / "sources.example.yaml"]
    data = _yaml(next((p for p in tries if p.exists()), tries[0]))
    base = _yaml(folder / "crawler.yaml")
    out = Settings(base.get("crawler") or {}, base.get("ai") or {}, base.get("report") or {})
    out.report |= {k: data[k] for k in ("title", "tags", "title_template") if k in data}
    for name, key in (("AIA_PROXY_URL", "proxy_url"), ("AIA_MODEL", "model")):
        if os.environ.get(name):
            out.ai[key] = os.environ[name]
    listed = data.get("sources") or {}
    rows = [{"key": k, **(v or {})} for k, v in listed.items()] if isinstance(listed, dict) else listed
    out.sources = list({r["key"]: r for r in map(checked, rows)}.values())
    return out


def chosen(sources: list[dict], key: str | None = None) -> list[dict]:
    """Enabled sources, or the one of a key even if it isn't enabled."""
    found = [s for s in sources if (s["key"] == key if key else s.get("enabled", True))]
    if key and not found:
        raise ValueError(f"source not known: {key}")
    return found


def excluded(sources: list[dict], keys: list[str]) -> list[str]:
    return sorted({*keys, *(s["key"] for s in sources if not s.get("enabled", True))})


def dictionary(path: str | Path) -> dict:
    """The three word lists of a key word file, in lower case, and its Japanese ``words``: pairs of dictionary form and kind, from
    entries ``form: kind``, or just a form for a noun."""
    data = _yaml(Path(path))
    words = [pair for w in data.get("words") or [] for pair in (w.items() if isinstance(w, dict) else [(str(w), "noun")])]
    return {"words": words} | {k: {str(w).lower() for w in data.get(k) or []} for k in ("ai_keywords", "stopwords_general", "stopwords_extraction")}


def append_words(path: str | Path, words: list[str]) -> list[str]:
    """Add words that aren't there in any case to the end of ai_keywords; comments stay. Returns those added."""
    path = Path(path)
    lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
    known = dictionary(path)["ai_keywords"]
    new = [w for w in dict.fromkeys(x.strip().lower() for x in words) if w and w not in known]
    if not new:
        return []
    head = next((i for i, x in enumerate(lines) if re.match(r"ai_keywords\s*:", x)), None)
    if head is None:
        lines += ["ai_keywords:"]
        head = len(lines) - 1
    at = head + 1
    for i in range(head + 1, len(lines)):
        if re.match(r"\S", lines[i]) and not lines[i].startswith(("#", "-")):
            break
        if re.match(r"\s*-", lines[i]):
            at = i + 1
    lines[at:at] = [f"  - {json.dumps(w, ensure_ascii=False)}" for w in new]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return new


def tag_option(values: list[str]) -> list[str]:
    """Tags of a repeatable option that may hold commas, each once."""
    return list(dict.fromkeys(t.strip() for v in values for t in v.split(",") if t.strip()))
