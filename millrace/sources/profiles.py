"""Skill profiles from parsed configuration."""

from __future__ import annotations

from millrace.operators.score import Variant


def variants(config: dict | None) -> list[Variant] | None:
    """Variants of ``{'cvs': {name: {'skills': [..] or {skill: weight}}}}``; those without skills are skipped; None if none is usable."""
    found = []
    for name, entry in ((config or {}).get("cvs") or {}).items():
        skills = entry.get("skills") if isinstance(entry, dict) else None
        if isinstance(skills, list):
            skills = {str(s): 1.0 for s in skills}
        if isinstance(skills, dict) and (kept := {str(k): float(v) if isinstance(v, int | float) else 1.0 for k, v in skills.items() if str(k).strip()}):
            found.append(Variant(str(name), kept))
    return found or None


def from_cache(config: dict | None, cache: dict | None) -> list[Variant] | None:
    """The configured variants, or else those of a cached keyword file of the same shape."""
    return variants(config) or variants(cache)
