"""Prompts: built once per profile on the driver, with the item's own text appended in the JVM. Wording is our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.operators.route import score_ranges

# Limits of what a prompt quotes.
SINGLE_CHARS, GROUP_CHARS = 30_000, 15_000
MOST_PRIORITIES, MOST_MUST, MOST_VALUED, MOST_AVOID = 7, 4, 4, 3


def _names(profile: dict) -> list[str]:
    return [c["name"] for c in profile.get("categories") or []]


def _listed(title: str, lines: list[str], most: int | None = None) -> str:
    lines = [x for x in lines if x][:most]
    return "\n".join([f"{title}:", *(f"- {x}" for x in lines)]) if lines else ""


def score_rule(profile: dict) -> str:
    """Which category each score stands for, from the thresholds; '' without thresholds."""
    limits = profile.get("thresholds") or {}
    if not limits:
        return ""
    parts = []
    for k, (name, low, high) in enumerate(score_ranges(limits)):
        parts.append(f"{low} or more: {name}" if k == 0 else f"{low}: {name}" if low == high else f"{low} to {high}: {name}")
    lowest = min(limits.values())
    others = [n for n in _names(profile) if n not in limits and n != "Ignore"]
    if lowest > 1:
        parts.append(f"{lowest - 1} or less: {others[0] if others else profile.get('default_category', 'Review')}")
    return "Score and category must agree (" + "; ".join(parts) + ")."


def sections(profile: dict) -> list[str]:
    """The parts of a profile that every prompt has, in order; empty parts are left out."""
    good, bad = profile.get("positive_criteria") or {}, profile.get("negative_criteria") or {}
    rubric = profile.get("scoring_rubric") or {}
    parts = [
        f"Profile {profile.get('name', '')}: {profile.get('description', '')}".strip(),
        _listed("Categories", [f"{c['name']}: {c.get('description') or ''}".rstrip(": ") for c in profile.get("categories") or []]),
        _listed("What matters most", profile.get("top_priorities") or [], MOST_PRIORITIES),
        _listed("Required", good.get("must_have") or [], MOST_MUST),
        _listed("Valued", good.get("highly_valued") or [], MOST_VALUED),
        _listed("To avoid", [x for v in bad.values() for x in v or []], MOST_AVOID),
        _listed("Guidance", profile.get("specific_guidance") or []),
        _listed("Scores", [f"{k}: {rubric[k]}" for k in sorted(rubric, reverse=True)]),
        _listed("Rate each from 1 to 5", [d["name"] for d in profile.get("dimensions") or []]),
        score_rule(profile),
    ]
    return [p for p in parts if p]


def head(profile: dict, kind: str, members: int | None = None) -> str:
    """Everything before the item. kind: image, video, audio, document, bundle."""
    task = f"Judge this {kind}." if members is None else f"Judge these {members} items of one {kind} group against each other and rank them."
    form = "Answer with a JSON " + ("object" if members is None else f"list of {members} objects") + " with classification, score and reasoning."
    return "\n\n".join([task, *sections(profile), form])


def group_prompt(profile: dict, kind: str, members: Column, lines: Column) -> Column:
    """One prompt per chunk of a group; ``members`` is its size, ``lines`` its members, one after another."""
    before, between, after = head(profile, kind, -1).split("-1")
    n = members.cast("string")
    return F.concat(F.lit(before), n, F.lit(between), n, F.lit(after), F.lit("\n\n"), lines)


def item_prompt(profile: dict, kind: str, name: Column, text: Column | None = None) -> Column:
    """One prompt per row; the text is cut at SINGLE_CHARS and marked."""
    parts = [F.lit(head(profile, kind)), F.concat(F.lit("Item: "), name)]
    if text is not None:
        cut = F.when(F.length(text) > SINGLE_CHARS, F.concat(F.substring(text, 1, SINGLE_CHARS), F.lit("\n[cut]"))).otherwise(text)
        parts.append(F.coalesce(cut, F.lit("")))
    return F.concat_ws("\n\n", *parts)


def sibling_line(siblings: Column, most: int = 5) -> Column:
    """The first ``most`` classifications of a burst's other members, and how many more there are."""
    shown = F.array_join(F.slice(siblings, 1, most), ", ")
    more = F.size(siblings) - most
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def correction_line(name: Column, was: Column, now: Column, dims: Column) -> Column:
    """name: was -> now (a=1, b=2); nulls among the dimensions are dropped."""
    known = F.map_filter(dims, lambda k, v: v.isNotNull())
    pairs = F.array_join(F.transform(F.map_entries(known), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    tail = F.when(F.size(known) > 0, F.concat(F.lit(" ("), pairs, F.lit(")"))).otherwise("")
    return F.concat(name, F.lit(": "), was, F.lit(" -> "), now, tail)
