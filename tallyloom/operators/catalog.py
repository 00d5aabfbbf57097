"""The metric catalogue: kinds, additivity and the components of ratios. It is bounded by the columns of a table, and lives on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.semantics import ADDITIVE_KINDS, DEFAULT_KIND, KIND_RULES

# Components of the stored ratios, by tab.
P2P_RATIOS = {
    "gross_cpa": ("gross_spend", "ntl"),
    "immediate_roas": ("immediate_raised", "gross_spend"),
    "average_gift": ("immediate_raised", "donors"),
    "donate_rate": ("donors", "recipients"),
    "unsub_rate": ("unsubs", "recipients"),
    "ltv_roas_from_ntl": ("ltv_from_ntl", "gross_spend"),
}
EMAIL_RATIOS = {
    "average": ("raised", "donors"),
    "donate_rate": ("donors", "recipients"),
    "action_rate": ("actions", "recipients"),
    "unsub_rate": ("unsubs", "recipients"),
}


def norm_text(text: str | None) -> str:
    return re.sub(":$", "", re.sub(r"\s+", " ", text or "").strip().lower())


def slug_text(text: str | None) -> str:
    return re.sub("^_|_$", "", re.sub("[^a-z0-9]+", "_", norm_text(text)))


def kind_of(label: str) -> str:
    name = norm_text(label)
    return next((kind for kind, rule in KIND_RULES if re.search(rule, name)), DEFAULT_KIND)


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    kind: str
    column: str | None = None
    numerator: str | None = None
    denominator: str | None = None

    @property
    def additive(self) -> bool:
        return self.kind in ADDITIVE_KINDS

    @property
    def unresolvable(self) -> bool:
        return not self.additive and self.numerator is None


@dataclass
class Catalog:
    metrics: list[Metric] = field(default_factory=list)

    @property
    def additive(self) -> list[Metric]:
        return [m for m in self.metrics if m.additive]

    @property
    def ratios(self) -> list[Metric]:
        return [m for m in self.metrics if not m.additive]

    def keys(self) -> list[str]:
        return [m.key for m in self.metrics]

    def get(self, key: str) -> Metric | None:
        return next((m for m in self.metrics if m.key == key), None)


def by_table(ratios: dict[str, tuple[str, str]]):
    """Components from a fixed table, where both are additive metrics of the table."""
    return lambda key, additive: ratios.get(key) if key in ratios and set(ratios[key]) <= set(additive) else None


def by_name(key: str, additive: list[str]) -> tuple[str, str] | None:
    """Components by the naming of paid media: cost per name is spend over names; a return is what its prefix raised over spend.

    Fixed values: the words by which headers are told.
    """
    spend = next((k for k in additive if "spend" in k), None)
    if re.search("(^|_)cpa$", key):
        names = next((k for k in additive if re.search("ntl|name", k)), None)
        return (spend, names) if spend and names else None
    if m := re.fullmatch("(.+?)_?roas", key):
        raised = next((k for k in additive if k.startswith(m[1]) and "rais" in k), None)
        return (raised, spend) if raised and spend else None
    return None


def catalog(headers: list[tuple[str, str | None]], components, ratios: bool = True) -> Catalog:
    """From (label, column letter) in order. Labels of one slug get a suffix, so that no metric hides another."""
    seen: dict[str, int] = {}
    named = []
    for label, column in headers:
        key = slug_text(label)
        seen[key] = seen.get(key, 0) + 1
        named.append((key if seen[key] == 1 else f"{key}_{seen[key]}", label.strip(), kind_of(label), column))
    additive = [key for key, _, kind, _ in named if kind in ADDITIVE_KINDS]
    out = []
    for key, label, kind, column in named:
        parts = (components(key, additive) if ratios and kind not in ADDITIVE_KINDS else None) or (None, None)
        out.append(Metric(key, label, kind, column, *parts))
    return Catalog(out)


def accumulated(cat: Catalog, wanted: list[str], fallback: bool = False) -> tuple[list[str], str | None]:
    """Metrics of the running totals: those wanted that exist; with fallback, filled from the first three additive ones, and a warning."""
    have = [k for k in wanted if cat.get(k)]
    if len(have) >= len(wanted) or not fallback:
        return have, None
    first = cat.additive[:3]
    text = "Running totals take " + ", ".join(m.label for m in first) + " instead."
    while len(have) < min(3, len(first)) and first[len(have)].key not in have:
        have.append(first[len(have)].key)
    return have, text
