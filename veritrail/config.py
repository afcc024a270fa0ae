"""The configuration that tells the engine about a business: its sources, codes, matching, survivorship, events, rules.

The YAML is read once on the driver into frozen values; lookups become literals in Spark expressions.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

# What counts as no value at all.
EMPTY = ("", "nan", "none", "null", "n/a", "na", "-", "--")


def clean_text(value: Any) -> str:
    """White space put in order on the driver: the counterpart of ``functions.text.clean`` for headers and settings."""
    if value is None:
        return ""
    text = " ".join(str(value).replace("﻿", "").split())
    return "" if text.lower() in EMPTY else text


def simple_text(value: Any) -> str:
    """Lower-case ASCII letters and digits, parted by single blanks."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", str(value)) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", bare.lower()))


def header_name(value: Any) -> str:
    return simple_text(clean_text(value)).replace(" ", "_")


@dataclass(frozen=True)
class Codes:
    """A value map: the label of each code, and the code of each known spelling (the last one listed wins)."""

    labels: dict[str, str]
    spellings: dict[str, str]

    @classmethod
    def of(cls, spec: dict | None) -> Codes:
        labels, spellings = {}, {}
        for code, info in (spec or {}).items():
            info = info or {}
            labels[code] = info.get("label", code)
            spellings |= {simple_text(x): code for x in (code, info.get("label"), *info.get("aliases", ())) if x}
        return cls(labels, spellings)


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    aliases: tuple[str, ...] = ()

    @property
    def keys(self) -> set[str]:
        return {header_name(x) for x in (self.name, *self.aliases)}


@dataclass(frozen=True)
class Source:
    name: str
    label: str
    loader: str
    fields: dict[str, Field]
    off: frozenset[str] = frozenset()
    leave: frozenset[str] = frozenset()

    @property
    def named(self) -> bool:
        """Whether its records are about somebody with a name."""
        return any(f.type in ("first_name", "last_name", "person_name") for f in self.fields.values())


@dataclass(frozen=True)
class Config:
    sources: dict[str, Source]
    codes: dict[str, Codes]
    nicknames: dict[str, str]
    identifiers: dict[str, dict]
    anchor: str
    anchor_key: str | None
    strong_keys: tuple[dict, ...]
    support: tuple[str, ...]
    auto: float
    review: float
    golden: dict[str, tuple[str, ...]]
    events: tuple[dict, ...]
    rules: tuple[dict, ...]
    date_order: str = "mdy"
    entity_label: str = "Record"
    credential_label: str | None = None
    equivalents: dict[str, dict[str, str]] = field(default_factory=dict)
    page_field: str = "facility"
    path: str = ""

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}, str(path))

    @classmethod
    def of(cls, raw: dict, path: str = "") -> Config:
        if not raw.get("sources"):
            raise ValueError(f"no sources are defined in {path or 'the configuration'}")
        sources = {}
        for name, spec in raw["sources"].items():
            fields = {
                f: Field(f, (s or {}).get("type", "string"), bool((s or {}).get("required")), tuple((s or {}).get("aliases", ())))
                for f, s in spec.get("fields", {}).items()
            }
            off = frozenset(map(simple_text, spec.get("off_values", ["off"])))
            leave = frozenset(map(simple_text, spec.get("leave_values", [])))
            sources[name] = Source(name, spec.get("label", name), spec.get("loader", ""), fields, off, leave)
        nicknames: dict[str, str] = {}
        for whole, short in (raw.get("nicknames") or {}).items():
            for alias in short:  # the first name that claims a nickname keeps it
                nicknames.setdefault(simple_text(alias), simple_text(whole))
        entity, business = raw.get("entity", {}), raw.get("business", {})
        marked = [k for k, v in raw["sources"].items() if v.get("anchor")]
        thresholds = entity.get("thresholds", {})
        groups = {k: v for k, v in raw.items() if isinstance(v, list) and v and all(isinstance(x, list) for x in v)}
        return cls(
            sources=sources,
            codes={k: Codes.of(v) for k, v in (raw.get("value_maps") or {}).items()},
            nicknames=nicknames,
            identifiers=raw.get("identifiers") or {},
            anchor=entity.get("anchor_source") or (marked or list(sources))[0],
            anchor_key=entity.get("anchor_key"),
            strong_keys=tuple(entity.get("strong_keys", ())),
            support=tuple(entity.get("support_fields", ())),
            auto=float(thresholds.get("auto", 0.9)),
            review=float(thresholds.get("review", 0.75)),
            golden={k: tuple(v) for k, v in (raw.get("golden") or {}).items()},
            events=tuple(raw.get("events") or ()),
            rules=tuple(raw.get("rules") or ()),
            date_order=(raw.get("dates") or {}).get("order", "mdy"),
            entity_label=business.get("entity_label", "Record"),
            credential_label=business.get("credential_label"),
            equivalents={k: {m: group[-1] for group in v for m in group} for k, v in groups.items()},
            page_field=(raw.get("grid") or {}).get("page_field", "facility"),
            path=path,
        )

    def rank(self, source: str) -> int:
        """The order in which sources are linked: the anchor, then the others as listed."""
        return [self.anchor, *(s for s in self.sources if s != self.anchor)].index(source)

    def label(self, source: str) -> str:
        return self.sources[source].label if source in self.sources else source

    def field_type(self, source: str, name: str) -> str:
        f = self.sources[source].fields.get(name) if source in self.sources else None
        return f.type if f else "string"

    @property
    def columns(self) -> dict[str, str]:
        """Every canonical field of every source with its Spark type, strings where sources differ."""
        kinds = {"date": "date", "number": "double"}
        out: dict[str, str] = {}
        for source in self.sources.values():
            for f in source.fields.values():
                kind = kinds.get(f.type, "string")
                out[f.name] = kind if out.get(f.name, kind) == kind else "string"
        return out

    @property
    def expiry_field(self) -> str | None:
        return next((r["field"] for r in self.rules if r.get("type") == "activity_after_expiry"), None)

    @property
    def credential_field(self) -> str | None:
        return next((r.get("id_field") for r in self.rules if r.get("type") == "expiry"), None)

    @property
    def checked_field(self) -> str | None:
        """The field that says when somebody last looked a credential up."""
        return next((r["field"] for r in self.rules if r.get("type") == "stale"), None)
