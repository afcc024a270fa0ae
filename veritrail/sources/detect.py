"""Which source a table is and which of its headers are which fields: decided on the driver, from headers only."""

from __future__ import annotations

from ..config import Config, clean_text, header_name

ACCEPTED = 0.45
#: Shortest alias that may match as a part of a header, or hold one.
LOOSE = 5


def map_headers(cfg: Config, source: str, headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """(field → header, headers left over). Exact aliases are given out first, then looser likenesses."""
    keys = {h: header_name(h) for h in headers}
    free, mapping = list(headers), {}
    fields = cfg.sources[source].fields
    aliases = {n: f.keys for n, f in fields.items()}
    loosely = lambda key, names: bool(key) and any(a in key or key in a for a in names if len(a) >= LOOSE)
    for fits in (lambda h, n: keys[h] in aliases[n], lambda h, n: loosely(keys[h], aliases[n])):
        for name in fields:
            if name not in mapping:
                hit = next((h for h in free if fits(h, name)), None)
                if hit is not None:
                    mapping[name] = hit
                    free.remove(hit)
    return mapping, [h for h in free if clean_text(h)]


def detect_source(cfg: Config, headers: list[str]) -> tuple[str | None, float]:
    """The table source whose fields the headers cover best, required ones counting double; none below ACCEPTED."""
    best, top = None, 0.0
    for name, source in cfg.sources.items():
        if source.loader != "table" or not source.fields:
            continue
        mapping, _ = map_headers(cfg, name, headers)
        required = [n for n, f in source.fields.items() if f.required]
        share = len(mapping) / len(source.fields)
        if required:
            share = (share + sum(n in mapping for n in required) / len(required)) / 2
        if share > top:
            best, top = name, share
    return (best if top >= ACCEPTED else None), top
