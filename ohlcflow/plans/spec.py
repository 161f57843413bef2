"""Declarative scan criteria ("recipes").

``ScanSpec`` holds the criteria keys of a scan.  ``merge`` applies the
screener's precedence: a value counts as given only if it differs from the
default, then the recipe fills what was not given.  Consequences kept on
purpose: ``trend_template=False`` cannot switch off a recipe's ``True`` and
``sort="symbol"`` cannot override a recipe's sort.  ``to_map`` drops None
values and keeps False.  Unknown keys in a map are ignored.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from . import predicates as P

NUMERIC_KEYS = ("min_price", "min_volume", "min_relative_volume", "min_adr", "gap_up")
KEYS = NUMERIC_KEYS + ("trend_template", "sort")
DEFAULT_SORT = "symbol"


@dataclass(frozen=True)
class ScanSpec:
    min_price: float | None = None
    min_volume: float | None = None
    min_relative_volume: float | None = None
    min_adr: float | None = None
    gap_up: float | None = None
    trend_template: bool = False
    sort: str = DEFAULT_SORT

    @classmethod
    def from_map(cls, m: dict | None) -> "ScanSpec":
        m = dict(m or {})
        kw = {k: m[k] for k in KEYS if k in m and m[k] is not None}
        for k in NUMERIC_KEYS:
            if k in kw:
                kw[k] = float(kw[k])
        if "trend_template" in kw:
            kw["trend_template"] = bool(kw["trend_template"])
        return cls(**kw)

    def merge(self, recipe: dict | None) -> "ScanSpec":
        """Explicit (non-default) values win, then the recipe, then defaults."""
        r = dict(recipe or {})
        upd = {}
        for k in NUMERIC_KEYS:
            if getattr(self, k) is None and k in r and r[k] is not None:
                upd[k] = float(r[k])
        if self.trend_template is False and bool(r.get("trend_template", False)):
            upd["trend_template"] = True
        if self.sort == DEFAULT_SORT and "sort" in r and r["sort"] is not None:
            upd["sort"] = str(r["sort"])
        return replace(self, **upd)

    def to_map(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}

    def predicates(self) -> list:
        """the filters switched on by this spec, in the screener's order."""
        preds = []
        if self.min_price is not None:
            preds.append(P.min_price(self.min_price))
        if self.min_volume is not None:
            preds.append(P.min_volume(self.min_volume))
        if self.min_relative_volume is not None:
            preds.append(P.min_rvol(self.min_relative_volume))
        if self.min_adr is not None:
            preds.append(P.min_adr(self.min_adr))
        if self.gap_up is not None:
            preds.append(P.gap_up(self.gap_up))
        if self.trend_template:
            preds.append(P.trend_template())
        return preds


def parse_recipe_text(text: str) -> dict:
    """Flat ``key: value`` recipe text (the YAML subset the recipes use)."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line or ":" not in line:
            continue
        k, v = (s.strip() for s in line.split(":", 1))
        low = v.lower()
        if low in ("true", "false"):
            out[k] = low == "true"
        elif low in ("null", "~", ""):
            out[k] = None
        else:
            try:
                out[k] = float(v) if any(ch in v for ch in ".eE") else int(v)
            except ValueError:
                out[k] = v.strip("'\"")
    return out


def recipe_text(spec: ScanSpec) -> str:
    return "".join(f"{k}: {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in spec.to_map().items())
