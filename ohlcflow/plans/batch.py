"""R2: batch scan — many recipes over one snapshot in a single job.

A short list of recipes (configuration the user wrote) becomes conditional
literals in one projection: every snapshot row carries the array of recipe
names it satisfies, and ``explode`` yields (recipe, symbol) rows.  No join, no
pairs: the per-row work is one comparison chain per recipe and only matches
are emitted.  A list longer than ``LITERAL_RECIPES`` is handled as a recipe
table by the predicate index (``recipe_index``), whose expressions do not grow
with the recipes.  Indicators are the union over all recipes, so the bars are
framed and shuffled once no matter how many recipes run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators.series import Framed
from ..schema import RECIPE_SCHEMA
from . import predicates as P
from .recipe_index import CRITERIA, batch_scan_table
from .spec import ScanSpec

#: Recipes up to which a list is planned as literals.
LITERAL_RECIPES = 16


def recipes_from_rows(rows) -> list[tuple[str, ScanSpec]]:
    """Recipe table rows (recipe, min_price, ..., trend_template) -> specs; NULL = not applied."""
    out = []
    for r in rows:
        d = r.asDict() if hasattr(r, "asDict") else dict(r)
        name = d.pop("recipe")
        out.append((name, ScanSpec.from_map({k: v for k, v in d.items() if v is not None})))
    return out


def batch_scan(bars: DataFrame, recipes: list[tuple[str, ScanSpec]], *, plan: str = "snapshot") -> DataFrame:
    """(recipe, symbol, date, close, volume) for every recipe match on the latest bars."""
    if plan == "snapshot" and len(recipes) > LITERAL_RECIPES:
        rows = [(name, *[getattr(spec, c) for c in CRITERIA]) for name, spec in dict(recipes).items()]
        return batch_scan_table(bars, bars.sparkSession.createDataFrame(rows, RECIPE_SCHEMA))
    preds = {name: spec.predicates() for name, spec in recipes}
    inds = P.required_indicators(p for ps in preds.values() for p in ps)
    if not inds:
        inds = [I.shifted("close", 1, "_unused_prev_close")]
    snap = I.snapshot_with(bars, inds) if plan == "snapshot" else None
    if snap is None:
        fr = I.frame_with(bars, inds, latest=(plan == "snapshot"))
        snap = fr.finish(fr.df.where(Framed.is_latest()))
    hits = [F.when(F.coalesce(P.all_of(ps).condition, F.lit(False)), F.lit(name))
            for name, ps in preds.items()]
    matched = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return (snap.select("symbol", "date", "close", "volume", F.explode(matched).alias("recipe"))
                .select("recipe", "symbol", "date", "close", "volume"))
