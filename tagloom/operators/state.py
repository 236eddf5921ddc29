"""What parallel branches found, put together; sheet regions; progress of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Regions of a sheet where none were measured: label, ymin, xmin, ymax, xmax.
REGIONS = [("B5", 0.1, 0.3, 0.5, 0.6), ("C9", 0.2, 0.6, 0.6, 0.9), ("F3", 0.5, 0.1, 0.8, 0.4), ("Notes", 0.7, 0.0, 1.0, 0.3), ("TitleBlock", 0.8, 0.7, 1.0, 1.0)]
# Share done when a step ends.
STEPS = {"ingest": 0.15, "context_loader": 0.25, "supervisor": 0.35, "text_recognition": 0.50, "symbol_recognition": 0.62, "pipeline_recognition": 0.70, "compiler": 0.78, "validation": 0.85, "completeness": 0.90, "re_extractor": 0.93, "output_generator": 0.98}


def merge(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables by name: those of both sides are appended, columns that one side lacks are null."""
    return left | {k: left[k].unionByName(t, allowMissingColumns=True) if k in left else t for k, t in right.items()}


def merge_maps(left: Column, right: Column) -> Column:
    """The keys of both; the right side's value wins, even if null."""
    empty = F.create_map().cast("map<string,string>")
    l, r = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(l, lambda k, _: ~F.map_contains_key(r, k)), r)


def region(y: Column, x: Column) -> Column:
    """The first region that a point lies in; null outside all."""
    return F.coalesce(*[F.when(y.between(y0, y1) & x.between(x0, x1), F.lit(n)) for n, y0, x0, y1, x1 in REGIONS])


def progress(step: Column) -> Column:
    """The share of a run that is done when a step ends; 0.50 for a step that isn't known."""
    return F.coalesce(*[F.when(step == s, p) for s, p in STEPS.items()], F.lit(0.50))
