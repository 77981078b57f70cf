"""Pool-sized water surfaces in map tiles, found, measured and ranked with Spark.

    from cerulea import detections, ranked
    ranked(detections(pixels, scanned).where("shown"))

Names are loaded when they are first used, as workers that run one kernel need none of the others.
"""

from importlib import import_module

_PUBLIC = {
    "functions": ("color", "geo", "text"),
    "operators.detect": ("Limits", "clusters", "detections", "fragments", "merge_pairs", "merged", "parts_of", "ranked", "top", "totals", "visible"),
    "operators.dated": ("as_of",),
    "operators.diff": ("scan_diff",),
    "operators.raster": ("clean", "components", "tile_components", "tile_labels", "water_mask"),
    "plans.cover": ("cover", "estimate", "grid", "serpentine", "spiral"),
    "plans.areas": ("estimates", "hilbert", "located", "ranges"),
    "plans.resume": ("pending",),
    "sinks.mosaic": ("mosaics",),
    "sinks.tiles": ("keep_tiles",),
    "sources.images": ("failed_images", "image_pixels", "kept_failures", "kept_pixels", "not_kept"),
    "streaming.merge": ("keep_merged", "messages", "progress"),
    "streaming.feed": ("changes", "keep_buckets", "keep_ranking", "keep_state", "latest"),
}
__all__ = sorted(name for names in _PUBLIC.values() for name in names)


def __getattr__(name: str):
    for module, names in _PUBLIC.items():
        if name in names:
            return import_module(f"cerulea.functions.{name}") if module == "functions" else getattr(import_module(f"cerulea.{module}"), name)
    raise AttributeError(name)
