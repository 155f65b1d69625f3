"""Query registry.  ``load_all`` imports every module that registers queries."""

from importlib import import_module

MODULES = ("fragments", "ingest", "scoring", "thresholds", "fusion", "selection", "review", "evaluation", "prep", "features",
           "images", "models", "streams", "experiments")


def load_all() -> None:
    """Import in order: later modules build on the fragments of earlier ones."""
    for name in MODULES:
        import_module(f"outlane.plans.{name}")
