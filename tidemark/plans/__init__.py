"""Registered queries, one module per section."""

from importlib import import_module

MODULES = ("q_metrics", "q_features", "q_quality", "q_conversion", "q_lifecycle",
           "q_targeting", "q_series", "q_models")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")
