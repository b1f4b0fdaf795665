"""Settings of the plan from a YAML file."""

from typing import Any

from ..plans.text_to_table import Options


def read(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:  # optional
        raise RuntimeError("reading YAML needs the package yaml") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


#: Where the file has what the plan's options need.
PLACES = {
    "regime": ("table_assembly", "regime"),
    "theta": ("chunking", "theta"),
    "least": ("chunking", "min_sentences"),
    "most": ("chunking", "max_sentences"),
    "delta": ("clustering", "delta"),
    "most_clusters": ("clustering", "max_k"),
    "least_clusters": ("clustering", "min_k"),
    "seed": ("clustering", "random_state"),
    "samples": ("insight_generation", "self_consistency_m"),
}


def options(settings: dict[str, Any], **more: Any) -> Options:
    """Options from the settings; what they lack keeps its default, and ``more`` overrides."""
    found = {name: settings[a][b] for name, (a, b) in PLACES.items() if b in (settings.get(a) or {})}
    return Options(**(found | more))
