"""Settings with defaults and the migration of older records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Tuning:
    """Per-model search parameters. The defaults."""

    top_k: int = 10
    min_score: float = 0.5
    score_window: float = 0.14
    folder_path_boost: float = 0.06
    semantic_highlights: bool = True
    highlight_result_min_score: float = 0.55
    highlight_single_word_min_score: float = 0.62
    highlight_phrase_min_score: float = 0.56
    highlight_max_phrases: int = 3


@dataclass(frozen=True)
class Settings:
    """The defaults."""

    enabled: bool = True
    folder_path_boost_enabled: bool = True
    allow_external_image_thumbnails: bool = False
    show_wikilinks: bool = True
    graph_k: int = 5
    graph_max_edges: int = 2000
    verbose: bool = False
    tuning: Tuning = field(default_factory=Tuning)


def load_settings(stored: dict[str, Any] | None) -> Settings:
    """Defaults, then what is stored. Tuning may stand at the top level (oldest
    records), under ``mobile``, or under ``bge``; later places win."""
    stored = stored or {}
    known = {f.name for f in fields(Tuning)}
    tweaks = stored.get("model_tweaks") or {}
    tuning: dict[str, Any] = asdict(Tuning())
    for place in (stored, tweaks.get("mobile") or {}, tweaks.get("bge") or {}):
        tuning |= {k: v for k, v in place.items() if k in known}
    own = {f.name: stored.get(f.name, f.default) for f in fields(Settings) if f.name != "tuning"}
    return Settings(**own, tuning=Tuning(**tuning))
