"""Job settings with their defaults; override fields with `dataclasses.replace`."""

from __future__ import annotations

from dataclasses import dataclass, field

from keepsift import constants as K


def _general() -> dict[str, float]:
    return dict(zip(K.DIMENSIONS, K.GENRE_PRESETS["general"]))


@dataclass(frozen=True)
class Settings:
    input_folder: str = ""
    output_folder: str = ""
    num_to_select: int = 20
    genre: str = "general"
    weights: dict[str, float] = field(default_factory=_general)
    active_profile_id: str | None = None
    preference_text: str = ""
    provider: str = "claude"
    base_url: str = ""
    model: str = "claude-sonnet-4-6"
    concurrency: int = 5
    extension_filter: tuple[str, ...] = ()
    prefix_filter: tuple[str, ...] = ()
    prefix_any_case: bool = True
    ignore_patterns: tuple[str, ...] = ()
    disable_duplicate_grouping: bool = False
    duplicate_threshold: int = K.DEFAULT_DUPLICATE_THRESHOLD
    max_faces_per_image: int = 0
    export_mode: str = "copyToOutput"
    enable_sidecars: bool = False
    shortfall_strategy: str = "stop"
    process_subfolders: bool = False
    preserve_subfolders: bool = False
    enable_auto_tagging: bool = False
    tag_top_percent: int = K.TAG_TOP_PERCENT
    dry_run: bool = False
    cache_max_gb: int = 5
    cache_max_days: int = 30
    disable_cache: bool = False
    use_embedded_preview: bool = True

    @property
    def tier_scope(self) -> tuple[str, ...]:
        """Sub-folders that are mirrored get tiers of their own."""
        return ("folder",) if self.process_subfolders and self.preserve_subfolders else ()
