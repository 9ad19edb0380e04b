"""Settings of a run: defaults, presets, and overrides. A driver-side record, never a table."""

from __future__ import annotations

import platform
from dataclasses import dataclass, field, replace

from .schema import ACTIONS, CATEGORIES

PRESETS = {
    "fast": {"sample_seconds": 2.0, "hit_fraction": 0.6, "frame_threshold": 0.75, "snap": False, "density": False, "llm": False, "vlm": False, "audio": False, "stt_model": "base", "stt_words": False, "min_streak": 3, "encoder": "auto", "quality": 23},
    "balanced": {"sample_seconds": 1.0, "hit_fraction": 0.5, "frame_threshold": 0.7, "snap": True, "density": True, "llm": False, "vlm": False, "audio": False, "stt_model": "small", "stt_words": True, "min_streak": 3, "encoder": "auto", "quality": 20},
    "thorough": {"sample_seconds": 0.5, "hit_fraction": 0.45, "frame_threshold": 0.65, "snap": True, "density": True, "llm": True, "vlm": True, "audio": True, "stt_model": "large-v3", "stt_words": True, "min_streak": 3, "encoder": "libx264", "quality": 18},
}


def _default_actions() -> dict[str, str]:
    return {"profanity": "mute", "drugs": "mute", "sex": "mute", "violence": "keep", "nudity": "cut"}


@dataclass(frozen=True)
class Settings:
    enabled: frozenset[str] = frozenset(CATEGORIES) - {"violence"}
    actions: dict[str, str] = field(default_factory=_default_actions)
    pad: float = 0.15
    merge_gap: float = 0.5
    context_window: float = 30.0
    sample_seconds: float = 1.0
    min_streak: int = 3
    hit_fraction: float = 0.5
    frame_threshold: float = 0.7
    snap: bool = True
    density: bool = True
    density_window: float = 60.0
    density_events: int = 3
    density_span: float = 8.0
    llm: bool = False
    llm_confidence: float = 0.6
    vlm: bool = False
    vlm_mode: str = "silent+gaps"
    vlm_confidence: float = 0.55
    vlm_radius: float = 30.0
    audio: bool = False
    audio_threshold: float = 0.45
    audio_clip: float = 8.0
    audio_skip_violence: bool = True
    corroborate: bool = True
    corroborate_radius: float = 5.0
    stt_model: str = "large-v3"
    stt_words: bool = True
    scene_threshold: float = 27.0
    encoder: str = "auto"
    quality: int = 20

    def preset(self, name: str) -> Settings:
        """The preset's values over these."""
        if name not in PRESETS:
            raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
        return replace(self, **PRESETS[name])

    def resolved_encoder(self) -> str:
        """The encoder named, or the one that this machine has."""
        return self.encoder if self.encoder != "auto" else "videotoolbox" if platform.system() == "Darwin" else "libx264"

    def with_actions(self, pairs: list[str]) -> Settings:
        """Overrides like 'drugs=cut'."""
        found = dict(self.actions)
        for pair in pairs:
            category, _, action = pair.partition("=")
            if category not in CATEGORIES or action not in ACTIONS:
                raise ValueError(f"{pair!r} isn't CATEGORY=ACTION of {', '.join(CATEGORIES)} and {', '.join(ACTIONS)}")
            found[category] = action
        return replace(self, actions=found)
