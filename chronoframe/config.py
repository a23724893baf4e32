"""Engine settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Thresholds and windows; seconds unless said otherwise."""

    sample_interval: float = 1.0
    min_keyframe_gap: float = 0.5
    text_similarity: float = 0.85
    flicker_similarity: float = 0.90
    flicker_reach: int = 3
    pixel_change: float = 0.80
    pixel_delta: int = 15
    thumb_size: tuple[int, int] = (320, 240)
    audio_half_window: float = 5.0
    audio_rate: int = 16_000
    chunk_buffer: float = 2.5
    embedding_dims: int = 3072
    edge_similarity: float = 0.5
    temporal_decay: float = 0.9
    max_temporal_distance: int = 10
    context_window: int = 3
    retrieval_context_window: int = 2
    similarity_weight: float = 0.7
    importance_weight: float = 0.3
    default_importance: float = 0.5
    over_fetch: int = 2
    text_limit: int = 400
    audio_limit: int = 250
    damping: float = 0.85
    #: Reports that count labels which the gate never emits (text and initial counts are 0) instead of those it does.
    compat_labels: bool = False
    #: Vector metadata with an empty audio text instead of the audio text.
    compat_audio: bool = False


DEFAULTS = Settings()
