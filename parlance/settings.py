"""Thresholds that are part of the results, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass

CLOCK = 24_000  # samples a second


@dataclass(frozen=True)
class Settings:
    min_clip_s: float = 20.0
    target_clip_s: float = 40.0
    max_clip_s: float = 50.0
    max_overlap: float = 0.20
    warn_overlap: float = 0.05
    max_silence: float = 0.80
    min_speaker_s: float = 1.0
    min_speaker_share: float = 0.02
    context_s: float = 0.25
    plan_min: int = 20 * CLOCK
    plan_max: int = 100 * CLOCK
    plan_context: int = 6_000
    safe_pause: int = 6_000
    word_guard: int = 960
    suspect_logprob: float = -0.50
    min_word_rate: float = 0.35
    max_word_rate: float = 6.0
    max_ngrams: int = 3
    max_disagreement: float = 0.25
    low_score: float = 0.40
    assign_overlap: float = 0.5
    short_turn_s: float = 0.35
    gap_samples: int = 12_000
    identity_similarity: float = 0.65
    identity_margin: float = 0.10
    enrol_s: float = 30.0
    enrol_turn_s: float = 1.5
    channel_silence: float = 0.995
    clipping_review: float = 0.001
    clipping_reject: float = 0.01
    leakage_review: float = 0.25
    low_confidence_review: float = 0.10
    low_confidence_reject: float = 0.35
    uncertain_review: float = 0.05
    uncertain_reject: float = 0.15

    def __post_init__(self) -> None:
        assert self.min_clip_s <= self.target_clip_s <= self.max_clip_s
        assert 0 <= self.warn_overlap <= self.max_overlap <= 1 and 0 <= self.max_silence <= 1
        assert 0 < self.plan_min <= self.plan_max


DEFAULT = Settings()
