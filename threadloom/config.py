"""Thresholds, weights and fixed lists of the analytics, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

# They must be these for results to agree.
AFFECTION_MARKERS = ("❤️", "❤", "💕", "😘", "🥰", "miluju", "miláčku", "zlatíčko", "love you")
NEGATIVE_MARKERS = ("nesnáším", "naštvan", "štve mě", "vadí mi", "zklaman", "lhát", "lžeš", "nech mě", "fuck", "hate", "angry")
STOPWORDS_CS = (
    "a", "i", "ale", "že", "se", "si", "to", "je", "jsem", "jsme", "jsi",
    "jste", "na", "do", "v", "ve", "z", "ze", "s", "za", "pro", "od", "o",
    "u", "k", "ke", "co", "jak", "tak", "už", "jen", "ne", "ano", "jo", "no",
    "ten", "ta", "ty", "mi", "mě", "ti", "tě", "ho", "ji", "mu", "nám", "vám",
    "oni", "ona", "on",
)
STOPWORDS_EN = (
    "the", "and", "or", "but", "a", "an", "to", "of", "in", "on", "for", "with",
    "is", "are", "was", "were", "be", "been", "it", "this", "that", "i", "you",
    "we", "he", "she", "they", "my", "your", "our", "do", "did", "not", "yes",
    "no",
)
STOPWORDS = tuple(sorted({*STOPWORDS_CS, *STOPWORDS_EN}))


@dataclass(frozen=True)
class Config:
    session_gap_seconds: int = 6 * 3600
    duplicate_tolerance_seconds: int = 2
    reply_types: tuple[str, ...] = ("reply", "reply_to")

    rapid_seconds: int = 300
    responsiveness_seconds: int = 6 * 3600
    post_silence_seconds: int = 18 * 3600
    long_silence_seconds: int = 24 * 3600
    night_start: int = 0
    night_end: int = 6
    conflict_threshold: float = 0.55

    change_window: int = 28
    change_min_history: int = 7
    change_z: float = 2.5
    regime_min_history: int = 4
    regime_signal: float = 10.0
    regime_clip: float = 2.5
    weekly_trend_periods: int = 8
    monthly_trend_periods: int = 6
    trend_min_periods: int = 4
    trend_slope: float = 0.05

    topic_min_df: int = 3
    topic_max_ratio: float = 1.0
    topic_min_token: int = 2
    topic_min_n: int = 1
    topic_max_n: int = 3
    topic_top: int = 50

    affection_markers: tuple[str, ...] = AFFECTION_MARKERS
    negative_markers: tuple[str, ...] = NEGATIVE_MARKERS
    stopwords: tuple[str, ...] = STOPWORDS

    #: activity, initiation, responsiveness, questions, affection
    engagement_weights: tuple[float, ...] = (0.25, 0.20, 0.25, 0.15, 0.15)
    #: negative, rapid, exclamation, silence afterwards
    conflict_weights: tuple[float, ...] = (0.45, 0.25, 0.15, 0.15)
    #: activity, initiation, responsiveness, effort, questions, affection
    regime_weights: tuple[float, ...] = (0.25, 0.20, 0.20, 0.15, 0.10, 0.10)

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int | float) and not isinstance(value, bool) and value < 0:
                raise ValueError(f"{f.name} must not be negative")
        if not 0 <= self.night_start <= 23 or not 0 <= self.night_end <= 23:
            raise ValueError("hours lie between 0 and 23")
        if not 0 <= self.conflict_threshold <= 1 or not 0 < self.topic_max_ratio <= 1:
            raise ValueError("shares lie between 0 and 1")
        if self.change_min_history < 2 or self.change_window < self.change_min_history:
            raise ValueError("the window of change points holds their least history, which is 2 at least")
        if min(self.trend_min_periods, self.weekly_trend_periods, self.monthly_trend_periods) < 2:
            raise ValueError("a trend needs two periods")
        if not 1 <= self.topic_min_n <= self.topic_max_n or self.topic_top < 1:
            raise ValueError("topics have one word at least")
        if any(not m for m in (*self.affection_markers, *self.negative_markers)):
            raise ValueError("a marker must not be empty")
        for name in ("engagement_weights", "conflict_weights", "regime_weights"):
            if not math.isclose(sum(getattr(self, name)), 1.0, abs_tol=1e-9):
                raise ValueError(f"{name} must sum to 1")


DEFAULT = Config()
