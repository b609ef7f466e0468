"""Decisions on classifier scores and sharpness. Nulls mean "not computed" and compare as false."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: blur scores up to this are soft where no slider is set.
SOFT = 100.0
BANDS = ("likely", "unsure", "clean", "unchecked")


@dataclass(frozen=True)
class Rule:
    """Thresholds on the score of the whole frame and on the mean of its tiles."""

    whole_flag: float = 0.85
    tile_mean_flag: float = 0.50
    unsure: float = 0.45

    def sanitised(self) -> Rule:
        clamp = lambda x, lo, hi: min(max(x, lo), hi)
        whole = clamp(self.whole_flag, 0.05, 1.0)
        return replace(self, whole_flag=whole, tile_mean_flag=clamp(self.tile_mean_flag, 0.05, 1.0), unsure=clamp(self.unsure, 0.01, whole))

    @property
    def sensitivity(self) -> str:
        return next((name for name, rule in PRESETS.items() if rule == self), "custom")

    def is_explicit(self, whole: Column, tile: Column) -> Column:
        return F.coalesce(whole >= self.whole_flag, F.lit(False)) | F.coalesce(tile >= self.tile_mean_flag, F.lit(False))

    def is_unsure(self, whole: Column, tile: Column) -> Column:
        return ~self.is_explicit(whole, tile) & F.coalesce(whole >= self.unsure, F.lit(False))

    def display_score(self, whole: Column, tile: Column) -> Column:
        """The score the decision rests on: the tiles' where they flag and are above the frame's."""
        return F.when(F.coalesce((tile >= self.tile_mean_flag) & (tile > whole), F.lit(False)), tile).otherwise(whole)

    def band(self, whole: Column, tile: Column) -> Column:
        return F.when(whole.isNull(), "unchecked").when(self.is_explicit(whole, tile), "likely").when(self.is_unsure(whole, tile), "unsure").otherwise("clean")

    def evidence(self, whole: Column, tile: Column) -> Column:
        """Which rule fired, in words."""
        return (
            F.when(whole.isNull(), F.lit("not scored"))
            .when(tile.isNull(), F.format_string(f"whole frame %.2f (flag {self.whole_flag:.2f})", whole))
            .when(tile >= self.tile_mean_flag, F.format_string(f"tiles %.2f flagged (flag {self.tile_mean_flag:.2f}), whole frame %.2f", tile, whole))
            .otherwise(F.format_string(f"whole frame %.2f (flag {self.whole_flag:.2f}), tiles %.2f (flag {self.tile_mean_flag:.2f})", whole, tile))
        )


#: The presets of sensitivity.
PRESETS = {
    "cautious": Rule(0.95, 0.65, 0.60),
    "balanced": Rule(0.85, 0.50, 0.45),
    "eager": Rule(0.70, 0.50, 0.30),
}


def is_soft(blur: Column, slider: float = 0.0) -> Column:
    return F.coalesce(blur <= (slider if slider > 0 else SOFT), F.lit(False))


def covers(kinds: Column, enabled: int) -> Column:
    """Whether a mask of checked kinds has all enabled ones."""
    return kinds.bitwiseAND(enabled) == enabled


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, over an array of doubles."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
