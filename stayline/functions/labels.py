"""Churn labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Label bins and campaign groups.
LEVEL_CEILING = 999
BINS_OF_3 = (0, 13, 21, 999)
BINS_OF_4 = (0, 13, 30, 100, 999)
DRAFT_BINS_OF_2 = (5, 20, 999)
DRAFT_BINS_OF_4 = (5, 12, 39, 100, 999)
EARLY_CAMPAIGNS = ("dungeon",)
MID_CAMPAIGNS = ("campaign-web-dev-1", "campaign-game-dev-1", "forest")
LATE_CAMPAIGNS = (
    "campaign-web-dev-2", "campaign-game-dev-2", "desert", "mountain", "glacier",
)


def digitize(value: Column, edges: Sequence[float]) -> Column:
    """Bin index: 0 below the first edge, len(edges) at or above the last."""
    steps = [F.when(value >= edge, 1).otherwise(0) for edge in edges]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return F.when(value.isNotNull(), total)


def level_class(levels: Column, classes: int = 2, threshold: int = 13) -> Column:
    """Class by levels completed; two classes split at the threshold.

    Counts at or above the ceiling form a class of their own.
    """
    bins = {2: (threshold, LEVEL_CEILING), 3: BINS_OF_3, 4: BINS_OF_4}
    if classes not in bins:
        raise ValueError(f"no level bins for {classes} classes")
    return digitize(levels, bins[classes])


def continues(levels: Column, threshold: int) -> Column:
    """Binary label: 1 when the player reaches the threshold."""
    return F.least(level_class(levels, 2, threshold), F.lit(1))


def campaign_class(campaign: Column, classes: int = 2) -> Column:
    early = campaign.isin(*EARLY_CAMPAIGNS)
    mid = campaign.isin(*MID_CAMPAIGNS)
    late = campaign.isin(*LATE_CAMPAIGNS)
    if classes == 2:
        return F.when(early, "early_churn").otherwise("later_churn")
    if classes == 3:
        return F.when(early, "early_churn").when(mid, "mid_churn").otherwise("later_churn")
    if classes == 4:
        return (
            F.when(early, "early_churn").when(mid, "mid_churn")
            .when(late, "later_churn").otherwise("other")
        )
    raise ValueError(f"no campaign groups for {classes} classes")
