"""Scalar (row-level) feature expressions, F1-F34.

Each builder returns ordered ``{name: Column}`` levels; a level only refers to
columns of earlier levels so one ``withColumns`` per level is enough.  No UDF
is involved: everything compiles into one whole-stage-codegen projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.exprs import flag, safe_div
from panelcast.spec import PITCH_SHARES

c = F.col


def _age_level() -> dict[str, Column]:
    return {
        "age_squared": c("age") * c("age"),
        "is_prime_age": flag((c("age") >= 27) & (c("age") <= 31)),
        "is_young": flag(c("age") < 27),
        "is_veteran": flag(c("age") > 31),
        "age_from_peak": F.abs(c("age") - 29),
    }


def current_levels() -> list[dict[str, Column]]:
    """Feature formulas of the current ingest (``variant='current'``)."""
    ip, so, bb = c("total_innings_pitched"), c("total_strikeouts"), c("total_walks")
    k9 = c("k_per_9")
    level1 = _age_level()
    level1.update({
        "k_minus_bb_pct": c("strike_percentage") - safe_div(bb, ip * 3) * 100,
        "contact_quality": c("hard_pct") + c("barrel_pct"),
        "whiff_rate": c("swstr_pct"),
        "zone_contact_diff": 100 - c("contact_pct"),
        "true_outcomes_pct": safe_div(so + bb + c("hr_per_9") * ip / 9, ip * 3) * 100,
        "k_to_contact_ratio": safe_div(so, ip * 3 - so),
        "k_upside": k9 * c("swstr_pct") / 100,
        "pitch_efficiency": safe_div(ip, c("total_pitches")) * 100,
        "power_index": k9 * (1 - c("hard_pct") / 100),
        "consistency_score": safe_div(F.lit(1.0), c("season_whip") * c("season_era")),
        "is_ace": flag((k9 >= 9.5) & (ip >= 150)),
        "is_high_k_pitcher": flag(k9 >= 10.0),
        "is_workhorse": flag(ip >= 180),
        "log_total_strikeouts": F.log1p(so),
        "is_starter": flag((c("games_started") > 15) | (safe_div(ip, c("games_pitched")) > 4)),
    })
    level2 = {
        "is_reliever": flag(c("is_starter") == 0),
        "k9_x_starter": k9 * c("is_starter"),
        "swstr_x_starter": c("swstr_pct") * c("is_starter"),
        "ip_x_starter": ip * c("is_starter"),
        "swstr_x_ip": c("swstr_pct") * ip,
        "k9_x_era": k9 * c("season_era"),
        "age_x_ip": c("age") * ip,
        "stuff_x_command": c("stuff_plus") * c("command_plus"),
        "workload_stress": safe_div(c("total_pitches"), c("age")),
    }
    return [level1, level2]


def extended_levels() -> list[dict[str, Column]]:
    """Formulas of the archived multi-season generation (``variant='extended'``).

    Same names, different definitions; the constant strike share and the
    ``replace(0, 1)`` walk denominator are part of that generation.
    """
    ip, so, bb = c("total_innings_pitched"), c("total_strikeouts"), c("total_walks")
    k9 = c("k_per_9")
    level1 = _age_level()
    level1.update({
        "k_bb_ratio": so / F.when(bb == 0, F.lit(1)).otherwise(bb),
        "strike_percentage": F.lit(0.65),
        "pitch_efficiency": safe_div(ip, c("games_pitched")),
        "k_minus_bb_pct": safe_div(so - bb, ip),
        "contact_quality": c("hard_pct") / 100,
        "whiff_rate": c("swstr_pct") / 100,
        "k_to_contact_ratio": safe_div(so, ip * 3),
        "k_upside": k9 * ip / 100,
        "power_index": k9 * c("swstr_pct") / 100,
        "consistency_score": 100 - c("bb_per_9") * 10,
        "zone_contact_diff": c("zone_pct") - c("contact_pct"),
        "true_outcomes_pct": safe_div(so + bb, ip * 3),
        "is_ace": flag((k9 >= 9.5) & (ip >= 150)),
        "is_high_k_pitcher": flag(k9 >= 9.5),
        "is_workhorse": flag(ip >= 150),
        "log_total_strikeouts": F.log1p(so),
        "is_starter": flag(safe_div(ip, c("games_pitched")) >= 4),
    })
    level2 = {
        "is_reliever": 1 - c("is_starter"),
        "k9_x_starter": k9 * c("is_starter"),
        "swstr_x_starter": c("swstr_pct") * c("is_starter"),
        "ip_x_starter": ip * c("is_starter"),
        "swstr_x_ip": c("swstr_pct") * ip,
        "k9_x_era": k9 * c("season_era"),
        "age_x_ip": c("age") * ip,
        "stuff_x_command": c("stuff_plus") * c("command_plus") / 100,
        "workload_stress": safe_div(ip, c("age")),
    }
    return [level1, level2]


def scalar_features(df: DataFrame, variant: str = "current") -> DataFrame:
    """Add F1-F29 to a renamed season panel (``variant`` = 'current' | 'extended')."""
    levels = current_levels() if variant == "current" else extended_levels()
    for level in levels:
        df = df.withColumns(level)
    return df


# ---------------------------------------------------------------------------
# Pitch-mix row features
# ---------------------------------------------------------------------------

def mix_entropy(*cols: str) -> Column:
    """Shannon entropy (bits) of the positive shares, renormalised to sum 1;
    0.0 when no share is positive.  Uses the ``+1e-10`` guard inside the log
    like the source definition."""
    arr = F.array(*[c(x).cast("double") for x in cols])
    pos = F.filter(arr, lambda p: p.isNotNull() & (p > 0))
    total = F.aggregate(pos, F.lit(0.0), lambda acc, p: acc + p)
    ent = F.aggregate(
        pos, F.lit(0.0),
        lambda acc, p: acc - (p / total) * F.log2(p / total + F.lit(1e-10)),
    )
    return F.when(F.size(pos) > 0, ent).otherwise(F.lit(0.0))


def pitch_mix_levels(shares: Sequence[str] = tuple(PITCH_SHARES)) -> dict[str, Column]:
    fb, sl, cb = shares[0], shares[1], shares[3]
    return {
        "pitch_diversity": sum((F.coalesce((c(s) > 0).cast("int"), F.lit(0)) for s in shares), F.lit(0)),
        "pitch_mix_entropy": mix_entropy(*shares),
        "primary_pitch_pct": F.greatest(*[c(s) for s in shares]),
        "fastball_heavy": flag(c(fb) > 0.5),
        "breaking_ball_pct": F.coalesce(c(sl), F.lit(0.0)) + F.coalesce(c(cb), F.lit(0.0)),
    }


def pitch_mix_features(df: DataFrame, shares: Sequence[str] = tuple(PITCH_SHARES)) -> DataFrame:
    return df.withColumns(pitch_mix_levels(shares))
