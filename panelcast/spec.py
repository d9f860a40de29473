"""Panel specification and the fixed values the forecasting job depends on.

A ``PanelSpec`` names the key, period and measure columns so that every
operator is written once against a schema contract, not against one table.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "player_id"          # stable id; never a display name
    period: str = "season"
    name: str = "full_name"            # display name (may repeat across ids)
    exposure: str = "total_innings_pitched"
    count: str = "total_strikeouts"    # the quantity forecast for the next period
    rate: str = "k_per_9"
    target: str = "next_season_strikeouts"
    tie: tuple[str, ...] = ()


DEFAULT_SPEC = PanelSpec()

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# ---------------------------------------------------------------------------

# Source column -> panel column.  Source names are the public season-stat
# headers; panel names are snake_case so no quoting is needed downstream.
RENAME_MAP: dict[str, str] = {
    "Name": "full_name",
    "Season": "season",
    "IP": "total_innings_pitched",
    "SO": "total_strikeouts",
    "G": "games_pitched",
    "GS": "games_started",
    "K/9": "k_per_9",
    "BB/9": "bb_per_9",
    "HR/9": "hr_per_9",
    "H/9": "h_per_9",
    "BB": "total_walks",
    "K/BB": "k_bb_ratio",
    "K%": "strike_percentage",
    "ERA": "season_era",
    "WHIP": "season_whip",
    "FIP": "fip",
    "xFIP": "xfip",
    "SIERA": "siera",
    "SwStr%": "swstr_pct",
    "CSW%": "csw_pct",
    "Contact%": "contact_pct",
    "O-Swing%": "o_swing_pct",
    "Z-Swing%": "z_swing_pct",
    "Zone%": "zone_pct",
    "F-Strike%": "f_strike_pct",
    "Hard%": "hard_pct",
    "Barrel%": "barrel_pct",
    "AVG": "batting_avg_against",
    "LOB%": "lob_pct",
    "Age": "age",
    "Stuff+": "stuff_plus",
    "Location+": "command_plus",
    "Pitches": "total_pitches",
    "Team": "team",
}

# Columns that may be absent from a source and their default.
OPTIONAL_DEFAULTS: dict[str, object] = {
    "games_started": 0,
    "team": "N/A",
    "stuff_plus": None,
    "command_plus": None,
}

# Constant imputation: 100 = league average.
LEAGUE_AVERAGE_FILL: dict[str, float] = {"stuff_plus": 100.0, "command_plus": 100.0}

# Minimum exposure per season (P2): 50 in the current ingest, 20 in the
# extended one; supplemental projections skip last seasons under 30.
MIN_EXPOSURE = 50.0
MIN_EXPOSURE_EXTENDED = 20.0
MIN_EXPOSURE_SUPPLEMENTAL = 30.0

# The 58 model columns, in model order.
MODEL_FEATURES: list[str] = [
    "total_innings_pitched", "total_strikeouts", "games_pitched",
    "k_per_9", "bb_per_9", "hr_per_9", "h_per_9",
    "total_walks", "k_bb_ratio", "strike_percentage",
    "season_era", "season_whip", "fip", "xfip", "siera",
    "swstr_pct", "csw_pct", "contact_pct", "o_swing_pct", "z_swing_pct", "zone_pct", "f_strike_pct",
    "hard_pct", "barrel_pct", "batting_avg_against", "lob_pct",
    "age", "age_squared", "is_prime_age", "is_young", "is_veteran", "age_from_peak",
    "stuff_plus", "command_plus", "k_minus_bb_pct", "contact_quality", "whiff_rate",
    "zone_contact_diff", "true_outcomes_pct", "k_to_contact_ratio", "k_upside",
    "pitch_efficiency", "power_index", "consistency_score",
    "is_ace", "is_high_k_pitcher", "is_workhorse",
    "log_total_strikeouts",
    "is_starter", "is_reliever",
    "k9_x_starter", "swstr_x_starter", "ip_x_starter",
    "swstr_x_ip", "k9_x_era", "age_x_ip", "stuff_x_command", "workload_stress",
]

# Year-over-year (momentum) block: lagged source -> lag column name.
LAG_COLUMNS: dict[str, str] = {
    "k_per_9": "prev_k9",
    "swstr_pct": "prev_swstr",
    "total_innings_pitched": "prev_ip",
    "season_era": "prev_era",
    "xfip": "prev_xfip",
    "siera": "prev_siera",
    "total_strikeouts": "prev_total_k",
    "stuff_plus": "prev_stuff",
    "command_plus": "prev_command",
}
DELTA_COLUMNS: dict[str, tuple[str, str]] = {
    "delta_k9": ("k_per_9", "prev_k9"),
    "delta_swstr": ("swstr_pct", "prev_swstr"),
    "delta_ip": ("total_innings_pitched", "prev_ip"),
    "delta_era": ("season_era", "prev_era"),
    "delta_xfip": ("xfip", "prev_xfip"),
    "delta_siera": ("siera", "prev_siera"),
    "delta_stuff": ("stuff_plus", "prev_stuff"),
    "delta_command": ("command_plus", "prev_command"),
}
# Momentum score weights over globally standardised deltas (sign -1 = lower is better).
MOMENTUM_WEIGHTS: dict[str, float] = {"delta_k9": 0.4, "delta_swstr": 0.3, "delta_stuff": 0.2, "delta_era": -0.1}

MOMENTUM_FEATURES: list[str] = [
    "delta_k9", "delta_swstr", "delta_ip", "delta_era", "delta_xfip", "delta_siera",
    "delta_stuff", "delta_command", "pct_change_k",
    "is_improving", "is_declining", "is_breakout", "is_collapse",
    "stuff_improving", "command_improving", "workload_increasing", "workload_decreasing",
    "missed_time_last_year", "coming_off_injury",
    "career_high_k", "career_high_k9", "has_hit_200k", "has_hit_11k9",
    "years_experience", "is_rookie_level", "is_established",
    "k9_rolling_std", "is_volatile", "k9_3yr_avg", "swstr_3yr_avg", "momentum_score",
]

# The features that count as newly engineered, and the selective momentum features.
ENGINEERED: list[str] = [
    "is_ace", "is_high_k_pitcher", "is_workhorse", "log_total_strikeouts", "is_starter", "is_reliever", "k9_x_starter",
    "swstr_x_starter", "ip_x_starter", "swstr_x_ip", "k9_x_era", "age_x_ip", "stuff_x_command", "workload_stress",
]
SELECTIVE: list[str] = [
    "k9_3yr_avg", "swstr_3yr_avg", "career_high_k9", "years_experience", "delta_k9", "is_improving", "has_hit_200k",
    "momentum_score", "is_breakout", "coming_off_injury",
]

AVAILABILITY_FEATURES: list[str] = [
    "missed_previous_season", "consecutive_active_years", "years_since_injury",
    "career_availability_rate", "ip_volatility", "coming_back_from_injury", "injury_risk_score",
]

# Injury risk weights: missed, short streak, recent gap, low availability, volatility.
RISK_WEIGHTS: dict[str, float] = {"missed": 0.35, "streak": 0.20, "recent": 0.25, "availability": 0.15, "volatility": 0.05}
NEVER_GAPPED = 99          # years_since_injury when no gap
RECENT_GAP_CAP = 5         # clip(5 - years_since, 0, 5) / 5

# Six pitch-type shares and the pitch-mix columns derived from them.
PITCH_SHARES: list[str] = ["fb_pct", "sl_pct", "ct_pct", "cb_pct", "ch_pct", "sf_pct"]
PITCH_SHARE_SOURCE: dict[str, str] = {
    "FB%": "fb_pct", "SL%": "sl_pct", "CT%": "ct_pct", "CB%": "cb_pct", "CH%": "ch_pct", "SF%": "sf_pct",
}
PITCH_MIX_FEATURES: list[str] = ["pitch_diversity", "pitch_mix_entropy", "primary_pitch_pct", "fastball_heavy", "breaking_ball_pct"]

# Projection constants.
RANGE_HALF_WIDTH = 29                 # rounded MAE used for ranges
SUPPLEMENTAL_MAX_YEARS_AWAY = 3
SUPPLEMENTAL_DECAY_PER_YEAR = 0.05
SUPPLEMENTAL_OLD_AGE = 32
SUPPLEMENTAL_OLD_PENALTY = 0.02
SUPPLEMENTAL_WIDTH_PER_YEAR = 0.2
TIER_CUTS: list[int] = [200, 150, 100]

# Scenario IP factors (conservative, moderate, optimistic) and the rate haircut.
SCENARIO_FACTORS_MISSED = (0.65, 0.75, 0.85)
SCENARIO_FACTORS_HIGH = (0.70, 0.80, 0.90)      # risk > 0.6
SCENARIO_FACTORS_MEDIUM = (0.80, 0.90, 0.95)    # risk > 0.3
SCENARIO_FACTORS_LOW = (0.90, 0.95, 1.00)
SCENARIO_RATE_FACTOR = 0.97

# Error-analysis tiers (right-closed intervals).
K9_TIER_EDGES = [0, 7, 9, 11, 100]
K9_TIER_LABELS = ["Low (<7)", "Average (7-9)", "High (9-11)", "Elite (11+)"]
IP_TIER_EDGES = [0, 50, 100, 150, 300]
IP_TIER_LABELS = ["Reliever (0-50)", "Swingman (50-100)", "Starter (100-150)", "Workhorse (150+)"]
ACTUAL_TIER_EDGES = [0, 75, 125, 175, 250, 500]
ACTUAL_TIER_LABELS = ["Low (0-75)", "Medium (75-125)", "High (125-175)", "Elite (175-250)", "Ace (250+)"]
ACCURACY_BANDS = [10, 20, 30]
Z_SCORES = {"80": 1.28, "90": 1.645, "95": 1.96}
DIRECTION_MARGIN = 10
PRIOR_LEVEL_CUT = 150

# Features checked against absolute error.
ERROR_CORRELATION_FEATURES = [
    "k_per_9", "total_innings_pitched", "age", "season_era",
    "swstr_pct", "is_ace", "is_starter", "power_index",
    "xfip", "siera", "stuff_plus", "command_plus",
]
