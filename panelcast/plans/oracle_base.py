"""Independent SQL definitions (DuckDB dialect) used as the correctness oracle.

They describe the same results as the Spark operators, written the plain way
(join then aggregate, window functions, CASE).  Doubles are rounded to 6
digits at the result boundary on both sides; counts are cast explicitly.
"""

from __future__ import annotations

# Stand-in raw season table: one row per (customer, order year).
RAW_CTE = """
raw AS (
  SELECT o.o_custkey AS player_id,
         CAST(year(o.o_orderdate) AS INTEGER) AS season_,
         CAST(count(*) * 6 AS INTEGER) AS g_,
         CAST(count(DISTINCT CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderkey END) * 12 AS INTEGER) AS gs_,
         CAST(sum(l.l_quantity) AS DOUBLE) AS ip_,
         CAST(floor(COALESCE(sum(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity END), 0) * 1.5
                    + COALESCE(sum(CASE WHEN l.l_returnflag = 'A' THEN l.l_quantity END), 0)) AS INTEGER) AS so_,
         CAST(floor(COALESCE(sum(CASE WHEN l.l_returnflag = 'N' THEN l.l_quantity END), 0) / 2) AS INTEGER) AS bb_,
         CAST(count(*) AS INTEGER) AS n_,
         count(CASE WHEN l.l_returnflag = 'R' THEN 1 END) AS n_r,
         count(CASE WHEN l.l_returnflag = 'A' THEN 1 END) AS n_a,
         count(CASE WHEN l.l_returnflag = 'N' THEN 1 END) AS n_n,
         count(CASE WHEN l.l_linestatus = 'O' THEN 1 END) AS n_o,
         count(CASE WHEN l.l_discount >= CAST(0.09 AS DOUBLE) THEN 1 END) AS n_hr,
         count(CASE WHEN l.l_discount > CAST(0.05 AS DOUBLE) THEN 1 END) AS n_brl,
         count(CASE WHEN l.l_linenumber = 1 THEN 1 END) AS n_l1,
         CAST(sum(CAST(l.l_tax AS DECIMAL(12,2))) AS DOUBLE) AS s_tax,
         CAST(sum(CAST(l.l_discount AS DECIMAL(12,2))) AS DOUBLE) AS s_disc,
         CAST(sum(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS s_price,
         sum(l.l_linenumber) AS s_line
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, year(o.o_orderdate)
)"""

# Renamed panel with the exposure filter (>= 50) and league-average fills.
BASE_CTE = """
base AS (
  SELECT r.player_id, c.c_name AS full_name, c.c_mktsegment AS team, r.season_ AS season,
         r.g_ AS games_pitched, r.gs_ AS games_started, r.ip_ AS total_innings_pitched,
         r.so_ AS total_strikeouts, r.bb_ AS total_walks,
         CAST(floor(r.s_price / 100) AS INTEGER) AS total_pitches,
         CAST(20 + r.player_id % 20 + r.season_ - 1995 AS INTEGER) AS age,
         CAST(r.so_ AS DOUBLE) * 9 / r.ip_ AS k_per_9,
         CAST(r.bb_ AS DOUBLE) * 9 / r.ip_ AS bb_per_9,
         CAST(r.n_hr AS DOUBLE) * 9 / r.ip_ AS hr_per_9,
         CAST(r.n_n AS DOUBLE) * 9 / r.ip_ AS h_per_9,
         CASE WHEN r.bb_ <> 0 THEN r.so_ / CAST(r.bb_ AS DOUBLE) END AS k_bb_ratio,
         CAST(r.so_ AS DOUBLE) * 100 / floor(r.s_price / 100) AS strike_percentage,
         r.s_tax / r.n_ * 100 AS season_era,
         (r.so_ + r.bb_) / r.ip_ AS season_whip,
         r.s_disc / r.n_ * 100 AS fip,
         (r.s_tax + r.s_disc) / r.n_ * 50 AS xfip,
         r.s_price / r.n_ / 10000 AS siera,
         CAST(r.n_r AS DOUBLE) * 100 / r.n_ AS swstr_pct,
         CAST(r.n_r + r.n_a AS DOUBLE) * 100 / r.n_ AS csw_pct,
         100 - CAST(r.n_r AS DOUBLE) * 100 / r.n_ AS contact_pct,
         CAST(r.n_o AS DOUBLE) * 100 / r.n_ AS o_swing_pct,
         100 - CAST(r.n_o AS DOUBLE) * 100 / r.n_ AS z_swing_pct,
         r.s_line / r.n_ * 10 AS zone_pct,
         CAST(r.n_l1 AS DOUBLE) * 100 / r.n_ AS f_strike_pct,
         CAST(r.n_a AS DOUBLE) * 100 / r.n_ AS hard_pct,
         CAST(r.n_brl AS DOUBLE) * 100 / r.n_ AS barrel_pct,
         CAST(r.n_n AS DOUBLE) / r.n_ AS batting_avg_against,
         r.ip_ / r.n_ * 2 AS lob_pct,
         CASE WHEN r.player_id % 7 <> 0 THEN CAST(80 + (r.player_id + 3 * r.season_) % 41 AS DOUBLE) END AS stuff_raw,
         CASE WHEN r.player_id % 11 <> 0 THEN CAST(85 + (r.player_id + 5 * r.season_) % 31 AS DOUBLE) END AS command_raw
  FROM raw r LEFT JOIN customer c ON r.player_id = c.c_custkey
  WHERE r.ip_ >= {min_ip}
)"""

FEAT_CTE = """
feat1 AS (
  SELECT *,
         COALESCE(stuff_raw, 100.0) AS stuff_plus,
         COALESCE(command_raw, 100.0) AS command_plus,
         age * age AS age_squared,
         CAST(COALESCE(age >= 27 AND age <= 31, false) AS INTEGER) AS is_prime_age,
         CAST(COALESCE(age < 27, false) AS INTEGER) AS is_young,
         CAST(COALESCE(age > 31, false) AS INTEGER) AS is_veteran,
         abs(age - 29) AS age_from_peak,
         strike_percentage - total_walks / NULLIF(total_innings_pitched * 3, 0) * 100 AS k_minus_bb_pct,
         hard_pct + barrel_pct AS contact_quality,
         swstr_pct AS whiff_rate,
         100 - contact_pct AS zone_contact_diff,
         (total_strikeouts + total_walks + hr_per_9 * total_innings_pitched / 9)
           / NULLIF(total_innings_pitched * 3, 0) * 100 AS true_outcomes_pct,
         total_strikeouts / NULLIF(total_innings_pitched * 3 - total_strikeouts, 0) AS k_to_contact_ratio,
         k_per_9 * swstr_pct / 100 AS k_upside,
         total_innings_pitched / NULLIF(total_pitches, 0) * 100 AS pitch_efficiency,
         k_per_9 * (1 - hard_pct / 100) AS power_index,
         1.0 / NULLIF(season_whip * season_era, 0) AS consistency_score,
         CAST(COALESCE(k_per_9 >= 9.5 AND total_innings_pitched >= 150, false) AS INTEGER) AS is_ace,
         CAST(COALESCE(k_per_9 >= 10.0, false) AS INTEGER) AS is_high_k_pitcher,
         CAST(COALESCE(total_innings_pitched >= 180, false) AS INTEGER) AS is_workhorse,
         ln(1 + total_strikeouts) AS log_total_strikeouts,
         CAST(COALESCE(games_started > 15 OR total_innings_pitched / NULLIF(games_pitched, 0) > 4, false) AS INTEGER) AS is_starter
  FROM base
),
feat AS (
  SELECT * EXCLUDE (stuff_raw, command_raw),
         CAST(COALESCE(is_starter = 0, false) AS INTEGER) AS is_reliever,
         k_per_9 * is_starter AS k9_x_starter,
         swstr_pct * is_starter AS swstr_x_starter,
         total_innings_pitched * is_starter AS ip_x_starter,
         swstr_pct * total_innings_pitched AS swstr_x_ip,
         k_per_9 * season_era AS k9_x_era,
         age * total_innings_pitched AS age_x_ip,
         stuff_plus * command_plus AS stuff_x_command,
         total_pitches / NULLIF(age, 0) AS workload_stress
  FROM feat1
),
panel AS (
  SELECT *,
         CAST(lead(total_strikeouts) OVER (PARTITION BY player_id ORDER BY season) AS DOUBLE) AS next_season_strikeouts
  FROM feat
)"""


# Archived multi-season generation: exposure >= 20, no rating fill, own formulas.
EXT_FEAT_CTE = """
feat1 AS (
  SELECT * EXCLUDE (k_bb_ratio, strike_percentage),
         stuff_raw AS stuff_plus,
         command_raw AS command_plus,
         total_strikeouts / CAST(CASE WHEN total_walks = 0 THEN 1 ELSE total_walks END AS DOUBLE) AS k_bb_ratio,
         0.65::DOUBLE AS strike_percentage,
         total_innings_pitched / NULLIF(games_pitched, 0) AS pitch_efficiency,
         age * age AS age_squared,
         CAST(COALESCE(age >= 27 AND age <= 31, false) AS INTEGER) AS is_prime_age,
         CAST(COALESCE(age < 27, false) AS INTEGER) AS is_young,
         CAST(COALESCE(age > 31, false) AS INTEGER) AS is_veteran,
         abs(age - 29) AS age_from_peak,
         (total_strikeouts - total_walks) / NULLIF(total_innings_pitched, 0) AS k_minus_bb_pct,
         hard_pct / 100 AS contact_quality,
         swstr_pct / 100 AS whiff_rate,
         total_strikeouts / NULLIF(total_innings_pitched * 3, 0) AS k_to_contact_ratio,
         k_per_9 * total_innings_pitched / 100 AS k_upside,
         k_per_9 * swstr_pct / 100 AS power_index,
         100 - bb_per_9 * 10 AS consistency_score,
         zone_pct - contact_pct AS zone_contact_diff,
         (total_strikeouts + total_walks) / NULLIF(total_innings_pitched * 3, 0) AS true_outcomes_pct,
         CAST(COALESCE(k_per_9 >= 9.5 AND total_innings_pitched >= 150, false) AS INTEGER) AS is_ace,
         CAST(COALESCE(k_per_9 >= 9.5, false) AS INTEGER) AS is_high_k_pitcher,
         CAST(COALESCE(total_innings_pitched >= 150, false) AS INTEGER) AS is_workhorse,
         ln(1 + total_strikeouts) AS log_total_strikeouts,
         CAST(COALESCE(total_innings_pitched / NULLIF(games_pitched, 0) >= 4, false) AS INTEGER) AS is_starter
  FROM base
),
feat AS (
  SELECT * EXCLUDE (stuff_raw, command_raw),
         1 - is_starter AS is_reliever,
         k_per_9 * is_starter AS k9_x_starter,
         swstr_pct * is_starter AS swstr_x_starter,
         total_innings_pitched * is_starter AS ip_x_starter,
         swstr_pct * total_innings_pitched AS swstr_x_ip,
         k_per_9 * season_era AS k9_x_era,
         age * total_innings_pitched AS age_x_ip,
         stuff_plus * command_plus / 100 AS stuff_x_command,
         total_innings_pitched / NULLIF(age, 0) AS workload_stress
  FROM feat1
),
panel AS (
  SELECT *,
         CAST(lead(total_strikeouts) OVER (PARTITION BY player_id ORDER BY season) AS DOUBLE) AS next_season_strikeouts
  FROM feat
)"""


def with_panel(extra_ctes: str = "", variant: str = "current") -> str:
    """``WITH raw, base, feat1, feat, panel[, extra]`` prefix."""
    if variant == "current":
        parts = [RAW_CTE.strip(), BASE_CTE.format(min_ip=50).strip(), FEAT_CTE.strip()]
    else:
        parts = [RAW_CTE.strip(), BASE_CTE.format(min_ip=20).strip(), EXT_FEAT_CTE.strip()]
    if extra_ctes:
        parts.append(extra_ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(select_sql: str, keep: tuple[str, ...] = ()) -> str:
    """Round every numeric output column to 6 digits (``round(x * 1e6) / 1e6``,
    as ``round_scaled`` on the Spark side); ``+ 0`` turns -0.0 into 0.0.
    ``keep`` lists non-numeric columns."""
    if keep:
        ks = ", ".join(keep)
        return f"SELECT {ks}, round(COLUMNS(* EXCLUDE ({ks})), 6) + 0 FROM (\n{select_sql}\n) AS q"
    return f"SELECT round(COLUMNS(*), 6) + 0 FROM (\n{select_sql}\n) AS q"


def panel_query(select_sql: str, keep: tuple[str, ...] = (), extra_ctes: str = "", variant: str = "current") -> str:
    """Oracle statement over the panel CTE chain with rounded output."""
    return with_panel(extra_ctes, variant) + rounded(select_sql, keep)
