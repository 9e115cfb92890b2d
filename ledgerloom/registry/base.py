"""Query registry: each entry is a Spark query and, where SQL can say it, its SQL twin.

The SQL is written from the definitions (brute-force joins, per-row windows), not from the
Spark plans. Named blocks are prefixed as common table expressions when a query uses them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom import constants as C
from ledgerloom.sources.driver_tables import CITIZENSHIPS, FEET, POSITIONS, DriverTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def add(fn: Callable[[DriverTables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(DriverTables(spark, folder))
        if sql is not None:
            SQL[name] = with_blocks(sql)
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listing(values) -> str:
    return ", ".join(quoted(v) for v in values)


def club_name_sql(i: str) -> str:
    base = f"('Supplier#' || lpad(CAST({i} AS VARCHAR), 9, '0'))"
    return (f"CASE {i} % 25 WHEN 3 THEN {base} || ' B' WHEN 4 THEN 'Jong ' || {base} WHEN 5 THEN 'Without Club' "
            f"WHEN 6 THEN 'Retired' WHEN 7 THEN {base} || ' U19' ELSE {base} END")


def season_sql(d: str) -> str:
    return (f"CASE WHEN month({d}) >= 7 THEN year({d}) || '-' || (year({d}) + 1) "
            f"ELSE (year({d}) - 1) || '-' || year({d}) END")


def bucket_sql(fee: str) -> str:
    rules = " ".join(f"WHEN {fee} < {bound} THEN '{label}'" for bound, label in C.FEE_BUCKETS)
    return f"CASE WHEN {fee} IS NULL THEN 'unknown' WHEN {fee} <= 0 THEN 'free' {rules} ELSE 'elite' END"


def type_sql(fee: str, origin: str, target: str) -> str:
    o, t = f"trim(coalesce({origin}, ''))", f"trim(coalesce({target}, ''))"
    rules = " ".join(
        f"WHEN regexp_matches({o}, {quoted('(?i)' + p)}) THEN 'youth_promotion' "
        f"WHEN regexp_matches({t}, {quoted('(?i)' + p)}) THEN 'sent_to_reserves'" for p in C.RESERVE_PATTERNS)
    return (f"CASE WHEN {fee} > 0 THEN 'paid' WHEN lower({t}) = 'retired' THEN 'retired' "
            f"WHEN lower({t}) = 'without club' THEN 'contract_expired' {rules} ELSE 'free_transfer' END")


def strip_sql(column: str) -> str:
    """Prefix stripping as a fold over the prefix list."""
    prefixes = listing(C.CLUB_PREFIXES)
    return (f"list_reduce(list_prepend(lower(trim({column})), [{prefixes}]), "
            f"lambda acc, p: CASE WHEN starts_with(acc, p) THEN substr(acc, length(p) + 1) ELSE acc END)")


def gem_sql(roi: str = "roi_pct") -> str:
    return f"CASE WHEN {roi} >= 1000 THEN 3 WHEN {roi} >= 500 THEN 2 WHEN {roi} >= 100 THEN 1 ELSE 0 END"


def region_sql(citizenship: str) -> str:
    first = f"trim(split_part({citizenship}, ',', 1))"
    rules = " ".join(f"WHEN {first} IN ({listing(names)}) THEN '{region}'" for region, names in C.REGIONS.items())
    return f"CASE WHEN {citizenship} IS NULL OR {citizenship} = '' THEN NULL {rules} ELSE 'Other' END"


def position_sql(position: str) -> str:
    rules = " ".join(f"WHEN {quoted(k)} THEN '{v}'" for k, v in C.POSITION_BUCKETS.items())
    return f"CASE WHEN {position} IS NOT NULL THEN CASE {position} {rules} ELSE 'Other' END END"


def indel_sql(a: str, b: str) -> str:
    """0-100: twice the longest common subsequence over both lengths. The subsequence is worked out row by row: ``acc`` holds the
    lengths for the characters of ``a`` so far against every prefix of ``b``, ``hit`` which characters of ``b`` equal the next one."""
    zeros = f"list_transform(range(0, length({b}) + 1), lambda j: 0::BIGINT)"
    hits = (f"list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), "
            "lambda y: CASE WHEN x = y THEN 1::BIGINT ELSE 0::BIGINT END))")
    step = ("list_prepend(0::BIGINT, list_transform(range(1, len(acc)), lambda j: list_max(list_transform(range(1, j + 1), "
            "lambda i: greatest(acc[i + 1], acc[i] + hit[i])))))")
    common = f"list_extract(list_reduce(list_prepend({zeros}, {hits}), lambda acc, hit: {step}), -1)"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {common} / (length({a}) + length({b})) END"


def sorted_words_sql(text: str) -> str:
    words = f"list_filter(string_split_regex(strip_accents(lower(trim({text}))), '\\s+'), lambda w: w <> '')"
    return f"coalesce(array_to_string(list_sort({words}), ' '), '')"


BLOCKS = {
    "moves": """
        SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_tax, l_returnflag, l_linestatus,
               CAST(l_shipdate AS DATE) AS d,
               row_number() OVER w AS seq, lag(l_suppkey) OVER w AS prev
        FROM lineitem
        WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)""",
    "transfers0": """
        SELECT l_partkey * 100000000 + seq AS transfer_id, l_partkey AS player_id,
               CASE WHEN seq = 1 THEN NULL WHEN l_tax = 0 THEN CAST(l_linenumber AS BIGINT) ELSE prev END AS from_club_id,
               l_suppkey AS to_club_id, d AS transfer_date,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'N' THEN 0.0
                    ELSE round(l_extendedprice * 100) END::DOUBLE AS transfer_fee
        FROM moves""",
    "transfers": f"""
        SELECT *, {club_name_sql('from_club_id')} AS from_club_name, {club_name_sql('to_club_id')} AS to_club_name,
               {season_sql('transfer_date')} AS transfer_season
        FROM transfers0""",
    "players": f"""
        SELECT p_partkey AS player_id, p_name AS name, p_type AS sub_position,
               ([{listing(POSITIONS)}])[1 + p_partkey % 17] AS position,
               CAST(DATE '1973-01-01' + CAST(p_size * 100 AS INTEGER) AS DATE) AS date_of_birth,
               CAST(p_size AS BIGINT) AS current_club_id,
               CASE WHEN p_size <> 13 THEN {club_name_sql('CAST(p_size AS BIGINT)')} END AS current_club_name,
               ([{listing(FEET)}])[1 + p_partkey % 4] AS foot, CAST(p_size + 150 AS DOUBLE) AS height_in_cm,
               round(p_retailprice * 10000) AS market_value_in_eur,
               ([{listing(CITIZENSHIPS)}])[1 + p_partkey % 8] AS citizenship,
               CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'no agent' ELSE p_brand END AS agent_name,
               CASE WHEN p_partkey % 5 <> 0 THEN DATE '2001-06-30' END AS contract_expiry_date,
               CASE WHEN p_size > 10 THEN '/img/' || p_partkey END AS image_url
        FROM part""",
    "clubs": """
        SELECT s_suppkey AS club_id, s_name AS name, 'club-' || s_suppkey AS club_code, n_name AS domestic_competition_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 1500""",
    "valuations": """
        SELECT l_partkey AS player_id, CAST(o_orderdate AS DATE) AS date, round(o_totalprice * 50) AS market_value_in_eur
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "appearances": """
        SELECT l_partkey || '-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-'
                   || CAST(round(l_extendedprice * 100) AS BIGINT) AS appearance_id,
               l_orderkey AS game_id, l_partkey AS player_id, l_suppkey AS player_club_id,
               CAST(CAST(l_shipdate AS DATE) + CAST(l_linenumber * 30 AS INTEGER) AS DATE) AS date,
               'C' || l_linenumber AS competition_id,
               CAST(l_linenumber = 7 AS BIGINT) AS yellow_cards,
               CAST(l_linenumber = 6 AND l_returnflag = 'R' AS BIGINT) AS red_cards,
               CAST(l_linenumber % 3 AS BIGINT) AS goals, CAST(l_linenumber % 2 AS BIGINT) AS assists,
               CAST(l_quantity * 2 AS BIGINT) AS minutes_played
        FROM lineitem""",
    "player_xg": """
        SELECT l_partkey AS player_id, year(l_shipdate) || '/' || (year(l_shipdate) + 1) AS season,
               l_linestatus AS competition_id, CAST(sum(CAST(l_quantity * 2 AS BIGINT)) AS BIGINT) AS minutes,
               round(sum(l_discount) * 10, 2) AS xg, round(sum(l_tax) * 10, 2) AS xa,
               CAST(sum(l_linenumber % 3) AS BIGINT) AS goals
        FROM lineitem GROUP BY 1, 2, 3""",
    "ledger": """
        SELECT t.*, p.name AS player_name, (t.transfer_date - p.date_of_birth) / 365.25::DOUBLE AS age_at_transfer
        FROM transfers t LEFT JOIN players p ON p.player_id = t.player_id""",
    "all_matches": """
        SELECT b.transfer_id AS buy_transfer_id, s.transfer_id AS sell_transfer_id, b.player_id, b.to_club_id AS club_id,
               b.transfer_date AS buy_date, s.transfer_date AS sell_date, b.transfer_fee AS buy_fee, s.transfer_fee AS sell_fee,
               row_number() OVER (PARTITION BY b.transfer_id ORDER BY s.transfer_date DESC, s.transfer_id DESC) AS rn
        FROM transfers0 b JOIN transfers0 s
          ON s.player_id = b.player_id AND s.from_club_id = b.to_club_id AND s.transfer_date > b.transfer_date
        WHERE b.transfer_fee > 0 AND s.transfer_fee > 0""",
    "matched": """
        SELECT * EXCLUDE (rn), sell_fee - buy_fee AS profit, (sell_fee - buy_fee) / buy_fee * 100 AS roi_pct,
               CAST(sell_date - buy_date AS BIGINT) AS tenure_days, (sell_date - buy_date) / 365.25::DOUBLE AS tenure_years,
               greatest(least(pow(sell_fee / buy_fee, 1.0 / greatest((sell_date - buy_date) / 365.25::DOUBLE, 7 / 365.25::DOUBLE)) - 1,
                              5.0), -5.0) * 100 AS annualized_roi_pct
        FROM all_matches WHERE rn = 1 AND buy_fee >= 100000""",
    "pair_rows": f"""
        SELECT m.*, l.age_at_transfer AS age_at_buy, {gem_sql()} AS gem_tier, CAST(roi_pct >= 100 AS INTEGER) AS is_gem,
               CASE WHEN buy_date < DATE '1999-01-01' AND l.age_at_transfer <= 23 THEN 1 ELSE 0 END AS is_training_eligible
        FROM matched m JOIN ledger l ON l.transfer_id = m.buy_transfer_id""",
    "peaks": "SELECT player_id, max(market_value_in_eur) AS peak_value FROM valuations GROUP BY player_id",
    "pairs": """
        SELECT m.*, k.peak_value, (coalesce(k.peak_value, 0) - m.buy_fee) / m.buy_fee * 100 AS value_creation_pct,
               p.name AS player_name, p.position AS player_position
        FROM matched m LEFT JOIN peaks k ON k.player_id = m.player_id LEFT JOIN players p ON p.player_id = m.player_id""",
    "paired": f"""
        SELECT l.*, m.buy_fee, m.sell_fee, m.profit, m.roi_pct, m.annualized_roi_pct, m.tenure_days, m.tenure_years,
               m.peak_value, m.value_creation_pct, m.player_position,
               CASE WHEN m.roi_pct IS NOT NULL THEN CAST(m.roi_pct >= 100 AS INTEGER) END AS is_gem,
               CASE WHEN m.roi_pct IS NOT NULL THEN {gem_sql('m.roi_pct')} END AS gem_tier,
               CASE WHEN m.roi_pct IS NOT NULL AND l.transfer_date < DATE '1999-01-01' AND l.age_at_transfer <= 23
                    THEN 1 ELSE 0 END AS is_training_eligible
        FROM ledger l LEFT JOIN pairs m ON m.buy_transfer_id = l.transfer_id""",
    "agent_sizes": """
        SELECT agent_name, count(*) AS players FROM players
        WHERE agent_name IS NOT NULL AND agent_name NOT IN ('no agent', '') GROUP BY agent_name""",
    "agent_ranks": "SELECT *, row_number() OVER (ORDER BY players DESC, agent_name) AS rn FROM agent_sizes",
    "derived_players": f"""
        SELECT p.*, {position_sql('p.position')} AS position_bucket, {region_sql('p.citizenship')} AS citizenship_region,
               CASE WHEN p.agent_name IS NULL THEN 'Unknown' WHEN p.agent_name IN ('no agent', '') THEN 'Solo'
                    WHEN a.rn <= 10 THEN 'Mega' WHEN a.players >= 5 THEN 'Active' WHEN a.players >= 2 THEN 'Small'
                    ELSE 'Solo' END AS agent_cluster
        FROM players p LEFT JOIN agent_ranks a ON a.agent_name = p.agent_name""",
    "gem_rates": """
        SELECT c.domestic_competition_id AS league_id, count(DISTINCT t.transfer_id) AS total_deals,
               count(DISTINCT CASE WHEN roi_pct >= 100 AND age_at_transfer <= 23 THEN t.transfer_id END) AS gems,
               round(count(DISTINCT CASE WHEN roi_pct >= 100 AND age_at_transfer <= 23 THEN t.transfer_id END) * 100.0::DOUBLE
                     / count(DISTINCT t.transfer_id), 1) AS gem_rate
        FROM paired t JOIN clubs c ON c.club_id = t.from_club_id
        WHERE roi_pct IS NOT NULL AND transfer_date < DATE '2030-01-01' AND c.domestic_competition_id IS NOT NULL
        GROUP BY 1 HAVING count(DISTINCT t.transfer_id) >= 5""",
    "tiers": """
        SELECT *, CASE WHEN gem_rate < 18 THEN 1 WHEN gem_rate < 20 THEN 2 WHEN gem_rate < 22 THEN 3 ELSE 4 END AS tier
        FROM gem_rates""",
    "tiered_clubs": """
        SELECT c.*, CASE WHEN c.domestic_competition_id IS NOT NULL THEN coalesce(t.tier, 4) END AS league_tier
        FROM clubs c LEFT JOIN tiers t ON t.league_id = c.domestic_competition_id""",
    "club_groups": """
        SELECT club_id, count(roi_pct) AS total_transfers, median(roi_pct) AS median_roi, sum(profit) AS total_profit,
               avg(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) * 100 AS hit_rate,
               median(value_creation_pct) AS value_creation, median(annualized_roi_pct) AS annualized_roi,
               avg(profit) AS profit_per_deal,
               median(CASE WHEN peak_value > 0 THEN (sell_fee - peak_value) / peak_value * 100 END) AS buying_club_premium
        FROM pairs GROUP BY club_id""",
    "club_bounds": """
        SELECT min(median_roi) AS a0, max(median_roi) AS a1, min(total_profit) AS b0, max(total_profit) AS b1,
               min(hit_rate) AS c0, max(hit_rate) AS c1, min(value_creation) AS d0, max(value_creation) AS d1,
               min(coalesce(annualized_roi, 0)) AS e0, max(coalesce(annualized_roi, 0)) AS e1,
               min(profit_per_deal) AS f0, max(profit_per_deal) AS f1
        FROM club_groups WHERE total_transfers >= 3""",
    "club_scores": """
        SELECT g.*, 0.25::DOUBLE * CASE WHEN a1 = a0 THEN 0.5 ELSE (median_roi - a0) / (a1 - a0) END
             + 0.20::DOUBLE * CASE WHEN b1 = b0 THEN 0.5 ELSE (total_profit - b0) / (b1 - b0) END
             + 0.20::DOUBLE * CASE WHEN c1 = c0 THEN 0.5 ELSE (hit_rate - c0) / (c1 - c0) END
             + 0.15::DOUBLE * CASE WHEN d1 = d0 THEN 0.5 ELSE (value_creation - d0) / (d1 - d0) END
             + 0.10::DOUBLE * CASE WHEN e1 = e0 THEN 0.5 ELSE (coalesce(annualized_roi, 0) - e0) / (e1 - e0) END
             + 0.10::DOUBLE * CASE WHEN f1 = f0 THEN 0.5 ELSE (profit_per_deal - f0) / (f1 - f0) END AS composite_score
        FROM club_groups g, club_bounds WHERE total_transfers >= 3""",
    "scored_clubs": """
        SELECT c.*, s.* EXCLUDE (club_id) FROM clubs c LEFT JOIN club_scores s ON s.club_id = c.club_id""",
    "window_groups": """
        SELECT w AS window_key, club_id, count(roi_pct) AS total_transfers, median(roi_pct) AS median_roi,
               sum(profit) AS total_profit, avg(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) * 100 AS hit_rate,
               median(value_creation_pct) AS value_creation, median(annualized_roi_pct) AS annualized_roi,
               avg(profit) AS profit_per_deal,
               median(CASE WHEN peak_value > 0 THEN (sell_fee - peak_value) / peak_value * 100 END) AS buying_club_premium
        FROM pairs JOIN (VALUES ('1996'), ('1998'), ('2000')) v(w) ON year(buy_date) >= CAST(w AS INTEGER)
        GROUP BY 1, 2 HAVING count(roi_pct) >= 3""",
    "window_scores": """
        SELECT g.*, 0.25::DOUBLE * CASE WHEN max(median_roi) OVER p = min(median_roi) OVER p THEN 0.5
                 ELSE (median_roi - min(median_roi) OVER p) / (max(median_roi) OVER p - min(median_roi) OVER p) END
             + 0.20::DOUBLE * CASE WHEN max(total_profit) OVER p = min(total_profit) OVER p THEN 0.5
                 ELSE (total_profit - min(total_profit) OVER p) / (max(total_profit) OVER p - min(total_profit) OVER p) END
             + 0.20::DOUBLE * CASE WHEN max(hit_rate) OVER p = min(hit_rate) OVER p THEN 0.5
                 ELSE (hit_rate - min(hit_rate) OVER p) / (max(hit_rate) OVER p - min(hit_rate) OVER p) END
             + 0.15::DOUBLE * CASE WHEN max(value_creation) OVER p = min(value_creation) OVER p THEN 0.5
                 ELSE (value_creation - min(value_creation) OVER p) / (max(value_creation) OVER p - min(value_creation) OVER p) END
             + 0.10::DOUBLE * CASE WHEN max(coalesce(annualized_roi, 0)) OVER p = min(coalesce(annualized_roi, 0)) OVER p THEN 0.5
                 ELSE (coalesce(annualized_roi, 0) - min(coalesce(annualized_roi, 0)) OVER p)
                      / (max(coalesce(annualized_roi, 0)) OVER p - min(coalesce(annualized_roi, 0)) OVER p) END
             + 0.10::DOUBLE * CASE WHEN max(profit_per_deal) OVER p = min(profit_per_deal) OVER p THEN 0.5
                 ELSE (profit_per_deal - min(profit_per_deal) OVER p) / (max(profit_per_deal) OVER p - min(profit_per_deal) OVER p) END
               AS composite_score
        FROM window_groups g WINDOW p AS (PARTITION BY window_key)""",
    "loans": """
        SELECT DISTINCT t.transfer_id FROM transfers0 t JOIN transfers0 o
          ON o.player_id = t.player_id AND o.from_club_id = t.to_club_id AND o.to_club_id = t.from_club_id
         AND o.transfer_id <> t.transfer_id AND abs(t.transfer_date - o.transfer_date) <= 730
        WHERE t.from_club_id <> 0 AND t.to_club_id <> 0 AND coalesce(t.transfer_fee, 0) <= 0 AND coalesce(o.transfer_fee, 0) <= 0
          AND (coalesce(t.transfer_fee, 0) = 0 OR coalesce(o.transfer_fee, 0) = 0)""",
    "typed": f"""
        SELECT t.*, CASE WHEN base = 'free_transfer' AND transfer_id IN (SELECT transfer_id FROM loans) THEN 'loan'
                         ELSE base END AS transfer_type
        FROM (SELECT *, {type_sql('transfer_fee', 'from_club_name', 'to_club_name')} AS base FROM transfers) t""",
    "unpaired": """
        SELECT t.* FROM transfers t JOIN clubs c ON c.club_id = t.from_club_id
        WHERE t.transfer_fee > 100000 AND t.from_club_id NOT IN (515, 2113, 75)
          AND NOT EXISTS (SELECT 1 FROM transfers0 a WHERE a.player_id = t.player_id AND a.to_club_id = t.from_club_id)""",
    "lagged": """
        SELECT *, lag(to_club_id) OVER (PARTITION BY player_id ORDER BY transfer_date, transfer_id) AS prev_to,
               row_number() OVER (PARTITION BY player_id ORDER BY transfer_date, transfer_id) AS n,
               count(*) OVER (PARTITION BY player_id) AS total
        FROM transfers""",
    "breaks": """
        SELECT player_id, count(*) AS breaks FROM lagged
        WHERE total >= 3 AND prev_to IS NOT NULL AND prev_to <> from_club_id GROUP BY player_id""",
    "impossible": """
        SELECT s.player_id, s.from_club_id AS club_id, s.transfer_id AS sell_transfer_id, b.transfer_id AS buy_transfer_id,
               s.transfer_date AS sell_date, b.transfer_date AS buy_date, s.transfer_fee AS sell_fee, b.transfer_fee AS buy_fee
        FROM transfers0 s JOIN transfers0 b
          ON b.player_id = s.player_id AND b.to_club_id = s.from_club_id AND s.transfer_date < b.transfer_date
        WHERE s.transfer_fee > 100000 OR b.transfer_fee > 100000""",
    "dup_transfers": """
        SELECT player_id, from_club_id, to_club_id, transfer_date, count(*) AS cnt FROM transfers0
        WHERE player_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "dup_valuations": """
        SELECT player_id, date, market_value_in_eur, count(*) AS cnt FROM valuations
        WHERE player_id IS NOT NULL AND date IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "missing_first": """
        SELECT count(*) AS missing FROM (SELECT player_id, min(transfer_date) AS first FROM transfers0 GROUP BY 1) f
        JOIN transfers0 t ON t.player_id = f.player_id AND t.transfer_date = f.first WHERE t.from_club_id IS NULL""",
    "edges": """
        SELECT from_club_id AS cid, min(from_club_name) AS name, count(*) AS cnt FROM transfers
        WHERE from_club_id IS NOT NULL AND from_club_name <> '' GROUP BY 1
        UNION ALL
        SELECT to_club_id, min(to_club_name), count(*) FROM transfers
        WHERE to_club_id IS NOT NULL AND to_club_name <> '' GROUP BY 1""",
    "orphans": f"""
        SELECT cid, name, CAST(sum(cnt) AS BIGINT) AS total_cnt FROM edges WHERE cid NOT IN (SELECT club_id FROM clubs)
          AND lower(trim(name)) NOT IN ({listing(C.NON_CLUB_NAMES)})
          AND NOT regexp_matches(name, {quoted('(?i)' + '|'.join(C.ORPHAN_RESERVE_PATTERNS))})
        GROUP BY 1, 2""",
    "graph_totals": """
        SELECT (SELECT count(*) FROM players)::DOUBLE AS total_players, (SELECT count(*) FROM transfers0)::DOUBLE AS total_edges,
               (SELECT count(DISTINCT player_id) FROM impossible)::DOUBLE AS timeline_violations,
               (SELECT count(*) FROM breaks)::DOUBLE AS disconnected_segments,
               (SELECT count(DISTINCT player_id) FROM transfers0 WHERE from_club_id IS NOT NULL
                  AND from_club_id NOT IN (SELECT club_id FROM clubs))::DOUBLE AS orphan_players,
               (SELECT count(*) FROM dup_transfers)::DOUBLE AS duplicate_edges,
               (SELECT missing FROM missing_first)::DOUBLE AS missing_continuity""",
    "health": """
        SELECT *, round(greatest(0.0, least(1.0, 1.0::DOUBLE - timeline_violations / total_edges * 8
                 - least(disconnected_segments * 0.002::DOUBLE, 0.15) - least(orphan_players * 0.001::DOUBLE, 0.10)
                 - least(duplicate_edges * 0.03::DOUBLE, 0.20) - least(missing_continuity / 10000, 0.10)))::DOUBLE, 3) AS graph_health_score
        FROM graph_totals""",
    "candidates0": """
        SELECT *, coalesce(transfer_fee = 0, true) AS changed FROM transfers""",
    "candidates": f"""
        SELECT transfer_id AS candidate_id, player_id,
               CASE WHEN changed AND to_club_id % 10 = 0 THEN 'x' || transfer_id END AS source_id,
               CASE WHEN NOT (changed AND transfer_fee IS NULL) THEN from_club_id END AS from_id,
               CASE WHEN changed THEN to_club_id + 1 ELSE to_club_id END AS to_id,
               {strip_sql('from_club_name')} AS from_name,
               from_club_name AS raw_from_name,
               CASE WHEN changed THEN CAST(transfer_date + 400 AS DATE) ELSE transfer_date END AS on_date,
               transfer_fee AS fee, transfer_fee * 2 AS market_value_in_eur
        FROM candidates0""",
    "candidate_prints": f"""
        SELECT *, {strip_sql('raw_to_name')} AS to_name, {season_sql('on_date')} AS season, {bucket_sql('fee')} AS bucket
        FROM (SELECT *, {club_name_sql('to_id')} AS raw_to_name FROM candidates)""",
    "ledger_prints": f"""
        SELECT transfer_id, player_id, from_club_id AS from_id, to_club_id AS to_id,
               {strip_sql('from_club_name')} AS from_name, {strip_sql('to_club_name')} AS to_name,
               transfer_season AS season, {bucket_sql('transfer_fee')} AS bucket,
               CASE WHEN transfer_id % 10 = 0 THEN 'x' || transfer_id END AS source_id
        FROM transfers""",
    "matches0": """
        SELECT c.candidate_id, l.transfer_id,
               CASE WHEN c.from_id IS NOT NULL AND l.from_id IS NOT NULL THEN 35
                    WHEN c.from_name <> '' AND l.from_name <> '' THEN 25 ELSE 0 END
             + CASE WHEN c.to_id IS NOT NULL AND l.to_id IS NOT NULL THEN 35
                    WHEN c.to_name <> '' AND l.to_name <> '' THEN 25 ELSE 0 END
             + CASE WHEN c.season <> '' AND l.season <> '' THEN 15 ELSE 0 END + 15 AS available,
               CASE WHEN c.from_id = l.from_id THEN 'from_club_id_match'
                    WHEN (c.from_id IS NULL OR l.from_id IS NULL) AND c.from_name = l.from_name THEN 'from_club_name_match' END AS r1,
               CASE WHEN c.to_id = l.to_id THEN 'to_club_id_match'
                    WHEN (c.to_id IS NULL OR l.to_id IS NULL) AND c.to_name = l.to_name THEN 'to_club_name_match' END AS r2,
               CASE WHEN c.season = l.season THEN 'season_match' END AS r3,
               CASE WHEN c.bucket = l.bucket THEN 'fee_bucket_match:' || c.bucket END AS r4,
               coalesce(c.source_id = l.source_id, false) AS same
        FROM candidate_prints c JOIN ledger_prints l ON l.player_id = c.player_id""",
    "matches": """
        SELECT *, CASE WHEN same THEN ['exact_transfermarkt_id'] ELSE list_filter([r1, r2, r3, r4], lambda r: r IS NOT NULL) END AS why,
               CASE WHEN same THEN 1.0::DOUBLE ELSE (CASE r1 WHEN 'from_club_id_match' THEN 35 WHEN 'from_club_name_match' THEN 25 ELSE 0 END
                 + CASE r2 WHEN 'to_club_id_match' THEN 35 WHEN 'to_club_name_match' THEN 25 ELSE 0 END
                 + CASE WHEN r3 IS NULL THEN 0 ELSE 15 END + CASE WHEN r4 IS NULL THEN 0 ELSE 15 END)::DOUBLE / available END AS score
        FROM matches0""",
    "best": """
        SELECT candidate_id, transfer_id AS ledger_id, round(score, 3) AS best_score, why AS best_reasons
        FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, transfer_id) AS rn FROM matches)
        WHERE rn = 1""",
    "graded": """
        SELECT c.*, coalesce(b.best_score, 0) AS best_score, coalesce(b.best_reasons, []) AS best_reasons, b.ledger_id,
               (CASE (c.from_id IS NOT NULL)::INT + (c.to_id IS NOT NULL)::INT WHEN 2 THEN 40 WHEN 1 THEN 20 ELSE 0 END
              + CASE coalesce(c.from_name <> '', false)::INT + coalesce(c.to_name <> '', false)::INT WHEN 2 THEN 15 WHEN 1 THEN 8 ELSE 0 END
              + CASE WHEN c.season <> '' THEN 15 ELSE 0 END + CASE WHEN c.on_date IS NOT NULL THEN 10 ELSE 0 END
              + CASE WHEN c.fee IS NOT NULL THEN 10 WHEN c.bucket <> 'unknown' THEN 5 ELSE 0 END)::DOUBLE / 90
              * CASE WHEN coalesce(b.best_score, 0) < 0.3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS grade
        FROM candidate_prints c LEFT JOIN best b ON b.candidate_id = c.candidate_id""",
    "scored": """
        SELECT *, CASE WHEN best_score >= 0.85 THEN list_prepend('duplicate: matched DB record with score ' || best_score::DOUBLE, best_reasons)
                       WHEN source_id <> '' THEN ['transfermarkt_id_present']
                       ELSE list_filter([CASE (from_id IS NOT NULL)::INT + (to_id IS NOT NULL)::INT WHEN 2 THEN 'both_club_ids_present'
                                              WHEN 1 THEN 'one_club_id_present' ELSE 'no_club_ids' END,
                                         CASE WHEN from_name <> '' AND to_name <> '' THEN 'both_club_names_present' END,
                                         CASE WHEN season <> '' THEN 'season:' || season END, CASE WHEN on_date IS NOT NULL THEN 'date_present' END,
                                         CASE WHEN fee IS NOT NULL THEN 'fee:' || bucket WHEN bucket <> 'unknown' THEN 'fee_bucket:' || bucket END,
                                         CASE WHEN best_score < 0.3 THEN 'no_contextual_matches' END], lambda r: r IS NOT NULL) END AS reasons,
               CASE WHEN best_score >= 0.85 THEN 0.0 WHEN source_id <> '' THEN 1.0 ELSE round(least(grade, 1.0), 3) END::DOUBLE AS score,
               CASE WHEN best_score >= 0.85 THEN 'reject' WHEN source_id <> '' THEN 'safe'
                    WHEN round(grade, 9) >= 0.85 THEN 'safe' WHEN round(grade, 9) >= 0.70 THEN 'review' ELSE 'reject' END AS decision,
               substr(sha256(CASE WHEN source_id <> '' THEN 'tm:' || player_id || ':' || source_id
                    ELSE 'composite:' || player_id || ':' || coalesce(CASE WHEN from_id <> 0 THEN from_id::VARCHAR END, 'nil') || ':'
                         || coalesce(CASE WHEN to_id <> 0 THEN to_id::VARCHAR END, 'nil') || ':' || season || ':' || bucket END), 1, 16)
                   AS fingerprint_hash
        FROM graded""",
    "outside_rows": """
        SELECT CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')[-1] || ' ' || string_split(p_name, ' ')[1]
                    WHEN 1 THEN substr(p_name, 1, 3) || substr(p_name, 5, 100) ELSE upper(p_name) END AS name,
               CASE WHEN l_suppkey % 2 = 0 THEN 'Supplier ' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') ELSE '' END AS team, lineitem.*
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "outside_names": f"""
        SELECT name, team, {sorted_words_sql('name')} AS text, {sorted_words_sql('team')} AS team_text
        FROM (SELECT DISTINCT name, team FROM outside_rows)""",
    "known_names": f"""
        SELECT {sorted_words_sql('name')} AS text, {sorted_words_sql('current_club_name')} AS club_text, player_id
        FROM players WHERE name IS NOT NULL""",
    "name_ratios": f"""
        SELECT a, b, {indel_sql('a', 'b')} AS ratio
        FROM (SELECT DISTINCT text AS a FROM outside_names), (SELECT DISTINCT text AS b FROM known_names)""",
    "team_ratios": f"""
        SELECT c, d, {indel_sql('c', 'd')} AS ratio
        FROM (SELECT DISTINCT team_text AS c FROM outside_names WHERE team_text <> ''), (SELECT DISTINCT club_text AS d FROM known_names WHERE club_text <> '')""",
    "strong_links": """
        SELECT a AS text, ratio AS score, min(player_id) AS player_id FROM name_ratios JOIN known_names k ON k.text = b
        WHERE ratio >= 85 - 1e-9 GROUP BY 1, 2""",
    "weak_links": """
        SELECT n.a AS text, t.c AS team_text, greatest(n.ratio, least(n.ratio + 15, 95)) AS score, min(player_id) AS player_id
        FROM name_ratios n JOIN known_names k ON k.text = n.b JOIN team_ratios t ON t.d = k.club_text AND t.ratio >= 80 - 1e-9
        WHERE n.ratio >= 70 - 1e-9 AND n.ratio < 85 AND least(n.ratio + 15, 95) >= 85 GROUP BY 1, 2, 3""",
    "links": """
        SELECT name, team, arg_min(player_id, {'s': -score, 'p': player_id}) AS player_id, max(score) AS match_score
        FROM (SELECT o.name, o.team, s.score, s.player_id FROM outside_names o LEFT JOIN strong_links s ON s.text = o.text
              UNION ALL SELECT o.name, o.team, w.score, w.player_id FROM outside_names o JOIN weak_links w
              ON w.text = o.text AND w.team_text = o.team_text)
        GROUP BY 1, 2""",
    "base": """
        SELECT t.transfer_id AS pair_id, t.player_id, p.name AS player_name, t.from_club_id AS selling_club_id,
               fc.name AS selling_club_name, coalesce(fc.domestic_competition_id, 'UNKNOWN') AS selling_league,
               coalesce(fc.league_tier, 0) AS selling_league_tier, t.to_club_id AS buying_club_id, bc.name AS buying_club_name,
               coalesce(bc.domestic_competition_id, 'UNKNOWN') AS buying_league, coalesce(bc.league_tier, 0) AS buying_league_tier,
               t.transfer_date, t.buy_fee, t.sell_fee, t.roi_pct, t.is_gem, t.gem_tier, t.age_at_transfer AS age_at_buy,
               CASE WHEN month(t.transfer_date) >= 7 THEN 'summer' ELSE 'winter' END AS transfer_window, t.tenure_years, t.profit,
               p.position, p.position_bucket, p.citizenship, p.citizenship_region, p.agent_name, p.agent_cluster,
               p.height_in_cm, p.foot, p.date_of_birth
        FROM paired t JOIN derived_players p ON p.player_id = t.player_id
        LEFT JOIN tiered_clubs fc ON fc.club_id = t.from_club_id LEFT JOIN tiered_clubs bc ON bc.club_id = t.to_club_id
        WHERE t.is_training_eligible = 1 AND t.roi_pct IS NOT NULL""",
    "app_sums": """
        SELECT b.pair_id, coalesce(sum(a.minutes_played), 0)::BIGINT AS minutes, coalesce(sum(a.goals), 0)::BIGINT AS goals,
               coalesce(sum(a.assists), 0)::BIGINT AS assists, coalesce(sum(a.yellow_cards), 0)::BIGINT AS yellow,
               coalesce(sum(a.red_cards), 0)::BIGINT AS red, count(DISTINCT a.game_id) AS games,
               coalesce(sum(CASE WHEN a.date >= b.transfer_date - 365 THEN a.minutes_played END), 0)::BIGINT AS last,
               coalesce(sum(CASE WHEN a.date < b.transfer_date - 365 THEN a.minutes_played END), 0)::BIGINT AS prev
        FROM base b LEFT JOIN appearances a ON a.player_id = b.player_id AND a.player_club_id = b.selling_club_id
         AND a.date >= b.transfer_date - 730 AND a.date < b.transfer_date AND a.minutes_played > 0
        GROUP BY b.pair_id""",
    "app_features": """
        SELECT pair_id, CASE WHEN minutes > 0 THEN goals::DOUBLE / minutes * 90 END AS goals_per_90,
               CASE WHEN minutes > 0 THEN assists::DOUBLE / minutes * 90 END AS assists_per_90,
               CASE WHEN minutes > 0 THEN (goals + assists)::DOUBLE / minutes * 90 END AS g_plus_a_per_90,
               last AS minutes_last_season, prev AS minutes_prev_season,
               CASE WHEN prev > 0 THEN last::DOUBLE / prev END AS minutes_trend, games AS games_played,
               CASE WHEN minutes > 0 THEN (yellow + 2 * red)::DOUBLE / minutes * 90 END AS cards_per_90,
               CASE WHEN minutes >= 900 THEN 1 ELSE 0 END AS has_appearance_data
        FROM app_sums""",
    "mv_points": """
        SELECT b.pair_id, b.buy_fee, max(v.market_value_in_eur) AS peak,
               first(v.market_value_in_eur ORDER BY abs(v.date - (b.transfer_date - 365)), v.date, v.market_value_in_eur)
                 FILTER (WHERE v.market_value_in_eur IS NOT NULL) AS nearest
        FROM base b LEFT JOIN valuations v ON v.player_id = b.player_id AND v.date <= b.transfer_date - 30
        GROUP BY b.pair_id, b.buy_fee""",
    "mv_features": """
        SELECT pair_id, peak AS mv_at_transfer, nearest AS mv_12mo_before,
               CASE WHEN nearest > 0 THEN (peak - nearest) / nearest END AS mv_trend,
               CASE WHEN peak > 0 AND buy_fee > 0 THEN buy_fee / peak END AS fee_vs_mv,
               CASE WHEN peak > 0 AND buy_fee > 0 THEN peak / buy_fee END AS peak_mv_to_fee
        FROM mv_points""",
    "xg_one": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY minutes DESC, competition_id) AS rn
                       FROM player_xg WHERE minutes > 0) WHERE rn = 1""",
    "xg_rates": """
        SELECT b.pair_id, x.xg / x.minutes * 90 AS xg_per_90, x.xa / x.minutes * 90 AS xa_per_90,
               x.goals::DOUBLE / x.minutes * 90 - x.xg / x.minutes * 90 AS goals_vs_xg,
               CASE WHEN x.player_id IS NULL THEN 0 ELSE 1 END AS has_xg_data
        FROM base b LEFT JOIN xg_one x ON x.player_id = b.player_id
         AND x.season = (year(b.transfer_date) - 1) || '/' || year(b.transfer_date)""",
}


#: Rounds of the repair loop that the blocks spell out.
ROUNDS = 3
PER_LEDGER = ("unpaired", "lagged", "breaks", "impossible", "dup_transfers", "missing_first", "graph_totals", "health")
PER_OFFER = ("matches0", "matches", "best", "graded", "scored")


def of_round(block: str, number: int, sources: dict[str, str]) -> str:
    """A block over the ledger and offers of a round of the repair loop."""
    names = {**{name: f"{name}_{number}" for name in (*PER_LEDGER, *PER_OFFER)}, **sources}
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m.group()], BLOCKS[block])


def repair_blocks() -> dict[str, str]:
    """The repair loop round by round, each on the whole ledger: ``ledger_n`` and ``health_n`` before round n, its ``need_n``,
    ``scored_n`` and ``inserts_n``, and ``tried_n``, the players given up so far."""
    blocks = {"ledger_1": "SELECT *, CASE WHEN transfer_id % 10 = 0 THEN 'x' || transfer_id END AS source_id FROM transfers"}
    for n in range(1, ROUNDS + 2):
        if n > 1:
            blocks[f"ledger_{n}"] = f"""
        SELECT transfer_id, player_id, from_club_id, to_club_id, transfer_date, transfer_fee, from_club_name, to_club_name, transfer_season,
               source_id FROM ledger_{n - 1}
        UNION ALL SELECT -candidate_id, player_id, from_id, to_id, on_date, fee, raw_from_name, raw_to_name, season, source_id FROM inserts_{n - 1}"""
        for name in PER_LEDGER:
            blocks[f"{name}_{n}"] = of_round(name, n, {"transfers": f"ledger_{n}", "transfers0": f"ledger_{n}"})
        if n > ROUNDS:
            break
        given_up = f" WHERE player_id NOT IN (SELECT player_id FROM tried_{n - 1})" if n > 1 else ""
        blocks[f"need_{n}"] = f"SELECT DISTINCT player_id FROM unpaired_{n}{given_up}"
        blocks[f"offers_{n}"] = f"SELECT * FROM candidate_prints WHERE player_id IN (SELECT player_id FROM need_{n})"
        blocks[f"prints_{n}"] = f"""
        SELECT transfer_id, player_id, from_club_id AS from_id, to_club_id AS to_id, {strip_sql('from_club_name')} AS from_name,
               {strip_sql('to_club_name')} AS to_name, transfer_season AS season, {bucket_sql('transfer_fee')} AS bucket, source_id
        FROM ledger_{n} WHERE player_id IN (SELECT player_id FROM need_{n})"""
        for name in PER_OFFER:
            blocks[f"{name}_{n}"] = of_round(name, n, {"candidate_prints": f"offers_{n}", "ledger_prints": f"prints_{n}"})
        blocks[f"inserts_{n}"] = f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, fingerprint_hash ORDER BY candidate_id) AS rn FROM scored_{n}
          WHERE (decision = 'safe' OR (decision = 'review' AND score >= 0.85)) AND year(on_date) >= 1995) WHERE rn = 1"""
        earlier = f"SELECT player_id FROM tried_{n - 1} UNION " if n > 1 else ""
        blocks[f"tried_{n}"] = f"{earlier}(SELECT player_id FROM need_{n} EXCEPT SELECT player_id FROM inserts_{n})"
    return blocks


BLOCKS |= repair_blocks()


def iteration_sql(n: int) -> str:
    """What the loop reports of round ``n``; no row if no player is in need."""
    previous = f"(SELECT count(*) FROM inserts_{n - 1})" if n > 1 else "NULL::BIGINT"
    return f"""
    SELECT *, CASE WHEN unpaired <= 10 AND inserted = 0 AND previous_inserted = 0 AND health >= 0.95 THEN 'triple_signal_convergence'
                   ELSE 'open' END AS status
    FROM (SELECT {n} AS iteration, (SELECT count(*) FROM need_{n}) AS players, (SELECT count(*) FROM inserts_{n}) AS inserted,
                 {previous} AS previous_inserted, count(*) FILTER (WHERE score >= 0.9) AS high,
                 count(*) FILTER (WHERE score >= 0.7 AND score < 0.9) AS medium, count(*) FILTER (WHERE score < 0.7) AS low,
                 (SELECT count(*) FROM unpaired_{n + 1}) AS unpaired, (SELECT graph_health_score FROM health_{n + 1}) AS health
          FROM scored_{n}) WHERE players > 0"""


def with_blocks(sql: str) -> str:
    """Prefix the blocks a query needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(BLOCKS[name])

    visit(sql)
    blocks = [f"{name} AS ({BLOCKS[name]})" for name in BLOCKS if name in needed]
    return (f"WITH {', '.join(blocks)}\n{sql}" if blocks else sql).strip()
