"""Scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions import identity, labels, parsing, returns, similarity
from ledgerloom.operators import chains, features, matching, views
from ledgerloom.registry.base import (
    bucket_sql, gem_sql, indel_sql, position_sql, query, region_sql, rounded, season_sql, sorted_words_sql, strip_sql,
)
from ledgerloom.registry.filters import scored_clubs
from ledgerloom.registry.joins import training_base
from ledgerloom.sources import documents
from ledgerloom.sources.driver_tables import pick


@query("fn_parse_int", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(p_size AS BIGINT) WHEN 2 THEN NULL END AS value FROM part""")
def _(t):
    size = F.col("p_size")
    text = F.when(size % 4 == 0, size.cast("string")).when(size % 4 == 1, F.concat(size.cast("string"), F.lit(".0"))).when(size % 4 == 2, "abc")
    return t.raw("part").select("p_partkey", parsing.parse_int(text).alias("value"))


@query("fn_parse_float", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS value FROM part")
def _(t):
    text = F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice").cast("string")).otherwise("n.a.")
    return t.raw("part").select("p_partkey", parsing.parse_float(text).alias("value"))


@query("fn_parse_date", """
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 3 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END
                       WHEN 6 THEN NULL ELSE d END AS value
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    text = F.when(k == 6, "someday")
    for i, fmt in enumerate(("MMM d, yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd MMM yyyy", "yyyy/MM/dd")):
        text = text.when(k == i, F.date_format(d, fmt))
    return t.raw("orders").select("o_orderkey", parsing.parse_date(text).alias("value"))


@query("fn_parse_money", """
    SELECT p_partkey, round(CASE p_size % 6 WHEN 0 THEN p_retailprice * 1e9 WHEN 1 THEN p_retailprice * 1e6 WHEN 2 THEN p_retailprice * 1e3
           WHEN 3 THEN p_retailprice * 1e3 WHEN 4 THEN p_retailprice END, 2) AS value FROM part""")
def _(t):
    k, p = F.col("p_size") % 6, F.col("p_retailprice").cast("string")
    text = F.when(k == 5, "x")
    for i, suffix in enumerate(("bn", "m", "k", "Th.", "")):
        text = text.when(k == i, F.concat(F.lit(" €"), p, F.lit(suffix)))
    return t.raw("part").select("p_partkey", F.round(parsing.parse_money(text), 2).alias("value"))


@query("fn_parse_fee", """
    SELECT p_partkey, round(CASE p_size % 6 WHEN 3 THEN p_partkey + 1500000.0::DOUBLE WHEN 4 THEN p_retailprice * 1e6 END, 2) AS value FROM part""")
def _(t):
    k, p = F.col("p_size") % 6, F.col("p_retailprice").cast("string")
    grouped = F.regexp_replace((F.col("p_partkey") + 1500000).cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
    text = (F.when(k == 0, "Free Transfer").when(k == 1, " End of loan").when(k == 2, "?").when(k == 3, grouped)
            .when(k == 4, F.concat(F.lit("€"), p, F.lit("m"))).otherwise("retired"))
    return t.raw("part").select("p_partkey", F.round(parsing.parse_fee(text), 2).alias("value"))


@query("fn_parse_height", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size + 150.0::DOUBLE WHEN 1 THEN p_size + 150.0::DOUBLE END AS value FROM part")
def _(t):
    k, cm = F.col("p_size") % 3, F.col("p_size") + 150
    metres = F.concat(F.floor(cm / 100).cast("string"), F.lit(","), F.lpad((cm % 100).cast("string"), 2, "0"), F.lit(" m"))
    text = F.when(k == 0, metres).when(k == 1, F.concat(cm.cast("string"), F.lit(" cm"))).otherwise("tall")
    return t.raw("part").select("p_partkey", parsing.parse_height_cm(text).alias("value"))


@query("fn_join_citizenship", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type || ', ' || p_brand END AS value FROM part")
def _(t):
    names = F.array(F.concat(F.lit(" "), F.col("p_type")), F.lit("  "), F.lit(None).cast("string"), F.col("p_brand"))
    empty = F.array(F.lit(""), F.lit(None).cast("string"))
    return t.raw("part").select("p_partkey", parsing.join_citizenship(F.when(F.col("p_size") % 5 == 0, empty).otherwise(names)).alias("value"))


@query("fn_profit", "SELECT buy_transfer_id, profit FROM matched")
def _(t):
    return t.matched.select("buy_transfer_id", returns.profit(F.col("buy_fee"), F.col("sell_fee")).alias("profit"))


@query("fn_roi", "SELECT buy_transfer_id, round(roi_pct, 6) AS roi_pct FROM matched")
def _(t):
    return t.matched.select("buy_transfer_id", F.round(returns.roi_pct(F.col("buy_fee"), F.col("sell_fee")), 6).alias("roi_pct"))


@query("fn_tenure", "SELECT buy_transfer_id, tenure_days, round(tenure_years, 6) AS tenure_years FROM matched")
def _(t):
    return rounded(t.matched.select("buy_transfer_id", "tenure_days", "tenure_years"), "tenure_years")


@query("fn_annualized", "SELECT buy_transfer_id, round(annualized_roi_pct, 6) AS annualized_roi_pct FROM matched")
def _(t):
    return rounded(t.matched.select("buy_transfer_id", "annualized_roi_pct"), "annualized_roi_pct")


@query("fn_value_creation", "SELECT buy_transfer_id, round(value_creation_pct, 6) AS value_creation_pct FROM pairs")
def _(t):
    return rounded(t.pairs.select("buy_transfer_id", "value_creation_pct"), "value_creation_pct")


@query("fn_calc_profit_roi", """
    SELECT buy_transfer_id, coalesce(CASE WHEN tenure_days % 2 = 0 THEN profit END, sell_fee - buy_fee) AS profit,
           round(coalesce(CASE WHEN tenure_days % 2 = 0 THEN roi_pct END, (sell_fee - buy_fee) / buy_fee * 100), 6) AS roi_pct FROM matched""")
def _(t):
    keep = F.col("tenure_days") % 2 == 0
    buy, sell = F.col("buy_fee"), F.col("sell_fee")
    return t.matched.select(
        "buy_transfer_id", returns.filled_profit(F.when(keep, F.col("profit")), buy, sell).alias("profit"),
        F.round(returns.filled_roi(F.when(keep, F.col("roi_pct")), buy, sell), 6).alias("roi_pct"))


@query("fn_age_at", "SELECT transfer_id, round(age_at_transfer, 6) AS age_at_transfer FROM ledger")
def _(t):
    return rounded(t.ledger.select("transfer_id", "age_at_transfer"), "age_at_transfer")


@query("fn_classify_transfer", "SELECT transfer_id, transfer_type FROM typed")
def _(t):
    return chains.typed(t.transfers).select("transfer_id", "transfer_type")


@query("fn_gem_tier", f"SELECT buy_transfer_id, {gem_sql()} AS gem_tier, CAST(roi_pct >= 100 AS INTEGER) AS is_gem FROM matched")
def _(t):
    roi = F.col("roi_pct")
    return t.matched.select("buy_transfer_id", labels.gem_tier(roi).alias("gem_tier"), labels.is_gem(roi).alias("is_gem"))


@query("fn_training_eligible", "SELECT transfer_id, is_training_eligible FROM paired")
def _(t):
    return t.paired.select("transfer_id", "is_training_eligible")


@query("fn_transfer_window", "SELECT transfer_id, CASE WHEN month(transfer_date) >= 7 THEN 'summer' ELSE 'winter' END AS transfer_window FROM transfers0")
def _(t):
    return t.transfers.select("transfer_id", labels.transfer_window(F.col("transfer_date")).alias("transfer_window"))


@query("fn_season", f"SELECT transfer_id, {season_sql('transfer_date')} AS season FROM transfers0")
def _(t):
    return t.transfers.select("transfer_id", labels.season(F.col("transfer_date")).alias("season"))


@query("fn_season_label_xg", "SELECT transfer_id, (year(transfer_date) - 1) || '/' || year(transfer_date) AS season FROM transfers0")
def _(t):
    return t.transfers.select("transfer_id", labels.xg_season(F.col("transfer_date")).alias("season"))


@query("fn_position_bucket", f"SELECT player_id, {position_sql('position')} AS position_bucket FROM players")
def _(t):
    return t.players.select("player_id", labels.position_bucket(F.col("position")).alias("position_bucket"))


@query("fn_region", f"SELECT player_id, {region_sql('citizenship')} AS citizenship_region FROM players")
def _(t):
    return t.players.select("player_id", labels.citizenship_region(F.col("citizenship")).alias("citizenship_region"))


@query("fn_agent_cluster", "SELECT player_id, agent_cluster FROM derived_players")
def _(t):
    return t.derived_players.select("player_id", "agent_cluster")


@query("fn_league_tier", "SELECT league_id, gem_rate, tier FROM tiers")
def _(t):
    from ledgerloom.operators import gems
    from ledgerloom.sources.driver_tables import TIER_CUTS
    return gems.league_tiers(gems.league_gem_rate(t.paired, t.clubs), TIER_CUTS).select("league_id", "gem_rate", "tier")


@query("fn_fee_bucket", f"SELECT transfer_id, {bucket_sql('transfer_fee * 20')} AS bucket FROM transfers0")
def _(t):
    return t.transfers.select("transfer_id", labels.fee_bucket(F.col("transfer_fee") * 20).alias("bucket"))


CLUB_WORDS = ["FC ", "fc Club ", "SC ", "A.F.C. ", "Real ", "TSV VfL "]


@query("fn_norm_club_name", f"""
    SELECT s_suppkey, {strip_sql('n')} AS name FROM (
        SELECT s_suppkey, ' ' || (['FC ', 'fc Club ', 'SC ', 'A.F.C. ', 'Real ', 'TSV VfL '])[1 + s_suppkey % 6] || s_name AS n FROM supplier)""")
def _(t):
    name = F.concat(F.lit(" "), pick(CLUB_WORDS, F.col("s_suppkey") % 6), F.col("s_name"))
    return t.raw("supplier").select("s_suppkey", identity.normal_club_name(name).alias("name"))


@query("fn_fold_accents", r"""
    SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS folded FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", similarity.fold_accents(F.col("text")).alias("folded"))


@query("fn_slug", "SELECT p_partkey, lower(replace(trim(p_name), ' ', '-')) || '-' || lower(p_type) || CAST(p_size AS VARCHAR) AS slug FROM part")
def _(t):
    name = F.concat(F.lit("  "), F.upper("p_name"), F.lit("  "), F.col("p_type"), F.lit("'."), F.col("p_size").cast("string"), F.lit(" -"))
    return t.raw("part").select("p_partkey", parsing.slug(name).alias("slug"))


@query("fn_club_code_slug", """
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name END AS code FROM supplier""")
def _(t):
    k = F.col("s_suppkey") % 3
    url = F.when(k == 0, F.concat(F.lit("/"), F.col("s_name"), F.lit("/startseite/verein/1/"))).when(
        k == 1, "/startseite/verein/2").otherwise(F.col("s_name"))
    return t.raw("supplier").select("s_suppkey", parsing.club_code_from_url(url).alias("code"))


@query("fn_fingerprint_hash", "SELECT candidate_id, fingerprint_hash FROM scored")
def _(t):
    c = matching.fingerprints(t.candidates, derive_season=True)
    return c.select("candidate_id", identity.fingerprint_hash(
        F.col("player_id"), F.col("source_id"), F.col("from_id"), F.col("to_id"), F.col("season"), F.col("bucket")
    ).alias("fingerprint_hash"))


SELF = """
    SELECT c.candidate_id, round(m.score, 3) AS score, array_to_string(why, '|') AS reasons
    FROM matches m JOIN candidate_prints c ON c.candidate_id = m.candidate_id AND m.transfer_id = c.candidate_id"""


@query("fn_match_score", SELF)
def _(t):
    """Every candidate against the ledger row it was made from."""
    c = matching.fingerprints(t.candidates, derive_season=True)
    own = matching.fingerprints(t.sourced, derive_season=False).select(
        F.col("transfer_id").alias("candidate_id"), *[F.col(f).alias(f"l_{f}") for f in matching.FIELDS])
    evidence = identity.match_evidence(F.col, lambda f: F.col(f"l_{f}"))
    same = identity.same_source(F.col("source_id"), F.col("l_source_id"))
    score = F.when(same, 1.0).otherwise(identity.score_of(evidence))
    reasons = F.when(same, F.lit(identity.SAME_SOURCE)).otherwise(F.array_join(identity.reasons_of(evidence), "|"))
    return c.join(own, "candidate_id").select("candidate_id", F.round(score, 3).alias("score"), reasons.alias("reasons"))


@query("fn_confidence", "SELECT candidate_id, score, decision, array_to_string(reasons, '|') AS reasons FROM scored")
def _(t):
    return matching.scored(t.candidates, t.sourced).select("candidate_id", "score", "decision", F.array_join("reasons", "|").alias("reasons"))


@query("fn_token_sort_ratio", f"""
    SELECT p_partkey, round({indel_sql('a', 'b')}, 6) AS ratio FROM (
        SELECT p_partkey, {sorted_words_sql('p_name')} AS a, {sorted_words_sql("p_type || ' ' || reverse(p_name) || ' ' || p_brand")} AS b FROM part)""")
def _(t):
    """Part names against their type and brand."""
    other = F.concat_ws(" ", "p_type", F.reverse(F.col("p_name")), "p_brand")
    ratio = similarity.token_sort_ratio(F.lower("p_name"), F.lower(other))
    return t.raw("part").select("p_partkey", F.round(ratio, 6).alias("ratio"))


@query("fn_log_fee", "SELECT transfer_id, round(CASE WHEN transfer_fee > 0 THEN ln(transfer_fee + 1) END, 6) AS log_fee FROM transfers0")
def _(t):
    return t.transfers.select("transfer_id", F.round(returns.log_fee(F.col("transfer_fee")), 6).alias("log_fee"))


def hot_sql(value, prefix, words, other):
    known = ", ".join(f"'{w}'" for w in words if w != other)
    cells = [f"CAST(coalesce({value}, '') = '{w}' AS INTEGER) AS \"{prefix}_{w}\"" for w in words if w != other]
    return ", ".join(cells) + f", CAST(coalesce({value}, '') NOT IN ({known}) AS INTEGER) AS \"{prefix}_{other}\""


HOT = ", ".join([
    hot_sql("position_bucket", "pos", C.POSITION_VOCAB, "Other"),
    hot_sql("upper(substr(foot, 1, 1)) || lower(substr(foot, 2))", "foot", C.FOOT_VOCAB, "Unknown"),
    hot_sql("citizenship_region", "region", C.REGION_VOCAB, "Unknown"),
    hot_sql("agent_cluster", "agent", C.AGENT_VOCAB, "Unknown"),
])


@query("fn_one_hot", f"SELECT pair_id, {HOT} FROM base")
def _(t):
    rows = features.profile_features(training_base(t))
    return rows.drop("age_at_buy", "height_in_cm", "is_international", "is_other_position")


@query("fn_league_jump", "SELECT pair_id, buying_league_tier - selling_league_tier AS league_jump FROM base")
def _(t):
    return features.context_features(training_base(t)).select("pair_id", "league_jump")


XG = ["xg_per_90", "xa_per_90", "goals_vs_xg"]


@query("fn_xg_rates", "SELECT pair_id, has_xg_data, " + ", ".join(f"round({c}, 6) AS {c}" for c in XG) + " FROM xg_rates")
def _(t):
    return rounded(features.xg_features(training_base(t), t.player_xg), *XG)


EURO = """
    CASE WHEN a >= 1e9 THEN s || '€' || printf('%.1f', floor(a / 1e9 * 10 + 0.5) / 10) || 'B'
         WHEN a >= 1e6 THEN s || '€' || printf('%.1f', floor(a / 1e6 * 10 + 0.5) / 10) || 'M'
         WHEN a >= 1e3 THEN s || '€' || printf('%.1f', floor(a / 1e3 * 10 + 0.5) / 10) || 'K'
         WHEN a IS NULL THEN '' ELSE s || '€' || CAST(CAST(floor(a + 0.5) AS BIGINT) AS VARCHAR) END"""


@query("fn_format_euro", f"""
    SELECT transfer_id, {EURO} AS text FROM (SELECT transfer_id, abs(v) AS a, CASE WHEN v < 0 THEN '-' ELSE '' END AS s FROM (
        SELECT transfer_id, CASE to_club_id % 4 WHEN 0 THEN transfer_fee WHEN 1 THEN -transfer_fee / 10 WHEN 2 THEN transfer_fee * 1000
               ELSE transfer_fee / 100000 END AS v FROM transfers0))""")
def _(t):
    k, fee = F.col("to_club_id") % 4, F.col("transfer_fee")
    amount = F.when(k == 0, fee).when(k == 1, -fee / 10).when(k == 2, fee * 1000).otherwise(fee / 100000)
    return t.transfers.select("transfer_id", labels.format_euro(amount).alias("text"))


@query("fn_league_name", """
    SELECT club_id, CASE club_id % 3 WHEN 0 THEN 'Eredivisie' WHEN 1 THEN 'Scottish Premiership' ELSE domestic_competition_id END AS league FROM clubs""")
def _(t):
    k = F.col("club_id") % 3
    code = F.when(k == 0, "NL1").when(k == 1, "SC1").otherwise(F.col("domestic_competition_id"))
    return t.clubs.select("club_id", F.coalesce(labels.league_name(code), code).alias("league"))


@query("fn_opponent", """
    SELECT transfer_id, CASE WHEN to_club_name = home THEN away ELSE home END AS opponent FROM (
        SELECT transfer_id, to_club_name, coalesce(from_club_name, 'none') AS away,
               CASE WHEN transfer_fee > 0 THEN to_club_name ELSE 'Visitors' END AS home FROM transfers)""")
def _(t):
    away = F.coalesce("from_club_name", F.lit("none"))
    home = F.when(F.col("transfer_fee") > 0, F.col("to_club_name")).otherwise("Visitors")
    return t.transfers.select("transfer_id", documents.opponent(F.col("to_club_name"), home, away).alias("opponent"))


@query("fn_badge_label", """
    SELECT transfer_id, CASE transfer_type WHEN 'paid' THEN 'Paid' WHEN 'loan' THEN 'Loan' WHEN 'youth_promotion' THEN 'Youth'
        WHEN 'sent_to_reserves' THEN 'Reserves' WHEN 'contract_expired' THEN 'Expired' WHEN 'retired' THEN 'Retired'
        WHEN 'free_transfer' THEN 'Free' ELSE '' END AS label FROM typed""")
def _(t):
    return chains.typed(t.transfers).select("transfer_id", labels.badge_label(F.col("transfer_type")).alias("label"))


@query("fn_compare_radar", """
    SELECT club_id, name AS club, metric, round(value, 4) AS value FROM (
        SELECT club_id, name, 'Median ROI' AS metric, coalesce(median_roi, 0) AS value FROM scored_clubs
        UNION ALL SELECT club_id, name, 'Hit Rate', coalesce(hit_rate, 0) FROM scored_clubs
        UNION ALL SELECT club_id, name, 'Composite', coalesce(composite_score, 0) * 100 FROM scored_clubs
        UNION ALL SELECT club_id, name, 'Value Creation', coalesce(value_creation, 0) FROM scored_clubs)
    WHERE club_id IN (8, 17)""")
def _(t):
    return rounded(views.compare_radar(scored_clubs(t), 8, 17), "value", digits=4)


@query("fn_fuzzy_search", """
    SELECT club_id, name, round(0.7::DOUBLE * n + 0.3::DOUBLE * l, 6) AS score FROM (
        SELECT club_id, name, CASE WHEN contains(lower(name), 'supplier#00000001') THEN 0 ELSE
                   levenshtein(lower(name), 'supplier#00000001')::DOUBLE / greatest(length(name), 17) END AS n,
               CASE WHEN contains(lower(domestic_competition_id), 'supplier#00000001') THEN 0 ELSE
                   levenshtein(lower(domestic_competition_id), 'supplier#00000001')::DOUBLE / greatest(length(domestic_competition_id), 17) END AS l
        FROM clubs) WHERE least(n, l) <= 0.4""")
def _(t):
    return views.fuzzy_search(t.clubs, " Supplier#00000001 ").select("club_id", "name", "score")


@query("fn_window_flip", "SELECT buy_transfer_id, tenure_days < 180 AS is_flip FROM matched")
def _(t):
    return t.matched.select("buy_transfer_id", returns.is_window_flip(F.col("tenure_days")).alias("is_flip"))


@query("fn_loan_option", """
    SELECT transfer_id FROM transfers0 l WHERE transfer_id IN (SELECT transfer_id FROM loans)
      AND EXISTS (SELECT 1 FROM transfers0 p WHERE p.player_id = l.player_id AND p.to_club_id = l.to_club_id AND p.transfer_fee > 0
                  AND p.transfer_date - l.transfer_date BETWEEN 1 AND 548)""")
def _(t):
    return chains.loan_with_option(t.transfers).select("transfer_id")
