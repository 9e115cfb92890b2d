"""Transfer fingerprints and confidence scores, in integer percentage points."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ledgerloom import constants as C


def normal_club_name(name: Column) -> Column:
    """Lower case, and each known prefix taken off in turn: one anchored pass."""
    prefixes = "".join(f"(?:{re.escape(p)})?" for p in C.CLUB_PREFIXES)
    return F.when(name != "", F.regexp_replace(F.lower(F.trim(name)), "^" + prefixes, ""))


def fingerprint_hash(player: Column, source_id: Column, from_id: Column, to_id: Column,
                     season: Column, bucket: Column) -> Column:
    """First 16 hex digits of SHA-256 over the source id, or over the composite key."""
    def shown(club: Column) -> Column:
        return F.coalesce(F.when(club != 0, club.cast("string")), F.lit("nil"))

    by_source = F.concat_ws(":", F.lit("tm"), player, source_id)
    by_fields = F.concat_ws(
        ":", F.lit("composite"), player, shown(from_id), shown(to_id),
        F.coalesce(F.when(season != "", season), F.lit("noseason")), bucket,
    )
    has_source = F.coalesce(source_id != "", F.lit(False))
    return F.substring(F.sha2(F.when(has_source, by_source).otherwise(by_fields), 256), 1, 16)


@dataclass(frozen=True)
class Evidence:
    """One compared field: points available, points earned, reason when it agrees."""
    available: Column
    earned: Column
    reason: Column


def _club_evidence(side: str, id_a: Column, id_b: Column, name_a: Column, name_b: Column) -> Evidence:
    by_id = id_a.isNotNull() & id_b.isNotNull()
    by_name = (name_a != "") & (name_b != "")
    available = F.when(by_id, 35).when(by_name, 25).otherwise(0)
    earned = F.when(by_id & (id_a == id_b), 35).when(~by_id & by_name & (name_a == name_b), 25).otherwise(0)
    reason = F.when(earned == 35, f"{side}_club_id_match").when(earned == 25, f"{side}_club_name_match")
    return Evidence(available, earned, reason)


def match_evidence(a, b) -> list[Evidence]:
    """Field agreement of two fingerprints; ``a`` and ``b`` map field names to columns."""
    season_known = (a("season") != "") & (b("season") != "")
    season_same = season_known & (a("season") == b("season"))
    bucket_same = a("bucket") == b("bucket")
    return [
        _club_evidence("from", a("from_id"), b("from_id"), a("from_name"), b("from_name")),
        _club_evidence("to", a("to_id"), b("to_id"), a("to_name"), b("to_name")),
        Evidence(F.when(season_known, 15).otherwise(0), F.when(season_same, 15).otherwise(0),
                 F.when(season_same, "season_match")),
        Evidence(F.lit(15), F.when(bucket_same, 15).otherwise(0),
                 F.when(bucket_same, F.concat(F.lit("fee_bucket_match:"), a("bucket")))),
    ]


SAME_SOURCE = "exact_transfermarkt_id"


def same_source(a: Column, b: Column) -> Column:
    """Two records with one source id are the same transfer, whatever else they say."""
    return F.coalesce((a != "") & (a == b), F.lit(False))


def score_of(evidence: list[Evidence]) -> Column:
    earned = sum((e.earned for e in evidence[1:]), evidence[0].earned)
    available = sum((e.available for e in evidence[1:]), evidence[0].available)
    return earned / available


def reasons_of(evidence: list[Evidence]) -> Column:
    return F.filter(F.array(*[e.reason for e in evidence]), lambda r: r.isNotNull())


SOURCE_BIT = 64


def agreed_reasons(agreement: Column, bucket: Column) -> Column:
    """Reasons from what agrees, in seven bits: source id; origin's id, name; target's id, name; season; bucket."""
    def has(bit: int) -> Column:
        return agreement.bitwiseAND(F.lit(bit)) != 0

    found = F.array(
        F.when(has(32), "from_club_id_match").when(has(16), "from_club_name_match"),
        F.when(has(8), "to_club_id_match").when(has(4), "to_club_name_match"),
        F.when(has(2), "season_match"), F.when(has(1), F.concat(F.lit("fee_bucket_match:"), bucket)))
    return F.when(has(SOURCE_BIT), F.array(F.lit(SAME_SOURCE))).otherwise(F.filter(found, lambda r: r.isNotNull()))


def confidence(c, best_score: Column, best_reasons: Column, is_academy: Column) -> Column:
    """struct<score, reasons, decision> of a candidate given its best ledger match.

    ``c`` maps names to candidate columns: source_id, from_id, to_id, from_name, to_name,
    season, date, fee, bucket.
    """
    ids = c("from_id").isNotNull().cast("int") + c("to_id").isNotNull().cast("int")
    names = (F.coalesce(c("from_name") != "", F.lit(False)).cast("int")
             + F.coalesce(c("to_name") != "", F.lit(False)).cast("int"))
    has_season = F.coalesce(c("season") != "", F.lit(False))
    points = (
        F.when(ids == 2, 40).when(ids == 1, 20).otherwise(0)
        + F.when(names == 2, 15).when(names == 1, 8).otherwise(0)
        + F.when(has_season, 15).otherwise(0)
        + F.when(c("date").isNotNull(), 10).otherwise(0)
        + F.when(c("fee").isNotNull(), 10).when(c("bucket") != "unknown", 5).otherwise(0)
    )
    lonely = best_score < 0.3
    scaled = points / F.lit(90.0) * F.when(is_academy, 0.7).otherwise(1.0) * F.when(lonely, 0.9).otherwise(1.0)
    score = F.round(F.least(scaled, F.lit(1.0)), 3)
    graded = F.round(scaled, 9)
    decision = (
        F.when(graded >= C.INSERT_THRESHOLD, "safe").when(graded >= C.MEDIUM_CONFIDENCE, "review").otherwise("reject")
    )
    reasons = F.filter(
        F.array(
            F.when(ids == 2, "both_club_ids_present").when(ids == 1, "one_club_id_present").otherwise("no_club_ids"),
            F.when(names == 2, "both_club_names_present"),
            F.when(has_season, F.concat(F.lit("season:"), c("season"))),
            F.when(c("date").isNotNull(), "date_present"),
            F.when(c("fee").isNotNull(), F.concat(F.lit("fee:"), c("bucket")))
            .when(c("bucket") != "unknown", F.concat(F.lit("fee_bucket:"), c("bucket"))),
            F.when(is_academy, "academy_player_penalty"),
            F.when(lonely, "no_contextual_matches"),
        ),
        lambda r: r.isNotNull(),
    )
    duplicate = best_score >= C.INSERT_THRESHOLD
    has_source = F.coalesce(c("source_id") != "", F.lit(False))
    matched = F.concat(F.lit("duplicate: matched DB record with score "), best_score.cast("string"))
    return F.struct(
        F.when(duplicate, 0.0).when(has_source, 1.0).otherwise(score).alias("score"),
        F.when(duplicate, F.concat(F.array(matched), best_reasons))
        .when(has_source, F.array(F.lit("transfermarkt_id_present"))).otherwise(reasons).alias("reasons"),
        F.when(duplicate, "reject").when(has_source, "safe").otherwise(decision).alias("decision"),
    )

