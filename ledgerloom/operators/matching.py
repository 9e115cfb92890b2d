"""Candidate transfers against the ledger: best fingerprint match, confidence, inserts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ledgerloom import constants as C
from ledgerloom.functions import identity, labels, returns
from ledgerloom.session import checkpointed

FIELDS = ["from_id", "to_id", "from_name", "to_name", "season", "bucket", "source_id"]


def fingerprints(transfers: DataFrame, derive_season: bool) -> DataFrame:
    """Adds normalised names, season and fee bucket. Candidates derive a missing season
    from the date; ledger rows keep what is stored."""
    stored = F.when(F.col("transfer_season") != "", F.col("transfer_season"))
    season = F.coalesce(stored, labels.season(F.col("transfer_date"))) if derive_season else stored
    return transfers.withColumns({
        "from_id": F.col("from_club_id"), "to_id": F.col("to_club_id"),
        "from_name": identity.normal_club_name(F.col("from_club_name")),
        "to_name": identity.normal_club_name(F.col("to_club_name")),
        "season": season, "bucket": labels.fee_bucket(F.col("transfer_fee")),
        "source_id": F.col("source_id") if "source_id" in transfers.columns else F.lit(None).cast("string"),
    })


def _collapsed(ledger: DataFrame) -> DataFrame:
    """One row per distinct fingerprint; the lowest transfer id stands for it."""
    prints = fingerprints(ledger, derive_season=False)
    return prints.groupBy("player_id", *FIELDS).agg(F.min("transfer_id").alias("ledger_id"))


def _best(scored: DataFrame) -> DataFrame:
    """Highest score per candidate; equal scores go to the lowest ledger id."""
    top = F.max(F.struct("score", (-F.col("ledger_id")).alias("neg_id"))).alias("m")
    return scored.groupBy("candidate_id").agg(top).select(
        "candidate_id", "m.score", (-F.col("m.neg_id")).alias("ledger_id"))


def _prefixed(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.select(*keys, *[F.col(f).alias(f"l_{f}") for f in FIELDS])


def _evidence() -> list[identity.Evidence]:
    return identity.match_evidence(F.col, lambda f: F.col(f"l_{f}"))


#: Fields that a row may lack, one bit each; ids are compared where both rows have one, else names where both have one.
HELD = {"from_id": 1, "from_name": 2, "to_id": 4, "to_name": 8, "season": 16}
ID, NAME = 1, 2
CLUB_POINTS = {0: 0, ID: 35, NAME: 25}
OTHER_POINTS = 15
#: Least score of each wave of look-ups; a candidate that one wave finds a row for is not looked up by the next.
WAVES = (1.0, 0.8, 0.5, 0.0)
#: Up to this many candidates one wave looks up all scores: a wave is four jobs, which cost more than so few look-ups.
FEW = 50_000
KEY = ["player_id", "code", "f", "t", "s", "b"]


def _held() -> Column:
    has = {f: F.col(f).isNotNull() if f.endswith("_id") else F.coalesce(F.col(f) != "", F.lit(False)) for f in HELD}
    return sum((F.when(has[f], bit).otherwise(0) for f, bit in HELD.items()), F.lit(0))


def agreements(mine: int, theirs: int) -> list[tuple]:
    """What two rows that hold these fields may agree on: kind of each club side, season, bucket; and the score of that."""
    both = mine & theirs

    def side(name: str) -> int:
        return ID if both & HELD[f"{name}_id"] else NAME if both & HELD[f"{name}_name"] else 0

    origin, target, season = side("from"), side("to"), int(bool(both & HELD["season"]))
    available = CLUB_POINTS[origin] + CLUB_POINTS[target] + OTHER_POINTS * (season + 1)
    return [(f, t, s, b, (CLUB_POINTS[f] + CLUB_POINTS[t] + OTHER_POINTS * (s + b)) / available)
            for f, t, s, b in product({0, origin}, {0, target}, {0, season}, (0, 1))]


def _code(theirs: int, f: int, t: int, s: int, b: int) -> int:
    return (((theirs * 3 + f) * 3 + t) * 2 + s) * 2 + b


def _keyed(rows: DataFrame, shapes: list[tuple], *more: str) -> DataFrame:
    """A row for each shape of its kind (``held``), with the values that the shape compares. At most 32 x 32 x 16 shapes are sent."""
    names = [*more, "held", "code", "f_kind", "t_kind", "s_kind", "b_kind"]
    kinds = [f"{n} {'double' if n == 'score' else 'int'}" for n in names]
    sent = F.broadcast(rows.sparkSession.createDataFrame(shapes, ", ".join(kinds)))

    def club(kind: str, by_id: str, by_name: str) -> Column:
        return F.when(F.col(kind) == ID, F.col(by_id).cast("string")).when(F.col(kind) == NAME, F.col(by_name)).otherwise("")

    return rows.join(sent, "held").withColumns({
        "f": club("f_kind", "from_id", "from_name"), "t": club("t_kind", "to_id", "to_name"),
        "s": F.when(F.col("s_kind") == 1, F.col("season")).otherwise(""), "b": F.when(F.col("b_kind") == 1, F.col("bucket")).otherwise(""),
    })


def look_ups(candidates: DataFrame, plan: list[tuple]) -> DataFrame:
    """The keys that one wave looks up: one row for each candidate, kind of ledger row and set of fields to agree on."""
    shapes = [(score, mine, _code(theirs, *kinds), *kinds) for mine, theirs, *kinds, score in plan]
    return _keyed(candidates, shapes, "score").select("candidate_id", "score", *KEY)


def _wave(candidates: DataFrame, ledger: DataFrame, plan: list[tuple]) -> DataFrame:
    wanted = sorted({(theirs, _code(theirs, *kinds), *kinds) for _, theirs, *kinds, _ in plan})
    theirs = _keyed(ledger, wanted).groupBy(*KEY).agg(F.min("ledger_id").alias("ledger_id"))
    # merged: exploded keys are far more than the planner expects of their table, too many to broadcast
    return look_ups(candidates, plan).join(theirs.hint("merge"), KEY).select("candidate_id", "ledger_id", "score")


def wave_plans(candidates: DataFrame, ledger: DataFrame, waves: tuple[float, ...] = WAVES) -> list[list[tuple]]:
    """For each wave its look-ups: kind of candidate, kind of ledger row, fields to agree on, score. There are 32 kinds at most."""
    mine, theirs = ([r.held for r in rows.select("held").distinct().collect()] for rows in (candidates, ledger))
    every = [(m, k, *a) for m in sorted(mine) for k in sorted(theirs) for a in agreements(m, k)]
    highest = [float("inf"), *waves]
    return [[x for x in every if low <= x[-1] < high] for low, high in zip(waves, highest, strict=False)]


def _by_waves(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Best match per candidate without pairing rows, however many a player has.

    Which fields two rows can be compared on follows from the fields they hold, so a set of agreeing fields has one
    score. A wave looks up all sets of its scores. A hit scores at least what its set says, and a row that agrees on more
    would have been met by the same wave or an earlier one: the best hit of the first wave with any is the best match.
    """
    total = candidates.agg(F.count(F.lit(1))).first()[0]
    waves = WAVES
    if total <= FEW:
        waves, ledger = WAVES[-1:], ledger.join(candidates.select("player_id").distinct(), "player_id", "left_semi")
    found, left, hits = None, candidates, 0
    for number, plan in enumerate(wave_plans(candidates, ledger, waves)):
        met = _wave(left, ledger, plan)
        if number == 0:
            met = met.unionByName(_by_source(candidates, ledger))
        best = checkpointed(_best(met), "matches")
        hits += best.agg(F.count(F.lit(1))).first()[0]
        found = best if found is None else found.unionByName(best)
        if hits == total or number == len(waves) - 1:
            break
        left = checkpointed(candidates.join(found, "candidate_id", "left_anti"), "unmatched")
        # written, so that a player with a large share of the rows is split among tasks
        ledger = checkpointed(ledger.join(left.select("player_id").distinct(), "player_id", "left_semi"), "fingerprints")
    return found


def _by_source(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """The player's ledger row with the candidate's own source id, if there is one."""
    theirs = ledger.filter("source_id <> ''").groupBy("player_id", "source_id").agg(F.min("ledger_id").alias("ledger_id"))
    return candidates.join(theirs, ["player_id", "source_id"]).select("candidate_id", "ledger_id", F.lit(1.0).alias("score"))


#: Rows of one player, on either side, up to which its candidates are compared with all its ledger rows in one task.
WIDE = 2_000
#: Rows that are compared at a time, and pairs of rows that a task holds at a time.
BLOCK_ROWS, BLOCK_PAIRS = 50_000, 1_000_000
#: Scores are compared as whole numbers: every sum of available points divides this.
WHOLE = 8_751_600
#: Bits of a comparison: score, place of the ledger row among the player's (the lowest id is the highest), what agrees.
SCORE_BIT, PLACE_BIT, LAST_PLACE = 38, 7, 2**31 - 1


def player_rows(candidates: DataFrame, ledger: DataFrame) -> tuple[int, DataFrame | None]:
    """All rows of both sides; and the players (NULL is one) with more than ``WIDE`` of them on either side, if any."""
    counts = [rows.groupBy("player_id").agg(F.count(F.lit(1)).alias("_n")) for rows in (candidates, ledger)]
    stored = checkpointed(counts[0].unionByName(counts[1]), "player-rows")
    total, wide = stored.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col("_n") > WIDE)).first()
    return total, stored.filter(F.col("_n") > WIDE).select("player_id").distinct() if wide else None


def _split(rows: DataFrame, wide: DataFrame, how: str) -> DataFrame:
    return rows.join(wide, rows["player_id"].eqNullSafe(wide["player_id"]), how)


def _codes(mine: pa.Table, theirs: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of a column, the same on both sides; -1 for NULL and empty text."""
    values = pa.chunked_array([*mine.column(name).chunks, *theirs.column(f"l_{name}").chunks], mine.schema.field(name).type).combine_chunks()
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = pc.if_else(pc.equal(values, ""), None, values)
    codes = pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return codes[:len(mine)], codes[len(mine):]


def _best_of_block(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    """``_best`` (null without a ledger row of the player) and ``ledger_id`` for each candidate of a block of players.

    A comparison is one number, so that the best of a candidate is a maximum, and what agrees is part of it.
    """
    if not len(mine):
        return pa.table({})
    if not len(theirs):
        theirs = mine.slice(0, 0).rename_columns([f"l_{c}" for c in mine.column_names]).append_column("ledger_id", pa.array([], pa.int64()))
    player, owner = _codes(mine, theirs, "player_id")
    ids = theirs.column("ledger_id").to_numpy()
    order = np.lexsort((ids, owner))
    order = order[np.searchsorted(owner[order], 0):]
    owner, ids = owner[order], ids[order]
    fields = {f: (a, b[order]) for f, (a, b) in ((f, _codes(mine, theirs, f)) for f in FIELDS)}
    first = np.searchsorted(owner, player)
    size = np.where(player >= 0, np.searchsorted(owner, player, "right") - first, 0)
    best, found = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK_PAIRS, "right")))
        some = start + np.flatnonzero(size[start:stop])
        start = stop
        if not len(some):
            continue
        offset = np.cumsum(size[some]) - size[some]
        a = np.repeat(some, size[some])
        place = np.arange(len(a)) - np.repeat(offset, size[some])
        b = first[a] + place

        def values(field):
            return fields[field][0][a], fields[field][1][b]

        def agree(x, y):
            return (x == y) & (x >= 0)

        available, earned, bits = np.full(len(a), 15), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for side, shift in (("from", 4), ("to", 2)):
            (x, y), (u, v) = values(f"{side}_id"), values(f"{side}_name")
            ids_known, names_known = (x >= 0) & (y >= 0), (u >= 0) & (v >= 0)
            kind = np.where(ids_known, 2 * (x == y), names_known & (u == v))
            available += np.where(ids_known, 35, 25 * names_known)
            earned += np.array([0, 25, 35])[kind]
            bits |= kind << shift
        x, y = values("season")
        available += 15 * ((x >= 0) & (y >= 0))
        for field, bit in (("season", 2), ("bucket", 1)):
            same = agree(*values(field))
            earned += 15 * same
            bits |= bit * same
        source = agree(*values("source_id"))
        points = np.where(source, WHOLE, earned * WHOLE // available)
        key = (points << SCORE_BIT) + ((LAST_PLACE - place) << PLACE_BIT) + (bits | (source * identity.SOURCE_BIT))
        best[some] = np.maximum.reduceat(key, offset)
        found[some] = ids[first[some] + LAST_PLACE - ((best[some] >> PLACE_BIT) & LAST_PLACE)]
    none = size == 0
    return mine.drop_columns("_block").append_column("_best", pa.array(best, pa.int64(), mask=none)).append_column(
        "ledger_id", pa.array(found, pa.int64(), mask=none))


def _compared(candidates: DataFrame, ledger: DataFrame, total: int) -> DataFrame:
    """Each candidate against all ledger rows of its player: both sides are dealt by blocks of players once."""
    block = F.pmod(F.xxhash64("player_id"), F.lit(max(1, -(-total // BLOCK_ROWS)))).alias("_block")
    # every column has a name of its own: both sides may stem from one table
    theirs = fingerprints(ledger, derive_season=False).select(
        block.alias("_of_block"), F.col("transfer_id").alias("ledger_id"), *[F.col(f).alias(f"l_{f}") for f in ("player_id", *FIELDS)])
    # the candidates' derived columns are worked out after the shuffle
    mine = fingerprints(candidates.select("*", block).repartition("_block"), derive_season=True)
    schema = StructType([f for f in mine.schema.fields if f.name != "_block"]).add("_best", "long").add("ledger_id", "long")
    best = mine.groupBy("_block").cogroup(theirs.groupBy("_of_block")).applyInArrow(_best_of_block, schema)
    score = F.shiftright("_best", SCORE_BIT) / WHOLE
    reasons = F.when(score > 0, identity.agreed_reasons(F.col("_best"), F.col("bucket"))).otherwise(F.array().cast("array<string>"))
    return best.withColumns({"best_score": F.round(F.coalesce(score, F.lit(0.0)), 3), "best_reasons": reasons}).drop("_best")


def _looked_up(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """The same by look-ups in waves, for players with too many rows to compare all."""
    # both are read several times below, so they are written to the shared folder first
    prints = checkpointed(_collapsed(ledger).withColumn("held", _held()), "fingerprints")
    cands = checkpointed(fingerprints(candidates, derive_season=True).withColumn("held", _held()), "candidates")
    best = _by_waves(cands, prints)
    # reasons are worked out once per candidate, for the winning row only
    joined = cands.join(best, "candidate_id", "left").join(_prefixed(prints, "ledger_id"), "ledger_id", "left")
    reasons = F.when(identity.same_source(F.col("source_id"), F.col("l_source_id")), F.array(F.lit(identity.SAME_SOURCE))) \
        .when(F.col("score") > 0, identity.reasons_of(_evidence())).otherwise(F.array().cast("array<string>"))
    return joined.withColumns({
        "best_score": F.round(F.coalesce("score", F.lit(0.0)), 3), "best_reasons": reasons,
    }).drop("score", "held", *[f"l_{f}" for f in FIELDS])


def best_match(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per candidate the best match score (3 places), its reasons and the ledger row. Candidate ids are unique."""
    total, wide = player_rows(candidates, ledger)
    if wide is None:
        return _compared(candidates, ledger, total)
    usual = _compared(_split(candidates, wide, "left_anti"), _split(ledger, wide, "left_anti"), total)
    return usual.unionByName(_looked_up(_split(candidates, wide, "left_semi"), _split(ledger, wide, "left_semi")))


def scored(candidates: DataFrame, ledger: DataFrame, academy: DataFrame | None = None) -> DataFrame:
    """Candidates with score, reasons, decision and fingerprint hash."""
    return _decided(best_match(candidates, ledger), candidates.columns, academy)


def rescored(earlier: DataFrame, added: DataFrame, columns: list[str]) -> DataFrame:
    """``scored`` candidates (of these ``columns``) after the ledger grew, without reading the rows they were compared with.

    A ledger only grows, so a best score only rises: it is the earlier one or the best among the ``added`` rows. One that
    makes a duplicate is final; such candidates need not come again (see ``settled``).
    """
    rows = best_match(earlier.select(*columns, F.col("best_score").alias("_earlier")), added)
    return _decided(rows.withColumn("best_score", F.greatest("best_score", "_earlier")).drop("_earlier"), columns)


def settled() -> Column:
    """The candidate is a duplicate of a ledger row, and stays one whatever the ledger gets."""
    return F.col("best_score") >= C.INSERT_THRESHOLD


def _decided(rows: DataFrame, columns: list[str], academy: DataFrame | None = None) -> DataFrame:
    is_academy = F.lit(False)
    if academy is not None:
        rows = rows.join(academy.select("player_id").distinct().withColumn("_academy", F.lit(True)), "player_id", "left")
        is_academy = F.coalesce("_academy", F.lit(False))
    names = {"date": "transfer_date", "fee": "transfer_fee"}
    result = identity.confidence(lambda f: F.col(names.get(f, f)), F.col("best_score"), F.col("best_reasons"), is_academy)
    hashed = identity.fingerprint_hash(F.col("player_id"), F.col("source_id"), F.col("from_id"), F.col("to_id"),
                                       F.col("season"), F.col("bucket"))
    return rows.withColumn("_c", result).select(
        "candidate_id", *[c for c in columns if c != "candidate_id"], "season", "bucket", "best_score",
        F.col("_c.score").alias("score"), F.col("_c.reasons").alias("reasons"),
        F.col("_c.decision").alias("decision"), hashed.alias("fingerprint_hash"))


def to_insert(scored_rows: DataFrame, players: DataFrame, threshold: float = C.INSERT_THRESHOLD,
              min_year: int = C.MIN_YEAR, max_reasons: int | None = 5) -> DataFrame:
    """Candidates to append: not rejected, confident enough, one per fingerprint and player."""
    kept = scored_rows.filter(
        (F.col("decision") == "safe") | ((F.col("decision") == "review") & (F.col("score") >= threshold))
    ).filter(F.col("transfer_date").isNull() | (F.col("transfer_date") >= F.make_date(F.lit(min_year), F.lit(1), F.lit(1))))
    rest = [c for c in kept.columns if c not in ("player_id", "fingerprint_hash")]
    single = kept.groupBy("player_id", "fingerprint_hash").agg(
        F.min_by(F.struct(*rest), "candidate_id").alias("_row")).select("player_id", "fingerprint_hash", "_row.*")
    info = players.select("player_id", F.col("name").alias("player_name"), "date_of_birth")
    named = single.join(info, "player_id", "left")
    value = F.col("market_value_in_eur") if "market_value_in_eur" in named.columns else F.lit(None)
    reasons = F.col("reasons") if max_reasons is None else F.slice("reasons", 1, max_reasons)
    return named.select(
        "candidate_id", "player_id", "player_name", "from_club_id", "to_club_id", "from_club_name", "to_club_name",
        "transfer_date", F.col("season").alias("transfer_season"), "transfer_fee",
        value.cast("double").alias("market_value_in_eur"), "source_id",
        returns.age_years(F.col("date_of_birth"), F.col("transfer_date")).alias("age_at_transfer"),
        F.col("score").alias("confidence_score"), "fingerprint_hash",
        reasons.alias("confidence_reasons"))
