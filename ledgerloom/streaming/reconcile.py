"""Detect, score, insert and validate until nothing changes any more."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ledgerloom import constants as C
from ledgerloom.operators import chains, quality
from ledgerloom.operators.gems import confidence_bands
from ledgerloom.operators.matching import rescored, scored, settled, to_insert
from ledgerloom.plans.analytics import all_pairs, club_scores
from ledgerloom.session import checkpointed, drop_table

STRATEGIES = ("broken", "silent")
ITERATION = ("iteration int, players long, inserted long, previous_inserted long, high long, medium long, low long, "
             "unpaired long, health double, status string")


@dataclass
class Outcome:
    """``added`` holds the rows that each iteration appended, a stored table for each that appended any."""

    ledger: DataFrame
    iterations: list[dict] = field(default_factory=list)
    status: str = "open"
    added: list[tuple[int, DataFrame]] = field(default_factory=list)
    scores: DataFrame | None = None


def _of(rows: DataFrame, players: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.join(players, "player_id", how)


def judged(spark, totals: dict[str, int], players: int, inserted: int, previous: int | None, open_players: int) -> dict:
    """Health and status of a ledger with these totals."""
    row = spark.range(1).select(F.lit(players).alias("total_players"), *[F.lit(v).alias(k) for k, v in totals.items()])
    status = quality.convergence(F.col("unpaired"), F.lit(inserted), F.lit(previous).cast("long"), F.col("graph_health_score"), F.lit(open_players))
    return quality.health(row).select("unpaired", F.col("graph_health_score").alias("health"), status.alias("status")).first().asDict()


def reconcile(ledger: DataFrame, candidates: DataFrame, players: DataFrame, clubs: DataFrame,
              max_iterations: int = 5, min_fee: float = 100_000, threshold: float = C.INSERT_THRESHOLD,
              min_year: int = C.MIN_YEAR, strategy: str = "broken", dry_run: bool = False,
              valuations: DataFrame | None = None) -> Outcome:
    """Repair the ledger from a table of candidates.

    Each iteration scores the candidates of players in need (``broken``: with unpaired sales; ``silent``: whose first
    paid move starts nowhere known) and appends what may be inserted. Players without inserts are not tried again
    (``broken``). Rows without a player are counted, but nothing can be inserted for them.

    Whatever an iteration looks up or counts belongs to one player, and only players in need get inserts. So the whole
    ledger is read twice, before the first iteration: for the state of every player and for the rows of players in need.
    Later iterations read the rows of the players that changed last; inserts are stored as tables of their own, and
    the repaired ledger is the union of the given one and those. Only a few totals reach the driver.

    Candidates are compared with a ledger row once: later iterations compare with the last inserts those that are no
    duplicates yet, and only count the duplicates. Players never come back into need, so both are found in the scored
    table of the iteration before.

    With ``valuations`` the club scores are worked out once, after the last insert. A dry run scores and counts, and
    stops before anything is appended.
    """
    assert strategy in STRATEGIES, strategy
    spark = ledger.sparkSession
    done = Outcome(ledger)
    state = checkpointed(quality.player_state(ledger, clubs, min_fee), "state")
    totals = quality.state_totals(state)
    total_players = players.count()

    def in_need() -> DataFrame:
        if strategy == "silent":
            found = chains.silent_gaps(rows, players, clubs, min_fee)
        else:
            found = state.filter("unpaired > 0")
        return checkpointed(found.filter(F.col("player_id").isNotNull()).select("player_id"), "need")

    rows = ledger
    need = in_need()
    rows = checkpointed(_of(ledger, need), "open")
    previous, graded, duplicates = None, None, []
    for number in range(1, max_iterations + 1):
        open_players = need.count()
        if open_players == 0:
            done.status = "zero_candidates"
            break
        if graded is None:
            graded = checkpointed(scored(_of(candidates, need), rows), "scored")
        else:
            duplicates.append(checkpointed(graded.filter(settled()).groupBy("player_id").agg(F.count(F.lit(1)).alias("n")), "duplicates"))
            before, graded = graded, checkpointed(rescored(_of(graded.filter(~settled()), need), added, candidates.columns), "scored")
            drop_table(before)
        bands = confidence_bands(graded).first().asDict()
        bands["low"] += sum(_of(known, need).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for known in duplicates)
        inserts = checkpointed(to_insert(graded, players, threshold, min_year), "inserts")
        inserted = inserts.count()
        row = {"iteration": number, "players": open_players, "inserted": inserted, "previous_inserted": previous, **bands}
        if dry_run:
            done.iterations.append(row)
            break
        added = inserts.withColumn("transfer_id", -F.col("candidate_id")).drop("candidate_id")
        if inserted:
            touched = inserts.select("player_id").distinct()
            done.added.append((number, added))
            done.ledger = done.ledger.unionByName(added, allowMissingColumns=True)
            grown = rows.unionByName(added, allowMissingColumns=True)
            if strategy == "broken":
                grown = _of(grown, touched)
            before, rows = rows, checkpointed(grown, "open")
            drop_table(before)
            changed = checkpointed(quality.player_state(_of(rows, touched), clubs, min_fee), "state")
            new, old = quality.state_totals(changed), quality.state_totals(_of(state, touched))
            totals = {name: totals[name] + new[name] - old[name] for name in totals}
            if strategy == "silent":
                changed = checkpointed(_of(state, touched, "left_anti").unionByName(changed), "state")
            before, state = state, changed
            drop_table(before)
        elif strategy == "broken":
            state = state.limit(0)
        verdict = judged(spark, totals, total_players, inserted, previous, open_players)
        done.iterations.append({**row, **verdict})
        if verdict["status"] != "open":
            done.status = verdict["status"]
            break
        previous = inserted
        drop_table(need)
        need = in_need()
    for table in (rows, state, need, *duplicates, *([] if graded is None else [graded])):
        drop_table(table)
    if valuations is not None and done.added:
        done.scores = club_scores(all_pairs(done.ledger, valuations, players))
    return done
