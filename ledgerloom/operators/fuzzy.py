"""Fuzzy name linkage without comparing every name to every other.

Two texts of lengths m and n with Indel ratio t or more share at least
c = (1.5 t - 1)(m + n) + 1 of their bigrams once a start and an end mark are added. So of its
bigrams, the rarest first, each text needs only the first (size - c + k): two such texts share at
least k of these, and they meet under a key of k bigrams together. Keys of three (two below a
ratio of 0.8, one inside blocks) are rare in small tables even where single bigrams are not.
A key that too many texts have is not joined but made longer, by each bigram that may come next
in the order, until it is rare, neither text promises one more, or the longer keys would join
as much because the crowd's texts really are alike. What two texts share begins with the key and
goes on with one of these. So a common key does not join all its names with each other. Texts too short to promise k shared
bigrams meet all texts of feasible length under single bigrams; there are few of them.
No pair at or above the ratio is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.similarity import fold_accents, sequence_ratio, sorted_ratio, sorted_tokens
from ledgerloom.session import checkpointed

START, END = "\u0002", "\u0003"
#: A key is crowded if it would join more rows than this for each text that has it.
CROWD = 512


def normal_text(text: Column) -> Column:
    return fold_accents(F.lower(F.trim(text)))


def _bigrams(text: Column) -> Column:
    """Bigrams with marks; a repeated bigram gets its repeat number, making them a set."""
    marked = F.concat(F.lit(START), text, F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(marked, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def _required(length: Column, ratio: float) -> Column:
    """Fewest shared bigrams with any partner, the shortest feasible one included."""
    shortest = length * F.lit(ratio / (2 - ratio))
    return F.greatest(F.lit(1), F.ceil(F.lit(1.5 * ratio - 1) * (length + shortest) + 1 - F.lit(1e-6)))


def _together(ratio: float, block: list[str]) -> int:
    """How many bigrams make a key: one inside blocks, which are small already, else as many as short names can promise."""
    return 1 if block else 3 if ratio >= 0.8 else 2


def _keys(grams: Column, together: int) -> Column:
    """Every way to take ``together`` (1 to 3) bigrams out of an ordered list: hash, and place of the last one."""
    spots = lambda start: F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: i > start)
    pick = lambda i: F.element_at(grams, i.cast("int"))
    key = lambda last, *places: F.struct(F.xxhash64(*[pick(i) for i in (*places, last)]).alias("key"), last.cast("int").alias("place"))
    if together == 1:
        return F.transform(spots(F.lit(0)), lambda i: key(i))
    if together == 2:
        every = F.transform(spots(F.lit(0)), lambda i: F.transform(spots(i), lambda j: key(j, i)))
        return F.flatten(every)
    every = F.transform(spots(F.lit(0)), lambda i: F.transform(spots(i), lambda j: F.transform(
        spots(j), lambda k: key(k, i, j))))
    return F.flatten(F.flatten(every))


def _longer(rows: DataFrame, signed: DataFrame, block: list[str], size: int) -> DataFrame:
    """Keys of one bigram more: each that may be the ``size``-th shared one, behind the key's last; ``parent`` is the shorter key."""
    n = F.size("named")
    end = F.when(F.col("promised") >= size, n - F.col("promised") + size).otherwise(n)
    next_place = F.filter(F.sequence(F.lit(1), n), lambda i: (i > F.col("place")) & (i <= end))
    known = rows.join(signed.select(*block, "text", "named"), [*block, "text"])
    return known.withColumn("place", F.explode(next_place)).select(
        *block, "text", "promised", "ours", F.col("key").alias("parent"), F.xxhash64("key", F.element_at("named", F.col("place"))).alias("key"), "place")


def _met(rows: DataFrame, *key: str) -> DataFrame:
    """Per key the texts of both sides, and the largest promise among them."""
    return rows.groupBy(*key).agg(F.count_if("ours").alias("a"), F.count_if(~F.col("ours")).alias("b"), F.max("promised").alias("most"))


def _rounds(ours: DataFrame, theirs: DataFrame, block: list[str], together: int):
    """Per key length the rows (``text, key, ours``) that are joined; crowded keys go on as longer ones where that pays.

    It pays if the longer keys join less than half of what the key itself would join. Where a crowd's
    texts really are alike it doesn't, and they are joined as they are.
    """
    signed = ours.withColumn("ours", F.lit(True)).unionByName(theirs.withColumn("ours", F.lit(False)))
    rows = signed.select(*block, "text", "promised", "ours", F.inline(_keys(F.col("grams"), together)))
    named, size, key = ours.unionByName(theirs).dropDuplicates([*block, "text"]), together, [*block, "key"]
    while True:
        crowded = _met(rows, *key).filter((F.col("a") * F.col("b") > CROWD * (F.col("a") + F.col("b"))) & (F.col("most") > size))
        crowded = checkpointed(crowded.select(*key, (F.col("a") * F.col("b")).alias("joins")), "crowded-keys")
        if crowded.isEmpty():
            yield rows
            return
        yield rows.join(crowded, key, "left_anti")
        held = checkpointed(rows.join(crowded.select(*key), key, "left_semi"), "crowded-names")
        longer = checkpointed(_longer(held, named, block, size + 1), "longer-names")
        below = _met(longer, *block, "parent", "key").groupBy(*block, F.col("parent").alias("key")).agg(F.sum(F.col("a") * F.col("b")).alias("below"))
        paying = checkpointed(crowded.join(below, key, "left").filter(2 * F.coalesce("below", F.lit(0)) < F.col("joins")).select(*key), "paying-keys")
        yield held.join(paying, key, "left_anti")
        # texts that promise no more meet here among themselves: their partners of more promise come under longer keys
        yield held.join(paying, key, "left_semi").filter(F.col("promised") <= size)
        rows = longer.join(paying.withColumnRenamed("key", "parent"), [*block, "parent"], "left_semi").drop("parent")
        size += 1


def _joined(rows: DataFrame, block: list[str]) -> DataFrame:
    """Texts of both sides that meet under a key, before any comparison."""
    key = [*block, "key"]
    left = rows.filter("ours").select(*key, F.col("text").alias("left"))
    right = rows.filter(~F.col("ours")).select(*key, F.col("text").alias("right"))
    # merged: exploded keys are far more than the planner expects of their table, too many to broadcast
    return left.join(right.hint("merge"), key).select(*block, "left", "right")


def _signed(texts: DataFrame, block: list[str], ratio: float, frequency: DataFrame) -> DataFrame:
    """Adds ``grams``: the rarest bigrams, as many as the bound requires for the text's key size, and ``short``."""
    grams = texts.select(*block, "text", F.explode(_bigrams(F.col("text"))).alias("gram")).join(frequency, "gram")
    ordered = grams.groupBy(*block, "text").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("_all"))
    size, required = F.length("text"), _required(F.length("text"), ratio)
    together = _together(ratio, block)
    short = required < together
    first = size + 1 - required + F.when(short, 1).otherwise(together)
    named = F.transform("_all", lambda g: g["gram"])
    return ordered.select(*block, "text", short.alias("short"), required.cast("int").alias("promised"), named.alias("named"),
                          F.slice(named, F.lit(1), first.cast("int")).alias("grams"), F.slice(named, F.lit(1), (size + 2 - required).cast("int")).alias("single"))


def _candidates(ours: DataFrame, theirs: DataFrame, block: list[str], ratio: float) -> DataFrame:
    """Pairs (left, right) that share a key and have feasible lengths."""
    m, n = F.length("left"), F.length("right")
    feasible = F.least(m, n) * 2 >= (m + n) * F.lit(ratio) - F.lit(1e-6)

    def met(a: DataFrame, b: DataFrame, keys: Column) -> DataFrame:
        left = a.select(*block, F.col("text").alias("left"), F.explode(keys).alias("key"))
        right = b.select(*block, F.col("text").alias("right"), F.explode(keys).alias("key"))
        # merged: exploded keys are far more than the planner expects of their table, too many to broadcast
        return apart(left.join(right.hint("merge"), [*block, "key"]).select(*block, "left", "right"))

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs.filter(feasible & (F.col("left") != F.col("right")))

    def reachable(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Texts that can be similar to a short one of the other side."""
        longest = others.filter("short").agg(F.max(F.length("text")).alias("n")).scalar()
        return rows.filter(F.length("text") <= longest * F.lit((2 - ratio) / ratio) + 1)

    if block:  # one bigram makes a key, which every text promises, and blocks are small
        return met(ours, theirs, F.transform(_keys(F.col("grams"), 1), lambda k: k["key"])).distinct()
    pairs, single = None, F.col("single")
    for rows in _rounds(ours.filter("not short"), theirs.filter("not short"), block, _together(ratio, block)):
        found = apart(_joined(rows, block))
        pairs = found if pairs is None else pairs.unionByName(found)
    pairs = pairs.unionByName(met(ours.filter("short"), reachable(theirs, ours), single))
    return pairs.unionByName(met(reachable(ours, theirs), theirs.filter("short"), single)).distinct()


def similar_texts(left: DataFrame, right: DataFrame, ratio: float, block: list[str] | None = None) -> DataFrame:
    """All (left, right, score) of distinct ``text`` values with Indel ratio >= ``ratio`` (two thirds at least).

    ``block`` columns must be equal on both sides.
    """
    block = block or []
    a = left.select(*block, "text").filter("text IS NOT NULL").distinct()
    b = right.select(*block, "text").filter("text IS NOT NULL").distinct()
    frequency = (
        a.select("text").unionByName(b.select("text"))
        .select(F.explode(_bigrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    )
    equal = a.join(b, [*block, "text"]).select(*block, F.col("text").alias("left"), F.col("text").alias("right"), F.lit(100.0).alias("score"))
    signed = [_signed(side, block, ratio, frequency) for side in (a, b)]
    if not block:  # the keys are counted before they are joined
        signed = [checkpointed(side, "signed-names") for side in signed]
    near = _candidates(*signed, block, ratio)
    # two texts may meet in many blocks, but are compared once
    scored = near.select("left", "right").distinct().withColumn("score", sorted_ratio("left", "right")) \
        .filter(F.col("score") >= 100 * ratio - 1e-9)
    return equal.unionByName(near.join(scored, ["left", "right"]).select(*block, "left", "right", "score") if block else scored)


def link_players(external: DataFrame, players: DataFrame, threshold: float = 85.0, borderline: float = 70.0,
                 team_ratio: float = 80.0, boost: float = 15.0, cap: float = 95.0) -> DataFrame:
    """Each distinct external (name, team) with its best player.

    A name score between ``borderline`` and ``threshold`` gains ``boost`` (up to ``cap``)
    when the teams are alike. Ties go to the smallest player id; no match gives NULL.
    """
    raw = external.select("name", "team").distinct()
    ours = raw.select("name", "team", sorted_tokens(normal_text(F.col("name"))).alias("text"),
                      sorted_tokens(normal_text(F.coalesce("team", F.lit("")))).alias("team_text"))
    # equal names at equal clubs are interchangeable: the smallest id stands for them
    theirs = (
        players.filter(F.col("name").isNotNull()).groupBy("name", "current_club_name")
        .agg(F.min("player_id").alias("player_id"))
        .select(sorted_tokens(normal_text(F.col("name"))).alias("text"),
                sorted_tokens(normal_text(F.coalesce("current_club_name", F.lit("")))).alias("club_text"), "player_id")
        .groupBy("text", "club_text").agg(F.min("player_id").alias("player_id"))
    )
    # both sides are read in many places, so the outside rows, of which there may be far more than names, are read once for all
    ours, theirs = checkpointed(ours, "outside-names"), checkpointed(theirs, "known-names")
    by_name = theirs.groupBy("text").agg(F.min("player_id").alias("player_id")).withColumnRenamed("text", "right")
    rank = F.struct("score", (-F.col("player_id")).alias("neg_id"))

    strong = similar_texts(ours, theirs, threshold / 100).join(by_name, "right") \
        .groupBy(F.col("left").alias("text")).agg(F.max(rank).alias("best"))
    strong = ours.select("text", "team_text").distinct().join(strong, "text")

    teams = ours.filter("team_text <> ''").select(F.col("team_text").alias("text"))
    clubs = theirs.filter("club_text <> ''").select(F.col("club_text").alias("text"))
    alike = checkpointed(similar_texts(teams, clubs, team_ratio / 100).select(
        F.col("left").alias("team_text"), F.col("right").alias("club_text")), "alike-clubs")
    at_club = ours.join(alike, "team_text").select("club_text", "text", "team_text").distinct()
    near = similar_texts(at_club, theirs, borderline / 100, ["club_text"]).filter(F.col("score") < threshold)
    lifted = F.greatest(F.col("score"), F.least(F.col("score") + boost, F.lit(cap)))
    weak = (
        near.withColumn("score", lifted).filter(F.col("score") >= threshold)
        .join(theirs.withColumnRenamed("text", "right"), ["right", "club_text"])
        .join(at_club.withColumnRenamed("text", "left"), ["left", "club_text"])
        .groupBy(F.col("left").alias("text"), "team_text").agg(F.max(rank).alias("best"))
    )
    best = strong.unionByName(weak).groupBy("text", "team_text").agg(F.max("best").alias("best"))
    return ours.join(best, ["text", "team_text"], "left").select(
        "name", "team", (-F.col("best.neg_id")).alias("player_id"), F.col("best.score").alias("match_score"))


def best_club(targets: DataFrame, results: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per target the most similar of *its own* search results, if similar enough.

    ``results`` carries the target's id, so the work grows with the result rows.
    """
    both = results.join(targets.select("target_id", F.col("name").alias("target_name")), "target_id")
    scored = both.withColumn("score", sequence_ratio(F.lower(F.trim("target_name")), F.lower(F.trim("name"))))
    best = scored.groupBy("target_id", "target_name").agg(
        F.max(F.struct("score", (-F.col("club_id")).alias("neg_id"), "name")).alias("b"))
    return best.filter(F.col("b.score") >= threshold).select(
        "target_id", "target_name", (-F.col("b.neg_id")).alias("club_id"), F.col("b.name").alias("club_name"),
        F.col("b.score").alias("score"))


def match_report(matched: DataFrame, by: str) -> DataFrame:
    """Rows found, matched and too short per group, with the match rate."""
    out = matched.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count("player_id").alias("matched"))
    return out.withColumn("match_rate", F.round(F.col("matched") / F.col("total") * 100, 1))
