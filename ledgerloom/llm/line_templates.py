"""Line de-duplication by a log-template tree, in DataFrame functions only.

A line's words (runs of other than ``\\x20\\x09-\\x0D``) that hold a digit are variable fields and count as ``<*>``. The tree has a fixed
depth: number of words, then the first ``LEADING`` words; a leaf holds the lines that agree in these. A template is either one masked line
or, where a leaf holds several masked lines, the leaf's most frequent word at each place; a line belongs to the leaf's template if it has
``SIMILAR`` of its words, the others being variable fields too.

A leaf may hold several templates. Its lines that are neither of its first template nor a recurring masked line are a group, which is
worked on in rounds. A word at a place is common if the group's lines with it have ``MIN_DOCS`` documents or more, a document counting once
for each different line. A line of which fewer than ``SIMILAR`` of the words are common leaves for good: the fixed words of a template
that recurs are all common. Of what stays, the most frequent common word of each place makes the next template; if it does not recur, the
group is split by the word at the place where a common word that not all lines have is most frequent (lines without a common word
there stay together). What is left of a group when a template is taken out is a group again. This ends when every line has left.

A template that occurs in ``MIN_DOCS`` documents or more recurs. Its first line (smallest id, then line number) stays, all others are
dropped. Lines of fewer than ``MIN_WORDS`` words are never dropped. The rest of a text stays as it is.

After the first pass the work is on one row for each different masked line of a leaf, whatever its number of copies; only lines of
leaves with ``MIN_DOCS`` documents are read again for their words, and documents are counted exactly only for groups whose lines' counts
leave it open.

Null texts stay null, empty texts empty. Rows are named by id and text: equal rows get the same lines removed, rows that share an id but
not their text each lose their own lines, and both count as one document. Rows without an id count as one document for each text. An empty
table gives an empty result. ``dropped_lines`` ignores other columns, ``drop_recurring_lines`` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import stored
from ledgerloom.session import drop_table

LEADING = 3
SIMILAR = 0.7
MIN_DOCS = 5
MIN_WORDS = 3
#: Line numbers that are sent to every task (8 MB); more are joined by a shuffle, with the same result.
SENT_LINES = 2_000_000
FIELD = "<*>"


def masked_words(line: Column) -> Column:
    """The words of a line, those with a digit as ``<*>``."""
    plain = F.when(line.rlike(r"\d"), F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(line)
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _own() -> Column:
    """The name of a row: a hash of id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _placed(docs: DataFrame) -> DataFrame:
    """``own, doc, line_no, leaf, line`` of the lines that may be dropped: hashes of row, leaf and masked line.

    Stored before it is filtered: a filter on the words would be pushed below them and have each line masked twice.
    """
    own = docs.select(_own().alias("own"), F.coalesce(F.col("doc_id").cast("long"), _own()).alias("doc"),
                      F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "raw"))
    words = own.select("own", "doc", "line_no", masked_words(F.col("raw")).alias("words"))
    rows = words.select("own", "doc", "line_no", F.size("words").alias("n"),
                        F.xxhash64(F.size("words"), F.slice("words", 1, LEADING)).alias("leaf"), F.xxhash64("words").alias("line"))
    return stored(rows, "lines").where(F.col("n") >= MIN_WORDS).drop("n")


def _with_lines(docs: DataFrame, lines: DataFrame, name: str, how: str) -> DataFrame:
    """Joins to each row the numbers of its ``lines``, sent to every task if there are at most ``SENT_LINES``."""
    mine = stored(lines.groupBy("own").agg(F.collect_set("line_no").alias(name)), name)
    small = mine.agg(F.coalesce(F.sum(F.size(name)), F.lit(0))).first()[0] <= SENT_LINES
    return docs.withColumn("own", _own()).join(F.broadcast(mine) if small else mine, "own", how)


def _agreeing(lines: DataFrame, modes: DataFrame, group: str) -> DataFrame:
    """The lines that have enough of their group's ``place, mode`` words."""
    listed = modes.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("place", "mode"))).alias("modes"))
    same = F.size(F.filter(F.transform("words", lambda w, i: F.coalesce(F.try_element_at("modes", i) == w, F.lit(False))), lambda x: x))
    return lines.join(listed, group).where(same / F.size("words") >= SIMILAR).drop("modes")


def _recurring(near: DataFrame, group: str, placed: DataFrame) -> DataFrame:
    """The groups whose lines occur in enough documents."""
    groups = near.groupBy(group).agg(F.max("docs").alias("least"), F.sum("docs").alias("most")).where(F.col("most") >= MIN_DOCS)
    open_lines = near.join(groups.where(F.col("least") < MIN_DOCS), group).select(group, "line")
    exact = placed.select("line", "doc").join(open_lines, "line").select(group, "doc").distinct().groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    return groups.where(F.col("least") >= MIN_DOCS).select(group).unionByName(exact.select(group))


def _cells(lines: DataFrame) -> DataFrame:
    """One row for each word behind the leading ones, which all lines of a group share."""
    return lines.select("group", "line", "n", "docs", F.posexplode("words").alias("place", "word")).where(F.col("place") >= LEADING)


def _common(cells: DataFrame) -> DataFrame:
    return cells.groupBy("group", "place", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS).drop("docs")


def _kept(lines: DataFrame) -> DataFrame:
    """The lines that have enough common words of their group."""
    cells = _cells(lines)
    has = cells.join(_common(cells), ["group", "place", "word"], "left_semi").groupBy("group", "line").agg(F.count("*").alias("has"))
    return lines.join(has, ["group", "line"]).where((F.col("has") + LEADING) / F.size("words") >= SIMILAR).drop("has")


def _split(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The lines of groups that can be split, in their new groups."""
    sizes = lines.groupBy("group").agg(F.sum("n").alias("lines"))
    parting = common.join(sizes, "group").where("n < lines")
    places = parting.groupBy("group").agg(F.max_by("place", F.struct("n", -F.col("place"))).alias("place"))
    words = parting.join(places, ["group", "place"]).select("group", "word", F.lit(True).alias("held"))
    at = lines.join(places, "group").withColumn("word", F.get("words", F.col("place"))).join(words, ["group", "word"], "left")
    new = F.xxhash64("group", "place", F.col("held").isNotNull(), F.when(F.col("held"), F.col("word")))
    return at.withColumn("group", new).select(*lines.columns)


def _further(lines: DataFrame, placed: DataFrame):
    """``line, template`` of each further round's templates, for rows ``group, line, words, n, docs``."""
    before = None
    while True:
        lines = stored(_kept(lines), "group-lines")
        if before is not None:
            drop_table(before)
        before = lines
        if lines.isEmpty():
            return
        common = _common(_cells(lines))
        modes = common.groupBy("group", "place").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("mode"))
        # the leading words are modes of their places
        leading = lines.groupBy("group").agg(F.first(F.slice("words", 1, LEADING)).alias("w")).select("group", F.posexplode("w").alias("place", "mode"))
        near = _agreeing(lines, modes.unionByName(leading), "group")
        near = stored(near.join(_recurring(near, "group", placed), "group", "left_semi").select("group", "line"), "group-templates")
        yield near.select("line", F.col("group").alias("template"))
        taken = near.select("group").distinct()
        # a group that gave a template has another name in the next round
        again = lines.join(taken, "group", "left_semi").join(near, ["group", "line"], "left_anti").withColumn("group", F.xxhash64("group"))
        others = lines.join(taken, "group", "left_anti")
        lines = again.unionByName(_split(others, common))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``own, line_no`` (from 0) of every line that goes; ``own`` is the row's name."""
    docs = docs.select("doc_id", "text")
    placed = _placed(docs)
    # one row for each different masked line
    per_doc = placed.groupBy("leaf", "line", "doc").agg(F.count("*").alias("n"), F.min(F.struct("doc", "line_no", "own")).alias("first"))
    kinds = stored(per_doc.groupBy("leaf", "line").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min("first").alias("first")), "different-lines")

    # leaves of several masked lines that may be in enough documents: most frequent word at each place
    mixed = kinds.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).where((F.col("kinds") > 1) & (F.col("docs") >= MIN_DOCS))
    read = kinds.join(mixed.select("leaf"), "leaf", "left_semi")
    held = _with_lines(docs, read.select("first.own", "first.line_no"), "leaf_lines", "inner")
    split = held.select("leaf_lines", F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
    words = split.select(F.explode("leaf_lines").alias("line_no"), "lines").select(masked_words(F.get("lines", F.col("line_no"))).alias("words"))
    words = words.select(F.xxhash64("words").alias("line"), "words").dropDuplicates(["line"])
    lines = stored(read.join(words, "line").select("leaf", "line", "words", "n", "docs"), "leaf-lines")
    counted = lines.select("leaf", "n", F.posexplode("words").alias("place", "word")).groupBy("leaf", "place", "word").agg(F.sum("n").alias("n"))
    modes = counted.groupBy("leaf", "place").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("mode"))
    near = stored(_agreeing(lines, modes, "leaf"), "similar")
    general = near.join(_recurring(near, "leaf", placed), "leaf", "left_semi").select("line", F.col("leaf").alias("template"))

    # other lines: one masked line is the template
    same = kinds.where(F.col("docs") >= MIN_DOCS).select("line").join(general.select("line"), "line", "left_anti").select("line", F.col("line").alias("template"))
    recurring = stored(general.withColumn("kind", F.lit("leaf")).unionByName(same.withColumn("kind", F.lit("line"))), "recurring")
    rest = lines.join(recurring.select("line"), "line", "left_anti").withColumnRenamed("leaf", "group")
    for more in _further(rest, placed):
        recurring = recurring.unionByName(more.withColumn("kind", F.lit("group")))
    found = recurring.join(kinds.select("line", "first"), "line")
    firsts = found.groupBy("kind", "template").agg(F.min("first").alias("first"))
    going = found.drop("first").join(firsts, ["kind", "template"]).select("line", "first")
    return placed.join(going, "line").where(F.struct("doc", "line_no", "own") != F.col("first")).select("own", "line_no")


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the dropped lines out of ``text``, and ``n_lines`` and ``n_dropped`` (in place of such columns)."""
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    text = F.col("text").cast("string")
    rows = _with_lines(whole, dropped_lines(docs), "gone_lines", "left").withColumn(
        "text_lines", F.when(F.col("gone_lines").isNotNull(), F.split(text, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("text_lines") - 1), F.col("gone_lines"))
    left = F.array_join(F.transform(kept, lambda k: F.get(F.col("text_lines"), k)), "\n")
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return rows.select(*[F.coalesce(left, text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in others],
                       F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_dropped"))
