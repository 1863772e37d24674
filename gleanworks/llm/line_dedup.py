"""Line dedup: a suffix array over documents' lines, by distributed prefix doubling.

Documents are sequences of line ids (128 bits: two hashes of a line). A suffix is
open while the lines it begins with stand elsewhere too. It starts with a label of
the ids of its first ``least`` lines; in each round, the distinct pairs of an open
suffix's label and the label k lines on are sorted, the pair's place is appended to
the label, and k doubles. Labels are ranks: in their order the suffixes stand as
their lines do, and equal labels mean equal lines. Suffixes whose label is their own
(or whose document ends) are closed and keep it, so a round handles what still
recurs; there are as many rounds as the longest repeat has binary digits.

The labels sorted are the suffix array. The longest common prefix of neighbours in
it is read off two labels (how many entries they share), then off the labels behind
what is common so far, until they differ at once. Intervals of neighbours with
``least`` lines in common are the repeated runs: the first copy by (doc_id, line)
stays, and the lines of all later copies are deleted. A suffix's longest match is
the larger of its two common prefixes; where it isn't that of the line before less
one, a maximal repeated run begins.

With ``passage`` a single line is a run too if it is as long as a passage: a
paragraph in one line that stands between other neighbours each time, or is a
whole document. Shorter lines count in runs of ``least`` only.

Only DataFrame functions are used. Counting is pre-aggregated by Spark, and the
joins back to the copies deal frequent runs over as many salts as they are frequent,
so a line that stands in a third of all documents doesn't meet in one task.

Defined cases: null text stays null, with no lines; an empty text is one empty
line; a run of nothing but white space is deleted nowhere, and no maximal run
begins with ``least`` such lines; null doc_ids come behind all others; rows with
equal doc_id and text are one document to each other (each is the same copy); an
empty table gives no rows. A document's lines are one array, so a text may have 2 GB
at most, as any value of Spark's. All columns of the input are kept as they are,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, filter_words, in_filter, join_spread, materialise, release

#: Lines of the shortest run that counts.
LEAST = 2
#: Words of a line that is a passage by itself, where single lines count (``passage``);
#: or, as not all scripts part words, LETTERS times as many characters.
PASSAGE = 50
LETTERS = 6

_DOC = ["doc", "text_hash"]


def _ids(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _runs(lines: DataFrame, least: int) -> DataFrame:
    """For each line (ids, full) the name of the ``least`` lines from there (name), and
    whether any of them has more than white space (some). Each round is a projection of
    its own, so that a name is made once."""
    named = lines.withColumns({"name": F.col("ids"), "some": F.col("full")})
    k = 1
    while k < least:
        ahead = min(k, least - k)
        both = lambda x, y: F.struct(F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(x["b"], y["b"]).alias("b"))
        named = named.withColumns(
            {
                "name": F.zip_with("name", F.slice("name", ahead + 1, F.col("n")), both),
                "some": F.zip_with("some", F.slice("some", ahead + 1, F.col("n")), lambda x, y: x | F.coalesce(y, F.lit(False))),
            }
        )
        k += ahead
    return named


def _alone(line: Column, passage: int) -> Column:
    """The name of a line that is a passage by itself, or null. Few lines are split."""
    size = F.length(F.trim(line))
    many = (size >= 2 * passage - 1) & (F.size(F.array_remove(F.split(line, r"\s+"), "")) >= passage)
    return F.when((size >= LETTERS * passage) & line.rlike(r"\S") | many, _ids(F.concat(F.lit("alone "), line)))


def _line_ids(docs: DataFrame) -> DataFrame:
    text = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    text = text.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    return text.select("doc_id", F.xxhash64("doc_id", "text_hash").alias("doc"), "text_hash", F.size("lines").alias("n"), F.transform("lines", _ids).alias("ids"), "lines")


def recurring(docs: DataFrame, least: int = LEAST, passage: int | None = None, made: list[str] | None = None) -> DataFrame:
    """Places of runs that stand at two places or more: doc, text_hash, doc_id, line,
    length, some (more than white space), later (not the first copy)."""
    named = _line_ids(docs).withColumn("full", F.transform("lines", lambda x: x.rlike("\\S")))
    if passage is None:
        named = _runs(named.drop("lines").filter(F.col("n") >= least), least)
        each = named.select("doc_id", *_DOC, "n", F.posexplode(F.arrays_zip("name", "some")).alias("line", "r"))
        places = each.filter(F.col("line") <= F.col("n") - least).select("doc_id", *_DOC, "line", "r.name", "r.some", F.lit(least).alias("length"))
    else:
        named = _runs(named.withColumn("alone", F.transform("lines", lambda x: _alone(x, passage))).drop("lines"), least)
        each = named.select("doc_id", *_DOC, "n", F.posexplode(F.arrays_zip("name", "some", "alone")).alias("line", "r"))
        run = F.when(F.col("line") <= F.col("n") - least, F.struct("r.name", "r.some", F.lit(least).alias("length")))
        single = F.when(F.col("r.alone").isNotNull(), F.struct(F.col("r.alone").alias("name"), F.lit(True).alias("some"), F.lit(1).alias("length")))
        places = each.select("doc_id", *_DOC, "line", F.explode(F.array_compact(F.array(run, single))).alias("run")).select("doc_id", *_DOC, "line", "run.*")
    # Most runs stand once: their names alone are counted, and a filter tells which places to keep.
    h = F.xxhash64("name")
    again = places.select(h.alias("h")).groupBy("h").count().filter("count > 1")
    places = materialise(in_filter(places, filter_words(again, made), h, "near").filter("near").drop("near"), made)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("line"), F.col("text_hash"))
    runs = places.groupBy("name").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    found = join_spread(places, materialise(runs, made), "name", "doc", "line", weight="n")
    return found.select("doc_id", *_DOC, "line", "length", "some", (place > F.col("first")).alias("later"))


def suffixes(docs: DataFrame, found: DataFrame, words: DataFrame, least: int, made: list[str]) -> DataFrame:
    """doc, text_hash, line, label of all lines of documents that have a place in
    ``found``. Those of recurring runs have a label with an entry for each round.
    ``words``: a filter over such documents."""
    places = found.filter(F.col("length") == least).select(*_DOC, "line").distinct()
    lines = in_filter(_line_ids(docs).select(*_DOC, "ids"), words, F.xxhash64(*_DOC), "near").filter("near").drop("near")
    lines = lines.join(places.select(_DOC).distinct(), _DOC, "left_semi").dropDuplicates(_DOC)
    each = lines.select(*_DOC, F.posexplode("ids").alias("line", "id"))
    along = Window.partitionBy(*_DOC).orderBy("line")
    first = F.flatten(F.collect_list(F.array("id.a", "id.b")).over(along.rowsBetween(0, least - 1)))
    at = each.select(*_DOC, "line", first.alias("label")).join(places.withColumn("open", F.lit(True)), [*_DOC, "line"], "left")
    at = at.withColumn("open", F.coalesce("open", F.lit(False)))
    done, k = [], least
    past: list[str] = []
    while True:
        now: list[str] = []
        ahead = along.rangeBetween(k, k)
        seen = at.select(
            *_DOC,
            "line",
            "label",
            "open",
            F.coalesce(F.first("label").over(ahead), F.array().cast("array<long>")).alias("ahead"),
            F.coalesce(F.first("open").over(ahead), F.lit(False)).alias("goes_on"),
            F.max("open").over(Window.partitionBy(*_DOC)).alias("alive"),
        )
        seen = materialise(seen, now)
        # Documents with no open suffix are done; the tables of the round before aren't needed any more.
        done.append(materialise(seen.filter(~F.col("alive")).select(*_DOC, "line", "label").coalesce(64), made))
        discard(docs.sparkSession, *past)
        past = now
        release(docs.sparkSession)
        pairs = seen.filter("open").select(*_DOC, "line", "label", F.struct("label", "ahead").alias("pair"), "goes_on")
        ranks = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.first("goes_on").alias("goes_on"))
        # Sorted by ranges: the numbers rise from partition to partition.
        ranks = materialise(ranks.orderBy("pair").select("pair", "n", ((F.col("n") > 1) & F.col("goes_on")).alias("again"), F.monotonically_increasing_id().alias("rank")), now)
        if ranks.isEmpty():
            out = materialise(reduce(DataFrame.union, done), made)
            discard(docs.sparkSession, *past)
            return out
        fresh = join_spread(pairs, ranks, "pair", "doc", "line", weight="n")
        fresh = fresh.select(*_DOC, "line", F.concat("label", F.array("rank")).alias("label"), F.col("again").alias("open"))
        at = seen.filter("alive AND NOT open").select(*_DOC, "line", "label", "open").union(fresh)
        k *= 2


def longest_matches(labelled: DataFrame, least: int, made: list[str]) -> DataFrame:
    """doc, text_hash, line, match: of each suffix of a recurring run, how many lines
    from there on stand elsewhere too; from neighbours in the suffix array. ``labelled``
    is a written table."""
    some = labelled.filter(F.size("label") > 2 * least)
    ordered = materialise(some.orderBy("label").withColumn("at", F.monotonically_increasing_id()), made)
    # Places without gaps; rows of `parts`: one for each partition of the sort.
    part = F.shiftright("at", 33)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(parts.drop("n")), "part").withColumn("sa", F.col("before") + F.expr("at - shiftleft(part, 33)"))
    side = lambda s, shift: numbered.select((F.col("sa") + shift).alias("sa"), *(F.col(c).alias(f"{c}_{s}") for c in (*_DOC, "line", "label")))
    pairs = side("p", 0).join(side("q", -1), "sa").withColumn("lcp", F.lit(0).cast("long"))
    done = []
    while True:
        same = F.zip_with("label_p", "label_q", lambda x, y: F.coalesce(x == y, F.lit(False)))
        at = F.array_position(same, False)
        # The last entry of equal labels says only that both documents end alike behind it.
        whole = F.size("label_p")
        pairs = pairs.withColumn("entries", F.when(at > 0, at - 1).when(whole > 2 * least, whole - 1).otherwise(whole).cast("int"))
        deep = F.col("entries") >= 2 * least
        shared = F.when(deep, F.expr(f"shiftleft({least}L, entries - {2 * least})")).otherwise(F.expr("entries div 2"))
        moved = pairs.select("sa", *(F.col(f"{c}_{s}") for s in "pq" for c in _DOC), *((F.col(f"line_{s}") + F.when(deep, shared).otherwise(0)).alias(f"line_{s}") for s in "pq"), (F.col("lcp") + shared).alias("lcp"), deep.alias("more"), shared.alias("step"))
        moved = materialise(moved, made)
        # Back to where the suffixes begin: the lines that were common before.
        done.append(moved.filter(~F.col("more")).select(*((F.col(f"{c}_{s}")) for s in "pq" for c in _DOC), *((F.col(f"line_{s}") - F.col("lcp") + F.col("step")).alias(f"line_{s}") for s in "pq"), "lcp"))
        left = moved.filter("more").drop("more", "step")
        if left.isEmpty():
            break
        release(labelled.sparkSession)
        for s in "pq":
            names = {c: f"{c}_{s}" for c in (*_DOC, "line", "label")}
            left = left.join(labelled.select(*(F.col(a).alias(b) for a, b in names.items())), [f"{c}_{s}" for c in (*_DOC, "line")], "left")
        none = F.array().cast("array<long>")
        pairs = left.withColumns({f"label_{s}": F.coalesce(f"label_{s}", none) for s in "pq"})
    found = reduce(DataFrame.union, done)
    each = found.select(F.explode(F.array(*(F.struct(*(F.col(f"{c}_{s}").alias(c) for c in (*_DOC, "line")), "lcp") for s in "pq"))).alias("e")).select("e.*")
    return each.groupBy(*_DOC, "line").agg(F.max("lcp").alias("match")).filter(F.col("match") >= least)


def find_copies(docs: DataFrame, least: int = LEAST, passage: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of each text with repeated runs: doc, text_hash, gone (sorted numbers of the lines
    to delete, from 0; null if none), n_maximal (maximal repeated runs that begin in it),
    longest (lines of the longest); and a filter over such texts. Written tables."""
    made: list[str] = []
    found = materialise(recurring(docs, least, passage, made), made)
    words = filter_words(found.select(F.xxhash64(*_DOC).alias("h")))
    stops = lambda s: F.sequence(s["line"], s["line"] + s["length"] - 1)
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("line", "length")), stops))))
    gone = found.filter("later AND some").groupBy(_DOC).agg(covered.alias("gone"))
    matches = longest_matches(suffixes(docs, found, words, least, made), least, made)
    begins = found.filter((F.col("length") == least) & F.col("some")).select(*_DOC, "line").distinct()
    before = F.lag(F.struct("line", "match")).over(Window.partitionBy(*_DOC).orderBy("line"))
    runs = matches.join(begins, [*_DOC, "line"], "left_semi").withColumn("before", before)
    inside = (F.col("before.line") == F.col("line") - 1) & (F.col("before.match") == F.col("match") + 1)
    runs = runs.groupBy(_DOC).agg(F.count(F.when(~F.coalesce(inside, F.lit(False)), 1)).alias("n_maximal"), F.max("match").alias("longest"))
    out = materialise(runs.join(gone, _DOC, "full"))
    discard(docs.sparkSession, *made)
    release(docs.sparkSession)
    return out, words


def dedup_lines(docs: DataFrame, least: int = LEAST, passage: int | None = None) -> DataFrame:
    """``record`` (a struct of all columns of ``docs``), text (without the later
    copies), n_lines, n_deleted, n_runs (stretches of deleted lines), n_maximal (maximal
    repeated runs that begin in it), longest (lines of the longest of them, or 0)."""
    names = {c: f"found_{c}" for c in _DOC}
    found, words = find_copies(docs, least, passage)
    found = found.withColumnsRenamed(names)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", F.xxhash64("text")).alias("doc"))
    # Texts without repeated runs aren't shuffled.
    rows = in_filter(rows, words, F.xxhash64(*_DOC), "near")
    same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in names.items()]) & F.col("record.text").isNotNull()
    columns = ["record", "gone", "n_maximal", "longest"]
    none = {c: F.lit(None).cast(found.schema[c].dataType) for c in columns[1:]}
    met = rows.filter("near").join(found, same, "left").select(columns).union(rows.filter("NOT near").withColumns(none).select(columns))
    met = met.select("record", "gone", "n_maximal", "longest", F.split("record.text", "\n", -1).alias("lines"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i)), "\n")
    runs = F.size(F.array_except(F.col("gone"), F.transform("gone", lambda i: i + 1)))
    some = F.col("gone").isNotNull()
    return met.select(
        "record",
        F.when(some, kept).otherwise(F.col("record.text")).alias("text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(some, F.size("gone")).otherwise(0).cast("long").alias("n_deleted"),
        F.when(some, runs).otherwise(0).cast("long").alias("n_runs"),
        F.coalesce("n_maximal", F.lit(0)).cast("long").alias("n_maximal"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
    )
