"""Which entries of a table contain a typed text: the first few, in the table's order.

Entries are indexed by their distinct grams of one to three characters. A text of up to
three characters is itself a gram, and the first entries of every gram are kept. A longer
text is looked up by its rarest gram, and the entries that have this gram are checked.
Entries are checked in blocks of growing size, in order, and texts that have found enough
leave: a text that many entries contain meets the first of them only. Texts longer than
every entry are not looked up at all. Joins and bounded rankings are all there is to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carequeue.operators.shared import written

GRAM = 3
FIRST_BLOCK = 1024
GROWTH = 4  # of a block over the one before


def _grams(text: str, size: int) -> Column:
    """Distinct runs of characters, overlapping; none in a shorter text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _first(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The rows of each value with the least entries; each task passes on no more."""
    nth = Window.partitionBy(by).orderBy("entry")
    return rows.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= most).drop("_nth")


def index(entries: DataFrame) -> DataFrame:
    """(gram, entry) of a table of (entry, lowered): its distinct grams."""
    sizes = F.concat(*[_grams("lowered", n) for n in range(1, GRAM + 1)])
    return entries.select(F.explode(sizes).alias("gram"), "entry")


def containing(
    texts: DataFrame, entries: DataFrame, most: int = 1, longer_only: bool = False
) -> DataFrame:
    """(text, entry) of the first ``most`` entries that contain each text.

    ``texts`` has distinct texts ``text``; ``entries`` has ``entry``, whole numbers that
    give the order, each once, and ``lowered``. With ``longer_only`` an entry equal to the
    text does not count. Empty texts find nothing.
    """
    entries = written(entries.select("entry", "lowered"), "infix-entries")
    ends = entries.agg(F.max(F.char_length("lowered")), F.min("entry"), F.max("entry")).first()
    longest, first, last = ends
    grams = written(index(entries), "infix-grams")
    size = F.char_length("text")
    # no text that is longer than every entry has a place in one
    asked = texts.select("text").where((size > 0) & (size <= F.lit(longest or 0)))

    short = asked.where(size <= GRAM)
    of_gram = grams.where(F.char_length("gram") <= GRAM).withColumnRenamed("gram", "text")
    if longer_only:
        # an entry as short as a gram is equal to it
        lengths = entries.where(F.char_length("lowered") <= GRAM).select(
            "entry", F.col("lowered").alias("text")
        )
        of_gram = of_gram.join(lengths, ["entry", "text"], "left_anti")
    found = [short.join(_first(of_gram, "text", most), "text").select("text", "entry")]
    if longest is None or longest <= GRAM:
        return found[0]

    parts = asked.where(size > GRAM).select("text", F.explode(_grams("text", GRAM)).alias("gram"))
    frequent = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        parts.join(frequent, "gram", "left")
        .groupBy("text")
        .agg(
            F.min_by("gram", F.struct("n", "gram")).alias("gram"),
            F.count("*").alias("grams"),
            F.count("n").alias("known"),
        )
        .where("grams = known")  # a gram that no entry has rules the text out
    )
    open_ = written(rarest.select("text", "gram", F.lit(most).cast("long").alias("need")), "infix-open")
    at, width = first - 1, FIRST_BLOCK
    while at < last:
        in_block = F.col("entry").between(at + 1, at + width)
        candidates = open_.join(grams.where(in_block), "gram").join(
            entries.where(in_block), "entry"
        )
        matches = candidates.where(F.contains("lowered", "text"))
        if longer_only:
            matches = matches.where("lowered <> text")
        block = written(
            _first(matches.select("text", "entry", "need"), "text", most)
            .withColumn("nth", F.row_number().over(Window.partitionBy("text").orderBy("entry")))
            .where("nth <= need")
            .select("text", "entry"),
            "infix-found",
        )
        found.append(block)
        at, width = at + width, width * GROWTH
        if at >= last:
            break
        got = block.groupBy("text").agg(F.count("*").alias("got"))
        left = open_.join(got, "text", "left").withColumn(
            "need", F.col("need") - F.coalesce("got", F.lit(0))
        )
        open_ = written(left.where("need > 0").drop("got"), "infix-open")
        if open_.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every
