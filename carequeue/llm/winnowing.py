"""Document fingerprints by winnowing, in SQL functions only.

A text is cut into tokens: runs of characters other than white space, at most ``TOKEN``
long. Longer runs, and the letters of scripts written without spaces, are tokens of one
character each, so that a cut depends on nothing but the run it lies in. Every
``GRAM`` tokens in a row are hashed; of each window of ``WINDOW`` hashes the least is
chosen, the rightmost of equal ones, with its position. Two texts that share
``WINDOW + GRAM - 1`` tokens in a row share a chosen hash. Hashes (40 bits) and positions
are packed in one number whose order is that of the hashes and, among equal ones, falls
with the position, so that a window's least is its choice.

Likeness is the Jaccard similarity of chosen hashes. Defined cases: null and empty texts
have an empty fingerprint, two of which are alike with 1 and any other with 0; texts
shorter than a gram are hashed whole; equal texts have equal fingerprints; positions count
up to 2^23 grams and then from 0 again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carequeue.operators.shared import written

TOKEN = 16
GRAM = 4
WINDOW = 8
_SPACE = r"\x20\x09-\x0D"
_UNSPACED = "".join(
    rf"\p{{Is{script}}}"
    for script in "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split()
)
_IN_RUN = f"[^{_SPACE}{_UNSPACED}]"
# a whole run of up to TOKEN characters, or else one character
_TOKENS = rf"(?<!{_IN_RUN}){_IN_RUN}{{1,{TOKEN}}}+(?!{_IN_RUN})|[^{_SPACE}]"
_POSITION_BITS = 23
_POSITIONS = (1 << _POSITION_BITS) - 1


def _pairs(values: Column, shift: int, join) -> Column:
    """join(v[i], v[i + shift]) for every i that has both."""
    n = F.greatest(F.size(values) - shift, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + shift), n), join)


def fingerprint_columns(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add the packed choices of a text column as an array of longs."""
    grams, packed = f"_{to}_grams", f"_{to}_packed"
    tokens = F.regexp_extract_all(
        F.coalesce(F.col(text), F.lit("")), F.lit(_TOKENS), F.lit(0)
    )
    df = df.withColumn(grams, F.transform(tokens, lambda t: F.xxhash64(t)))
    # doubling: hashes of 2 tokens, then of 4; a short text is one gram
    short = F.size(grams) < GRAM
    whole = F.when(F.size(grams) > 0, F.array(F.xxhash64(F.to_json(grams)))).otherwise(
        F.array().cast("array<bigint>")
    )
    twos = _pairs(F.col(grams), 1, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(grams, F.when(short, whole).otherwise(twos))
    fours = _pairs(F.col(grams), 2, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(grams, F.when(F.size(grams) > 1, fours).otherwise(F.col(grams)))
    number = F.transform(
        F.col(grams),
        lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 40), _POSITION_BITS).bitwiseOR(
            F.lit(_POSITIONS) - i.bitwiseAND(F.lit(_POSITIONS)).cast("long")
        ),
    )
    df = df.withColumn(packed, number)
    least = lambda a, b: F.least(a, b)
    for shift in (1, 2, 4):
        narrower = _pairs(F.col(packed), shift, least)
        df = df.withColumn(
            packed,
            F.when(F.size(packed) > shift, narrower).otherwise(
                F.when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(F.col(packed))
            ),
        )
    return df.withColumn(to, F.array_distinct(packed)).drop(grams, packed)


def hashes(choices: Column) -> Column:
    return F.transform(choices, lambda c: F.shiftright(c, _POSITION_BITS))


def positions(choices: Column) -> Column:
    """Number of the gram that each chosen hash starts at."""
    return F.transform(choices, lambda c: F.lit(_POSITIONS) - c.bitwiseAND(F.lit(_POSITIONS)))


def as_text(choices: Column) -> Column:
    """hash:position of every choice, hashes in hexadecimal."""
    written_out = F.transform(
        choices,
        lambda c: F.concat_ws(
            ":",
            F.lower(F.hex(F.shiftright(c, _POSITION_BITS))),
            (F.lit(_POSITIONS) - c.bitwiseAND(F.lit(_POSITIONS))).cast("string"),
        ),
    )
    return F.array_join(written_out, ",")


def likeness(a: Column, b: Column) -> Column:
    x, y = hashes(a), hashes(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, _part, _guest): texts dealt by ranges of ids, with a guest for each range.

    The next document, in falling order of ids, is then the next row of the same range.
    Only the first document of a range follows the last of another one; a copy of it goes
    to that range as its guest and last row. The ranges' bounds are quantiles of the ids:
    ``parts`` numbers (default: twice the shuffle partitions) that the driver holds.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), order.alias("_id"))
    steps = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("_id", steps, 20 * parts)).first()[0] if steps else None
    bounds = sorted(set(bounds or []))
    part = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("_part", part)
    # the first row of each range: the largest id, ties by hash and length of the text
    key = F.struct("_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    firsts = written(
        rows.withColumn("_key", key).groupBy("_part").agg(F.max("_key").alias("_first")),
        "winnow-ranges",
    )
    found = sorted((r._part for r in firsts.select("_part").collect()), reverse=True)
    # the range that each one's first row is a guest of: the one before it, in a circle
    before = {p: found[i - 1] for i, p in enumerate(found)}
    pairs = spark.createDataFrame([*before.items()] or [(0, 0)], "_part int, _host int")
    firsts = firsts.withColumn("_part", F.col("_part").cast("int")).join(F.broadcast(pairs), "_part")
    rows = rows.withColumn("_part", F.col("_part").cast("int")).join(F.broadcast(firsts), "_part")
    same = key == F.col("_first")
    places = F.when(same, F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("g")),
                                  F.struct(F.col("_host").alias("p"), F.lit(True).alias("g"))))
    own = F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("g")))
    return rows.select(
        "doc_id", "text", "_id", F.explode(F.coalesce(places, own)).alias("_place")
    ).select("doc_id", "text", "_id", F.col("_place.p").alias("_part"), F.col("_place.g").alias("_guest"))


def fingerprinted_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, with likenesses.

    The edited text has its last third replaced by the beginning of the next document.
    """
    order = Window.partitionBy("_part").orderBy(
        "_guest", F.col("_id").desc(), F.xxhash64("text").desc(), F.length("text").desc()
    )
    rows = with_next(docs).withColumn("_next", F.lead("text").over(order))
    rows = fingerprint_columns(rows, "text", "_own")
    rows = rows.withColumn("_following", F.lead("_own").over(order)).where(~F.col("_guest"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - third),
        F.substring(F.col("_next"), F.lit(1), third),
    )
    rows = rows.withColumn("_edited", edited)
    rows = fingerprint_columns(rows, "_edited", "_changed")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_following")).alias("near_next"),
    )
