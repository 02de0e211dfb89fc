"""Document fingerprints: Merkle trees over sections, paragraphs and short passages.

A section ends with a blank line, a paragraph with a line break, and a passage with a sentence or
after 240 characters. Every piece keeps what ends it, so the pieces in order are the text. A passage
is hashed, a paragraph hashes its passages' hashes, a section its paragraphs', the root its sections'.

A fingerprint is written ``root:tree``, where the tree lists the passage hashes, shortened: passages
are parted by ``.``, paragraphs by ``,`` and sections by ``;``. Equal roots mean equal texts; two trees
show where texts differ. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION, PARAGRAPH, PASSAGE = r"(?s).+?(?:\n\n+|\z)", r"[^\n]*\n+|[^\n]+", r"(?s).{1,240}?(?:[.!?]\s|\n|\z)|.{1,240}"
#: Hex digits of a passage's hash in the tree.
SHORT = 10
#: Rows of one range of ids, up to a bound on the number of ranges.
RANGE_ROWS, MOST_RANGES = 500, 65_536
_NULL_ID = -(1 << 63)


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; null counts as empty."""
    leaves = lambda paragraph: F.transform(_pieces(paragraph, PASSAGE), F.md5)
    tree = F.transform(_pieces(F.coalesce(text, F.lit("")), SECTION), lambda s: F.transform(_pieces(s, PARAGRAPH), leaves))
    joined = lambda hashes: F.md5(F.array_join(hashes, ""))
    return F.transform(F.array(tree), lambda t: F.concat(  # bound once: the tree is used twice
        F.sha2(F.array_join(F.transform(t, lambda s: joined(F.transform(s, joined))), ""), 256),
        F.lit(":"),
        F.array_join(F.transform(t, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(F.transform(p, lambda h: F.substring(h, 1, SHORT)), ".")), ",")), ";"),
    ))[0]


def _leaves(print_: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring_index(print_, ":", -1), "[.,;]"), lambda h: h != ""))


def likeness(one: Column, other: Column) -> Column:
    """Twice the shared passages over the passages of both: 1 for equal roots, 0 for nothing shared."""
    a, b = _leaves(one), _leaves(other)
    dice = F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))
    return F.when(F.substring_index(one, ":", 1) == F.substring_index(other, ":", 1), F.lit(1.0)).otherwise(dice)


def differing_paragraphs(one: Column, other: Column) -> Column:
    """Where two fingerprints differ: an array of (section, paragraph), counted from 0.

    Branches that agree are not entered. Sections and paragraphs are compared place by place; a place
    that only one text has differs.
    """
    split = lambda text, by: F.filter(F.split(F.coalesce(text, F.lit("")), by), lambda x: x != "")
    sections = F.zip_with(split(F.substring_index(one, ":", -1), ";"), split(F.substring_index(other, ":", -1), ";"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    paragraphs = lambda s: F.zip_with(split(s["a"], ","), split(s["b"], ","), lambda a, b: ~a.eqNullSafe(b))
    places = F.transform(sections, lambda s, i: F.when(s["a"].eqNullSafe(s["b"]), F.array().cast("array<struct<section:int,paragraph:int,differs:boolean>>")).otherwise(
        F.transform(paragraphs(s), lambda d, j: F.struct(i.alias("section"), j.alias("paragraph"), d.alias("differs")))
    ))
    return F.transform(F.filter(F.flatten(places), lambda p: p["differs"]), lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Rows with the number of their id's range, plus a marked copy of each range's successor.

    Ranges go down from the largest ids. A range is followed by the next range's largest id, the last
    range by the very first; copies of these rows close each range, so that the row after any row is
    in its own range and no ordering of the whole table is needed.
    """
    count = docs.count()
    ranges = max(1, min(MOST_RANGES, count // RANGE_ROWS))
    cuts = docs.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 10 * max(1000, ranges))).first()[0] or []
    cuts = sorted(set(cuts)) if ranges > 1 else []
    if cuts:  # in two steps: which stretch of cuts, and how many of that stretch lie below
        step = max(1, int(len(cuts) ** 0.5))
        fine = docs.sparkSession.createDataFrame([(k + 1, cuts[i : i + step]) for k, i in enumerate(range(0, len(cuts), step))], "stretch int, cuts array<long>")
        below = lambda some: F.size(F.filter(some, lambda c: c < F.col("key")))
        docs = docs.withColumn("stretch", below(F.lit(cuts[::step]))).join(F.broadcast(fine), "stretch", "left")
        number = F.when(F.col("stretch") == 0, 0).otherwise((F.col("stretch") - 1) * step + below(F.col("cuts")))
        docs = docs.withColumn("range", -number).drop("stretch", "cuts")
    else:
        docs = docs.withColumn("range", F.lit(0))
    # at most MOST_RANGES rows
    heads = docs.groupBy("range").agg(F.max("key").alias("head")).orderBy("range").collect()
    closes = [(h["head"], heads[i - 1]["range"]) for i, h in enumerate(heads)]
    table = docs.sparkSession.createDataFrame(closes, "head long, closes int")
    both = docs.join(F.broadcast(table), docs["key"] == table["head"], "left")
    place = lambda r, copy: F.struct(r.alias("range"), F.lit(copy).alias("copy"))
    places = F.when(F.col("closes").isNull(), F.array(place(F.col("range"), False))).otherwise(F.array(place(F.col("range"), False), place(F.col("closes"), True)))
    return both.withColumn("at", F.explode(places)).select("doc_id", "text", "key", "at.range", "at.copy")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of an edit of it, and their likenesses; one row per document.

    The edit replaces the last third of the code points by as many from the start of the next
    document, in descending order of ids; the first follows the last. Null texts count as empty. Null
    ids come last and rows that share an id are ordered by their texts. A table of one row has itself
    as its next document. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _in_ranges(rows.withColumn("key", F.coalesce("doc_id", F.lit(_NULL_ID))))
    order = Window.partitionBy("range").orderBy("copy", F.col("key").desc(), "text")
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    one = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - int(length(text) div 3))"), F.substring("next_text", F.lit(1), cut)))
    two = one.select("doc_id", "range", "copy", "key", "text", n.cast("long").alias("n_chars"), "edited", fingerprint(F.col("text")).alias("fingerprint"))
    three = two.withColumn("next_print", F.lead("fingerprint").over(order)).where("not copy")
    four = three.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    places = F.transform(differing_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint")), lambda p: F.concat(p["section"].cast("string"), F.lit(":"), p["paragraph"].cast("string")))
    return four.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
        F.array_join(places, ",").alias("edited_places"),
    )
