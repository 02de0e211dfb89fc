"""Line dedup by distinct-site spread: drop lines that very many sites share.

Each line's sites are counted by a HyperLogLog sketch, built and merged by aggregation. Lines whose
estimate is near the threshold get an exact distinct count. A line on ``min_sites`` sites or more is
boilerplate and stays only where it comes first (smallest document, then position), so that text which
was copied as a whole survives once. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A sketch of 2^12 registers has a relative standard error of 1.6 %; 12 of those count as near.
LG_K, NEAR = 12, 0.2
#: Boilerplate lines are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_LINES = 200_000


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc_id, row_key, site, pos, line): a row for each line that isn't blank, the line as a hash."""
    hashes = F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) != "", F.unhex(F.md5(F.trim(x)))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row_key"), "site", F.posexplode(hashes).alias("pos", "line"))
    return rows.where("line is not null")


def _with(lines: DataFrame, some: DataFrame) -> DataFrame:
    """Lines joined to a smaller table by hash, broadcast only below a checked bound."""
    return lines.join(F.broadcast(some) if some.count() <= BROADCAST_LINES else some, "line")


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first_doc, first_pos) of the lines on ``min_sites`` distinct sites or more."""
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "pos")
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("site").alias("n"), F.min(place).alias("first"))
    # fewer rows than sites asked for need no estimate
    spread = spread.where(F.col("n") >= min_sites).select("line", F.hll_sketch_estimate("sketch").alias("sites"), "first")
    spread = written(spread.where(F.col("sites") >= (1 - NEAR) * min_sites), "spread")
    near = F.col("sites") <= (1 + NEAR) * min_sites
    exact = _with(lines.select("line", "site"), spread.where(near).select("line")).distinct().groupBy("line").agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites)
    sure = spread.where(~near).select("line", "first").unionByName(spread.where(near).join(exact, "line", "left_semi").select("line", "first"))
    return sure.select("line", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, plus ``n_lines`` and ``n_removed``.

    Lines are compared without spaces at their ends; blank lines are never removed. A null site adds
    to no line's spread. Null texts stay null with 0 lines. Rows with a null id come after all others
    when a line's first place is chosen. Repeated rows get the same text. All other columns are kept;
    columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    lines = written(_lines(docs, id_col, text_col, site_col), "lines")
    found = written(boilerplate_lines(lines, min_sites), "boilerplate")
    here = (F.coalesce("doc_id", F.lit((1 << 63) - 1)) != F.col("first_doc")) | (F.col("pos") != F.col("first_pos"))
    gone = _with(lines, found).where(here)
    # removed positions of a text as bits, 64 to a number
    bits = gone.groupBy("doc_id", "row_key", F.expr("pos div 64").cast("int").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    removed = bits.groupBy(F.col("doc_id").alias("_gf_id"), F.col("row_key").alias("_gf_key")).agg(
        F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("_gf_bits"), F.max("block").alias("_gf_last"), F.sum(F.bit_count("bits")).alias("_gf_n")
    )
    both = docs.join(removed, F.col(id_col).cast("long").eqNullSafe(F.col("_gf_id")) & (F.xxhash64(text_col) == F.col("_gf_key")), "left")
    dense = F.transform(F.sequence(F.lit(0), F.col("_gf_last")), lambda b: F.coalesce(F.element_at("_gf_bits", b), F.lit(0).cast("long")))
    both = both.withColumn("_gf_dense", F.when(F.col("_gf_n").isNotNull(), dense))
    parts = F.expr(f"filter(split(`{text_col}`, '\n'), (x, i) -> i div 64 > _gf_last or (shiftright(element_at(_gf_dense, cast(i div 64 as int) + 1), cast(i % 64 as int)) & 1L) = 0)")
    text = F.when(F.col("_gf_n").isNull(), F.col(text_col)).otherwise(F.array_join(parts, "\n"))
    n_lines = F.coalesce(F.size(F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    out = both.withColumns({"n_lines": n_lines, "n_removed": F.coalesce("_gf_n", F.lit(0)).cast("long")}).withColumn(text_col, text)
    return out.drop("_gf_id", "_gf_key", "_gf_bits", "_gf_last", "_gf_n", "_gf_dense")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with boilerplate lines removed; documents that lose every line go, all others stay."""
    columns = docs.columns
    # counts of the lines take names of their own, so that a column of these names stays as it is
    held = {c: f"_gf_own_{c}" for c in ("n_lines", "n_removed") if c in columns}
    out = dedup_lines(docs.withColumnsRenamed(held), id_col, text_col, **how)
    out = out.where("not (n_removed > 0 and n_removed = n_lines)").drop("n_lines", "n_removed")
    return out.withColumnsRenamed({new: c for c, new in held.items()}).select(*columns)


#: DuckDB SQL for the digests of ``dedup_lines`` over ``documents``.
DIGEST_SQL = """
with lines as (
  select doc_id, source, u.pos - 1 as pos, u.line as raw, trim(u.line) as line
  from documents, lateral (select unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos) u
), spread as (
  select line, arg_min(doc_id, (doc_id, pos)) as first_doc, arg_min(pos, (doc_id, pos)) as first_pos
  from lines where line <> '' group by line having count(distinct source) >= 10
), marked as (
  select l.*, s.line is not null and not (l.doc_id = s.first_doc and l.pos = s.first_pos) as gone
  from lines l left join spread s on l.line = s.line
), digested as (
  select doc_id, cast(count(*) filter (where line <> '') as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_removed,
    sha256(coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '')) as text_sha256
  from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(text_sha256, sha256('')) as text_sha256
from documents d left join digested using (doc_id)
"""


def line_digests(docs: DataFrame, **how) -> DataFrame:
    """One row per document: ``n_lines`` that aren't blank, ``n_removed``, and ``text_sha256`` of what is left."""
    out = dedup_lines(docs, **how)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
