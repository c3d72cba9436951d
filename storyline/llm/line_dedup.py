"""Operator 6: line dedup, DataFrame functions only.

1. Explode the lines of every text, normalise them to keys, hash the keys of at
   least ``min_chars`` code points to 128 bits.
2. One row for each (document, hash), then for each hash the number of documents
   that hold it and the smallest of their ids; partial aggregation makes a
   line that a third of the corpus repeats one row for each task.
3. The lines meet the hashes that are over the threshold, by an equi-join whose hot
   hashes Spark may split; the positions that must go are gathered by row (the
   document and its text's hash), bounded by the row's own lines.
4. Rows meet their own positions; the other lines are put together again by position.
   Every step is linear in the number of lines, of a single document, too.

A line is dropped from every document but the one with the smallest id, which
keeps all its copies.  Results for special cases: null and empty texts have one
empty line and stay empty texts (a null text stays null where nothing goes);
null ids count as one document after all others, whose rows are gathered each on its
own; rows that repeat an id are one document, each row treated alike; short keys are always kept; other columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 10, 2
LAST = (1 << 63) - 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the document (LAST for null) and 128 bits of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(text), F.xxhash64(F.lit("text"), text)]


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, t, u (the row's key) and gone (positions from 0): what each row loses."""
    doc, t, u = row_key(id_col, text_col)
    held = (
        docs.select(doc.alias("doc"), t.alias("t"), u.alias("u"), lines(F.translate(F.col(text_col), UPPER, LOWER)).alias("lines"))
        .select("doc", "t", "u", F.posexplode("lines").alias("pos", "line"))  # the text's hashes are made before, not for each line
        .withColumn("key", F.btrim("line", F.lit(BLANKS)))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "t", "u", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("line"), "key").alias("b"))
    )
    found = held.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    if min_docs > 2:
        found = held.select("doc", "a", "b").distinct().groupBy("a", "b").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    else:
        found = found.where("first <> last")
    # as a table of its own, so that both sides of the join are plain shuffles, whose hot partitions Spark splits
    found = written(found.select("a", "b", "first"), "repeated-lines")
    gone = held.join(found, ["a", "b"]).where("doc <> first")
    return gone.groupBy("doc", "t", "u").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with its text less the dropped lines; ``counts`` names two more columns, lines before and lines dropped.

    Columns of ``docs`` may have any names; names of ``counts`` must be new ones.
    """
    if counts and {x.lower() for x in counts} & {x.lower() for x in docs.columns}:
        raise ValueError(f"docs has columns named like {counts}")
    names = [unused(docs.columns, x) for x in ("doc", "t", "u")]
    gone_col = unused(docs.columns, "gone")
    lost = dropped_lines(docs, id_col, text_col, min_chars, min_docs).select(*(F.col(c).alias(n) for c, n in zip(("doc", "t", "u"), names, strict=True)), F.col("gone").alias(gone_col))
    met = docs.select("*", *(c.alias(n) for c, n in zip(row_key(id_col, text_col), names, strict=True))).join(lost, names, "left")
    text, gone = F.col(text_col), F.col(gone_col)
    n_lines = F.size(lines(text))
    # both arrays are bound once, so that taking a line by its position is one step
    both = F.struct(lines(text).alias("lines"), F.array_except(F.sequence(F.lit(0), n_lines - 1), gone).alias("kept"))
    left = F.transform(F.array(both), lambda x: F.array_join(F.transform(x["kept"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    new_text = F.when(gone.isNull(), text).otherwise(left).alias(text_col)
    more = [n_lines.cast("long").alias(counts[0]), F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(counts[1])] if counts else []
    return met.select(*(new_text if c == text_col else F.col(f"`{c}`") for c in docs.columns), *more)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    done = line_dedup(docs.select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
