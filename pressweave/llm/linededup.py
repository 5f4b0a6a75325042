"""Line deduplication by content-defined chunks, with DataFrame functions only.

A text is cut into lines: after every line feed, and after every sentence end, so that passages inside long lines
are seen as well. A rolling hash over the hashes of the last two lines decides where a chunk ends, so that equal
passages get equal chunks wherever they stand. Chunks of two lines or more that stand in the corpus more than once
are compared byte by byte and stay only where they come first.

With ``whole`` every two lines that follow each other and every single line of many words are keys beside the chunks,
so a repeated passage goes with all its whole lines, whatever stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

LINE_END = r"(?<=[\n ])(?<=\n|[.!?] )"
#: One boundary in so many lines.
DIVISOR = 3
MIN_LINES = 2
MIN_CHARS = 40
#: With ``whole`` a single line of so many words counts as a passage.
MIN_WORDS = 50
BLANK = " \n\r\t"
#: Up to so many chunk hashes are sent to all executors; more are shuffled.
BROADCAST_KEYS = 2_000_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """The lines with their ends; put together they are the text and a line feed, so that the last line ends like others."""
    return F.array_remove(F.split(F.concat(F.coalesce(text, F.lit("")), F.lit("\n")), LINE_END), "")


def line_hash(line: Column) -> Column:
    """32 bits of a line without the spaces at its end."""
    return F.conv(F.substring(F.md5(F.rtrim(line).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _spans(cut_lines: Column) -> Column:
    """``(s, n, t)``: first line (from 0), number of lines and text of each chunk, without spaces at its end."""
    def rolled(hashes):
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(hashes, F.lit(1), F.size(hashes) - 1))
        return F.zip_with(hashes, before, lambda h, b: (F.lit(31).cast("bigint") * b + h) % DIVISOR == 0)

    def spans(flags):
        at = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
        return let(F.array_distinct(F.concat(at, F.array(F.size(flags) - 1))), lambda ends: F.zip_with(
            F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e: e + 1)), ends,
            lambda s, e: F.struct(s.alias("s"), (e - s + 1).alias("n"))))

    return let(cut_lines, lambda ls: F.transform(let(rolled(F.transform(ls, line_hash)), spans), lambda x: F.struct(
        x["s"].alias("s"), x["n"].alias("n"), F.rtrim(F.array_join(F.slice(ls, x["s"] + 1, x["n"]), "")).alias("t"))))


def _long_spans(cut_lines: Column) -> Column:
    return F.filter(_spans(cut_lines), lambda x: (x["n"] >= MIN_LINES) & (F.char_length(x["t"]) >= MIN_CHARS))


def chunks(base: DataFrame) -> DataFrame:
    """``(_d, _t, s, n, t, h)`` of every chunk that is long enough to be removed."""
    return base.select("_d", "_t", F.inline(_long_spans(lines(F.col("_x"))))).withColumn("h", F.xxhash64("t"))


def pairs(base: DataFrame) -> DataFrame:
    """``(_d, _t, s, n, t, h)`` of every two neighbouring lines (blank ones between them belong to them), long line and chunk."""
    def keyed(ls):
        return let(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("x"))), lambda x: x["x"] != ""), spans)

    def spans(full):
        after = F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0)))
        two = F.zip_with(F.slice(full, 1, F.size(after)), after, lambda a, b: F.struct(
            a["i"].alias("s"), (b["i"] - a["i"] + 1).alias("n"), F.concat(a["x"], F.lit("\n"), b["x"]).alias("t")))
        one = F.transform(F.filter(full, lambda a: (F.length(a["x"]) >= 2 * MIN_WORDS - 1) & (F.size(F.split(a["x"], r"\s+", MIN_WORDS)) >= MIN_WORDS)),
                          lambda a: F.struct(a["i"].alias("s"), F.lit(1).alias("n"), a["x"].alias("t")))
        return F.concat(F.filter(two, lambda x: F.char_length(x["t"]) > MIN_CHARS), one)
    return base.select("_d", "_t", F.inline(let(lines(F.col("_x")), lambda ls: F.concat(keyed(ls), _long_spans(ls))))).withColumn("h", F.xxhash64("t"))


def _merged(spans: Column) -> Column:
    """Sorted spans that may overlap, as sorted spans that don't."""
    return let(F.sort_array(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))), lambda at: F.zip_with(
        F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1)), F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1)),
        lambda s, e: F.struct(s.alias("s"), (e - s + 1).alias("n"))))


def _kept(text: Column, removed: Column) -> Column:
    """What is left of a text without the sorted spans."""
    def put(ls):
        starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["s"] + r["n"]))
        ends = F.concat(F.transform(removed, lambda r: r["s"]), F.array(F.size(ls)))
        left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(ls, a + 1, F.greatest(b - a, F.lit(0))), "")), "")
        last = F.element_at(removed, -1)
        return F.when(last["s"] + last["n"] == F.size(ls), left).otherwise(F.left(left, F.char_length(left) - 1))
    return let(lines(text), put)


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``(_d, _t, removed)``: the spans of lines to take out of each document that has any, in order.

    The first place of a chunk, and with ``whole`` of a pair or long line, stays (least key, then first line)."""
    keyed = pairs if whole else chunks
    base = docs.select(F.col(doc_id).alias("_d"), F.xxhash64(F.col(text).cast("string")).alias("_t"), F.col(text).cast("string").alias("_x"))
    keys = cut(keyed(base).groupBy("h").count().where("count > 1").select("h"))
    small = keys.count() <= BROADCAST_KEYS
    again = cut(keyed(base).join(F.broadcast(keys) if small else keys, "h", "left_semi"))
    # written, so that both sides of the join are plain shuffles and a chunk with very many places is split over tasks
    first = cut(again.groupBy("h", "t").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("_d", "_t", "s")).alias("first")).where("many > 1"))
    later = again.join(first, ["h", "t"]).where(~F.struct("_d", "_t", "s").eqNullSafe(F.col("first")))
    found = later.groupBy("_d", "_t").agg(F.sort_array(F.collect_set(F.struct("s", "n"))).alias("removed"))
    return found.withColumn("removed", _merged(F.col("removed"))) if whole else found


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None,
                drop_emptied: bool = False, removed_lines: str | None = None, whole: bool = False) -> DataFrame:
    """``docs`` with later copies of repeated chunks taken out of ``text``, and ``n_chars`` (if named) counted anew.

    With ``whole`` all lines go as well that stand in a repeated pair of lines, or hold many words and are repeated.

    A null or empty text stays as it is. Rows equal in key and text are one document here and keep the same; other
    columns are untouched, whatever their names; ``removed_lines`` names a column for the number of lines taken. With ``drop_emptied`` documents of which nothing but white space
    is left go; otherwise they stay with what is left."""
    gone = removals(docs, doc_id, text, whole)
    packed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_d2"), F.xxhash64(F.col(text).cast("string")).alias("_t2"))
    joined = packed.join(gone, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2")), "left")
    gone_lines = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<s:int,n:int>>")), F.lit(0).cast("bigint"), lambda a, r: a + r["n"])
    new = joined.select("_row", F.col("removed").isNotNull().alias("_changed"), gone_lines.alias("_gone"), F.when(
        F.col("removed").isNotNull(), _kept(F.col("_row")[text], F.col("removed"))).otherwise(F.col("_row")[text]).alias("_new"))
    if drop_emptied:
        new = new.where(~(F.col("_changed") & (F.btrim("_new", F.lit(BLANK)) == "")))
    out = []
    for f in docs.schema.fields:
        if f.name == text:
            out.append(F.col("_new").alias(text))
        elif f.name == n_chars:
            out.append(F.when(F.col("_changed"), F.char_length("_new")).otherwise(F.col("_row")[f.name]).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col("_row")[f.name].alias(f.name))
    if removed_lines:
        out.append(F.col("_gone").alias(removed_lines))
    return new.select(*out)
