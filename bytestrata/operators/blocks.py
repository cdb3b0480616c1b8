"""Recognition, dissection and the questions asked of labelled ranges, over a BINARY column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytestrata.formats.tree import Node, View, flat
from bytestrata.formats.walkers import dissect
from bytestrata.operators.recognise import REGISTERED, Bytes, identify

BLOCKS = "idx int, parent int, depth int, label string, start long, end long, expandable boolean, default_expanded boolean"


NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
ROWS_AT_ONCE = 16_384
CHUNK_LINES = 4096
_WALKERS: dict[str, Callable[[View], list[Node]]] = {}


def register_dissector(name: str, rule: Callable[[Bytes], Column], walker: Callable[[View], list[Node]], before: str | None = None) -> None:
    """Adds a format to the ladder, before the named one or last, or replaces the one added under this name."""
    REGISTERED[:] = [r for r in REGISTERED if r[0] != name] + [(name, rule, before)]
    _WALKERS[name] = walker


_LADDERS: dict[tuple, Column] = {}


def _file_type() -> Column:
    """identify() of a column "content", built once an application: it is some thousand calls to the JVM."""
    app = SparkContext._active_spark_context
    if app is None:
        return identify(F.col("content"))
    known = (app.applicationId, *((name, id(rule), before) for name, rule, before in REGISTERED))
    if known not in _LADDERS:
        _LADDERS.clear()
        _LADDERS[known] = identify(F.col("content"))
    return _LADDERS[known]


def blocks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """files(key, content) -> a row per labelled range, with key and file_type. Null content gives no row. A content's rows
    leave in parts of ROWS_AT_ONCE; contents themselves come in batches that Spark bounds by bytes."""
    bare = files.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"))
    slim = bare.select("key", "content", _file_type().alias("file_type"))
    kind, more = slim.schema["key"].dataType.simpleString(), dict(_WALKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(batch: pa.RecordBatch, who: list[int], rows: list[tuple]) -> pa.RecordBatch:
            at = pa.array(who, pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *cols], ["key", "file_type", *NAMES])

        for batch in batches:
            who, rows = [], []
            for i, (data, name) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                own = flat(dissect(name.as_py(), data.as_py(), more))
                who += [i] * len(own)
                rows += own
                while len(rows) >= ROWS_AT_ONCE:
                    yield told(batch, who[:ROWS_AT_ONCE], rows[:ROWS_AT_ONCE])
                    who, rows = who[ROWS_AT_ONCE:], rows[ROWS_AT_ONCE:]
            if rows:
                yield told(batch, who, rows)

    return slim.mapInArrow(run, f"key {kind}, file_type string, {BLOCKS}").withColumnRenamed("key", key)


def line_count(size: Column, width: int = 16) -> Column:
    """Hex lines of a content of this many bytes."""
    return F.ceil(size / width).cast("long")


def hex_lines(files: DataFrame, key: str = "path", content: str = "content", width: int = 16) -> DataFrame:
    """(key, line, text): address, hex bytes padded to the line's width, a space, printable ASCII with dots for the rest.
    Contents are cut into chunks of CHUNK_LINES lines first, so that no row holds more lines and no line a whole content."""
    c, step = F.col(content), CHUNK_LINES * width
    zero = F.lit(0).cast("long")
    chunks = files.where(F.octet_length(c) > 0).select(key, c.alias("c"), F.explode(F.sequence(zero, F.ceil(F.octet_length(c) / step).cast("long") - 1)).alias("chunk"))
    chunks = chunks.select(key, "chunk", F.substring("c", (F.col("chunk") * step + 1).cast("int"), F.lit(step)).alias("c"))
    part = chunks.withColumn("at", F.explode(F.sequence(zero, line_count(F.octet_length("c"), width) - 1)))
    part = part.select(key, (F.col("chunk") * CHUNK_LINES + F.col("at")).alias("line"), F.substring("c", (F.col("at") * width + 1).cast("int"), F.lit(width)).alias("b"))
    pairs = F.rpad(F.regexp_replace(F.lower(F.hex("b")), "(..)", "$1 "), F.lit(3 * width), F.lit(" "))
    chars = F.regexp_replace(F.decode("b", "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
    digits = F.lower(F.hex(F.col("line") * width))
    address = F.when(F.length(digits) < 8, F.lpad(digits, F.lit(8), F.lit("0"))).otherwise(digits)
    return part.select(key, "line", F.concat(address, F.lit("  "), pairs, F.lit(" "), chars).alias("text"))


def visible_lines(lines: DataFrame, first: Column, count: Column) -> DataFrame:
    """The hex lines on a screen of ``count`` lines that begins with line ``first``, and the one that is cut off below."""
    return lines.where((F.col("line") >= first) & (F.col("line") < first + count + 1))


def click_offset(line: Column, column: Column, size: Column, width: int = 16) -> Column:
    """The offset of the byte at a column of a hex line, in its hex or its character part; null elsewhere and past the end."""
    hexes, chars = 10, 10 + 3 * width + 1
    at = F.when((column >= hexes) & (column < chars), F.floor((column - hexes) / 3)).when((column >= chars) & (column < chars + width), column - chars)
    offset = line * width + at
    return F.when((at < width) & (offset < size), offset).cast("long")


def scroll_target(start: Column, first: Column, count: Column, size: Column, width: int = 16) -> Column:
    """The first line on screen after a range is selected: unchanged where its line is visible, else that line in the middle,
    as far as the content's lines allow."""
    line, last = F.floor(start / width), F.greatest(F.lit(0), line_count(size, width) - count)
    return F.when((line >= first) & (line < first + count), first).otherwise(F.least(last, F.greatest(F.lit(0), line - F.floor(count / 2)))).cast("long")


def highlight(ranges: DataFrame, key: str = "path", width: int = 16) -> DataFrame:
    """ranges(key, start, end) -> (key, line, hl_start, hl_end): the part of each hex line that the range covers."""
    step = CHUNK_LINES * width
    full = ranges.where("end > start").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step))))
    part = full.select(key, F.greatest("start", F.col("chunk") * step).alias("start"), F.least("end", (F.col("chunk") + 1) * step).alias("end"))
    lines = part.withColumn("line", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return lines.select(key, "line", F.greatest("start", F.col("line") * width).alias("hl_start"), F.least("end", (F.col("line") + 1) * width).alias("hl_end"))


def _by_shuffle(df: DataFrame) -> DataFrame:
    """df, never to be broadcast: Spark takes a block table to be as small as the contents it comes from, and the keys of a
    compressed file to be as small as the file, so that either would be built whole on the driver."""
    return df.hint("merge")


def leaf_at(tree: DataFrame, offsets: DataFrame, key: str = "path") -> DataFrame:
    """offsets(key, offset) -> (key, offset, idx, label): from the top, the first child in order that holds the offset; idx -1
    and no label where no range does."""
    asked = offsets.select(key, "offset").distinct()
    hit = tree.join(_by_shuffle(asked), key).where("start <= offset and offset < end").select(key, "offset", "idx", "parent", "label")
    first = hit.groupBy(key, "offset", "parent").agg(F.min(F.struct("idx", "label")).alias("first"))
    # A node counts if its parent does; descend by collecting the first children, of which a node has one at most.
    own = first.groupBy(key, "offset").agg(F.map_from_entries(F.collect_list(F.struct("parent", "first"))).alias("next"))
    found = F.struct(F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("label"))
    walk = F.aggregate(F.sequence(F.lit(1), F.size("next")), found, lambda at, _: F.coalesce(F.try_element_at(F.col("next"), at["idx"]), at))
    leaves = own.select(key, "offset", walk.alias("leaf"))
    return offsets.join(_by_shuffle(leaves), [key, "offset"], "left").select(key, "offset", F.coalesce("leaf.idx", F.lit(-1)).alias("idx"), F.col("leaf.label").alias("label"))


def parents(tree: DataFrame, key: str = "path") -> DataFrame:
    """Each range with the label and bounds of the one around it; null at the top."""
    around = tree.select(key, F.col("idx").alias("parent"), F.col("label").alias("parent_label"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end"))
    return tree.join(_by_shuffle(around), [key, "parent"], "left")


def ancestors(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, ancestor, steps): all ranges around each range, the nearest first. A join a level, as many as the tree is
    deep; ranges whose ancestors are all found take no part in later ones."""
    links = tree.where("parent >= 0").select(key, "idx", "parent", "depth")
    deepest = links.agg(F.max("depth")).first()[0] or 0
    now = links.select(key, "idx", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    out, up = now, links.select(key, F.col("idx").alias("ancestor"), "parent")
    for step in range(2, deepest + 1):
        now = now.join(_by_shuffle(up), [key, "ancestor"]).select(key, "idx", F.col("parent").alias("ancestor"), F.lit(step).alias("steps"))
        out = out.unionByName(now)
    return out


def coverage_gaps(tree: DataFrame, sizes: DataFrame, key: str = "path") -> DataFrame:
    """sizes(key, size) -> (key, start, end): the runs of bytes that no top range covers."""
    ends = tree.where("parent = -1").select(key, "start", "end").unionByName(sizes.select(key, F.col("size").cast("long").alias("start"), F.col("size").cast("long").alias("end")))
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ends.withColumn("before", before).where("start > before").select(key, F.col("before").alias("start"), F.col("start").alias("end"))


def file_status(size: Column, file_type: Column) -> Column:
    return F.format_string("Size: %d bytes, Type: %s | Dissected as: %s", size, file_type, file_type)


def selection_status(start: Column, end: Column) -> Column:
    """Size and inclusive bounds of a selection; a dash where it is empty."""
    size = end - start
    return F.when(size > 0, F.format_string("Selection: %d bytes, Range: 0x%x-0x%x (%d-%d)", size, start, end - 1, start, end - 1)).otherwise("-")
