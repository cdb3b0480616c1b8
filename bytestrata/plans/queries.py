"""Driver queries of the engine: rows of the tables encoded to bytes, dissected, and asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.operators import blocks as B
from bytestrata.plans import formats


def _le(c: Column, width: int) -> Column:
    """The lowest bytes of a number, lowest first."""
    h = F.lpad(F.hex(c.cast("long")), F.lit(16), F.lit("0"))
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(width))))


def _be(c: Column, width: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(c.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * width)))


def _raw(b: bytes) -> Column:
    return F.lit(b)


def _part_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    zero = F.lit(0)
    content = F.concat(
        _raw(b"BM"), _le(F.lit(70), 4), _le(zero, 4), _le(F.lit(54), 4), _le(F.lit(40), 4), _le(F.col("p_size"), 4), _le(F.col("p_partkey"), 4), _le(F.lit(1), 2),
        _le(F.lit(24), 2), _le(zero, 4), _le(F.lit(16), 4), _le(F.lit(2835), 4), _le(F.lit(2835), 4), _le(zero, 8), _raw(bytes(16)),
    )
    return p.select(F.col("p_partkey").alias("path"), content.alias("content"))


def bmp_fields(spark: SparkSession, d: str) -> DataFrame:
    return B.blocks(_part_bitmaps(spark, d)).where("parent <> -1 and label rlike '^(Width|Height|Compression)'").select("path", "label", "start", "end")


def identify_magic(spark: SparkSession, d: str) -> DataFrame:
    magic = [b"BM", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"\x1f\x8b", b"\xff\xd8", b"fLaC", b"plain"]
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % len(magic)).alias("k"))
    c = F.element_at(F.array(*map(_raw, magic)), (F.col("k") + 1).cast("int"))
    return rows.groupBy(B.identify(c).alias("file_type")).agg(F.count("*").alias("n"))


def tar_entries(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    field = lambda s, n: F.rpad(s, F.lit(n), F.lit("\0"))
    octal = F.lpad(F.conv(F.col("c_nationkey").cast("string"), 10, 8), F.lit(11), F.lit("0"))
    head = F.concat(field(F.col("c_name"), 100), field(F.lit("0000644"), 8), field(F.lit(""), 16), field(octal, 12), field(F.lit("0"), 12), field(F.lit(""), 8), F.lit("0"), field(F.lit(""), 100), field(F.lit("ustar"), 8), field(F.lit(""), 247))
    content = F.concat(head, field(F.repeat(F.lit("x"), F.col("c_nationkey")), 512), field(F.lit(""), 512))
    return B.blocks(c.select(F.col("c_custkey").alias("path"), content.cast("binary").alias("content"))).where("label rlike '^(File: |Size: |File data)'").select("path", "label", "start", "end")


def png_ihdr(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    content = F.concat(_raw(b"\x89PNG\r\n\x1a\n"), _be(F.lit(13), 4), _raw(b"IHDR"), _be(F.col("o_custkey"), 4), _be(F.col("o_orderkey"), 4), _raw(b"\x08\x02\0\0\0"), _raw(bytes(4)))
    return B.blocks(o.select(F.col("o_orderkey").alias("path"), content.alias("content"))).where("label rlike '^(Width|Height|Color type)'").select("path", "label", "start", "end")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))


def hexdump_lines(spark: SparkSession, d: str) -> DataFrame:
    return B.hex_lines(_texts(spark, d))


def visible_lines(spark: SparkSession, d: str) -> DataFrame:
    return B.visible_lines(B.hex_lines(_texts(spark, d)), F.col("path") % 7, F.lit(2))


def offset_lookup(spark: SparkSession, d: str) -> DataFrame:
    tree = B.blocks(_part_bitmaps(spark, d))
    offsets = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("offset"))
    return B.leaf_at(tree, offsets).select("path", "offset", "label")


def highlight_lines(spark: SparkSession, d: str) -> DataFrame:
    return B.highlight(B.blocks(_part_bitmaps(spark, d)).where("label = 'DIB header'"))


def block_stats(spark: SparkSession, d: str) -> DataFrame:
    tree = B.blocks(_part_bitmaps(spark, d))
    return tree.groupBy("file_type", "depth").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"))


def selection_status(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    start = F.col("p_partkey").cast("long")
    return p.select("p_partkey", B.selection_status(start, start + F.col("p_size") - 1).alias("status"))


def gif_screen(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    content = F.concat(_raw(b"GIF89a"), _le(F.col("p_partkey"), 2), _le(F.col("p_size"), 2), _raw(b"\0\0\0!\xfe"), _le(F.col("p_size"), 1), F.repeat(F.lit("c"), F.col("p_size")).cast("binary"), _raw(b"\0;"))
    return B.blocks(p.select(F.col("p_partkey").alias("path"), content.alias("content"))).where("label rlike '^(Canvas|Sub-block|Trailer)'").select("path", "label", "start", "end")


def ogg_pages(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 200 + 1).alias("n"))
    head = F.concat(_raw(b"OggS\0\4"), _le(F.col("o_orderkey"), 8), _raw(bytes(12)), _raw(b"\1"), _le(F.col("n"), 1))
    content = F.concat(head, F.repeat(F.lit("p"), F.col("n").cast("int")).cast("binary"))
    return B.blocks(o.select(F.col("o_orderkey").alias("path"), content.alias("content"))).where("label rlike '^(Granule|Header type|Payload)'").select("path", "label", "start", "end")


def macho_commands(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")
    head = F.concat(_raw(b"\xcf\xfa\xed\xfe\x07\0\0\1\3\0\0\0\2\0\0\0\2\0\0\0"), _le(F.col("c_nationkey") + 16, 4), _raw(bytes(8)))
    content = F.concat(head, _raw(b"\x28\0\0\x80"), _le(F.col("c_nationkey") + 8, 4), F.repeat(F.lit("x"), F.col("c_nationkey").cast("int")).cast("binary"), _raw(b"\2\0\0\0\x08\0\0\0"))
    return B.blocks(c.select(F.col("c_custkey").alias("path"), content.alias("content"))).where("label rlike '^(Load command|Command size|CPU type)'").select("path", "label", "start", "end")


WHOLE = ("path", "file_type", "idx", "parent", "depth", "label", "start", "end", "expandable", "default_expanded")


def bzip2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole block tables of empty streams whose end marker holds the key."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    return B.blocks(p.select(F.col("p_partkey").alias("path"), F.concat(_raw(b"BZh9\x17\x72\x45\x38\x50\x90"), _be(F.col("p_partkey"), 4), _raw(b"rest")).alias("content"))).select(*WHOLE)


def atari_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole block tables of programs with one symbol and two fixups."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    head = F.concat(_raw(b"\x60\x1a"), _be(F.col("p_size"), 4), _raw(bytes(8)), _be(F.lit(14), 4), _raw(bytes(10)))
    symbol = F.concat(_raw(b"main\0\0\0\0\xa2\0"), _be(F.col("p_partkey"), 4))
    content = F.concat(head, F.repeat(F.lit("N"), F.col("p_size")).cast("binary"), symbol, _be(F.col("p_size"), 4), _raw(b"\1\4\0"))
    return B.blocks(p.select(F.col("p_partkey").alias("path"), content.alias("content"))).select(*WHOLE)


def dos_com_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole block tables of images that call one DOS function."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    content = F.concat(_raw(b"\xb8"), _le(F.col("p_partkey"), 1), _raw(b"\x4c\xcd\x21"))
    return B.blocks(p.select(F.col("p_partkey").alias("path"), content.alias("content"))).select(*WHOLE)


def jpeg_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole block tables of images with a JFIF segment, a frame and a scan."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    jfif = F.concat(_raw(b"\xff\xe0\0\x10JFIF\0\1\2\1"), _be(F.col("p_size"), 2), _be(F.col("p_size"), 2), _raw(bytes(2)))
    frame = F.concat(_raw(b"\xff\xc0\0\x0b\x08"), _be(F.col("p_size"), 2), _be(F.col("p_partkey") % 65536, 2), _raw(b"\1\1\x11\0"))
    scan = F.concat(_raw(b"\xff\xda\0\x08\1\1\0\0\x3f\0"), F.repeat(F.lit("s"), F.col("p_size")).cast("binary"), _raw(b"\xff\0\xff\xd9"))
    return B.blocks(p.select(F.col("p_partkey").alias("path"), F.concat(_raw(b"\xff\xd8"), jfif, frame, scan).alias("content"))).select(*WHOLE)


def file_status(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    content = F.concat(F.element_at(F.array(_raw(b"fLaC"), _raw(b"GIF89a"), _raw(b"text")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.repeat(F.lit("."), (F.col("o_orderkey") % 5).cast("int")).cast("binary"))
    return o.select("o_orderkey", B.file_status(F.octet_length(content), B.identify(content)).alias("status"))


def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return B.ancestors(B.blocks(_part_bitmaps(spark, d)))


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    return B.parents(B.blocks(_part_bitmaps(spark, d))).where("depth > 0").groupBy("path", "parent_label", "parent_start", "parent_end").agg(F.count("*").alias("n"))


def missing_offsets(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    offsets = p.select(F.col("p_partkey").alias("path"), (F.col("p_size") + 45).cast("long").alias("offset"))
    return B.leaf_at(B.blocks(_part_bitmaps(spark, d)), offsets)


def click_offsets(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    return p.select("p_partkey", B.click_offset((F.col("p_partkey") % 6).cast("long"), (F.col("p_size") * 2).cast("long"), F.lit(70)).alias("offset"))


def scroll_targets(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    return p.select("p_partkey", B.scroll_target(F.col("p_partkey").cast("long") * 3, F.col("p_size").cast("long"), F.lit(21), F.lit(4000)).alias("first_line"))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that no top range covers: between header and pixels, and after the declared end."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("path"), (F.col("p_size") % 5).alias("k"))
    head = F.concat(_raw(b"BM"), _le(F.col("k") + 60, 4), _raw(bytes(4)), _le(F.col("k") + 54, 4), _le(F.lit(40), 4), _raw(bytes(36)))
    files = p.select("path", F.concat(head, F.repeat(F.lit("p"), F.col("k") + 8).cast("binary")).alias("content"))
    return B.coverage_gaps(B.blocks(files), files.select("path", F.octet_length("content").alias("size")))


def _whole(kind: str, rows: list[tuple[int, int, str, str, str, bool, bool]]) -> str:
    """SQL of whole block tables of part: (parent, depth, label, start, end, expandable, default_expanded) in SQL, in order."""
    one = "SELECT p_partkey AS path, '{}' AS file_type, CAST({} AS INTEGER) AS idx, CAST({} AS INTEGER) AS parent, CAST({} AS INTEGER) AS depth, {} AS label, CAST({} AS BIGINT) AS start, CAST({} AS BIGINT) AS \"end\", {} AS expandable, {} AS default_expanded FROM part"
    return " UNION ALL ".join(one.format(kind, i, parent, depth, label, a, b, str(x).lower(), str(y).lower()) for i, (parent, depth, label, a, b, x, y) in enumerate(rows))


_YES, _NO = (True, True), (False, False)
_BZIP2 = [
    (-1, 0, "'Stream header'", 0, 4, *_YES), (0, 1, "'Signature: BZ'", 0, 2, *_NO), (0, 1, "'Version: h (Huffman)'", 2, 3, *_NO), (0, 1, "'Block size: 9 (900 kB)'", 3, 4, *_NO),
    (-1, 0, "'End of stream'", 4, 14, *_YES), (4, 1, "'End-of-stream magic: 0x177245385090 (sqrt pi)'", 4, 10, *_NO),
    (4, 1, "'Combined stream CRC: 0x' || printf('%08X', p_partkey)", 10, 14, *_NO), (-1, 0, "'Trailing data'", 14, 18, *_NO),
]
_ATARI = [
    (-1, 0, "'GEMDOS program header'", 0, 28, *_YES), (0, 1, "'Magic: 0x601A (BRA.S +26)'", 0, 2, *_NO), (0, 1, "'Text size: ' || p_size", 2, 6, *_NO), (0, 1, "'Data size: 0'", 6, 10, *_NO),
    (0, 1, "'BSS size: 0'", 10, 14, *_NO), (0, 1, "'Symbol table size: 14'", 14, 18, *_NO), (0, 1, "'Reserved: 0x00000000'", 18, 22, *_NO), (0, 1, "'Program flags: 0x00000000'", 22, 26, True, False),
    (7, 2, "'Fastload (bit 0): no'", 22, 26, *_NO), (7, 2, "'Load into TT-RAM (bit 1): no'", 22, 26, *_NO), (7, 2, "'Malloc from TT-RAM (bit 2): no'", 22, 26, *_NO),
    (7, 2, "'Memory protection (bits 4-5): private'", 22, 26, *_NO), (7, 2, "'Shared text (bit 11): no'", 22, 26, *_NO), (7, 2, "'TPA size (bits 28-31): 0 (128 KB minimum TT-RAM)'", 22, 26, *_NO),
    (0, 1, "'Absolute flag: 0 (relocation info present)'", 26, 28, *_NO), (-1, 0, "'Text segment (' || p_size || ' bytes)'", 28, "28 + p_size", *_NO),
    (-1, 0, "'Symbol table (DRI/GST, 1 symbols)'", "28 + p_size", "42 + p_size", True, False), (16, 1, "'main = 0x' || printf('%08X', p_partkey)", "28 + p_size", "42 + p_size", True, False),
    (17, 2, "'Name: main'", "28 + p_size", "36 + p_size", *_NO), (17, 2, "'Type: 0xA200 (defined, global, text based)'", "36 + p_size", "38 + p_size", *_NO),
    (17, 2, "'Value: 0x' || printf('%08X', p_partkey)", "38 + p_size", "42 + p_size", *_NO), (-1, 0, "'Relocation table (2 fixups)'", "42 + p_size", "49 + p_size", *_YES),
    (21, 1, "'First fixup offset: text+0x' || printf('%08X', p_size)", "42 + p_size", "46 + p_size", *_NO), (21, 1, "'Offset byte stream (3 bytes)'", "46 + p_size", "49 + p_size", *_NO),
    (21, 1, "'Fixup targets (2)'", "42 + p_size", "49 + p_size", True, False), (24, 2, "'Fixup: text+0x' || printf('%08X', p_size)", "42 + p_size", "46 + p_size", *_NO),
    (24, 2, "'Fixup: text+0x' || printf('%08X', p_size + 258)", "47 + p_size", "48 + p_size", *_NO),
]
_CALL = "CASE WHEN p_partkey % 256 = 180 THEN 1 ELSE 0 END"  # where the low byte reads as MOV AH
_DOS_COM = [
    (-1, 0, "'Code/data image (5 bytes, loaded at 0100h–0104h)'", 0, 5, *_YES), (0, 1, "'Entry (CS:0100): MOV AX, 4C' || printf('%02X', p_partkey % 256) || 'h'", 0, 3, *_NO),
    (0, 1, "'Possible INT 21h calls (1)'", _CALL, 5, True, False), (2, 2, "'0103h: possible INT 21h, AH=4Ch (exit)'", _CALL, 5, *_NO),
]
_JPEG = [
    (-1, 0, "'SOI'", 0, 2, *_NO), (-1, 0, "'APP0 marker (JFIF)'", 2, 20, *_YES), (1, 1, "'Identifier: JFIF'", 6, 11, *_NO), (1, 1, "'Version: 1.02'", 11, 13, *_NO),
    (1, 1, "'Density units: Pixels per inch (1)'", 13, 14, *_NO), (1, 1, "'X density: ' || p_size", 14, 16, *_NO), (1, 1, "'Y density: ' || p_size", 16, 18, *_NO),
    (1, 1, "'Thumbnail width: 0'", 18, 19, *_NO), (1, 1, "'Thumbnail height: 0'", 19, 20, *_NO), (-1, 0, "'SOF0 marker'", 20, 33, *_YES), (9, 1, "'Precision: 8'", 24, 25, *_NO),
    (9, 1, "'Height: ' || p_size", 25, 27, *_NO), (9, 1, "'Width: ' || p_partkey % 65536", 27, 29, *_NO), (9, 1, "'Number of components: 1'", 29, 30, *_NO),
    (9, 1, "'Component 1'", 30, 33, True, False), (14, 2, "'Component id: 1'", 30, 31, *_NO), (14, 2, "'Sampling factors: 0x11'", 31, 32, *_NO),
    (14, 2, "'Quantization table selector: 0'", 32, 33, *_NO), (-1, 0, "'SOS'", 33, "45 + p_size", True, False), (18, 1, "'Number of components: 1'", 37, 38, *_NO),
    (18, 1, "'Component 1'", 38, 40, True, False), (20, 2, "'Component selector: 1'", 38, 39, *_NO), (20, 2, "'Huffman table selectors: 0x00'", 39, 40, *_NO),
    (18, 1, "'Spectral selection / approximation'", 40, 43, *_NO), (18, 1, "'Entropy-coded scan data'", 43, "45 + p_size", *_NO), (-1, 0, "'EOI'", "45 + p_size", "47 + p_size", *_NO),
]
_HEX_LINES = r"""WITH t AS (SELECT doc_id AS path, lower(hex(encode(text))) AS h FROM documents WHERE text IS NOT NULL),
      l AS (SELECT path, h, unnest(range(CAST(ceil(length(h) / 32.0) AS BIGINT))) AS line FROM t),
      p AS (SELECT path, line, substring(h, line * 32 + 1, 32) AS x FROM l)
      SELECT path, line, lpad(printf('%x', line * 16), 8, '0') || '  ' || rpad(regexp_replace(x, '(..)', '\1 ', 'g'), 48, ' ') || ' ' ||
        array_to_string(list_transform(regexp_extract_all(x, '..'), lambda b: CASE WHEN b BETWEEN '20' AND '7e' THEN chr(CAST('0x' || b AS INTEGER)) ELSE '.' END), '') AS text FROM p"""

QUERIES = {q.__name__: q for q in (bmp_fields, identify_magic, tar_entries, png_ihdr, hexdump_lines, offset_lookup, highlight_lines, block_stats, selection_status, gif_screen, ogg_pages, macho_commands, visible_lines, bzip2_blocks, atari_blocks, dos_com_blocks, jpeg_blocks, file_status, ancestors, parent_links, missing_offsets, click_offsets, scroll_targets, coverage_gaps)}
ORACLES = {
    "bmp_fields": """SELECT p_partkey AS path, unnest(['Width: ' || p_size, 'Height: ' || p_partkey, 'Compression: BI_RGB']) AS label,
      CAST(unnest([18, 22, 30]) AS BIGINT) AS start, CAST(unnest([22, 26, 34]) AS BIGINT) AS "end" FROM part""",
    "identify_magic": """SELECT CASE l_orderkey % 7 WHEN 0 THEN 'BMP' WHEN 1 THEN 'GIF' WHEN 2 THEN 'PNG' WHEN 3 THEN 'Gzip' WHEN 4 THEN 'JPEG' WHEN 5 THEN 'FLAC' ELSE 'Data' END AS file_type,
      count(*) AS n FROM lineitem GROUP BY 1""",
    "tar_entries": """SELECT c_custkey AS path, 'File: ' || c_name AS label, CAST(0 AS BIGINT) AS start, CAST(CASE WHEN c_nationkey > 0 THEN 1024 ELSE 512 END AS BIGINT) AS "end" FROM customer
      UNION ALL SELECT c_custkey, 'Size: ' || c_nationkey, 124, 136 FROM customer
      UNION ALL SELECT c_custkey, 'File data', 512, 512 + c_nationkey FROM customer WHERE c_nationkey > 0""",
    "png_ihdr": """SELECT o_orderkey AS path, unnest(['Width: ' || o_custkey, 'Height: ' || o_orderkey, 'Color type: truecolor']) AS label,
      CAST(unnest([16, 20, 25]) AS BIGINT) AS start, CAST(unnest([20, 24, 26]) AS BIGINT) AS "end" FROM orders""",
    "hexdump_lines": _HEX_LINES,
    "visible_lines": f"SELECT * FROM ({_HEX_LINES}) WHERE line >= path % 7 AND line < path % 7 + 3",
    "bzip2_blocks": _whole("bzip2", _BZIP2),
    "atari_blocks": _whole("Atari ST program", _ATARI),
    "dos_com_blocks": _whole("DOS COM", _DOS_COM),
    "jpeg_blocks": _whole("JPEG", _JPEG),
    "file_status": """WITH t AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderkey % 5 AS m FROM orders), u AS (SELECT o_orderkey, m + CASE k WHEN 1 THEN 6 ELSE 4 END AS n,
      CASE k WHEN 0 THEN 'FLAC' WHEN 1 THEN 'GIF' ELSE 'Data' END AS f FROM t) SELECT o_orderkey, printf('Size: %d bytes, Type: %s | Dissected as: %s', n, f, f) AS status FROM u""",
    "ancestors": """SELECT p_partkey AS path, CAST(i AS INTEGER) AS idx, CAST(CASE WHEN i < 5 THEN 0 ELSE 5 END AS INTEGER) AS ancestor, CAST(1 AS INTEGER) AS steps
      FROM part, (SELECT unnest(range(1, 17)) AS i) WHERE i <> 5""",
    "parent_links": """SELECT p_partkey AS path, unnest(['BMP file header', 'DIB header']) AS parent_label, CAST(unnest([0, 14]) AS BIGINT) AS parent_start,
      CAST(unnest([14, 54]) AS BIGINT) AS parent_end, CAST(unnest([4, 11]) AS BIGINT) AS n FROM part""",
    "missing_offsets": """SELECT p_partkey AS path, CAST(p_size + 45 AS BIGINT) AS "offset", CAST(CASE WHEN p_size < 5 THEN 15 WHEN p_size < 9 THEN 16 WHEN p_size < 25 THEN 17 ELSE -1 END AS INTEGER) AS idx,
      CASE WHEN p_size < 5 THEN 'Colors used: 0' WHEN p_size < 9 THEN 'Important colors: 0' WHEN p_size < 25 THEN 'Pixel data' END AS label FROM part""",
    "click_offsets": """WITH t AS (SELECT p_partkey, CAST(p_partkey % 6 AS BIGINT) * 16 AS o, p_size * 2 AS c FROM part), u AS (SELECT p_partkey, o, CASE WHEN c BETWEEN 10 AND 58 THEN (c - 10) // 3
      WHEN c BETWEEN 59 AND 74 THEN c - 59 END AS i FROM t) SELECT p_partkey, CASE WHEN i < 16 AND o + i < 70 THEN o + i END AS "offset" FROM u""",
    "scroll_targets": """WITH t AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS f, CAST(p_partkey AS BIGINT) * 3 // 16 AS l FROM part)
      SELECT p_partkey, CASE WHEN l >= f AND l < f + 21 THEN f ELSE least(229, greatest(0, l - 10)) END AS first_line FROM t""",
    "coverage_gaps": """SELECT p_partkey AS path, CAST(54 AS BIGINT) AS start, CAST(54 + p_size % 5 AS BIGINT) AS "end" FROM part WHERE p_size % 5 > 0
      UNION ALL SELECT p_partkey, 60 + p_size % 5, 62 + p_size % 5 FROM part""",
    "offset_lookup": """SELECT p_partkey AS path, CAST(p_size AS BIGINT) AS "offset", CASE WHEN p_size < 2 THEN 'Signature: BM' WHEN p_size < 6 THEN 'File size: 70' WHEN p_size < 10 THEN 'Reserved'
      WHEN p_size < 14 THEN 'Pixel data offset: 54' WHEN p_size < 18 THEN 'Header size: 40' WHEN p_size < 22 THEN 'Width: ' || p_size WHEN p_size < 26 THEN 'Height: ' || p_partkey
      WHEN p_size < 28 THEN 'Planes: 1' WHEN p_size < 30 THEN 'Bits per pixel: 24' WHEN p_size < 34 THEN 'Compression: BI_RGB' WHEN p_size < 38 THEN 'Image size: 16'
      WHEN p_size < 42 THEN 'Horizontal resolution: 2835' WHEN p_size < 46 THEN 'Vertical resolution: 2835' WHEN p_size < 50 THEN 'Colors used: 0' ELSE 'Important colors: 0' END AS label FROM part""",
    "highlight_lines": """SELECT p_partkey AS path, CAST(line AS BIGINT) AS line, CAST(greatest(14, line * 16) AS BIGINT) AS hl_start, CAST(least(54, line * 16 + 16) AS BIGINT) AS hl_end
      FROM part, (SELECT unnest([0, 1, 2, 3]) AS line)""",
    "block_stats": """SELECT 'BMP' AS file_type, 0 AS depth, 3 * count(*) AS n, CAST(70 * count(*) AS BIGINT) AS covered FROM part UNION ALL SELECT 'BMP', 1, 15 * count(*), CAST(54 * count(*) AS BIGINT) FROM part""",
    "selection_status": """SELECT p_partkey, CASE WHEN p_size > 1 THEN printf('Selection: %d bytes, Range: 0x%x-0x%x (%d-%d)', p_size - 1, p_partkey, p_partkey + p_size - 2, p_partkey, p_partkey + p_size - 2) ELSE '-' END AS status FROM part""",
    "gif_screen": """SELECT p_partkey AS path, unnest(['Canvas width: ' || p_partkey % 65536, 'Canvas height: ' || p_size, 'Sub-block (' || p_size || ' bytes)', 'Trailer']) AS label,
      CAST(unnest([6, 8, 15, 17 + p_size]) AS BIGINT) AS start, CAST(unnest([8, 10, 16 + p_size, 18 + p_size]) AS BIGINT) AS "end" FROM part""",
    "ogg_pages": """SELECT o_orderkey AS path, unnest(['Header type flag: 0x04 (last page (eos))', 'Granule position: ' || o_orderkey, 'Payload data']) AS label,
      CAST(unnest([5, 6, 28]) AS BIGINT) AS start, CAST(unnest([6, 14, 29 + o_custkey % 200]) AS BIGINT) AS "end" FROM orders""",
    "macho_commands": """WITH t AS (SELECT c_custkey AS path, CAST(c_nationkey AS BIGINT) AS n FROM customer)
      SELECT path, unnest(['CPU type: x86_64', 'Load command: LC_MAIN', 'Command size: ' || (n + 8), 'Load command: LC_SYMTAB', 'Command size: 8']) AS label,
      CAST(unnest([4, 32, 36, 40 + n, 44 + n]) AS BIGINT) AS start, CAST(unnest([8, 40 + n, 40, 48 + n, 48 + n]) AS BIGINT) AS "end" FROM t""",
}
QUERIES |= formats.QUERIES
ORACLES |= formats.ORACLES
