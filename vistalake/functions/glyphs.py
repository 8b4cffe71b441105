"""A 5 by 7 bitmap font as data: which pixels a text plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GLYPH_WIDTH, GLYPH_HEIGHT, GLYPH_SPACING = 5, 7, 1

# The columns of each character, bit n for row n.
GLYPHS = {
    " ": (0x00, 0x00, 0x00, 0x00, 0x00),
    "0": (0x3E, 0x51, 0x49, 0x45, 0x3E),
    "1": (0x00, 0x42, 0x7F, 0x40, 0x00),
    "2": (0x42, 0x61, 0x51, 0x49, 0x46),
    "3": (0x21, 0x41, 0x45, 0x4B, 0x31),
    "4": (0x18, 0x14, 0x12, 0x7F, 0x10),
    "5": (0x27, 0x45, 0x45, 0x45, 0x39),
    "6": (0x3C, 0x4A, 0x49, 0x49, 0x30),
    "7": (0x01, 0x71, 0x09, 0x05, 0x03),
    "8": (0x36, 0x49, 0x49, 0x49, 0x36),
    "9": (0x06, 0x49, 0x49, 0x29, 0x1E),
    "A": (0x7E, 0x11, 0x11, 0x11, 0x7E),
    "B": (0x7F, 0x49, 0x49, 0x49, 0x36),
    "C": (0x3E, 0x41, 0x41, 0x41, 0x22),
    "D": (0x7F, 0x41, 0x41, 0x22, 0x1C),
    "E": (0x7F, 0x49, 0x49, 0x49, 0x41),
    "F": (0x7F, 0x09, 0x09, 0x09, 0x01),
    "G": (0x3E, 0x41, 0x49, 0x49, 0x7A),
    "H": (0x7F, 0x08, 0x08, 0x08, 0x7F),
    "I": (0x00, 0x41, 0x7F, 0x41, 0x00),
    "J": (0x20, 0x40, 0x41, 0x3F, 0x01),
    "K": (0x7F, 0x08, 0x14, 0x22, 0x41),
    "L": (0x7F, 0x40, 0x40, 0x40, 0x40),
    "M": (0x7F, 0x02, 0x0C, 0x02, 0x7F),
    "N": (0x7F, 0x04, 0x08, 0x10, 0x7F),
    "O": (0x3E, 0x41, 0x41, 0x41, 0x3E),
    "P": (0x7F, 0x09, 0x09, 0x09, 0x06),
    "Q": (0x3E, 0x41, 0x51, 0x21, 0x5E),
    "R": (0x7F, 0x09, 0x19, 0x29, 0x46),
    "S": (0x46, 0x49, 0x49, 0x49, 0x31),
    "T": (0x01, 0x01, 0x7F, 0x01, 0x01),
    "U": (0x3F, 0x40, 0x40, 0x40, 0x3F),
    "V": (0x1F, 0x20, 0x40, 0x20, 0x1F),
    "W": (0x3F, 0x40, 0x38, 0x40, 0x3F),
    "X": (0x63, 0x14, 0x08, 0x14, 0x63),
    "Y": (0x07, 0x08, 0x70, 0x08, 0x07),
    "Z": (0x61, 0x51, 0x49, 0x45, 0x43),
    ".": (0x00, 0x60, 0x60, 0x00, 0x00),
    ",": (0x00, 0x50, 0x30, 0x00, 0x00),
    ":": (0x00, 0x36, 0x36, 0x00, 0x00),
    ";": (0x00, 0x56, 0x36, 0x00, 0x00),
    "/": (0x20, 0x10, 0x08, 0x04, 0x02),
    "\\": (0x02, 0x04, 0x08, 0x10, 0x20),
    "%": (0x23, 0x13, 0x08, 0x64, 0x62),
    "(": (0x00, 0x1C, 0x22, 0x41, 0x00),
    ")": (0x00, 0x41, 0x22, 0x1C, 0x00),
    "[": (0x00, 0x7F, 0x41, 0x41, 0x00),
    "]": (0x00, 0x41, 0x41, 0x7F, 0x00),
    "-": (0x08, 0x08, 0x08, 0x08, 0x08),
    "_": (0x40, 0x40, 0x40, 0x40, 0x40),
    "=": (0x14, 0x14, 0x14, 0x14, 0x14),
    "+": (0x08, 0x08, 0x3E, 0x08, 0x08),
    "*": (0x14, 0x08, 0x3E, 0x08, 0x14),
    "#": (0x14, 0x7F, 0x14, 0x7F, 0x14),
    "?": (0x02, 0x01, 0x51, 0x09, 0x06),
    "!": (0x00, 0x00, 0x5F, 0x00, 0x00),
    "<": (0x08, 0x14, 0x22, 0x41, 0x00),
    ">": (0x00, 0x41, 0x22, 0x14, 0x08),
    "'": (0x00, 0x07, 0x00, 0x00, 0x00),
}
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def glyph_bits(spark: SparkSession) -> DataFrame:
    """``ch, col, row`` of every set bit: a small dimension table of fixed size."""
    rows = [(ch, col, row) for ch, columns in GLYPHS.items() for col, bits in enumerate(columns) for row in range(GLYPH_HEIGHT) if bits >> row & 1]
    return spark.createDataFrame(rows, "ch string, col int, row int")


def text_width(text: Column, scale: int) -> Column:
    """Pixels a text takes; characters without a glyph take their place too."""
    n = F.char_length(text).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(n * ((GLYPH_WIDTH + GLYPH_SPACING) * scale) - GLYPH_SPACING * scale, F.lit(0).cast("long")))


def text_height(scale: int) -> int:
    return GLYPH_HEIGHT * scale


def plotted_pixels(texts: DataFrame, text: str, x: Column, y: Column, scale: int) -> DataFrame:
    """The rows of ``texts`` (without the text) for each pixel that drawing it at ``x, y`` plots, as ``px, py``."""
    scale = max(scale, 1)
    keep = [c for c in texts.columns if c != text]
    chars = texts.select(*keep, x.cast("long").alias("_x"), y.cast("long").alias("_y"), F.posexplode(F.split(F.col(text), "")).alias("_at", "_ch"))
    bits = glyph_bits(texts.sparkSession)
    hits = chars.where("_ch <> ''").withColumn("_ch", F.translate("_ch", _LOWER, _UPPER)).join(F.broadcast(bits), F.col("_ch") == F.col("ch"))
    block = F.sequence(F.lit(0), F.lit(scale - 1))
    spread = hits.withColumn("_dx", F.explode(block)).withColumn("_dy", F.explode(block)) if scale > 1 else hits.withColumn("_dx", F.lit(0)).withColumn("_dy", F.lit(0))
    left = F.col("_x") + F.col("_at") * ((GLYPH_WIDTH + GLYPH_SPACING) * scale)
    return spread.select(*keep, (left + F.col("col") * scale + F.col("_dx")).cast("long").alias("px"), (F.col("_y") + F.col("row") * scale + F.col("_dy")).cast("long").alias("py"))
