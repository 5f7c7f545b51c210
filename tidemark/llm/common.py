"""What the corpus operators share: work folders, bounded Arrow batches, label samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.workdir import work_folder

#: Fixed value: a word is a run of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Of the bytes of UTF-8 digits, letters and those beyond ASCII stay, A-Z in lower case; all others part terms.
TERM_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 64 << 20) -> None:
    """Texts may be long, so Arrow batches hold fewer rows than Spark's default of 10,000, and end at ``size`` bytes.

    A setting of the session, as Spark reads it when the query runs; a bound in bytes that the session has stays.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and the struct __doc of all of ``docs``, so that no name of its columns clashes with one made here."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))


def marked(rows: DataFrame, keys: DataFrame, columns: list[str], *, held: bool, bits: int = 1 << 26) -> DataFrame:
    """The rows whose key of ``columns`` may be among ``keys`` (``held``), or the rest, whose key surely isn't.

    The keys' hashes are bits of a bitmap of ``bits`` bits, which alone is broadcast: 8 MB
    at most, however many keys there are. It spares a shuffle of wide rows; with many more
    keys than bits it spares less. The two parts are all rows of ``rows``.
    """
    place = F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(bits))
    bucket, bit = F.shiftright(place, 15).alias("__bucket"), place.bitwiseAND(32767)
    bitmap = keys.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    own = rows.withColumn("__bucket", bucket).join(F.broadcast(bitmap), "__bucket", "inner" if held else "left")
    return own.where(found if held else ~found).select(*rows.columns)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order: maximal runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(TERM_BYTES).split()


def word_count(text: str):
    """Number of words of a text column, null for null."""
    return F.regexp_count(F.col(text), F.lit(WORD)).cast("long")


def crc_fold(key, folds: int):
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, per_class: int, max_chars: int) -> DataFrame:
    """Rows (doc_id, text, label) to fit a classifier on: at most ``per_class`` rows of label 0 and of label 1.

    Only labels whose fold isn't ``held_out`` are read. The rows of a class with the
    smallest hash of doc_id are taken; of these, texts above ``max_chars`` characters
    are left out of the fit (never of the scoring). Null labels, ids and texts take no
    part; with two labels for an id the larger one holds, with two texts the larger text.
    The rows are written to the shared folder; an empty table gives none.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != held_out))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value in (0, 1):
        part = own.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    # picked has at most 2 * per_class rows of two integers: a bounded broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    return written(rows, "labelled-rows")
