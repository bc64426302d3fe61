"""FASTA and FASTQ as DataFrames, read and written by Spark's text source.

Files are split like any text: FASTA by records, FASTQ by lines that are numbered across splits (a quality
line may begin with '@', so its records can't be told by their first byte).  Paths may be in any store
that Spark reads.
"""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import staged_path

HEADER_CHARS = 4095


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, value, block, id): what a separator ends, with its split and a number that rises within it."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def _numbered(lines: DataFrame) -> DataFrame:
    """(file, value, line): numbered from 0 within the file.

    Splits are few, so where each begins comes from a window over counts of splits, not over lines.
    """
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    offsets = counts.select("file", "block", "first", (F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    return lines.join(offsets, ["file", "block"]).select("file", "value", (F.col("before") + F.col("id") - F.col("first")).alias("line"))


def fasta_records(text: DataFrame) -> DataFrame:
    """Rows (value, ...) of records without their leading '>' -> (..., name, seq).

    The body ends at a line whose first character is outside 'A' to 'z'; blank lines are skipped.
    """
    rest = [c for c in text.columns if c != "value"]
    lines = F.transform(F.split("value", "\n"), _strip)
    rows = text.select(*rest, F.substring(F.element_at(lines, 1), 1, HEADER_CHARS).alias("name"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("body"))
    bad = F.array_position(F.transform("body", lambda x: (x != "") & ~x.rlike("^[A-z]")), F.lit(True))
    return rows.select(*rest, "name", F.array_join(F.when(bad > 0, F.slice("body", 1, (bad - 1).cast("int"))).otherwise(F.col("body")), "").alias("seq"))


def _fasta_text(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", F.regexp_replace("value", r"^\s*>", "")).where(F.length(_strip(F.col("value"))) > 0)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, seq) of FASTA files, bodies of any number of lines."""
    return fasta_records(_fasta_text(_lines(spark, path, "\n>")).select("value"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S3: (file, record, name, seq, qual) of FASTQ files of four lines a record."""
    record = F.col("line") % 4
    numbered = _numbered(_lines(spark, path, "\n"))
    rows = numbered.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(*(F.max(F.when(record == i, F.regexp_replace("value", r"\s+$", ""))).alias(x) for i, x in enumerate(("name", "seq", "plus", "qual"))))
    return rows.where(F.col("name").startswith("@") & F.col("seq").isNotNull()).select("file", "record", F.substring(F.expr("substring(name, 2)"), 1, HEADER_CHARS).alias("name"), "seq", F.coalesce("qual", F.lit("")).alias("qual"))


def _kind(spark: SparkSession, path: str | list[str]) -> str:
    """The first character of the data, '>' for none; ValueError if it is neither '>' nor '@'."""
    head = spark.read.text(path).where(F.length(_strip(F.col("value"))) > 0).limit(1).collect()
    kind = head[0].value.strip()[:1] if head else ">"
    if kind not in (">", "@"):
        raise ValueError(f"{path} begins with {kind!r}, which is neither FASTA nor FASTQ")
    return kind


def spool(spark: SparkSession, stream: BinaryIO, chunk: int = 4 << 20) -> str:
    """The path of a copy of a stream in the shared folder, where executors can read it, chunk by chunk."""
    path = staged_path(spark, "stream")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(there)
    try:
        while data := stream.read(chunk):
            out.write(bytearray(data))
    finally:
        out.close()
    return path


def read_fastx(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] = ("name", "seq", "qual")) -> DataFrame:
    """By the first character of the data, '>' or '@'; columns not asked for are not parsed.

    Raises ValueError on anything else; an empty file gives no rows.
    """
    reads = read_fasta(spark, path).withColumn("qual", F.lit(None).cast("string")) if _kind(spark, path) == ">" else read_fastq(spark, path)
    return reads.select(*columns)


def numbered_reads(spark: SparkSession, path: str) -> DataFrame:
    """(record, seq, qual) of one FASTA or FASTQ file, records numbered from 0; qual is empty in FASTA."""
    if _kind(spark, path) == "@":
        return read_fastq(spark, path).select("record", "seq", "qual")
    return fasta_records(_numbered(_fasta_text(_lines(spark, path, "\n>"))).select("value", F.col("line").alias("record"))).select("record", "seq", F.lit("").alias("qual"))


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Files of mates by place: (pair_id, s1, s2, q1, q2), the smaller mate first; ValueError if the second is shorter."""
    a, b = (numbered_reads(spark, p) for p in (first, second))
    if b.count() < a.count():
        raise ValueError("the second file has fewer reads")
    both = a.join(b.select("record", F.struct("seq", "qual").alias("y")), "record").withColumn("x", F.struct("seq", "qual"))
    pairs = both.select("record", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return pairs.select(F.col("record").alias("pair_id"), F.col("x.seq").alias("s1"), F.col("y.seq").alias("s2"), F.col("x.qual").alias("q1"), F.col("y.qual").alias("q2"))


def fasta_text(name: Column | str, seq: Column | str) -> Column:
    """K1."""
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def fastq_text(name: Column | str, seq: Column | str, qual: Column | str) -> Column:
    """K2."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def fastx_text(name: str, seq: str, qual: str) -> Column:
    """K3: FASTQ where there is a quality, else FASTA."""
    return F.when(F.length(qual) > 0, fastq_text(F.col(name), F.col(seq), F.col(qual))).otherwise(fasta_text(F.col(name), F.col(seq)))


def wrapped(seq: Column | str, width: int = 80) -> Column:
    """Lines of width characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def contig_text(contigs: DataFrame) -> DataFrame:
    """Contigs as one column of FASTA records."""
    title = F.concat(F.lit("CONTIG_"), "group_id", F.when(F.col("has_palindrome"), " palindromic").otherwise(""), F.when(F.col("cyclic"), " cyclic").otherwise(""), F.lit(" length:"), F.col("length").cast("string"), F.lit(" average coverage:"), F.format_string("%.2f", "average_coverage"))
    return contigs.select(fasta_text(title, wrapped("seq")).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """K4: one column of records."""
    rows.write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, first: str, second: str) -> None:
    """K5: pairs(name, s1, s2[, q1, q2]) as two folders in the order of name, FASTQ where there is a quality."""
    ordered = pairs.withColumn("name", F.col("name").cast("string")) if "q1" in pairs.columns else pairs.select(F.col("name").cast("string").alias("name"), "s1", "s2", F.lit("").alias("q1"), F.lit("").alias("q2"))
    ordered = ordered.orderBy(F.col("name").cast("long"))
    for path, i in ((first, 1), (second, 2)):
        write_text(ordered.select(fastx_text("name", f"s{i}", f"q{i}").alias("value")), path)


def write_routed(routed: DataFrame, output: str, discard: str) -> None:
    """K6: routed mates to their two sinks."""
    for path, rows in ((output, routed.where("kept")), (discard, routed.where("NOT kept"))):
        write_text(rows.select(fasta_text(F.concat_ws("/", "pair_id", "mate"), F.col("seq")).alias("value")), path)
