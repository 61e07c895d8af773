"""FASTQ in and out."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from helicase.functions import dna
from helicase.operators.qc import trim
from helicase.session import materialise
from helicase.sources.lines import blocks, first_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lines of a split looked at before its lines are given up as unclear.
UNCLEAR = 20_000
PIECES = "file string, block long, line long, lines long, header string, nucs string, qual string, value string"


def parse_fastq(lines: DataFrame, quality_offset: int = 33) -> DataFrame:
    """Records of ``(file, line_no, value)`` lines: ``(file, record, header, nucs, qual)``.

    Four lines make a record by line number, so a quality line may begin with
    '@'. A first line without '@' and a quality below the offset are errors.
    Quality comes out in Sanger letters.
    """
    return _finished(_grouped(lines), quality_offset)


def _grouped(lines: DataFrame) -> DataFrame:
    field = (F.col("line_no") % 4).cast("int")
    pick = lambda n: F.max(F.when(F.col("_f") == n, F.col("value")))
    return (
        lines.withColumn("record", F.call_function("div", F.col("line_no"), F.lit(4)))
        .withColumn("_f", field)
        .where("_f <> 2")
        .groupBy("file", "record")
        .agg(pick(0).alias("_h"), pick(1).alias("nucs"), pick(3).alias("qual"))
        .where("nucs is not null")
    )


def _finished(rec: DataFrame, quality_offset: int) -> DataFrame:
    header = F.when(F.startswith("_h", F.lit("@")), F.substring(F.col("_h"), F.lit(2), F.length("_h"))).otherwise(
        F.raise_error(F.concat(F.lit("not FASTQ, line: "), F.coalesce("_h", F.lit("")))).cast("string")
    )
    out = rec.select("file", "record", header.alias("header"), "nucs", F.coalesce("qual", F.lit("")).alias("qual"))
    if quality_offset == 33:
        bad = F.col("qual").rlike(r"[^!-~]")
        q = F.col("qual")
    else:
        q = F.array_join(
            F.transform(F.split("qual", ""), lambda c: F.when(c == "", c).otherwise(F.char(F.ascii(c) - quality_offset + 33))), ""
        )
        low = "".join(f"\\x{i:02x}" for i in range(33, quality_offset))
        bad = F.col("qual").rlike(f"[{low}]")
    return out.withColumn(
        "qual",
        F.when(bad, F.raise_error(F.concat(F.lit("quality below the offset in "), F.col("header"))).cast("string")).otherwise(q),
    )


class _Split:
    """Puts the lines of one file split together as records.

    A split may begin anywhere in a record. The one offset at which every record has its '@', its '+' and letters and
    qualities of one length is taken; lines in front of the first record, behind the last one, and all lines from the first that breaks
    the pattern (or of a split where no offset or several fit) come out as they are.
    """

    def __init__(self, file: str, block: int):
        self.file, self.block, self.line, self.rest, self.found, self.loose = file, block, 0, pa.array([], pa.string()), False, False

    def _rows(self, n: int, **columns: pa.Array) -> pa.RecordBatch:
        own = {"file": pa.array([self.file] * n, pa.string()), "block": pa.array([self.block] * n, pa.int64())} | columns
        kinds = {"line": pa.int64(), "lines": pa.int64()}
        names = ["file", "block", "line", "lines", "header", "nucs", "qual", "value"]
        return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(n, kinds.get(c, pa.string()))) for c in names], names)

    def _as_they_are(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        if len(values):
            yield self._rows(len(values), line=pa.array(range(self.line, self.line + len(values)), pa.int64()), value=values)
            self.line += len(values)

    @staticmethod
    def _fits(values: pa.Array) -> pa.Array:
        n = len(values) // 4 * 4
        field = lambda i: values.take(pa.array(range(i, n, 4), pa.int64()))
        same = pc.equal(pc.binary_length(field(1)), pc.binary_length(field(3)))
        return pc.and_(pc.and_(pc.starts_with(field(0), "@"), pc.starts_with(field(2), "+")), same)

    def feed(self, values: pa.Array, last: bool = False) -> Iterator[pa.RecordBatch]:
        values = pa.concat_arrays([self.rest, values])
        self.rest = values[:0]
        if not self.found and not self.loose:
            if not last and len(values) < 12:
                self.rest = values
                return
            fit = [p for p in range(min(4, len(values))) if len(values) - p >= 4 and pc.all(self._fits(values[p:])).as_py()]
            if len(fit) == 1:
                yield from self._as_they_are(values[: fit[0]])
                values, self.found = values[fit[0] :], True
            elif not last and len(fit) > 1 and len(values) < UNCLEAR:
                self.rest = values
                return
            else:
                self.loose = True
        if self.found and not self.loose:
            good = self._fits(values)
            n = len(good) if pc.all(good).as_py() in (True, None) else pc.index(good, False).as_py()
            if n:
                at = lambda i: values.take(pa.array(range(i, 4 * n, 4), pa.int64()))
                lines = pa.array(range(self.line, self.line + 4 * n, 4), pa.int64())
                yield self._rows(n, line=lines, header=at(0), nucs=at(1), qual=at(3))
                self.line += 4 * n
            self.loose = n < len(good)
            values = values[4 * n :]
        if self.loose or last:
            yield from self._as_they_are(values)
        else:
            self.rest = values
        if last:
            yield self._rows(1, lines=pa.array([self.line], pa.int64()))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for b in batches:
        for places in _runs(b):
            part = b.slice(*places)
            file, block = part.column("file")[0].as_py(), part.column("block")[0].as_py()
            if now is None or (now.file, now.block) != (file, block):
                if now is not None:
                    yield from now.feed(pa.array([], pa.string()), last=True)
                now = _Split(file, block)
            yield from now.feed(part.column("value").cast(pa.string()))
    if now is not None:
        yield from now.feed(pa.array([], pa.string()), last=True)


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Start and length of each stretch of rows from one split."""
    if not b.num_rows:
        return
    file, block = b.column("file"), b.column("block")
    new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False).nonzero()[0] + 1
    cuts = [0, *new.tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        yield i, j - i


def read_fastq(spark: SparkSession, path: str, quality_offset: int = 33) -> DataFrame:
    """One file or folder, plain or gzip.

    The files are read once. Each split assembles its own records; the lines of a record that lies over a border, and those of
    splits that don't show where records begin, are put together by their line numbers, which follow from the lines of each split.
    """
    lines = blocks(spark, path).select("file", "block", "value")
    pieces = materialise(lines.mapInArrow(_assembled, PIECES), "fastq")
    first = first_lines(pieces.where("lines is not null").select("file", "block", F.col("lines").alias("_n")))
    at = pieces.where("lines is null").join(first, ["file", "block"]).withColumn("line_no", F.col("line") + F.col("_before"))
    number = F.when(F.col("line_no") % 4 == 0, F.call_function("div", F.col("line_no"), F.lit(4))).otherwise(
        F.raise_error(F.concat(F.lit("not FASTQ, line: "), "header")).cast("long")
    )
    whole = at.where("header is not null").select("file", number.alias("record"), F.col("header").alias("_h"), "nucs", "qual")
    loose = _grouped(at.where("value is not null").select("file", "line_no", "value"))
    return _finished(whole.unionByName(loose.select(whole.columns)), quality_offset)


def in_file_order(records: DataFrame) -> DataFrame:
    """Adds the file's ``ordinal`` by name and the records ``before`` it; the window has a row per file."""
    w = W.orderBy("file")
    files = records.groupBy("file").agg((F.max("record") + 1).alias("_n")).select(
        "file",
        F.row_number().over(w).alias("ordinal"),
        F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    return records.join(files, "file")


def read_pairs(spark: SparkSession, first: str, second: str, quality_offset: int = 33, begin: int = 0, end: int = 0) -> DataFrame:
    """Two synchronised files or folders as ``reads(pair_id, mate, name, nucs, qual)``.

    The i-th records of the j-th files, in order of their names, belong together. The
    first side decides how many pairs there are; ``pair_id`` counts its records over all files.
    """
    cols = ["header", "nucs", "qual"]
    one, two = (in_file_order(read_fastq(spark, p, quality_offset)) for p in (first, second))
    a = one.select("ordinal", "record", (F.col("before") + F.col("record")).alias("pair_id"), F.struct(*cols).alias("a"))
    wide = a.join(two.select("ordinal", "record", F.struct(*cols).alias("b")), ["ordinal", "record"], "left")
    side = lambda c, m: F.struct(F.lit(m).alias("mate"), *[F.col(f"{c}.{x}").alias(x) for x in cols])
    long = wide.select("pair_id", F.inline(F.array(side("a", 1), side("b", 2)))).where("nucs is not null")
    return trim(long.select("pair_id", "mate", dna.read_name("header").alias("name"), "nucs", "qual"), begin, end)


def fastq_lines(reads: DataFrame, header: str = "name") -> DataFrame:
    """One row of four lines per read."""
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(header)), "nucs", F.lit("+"), "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    fastq_lines(reads).write.option("compression", compression).text(path)
