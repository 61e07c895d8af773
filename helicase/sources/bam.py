"""BAM and BAI output as a Spark data source.

Every task writes one complete BAM file with its index for its own range of the
genome: rows arrive range-partitioned and sorted, so the part files in name
order are the sorted alignment. Use :func:`write_bam`.
"""

from __future__ import annotations

import struct
import sys
import zlib
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from helicase.functions import dna
from helicase.sources import genome

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format: block header, empty end-of-file block, the size at
# which a block is closed, the pseudo bin of the index, CIGAR operation codes.
GZIP_HEAD = bytes.fromhex("1f8b08040000000000ff0600424302 00".replace(" ", ""))
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 65_000
STATS_BIN = 37450
CIGAR_CODES = {"M": 0, "I": 1, "D": 2}
FIELDS = "ref_id, pos, bin, name, flag, cigar, rnext_id, pnext, tlen, n, packed, qual"


def bgzf_block(data: bytes) -> bytes:
    """One gzip member with its own size in the extra field."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return GZIP_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_header(chromosomes: list[tuple[str, int]]) -> bytes:
    text = "@HD\tVN:1.0\tSO:coordinate\n" + "".join(f"@SQ\tSN:{r}\tLN:{n}\n" for r, n in chromosomes)
    out = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(chromosomes))
    for r, n in chromosomes:
        name = r.encode() + b"\0"
        out += struct.pack("<i", len(name)) + name + struct.pack("<i", n)
    return out


def bam_record(r) -> bytes:
    """Binary alignment of one row with the columns of ``FIELDS``."""
    ops = []
    for part in r.cigar.split(" "):
        ops.append(int(part[:-1]) << 4 | CIGAR_CODES[part[-1]])
    name = r.name.encode() + b"\0"
    body = struct.pack(
        "<iiIIIiii", r.ref_id, r.pos - 1, r.bin << 16 | len(name), r.flag << 16 | len(ops), r.n, r.rnext_id, r.pnext - 1, r.tlen
    )
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(r.packed) + bytes(ord(c) - 33 for c in r.qual)
    return struct.pack("<i", len(body)) + body


class Index:
    """BAI content gathered while records are written in order."""

    def __init__(self, n_refs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(n_refs)]
        self.linear: list[list[int]] = [[] for _ in range(n_refs)]
        self.count = [0] * n_refs
        self.span: list[list[int]] = [[0, 0] for _ in range(n_refs)]
        self.last = None

    def add(self, r, begin: int, end: int) -> None:
        chunks = self.bins[r.ref_id].setdefault(r.bin, [])
        if chunks and self.last == (r.ref_id, r.bin):
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        self.last = (r.ref_id, r.bin)
        lin = self.linear[r.ref_id]
        for w in range((r.pos - 1) >> 14, ((r.pos + r.n - 2) >> 14) + 1):
            while len(lin) <= w:
                lin.append(0)
            lin[w] = lin[w] or begin
        if not self.count[r.ref_id]:
            self.span[r.ref_id][0] = begin
        self.span[r.ref_id][1] = end
        self.count[r.ref_id] += 1

    def to_bytes(self) -> bytes:
        out = b"BAI\1" + struct.pack("<i", len(self.bins))
        for ref, bins in enumerate(self.bins):
            out += struct.pack("<i", len(bins) + (1 if self.count[ref] else 0))
            for b, chunks in sorted(bins.items()):
                out += struct.pack("<Ii", b, len(chunks))
                out += b"".join(struct.pack("<QQ", *c) for c in chunks)
            if self.count[ref]:
                out += struct.pack("<IiQQQQ", STATS_BIN, 2, *self.span[ref], self.count[ref], 0)
            lin = self.linear[ref]
            for i in range(1, len(lin)):
                lin[i] = lin[i] or lin[i - 1]
            out += struct.pack("<i", len(lin)) + struct.pack(f"<{len(lin)}Q", *lin)
        return out


@dataclass
class Part(WriterCommitMessage):
    path: str
    records: int


class BamWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.chromosomes = [(r, int(n)) for r, n in (x.rsplit(":", 1) for x in options["chromosomes"].split("\n") if x)]

    def write(self, rows):
        from pyarrow import fs
        from pyspark import TaskContext

        place, root = fs.FileSystem.from_uri(self.path)
        ctx = TaskContext.get()
        # Every attempt has files of its own; commit() gives the successful ones their names.
        name = f"{root}/_attempts/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.bam"
        place.create_dir(f"{root}/_attempts", recursive=True)
        index, n, at = Index(len(self.chromosomes)), 0, 0
        with place.open_output_stream(name) as out:
            buf = bytearray()

            def close_block():
                nonlocal at, buf
                block = bgzf_block(bytes(buf))
                out.write(block)
                at += len(block)
                buf = bytearray()

            buf += bam_header(self.chromosomes)
            close_block()
            for r in rows:
                rec = bam_record(r)
                if buf and len(buf) + len(rec) > BLOCK_BYTES:
                    close_block()
                begin = at << 16 | len(buf)
                buf += rec
                index.add(r, begin, at << 16 | len(buf))
                n += 1
            if buf:
                close_block()
            out.write(END_BLOCK)
        with place.open_output_stream(name + ".bai") as out:
            out.write(index.to_bytes())
        return Part(name, n)

    def commit(self, messages):
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            final = f"{root}/" + m.path.rsplit("/", 1)[1].rsplit("-", 1)[0] + ".bam"
            for end in (".bai", ""):
                place.move(m.path + end, final + end)
        place.delete_dir(f"{root}/_attempts")

    def abort(self, messages):
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(self.path)
        if place.get_file_info(f"{root}/_attempts").type != fs.FileType.NotFound:
            place.delete_dir(f"{root}/_attempts")


class BamSource(DataSource):
    """Format ``helicase_bam``; options ``path`` and ``chromosomes``."""

    @classmethod
    def name(cls):
        return "helicase_bam"

    def writer(self, schema, overwrite):
        return BamWriter(self.options)


def bam_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Columns of ``FIELDS`` from rows of ``sam.original_bases``."""
    order = genome.with_offsets(genome.chromosomes(chunks))
    ids = order.select("ref", (F.rank().over(_by_ref()) - 1).alias("ref_id"))
    n = F.length("seq")
    c = F.trim(F.regexp_replace(dna.cigar(n, "indel", "amount"), "([MID])", "$1 "))
    return rows.join(ids, "ref").select(
        "ref_id",
        "pos",
        dna.reg2bin(F.col("pos") - 1, F.col("pos") - 1 + n).alias("bin"),
        dna.read_name("name").alias("name"),
        (F.col("flags") + F.when(F.col("reverse"), 0x10).otherwise(0)).alias("flag"),
        c.alias("cigar"),
        F.when(F.col("rnext") == "=", F.col("ref_id")).otherwise(-1).alias("rnext_id"),
        F.col("pnext").cast("long").alias("pnext"),
        F.col("tlen").cast("int").alias("tlen"),
        n.alias("n"),
        dna.bam_nibbles("seq").alias("packed"),
        F.col("seq_q").alias("qual"),
    )


def _by_ref():
    from pyspark.sql import Window

    return Window.orderBy("ref")


def write_bam(rows: DataFrame, chunks: DataFrame, uri: str, files: int | None = None) -> None:
    """Write sorted BAM part files with indexes below ``uri`` (``file:/``, ``hdfs:/``, ``s3:/``).

    The header needs the chromosome list, the only thing collected here.
    """
    spark = rows.sparkSession
    spark.dataSource.register(BamSource)
    names = genome.chromosomes(chunks).orderBy("ref").collect()
    b = bam_rows(rows, chunks)
    ranged = b.repartitionByRange(files, "ref_id", "pos") if files else b.repartitionByRange("ref_id", "pos")
    ordered = ranged.sortWithinPartitions("ref_id", "pos").select(*FIELDS.split(", "))
    ordered.write.format("helicase_bam").mode("append").option("path", uri).option(
        "chromosomes", "\n".join(f"{r.ref}:{r.len}" for r in names)
    ).save()
