"""BAM, SAM, report files, streaming, the text picture."""

import glob
import gzip
import struct

import pytest
from pyspark.sql import functions as F

from helicase.operators import picture
from helicase.plans import report, stages
from helicase.sources import bam, fastq
from test_pipeline import chunked, rand_seq, small  # noqa: F401


def parse_bam(path):
    data = gzip.open(path).read()
    assert data[:4] == b"BAM\1"
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    (n_ref,) = struct.unpack_from("<i", data, at)
    at += 4
    refs = []
    for _ in range(n_ref):
        (n,) = struct.unpack_from("<i", data, at)
        refs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    out = []
    while at < len(data):
        size, ref, pos, bmn, fnc, n, nref, npos, tlen = struct.unpack_from("<iiiIIiiii", data, at)
        body = at + 36
        name = data[body : body + (bmn & 255) - 1].decode()
        body += bmn & 255
        ops = struct.unpack_from(f"<{fnc & 65535}I", data, body)
        body += 4 * (fnc & 65535)
        packed = data[body : body + (n + 1) // 2]
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:n]
        body += (n + 1) // 2
        qual = "".join(chr(q + 33) for q in data[body : body + n])
        out.append((refs[ref][0], pos + 1, bmn >> 16, fnc >> 16, "".join(f"{o >> 4}{'MID'[o & 15]}" for o in ops), name, seq, qual, npos + 1, tlen))
        at += 4 + size
    return refs, out


def test_bam_holds_every_mapped_read_in_order(spark, small, tmp_path):  # noqa: F811
    seqs, _, m = small
    rows = report.sam_rows(m)
    bam.write_bam(rows, m.chunks, f"file://{tmp_path}/out", files=3)
    got = []
    for p in sorted(glob.glob(f"{tmp_path}/out/*.bam")):
        refs, recs = parse_bam(p)
        assert refs == [("r1", 3000), ("r2", 1300)]
        got += recs
        bai = open(p + ".bai", "rb").read()
        assert bai[:4] == b"BAI\1" and struct.unpack_from("<i", bai, 4)[0] == 2
    assert [(r[0], r[1]) for r in got] == sorted((r[0], r[1]) for r in got)
    want = sorted((r.ref, r.pos, r.name, r.seq, r.seq_q) for r in rows.collect())
    assert sorted((r[0], r[1], r[5], r[6], r[7]) for r in got) == want
    assert any("D" in r[4] for r in got) and any("I" in r[4] for r in got)


def test_bai_chunks_point_at_records(spark, small, tmp_path):  # noqa: F811
    _, _, m = small
    bam.write_bam(report.sam_rows(m), m.chunks, f"file://{tmp_path}/one", files=1)
    (path,) = glob.glob(f"{tmp_path}/one/*.bam")
    bai = open(path + ".bai", "rb").read()
    at, total, starts = 8, 0, []
    for _ in range(2):
        (bins,) = struct.unpack_from("<i", bai, at)
        at += 4
        for _ in range(bins):
            b, n = struct.unpack_from("<Ii", bai, at)
            at += 8
            chunks = struct.unpack_from(f"<{2 * n}Q", bai, at)
            at += 16 * n
            if b == bam.STATS_BIN:
                total += chunks[2]
            else:
                starts += chunks[::2]
        (lin,) = struct.unpack_from("<i", bai, at)
        at += 4 + 8 * lin
    assert at == len(bai)
    assert total == len(parse_bam(path)[1])
    raw = open(path, "rb").read()
    for v in starts:
        block = raw[v >> 16 :]
        size = struct.unpack_from("<H", block, 16)[0] + 1
        body = gzip.decompress(block[:size])
        ref, pos = struct.unpack_from("<ii", body, (v & 65535) + 4)
        assert ref in (0, 1) and 0 <= pos < 3000


def test_report_tables_are_written(spark, small, tmp_path):  # noqa: F811
    _, _, m = small
    report.write(m, str(tmp_path / "r"), unmatched=True, undermatched=True)
    names = {p.split("/")[-1] for p in glob.glob(str(tmp_path / "r" / "*"))}
    assert {"loci", "loci_tsv", "depth_histogram", "qq", "run_summary", "unfound_fastq", "variable_regions", "insert_loci"} <= names
    summary = {r.metric: r.value for r in spark.read.json(str(tmp_path / "r/run_summary")).collect()}
    assert summary["placed"] + summary["unfound"] == summary["total_reads"] == 240
    assert spark.read.text(str(tmp_path / "r/unfound_fastq")).count() == 4 * summary["unfound"]


PICTURE_READS = "ref string, pos long, reverse boolean, pair_id long, mate int, nucs string, ref_bases string, qual string, indel int, inserted string, inserted_q int"


def test_picture(spark):
    region = spark.createDataFrame([("r", 10, 20)], "ref string, start long, stop long")
    rows = [("r", 12, False, 1, 1, "ACGTT", "ACGTA", "IIIII"), ("r", 8, False, 2, 1, "AAAA", "AAAA", "IIII"), ("r", 18, True, 3, 2, "GGGG", "GCAG", "I:#I"), ("r", 15, False, 4, 1, "TA", "CC", ":#")]
    a = spark.createDataFrame([(*r, 0, None, None) for r in rows], PICTURE_READS)
    got = {r.pair_id: r.row for r in picture.read_rows(region, a, 8).collect()}
    end = " " * 17
    assert got == {1: "  ....T" + end + " ", 3: " " * 8 + ".g" + end + "R", 4: " " * 5 + "t " + end + " "}


def test_picture_opens_columns_for_insertions(spark):
    text = "ACGTACGTAC" * 2
    region = spark.createDataFrame([("r", 1, 13), ("r", 13, 13)], "ref string, start long, stop long")
    read = lambda pos, pair, n, *indel: ("r", pos, False, pair, 1, text[pos - 1 : pos - 1 + n], text[pos - 1 : pos - 1 + n], "I" * n, *indel)
    rows = [
        read(1, 1, 10, 4, "GG", 40), read(2, 2, 8, 3, "T", 25), read(5, 3, 6, 0, None, None), read(3, 4, 4, 0, None, None),
        read(6, 5, 7, 2, "ccc".upper(), 3), read(2, 6, 3, 0, None, None), read(9, 7, 8, 6, "A", 40),
    ]
    a = spark.createDataFrame(rows, PICTURE_READS)
    end = " " * 18
    got = {r.pair_id: r.row for r in picture.read_rows(region, a, 4).collect()}
    # in front of position 5 two columns are open, in front of 8 three; read 7's insertion lies behind the region
    assert got == {
        1: "....GG...___..." + end, 2: " ...t_...___.." + end, 3: " " * 6 + "...___..." + end, 4: "  ..__.." + end,
        5: " " * 7 + "..   ....." + end, 6: " ..." + end, 7: " " * 13 + "...." + end,
    }
    chunks = spark.createDataFrame([("r", i, text[4 * i : 4 * i + 4]) for i in range(5)], "ref string, chunk long, s string")
    assert [tuple(r) for r in picture.reference_rows(region, a, chunks, 4, 4).collect()] == [("r", 1, "ACGT__ACG___TACAC")]


def test_stream_gives_the_batch_result(spark, sf_dir, tmp_path):
    from helicase.sources import tables as T
    from helicase.streaming import reads as R

    batch, ext = stages.reads(spark, sf_dir), stages.reference_ext(spark, sf_dir)
    batch.limit(600).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hits = R.exact_placements(stream, ext, T.CHUNK, T.READ_LENGTHS)
    q = (
        R.running_coverage(hits, ext, T.CHUNK).writeStream.outputMode("complete").format("memory").queryName("cov")
        .option("checkpointLocation", str(tmp_path / "ckpt")).start()
    )
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    same = spark.read.parquet(str(tmp_path / "in"))
    want = R.running_coverage(R.exact_placements(same, ext, T.CHUNK, T.READ_LENGTHS), ext, T.CHUNK)
    got = sorted(tuple(r) for r in spark.table("cov").collect())
    assert got and got == sorted(tuple(r) for r in want.collect())
