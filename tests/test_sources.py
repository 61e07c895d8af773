"""Readers and writers on small files."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from helicase.sources import annotations as A, fasta, fastq, genome


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if name.endswith(".gz") else open
    with opener(path, "wt", newline="") as f:
        f.write(text)
    return path


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


FASTQ = "@a 1\nACGT\n+\n@III\n@b\nGGNA\n+b\n!!!!\n@c\nTT\n+\n55\n"
WANT = [("a 1", "ACGT", "@III"), ("b", "GGNA", "!!!!"), ("c", "TT", "55")]


@pytest.mark.parametrize("name", ["x.fastq", "x.fastq.gz"])
def test_fastq_with_at_sign_quality(spark, folder, name):
    assert rows(fastq.read_fastq(spark, put(folder, name, FASTQ)), "header", "nucs", "qual") == WANT


def test_fastq_split_in_blocks(spark, folder):
    text = "".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@II5' * (i % 7 + 1)}\n" for i in range(3000))
    path = put(folder, "big.fastq", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        r = fastq.read_fastq(spark, path)
        got = sorted((x.record, x.header, x.nucs, x.qual) for x in r.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, f"r{i}", "ACGT" * (i % 7 + 1), "@II5" * (i % 7 + 1)) for i in range(3000)]


def test_fastq_rejects_other_text(spark, folder):
    with pytest.raises(Exception, match="not FASTQ"):
        fastq.read_fastq(spark, put(folder, "x", "hello\nACGT\n+\nIIII\n")).collect()


def test_fastq_quality_offset(spark, folder):
    text = "@a\nAC\n+\nhi\n"
    got = fastq.read_fastq(spark, put(folder, "x", text), 64)
    assert rows(got, "qual") == [("IJ",)]
    with pytest.raises(Exception, match="below the offset"):
        fastq.read_fastq(spark, put(folder, "y", "@a\nAC\n+\n!i\n"), 64).collect()


def test_pairs_follow_first_file_and_trim(spark, folder):
    one = put(folder, "1", "@a 1\nACGTAC\n+\nIIIIII\n@b 1\nTT\n+\n##\n")
    two = put(folder, "2", "@a 2\nGGGGGG\n+\n555555\n@b 2\nCC\n+\n##\n@c 2\nAA\n+\n##\n")
    got = rows(fastq.read_pairs(spark, one, two, begin=1, end=2), "pair_id", "mate", "name", "nucs", "qual")
    assert got == [(0, 1, "a", "CGT", "III"), (0, 2, "a", "GGG", "555"), (1, 1, "b", "TT", "##"), (1, 2, "b", "CC", "##")]


def test_pairs_of_several_files(spark, folder):
    for side in (1, 2):
        for j, names in enumerate(("ab", "cde")):
            put(folder, f"side{side}/part{j}.fq", "".join(f"@{n} {side}\n{'ACGT'[side] * 4}\n+\nIIII\n" for n in names))
    got = rows(fastq.read_pairs(spark, folder + "/side1", folder + "/side2"), "pair_id", "mate", "name", "nucs")
    assert got == [(i, m, n, "ACGT"[m] * 4) for i, n in enumerate("abcde") for m in (1, 2)]


def test_fastq_roundtrip(spark, folder):
    df = spark.createDataFrame([("x", "ACGT", "II#I"), ("y", "A", "@")], "name string, nucs string, qual string")
    fastq.write_fastq(df, folder + "/out", "gzip")
    assert rows(fastq.read_fastq(spark, folder + "/out"), "header", "nucs", "qual") == [("x", "ACGT", "II#I"), ("y", "A", "@")]


def test_fasta_many_chromosomes_any_split(spark, folder):
    seqs = {"one": "ACGTN" * 700, "two": "ggcat" * 3, "three": "T" * 1024}
    text = "".join(f">{n} some text\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in seqs.items())
    path = put(folder, "g.fa", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in sorted(fasta.read_fasta(spark, path, 128).collect(), key=lambda r: r.chunk):
            got[r.ref] = got.get(r.ref, "") + r.s
            assert r.fullname == r.ref + " some text"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == seqs
    packed = fasta.read_fasta(spark, path, 128, packed=True).where("ref = 'two'").first().s
    assert packed == "GGCAT" * 3


def test_fasta_roundtrip(spark, folder):
    seq = "ACGTTGCA" * 50
    chunks = spark.createDataFrame([("c", i, seq[i * 64 : i * 64 + 64]) for i in range(7)], "ref string, chunk long, s string")
    fasta.write_fasta(chunks, folder + "/out", 64)
    lines = "".join(r.value + "\n" for r in spark.read.text(folder + "/out").collect())
    assert lines.splitlines()[0] == ">c" and all(len(x) == 70 for x in lines.splitlines()[1:-1])
    back = fasta.read_fasta(spark, put(folder, "b.fa", lines), 64)
    assert "".join(r.s for r in sorted(back.collect(), key=lambda r: r.chunk)) == seq


def test_offsets_and_lookup(spark):
    chunks = spark.createDataFrame([("a", 0, "ACGT"), ("a", 1, "AC"), ("b", 0, "GG")], "ref string, chunk long, s string")
    assert rows(genome.with_offsets(genome.chromosomes(chunks)), "ref", "len", "offset") == [("a", 6, 0), ("b", 2, 6)]
    ext = genome.with_overhang(chunks, 4, 4)
    want = spark.createDataFrame([("a", 3), ("b", 1)], "ref string, pos long")
    got = genome.snippets(want, ext, 4, F.lit(4))
    assert rows(got, "ref", "snippet") == [("a", "GTAC"), ("b", "GG")]


def test_gff(spark, folder):
    text = (
        "##gff\n"
        "c\ts\tgene\t10\t20\t.\t+\t.\tID=g1;Note=second;Name=first;Parent=p\n"
        "c\ts\tregion\t1\t99\t.\t+\t.\tgenome=chromosome\n"
        "c\ts\tCDS\t10\t20\t.\t-\t.\tproduct=x=y\n"
        "c\ts\texon\t5\t6\t.\t-\t.\t\n"
    )
    got = rows(A.read_gff(spark, put(folder, "x.gff", text)), "type", "start", "stop", "strand", "tag", "id", "parent", "gene")
    assert got == [
        ("CDS", 10, 20, False, "CDS: x=y ", "", "", True),
        ("exon", 5, 6, False, "exon", "", "", False),
        ("gene", 10, 20, True, "gene: first second ", "g1", "p", True),
    ]


def test_shift_gff_keeps_comments(spark):
    df = spark.createDataFrame([("#x\t1",), ("c\ts\tgene\t10\t20\t.\t+\t.\tID=a",)], "value string")
    got = sorted(r.value for r in A.shift_gff(df, 10, 5).collect())
    assert got == ["#x\t1", "c\ts\tgene\t10\t25\t.\t+\t.\tID=a"]


def test_genbank(spark, folder):
    text = (
        "LOCUS       AB1 5 bp\nDEFINITION  x\nFEATURES             Location/Qualifiers\n"
        "     source          1..900\n                     /organism=\"E\"\n"
        "     gene            complement(join(<10..20,\n                     30..>40))\n"
        "                     /gene=\"abc\"\n                     /pseudo\n                     /codon_start=1\n"
        "     CDS             5..9\n                     /product=\"two\n                     lines\"\n                     /translation=\"MM\"\n"
        "ORIGIN\n        1 acgta\n//\nLOCUS       AB2\nFEATURES             Location/Qualifiers\n     tRNA            7..8\nORIGIN\n//\n"
    )
    got = rows(A.read_genbank(spark, put(folder, "x.gbk", text)), "chromosome", "type", "start", "stop", "strand", "tag", "gene")
    assert got == [
        ("AB1", "CDS", 5, 9, True, "two\\n                     lines, ", True),
        ("AB1", "gene", 30, 40, False, "abc, , 1, ", True),
        ("AB2", "tRNA", 7, 8, True, "", False),
    ]


def test_rrna_db_keeps_last_record(spark, folder):
    text = ">12\nacgt\nAC\n>S7 Some name\tRoot;x\nggg\n"
    got = rows(fasta.read_rrna_db(spark, put(folder, "db", text)), "id", "name", "nucs")
    assert got == [(7, "Some name", "GGG"), (12, "", "ACGTAC")]


def test_splits_assemble_their_own_records():
    """Wherever a file is cut, the splits give every record once, and only lines at the cuts come out loose."""
    import random

    import pyarrow as pa

    r = random.Random(3)
    lines = []
    for i in range(120):
        n = r.randint(1, 9)
        lines += [f"@r{i}", "".join(r.choice("ACGT") for _ in range(n)), "+", "".join(r.choice("@+I#") for _ in range(n))]
    for _ in range(40):
        cuts = sorted({0, len(lines), *(r.randrange(len(lines)) for _ in range(r.choice([1, 3])))})
        got, loose, before = [], [], 0
        for i, j in zip(cuts, cuts[1:]):
            split = fastq._Split("f", i)
            batches = []
            for k in range(i, j, 37):
                batches += split.feed(pa.array(lines[k : min(k + 37, j)], pa.string()))
            batches += split.feed(pa.array([], pa.string()), last=True)
            rows_of = [x for b in batches for x in b.to_pylist()]
            assert [x["lines"] for x in rows_of if x["lines"] is not None] == [j - i]
            for x in rows_of:
                if x["header"] is not None:
                    assert (before + x["line"]) % 4 == 0
                    got.append((before + x["line"], [x["header"], x["nucs"], "+", x["qual"]]))
                elif x["value"] is not None:
                    loose.append((before + x["line"], x["value"]))
            before += j - i
        whole = dict(got)
        assert len(whole) == len(got)
        text = dict(loose) | {at + i: v for at, own in whole.items() for i, v in enumerate(own)}
        assert [text[i] for i in range(len(lines))] == lines
        clear = [b - a for a, b in zip(cuts, cuts[1:]) if b - a >= 60]
        if len(clear) == len(cuts) - 1:
            assert len(loose) <= 6 * len(cuts)
