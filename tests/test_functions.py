"""Scalar functions on known values."""

import pytest
from pyspark.sql import functions as F

from helicase.functions import dna


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "kmer,code",
    [("A" * 16, 0), ("C" * 4, 85), ("C" * 8, 21845), ("C" * 12, 5592405), ("C" * 16, 1431655765), ("ACGT", 27)],
)
def test_kmer_code(spark, kmer, code):
    assert one(spark, dna.kmer_code(F.lit(kmer))) == code


@pytest.mark.parametrize(
    "codon,letter",
    [("GCC", "A"), ("ATG", "M"), ("TAA", "s"), ("TGA", "s"), ("TGG", "W"), ("NNN", "?"), ("TGN", "?"), ("ATN", "I"), ("CT", "L"), ("C", "?"), ("", "?"), ("XXX", "?")],
)
def test_amino_acid(spark, codon, letter):
    assert one(spark, dna.amino_acid(F.lit(codon))) == letter


def test_amino_name(spark):
    assert one(spark, dna.amino_name(F.lit("A"))) == "Alanine"
    assert one(spark, dna.amino_name(F.lit("B"))) == "?"


@pytest.mark.parametrize("text,want", [("TTTTGGGCCA", "TGGCCCAAAA"), ("", ""), ("ANCX", "XGNT")])
def test_revcomp(spark, text, want):
    assert one(spark, dna.revcomp(F.lit(text))) == want


@pytest.mark.parametrize("text,gc", [("GCNA", 0.5), ("", 0.0), ("XX", 0.0), ("GXC", 1.0)])
def test_gc_content(spark, text, gc):
    assert one(spark, dna.gc_content(F.lit(text))) == gc


@pytest.mark.parametrize(
    "text,hexed", [("AAAA", "1111"), ("CCCC", "2222"), ("ACACACAC", "12121212"), ("NNNN", "FFFF"), ("PPPP", "FFFF"), ("ACG", "1240")]
)
def test_bam_nibbles(spark, text, hexed):
    assert one(spark, F.hex(dna.bam_nibbles(F.lit(text)))) == hexed


@pytest.mark.parametrize(
    "beg,end,want", [(0, 100, 4681), (16383, 16385, 585), (131071, 131073, 73), (5000000, 5000100, 4986), (0, 1 << 29, 0)]
)
def test_reg2bin(spark, beg, end, want):
    assert one(spark, dna.reg2bin(F.lit(beg), F.lit(end))) == want


def test_q_to_err_rejects_high_q(spark):
    assert one(spark, dna.q_to_err(F.lit(10))) == pytest.approx(0.1)
    with pytest.raises(Exception, match="no error rate"):
        one(spark, dna.q_to_err(F.lit(60)))


@pytest.mark.parametrize("indel,amount,want", [(0, 0, "60M"), (-25, 2, "25M2D35M"), (30, 2, "30M2I28M")])
def test_cigar(spark, indel, amount, want):
    assert one(spark, dna.cigar(F.lit(60), F.lit(indel), F.lit(amount))) == want


def test_population_variance(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    assert tuple(df.agg(F.avg("x"), F.var_pop("x")).first()) == (2.0, 2.0)


def test_packed_order_puts_first_base_lowest(spark):
    # CAAA and AAAC: as bytes 1 and 64, although AAAC sorts first as text.
    assert one(spark, dna.packed_order_key(F.lit("CAAA")) < dna.packed_order_key(F.lit("AAAC"))) is True
    # A palindrome does not sort before itself.
    assert one(spark, dna.is_canonical_packed(F.lit("ACGTACGT"))) is False


def test_poisson_limit(spark):
    import math

    from helicase.operators.qc import poisson_limit

    def exact(mean):
        total, k = 0.0, 0
        while True:
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            if total >= 0.999:
                return k
            k += 1

    means = [0.1, 0.77, 1.0, 2.0, 15.0, 20.5, 21.0, 100.0, 1000.0, 54321.0, 1e6]
    got = {r.m: r.k for r in spark.createDataFrame([(m,) for m in means + [0.0]], "m double").select("m", poisson_limit(F.col("m")).alias("k")).collect()}
    assert got == {m: exact(m) for m in means} | {0.0: 0}
    assert [got[m] for m in (0.1, 0.77, 1.0, 2.0)] == [2, 5, 5, 8] and abs(got[1000.0] - 1099) <= 1


def test_sanger_roundtrip(spark):
    assert one(spark, dna.sanger_string(dna.qualities(F.lit("#I5!")))) == "#I5!"


def test_wrap(spark):
    assert one(spark, dna.wrap70(F.lit("A" * 150))) == "\n".join(["A" * 70, "A" * 70, "A" * 10])
    assert one(spark, dna.wrap70(F.lit("A" * 140))) == "\n".join(["A" * 70, "A" * 70])
