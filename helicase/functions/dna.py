"""Column expressions over nucleotide strings.

Everything here but :func:`with_indel` is a built-in Spark expression, so it stays inside the JVM and,
where Spark can, inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helicase.functions import stacks

# Complement pairs, base order of the 2-bit code.
BASES = "ACGT"
COMPLEMENT = "TGCA"
CODE_DIGITS = "0123"

# Standard genetic code, first base T C A G, then second, then
# third base in the same order; 's' is a stop codon.
CODON_ORDER = "TCAG"
GENETIC_CODE = "FFLLSSSSYYssCCsWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Amino-acid names as they appear in reports.
AMINO_NAMES = {
    "A": "Alanine",
    "C": "Cysteine",
    "D": "Aspartic Acid",
    "E": "Glutamic Acid",
    "F": "Phenylanaline",
    "G": "Glycine",
    "H": "Histidine",
    "I": "Isoleucine",
    "K": "Lysine",
    "L": "Leucine",
    "M": "Methionine",
    "N": "Asparagine",
    "P": "Proline",
    "Q": "Glutamine",
    "R": "Arganine",
    "S": "Serine",
    "T": "Threonine",
    "V": "Valine",
    "W": "Tryptophan",
    "Y": "Tyrosine",
    "s": "Stop",
}

# Fixed value: the 4-bit alphabet of the BAM format, in code order.
BAM_ALPHABET = "=ACMGRSVTWYHKDBN"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(nucs) -> Column:
    """Reverse complement; anything but A, C, G, T passes through unchanged."""
    return F.reverse(F.translate(_c(nucs), BASES, COMPLEMENT))


def gc_content(nucs) -> Column:
    """(C+G)/(A+C+G+T+N), 0 where none of those letters occurs."""
    s = _c(nucs)
    n = F.length(s)
    gc = n - F.length(F.translate(s, "CG", ""))
    total = n - F.length(F.translate(s, "ACGTN", ""))
    return F.when(total == 0, F.lit(0.0)).otherwise(gc / F.nullif(total, F.lit(0)))


def gc_bases(nucs) -> Column:
    """round(length * gc_content): the histogram bucket of a sequence."""
    return F.round(F.length(_c(nucs)) * gc_content(nucs)).cast("int")


def q_to_err(q) -> Column:
    """Sanger Q to error probability; Q of 60 and above is rejected."""
    q = _c(q)
    return F.when(q < 60, F.pow(F.lit(10.0), -q / 10.0)).otherwise(
        F.raise_error(F.concat(F.lit("no error rate for Q "), q.cast("string"))).cast("double")
    )


def pack_bases(nucs) -> Column:
    """Upper-cases and maps every letter but A, C, G, T to A, as 2-bit storage does."""
    return F.regexp_replace(F.upper(_c(nucs)), "[^ACGT]", "A")


def kmer_code(kmer) -> Column:
    """Base-4 code, first base most significant, unknown letters 0, at most 16 bases."""
    digits = F.translate(F.regexp_replace(_c(kmer), "[^ACGT]", "A"), BASES, CODE_DIGITS)
    return F.conv(digits, 4, 10).cast("long")


def packed_order_key(kmer16) -> Column:
    """Sort key with the byte order of 2-bit storage that keeps the first base lowest.

    Whole groups of four bases compare as one byte; a last partial group takes
    no part in the comparison.
    """
    return F.regexp_replace(F.regexp_extract(_c(kmer16), r"^((?:[ACGT]{4})*)", 1), "(.)(.)(.)(.)", "$4$3$2$1")


def is_canonical_packed(kmer) -> Column:
    """True where the storage of the k-mer sorts before its reverse complement's."""
    return packed_order_key(kmer) < packed_order_key(revcomp(kmer))


def canonical(kmer) -> Column:
    """The lexicographically smaller of a k-mer and its reverse complement."""
    return F.least(_c(kmer), revcomp(kmer))


def amino_acid(codon) -> Column:
    """One-letter amino acid of a codon, 's' stop, '?' unknown.

    A third base outside the alphabet falls where the unnamed alternative of
    that codon family lies: the code of base A, or of base A/G/T for 'AT?', and
    no amino acid at all in the TG family, which names all four.
    """
    codon = _c(codon)
    first = F.instr(F.lit(CODON_ORDER), F.substring(codon, 1, 1))
    second = F.instr(F.lit(CODON_ORDER), F.substring(codon, 2, 1))
    third = F.instr(F.lit(CODON_ORDER), F.substring(codon, 3, 1))
    known = (F.length(codon) >= 2) & (first > 0) & (second > 0)
    tg = F.substring(codon, 1, 2) == "TG"
    has_third = (third > 0) & (F.length(codon) >= 3)
    other = F.when(has_third, third).otherwise(F.lit(3))
    idx = (first - 1) * 16 + (second - 1) * 4 + other
    return (
        F.when(~known | (tg & ~has_third), F.lit("?"))
        .otherwise(F.substring(F.lit(GENETIC_CODE), idx, F.lit(1)))
    )


def amino_name(letter) -> Column:
    """Report name of a one-letter amino acid."""
    pairs = [F.lit(x) for kv in AMINO_NAMES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(letter)), F.lit("?"))


def translate_frame(nucs, frame: int) -> Column:
    """Amino-acid string of one reading frame.

    A partial last codon counts as one with unknown letters behind it.
    """
    s = F.substring(_c(nucs), frame + 1, 1 << 30)
    n = F.ceil(F.length(s) / 3).cast("int")
    codons = F.filter(F.split(F.regexp_replace(s, "(.{3})", "$1,"), ","), lambda c: c != "")
    one = F.transform(codons, amino_acid)
    return F.when(n > 0, F.array_join(one, "")).otherwise(F.lit(""))


def bases(nucs) -> Column:
    """Sequence as an array of one-letter strings."""
    return F.split(_c(nucs), "")


def qualities(qual) -> Column:
    """Array of integer Q scores of a Sanger quality string."""
    return F.transform(F.split(_c(qual), ""), lambda c: F.ascii(c) - 33)


def sanger_string(q_array) -> Column:
    """Sanger quality string of an array of Q scores."""
    return F.array_join(F.transform(_c(q_array), lambda q: F.char(q + 33)), "")


def exceeds_quality(qual, limit: int) -> Column:
    """Every base of the read has at least quality ``limit``."""
    return F.forall(qualities(qual), lambda q: q >= limit)


def hamming(a, b) -> Column:
    """Number of differing letters over the common length."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def common_prefix(a, b) -> Column:
    """Length of the common prefix."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: x == y)
    first_bad = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first_bad > 0, first_bad - 1).otherwise(n)


#: Bases that must agree in front of an indel and right behind it.
CLEAR = 11


def with_indel(df: DataFrame, read: str, ref: str, where: Column) -> DataFrame:
    """``df`` with ``indel`` and ``amount``: the single clear indel that explains ``read``, else 0 and 0.

    The indel stands at the end of the common prefix, so right-most inside a
    repeat. ``amount`` bases of the read (``indel`` > 0) or of the reference
    (``indel`` < 0) are left out; the rest then begins with ``CLEAR`` equal bases and
    has one differing base at most. Prefix and rest must be more than ten times the
    indel. The shortest one wins, an insertion before a deletion. Rows that
    ``where`` doesn't hold for are passed over.
    """
    found = stacks.clear_indel(F.col(read), F.col(ref), where, CLEAR)
    return df.withColumn("_found", found).select("*", "_found.amount", "_found.indel").drop("_found")


def fuzzy_prefix(a, b, ratio: int) -> Column:
    """Prefix length walked while mismatches stay within one per ``ratio`` bases."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    diff = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (x != y).cast("int"))
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("bad"))

    def step(acc, d):
        go = acc["bad"] <= F.floor(acc["pos"] / ratio)
        return F.when(
            go, F.struct((acc["pos"] + 1).alias("pos"), (acc["bad"] + d).alias("bad"))
        ).otherwise(acc)

    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(diff, zero, step, lambda acc: acc["pos"]))


def bam_nibbles(nucs) -> Column:
    """4-bit packed bases, high nibble first, unknown letters as N; binary."""
    hexed = F.translate(
        F.regexp_replace(_c(nucs), f"[^{BAM_ALPHABET}]", "N"), BAM_ALPHABET, "0123456789ABCDEF"
    )
    padded = F.when(F.length(hexed) % 2 == 1, F.concat(hexed, F.lit("0"))).otherwise(hexed)
    return F.unhex(padded)


def reg2bin(beg, end) -> Column:
    """UCSC bin of a zero-based half-open range."""
    beg, last = _c(beg), _c(end) - 1
    out = F.lit(0)
    for shift, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        lo, hi = F.shiftright(beg, shift), F.shiftright(last, shift)
        out = F.when(lo == hi, lo + base).otherwise(out)
    return out.cast("int")


def cigar(read_len, indel, amount=None) -> Column:
    """CIGAR of a read with at most one indel at offset ``abs(indel)``.

    Insertions are positive, deletions negative. ``amount`` is the true length
    of the indel; leave it out for single-base indels.
    """
    n, i = _c(read_len), _c(indel)
    a = F.lit(1) if amount is None else _c(amount)
    s = lambda c: c.cast("string")
    return (
        F.when(i < 0, F.concat(s(-i), F.lit("M"), s(a), F.lit("D"), s(n + i), F.lit("M")))
        .when(i > 0, F.concat(s(i), F.lit("M"), s(a), F.lit("I"), s(n - a - i), F.lit("M")))
        .otherwise(F.concat(s(n), F.lit("M")))
    )


def read_name(header) -> Column:
    """Header up to the first space."""
    return F.substring_index(_c(header), " ", 1)


def wrap70(seq) -> Column:
    """Sequence broken into lines of 70 letters."""
    return F.regexp_replace(F.regexp_replace(_c(seq), "(.{70})", "$1\n"), "\n$", "")
