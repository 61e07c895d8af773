"""Scalar functions, formats and alignments over the derived reads and reference."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from helicase.catalog.base import amino, gc, rc, sql
from helicase.catalog.mapping import _loci
from helicase.functions import dna, edit
from helicase.operators import coverage, pairing
from helicase.plans import stages as S
from helicase.session import shared_path
from helicase.sources import fasta, fastq, genome, sam, tables as T

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def rd(spark, d):
    return S.reads(spark, d)


def st(spark, d):
    return T.both_genomes(spark, d)


@query("v01_revcomp", sql(f"SELECT pair_id, mate, {rc('nucs')} AS nucs, reverse(qual) AS qual FROM reads", "reads"))
def _(spark, d):
    return rd(spark, d).select("pair_id", "mate", dna.revcomp("nucs").alias("nucs"), F.reverse("qual").alias("qual"))


@query("v02_gc", sql(f"SELECT pair_id, mate, round({gc('nucs')}, 6) AS gc FROM reads", "reads"))
def _(spark, d):
    return rd(spark, d).select("pair_id", "mate", F.round(dna.gc_content("nucs"), 6).alias("gc"))


@query("v03_expected_errors", sql("SELECT pair_id, mate, round(sum(pow(10, -q / 10)), 6) AS errors FROM read_bases GROUP BY pair_id, mate", "read_bases"))
def _(spark, d):
    e = F.aggregate(F.transform(dna.qualities("qual"), dna.q_to_err), F.lit(0.0), lambda a, x: a + x)
    return rd(spark, d).where(F.length("nucs") > 0).select("pair_id", "mate", F.round(e, 6).alias("errors"))


CODE = " + ".join(f"(instr('ACGT', translate(substr(s, {i + 1}, 1), 'N', 'A')) - 1) * {4 ** (15 - i)}" for i in range(16))


HALVES = "(SELECT ref, chunk, half, substr(s, (half * 16 + 1)::INT, 16) AS s FROM chunks, (SELECT unnest([0, 1]) AS half))"


def _halves(spark, d):
    """The two 16-base halves of each chunk: ``(ref, chunk, half, s)``."""
    both = F.array(F.left("s", F.lit(16)), F.substring(F.col("s"), F.lit(17), F.lit(16)))
    return st(spark, d).select("ref", "chunk", F.posexplode(both).alias("half", "s"))


@query("v04_kmer_code", sql(f"SELECT ref, chunk, half, ({CODE})::BIGINT AS code FROM {HALVES}", "chunks"))
def _(spark, d):
    return _halves(spark, d).select("ref", "chunk", "half", dna.kmer_code("s").alias("code"))


PREFIX = "list_min(list_concat(list_filter(range(1, least(length(s), length(t)) + 1), lambda i: substr(s, i::INT, 1) <> substr(t, i::INT, 1)), [least(length(s), length(t)) + 1])) - 1"


@query("v09_common_prefix", sql(f"SELECT ref, chunk, ({PREFIX})::INT AS n FROM chunks", "chunks"))
def _(spark, d):
    return st(spark, d).select("ref", "chunk", dna.common_prefix("s", "t").alias("n"))


@query(
    "v10_fuzzy_prefix",
    sql(
        """SELECT ref, chunk, coalesce(min(p) FILTER (bad > p // 8), any_value(n))::INT AS n FROM (
             SELECT ref, chunk, p, n, sum(CASE WHEN p > 0 AND substr(s, p::INT, 1) <> substr(t, p::INT, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY ref, chunk ORDER BY p) AS bad
             FROM (SELECT *, least(length(s), length(t)) AS n, unnest(generate_series(0, least(length(s), length(t)))) AS p FROM chunks)) GROUP BY ref, chunk""",
        "chunks",
    ),
)
def _(spark, d):
    return st(spark, d).select("ref", "chunk", dna.fuzzy_prefix("s", "t", 8).alias("n"))


@query("v11_hamming", sql("SELECT ref, chunk, hamming(left(s, least(length(s), length(t))), left(t, least(length(s), length(t))))::INT AS n FROM chunks", "chunks"))
def _(spark, d):
    return st(spark, d).select("ref", "chunk", dna.hamming("s", "t").alias("n"))


@query("v16_packed_bases", sql("SELECT pair_id, mate, regexp_replace(upper(lower(nucs)), '[^ACGT]', 'A', 'g') AS nucs FROM reads", "reads"))
def _(spark, d):
    return rd(spark, d).select("pair_id", "mate", dna.pack_bases(F.lower("nucs")).alias("nucs"))


KEY = "regexp_replace({0}, '(.)(.)(.)(.)', '\\4\\3\\2\\1', 'g')"


@query("v17_canonical", sql(f"SELECT ref, chunk, half, {KEY.format('s')} < {KEY.format(rc('s'))} AS canonical FROM {HALVES}", "chunks"))
def _(spark, d):
    return _halves(spark, d).select("ref", "chunk", "half", dna.is_canonical_packed("s").alias("canonical"))


@query(
    "v19_bam_nibbles",
    sql(
        """SELECT pair_id, mate, CASE WHEN length(h) % 2 = 1 THEN h || '0' ELSE h END AS packed
           FROM (SELECT pair_id, mate, translate(nucs, 'ACGTN', '1248F') AS h FROM reads)""",
        "reads",
    ),
)
def _(spark, d):
    return rd(spark, d).select("pair_id", "mate", F.hex(dna.bam_nibbles("nucs")).alias("packed"))


def bin_sql(beg, end):
    arms = " ".join(f"WHEN ({beg}) >> {s} = ({end} - 1) >> {s} THEN {b} + (({beg}) >> {s})" for s, b in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)))
    return f"(CASE {arms} ELSE 0 END)::INT"


@query("v20_reg2bin", sql(f"SELECT c_custkey, {bin_sql('c_custkey * 7919', '(c_custkey * 7919 + c_custkey * c_custkey % 70000 + 1)')} AS bin FROM customer"))
def _(spark, d):
    k = F.col("c_custkey")
    return T.table(spark, d, "customer").select("c_custkey", dna.reg2bin(k * 7919, k * 7919 + k * k % 70000 + 1).alias("bin"))


@query(
    "v21_cigar",
    sql(
        """SELECT pair_id, mate, CASE WHEN i = 0 OR n < 12 THEN n || 'M' WHEN i < 0 THEN -i || 'M1D' || (n + i) || 'M' ELSE i || 'M1I' || (n - 1 - i) || 'M' END AS cigar
           FROM (SELECT pair_id, mate, length(nucs) AS n, pair_id % 21 - 10 AS i FROM reads)""",
        "reads",
    ),
)
def _(spark, d):
    i = F.when(F.length("nucs") < 12, 0).otherwise(F.col("pair_id") % 21 - 10)
    return rd(spark, d).select("pair_id", "mate", dna.cigar(F.length("nucs"), i).alias("cigar"))


@query("v22_read_name", sql("SELECT pair_id, mate, name AS name FROM reads", "reads"))
def _(spark, d):
    return rd(spark, d).select("pair_id", "mate", dna.read_name(F.concat("name", F.lit(" length=72 run 5"))).alias("name"))


@query("v23_sanger_quality", sql("SELECT pair_id, mate, qual FROM reads WHERE length(nucs) > 0", "reads"))
def _(spark, d):
    r = rd(spark, d).where(F.length("nucs") > 0)
    return r.select("pair_id", "mate", dna.sanger_string(dna.qualities("qual")).alias("qual"))


FRAMES = {
    "w": "SELECT ref, chunk, ext AS fwd, " + rc("ext") + " AS rev FROM ext",
    "f": "SELECT ref, chunk, strand, frame, substr(CASE strand WHEN '+' THEN fwd ELSE rev END, frame + 1) AS t FROM w, (SELECT unnest(['+', '-']) AS strand), (SELECT unnest([0, 1, 2]) AS frame)",
    "cod": "SELECT ref, chunk, strand, frame, i, substr(t, (i * 3 + 1)::INT, 3) AS codon FROM (SELECT *, unnest(generate_series(0, (length(t) + 2) // 3 - 1)) AS i FROM f)",
}


@query(
    "v24_six_frame",
    sql(f"SELECT ref, chunk, strand, frame::INT AS frame, string_agg({amino('codon')}, '' ORDER BY i) AS protein FROM cod GROUP BY ALL", "ext", extra=FRAMES),
)
def _(spark, d):
    e = S.reference_ext(spark, d)
    both = F.inline(F.array(F.struct(F.lit("+").alias("strand"), F.col("ext").alias("t")), F.struct(F.lit("-").alias("strand"), dna.revcomp("ext").alias("t"))))
    t = e.select("ref", "chunk", both)
    frames = F.inline(F.array(*[F.struct(F.lit(f).alias("frame"), dna.translate_frame("t", f).alias("protein")) for f in range(3)]))
    return t.select("ref", "chunk", "strand", frames)


RANGES = "SELECT ref, chunk * 32 + 5 AS start, chunk * 32 + 112 + chunk % 7 AS stop FROM chunks JOIN chroms USING (ref) WHERE chunk * 32 + 112 + chunk % 7 <= len"
RANGE_FRAMES = {
    "ranges": RANGES,
    "texts": "SELECT e.ref, e.start, e.stop, string_agg(base, '' ORDER BY g.pos) AS fwd FROM ranges e JOIN genome g ON g.ref = e.ref AND g.pos >= e.start AND g.pos < e.stop GROUP BY ALL",
    "turned": "SELECT ref, start, stop, strand, frame, substr(CASE strand WHEN '+' THEN fwd ELSE " + rc("fwd") + " END, frame + 1) AS t FROM texts, (SELECT unnest(['+', '-']) AS strand), (SELECT unnest([0, 1, 2]) AS frame)",
    "codons": "SELECT ref, start, stop, strand, frame, i, substr(t, (i * 3 + 1)::INT, 3) AS codon FROM (SELECT *, unnest(generate_series(0, (length(t) + 2) // 3 - 1)) AS i FROM turned)",
}


@query(
    "v24_range_frames",
    sql(f"SELECT ref, start, stop, strand, frame::INT AS frame, string_agg({amino('codon')}, '' ORDER BY i) AS protein FROM codons GROUP BY ALL", "chunks", "chroms", "genome", extra=RANGE_FRAMES),
)
def _(spark, d):
    chunks = S.reference(spark, d)
    stop = F.col("chunk") * T.CHUNK + 112 + F.col("chunk") % 7
    ranges = chunks.join(genome.chromosomes(chunks), "ref").select("ref", (F.col("chunk") * T.CHUNK + 5).alias("start"), stop.alias("stop"), "len").where("stop <= len").drop("len")
    rows = coverage.six_frames(ranges, S.reference_ext(spark, d), T.CHUNK)
    order = F.when(F.col("strand") == "+", F.col("chunk")).otherwise(-F.col("chunk"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "protein"))), lambda x: x["protein"])
    return rows.groupBy("ref", "start", "stop", "strand", "frame").agg(F.array_join(parts, "").alias("protein"))


@query("p13_snippets", sql("SELECT r.ref, r.chunk * 32 + 9 AS pos, substr(ext, 9, 50) AS snippet FROM ext r", "ext"))
def _(spark, d):
    want = S.reference(spark, d).select("ref", (F.col("chunk") * 32 + 9).alias("pos"))
    return genome.snippets(want, S.reference_ext(spark, d), T.CHUNK, F.lit(50))


@query(
    "p14_ranges",
    sql(
        """SELECT e.ref, e.start, e.stop, min(g.pos) AS "at", string_agg(base, '' ORDER BY g.pos) AS bases
           FROM (SELECT ref, chunk * 32 + 5 AS start, chunk * 32 + 205 AS stop FROM chunks) e JOIN chroms USING (ref)
           JOIN genome g ON g.ref = e.ref AND g.pos >= e.start AND g.pos < e.stop WHERE e.stop <= len GROUP BY e.ref, e.start, e.stop, (g.pos - 1) // 32""",
        "genome", "chunks", "chroms",
    ),
)
def _(spark, d):
    c = S.reference(spark, d)
    r = c.select("ref", (F.col("chunk") * 32 + 5).alias("start"), (F.col("chunk") * 32 + 205).alias("stop"))
    r = r.join(genome.chromosomes(c), "ref").where("stop <= len").drop("len")
    return fasta.extract(c, r, T.CHUNK)


@query(
    "s32_packed_dump",
    sql(
        """SELECT ref, chunk, string_agg(printf('%02X', code), '' ORDER BY b) AS packed FROM (
             SELECT ref, chunk, (i - 1) // 4 AS b, sum((instr('ACGT', substr(s, i::INT, 1)) - 1) * pow(4, (i - 1) % 4))::INT AS code
             FROM chunks, (SELECT unnest(generate_series(1, 32)) AS i) WHERE i <= length(s) GROUP BY ALL) GROUP BY ref, chunk""",
        "chunks",
    ),
)
def _(spark, d):
    return fasta.packed_rows(S.reference(spark, d)).select("ref", "chunk", F.hex("packed").alias("packed"))


CASSETTE = "ACGTTGCAAGGCTTACGGATCCATTTGACC"


@query(
    "p15_splice",
    sql(
        f"""SELECT 'chr1' AS ref, (p - 1) // 32 AS chunk, string_agg(base, '' ORDER BY p) AS s FROM (
              SELECT CASE WHEN pos < 1000 THEN pos ELSE pos + {len(CASSETTE)} - 250 END AS p, base FROM genome WHERE ref = 'chr1' AND (pos < 1000 OR pos >= 1250)
              UNION ALL SELECT 999 + i, substr({rc("'" + CASSETTE + "'")}, i::INT, 1) FROM (SELECT unnest(generate_series(1, {len(CASSETTE)})) AS i)) GROUP BY 2""",
        "genome",
    ),
)
def _(spark, d):
    return fasta.splice(S.reference(spark, d), T.CHUNK, "chr1", 1000, 1250, CASSETTE)


@query(
    "s31_fasta_lines",
    sql(
        """SELECT ref, (pos - 1) // 70 + 1 AS line_no, string_agg(base, '' ORDER BY pos) AS value FROM genome GROUP BY ref, 2
           UNION ALL SELECT ref, 0, '>' || ref FROM chroms""",
        "genome", "chroms",
    ),
)
def _(spark, d):
    return fasta.fasta_lines(S.reference(spark, d), T.CHUNK)


@query("s28_unfound_fastq", sql("SELECT '@' || name || chr(10) || nucs || chr(10) || '+' || chr(10) || qual AS value FROM unfound", "unfound"))
def _(spark, d):
    return fastq.fastq_lines(S.mapping(spark, d).unfound)


@query("s01_fastq_parse", sql("SELECT name AS header, nucs, qual FROM reads WHERE length(nucs) > 0", "reads"))
def _(spark, d):
    # twenty-odd files of many records, their lines in no order
    file = F.concat(F.lit("part-"), (F.col("pair_id") % 23).cast("string"))
    nth = F.row_number().over(W.partitionBy(file).orderBy("pair_id", "mate")) - 1
    records = rd(spark, d).where(F.length("nucs") > 0).withColumn("file", file).withColumn("nth", nth)
    text = F.posexplode(F.array(F.concat(F.lit("@"), "name"), "nucs", F.lit("+"), "qual")).alias("i", "value")
    lines = records.select("file", "nth", text).select("file", (F.col("nth") * 4 + F.col("i")).cast("long").alias("line_no"), "value")
    return fastq.parse_fastq(lines).select("header", "nucs", "qual")


@query("s01_fastq_file", sql("SELECT name AS header, nucs, qual FROM reads WHERE length(nucs) > 0", "reads"))
def _(spark, d):
    path = shared_path(spark, "fastq")
    fastq.write_fastq(rd(spark, d).where(F.length("nucs") > 0), path)
    return fastq.read_fastq(spark, path).select("header", "nucs", "qual")


def _sam_rows(spark, d):
    m = S.mapping(spark, d)
    dist = pairing.pair_distances(m.best_pairs, m.kept)
    raw = m.kept.select("pair_id", "mate", "name", F.col("nucs").alias("raw_nucs"), F.col("qual").alias("raw_qual"))
    placed = m.placed.join(raw, ["pair_id", "mate"]).join(m.aligned.select("pair_id", "mate", "indel", "amount"), ["pair_id", "mate"])
    return sam.original_bases(sam.mate_fields(placed, dist))


@query(
    "s19_sam",
    sql(
        """SELECT l.ref, l.pos, concat_ws(chr(9), l.name, CASE WHEN paired THEN 3 + CASE WHEN mate = 1 THEN 64 ELSE 128 END ELSE 0 END + CASE WHEN l.reverse THEN 16 ELSE 0 END,
             l.ref, l.pos, 42, CASE WHEN indel > 0 THEN indel || 'M' || amount || 'I' || (length(whole) - indel - amount) || 'M' WHEN indel < 0 THEN -indel || 'M' || amount || 'D' || (length(whole) + indel) || 'M' ELSE length(whole) || 'M' END, CASE WHEN paired THEN '=' ELSE '*' END, CASE WHEN paired THEN mate_pos ELSE 0 END,
             CASE WHEN NOT paired THEN 0 WHEN reverse1 <> (mate = 2) THEN -dist ELSE dist END, whole, whole_q) AS value
           FROM laid l LEFT JOIN (SELECT pair_id, reverse1, length(nucs) + CASE WHEN reverse2 THEN pos2 - pos1 ELSE pos1 - pos2 END AS dist FROM best JOIN kept USING (pair_id) WHERE mate = 1) b USING (pair_id)""",
        "laid", "best", "kept",
    ),
)
def _(spark, d):
    return sam.sam_lines(_sam_rows(spark, d))


@query("s22_index_bins", sql(f"SELECT ref, {bin_sql('pos - 1', '(pos - 1 + length(whole))')} AS bin, count(*) AS n FROM laid GROUP BY ALL", "laid"))
def _(spark, d):
    return sam.index_bins(_sam_rows(spark, d))


@query("s22_linear_index", sql('SELECT ref, (pos - 1) >> 14 AS "window", min(pos) AS first_pos FROM laid GROUP BY ALL', "laid"))
def _(spark, d):
    return sam.linear_index(_sam_rows(spark, d))


@query("s24_sam_header", sql("SELECT '@SQ' || chr(9) || 'SN:' || ref || chr(9) || 'LN:' || len AS value FROM chroms", "chroms"))
def _(spark, d):
    return sam.header_lines(S.reference(spark, d))


@query(
    "s25_read_length_json",
    sql("SELECT '[' || string_agg('[' || length || '.0,' || n || '.0]', ',' ORDER BY length) || ']' AS json FROM (SELECT length(nucs) AS length, count(*) AS n FROM reads GROUP BY 1)", "reads"),
)
def _(spark, d):
    from helicase.operators import qc

    return sam.pair_json(qc.read_lengths(rd(spark, d)), "length", "n")


@query(
    "s26_loci_tsv",
    sql("SELECT concat_ws(chr(9), ref, pos, num_diff, depth, a, aq, c, cq, g, gq, t, tq, dels, tot_q, summary) AS value FROM loci", "loci"),
)
def _(spark, d):
    l = _loci(spark, d).select(*"ref pos num_diff depth a aq c cq g gq t tq dels tot_q summary".split())
    return l.select(sam.tsv(l).alias("value"))


@query("s16_accessions", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'AC' || c_custkey ELSE '' END AS accession FROM customer")
def _(spark, d):
    c = T.table(spark, d, "customer")
    text = c.where("c_custkey % 3 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit("\tAC"), F.col("c_custkey").cast("string")).alias("value"))
    return fasta.with_accessions(c.select(F.col("c_custkey").alias("id")), fasta.parse_accessions(text))


@query(
    "s15_rrna_db",
    sql(
        "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE '' END AS name, upper(translate(md5(c_name), '0123456789abcdef', 'acgtacgtacgtacgt')) AS nucs FROM customer"
    ),
)
def _(spark, d):
    c = T.table(spark, d, "customer")
    seq = F.translate(F.md5("c_name"), "0123456789abcdef", "acgtacgtacgtacgt")
    head = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("S"), F.col("c_custkey").cast("string"), F.lit(" "), "c_name", F.lit("\tRoot"))).otherwise(F.col("c_custkey").cast("string"))
    recs = c.select(F.concat_ws("\n", head, F.left(seq, F.lit(20)), F.substring(seq, F.lit(21), F.lit(40)), F.lit("")).alias("value"))
    return fasta.parse_rrna_db(recs)


def _pairs(spark, d):
    return T.both_genomes(spark, d).select("ref", "chunk", "s", "t")


@query("v07_nw")
def _(spark, d):
    return _pairs(spark, d).select("ref", "chunk", edit.nw_udf()("s", "t").alias("a")).select("ref", "chunk", "a.*")


@query("v08_delta")
def _(spark, d):
    e = _pairs(spark, d).select("ref", "chunk", F.explode(edit.delta_udf("s", "t")).alias("e"))
    return e.select("ref", "chunk", "e.*")


@query("v15_global_align")
def _(spark, d):
    g = edit.global_align_udf(1, -1, -3, -1)
    return _pairs(spark, d).select("ref", "chunk", g("s", "t").alias("a")).select("ref", "chunk", "a.*")
