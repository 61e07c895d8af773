"""Annotation queries: parsing, interval joins, codons."""

from __future__ import annotations

from pyspark.sql import functions as F

from helicase.catalog.base import amino, amino_name, rc, sql
from helicase.catalog.mapping import _loci
from helicase.functions import dna
from helicase.operators import annotations as A, loci
from helicase.plans import stages as S
from helicase.session import shared_path
from helicase.sources import annotations as parse, genome, tables as T

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


FEATURES = {
    "feats0": """SELECT c_custkey AS key, c_name, c_mktsegment, (c_custkey * 37) % (SELECT count(*) FROM part) AS gk FROM customer""",
    "feats1": """SELECT key, c_name, c_mktsegment, 'chr' || (gk // 1000 + 1) AS chromosome, ['gene', 'CDS', 'exon', 'mRNA', 'repeat_region'][key % 5 + 1] AS type,
        (gk % 1000) * 32 + 1 + key % 32 AS start, least((gk % 1000) * 32 + 1 + key % 32 + 59 + (key % 9) * 15,
          least(1000, (SELECT count(*) FROM part) - (gk // 1000) * 1000) * 32) AS stop, key % 2 = 0 AS strand FROM feats0""",
    "ann": """SELECT key, chromosome, chromosome AS ref, type, start, stop, strand,
          CASE WHEN key % 11 = 5 THEN type ELSE type || ': ' || c_name || ' ' || CASE WHEN key % 3 = 0 THEN c_mktsegment || ' ' ELSE '' END END AS tag,
          CASE WHEN key % 11 = 5 THEN '' ELSE type || ':' || key END AS id,
          CASE WHEN key % 11 = 5 OR key % 5 NOT IN (1, 2, 3) THEN '' ELSE 'gene:' || (key - key % 5) END AS parent, type IN ('gene', 'CDS') AS gene
        FROM feats1 WHERE key % 11 = 5 OR key % 50 <> 13""",
}


def lines(spark, d):
    return parse.gff_lines(T.feature_keys(spark, d))


def ann(spark, d):
    return parse.parse_gff(lines(spark, d)).withColumn("ref", F.col("chromosome"))


@query("s11_gff", sql("SELECT chromosome, type, start, stop, strand, tag, id, parent, gene FROM ann", extra=FEATURES))
def _(spark, d):
    return parse.parse_gff(lines(spark, d))


@query(
    "j05_stab",
    sql("SELECT l.ref, l.pos, start, stop, type, id FROM loci l JOIN ann ON ann.ref = l.ref AND l.pos BETWEEN start AND stop", "loci", extra=FEATURES),
)
def _(spark, d):
    return A.stab(_loci(spark, d).select("ref", "pos"), ann(spark, d)).select("ref", "pos", "start", "stop", "type", "id")


@query(
    "j06_contained",
    sql(
        """SELECT b.ref, b.lo, b.hi, count(*) AS n, sum(stop - start)::BIGINT AS bases FROM (SELECT ref, chunk * 32 + 1 AS lo, chunk * 32 + 512 AS hi FROM chunks) b
           JOIN ann ON ann.ref = b.ref AND start >= lo AND stop <= hi GROUP BY ALL""",
        "chunks", extra=FEATURES,
    ),
)
def _(spark, d):
    c = S.reference(spark, d)
    ranges = c.select("ref", (F.col("chunk") * 32 + 1).alias("lo"), (F.col("chunk") * 32 + 512).alias("hi"))
    j = A.contained(ranges, ann(spark, d).select("ref", "start", "stop"))
    return j.groupBy("ref", "lo", "hi").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


@query(
    "a24_cds_cov",
    sql(
        """SELECT c.ref, len + 1 AS size, coalesce(covered, 0) AS covered, coalesce(genes, 0) AS genes, round(coalesce(covered, 0) * 100.0 / (len + 1), 6) AS pct
           FROM chroms c LEFT JOIN (SELECT ref, count(DISTINCT p) AS covered FROM (SELECT ref, unnest(generate_series(start, stop - 1)) AS p FROM ann WHERE type IN ('CDS', 'exon')) GROUP BY ref) x USING (ref)
           LEFT JOIN (SELECT ref, count(*) AS genes FROM ann WHERE type = 'gene' GROUP BY ref) g USING (ref)""",
        "chroms", extra=FEATURES,
    ),
)
def _(spark, d):
    whole = genome.chromosomes(S.reference(spark, d)).select(
        "ref", F.lit("chromosome").alias("type"), F.lit(1).cast("long").alias("start"), F.col("len").alias("stop")
    )
    c = A.covered_positions(ann(spark, d).select(*whole.columns).unionByName(whole))
    return c.select("ref", "size", "covered", "genes", F.round("pct", 6).alias("pct"))


@query(
    "a25_start_codons",
    sql(
        f"""SELECT codon, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM (SELECT codon, count(*) AS n FROM (
             SELECT CASE WHEN strand THEN w ELSE {rc('w')} END AS codon FROM (
               SELECT strand, substr(ext, ((p - 1) % 32 + 1)::INT, 3) AS w FROM (SELECT *, CASE WHEN strand THEN start ELSE stop - 2 END AS p FROM ann WHERE type = 'gene') a
               JOIN ext ON ext.ref = a.ref AND ext.chunk = (p - 1) // 32)) GROUP BY codon) ORDER BY n DESC, codon DESC LIMIT 12""",
        "ext", extra=FEATURES,
    ),
)
def _(spark, d):
    c = A.start_codons(ann(spark, d), S.reference_ext(spark, d), T.CHUNK)
    return c.select("codon", "n", F.round("pct", 6).alias("pct"))


@query("p16_shifted", sql("SELECT ref, id, CASE WHEN start > 2000 THEN start + 50 ELSE start END AS start, CASE WHEN stop > 2000 THEN stop + 50 ELSE stop END AS stop FROM ann", extra=FEATURES))
def _(spark, d):
    return A.shifted(ann(spark, d).select("ref", "id", "start", "stop"), 2000, 50)


@query("p17_chromosomes", sql("SELECT chromosome, count(*) AS n FROM ann GROUP BY chromosome", extra=FEATURES))
def _(spark, d):
    return ann(spark, d).groupBy("chromosome").agg(F.count("*").alias("n"))


@query(
    "s30_shifted_gff",
    sql(
        """SELECT concat_ws(chr(9), chromosome, 'derived', type, CASE WHEN start > 2000 THEN start + 50 ELSE start END, CASE WHEN stop > 2000 THEN stop + 50 ELSE stop END,
             '.', CASE WHEN strand THEN '+' ELSE '-' END, '.', CASE WHEN key % 11 = 5 THEN '.' WHEN key % 50 = 13 THEN 'ID=whole' || key || ';genome=chromosome'
             ELSE 'ID=' || type || ':' || key || CASE WHEN key % 5 IN (1, 2, 3) THEN ';Parent=gene:' || (key - key % 5) ELSE '' END
               || CASE WHEN key % 3 = 0 THEN ';Note=' || c_mktsegment ELSE '' END || ';Name=' || c_name END) AS value FROM feats1""",
        extra=FEATURES,
    ),
)
def _(spark, d):
    return parse.shift_gff(lines(spark, d), 2000, 50)


@query("s34_parent_graph", sql("""SELECT '"' || id || '" -> "' || parent || '"' AS edge FROM ann WHERE parent <> ''""", extra=FEATURES))
def _(spark, d):
    return A.parent_edges(ann(spark, d))


GTF = {
    "gtf": """SELECT 'c' || (c_custkey // 10) % 5 AS chromo, CASE WHEN c_custkey % 10 = 0 THEN 'gene' ELSE 'exon' END AS type,
        (c_custkey // 10) * 1000 + (c_custkey % 10) * 90 + 1 AS start,
        (c_custkey // 10) * 1000 + (c_custkey % 10) * 90 + 1 + CASE WHEN c_custkey % 10 = 0 THEN 900 ELSE 30 + c_custkey % 7 END AS stop,
        (c_custkey // 10) % 2 = 0 AS sense, 'G' || c_custkey // 10 AS gene_name, CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_custkey % 3 + 1 END AS transcript_version,
        CASE WHEN (c_custkey // 10) % 7 = 3 THEN 'lincRNA' ELSE 'protein_coding' END AS gene_biotype FROM customer""",
    "newest": """SELECT * FROM gtf e WHERE type = 'exon' AND gene_biotype = 'protein_coding' AND transcript_version =
        (SELECT max(transcript_version) FROM gtf x WHERE x.type = 'exon' AND x.chromo = e.chromo AND x.gene_name = e.gene_name)""",
}


@query("s14_gtf", sql("SELECT chromo, type, start, stop, sense, gene_name, gene_biotype, transcript_version::INT AS transcript_version FROM gtf", extra=GTF))
def _(spark, d):
    return parse.parse_gtf(T.gtf_lines(spark, d)).drop("source")


@query(
    "a26_latest_transcript",
    sql(
        """SELECT n.chromo, n.gene_name AS name, numexons, exonsize, coalesce(stop - start, 0) AS size, coalesce(start, 0) AS start, coalesce(stop, 0) AS stop,
             coalesce(sense::INT, 0) AS strand FROM (SELECT chromo, gene_name, count(*) AS numexons, sum(stop - start)::BIGINT AS exonsize FROM newest GROUP BY ALL) n
           LEFT JOIN (SELECT * FROM gtf WHERE type = 'gene' AND gene_biotype = 'protein_coding') g USING (gene_name)""",
        extra=GTF,
    ),
)
def _(spark, d):
    return A.latest_transcripts(parse.parse_gtf(T.gtf_lines(spark, d)))


@query(
    "s29_exons_csv",
    sql(
        """SELECT concat_ws(' ', chromo, gene_name, start, stop, CASE WHEN sense THEN 1 ELSE 0 END) AS value FROM newest""",
        extra=GTF,
    ),
)
def _(spark, d):
    e = A.newest_exons(parse.parse_gtf(T.gtf_lines(spark, d)))
    return e.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in e.columns]).alias("value"))


@query(
    "s29_genes_csv",
    sql(
        """SELECT concat_ws(' ', n.chromo, n.gene_name, numexons, exonsize, coalesce(stop - start, 0), coalesce(start, 0), coalesce(stop, 0), coalesce(sense::INT, 0)) AS value
           FROM (SELECT chromo, gene_name, count(*) AS numexons, sum(stop - start)::BIGINT AS exonsize FROM newest GROUP BY ALL) n
           LEFT JOIN (SELECT * FROM gtf WHERE type = 'gene' AND gene_biotype = 'protein_coding') g USING (gene_name)""",
        extra=GTF,
    ),
)
def _(spark, d):
    return A.latest_transcripts(parse.parse_gtf(T.gtf_lines(spark, d))).select(F.concat_ws(" ", "chromo", "name", "numexons", "exonsize", "size", "start", "stop", "strand").alias("value"))


CHANGES = FEATURES | {
    "lg": """SELECT l.*, start, stop, strand, CASE WHEN strand THEN l.pos - start ELSE stop - l.pos END AS at_ FROM loci l
        JOIN ann ON ann.ref = l.ref AND l.pos BETWEEN start AND stop AND ann.gene""",
    "seen": """SELECT *, at_ // 3 + 1 AS residue, at_ % 3 AS off, unnest(list_filter(['A', 'C', 'G', 'T'], lambda x: (x = 'A' AND a > 0) OR (x = 'C' AND c > 0)
          OR (x = 'G' AND g > 0) OR (x = 'T' AND t > 0) OR (x = orig AND depth > 0))) AS base FROM lg""",
    "codons": f"""SELECT s.*, CASE WHEN residue * 3 < stop - start + 1 THEN
          CASE WHEN strand THEN substr(ext, ((p - 1) % 32 + 1)::INT, 3) ELSE {rc('substr(ext, ((p - 1) % 32 + 1)::INT, 3)')} END ELSE 'XXX' END AS codon
        FROM (SELECT *, CASE WHEN strand THEN start + (residue - 1) * 3 ELSE greatest(stop - (residue - 1) * 3 - 2, 1) END AS p FROM seen) s
        JOIN ext ON ext.ref = s.ref AND ext.chunk = (p - 1) // 32""",
    "changes": """SELECT *, substr(codon, 1, off::INT) || CASE WHEN strand THEN base ELSE translate(base, 'ACGT', 'TGCA') END || substr(codon, off::INT + 2) AS new_codon FROM codons""",
}


def _changes(spark, d):
    hits = A.stab(_loci(spark, d), ann(spark, d).where("gene").select("ref", "start", "stop", "strand"))
    return loci.amino_changes(hits, S.reference_ext(spark, d), T.CHUNK)


@query(
    "v25_amino_change",
    sql(
        f"""SELECT ref, pos, start, stop, strand, residue, off::INT AS "offset", base, codon, new_codon, {amino_name('(' + amino('codon') + ')')} AS amino,
              {amino_name('(' + amino('new_codon') + ')')} AS new_amino FROM changes WHERE codon <> new_codon""",
        "loci", "ext", extra=CHANGES,
    ),
)
def _(spark, d):
    return _changes(spark, d).select(
        "ref", "pos", "start", "stop", "strand", "residue", "offset", "base", "codon", "new_codon", "amino", "new_amino"
    )


@query(
    "v25_amino_report",
    sql(
        f"""SELECT ref, pos, start, stop, strand, 'R' || residue || '/' || (stop - start + 1) // 3 || ' ' || string_agg(line, '; ' ORDER BY line) AS amino_report
            FROM (SELECT DISTINCT *, base || ': ' || codon || ' -> ' || new_codon || ', ' || {amino_name('(' + amino('codon') + ')')} || ' -> ' || {amino_name('(' + amino('new_codon') + ')')} AS line
              FROM (SELECT DISTINCT ref, pos, start, stop, strand, residue, base, codon, new_codon FROM changes WHERE codon <> new_codon)) GROUP BY ref, pos, start, stop, strand, residue""",
        "loci", "ext", extra=CHANGES,
    ),
)
def _(spark, d):
    c = _changes(spark, d).dropDuplicates(["ref", "pos", "start", "stop", "strand", "base"])
    return loci.amino_text(c, "ref", "pos", "start", "stop", "strand").select("ref", "pos", "start", "stop", "strand", "amino_report")


@query(
    "v05_codon_usage",
    sql(
        f"""SELECT codon, {amino('codon')} AS amino, {amino_name('(' + amino('codon') + ')')} AS name, count(*) AS n FROM (
              SELECT substr(ext, (i + 1)::INT, 3) AS codon FROM ext, (SELECT unnest(generate_series(0, 31)) AS i) WHERE length(ext) >= i + 3) GROUP BY codon""",
        "ext",
    ),
)
def _(spark, d):
    from helicase.operators.kmers import windows

    u = windows(S.reference_ext(spark, d), T.CHUNK, [3]).groupBy(F.col("kmer").alias("codon")).agg(F.count("*").alias("n"))
    a = dna.amino_acid("codon")
    return u.select("codon", a.alias("amino"), dna.amino_name(a).alias("name"), "n")


ANNOTATED = CHANGES | {
    "inserted": """SELECT ref, pos, string_agg(inserted || ': ' || n, ', ' ORDER BY inserted) AS insert_report
        FROM (SELECT ref, pos, inserted, count(*) AS n FROM diffs WHERE inserted IS NOT NULL GROUP BY ALL) GROUP BY ref, pos""",
    "told": "SELECT l.ref, l.pos, string_agg(id || chr(9) || '[' || tag || ']' || chr(9), '' ORDER BY start, stop, id) AS annotation FROM loci l JOIN ann ON ann.ref = l.ref AND l.pos BETWEEN start AND stop GROUP BY l.ref, l.pos",
    "acids": f"SELECT DISTINCT ref, pos, start, stop, strand, residue, base, codon, new_codon, {amino('codon')} AS x, {amino('new_codon')} AS y FROM changes WHERE codon <> new_codon",
    "spoken": f"""SELECT ref, pos, string_agg(report, ' ' ORDER BY start, stop, strand) AS amino FROM (
        SELECT ref, pos, start, stop, strand, 'R' || residue || '/' || (stop - start + 1) // 3 || ' ' || string_agg(line, '; ' ORDER BY line) AS report
        FROM (SELECT *, base || ': ' || codon || ' -> ' || new_codon || ', ' || {amino_name('x')} || ' -> ' || {amino_name('y')} AS line FROM acids) GROUP BY ref, pos, start, stop, strand, residue) GROUP BY ref, pos""",
}


@query(
    "s26_annotated_loci_tsv",
    sql(
        """SELECT concat_ws(chr(9), ref, pos, num_diff, depth, a, aq, c, cq, g, gq, t, tq, dels, tot_q, printf('%.4f', round(frac_head, 4)), coalesce(insert_report, ''),
             '#' || coalesce(annotation, ''), coalesce(amino, '')) AS value
           FROM loci LEFT JOIN inserted USING (ref, pos) LEFT JOIN told USING (ref, pos) LEFT JOIN spoken USING (ref, pos)""",
        "loci", "diffs", "ext", extra=ANNOTATED,
    ),
)
def _(spark, d):
    m = S.mapping(spark, d)
    rows = loci.loci(m.differences, m.coverage, S.reference_ext(spark, d), T.CHUNK)
    return loci.loci_tsv(loci.annotated(rows, ann(spark, d), S.reference_ext(spark, d), T.CHUNK))


def _genbank_feature():
    """GenBank text of a supplier as a feature."""
    k = F.col("s_suppkey")
    n = lambda x: (k * 100 + x).cast("string")
    loc = F.when(
        k % 4 == 2, F.concat(F.lit("join("), n(1), F.lit(".."), n(50), F.lit(",\n                     <"), n(61), F.lit("..>"), n(90), F.lit(")"))
    ).otherwise(F.concat(n(1), F.lit(".."), n(50)))
    loc = F.when(k % 2 == 1, F.concat(F.lit("complement("), loc, F.lit(")"))).otherwise(loc)
    kind = F.when(k % 3 == 0, "CDS").when(k % 3 == 1, "gene").otherwise("tRNA")
    pad = F.lit("\n                     /")
    return F.concat(
        F.lit("     "), F.rpad(kind, 16, " "), loc, pad, F.lit('product="'), "s_name", F.lit('"'), pad, F.lit("transl_table=11"),
        pad, F.lit('translation="MKV\n                     LLA"'),
    )


@query(
    "s12_genbank",
    sql(
        """SELECT 'REC' || s_nationkey AS chromosome, CASE WHEN s_suppkey % 3 = 0 THEN 'CDS' WHEN s_suppkey % 3 = 1 THEN 'gene' ELSE 'tRNA' END AS type,
             s_suppkey * 100 + 1 + CASE WHEN s_suppkey % 4 = 2 THEN 60 ELSE 0 END AS start, s_suppkey * 100 + 50 + CASE WHEN s_suppkey % 4 = 2 THEN 40 ELSE 0 END AS stop,
             s_suppkey % 2 = 0 AS strand, s_name || ', 11, ' AS tag, s_suppkey % 3 <> 2 AS gene FROM supplier""",
    ),
)
def _(spark, d):
    feature = _genbank_feature()
    recs = (
        T.table(spark, d, "supplier")
        .groupBy("s_nationkey")
        .agg(F.array_join(F.array_sort(F.collect_list(feature)), "\n").alias("body"))
        .select(
            F.concat(
                F.lit("LOCUS       REC"), F.col("s_nationkey").cast("string"),
                F.lit("  900 bp\nFEATURES             Location/Qualifiers\n     source          1..900\n"), "body", F.lit("\nORIGIN\n        1 acgt\n"),
            ).alias("value")
        )
    )
    return parse.parse_genbank(recs)


@query(
    "s13_genbank_file",
    SQL["s12_genbank"].replace("'REC' || s_nationkey", "'REC' || s_suppkey"),
)
def _(spark, d):
    # a record of many lines for each supplier, its sequence included, in files that are split like any text
    key = F.col("s_suppkey").cast("string")
    sequence = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("        "), i.cast("string"), F.lit(" acgtacgtac gtacgtacgt"))), "\n")
    head = F.lit("  900 bp\nFEATURES             Location/Qualifiers\n     source          1..900\n                     /organism=\"x\"\n")
    record = F.concat(F.lit("LOCUS       REC"), key, head, _genbank_feature(), F.lit("\nORIGIN\n"), sequence, F.lit("\n//"))
    path = shared_path(spark, "genbank")
    T.table(spark, d, "supplier").select(record.alias("value")).write.text(path)
    return parse.read_genbank(spark, path)
