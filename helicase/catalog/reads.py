"""Quality-control queries over the read pairs and the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from helicase.catalog.base import gc, rc, sql
from helicase.functions import dna
from helicase.operators import pairing, qc
from helicase.plans import stages as S
from helicase.sources import genome, tables as T

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


ERR = "pow(10, -q / 10)"
STATS = f"count(*) AS n, avg({ERR}) AS m, greatest(avg({ERR} * {ERR}) - avg({ERR}) * avg({ERR}), 0) AS v"
PHRED = "round(-10 * log10(m), 6) AS quality, round(-10 * log10(m) - sqrt(-10 * log10(v)), 5) AS lo, round(-10 * log10(m) + sqrt(-10 * log10(v)), 5) AS hi"


@query("a02_quality_by_pos", sql(f"SELECT i, n, {PHRED} FROM (SELECT i, {STATS} FROM read_bases GROUP BY i)", "read_bases"))
def _(spark, d):
    q = qc.quality_by_position(S.reads(spark, d))
    return rounded(rounded(q, "quality"), "lo", "hi", digits=5).withColumn("i", F.col("i").cast("long"))


@query("a01_mean_variance", sql(f"SELECT n, {PHRED} FROM (SELECT {STATS} FROM read_bases)", "read_bases"))
def _(spark, d):
    q = qc.quality_overall(S.reads(spark, d))
    return rounded(rounded(q, "quality"), "lo", "hi", digits=5)


@query("a03_qhisto", sql("SELECT q, round(count(*) / (SELECT count(*) FROM read_bases), 9) AS share FROM read_bases WHERE q < 50 GROUP BY q", "read_bases"))
def _(spark, d):
    return rounded(qc.quality_histogram(S.reads(spark, d)), "share", digits=9)


@query("a04_read_lengths", sql("SELECT length(nucs)::INT AS length, count(*) AS n FROM reads GROUP BY length(nucs)", "reads"))
def _(spark, d):
    return qc.read_lengths(S.reads(spark, d))


@query("a05_gc_hist", sql(f"SELECT round(length(nucs) * ({gc('nucs')}))::INT AS gc_bases, count(*) AS n FROM kept GROUP BY 1", "kept"))
def _(spark, d):
    return qc.gc_histogram(S.mapping(spark, d).kept)


@query(
    "a06_ref_gc",
    sql(
        f"""SELECT ref, round(72 * ({gc('w')}))::INT AS gc_bases, count(*) // 4 AS n FROM (
              SELECT ref, left(ext, 71) AS w FROM ext WHERE chunk = 0 UNION ALL
              SELECT ref, substr(ext, (i + 1)::INT, 72) FROM ext, (SELECT unnest(generate_series(0, 31)) AS i) WHERE (chunk * 32 + i + 1) % 18 = 0)
            GROUP BY ref, 2""",
        "ext",
    ),
)
def _(spark, d):
    return qc.reference_gc_histogram(S.reference_ext(spark, d), T.CHUNK, 72)


@query(
    "a07_gc_by_pos",
    sql("SELECT i, round(count_if(base IN ('G', 'C')) / (0.001 + count(*)), 6) AS ratio FROM read_bases GROUP BY i", "read_bases"),
)
def _(spark, d):
    g = qc.gc_by_position(S.reads(spark, d))
    return rounded(g, "ratio").withColumn("i", F.col("i").cast("long"))


FOURMERS = """SELECT i, kmer, count(*) AS c FROM (SELECT i, translate(substr(nucs, (i + 1)::INT, 4), 'N', 'A') AS kmer FROM (
    SELECT nucs, unnest(generate_series(0, length(nucs) - 5)) AS i FROM reads WHERE length(nucs) > 4)) GROUP BY i, kmer"""


@query(
    "a08_kmer_cv",
    sql("SELECT i, round(sqrt(sum(c * c) / 256 - pow(sum(c) / 256, 2)) / (sum(c) / 256), 6) AS spread FROM fourmers GROUP BY i", "reads", extra={"fourmers": FOURMERS}),
)
def _(spark, d):
    k = qc.kmer_spread(S.reads(spark, d))
    return rounded(k, "spread").withColumn("i", F.col("i").cast("long"))


MULT = """SELECT c AS multiplicity, sum(c)::BIGINT AS n FROM (SELECT count(*) AS c FROM {t} GROUP BY {k}) GROUP BY 1"""


@query(
    "a09_duplicates",
    sql(
        f"SELECT multiplicity, n, round(n / (SELECT count(*) FROM reads), 9) AS share FROM ({MULT.format(t='reads', k='nucs')})", "reads"
    ),
)
def _(spark, d):
    return rounded(qc.duplicate_histogram(S.reads(spark, d)), "share", digits=9)


@query(
    "a09_document_copies",
    f"SELECT multiplicity, n, round(n / (SELECT count(*) FROM documents), 9) AS share FROM ({MULT.format(t='documents', k='text')})",
)
def _(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("text").alias("nucs"))
    return rounded(qc.duplicate_histogram(docs), "share", digits=9)


@query("w01_duplimit", sql("SELECT pair_id, mate, nucs FROM (SELECT *, row_number() OVER (PARTITION BY nucs ORDER BY pair_id, mate) AS rn FROM reads) WHERE rn <= 4", "reads"))
def _(spark, d):
    return pairing.limit_duplicates(S.reads(spark, d), 4).select("pair_id", "mate", "nucs")


RATIOS = """SELECT i, count_if(base IN ('G', 'C')) / (0.001 + count(*)) AS ratio FROM read_bases GROUP BY i"""


@query(
    "w04_begin_trim",
    sql(
        """SELECT min(i) + 1 AS begin_trim FROM (
             SELECT i, max(z) OVER w AS worst, count(*) OVER w AS n FROM (
               SELECT i, abs((ratio - (SELECT avg(ratio) FROM ratios WHERE i > 0.1 * top AND i < 0.9 * top))
                 / (SELECT stddev_pop(ratio) FROM ratios WHERE i > 0.1 * top AND i < 0.9 * top)) AS z
               FROM ratios, (SELECT max(i) + 1 AS top FROM ratios) t) WINDOW w AS (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
           WHERE n = 10 AND worst <= 5""",
        "read_bases",
        extra={"ratios0": RATIOS, "ratios": "SELECT *, (SELECT max(i) + 1 FROM ratios0) AS top FROM ratios0"},
    ).replace("FROM ratios, (SELECT max(i) + 1 AS top FROM ratios) t)", "FROM ratios)"),
)
def _(spark, d):
    t = qc.begin_trim(qc.gc_by_position(S.reads(spark, d)))
    return t.select(F.col("begin_trim").cast("long").alias("begin_trim"))


@query(
    "w06_index_lengths",
    sql(
        """SELECT length::INT AS length, n, round((before + n) / total, 9) AS covered FROM (
             SELECT length, n, coalesce(sum(n) OVER (ORDER BY n DESC, length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               row_number() OVER (ORDER BY n DESC, length DESC) AS rn, sum(n) OVER () AS total
             FROM (SELECT length(nucs) AS length, count(*) AS n FROM reads GROUP BY 1)) WHERE rn <= 3 AND before <= 0.99 * total""",
        "reads",
    ),
)
def _(spark, d):
    return rounded(qc.index_lengths(qc.read_lengths(S.reads(spark, d))), "covered", digits=9)


@query(
    "a21_base_totals",
    sql(
        """SELECT ref, count_if(base = 'A') AS a_count, count_if(base = 'C') AS c_count, count_if(base = 'G') AS g_count, count_if(base = 'T') AS t_count,
             round(count_if(base IN ('C', 'G')) / count(*), 9) AS gc_ratio FROM genome GROUP BY ref""",
        "genome",
    ),
)
def _(spark, d):
    return rounded(genome.base_totals(S.reference(spark, d)), "gc_ratio", digits=9)


@query(
    "v27_poisson_limit",
    sql(
        """SELECT min(k) AS duplimit FROM (SELECT k, sum(p) OVER (ORDER BY k) AS cdf FROM (
             SELECT k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (
               SELECT (SELECT count(*) FROM reads) / (SELECT sum(len) FROM chroms) AS rate), (SELECT unnest(generate_series(0, 1000)) AS k)))
           WHERE cdf >= 0.999""",
        "reads", "chroms",
    ),
)
def _(spark, d):
    return qc.duplicate_limit(S.reads(spark, d), S.reference(spark, d))


@query(
    "w09_chromosome_offsets",
    sql("SELECT ref, len, (sum(len) OVER (ORDER BY ref) - len)::BIGINT AS offset_ FROM chroms", "chroms").replace("offset_", '"offset"'),
)
def _(spark, d):
    return genome.with_offsets(genome.chromosomes(S.reference(spark, d)))


@query(
    "p18_catalogue",
    sql("SELECT count(*) AS chromosomes, sum(len)::BIGINT AS nucleotides FROM chroms", "chroms"),
)
def _(spark, d):
    c = genome.chromosomes(S.reference(spark, d))
    return c.agg(F.count("*").alias("chromosomes"), F.sum("len").alias("nucleotides"))


@query("p01_reads_without_n", sql("SELECT pair_id, mate, nucs FROM reads WHERE NOT contains(nucs, 'N')", "reads"))
def _(spark, d):
    return S.reads(spark, d).where(~F.contains("nucs", F.lit("N"))).select("pair_id", "mate", "nucs")


@query(
    "p02_exceeds_quality",
    sql("SELECT pair_id, mate, min(q) AS worst FROM read_bases GROUP BY pair_id, mate HAVING min(q) >= 5", "read_bases"),
)
def _(spark, d):
    r = S.reads(spark, d).where((F.length("qual") > 0) & dna.exceeds_quality("qual", 5))
    return r.select("pair_id", "mate", F.array_min(dna.qualities("qual")).alias("worst"))


@query("p03_confident_bases", sql("SELECT base, count(*) AS n FROM read_bases WHERE q > 30 GROUP BY base", "read_bases"))
def _(spark, d):
    return qc.per_base(S.reads(spark, d)).where("q > 30").groupBy("base").agg(F.count("*").alias("n"))


@query("s01_trimmed_reads", sql("SELECT pair_id, mate, CASE WHEN length(nucs) > 8 THEN substr(nucs, 6, length(nucs) - 8) ELSE nucs END AS nucs, CASE WHEN length(nucs) > 8 THEN substr(qual, 6, length(nucs) - 8) ELSE qual END AS qual FROM reads", "reads"))
def _(spark, d):
    return qc.trim(S.reads(spark, d), 5, 3).select("pair_id", "mate", "nucs", "qual")
