"""Mapping, pairing, coverage and loci queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helicase.catalog.base import rc, sql
from helicase.functions import dna, edit
from helicase.operators import clusters, coverage, kmers, loci, pairing, picture, pileup, seeds
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


def long(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


@query(
    "j01_kmer_index",
    sql("SELECT ref, k::INT AS k, count(*) AS n, count(DISTINCT kmer) AS kinds, sum(pos)::BIGINT AS pos_sum FROM kmers GROUP BY ref, k", "kmers"),
)
def _(spark, d):
    return (
        kmers.windows(S.reference_ext(spark, d), T.CHUNK, T.READ_LENGTHS)
        .groupBy("ref", "k")
        .agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("kinds"), F.sum("pos").alias("pos_sum"))
    )


@query("j02_exact_map", sql("SELECT pair_id, mate, ref, pos, reverse FROM exact", "exact"))
def _(spark, d):
    r = S.mapping(spark, d).kept
    return kmers.exact_matches(r, S.reference_ext(spark, d), T.CHUNK, T.READ_LENGTHS).select("pair_id", "mate", "ref", "pos", "reverse")


@query(
    "j03_both_orientations",
    sql("SELECT length(nucs)::INT AS length, reverse, count(*) AS n, count(DISTINCT (pair_id, mate)) AS reads FROM exact JOIN kept USING (pair_id, mate) GROUP BY ALL", "exact", "kept"),
)
def _(spark, d):
    r = S.mapping(spark, d).kept
    m = kmers.exact_matches(r, S.reference_ext(spark, d), T.CHUNK, T.READ_LENGTHS)
    return m.groupBy(F.length("nucs").alias("length"), "reverse").agg(
        F.count("*").alias("n"), F.countDistinct("pair_id", "mate").alias("reads")
    )


@query("j04_seed_triplets", sql("SELECT nucs, ref, pos, reverse FROM starts", "starts"))
def _(spark, d):
    m = S.mapping(spark, d)
    rest = m.kept.join(m.exact.select("pair_id", "mate"), ["pair_id", "mate"], "left_anti")
    return seeds.pair_starts(rest.select("nucs").distinct(), S.reference_ext(spark, d), T.CHUNK)


@query("v13_diff_score", sql("SELECT pair_id, mate, ref, pos, reverse, score FROM fuzzy", "fuzzy"))
def _(spark, d):
    return S.mapping(spark, d).fuzzy


@query("j07_pairs", sql("SELECT pair_id, ref, pos1, reverse1, score1, pos2, reverse2, score2 FROM pairs", "pairs"))
def _(spark, d):
    return S.mapping(spark, d).pairs


@query("j08_best_pair", sql("SELECT pair_id, ref, pos1, reverse1, pos2, reverse2, score FROM best", "best"))
def _(spark, d):
    return S.mapping(spark, d).best_pairs.select("pair_id", "ref", "pos1", "reverse1", "pos2", "reverse2", "score")


@query("j09_best_single", sql("SELECT pair_id, mate, ref, pos, reverse, score FROM singles", "singles"))
def _(spark, d):
    m = S.mapping(spark, d)
    return m.placed.where("not paired").select("pair_id", "mate", "ref", "pos", "reverse", "score")


@query("j10_unfound", sql("SELECT pair_id, mate, nucs FROM unfound", "unfound"))
def _(spark, d):
    return S.mapping(spark, d).unfound.select("pair_id", "mate", "nucs")


@query(
    "a19_pair_distance",
    sql(
        """SELECT distance, count(*) AS n FROM (SELECT length(nucs) + CASE WHEN reverse2 THEN pos2 - pos1 ELSE pos1 - pos2 END AS distance
           FROM best JOIN kept USING (pair_id) WHERE mate = 1) GROUP BY distance""",
        "best", "kept",
    ),
)
def _(spark, d):
    m = S.mapping(spark, d)
    return pairing.distance_histogram(pairing.pair_distances(m.best_pairs, m.kept))


@query(
    "a20_run_counters",
    sql(
        """SELECT (SELECT count(*) FROM reads) AS total, (SELECT count(*) FROM reads) - (SELECT count(*) FROM kept) AS too_frequent,
             (SELECT count(*) FROM kept WHERE contains(nucs, 'N')) AS with_n, (SELECT count(*) FROM placed) AS found,
             (SELECT count(*) FROM placed WHERE paired) AS in_good_pairs, (SELECT count(*) FROM unfound) AS unfound""",
        "reads", "kept", "placed", "unfound",
    ),
)
def _(spark, d):
    m = S.mapping(spark, d)
    # Every branch is a one-row aggregate; the union is folded into one row.
    def one(df, **named):
        names = ["total", "too_frequent", "with_n", "found", "in_good_pairs", "unfound"]
        return df.agg(*[(named[n] if n in named else F.lit(0)).cast("long").alias(n) for n in names])

    n = F.count("*")
    kept = one(m.kept, too_frequent=-n, with_n=F.count_if(F.contains("nucs", F.lit("N"))))
    parts = [
        one(m.reads, total=n, too_frequent=n),
        kept,
        one(m.placed, found=n, in_good_pairs=F.count_if("paired")),
        one(m.unfound, unfound=n),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.sum(c).alias(c) for c in u.columns])


@query("v14_map_to_reference", sql("SELECT pair_id, mate, ok FROM points", "points"))
def _(spark, d):
    return S.mapping(spark, d).aligned.where(F.least(F.length("nucs"), F.length("ref_bases")) > 0).select("pair_id", "mate", "ok")


@query("a10_coverage", sql("SELECT ref, pos, depth FROM cov", "cov"))
def _(spark, d):
    return S.mapping(spark, d).coverage


@query(
    "a11_depth",
    sql(
        """SELECT ref, round(sum(depth) / (len + 1), 6) AS mean_depth,
             round(sqrt(greatest(sum(depth * depth) / (len + 1) - pow(sum(depth) / (len + 1), 2), 0)), 6) AS sd_depth,
             1 + count_if(depth < 5) AS undercovered, round((1 + count_if(depth < 5)) * 100.0 / (len + 1), 6) AS undercovered_pct
           FROM dense JOIN chroms USING (ref) GROUP BY ref, len""",
        "dense", "chroms",
    ),
)
def _(spark, d):
    s = coverage.depth_summary(S.mapping(spark, d).depth_runs, S.reference(spark, d))
    return s.select(
        "ref", F.round("mean_depth", 6).alias("mean_depth"), F.round("sd_depth", 6).alias("sd_depth"),
        "undercovered", F.round("undercovered_pct", 6).alias("undercovered_pct"),
    )


@query(
    "a12_depth_hist",
    sql(
        """SELECT ref, depth, round(n / (len + 1), 9) AS share, round(sum(n) OVER (PARTITION BY ref ORDER BY depth) / (len + 1), 9) AS running FROM (
             SELECT ref, depth, count(*) + CASE WHEN depth = 0 THEN 1 ELSE 0 END AS n FROM dense GROUP BY ref, depth) JOIN chroms USING (ref)""",
        "dense", "chroms",
    ),
)
def _(spark, d):
    h = coverage.depth_histogram(S.mapping(spark, d).depth_runs, S.reference(spark, d))
    return h.select("ref", "depth", F.round("share", 9).alias("share"), F.round("running", 9).alias("running"))


@query(
    "a13_gc_cov",
    sql(
        """SELECT round(gc / 40, 6) AS gc, round(avg(depth), 6) AS depth, round(stddev_pop(depth), 6) AS sd FROM (
             SELECT length(w) - length(translate(w, 'CG', '')) AS gc, coalesce(depth, 0) AS depth
             FROM (SELECT ref, chunk * 32 + i + 21 AS pos, substr(ext, (i + 1)::INT, 40) AS w FROM ext, (SELECT unnest(generate_series(0, 31)) AS i)
                   WHERE length(ext) >= i + 40) LEFT JOIN cov USING (ref, pos)) GROUP BY gc""",
        "ext", "cov",
    ),
)
def _(spark, d):
    g = coverage.depth_by_gc(S.mapping(spark, d).depth_runs, S.reference_ext(spark, d), T.CHUNK)
    return g.select(F.round("gc", 6).alias("gc"), F.round("depth", 6).alias("depth"), F.round("sd", 6).alias("sd"))


@query(
    "s27_gc_coverage_tsv",
    sql(
        """SELECT printf('%.4f', gc / 40) || chr(9) || printf('%.4f', round(avg(depth)::DECIMAL(38, 12), 4)::DOUBLE) || chr(9) || printf('%.4f', round(stddev_pop(depth)::DECIMAL(38, 12), 4)::DOUBLE) AS value FROM (
             SELECT length(w) - length(translate(w, 'CG', '')) AS gc, coalesce(depth, 0) AS depth
             FROM (SELECT ref, chunk * 32 + i + 21 AS pos, substr(ext, (i + 1)::INT, 40) AS w FROM ext, (SELECT unnest(generate_series(0, 31)) AS i)
                   WHERE length(ext) >= i + 40) LEFT JOIN cov USING (ref, pos)) GROUP BY gc""",
        "ext", "cov",
    ),
)
def _(spark, d):
    g = coverage.depth_by_gc(S.mapping(spark, d).depth_runs, S.reference_ext(spark, d), T.CHUNK)
    # one rounding, of decimals, so that halves go the same way everywhere
    four = lambda c: F.round(F.col(c).cast("decimal(38,12)"), 4).cast("double")
    return g.select(F.format_string("%.4f\t%.4f\t%.4f", "gc", four("depth"), four("sd")).alias("value"))


LOW = {
    "runs": """SELECT ref, min(pos) AS pos, max(pos) + 1 AS stop FROM (
        SELECT ref, pos, pos - row_number() OVER (PARTITION BY ref ORDER BY pos) AS grp FROM dense WHERE depth < 5) GROUP BY ref, grp""",
    "low": "SELECT ref, pos, stop FROM runs JOIN chroms USING (ref) WHERE pos > 40 AND stop + 40 <= len",
}


@query(
    "w03_low_cov_regions",
    sql(
        """SELECT low.ref, low.pos, low.stop, piece."at", piece.bases, (SELECT string_agg(base, '' ORDER BY g.pos) FROM genome g WHERE g.ref = low.ref AND g.pos BETWEEN low.pos - 40 AND low.pos - 1) AS left_flank,
             (SELECT string_agg(base, '' ORDER BY g.pos) FROM genome g WHERE g.ref = low.ref AND g.pos BETWEEN low.stop AND low.stop + 39) AS right_flank
           FROM low JOIN (SELECT l.ref, l.pos, min(g.pos) AS "at", string_agg(base, '' ORDER BY g.pos) AS bases FROM low l
             JOIN genome g ON g.ref = l.ref AND g.pos >= l.pos AND g.pos < l.stop GROUP BY l.ref, l.pos, (g.pos - 1) // 32) piece ON piece.ref = low.ref AND piece.pos = low.pos""",
        "dense", "chroms", "genome", extra=LOW,
    ),
)
def _(spark, d):
    m = S.mapping(spark, d)
    low = coverage.low_regions(m.dense, m.chunks)
    flanked = coverage.with_flanks(low, S.reference_ext(spark, d), T.CHUNK)
    return coverage.region_pieces(flanked, m.chunks, T.CHUNK).select("ref", "pos", "stop", "at", "left_flank", "right_flank", "bases")


@query(
    "w02_clusters",
    sql(
        """SELECT ref, min(pos) AS first, max(pos) AS last, (min(pos) + max(pos)) // 2 AS middle, count(*) AS members FROM (
             SELECT ref, pos, sum(new) OVER (PARTITION BY ref ORDER BY pos) AS cl FROM (
               SELECT ref, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY ref ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS new FROM low))
           GROUP BY ref, cl""",
        "dense", "chroms", extra=LOW,
    ),
)
def _(spark, d):
    m = S.mapping(spark, d)
    c = clusters.cluster_ids(coverage.low_regions(m.dense, m.chunks).select("ref", "pos"), 100)
    return clusters.cluster_ranges(c).select("ref", "first", "last", "middle", "members")


@query(
    "w02_event_clusters",
    """SELECT user_id, min(s) AS first, max(s) AS last, count(*) AS members FROM (
         SELECT user_id, s, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS cl FROM (
           SELECT user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 3600 THEN 0 ELSE 1 END AS new
           FROM (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS s FROM events))) GROUP BY user_id, cl""",
)
def _(spark, d):
    e = T.table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).distinct()
    c = clusters.cluster_ids(e, 3600, key="user_id", pos="s", bin_size=1 << 22)
    return clusters.cluster_ranges(c, "user_id", "s").select("user_id", "first", "last", "members")


@query("a14_differences", sql("SELECT ref, pos, base, q, head, count(*) AS n FROM diffs GROUP BY ALL", "diffs"))
def _(spark, d):
    return S.mapping(spark, d).differences.groupBy("ref", "pos", "base", "q", "head").agg(F.count("*").alias("n"))


def _loci(spark, d):
    m = S.mapping(spark, d)
    return loci.loci(m.differences, m.coverage, S.reference_ext(spark, d), T.CHUNK, with_inserts=False)


LOCUS_COLS = "ref, pos, num_diff, depth, orig, a, aq, c, cq, g, gq, t, tq, dels, tot_q, summary"


@query("a15_loci", sql(f"SELECT {LOCUS_COLS}, round(frac_head, 6) AS frac_head FROM loci", "loci"))
def _(spark, d):
    return _loci(spark, d).select(*LOCUS_COLS.split(", "), F.round("frac_head", 6).alias("frac_head"))


VARIABILITY = {
    "votes": """SELECT ref, pos, base, sum(v) AS v FROM (SELECT ref, pos, base, 1 AS v FROM diffs
        UNION ALL SELECT ref, pos, orig, depth FROM loci) GROUP BY ref, pos, base""",
    "varied": """SELECT l.ref, l.pos, CASE WHEN total < 20 OR frac_head < 0.05 OR frac_head > 0.95 THEN 0
          ELSE (100 * (total - top)) // total END::BIGINT AS variability
        FROM loci l JOIN (SELECT ref, pos, sum(v)::BIGINT AS total, max(v)::BIGINT AS top FROM votes GROUP BY ref, pos) t USING (ref, pos)""",
}


@query("a23_variability", sql("SELECT ref, pos, variability FROM varied", "loci", "diffs", extra=VARIABILITY))
def _(spark, d):
    return loci.variability(_loci(spark, d), S.mapping(spark, d).differences).select("ref", "pos", "variability")


REGIONS = VARIABILITY | {
    "vc": """SELECT *, sum(new) OVER (PARTITION BY ref ORDER BY pos) AS cluster FROM (
        SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY ref ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS new FROM varied)""",
    "reg": """SELECT ref, cluster, CASE WHEN lo > 100 THEN lo - 100 ELSE 1 END AS start, least(hi + 100, len + 1) AS stop, loci, max_variability
        FROM (SELECT ref, cluster, min(pos) AS lo, max(pos) AS hi, count(*) AS loci, max(variability) AS max_variability FROM vc GROUP BY ref, cluster)
        JOIN chroms USING (ref)""",
}


def _regions(spark, d):
    m = S.mapping(spark, d)
    return loci.regions(loci.variability(_loci(spark, d), m.differences), m.chunks)


@query(
    "i03_regions",
    sql("SELECT ref, start, stop, (start + stop) // 2 AS pos, loci, max_variability FROM reg", "loci", "diffs", "chroms", extra=REGIONS),
)
def _(spark, d):
    return _regions(spark, d).select("ref", "start", "stop", "pos", "loci", "max_variability")


@query(
    "i03_region_depth",
    sql(
        """SELECT ref, start, pos, coalesce(depth, 0) AS depth FROM spots LEFT JOIN cov USING (ref, pos)""",
        "loci", "diffs", "chroms", "cov", extra=REGIONS | {"spots": "SELECT ref, start, unnest(generate_series(start, stop - 1)) AS pos FROM reg"},
    ),
)
def _(spark, d):
    r = _regions(spark, d)
    return loci.region_depths(r.withColumn("cluster", F.col("start")), S.mapping(spark, d).depth_runs).select(
        "ref", F.col("cluster").alias("start"), "pos", "depth"
    )


WEIGHTS = ", ".join(f"round(coalesce(sum(q) FILTER (base = '{b}'), 0) / 30.0, 6) AS {b.lower()}_prob" for b in "ACGTX")


@query(
    "i03_region_weights",
    sql(
        f"""SELECT r.ref, r.start, p AS pos, a_prob, c_prob, g_prob, t_prob, x_prob FROM (SELECT ref, start, unnest(generate_series(start, stop - 1)) AS p FROM reg) r
            JOIN (SELECT ref, pos, {WEIGHTS} FROM diffs GROUP BY ref, pos) w ON w.ref = r.ref AND w.pos = r.p""",
        "loci", "diffs", "chroms", extra=REGIONS,
    ),
)
def _(spark, d):
    r = _regions(spark, d).withColumn("cluster", F.col("start"))
    w = loci.region_weights(r, S.mapping(spark, d).differences)
    return w.select("ref", F.col("cluster").alias("start"), "pos", *[F.round(c, 6).alias(c) for c in w.columns if c.endswith("_prob")])


@query(
    "s09_control_counts",
    sql("SELECT ref, ref = 'chr1' AS control, count(*) AS reads, count_if(paired) AS paired FROM placed GROUP BY ref", "placed"),
)
def _(spark, d):
    return S.mapping(spark, d).control_counts(["chr1"])


@query(
    "s09_sample_reads",
    sql("SELECT pair_id, mate, nucs FROM reads ANTI JOIN (SELECT * FROM placed WHERE ref = 'chr1') USING (pair_id, mate)", "placed", "reads"),
)
def _(spark, d):
    return S.mapping(spark, d).sample_reads(["chr1"]).select("pair_id", "mate", "nucs")


@query(
    "a22_base_weights",
    sql(
        "SELECT ref, pos, "
        + ", ".join(f"round(coalesce(sum(q) FILTER (base = '{b}'), 0) / 30.0, 6) AS {b.lower()}_prob" for b in "ACGTX")
        + " FROM diffs GROUP BY ref, pos",
        "diffs",
    ),
)
def _(spark, d):
    w = loci.base_weights(S.mapping(spark, d).differences)
    return w.select("ref", "pos", *[F.round(c, 6).alias(c) for c in w.columns[2:]])


@query(
    "a17_qq",
    sql(
        """SELECT q, round(CASE WHEN good = 0 THEN 0 WHEN bad = 0 THEN 41 ELSE -10 * log10(bad / (good + bad)) END, 6) AS observed, good + bad AS n
           FROM (SELECT q, count_if(base = ref_base) AS good, count_if(base <> ref_base) AS bad FROM base_rows WHERE ok GROUP BY q)""",
        "base_rows",
    ),
)
def _(spark, d):
    return pileup.quality_calibration(S.mapping(spark, d).quality_counts).select("q", F.round("observed", 6).alias("observed"), "n")


@query(
    "a18_empirical_q",
    sql(
        """SELECT read_pos, round(-10 * log10(bad / (good + bad)), 6) AS observed
           FROM (SELECT read_pos, count_if(base = ref_base) AS good, count_if(base <> ref_base) AS bad FROM base_rows WHERE ok GROUP BY read_pos)
           WHERE good > 0 AND bad > 0""",
        "base_rows",
    ),
)
def _(spark, d):
    return pileup.quality_by_position(S.mapping(spark, d).quality_counts).select(
        F.col("read_pos").cast("long").alias("read_pos"), F.round("observed", 6).alias("observed")
    )


@query(
    "v26_locus_report",
    sql(
        """SELECT ref, pos, rpad(pos::VARCHAR, 10, ' ') || ': ' || lpad(depth::VARCHAR, 3, ' ') || '*' || orig || ' ' || bs || chr(10)
             || repeat(' ', 18) || qs || chr(10) || repeat(' ', 18) || hs || chr(10) || repeat(' ', 18)
             || 'A: ' || (100 * (a + CASE WHEN orig = 'A' THEN depth ELSE 0 END)) // tot || '%, C: ' || (100 * (c + CASE WHEN orig = 'C' THEN depth ELSE 0 END)) // tot
             || '%, G: ' || (100 * (g + CASE WHEN orig = 'G' THEN depth ELSE 0 END)) // tot || '%, T: ' || (100 * (t + CASE WHEN orig = 'T' THEN depth ELSE 0 END)) // tot
             || '%, X: ' || (100 * dels) // tot || '%' AS report
           FROM (SELECT *, num_diff + depth AS tot FROM loci) JOIN (
             SELECT ref, pos, string_agg(base, '' ORDER BY base, q, head) AS bs, string_agg(chr(q + 33), '' ORDER BY base, q, head) AS qs,
               string_agg(CASE WHEN head THEN 'H' ELSE '.' END, '' ORDER BY base, q, head) AS hs FROM diffs GROUP BY ref, pos) USING (ref, pos)""",
        "loci", "diffs",
    ),
)
def _(spark, d):
    return loci.locus_report(_loci(spark, d), S.mapping(spark, d).differences)


@query(
    "v12_indel",
    sql(
        """SELECT pair_id, mate, ref, pos, indel, amount, CASE WHEN indel > 0 THEN indel || 'M' || amount || 'I' || (length(whole) - indel - amount) || 'M'
             ELSE -indel || 'M' || amount || 'D' || (length(whole) + indel) || 'M' END AS cigar FROM laid WHERE indel <> 0""",
        "laid",
    ),
)
def _(spark, d):
    a = S.mapping(spark, d).aligned.where("indel <> 0")
    return a.select("pair_id", "mate", "ref", "pos", "indel", "amount", dna.cigar("read_len", "indel", "amount").alias("cigar"))


INSERTS = {"ins": "SELECT ref, pos + indel AS pos, count(*) AS n, count(*) > 4 AS significant FROM laid WHERE indel > 0 GROUP BY ALL"}


@query("a16_insert_counts", sql("SELECT * FROM ins", "laid", extra=INSERTS))
def _(spark, d):
    return loci.insert_counts(S.mapping(spark, d).aligned)


@query("t07_top_inserts", sql("SELECT * FROM ins WHERE n >= 3", "laid", extra=INSERTS))
def _(spark, d):
    return loci.top_inserts(loci.insert_counts(S.mapping(spark, d).aligned))


@query(
    "a15_loci_with_indels",
    sql(
        f"""SELECT {LOCUS_COLS}, coalesce(insert_report, '') AS insert_report FROM loci LEFT JOIN (
              SELECT ref, pos, string_agg(inserted || ': ' || n, ', ' ORDER BY inserted) AS insert_report
              FROM (SELECT ref, pos, inserted, count(*) AS n FROM diffs WHERE inserted IS NOT NULL GROUP BY ALL) GROUP BY ref, pos) USING (ref, pos)""",
        "loci", "diffs",
    ),
)
def _(spark, d):
    m = S.mapping(spark, d)
    g = loci.loci(m.differences, m.coverage, S.reference_ext(spark, d), T.CHUNK)
    return g.select(*LOCUS_COLS.split(", "), "insert_report")


@query("v29_edit_script")
def _(spark, d):
    g = T.both_genomes(spark, d)
    return g.select("ref", "chunk", edit.edit_text("s", "t").alias("e")).select("ref", "chunk", "e.*")


PICTURE = REGIONS | {
    "seen": """SELECT r.start, r.stop, l.* FROM reg r JOIN laid l ON l.ref = r.ref AND l.pos >= r.start AND l.pos < r.stop""",
    "gap": """SELECT ref, start, pos + indel AS p, max(length(inserted)) AS width FROM seen WHERE indel > 0 AND pos + indel < stop GROUP BY ALL""",
    "cell": """SELECT ref, start, pos, pair_id, mate, reverse, k, indel, inserted, inserted_q, substr(o, (k + 1)::INT, 1) AS x, substr(g, (k + 1)::INT, 1) AS y, ascii(substr(oq, (k + 1)::INT, 1)) - 33 AS q
        FROM (SELECT *, unnest(range(0, least(length(o), length(g), stop - pos))) AS k FROM seen)""",
    "drawn": """SELECT c.*, coalesce(width, 0) AS width, CASE WHEN x = y THEN '.' WHEN q > 30 THEN x WHEN q < 22 THEN ' ' ELSE lower(x) END AS ch,
        CASE WHEN indel <= 0 OR k <> indel THEN '' WHEN inserted_q > 30 THEN inserted WHEN inserted_q < 22 THEN repeat(' ', length(inserted)) ELSE lower(inserted) END AS own
        FROM cell c LEFT JOIN gap ON gap.ref = c.ref AND gap.start = c.start AND gap.p = c.pos + c.k""",
    "lines": """SELECT ref, start, pos, pair_id, mate, reverse, string_agg(CASE WHEN k > 0 THEN own || repeat('_', (width - length(own))::INT) ELSE '' END || ch, '' ORDER BY k) AS line FROM drawn GROUP BY ALL""",
    "lead": """SELECT l.ref, l.start, l.pos, coalesce(sum(width), 0)::BIGINT AS more FROM (SELECT DISTINCT ref, start, pos FROM lines) l LEFT JOIN gap ON gap.ref = l.ref AND gap.start = l.start AND gap.p <= l.pos GROUP BY ALL""",
    "ground": """SELECT r.ref, r.start, string_agg(repeat('_', coalesce(width, 0)::INT) || base, '' ORDER BY g.pos) AS row FROM reg r JOIN genome g ON g.ref = r.ref AND g.pos >= r.start AND g.pos < r.stop
        LEFT JOIN gap ON gap.ref = r.ref AND gap.start = r.start AND gap.p = g.pos GROUP BY r.ref, r.start""",
}


@query(
    "j21_region_picture",
    sql(
        """SELECT ref, start, pos, pair_id, mate, repeat(' ', (pos - start + more)::INT) || line || repeat(' ', 17) || CASE WHEN reverse THEN 'R' ELSE ' ' END AS row FROM lines JOIN lead USING (ref, start, pos)
           UNION ALL SELECT ref, start, start, NULL, 0, row FROM ground""",
        "loci", "diffs", "chroms", "laid", "genome", extra=PICTURE,
    ),
)
def _(spark, d):
    m = S.mapping(spark, d)
    r = _regions(spark, d).select("ref", "start", "stop")
    ground = picture.reference_rows(r, m.aligned, m.chunks, T.CHUNK)
    ground = ground.select("ref", "start", F.col("start").alias("pos"), F.lit(None).cast("long").alias("pair_id"), F.lit(0).alias("mate"), "row")
    return picture.read_rows(r, m.aligned).unionByName(ground)
