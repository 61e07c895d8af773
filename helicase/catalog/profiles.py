"""K-mer, 16S, merging, search, line and pool queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helicase.catalog.base import rc, sql
from helicase.functions import dna
from helicase.operators import kmers, lines, merging, pools, prefixes, selfref, similarity
from helicase.plans import stages as S
from helicase.session import materialise
from helicase.sources import genome, tables as T

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


K = 16
PACKED = "regexp_replace({0}, '(.)(.)(.)(.)', '\\4\\3\\2\\1', 'g')"
K16 = {
    "k16": f"""SELECT *, {rc('kmer')} AS turned FROM (SELECT ref, chunk * 32 + i + 1 AS pos, substr(ext, (i + 1)::INT, 16) AS kmer
        FROM ext, (SELECT unnest(generate_series(0, 31)) AS i) WHERE length(ext) >= i + 16)""",
    "counts": f"""SELECT CASE WHEN fwd THEN kmer ELSE turned END AS kmer, count_if(fwd) AS canon, count_if(NOT fwd) AS anticanon, count(*) AS n
        FROM (SELECT *, {PACKED.format('kmer')} < {PACKED.format('turned')} AS fwd FROM k16) GROUP BY 1""",
}


def _windows(spark, d):
    return kmers.windows(S.reference_ext(spark, d), T.CHUNK, [K])


@query("j14_kmer_counts", sql("SELECT kmer, canon, anticanon, n FROM counts", "ext", extra=K16))
def _(spark, d):
    return kmers.kmer_counts(_windows(spark, d))


@query(
    "a27_kmer_top",
    sql(
        f"""SELECT kmer, {rc('kmer')} AS rc, canon, anticanon, coalesce(sum(n) OVER (ORDER BY n DESC, kmer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cumul
            FROM (SELECT * FROM counts WHERE n > 1 ORDER BY n DESC, kmer LIMIT 1000)""",
        "ext", extra=K16,
    ),
)
def _(spark, d):
    return kmers.top_kmers(kmers.kmer_counts(_windows(spark, d)), 1000)


@query(
    "j13_earlier_places",
    sql(
        """SELECT q.ref, q.pos AS at_pos, k.ref AS hit_ref, k.pos AS hit, k.kmer <> q.kmer AS reverse FROM placed16 q JOIN placed16 k ON least(q.kmer, q.turned) = least(k.kmer, k.turned)
           AND k.place < q.place""",
        "ext", "chroms", extra=K16 | {"starts16": "SELECT ref, sum(len) OVER (ORDER BY ref) - len AS start FROM chroms", "placed16": "SELECT *, start + pos AS place FROM k16 JOIN starts16 USING (ref)"},
    ),
)
def _(spark, d):
    hits = kmers.earlier_places(_windows(spark, d), _order(spark, d))
    return hits.select("ref", F.col("pos").alias("at_pos"), "hit_ref", F.col("hit_pos").alias("hit"), "reverse")


SHORT = """SELECT kmer, count(*) AS n FROM (SELECT substr(ext, (i + 1)::INT, 8) AS kmer FROM ext, (SELECT unnest(generate_series(0, 31)) AS i)
    WHERE length(ext) >= i + 8) GROUP BY kmer"""


@query(
    "a37_neighbour_upgrade",
    sql(
        f"""SELECT kmer, max(m) AS best FROM (SELECT c.kmer, x.n AS m FROM (SELECT kmer, unnest(list_concat([{rc('kmer')}], flatten(list_transform(range(1, 9),
             lambda i: list_transform(['A', 'C', 'G', 'T'], lambda b: substr(kmer, 1, i::INT - 1) || b || substr(kmer, i::INT + 1)))))) AS other FROM short WHERE n = 2) c
             JOIN short x ON x.kmer = c.other AND x.kmer <> c.kmer AND (x.n > 2 OR x.kmer = {rc('c.kmer')})) GROUP BY kmer""",
        "ext", extra={"short": SHORT},
    ),
)
def _(spark, d):
    w = kmers.windows(S.reference_ext(spark, d), T.CHUNK, [8])
    return kmers.single_change_upgrades(w.groupBy("kmer").agg(F.count("*").alias("n")), 8)


GRID = 40
PIECES = f"""SELECT DISTINCT (gpos * {GRID}) // (SELECT sum(len) FROM chroms) AS piece, kmer FROM (
    SELECT kmer, (substr(ref, 4)::INT - 1) * 32000 + pos - 1 AS gpos FROM k16)"""


def _piece(spark, d):
    total = S.reference(spark, d).agg(F.sum(F.length("s"))).scalar()
    gpos = (F.substring("ref", 4, 9).cast("long") - 1) * (T.CHUNKS_PER_REF * T.CHUNK) + F.col("pos") - 1
    return F.call_function("div", gpos * GRID, total)


@query(
    "a28_chunk_overlap",
    sql(
        """SELECT a.piece::INT AS x, b.piece::INT AS y, any_value(xs.n) AS x_kmers, any_value(ys.n) AS y_kmers, count(*) AS shared FROM pieces a JOIN pieces b USING (kmer)
           JOIN sizes xs ON xs.piece = a.piece JOIN sizes ys ON ys.piece = b.piece GROUP BY a.piece, b.piece""",
        "ext", "chroms", extra=K16 | {"pieces": PIECES, "sizes": "SELECT piece, count(*) AS n FROM pieces GROUP BY piece"},
    ),
)
def _(spark, d):
    return similarity.shared_kmers(_windows(spark, d), _piece(spark, d), GRID)


@query("a29_joint_compression")
def _(spark, d):
    c = S.reference(spark, d)
    total = c.agg(F.count("*")).scalar()
    number = (F.substring("ref", 4, 9).cast("long") - 1) * T.CHUNKS_PER_REF + F.col("chunk")
    pieces = c.groupBy(F.call_function("div", number * 12, total).cast("int").alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("g"), "s"))), lambda x: x["s"]), "").alias("text")
    )
    return similarity.joint_compression(pieces, 12)


@query(
    "u01_shared_between_chromosomes",
    sql("SELECT kmer FROM (SELECT DISTINCT kmer FROM k16 WHERE pos <= 3200 INTERSECT SELECT DISTINCT kmer FROM k16 WHERE pos > 3200)", "ext", extra=K16),
)
def _(spark, d):
    w = _windows(spark, d)
    return w.where("pos <= 3200").select("kmer").intersect(w.where("pos > 3200").select("kmer"))


@query(
    "u01_chromosome_overlap",
    sql(
        """SELECT a.ref AS x, b.ref AS y, count(*) AS shared FROM own a JOIN own b USING (kmer) GROUP BY a.ref, b.ref""",
        "ext", extra=K16 | {"own": "SELECT DISTINCT ref, kmer FROM k16"},
    ),
)
def _(spark, d):
    return similarity.shared_by_name(_windows(spark, d), "ref")


RRNA = {
    "entries": f"""SELECT id, name, CASE WHEN id % 7 = 2 THEN left(x, 29) || 'N' || substr(x, 31) WHEN id % 3 = 1 THEN left(x, 49) || translate(substr(x, 50, 1), 'ACGT', 'GTAC') || substr(x, 51) ELSE x END AS nucs
        FROM (SELECT c_custkey AS id, c_name AS name, left(sample, 120 + c_custkey % 40) AS x FROM (SELECT c_custkey, c_name, (c_custkey * 53) % (SELECT count(*) FROM part) AS gk FROM customer) c
          JOIN sample ON sample.ref = 'chr' || (gk // 1000 + 1) AND sample.chunk = gk % 1000)""",
    "idx": f"""SELECT pair_id, mate, false AS reverse, nucs, qual, left(nucs, 35) AS prefix FROM reads WHERE length(nucs) >= 35
        UNION ALL SELECT pair_id, mate, true, {rc('nucs')}, reverse(qual), left({rc('nucs')}, 35) FROM reads WHERE length(nucs) >= 35""",
    "wins": """SELECT id, n, substr(nucs, (n + 1)::INT) AS rest FROM (SELECT id, nucs, unnest(generate_series(0, length(nucs) - 36)) AS n FROM entries WHERE length(nucs) > 35)
        WHERE NOT contains(substr(nucs, (n + 1)::INT), 'N')""",
    "fits0": """SELECT w.id, w.n, pair_id, mate, reverse, i.nucs AS read, qual, rest FROM wins w JOIN idx i ON i.prefix = left(rest, 35)
        WHERE hamming(left(i.nucs, least(length(i.nucs), length(rest))), left(rest, least(length(i.nucs), length(rest)))) < 2""",
    "fits": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY pair_id, mate, reverse) AS rn FROM fits0) WHERE rn = 1""",
    "agree": """SELECT id, n, n + p - 1 AS idx, ascii(substr(qual, p::INT, 1)) - 33 AS q FROM (SELECT *, unnest(generate_series(1, least(length(read), length(rest)))) AS p FROM fits)
        WHERE substr(read, p::INT, 1) = substr(rest, p::INT, 1)""",
    "dense16": """SELECT d.id, d.len, d.idx, coalesce(sum(q), 0) AS s FROM (SELECT id, length(nucs) AS len, unnest(generate_series(0, length(nucs) - 1)) AS idx FROM entries WHERE length(nucs) > 35) d
        LEFT JOIN agree a ON a.id = d.id AND a.idx = d.idx GROUP BY ALL""",
    "stops": """SELECT id, min(idx) AS stop FROM (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS tail FROM dense16)
        WHERE idx > 20 AND idx < len - 35 AND tail = 0 GROUP BY id""",
    "used": "SELECT f.* FROM fits f LEFT JOIN stops USING (id) WHERE stop IS NULL OR n <= stop",
    "per_idx": """SELECT a.id, a.idx, sum(q) AS s FROM agree a LEFT JOIN stops ON stops.id = a.id WHERE stop IS NULL OR n <= stop GROUP BY a.id, a.idx""",
    "scored": """SELECT e.id, name, sum(s)::BIGINT // length(nucs) AS score, length(nucs) - 21 - count_if(s > 0 AND idx > 20) AS holes FROM entries e JOIN per_idx USING (id) GROUP BY e.id, name, nucs""",
}


@query("j11_prefix_lookup", sql("SELECT w.id, w.n, pair_id, mate, reverse FROM wins w JOIN idx i ON i.prefix = left(rest, 35) WHERE w.n % 10 = 0 ", "sample", "reads", extra=RRNA).replace("WHERE w.n % 10 = 0 ", ""))
def _(spark, d):
    entries = T.rrna_entries(spark, d)
    idx = prefixes.prefix_index(S.reads(spark, d))
    w = entries.where(F.length("nucs") > 35).select("id", "nucs", F.explode(F.sequence(F.lit(0), F.length("nucs") - 36)).alias("n"))
    rest = F.substring(F.col("nucs"), F.col("n") + 1, F.length("nucs"))
    w = w.select("id", "n", rest.alias("rest")).where(~F.contains("rest", F.lit("N"))).select("id", "n", F.left("rest", F.lit(35)).alias("prefix"))
    return kmers.expanded(w).join(kmers.expanded(idx), "prefix").select("id", F.col("n").cast("long").alias("n"), "pair_id", "mate", "reverse")


@query("j12_rrna_first_match", sql("SELECT id, n, pair_id, mate, read FROM fits", "sample", "reads", extra=RRNA))
def _(spark, d):
    m = prefixes.rrna_matches(T.rrna_entries(spark, d), S.reads(spark, d), stage=materialise)
    return m.select("id", F.col("n").cast("long").alias("n"), "pair_id", "mate", "read")


@query(
    "a30_rrna_score",
    sql(
        """SELECT id, name, score, holes, reads, round(reads * 100.0 / (SELECT count(DISTINCT (pair_id, mate)) FROM used WHERE id IN (SELECT id FROM scored WHERE holes <= 60)), 6) AS share
           FROM scored JOIN (SELECT id, count(*) AS reads FROM used GROUP BY id) USING (id) WHERE holes <= 60""",
        "sample", "reads", extra=RRNA,
    ),
)
def _(spark, d):
    s = prefixes.rrna_scores(T.rrna_entries(spark, d), S.reads(spark, d), gaps=60, stage=materialise)
    return s.withColumn("share", F.round("share", 6))


MERGED = {
    "pr": f"""SELECT a.pair_id, a.nucs AS one, b.nucs AS two, {rc('b.nucs')} AS inv FROM reads a JOIN reads b ON a.pair_id = b.pair_id AND a.mate = 1 AND b.mate = 2""",
    "ov": """SELECT *, list_max(list_filter(range(20, least(length(one), length(inv)) + 1), lambda o: left(one, o) = right(inv, o))) AS a,
        list_max(list_filter(range(20, least(length(one), length(inv)) + 1), lambda o: right(one, o) = left(inv, o))) AS b FROM pr""",
    "merged": """SELECT pair_id, one, two, coalesce(a, b)::INT AS overlap, CASE WHEN a IS NOT NULL THEN inv WHEN b IS NOT NULL THEN one || substr(inv, b + 1) END AS merged FROM ov""",
}


def _merged(spark, d):
    return merging.merge_pairs(merging.pair_rows(S.reads(spark, d)))


@query("j20_pair_merge", sql("SELECT * FROM merged", "reads", extra=MERGED))
def _(spark, d):
    return _merged(spark, d)


@query("a32_overlap_hist", sql("SELECT overlap, count(*) AS n FROM merged WHERE overlap IS NOT NULL GROUP BY overlap", "reads", extra=MERGED))
def _(spark, d):
    return merging.overlap_histogram(_merged(spark, d))


PATTERN = "ACGTTG"


def grep_sql(source: str, keys: str) -> str:
    turned = rc("nucs")
    return f"""SELECT {keys}, CASE WHEN contains(nucs, '{PATTERN}') THEN 'F' ELSE 'R' END AS strand,
        CASE WHEN contains(nucs, '{PATTERN}') THEN substr(nucs, instr(nucs, '{PATTERN}')) ELSE substr({turned}, instr({turned}, '{PATTERN}')) END AS hit
        FROM {source} WHERE contains(nucs, '{PATTERN}') OR contains({turned}, '{PATTERN}')"""


@query("p10_grep", sql(grep_sql("reads", "pair_id, mate"), "reads"))
def _(spark, d):
    return merging.grep_reads(S.reads(spark, d), PATTERN).select("pair_id", "mate", "strand", "hit")


@query(
    "p10_pair_grep",
    sql(
        grep_sql("parts", "pair_id, part"),
        "reads",
        extra=MERGED
        | {
            "parts": """SELECT pair_id, 'merged' AS part, merged AS nucs FROM merged WHERE merged IS NOT NULL
                UNION ALL SELECT pair_id, '1', one FROM merged WHERE merged IS NULL UNION ALL SELECT pair_id, '2', two FROM merged WHERE merged IS NULL"""
        },
    ),
)
def _(spark, d):
    return merging.grep_pairs(_merged(spark, d), PATTERN)


LINES = {
    "l0": r"SELECT doc_id AS file, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents",
    "l1": """SELECT file, CASE WHEN regexp_full_match(line, '[0-9]+') THEN CASE WHEN ltrim(line, '0') = '' THEN '0' ELSE ltrim(line, '0') END
        ELSE translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS line FROM l0 WHERE line <> ''""",
    "present": "SELECT line, bit_xor(('0x' || substr(md5(file::VARCHAR), 1, 15))::BIGINT) AS set_id, count(*) AS n_files FROM (SELECT DISTINCT line, file FROM l1) GROUP BY line",
}


def _lines(spark, d):
    return lines.split_lines(T.table(spark, d, "documents"), "text", "doc_id")


@query("a33_line_presence", sql("SELECT line, set_id, n_files FROM present", extra=LINES))
def _(spark, d):
    return lines.presence(_lines(spark, d))


@query("a33_line_members", sql("SELECT DISTINCT line, file FROM l1", extra={k: LINES[k] for k in ("l0", "l1")}))
def _(spark, d):
    return lines.members(_lines(spark, d))


@query("a33_presence_groups", sql("SELECT set_id, n_files, count(*) AS n_lines FROM present GROUP BY ALL", extra=LINES))
def _(spark, d):
    return lines.presence_groups(lines.presence(_lines(spark, d)))


POOLS = {
    "pl": """SELECT l_linenumber AS pool, l_partkey AS locus, sum(l_quantity)::BIGINT AS num_diff, sum(round(l_extendedprice)::BIGINT % 100)::BIGINT AS depth,
        count_if(l_returnflag = 'R') AS dels, l_partkey % 3 <> 0 AS gene, max(l_linestatus) AS st, count_if(l_returnflag = 'A') AS na FROM lineitem GROUP BY ALL""",
    "graded": """SELECT *, CASE WHEN num_diff < 4 OR CASE WHEN depth = 0 THEN 1e300 ELSE num_diff * 100.0 / depth END < 20 THEN 'weak' WHEN num_diff > 10 THEN 'strong' ELSE 'fair' END AS grade
        FROM pl WHERE gene AND st <> 'F' AND na > 0""",
}


@query("a35_pool_summary", sql("SELECT count(DISTINCT pool) AS pools, count(*) AS mutations, count_if(NOT gene) AS outside_genes, count(DISTINCT locus) AS distinct_loci FROM pl", extra={"pl": POOLS["pl"]}))
def _(spark, d):
    return pools.summary(T.pool_loci(spark, d))


@query(
    "j19_pool_pivot",
    sql(
        "SELECT locus, "
        + ", ".join(f"max(grade) FILTER (pool = {p}) AS pool_{p}" for p in range(1, 8))
        + """, sum(num_diff)::BIGINT AS total FROM graded GROUP BY locus
          HAVING (count_if(grade <> 'weak') > 0 OR (sum(num_diff) > 12 AND sum(num_diff) > 20)) AND count(DISTINCT pool) < 7""",
        extra=POOLS,
    ),
)
def _(spark, d):
    g = pools.classify(T.pool_loci(spark, d), 4, 20, genes_only=True, nonsynonymous=True, inserts_only=True)
    return pools.pivot(g, list(range(1, 8)), 4, drop_universal=True)


@query("p12_deletes_only", sql("SELECT pool, locus, num_diff, dels FROM pl WHERE dels > 0", extra={"pl": POOLS["pl"]}))
def _(spark, d):
    return pools.classify(T.pool_loci(spark, d), deletes_only=True).select("pool", "locus", "num_diff", "dels")


STITCH = {
    "seeds": "SELECT ref || ':' || chunk AS seed_id, left(ext, 100) AS seed FROM ext",
    "idx": RRNA["idx"],
}


def _stitched(texts: str) -> str:
    """One step for the column `text` of a query: (text, col, w, base) of the winning votes, N without any."""
    m = "least(length(nucs), length(rest))"
    return f"""SELECT c.text, c.col, coalesce(max(w), 0) AS w, coalesce(arg_max(base, (w, base)), 'N') AS base FROM (SELECT text, unnest(range(0, length(text) * 3 // 2)) AS col FROM {texts}) c
        LEFT JOIN (SELECT text, col, base, sum(w) AS w FROM (
          SELECT text, i - 1 AS col, substr(text, i::INT, 1) AS base, 40 AS w FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM {texts})
          UNION ALL SELECT text, n + p - 1, substr(nucs, p::INT, 1), ascii(substr(qual, p::INT, 1)) - 33 FROM (
            SELECT text, n, nucs, qual, unnest(range(1, length(nucs) + 1)) AS p FROM (SELECT text, n, substr(text, n::INT + 1) AS rest FROM (SELECT text, unnest(range(0, length(text) - 35)) AS n FROM {texts})) s
            JOIN idx ON idx.prefix = left(rest, 35) WHERE NOT contains(left(rest, 35), 'N') AND hamming(left(nucs, {m}), left(rest, {m})) < 5))
          WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL HAVING sum(w) > 0) v ON v.text = c.text AND v.col = c.col GROUP BY c.text, c.col"""


def _seeds(spark, d):
    return S.reference_ext(spark, d).select(F.concat_ws(":", "ref", "chunk").alias("seed_id"), F.left("ext", F.lit(100)).alias("seed"))


WALK = STITCH | {
    "votes": _stitched("walk"),
    "steps": """SELECT text, substr(t, 1, length(text) // 2) AS emit, substr(t, length(text) // 2 + 1, length(text)) AS next, depths[:length(text) // 2] AS depths
        FROM (SELECT text, string_agg(base, '' ORDER BY col) AS t, list(w ORDER BY col) AS depths FROM votes GROUP BY text)""",
    "path": """SELECT seed_id, 0 AS step, seed AS text, length(seed) // 2 AS half FROM seeds
        UNION ALL SELECT seed_id, step + 1, next, half FROM path JOIN steps USING (text) WHERE (step + 1) * half <= 10000""",
    "walked": "SELECT * FROM path",
}
_NEXT = f"""SELECT substr(string_agg(base, '' ORDER BY col), length(text) // 2 + 1, length(text)) FROM ({_stitched('walk')}) GROUP BY text"""


def _walk(select: str) -> str:
    """A statement over the recursive steps of all seeds."""
    whole = sql(select, "ext", "reads", extra=STITCH | {"walk": "", **{k: v for k, v in WALK.items() if k not in STITCH}})
    walk = f"walk(text) AS (SELECT seed FROM seeds UNION {_NEXT})"
    whole = whole.replace("walk AS MATERIALIZED ()", walk).replace("path AS MATERIALIZED (", "path AS (")
    return whole.replace("WITH ", "WITH RECURSIVE ", 1)


@query("i01_stitch", _walk("SELECT seed_id, string_agg(emit, '' ORDER BY step) AS consensus, false AS found_end FROM walked JOIN steps USING (text) GROUP BY seed_id"))
def _(spark, d):
    return prefixes.stitch(_seeds(spark, d), S.reads(spark, d))


@query("s33_stitch_depth", _walk("""SELECT seed_id, step * half AS "at", array_to_string(depths, ',') AS depths FROM walked JOIN steps USING (text)"""))
def _(spark, d):
    s = prefixes.stitch_depths(_seeds(spark, d), S.reads(spark, d))
    return s.select("seed_id", F.col("at").cast("long").alias("at"), F.array_join(F.col("depths").cast("array<string>"), ",").alias("depths"))


@query(
    "s33_rrna_depth",
    sql(
        """SELECT e.id, e.idx, coalesce(s, 0)::BIGINT AS depth FROM (SELECT id, unnest(generate_series(0, length(nucs) - 1)) AS idx FROM entries JOIN scored USING (id) WHERE holes <= 60) e
           LEFT JOIN per_idx p ON p.id = e.id AND p.idx = e.idx""",
        "sample", "reads", extra=RRNA,
    ),
)
def _(spark, d):
    s = prefixes.rrna_depths(T.rrna_entries(spark, d), S.reads(spark, d), gaps=60, stage=materialise)
    return s.select("id", F.col("idx").cast("long").alias("idx"), "depth")


def _order(spark, d):
    return genome.with_offsets(genome.chromosomes(S.reference(spark, d)))


@query("j15_best_reference")
def _(spark, d):
    return selfref.best_references(S.reference(spark, d), T.CHUNK, _order(spark, d))


@query("i02_self_encoding")
def _(spark, d):
    return selfref.encode(S.reference(spark, d), T.CHUNK, _order(spark, d), longest=64, block=4096)[0]


@query("a36_encoding_totals")
def _(spark, d):
    return selfref.encode(S.reference(spark, d), T.CHUNK, _order(spark, d), longest=64, block=4096)[1]
