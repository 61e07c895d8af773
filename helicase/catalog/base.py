"""Shared SQL steps of the expected results.

Each step is one common table expression; ``sql`` puts the needed ones, in
order, in front of a final SELECT.
"""

from __future__ import annotations

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def gc(x: str) -> str:
    total = f"(length({x}) - length(translate({x}, 'ACGTN', '')))"
    return f"CASE WHEN {total} = 0 THEN 0.0 ELSE (length({x}) - length(translate({x}, 'CG', '')))::DOUBLE / {total} END"


def hexd(h: str, i: int) -> str:
    return f"(instr('0123456789abcdef', substr({h}, {i}, 1)) - 1)"


def _lead(col: str, n: int) -> str:
    return " || ".join([col] + [f"coalesce(lead({col}, {i}) OVER w, '')" for i in range(1, n)])


# Fixed values, written out apart from the code under test: codons of each amino acid by the standard genetic code, and names as reports spell them.
CODONS = {
    "A": "GCT GCC GCA GCG", "C": "TGT TGC", "D": "GAT GAC", "E": "GAA GAG", "F": "TTT TTC", "G": "GGT GGC GGA GGG", "H": "CAT CAC", "I": "ATT ATC ATA",
    "K": "AAA AAG", "L": "TTA TTG CTT CTC CTA CTG", "M": "ATG", "N": "AAT AAC", "P": "CCT CCC CCA CCG", "Q": "CAA CAG", "R": "CGT CGC CGA CGG AGA AGG",
    "S": "TCT TCC TCA TCG AGT AGC", "T": "ACT ACC ACA ACG", "V": "GTT GTC GTA GTG", "W": "TGG", "Y": "TAT TAC", "s": "TAA TAG TGA",
}
NAMES = {
    "A": "Alanine", "C": "Cysteine", "D": "Aspartic Acid", "E": "Glutamic Acid", "F": "Phenylanaline", "G": "Glycine", "H": "Histidine", "I": "Isoleucine", "K": "Lysine",
    "L": "Leucine", "M": "Methionine", "N": "Asparagine", "P": "Proline", "Q": "Glutamine", "R": "Arganine", "S": "Serine", "T": "Threonine", "V": "Valine", "W": "Tryptophan",
    "Y": "Tyrosine", "s": "Stop",
}


def amino(c: str) -> str:
    """One-letter amino acid of a codon expression made of A, C, G, T, N or X; an unknown third base counts as A, but not after TG."""
    known = f"(length({c}) >= 3 AND substr({c}, 3, 1) IN ('A', 'C', 'G', 'T'))"
    whole = f"(substr({c}, 1, 2) || CASE WHEN {known} THEN substr({c}, 3, 1) ELSE 'A' END)"
    arms = " ".join(f"WHEN {whole} IN ({', '.join(repr(x) for x in own.split())}) THEN '{letter}'" for letter, own in CODONS.items())
    return f"CASE WHEN substr({c}, 1, 2) = 'TG' AND NOT {known} THEN '?' {arms} ELSE '?' END"


def amino_name(letter: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())
    return f"CASE {letter} {arms} ELSE '?' END"


def indels(pairs: str) -> str:
    """(o, g, indel, amount) of the read and reference texts (o, g) of a query."""
    least = "least(length(o), length(g))"
    prefix = f"coalesce(nullif(list_position(list_transform(range(1, {least} + 1), lambda i: o[i] = g[i]), false), 0), {least} + 1) - 1"
    differ = "list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN x[i] <> y[i] THEN 1 ELSE 0 END))"
    return f"""SELECT o, g, (CASE WHEN best % 2 = 0 THEN p WHEN best % 2 = 1 THEN -p ELSE 0 END)::INT AS indel, coalesce(best // 2, 0)::INT AS amount FROM (
        SELECT o, g, p, min(2 * a + del) FILTER (p >= 11 AND n >= 11 AND left(x, 11) = left(y, 11) AND p + n > 10 * a AND {differ} <= 1) AS best FROM (
          SELECT *, least(length(x), length(y)) AS n FROM (
            SELECT *, CASE WHEN del = 0 THEN substr(o, (p + a + 1)::INT) ELSE substr(o, (p + 1)::INT) END AS x, CASE WHEN del = 0 THEN substr(g, (p + 1)::INT) ELSE substr(g, (p + a + 1)::INT) END AS y
            FROM (SELECT *, unnest(generate_series(1, length(o) // 10)) AS a FROM (SELECT DISTINCT o, g, {prefix} AS p FROM ({pairs}))), (SELECT unnest([0, 1]) AS del)))
        GROUP BY o, g, p)"""


STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "part_src": (
        (),
        """SELECT p_partkey AS k, CASE WHEN (p_partkey // 4) % 8 = 5
             THEN ((p_partkey // 4 // 32) * 32 + 5) * 4 + p_partkey % 4 ELSE p_partkey END AS src FROM part""",
    ),
    "part_bases": (
        ("part_src",),
        """SELECT k, translate(md5(src::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part_src""",
    ),
    "chunks": (
        ("part_bases",),
        """SELECT 'chr' || (k // 1000 + 1) AS ref, k % 1000 AS chunk, s,
             CASE WHEN k % 16 = 7 THEN left(s, 15) || translate(substr(s, 16, 1), 'ACGT', 'CGTA') || substr(s, 17)
                  WHEN k % 64 = 21 THEN left(s, 16) || substr(s, 18)
                  WHEN k % 64 = 43 THEN left(s, 16) || 'GT' || substr(s, 17)
                  ELSE s END AS t FROM part_bases""",
    ),
    "ext": (
        ("chunks",),
        f"""SELECT ref, chunk, s, {_lead('s', 4)} AS ext FROM chunks WINDOW w AS (PARTITION BY ref ORDER BY chunk)""",
    ),
    "sample": (
        ("chunks",),
        f"""SELECT ref, chunk, {_lead('t', 8)} AS sample FROM chunks WINDOW w AS (PARTITION BY ref ORDER BY chunk)""",
    ),
    "chroms": (("chunks",), "SELECT ref, sum(length(s))::BIGINT AS len FROM chunks GROUP BY ref"),
    "genome": (
        ("chunks",),
        """SELECT ref, chunk * 32 + i AS pos, substr(s, i::INT, 1) AS base
           FROM chunks, (SELECT unnest(generate_series(1, 32)) AS i)""",
    ),
    "pair_keys": (
        (),
        """SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 10 = 9 THEN (o_orderkey // 40) * 40 ELSE o_orderkey END AS eff
           FROM orders""",
    ),
    "frags": (
        ("pair_keys", "sample"),
        """SELECT pair_id, eff,
             CASE WHEN eff % 100 < 70 THEN 72 WHEN eff % 100 < 90 THEN 64 WHEN eff % 100 < 99 THEN 60 ELSE 48 END AS want,
             substr(sample, (eff % 32 + 1)::INT,
               (CASE WHEN eff % 7 = 3 THEN 60 + eff % 40 ELSE 150 + (eff * 31) % 60 END)::INT) AS frag
           FROM (SELECT pair_id, eff, (eff * 7919) % (SELECT count(*) FROM part) AS g FROM pair_keys) p
           JOIN sample ON sample.ref = 'chr' || (g // 1000 + 1) AND sample.chunk = g % 1000""",
    ),
    "mates": (
        ("frags",),
        f"""SELECT pair_id, eff, mate, CASE WHEN (eff + mate) % 2 = 1 THEN left(frag, want)
             ELSE {rc('right(frag, want)')} END AS clean
           FROM frags, (SELECT unnest([1, 2]) AS mate)""",
    ),
    "noisy": (
        ("mates",),
        f"""SELECT *, {hexd('h', 1)} AS kind,
              CASE WHEN length(clean) > 0 THEN 1 + (16 * {hexd('h', 2)} + {hexd('h', 3)}) % greatest(length(clean), 1) ELSE 1 END AS spot
            FROM (SELECT *, md5(eff || ':' || mate) AS h FROM mates)""",
    ),
    "dirty": (
        ("noisy",),
        """SELECT pair_id, eff, mate,
             CASE WHEN kind = 15 AND length(clean) > 1 THEN
               left(clean, length(clean) // 2) || 'A' || substr(clean, length(clean) // 2 + 1, length(clean) - length(clean) // 2 - 1)
             ELSE left(clean, spot - 1) || translate(substr(clean, spot, width), 'ACGT', 'GTAC') || substr(clean, spot + width) END AS nucs0
           FROM (SELECT *, CASE WHEN kind < 8 THEN 0 WHEN kind < 12 THEN 1 WHEN kind < 14 THEN 3 ELSE 7 END AS width FROM noisy)""",
    ),
    "reads": (
        ("dirty",),
        """SELECT pair_id, mate, 'pair' || pair_id || '/' || mate AS name, nucs,
             left(translate(repeat(md5(pair_id || ':' || mate || ':q'), 3), '0123456789abcdef', '#&),/258;>ADGJMP'), length(nucs)) AS qual
           FROM (SELECT pair_id, mate, CASE WHEN eff % 97 = 0 AND mate = 1 AND length(nucs0) > 10
                 THEN left(nucs0, 9) || 'N' || substr(nucs0, 11) ELSE nucs0 END AS nucs FROM dirty)""",
    ),
    "read_bases": (
        ("reads",),
        """SELECT pair_id, mate, i - 1 AS i, substr(nucs, i::INT, 1) AS base, ascii(substr(qual, i::INT, 1)) - 33 AS q
           FROM (SELECT pair_id, mate, nucs, qual, unnest(generate_series(1, length(nucs))) AS i FROM reads)""",
    ),
    "kept": (
        ("reads",),
        "SELECT pair_id, mate, name, nucs, qual FROM reads",
    ),
    "kmers": (
        ("ext",),
        """SELECT ref, chunk * 32 + i + 1 AS pos, k, substr(ext, (i + 1)::INT, k) AS kmer
           FROM ext, (SELECT unnest(generate_series(0, 31)) AS i), (SELECT unnest([60, 64, 72]) AS k)
           WHERE length(ext) >= i + k""",
    ),
    "exact": (
        ("kept", "kmers"),
        f"""SELECT r.pair_id, r.mate, m.ref, m.pos, false AS reverse, 0 AS score FROM kept r JOIN kmers m ON r.nucs = m.kmer
           UNION ALL
           SELECT r.pair_id, r.mate, m.ref, m.pos, true, 0 FROM (SELECT *, {rc('nucs')} AS turned FROM kept) r
           JOIN kmers m ON r.turned = m.kmer""",
    ),
    "leftover": (
        ("kept", "exact"),
        """SELECT pair_id, mate, nucs, qual FROM kept ANTI JOIN exact USING (pair_id, mate)""",
    ),
    "seed_index": (
        ("ext",),
        """SELECT ref, chunk * 32 + i + 1 AS pos, substr(ext, (i + 1)::INT, 11) AS kmer
           FROM ext, (SELECT unnest(generate_series(0, 31)) AS i) WHERE length(ext) >= i + 11""",
    ),
    "tries": (
        ("leftover",),
        f"""SELECT nucs, gap, shift, turn AS reverse, CASE WHEN turn THEN {rc('nucs')} ELSE nucs END AS o
           FROM (SELECT nucs, gap, unnest(generate_series(0, gap - 1, 3)) AS shift
                 FROM (SELECT DISTINCT nucs, (length(nucs) - 33) // 3 AS gap FROM leftover
                       WHERE length(nucs) >= 36 AND NOT contains(nucs, 'N'))),
                (SELECT unnest([false, true]) AS turn)""",
    ),
    "hits": (
        ("tries", "seed_index"),
        """SELECT t.nucs, t.gap, t.shift, t.reverse, n AS letter, ref, pos
           FROM (SELECT *, unnest([0, 1, 2]) AS n FROM tries) t
           JOIN seed_index x ON x.kmer = substr(t.o, (t.gap * t.n + t.shift + 1)::INT, 11)""",
    ),
    "starts": (
        ("hits",),
        """SELECT DISTINCT nucs, ref, pos - shift AS pos, reverse FROM (
             SELECT *, lead(letter, 1) OVER w AS l1, lead(pos, 1) OVER w AS p1, lead(letter, 2) OVER w AS l2, lead(pos, 2) OVER w AS p2
             FROM hits WINDOW w AS (PARTITION BY nucs, shift, reverse, ref ORDER BY pos, letter))
           WHERE letter = 0 AND l1 = 1 AND l2 = 2 AND p1 - pos < 1.2 * gap AND p2 - p1 < 1.2 * gap AND pos - shift >= 1""",
    ),
    "fuzzy0": (
        ("starts", "leftover", "ext"),
        f"""SELECT pair_id, mate, ref, pos, reverse, o, g, count_if(a <> b AND q > 30)::INT AS score FROM (
             SELECT pair_id, mate, ref, pos, reverse, o, g, substr(o, i::INT, 1) AS a, substr(g, i::INT, 1) AS b, ascii(substr(oq, i::INT, 1)) - 33 AS q
             FROM (SELECT *, unnest(generate_series(1, least(length(o), length(g)))) AS i FROM (
               SELECT l.pair_id, l.mate, s.ref, s.pos, s.reverse,
                 CASE WHEN s.reverse THEN {rc('l.nucs')} ELSE l.nucs END AS o,
                 CASE WHEN s.reverse THEN reverse(l.qual) ELSE l.qual END AS oq,
                 substr(x.ext, ((s.pos - 1) % 32 + 1)::INT, length(l.nucs)) AS g
               FROM leftover l JOIN starts s USING (nucs)
               JOIN ext x ON x.ref = s.ref AND x.chunk = (s.pos - 1) // 32)))
           GROUP BY ALL""",
    ),
    "fuzzy": (
        ("fuzzy0",),
        f"""SELECT pair_id, mate, ref, pos, reverse, CASE WHEN indel <> 0 THEN 1 ELSE score END AS score
            FROM fuzzy0 f LEFT JOIN ({indels('SELECT o, g FROM fuzzy0 WHERE score >= 5')}) i ON f.score >= 5 AND f.o = i.o AND f.g = i.g""",
    ),
    "cands": (("exact", "fuzzy"), "SELECT * FROM exact UNION ALL SELECT * FROM fuzzy"),
    "first_mates": (("cands",), "SELECT pair_id, ref, pos, reverse, score, NOT reverse AS facing FROM cands WHERE mate = 1"),
    "second_mates": (("cands",), "SELECT pair_id, ref, pos, reverse, score FROM cands WHERE mate = 2"),
    "pairs": (
        ("first_mates", "second_mates"),
        """SELECT * FROM (SELECT a.pair_id, a.ref, a.pos AS pos1, a.reverse AS reverse1, a.score AS score1, b.pos AS pos2, b.reverse AS reverse2, b.score AS score2
           FROM first_mates a JOIN second_mates b ON a.pair_id = b.pair_id AND a.ref = b.ref AND a.facing = b.reverse) WHERE abs(pos1 - pos2) < 1400""",
    ),
    "best": (
        ("pairs",),
        """SELECT * EXCLUDE (rn) FROM (SELECT *, score1 + score2 AS score,
             row_number() OVER (PARTITION BY pair_id ORDER BY score1 + score2, ref, pos1, pos2, reverse1, score1, score2) AS rn FROM pairs)
           WHERE rn = 1""",
    ),
    "singles": (
        ("cands", "best"),
        """SELECT pair_id, mate, ref, pos, reverse, score FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, mate
             ORDER BY score, ref, pos, reverse) AS rn FROM cands WHERE pair_id NOT IN (SELECT pair_id FROM best)) WHERE rn = 1""",
    ),
    "placed": (
        ("best", "singles"),
        """SELECT pair_id, 1 AS mate, ref, pos1 AS pos, reverse1 AS reverse, score1 AS score, true AS paired, pos2 AS mate_pos FROM best
           UNION ALL SELECT pair_id, 2, ref, pos2, reverse2, score2, true, pos1 FROM best
           UNION ALL SELECT pair_id, mate, ref, pos, reverse, score, false, NULL FROM singles""",
    ),
    "unfound": (("kept", "placed"), "SELECT * FROM kept ANTI JOIN placed USING (pair_id, mate)"),
    "laid0": (
        ("placed", "kept", "ext"),
        f"""SELECT p.*, r.name, CASE WHEN p.reverse THEN {rc('r.nucs')} ELSE r.nucs END AS o,
             CASE WHEN p.reverse THEN reverse(r.qual) ELSE r.qual END AS oq,
             substr(x.ext, ((p.pos - 1) % 32 + 1)::INT, length(r.nucs)) AS g
           FROM placed p JOIN kept r USING (pair_id, mate) JOIN ext x ON x.ref = p.ref AND x.chunk = (p.pos - 1) // 32""",
    ),
    "points0": (
        ("laid0",),
        """SELECT pair_id, mate, coalesce(sum(CASE WHEN base = ref_base THEN 0 WHEN q > 30 THEN 1 ELSE 0.5 END), 0) < 5 AS near
           FROM (SELECT pair_id, mate, substr(o, i::INT, 1) AS base, substr(g, i::INT, 1) AS ref_base, ascii(substr(oq, i::INT, 1)) - 33 AS q
                 FROM (SELECT *, unnest(generate_series(1, least(length(o), length(g)))) AS i FROM laid0)) GROUP BY ALL""",
    ),
    "laid": (
        ("laid0", "points0"),
        f"""SELECT * EXCLUDE (o, oq, near), o AS whole, oq AS whole_q, coalesce(near, true) OR indel <> 0 AS ok,
              CASE WHEN indel > 0 THEN left(o, indel) || substr(o, indel + amount + 1) WHEN indel < 0 THEN left(o, -indel) || repeat('X', amount) || substr(o, 1 - indel) ELSE o END AS o,
              CASE WHEN indel > 0 THEN left(oq, indel) || substr(oq, indel + amount + 1) WHEN indel < 0 THEN left(oq, -indel) || repeat('I', amount) || substr(oq, 1 - indel) ELSE oq END AS oq,
              CASE WHEN indel > 0 THEN substr(o, indel + 1, amount) END AS inserted, ascii(substr(oq, indel + 1, 1)) - 33 AS inserted_q
            FROM (SELECT l.*, near, coalesce(i.indel, 0) AS indel, coalesce(i.amount, 0) AS amount FROM laid0 l LEFT JOIN points0 USING (pair_id, mate)
                  LEFT JOIN ({indels('SELECT o, g FROM laid0 JOIN points0 USING (pair_id, mate) WHERE NOT near')}) i ON NOT near AND l.o = i.o AND l.g = i.g)""",
    ),
    "rows0": (
        ("laid",),
        """SELECT pair_id, mate, ok, ref, pos + i - 1 AS pos, reverse, i - 1 AS i, length(o) AS n, length(g) AS m,
             substr(o, i::INT, 1) AS base, substr(g, i::INT, 1) AS ref_base, ascii(substr(oq, i::INT, 1)) - 33 AS q
           FROM (SELECT *, unnest(generate_series(1, least(length(o), length(g)))) AS i FROM laid)""",
    ),
    "points": (
        ("laid",),
        """SELECT pair_id, mate, ok FROM laid WHERE least(length(o), length(g)) > 0""",
    ),
    "base_rows": (
        ("rows0",),
        """SELECT ref, pos, base, ref_base, q, ok, reverse <> (i > n // 2) AS head, CASE WHEN reverse THEN m - 1 - i ELSE i END AS read_pos
           FROM rows0""",
    ),
    "cov": (
        ("base_rows",),
        "SELECT ref, pos, count(*) AS depth FROM base_rows WHERE base = ref_base AND q > 30 GROUP BY ref, pos",
    ),
    "dense": (
        ("genome", "cov"),
        "SELECT g.ref, g.pos, g.base, coalesce(c.depth, 0) AS depth FROM genome g LEFT JOIN cov c USING (ref, pos)",
    ),
    "diffs": (
        ("base_rows", "laid"),
        """SELECT ref, pos, base, q, head, NULL AS inserted FROM base_rows WHERE base <> ref_base AND q > 30 AND ok
           UNION ALL SELECT ref, pos + indel, left(inserted, 1), inserted_q, reverse <> (indel > length(whole) // 2), inserted FROM laid WHERE indel > 0""",
    ),
    "locus0": (
        ("diffs",),
        """SELECT ref, pos, count(*) AS num_diff, count_if(head) AS heads, count_if(base = 'X') AS dels,
             count_if(base = 'A') AS a, coalesce(sum(q) FILTER (base = 'A'), 0)::BIGINT AS aq,
             count_if(base = 'C') AS c, coalesce(sum(q) FILTER (base = 'C'), 0)::BIGINT AS cq,
             count_if(base = 'G') AS g, coalesce(sum(q) FILTER (base = 'G'), 0)::BIGINT AS gq,
             count_if(base = 'T') AS t, coalesce(sum(q) FILTER (base = 'T'), 0)::BIGINT AS tq
           FROM diffs GROUP BY ref, pos""",
    ),
    "loci": (
        ("locus0", "cov", "genome"),
        """SELECT l.*, coalesce(cov.depth, 0) AS depth, genome.base AS orig, heads / num_diff AS frac_head, aq + cq + gq + tq AS tot_q,
             concat_ws(',', CASE WHEN a > 0 AND base <> 'A' THEN base || '>A' END, CASE WHEN c > 0 AND base <> 'C' THEN base || '>C' END,
               CASE WHEN g > 0 AND base <> 'G' THEN base || '>G' END, CASE WHEN t > 0 AND base <> 'T' THEN base || '>T' END,
               CASE WHEN dels > 0 THEN '-' || base END) AS summary
           FROM locus0 l LEFT JOIN cov USING (ref, pos) JOIN genome USING (ref, pos)
           WHERE num_diff > 1 AND (greatest(aq, cq, gq, tq) >= 90 OR dels >= 3) AND heads / num_diff BETWEEN 0.1 AND 0.9""",
    ),
}

# Steps that several later ones read.
SHARED = {"chunks", "ext", "reads", "kept", "kmers", "exact", "leftover", "hits", "cands", "first_mates", "second_mates", "pairs", "best", "placed", "rows0", "base_rows", "cov", "diffs", "loci", "dense", "fuzzy0", "laid0", "laid"}


def sql(select: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the common table expressions for ``needs`` in front."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for dep in STEPS[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    ctes = [f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({STEPS[n][1]})" for n in order]
    ctes += [f"{n} AS MATERIALIZED ({body})" for n, body in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select
