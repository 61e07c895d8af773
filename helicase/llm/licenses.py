"""Licence detection with ordered signature rules.

A rule is a regular expression with a label, a keyword and a priority. A text meets only the rules whose keyword it
contains. A detection that lies inside one of at least its own priority is suppressed. Everything is DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrase and label of the plain detections.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, keyword, and a pattern for the name, all in lower case.
FAMILIES = [
    ("gpl", "gnu", r"gnu\s+general\s+public\s+licen[sc]e"),
    ("gpl", "gpl", r"(?<![al])gpl"),
    ("lgpl", "gnu", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e"),
    ("lgpl", "lgpl", r"lgpl"),
    ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e"),
    ("agpl", "agpl", r"agpl"),
    ("gfdl", "documentation", r"gnu\s+free\s+documentation\s+licen[sc]e"),
    ("apache", "apache", r"apache(?:\s+software)?\s+licen[sc]e"),
    ("apache", "asl", r"asl\s+2\.0"),
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("x11", "x11", r"x11"),
    ("bsd", "bsd", r"(?:(?:new|modified|simplified|revised|original|[0-4]-clause)\s+)?bsd"),
    ("isc", "isc", r"isc"),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[sc]e"),
    ("mpl", "mpl", r"mpl"),
    ("epl", "eclipse", r"eclipse\s+public\s+licen[sc]e"),
    ("epl", "epl", r"epl"),
    ("edl", "eclipse", r"eclipse\s+distribution\s+licen[sc]e"),
    ("cddl", "cddl", r"cddl"),
    ("cddl", "common", r"common\s+development\s+and\s+distribution\s+licen[sc]e"),
    ("cpl", "common", r"common\s+public\s+licen[sc]e"),
    ("cpal", "common", r"common\s+public\s+attribution\s+licen[sc]e"),
    ("artistic", "artistic", r"(?:perl\s+)?artistic"),
    ("zlib", "zlib", r"zlib(?:/libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("boost", "boost", r"boost\s+software"),
    ("boost", "bsl", r"bsl-1\.0"),
    ("busl", "business", r"business\s+source"),
    ("sspl", "server", r"server\s+side\s+public"),
    ("elastic", "elastic", r"elastic"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0", "cc0", r"cc0"),
    ("cc-by-nc-sa", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+sa"),
    ("cc-by-nc-nd", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+nd"),
    ("cc-by-nc", "cc", r"cc[\s-]+by[\s-]+nc"),
    ("cc-by-sa", "cc", r"cc[\s-]+by[\s-]+sa"),
    ("cc-by-nd", "cc", r"cc[\s-]+by[\s-]+nd"),
    ("cc-by", "cc", r"cc[\s-]+by"),
    ("cc-by", "commons", r"creative\s+commons\s+attribution"),
    ("cc-by-sa", "commons", r"creative\s+commons\s+attribution[\s-]+share[\s-]*alike"),
    ("cc-by-nc", "commons", r"creative\s+commons\s+attribution[\s-]+non[\s-]*commercial"),
    ("cc-by-nd", "commons", r"creative\s+commons\s+attribution[\s-]+no[\s-]*deriv(?:ative|ative\s+work)?s?"),
    ("odbl", "database", r"open\s+(?:data\s+commons\s+)?(?:open\s+)?database"),
    ("odc-by", "commons", r"open\s+data\s+commons\s+attribution"),
    ("pddl", "public", r"public\s+domain\s+dedication"),
    ("ofl", "font", r"(?:sil\s+)?open\s+font"),
    ("psf", "python", r"python\s+software\s+foundation"),
    ("php", "php", r"php"),
    ("ruby", "ruby", r"ruby"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ms-pl", "microsoft", r"microsoft\s+public"),
    ("ms-rl", "microsoft", r"microsoft\s+reciprocal"),
    ("eupl", "european", r"european\s+union\s+public"),
    ("osl", "open", r"open\s+software"),
    ("afl", "academic", r"academic\s+free"),
    ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/)?ncsa"),
    ("upl", "universal", r"universal\s+permissive"),
    ("ecl", "educational", r"educational\s+community"),
    ("mulan", "mulan", r"mulan\s+(?:permissive|psl)"),
]

NAMED = r"{n}\s+licen[sc]e"

#: What stands around a name, and the priority of a detection of that form. {n} is the name.
FORMS = [
    (r"spdx-licen[sc]e-identifier:\s*{n}(?:[-\s]?v?[0-9][0-9.]*)?(?:-only|-or-later|\+)?", 100),
    (r"licen[sc]ed\s+(?:to\s+\S+\s+)?under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{n}(?:\s+licen[sc]e)?(?:,?\s*(?:version|v\.?)?\s*[0-9][0-9.]*[0-9]?)?", 90),
    (r"(?:released|distributed|published|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{n}(?:\s+licen[sc]e)?(?:,?\s*(?:version|v\.?)?\s*[0-9][0-9.]*[0-9]?)?", 80),
    (r"{n}(?:\s+licen[sc]e)?,?\s+version\s*[0-9][0-9.]*[0-9]?", 70),
    (NAMED, 60),
]

#: Label, keyword, pattern and priority of rules that stand alone.
SINGLE = [
    ("public-domain", "public", r"(?:in|into|to)\s+the\s+public\s+domain", 60),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)\s*|©\s*)?[12][0-9]{3}", 20),
    ("all-rights-reserved", "rights", r"all\s+rights\s+reserved", 20),
    ("bsd", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 75),
    ("mit", "permission", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge", 75),
    ("isc", "permission", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute", 75),
    ("proprietary", "proprietary", r"proprietary\s+and\s+confidential", 50),
    ("no-warranty", "warrant", r"without\s+(?:any\s+)?warrant(?:y|ies)", 10),
    ("unknown-license", "licen", r"licen[sc]ed\s+under\s+(?:the\s+)?[a-z0-9][^\s]*", 5),
]

#: A text in which any rule or phrase matches has one of these; "cc" stands for the phrase, before a "by".
STEMS = (
    "licen", "copyright", "reserved", "domain", "redistribution", "permission", "proprietary", "warrant", "version", "released", "distributed", "published", "available", "provided",
)


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority), about three hundred."""
    edge = r"(?<![a-z0-9])", r"(?![a-z0-9])"
    out = []
    for label, key, name in FAMILIES:
        for form, p in FORMS:
            if form == NAMED and name.endswith("licen[sc]e"):
                form = "{n}"  # the name says it all
            out.append((label, key, edge[0] + form.format(n=f"(?:{name})") + edge[1], p))
    return out + [(label, key, edge[0] + pattern, p) for label, key, pattern, p in SINGLE]


def _gate(low: Column) -> Column:
    held = F.contains(low, F.lit("cc")) & F.regexp_like(low, F.lit(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))
    for stem in STEMS:
        held = F.contains(low, F.lit(stem)) | held
    return held


def _places(words: Column, phrase: str, label: str) -> Column:
    want = phrase.split()
    starts = F.transform(words, lambda w, i: F.when((w == want[0]) & (F.array_join(F.slice(words, i + 1, len(want)), " ") == phrase), i).otherwise(F.lit(-1)))
    return F.transform(F.filter(starts, lambda i: i >= 0), lambda i: F.named_struct(F.lit("label"), F.lit(label), F.lit("word"), i.cast("long")))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Detections of every row of `docs` (column text): the columns `keep` and, for each row,

    n_words; base array<struct<label, word>>: places (in words from 0) of the phrases of BASE; found array<struct<start,
    stop, label, rule, priority>>: what is left of the rules' detections, in characters of the lower-cased text. Nulls
    and empty texts have no words and no detections; repeated rows are repeated; an empty table gives none. Texts are
    never cut. Columns of `docs` that are not kept do not matter, whatever their names.

    Only a row's matches come together in one group, never those of several rows.
    """
    table = [{"rule": i, "label": r[0], "keyword": r[1], "pattern": r[2], "priority": r[3]} for i, r in enumerate(rules())]
    all_rules_type = "array<struct<rule:int,label:string,keyword:string,pattern:string,priority:int>>"
    all_rules = F.from_json(F.lit(json.dumps(table)), all_rules_type)
    held = F.struct(*keep).alias("__keep")
    rows = docs.select(held, F.coalesce("text", F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.select("__keep", "__row", F.regexp_count("__text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), F.lower("__text").alias("__low"))
    rows = rows.withColumn("__gated", _gate(F.col("__low")))
    tokens = F.when(F.col("__gated"), F.regexp_extract_all("__low", F.lit(f"({WORD})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__words", tokens)
    base = F.concat(*[_places(F.col("__words"), phrase, label) for phrase, label in BASE.items()])
    nothing = F.from_json(F.lit("[null]"), all_rules_type)
    used = F.when(F.col("__gated"), F.concat(nothing, F.filter(all_rules, lambda r: F.contains(F.col("__low"), r["keyword"])))).otherwise(nothing)
    rows = rows.select("__keep", "__row", "n_words", base.alias("base"), "__low", F.explode(used).alias("r"))
    at = F.arrays_zip(F.split("__low", F.col("r.pattern")).alias("piece"), F.regexp_extract_all("__low", F.col("r.pattern"), F.lit(0)).alias("match"))
    sizes = F.transform(at, lambda x: F.named_struct(F.lit("before"), F.length(x["piece"]), F.lit("size"), F.length(x["match"])))
    hits = F.when(F.col("r").isNotNull(), F.filter(sizes, lambda x: x["size"].isNotNull()))
    rows = rows.select("__keep", "__row", "n_words", "base", F.col("r.rule").alias("rule"), F.col("r.label").alias("label"), F.col("r.priority").alias("priority"), hits.alias("hits"))
    rows = rows.filter(F.col("rule").isNull() | (F.size("hits") > 0))  # the null rule keeps a row for each text
    rows = rows.select("__keep", "__row", "n_words", "base", "rule", "label", "priority", F.posexplode_outer("hits").alias("i", "h")).repartition("__row")
    run = Window.partitionBy("__row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("h.before") + F.col("h.size")).over(run)
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("h.size"))
    earlier = Window.partitionBy("__row").orderBy("start", F.desc("stop"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted({r["priority"] for r in table}):
        reach = F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(earlier)
        inside = inside | ((F.col("priority") == p) & (F.coalesce(reach, F.lit(-1)) >= F.col("stop")))
    rows = rows.withColumn("inside", inside)
    found = F.when(F.col("h").isNotNull() & ~F.col("inside"), F.struct("start", "stop", "label", "rule", "priority"))
    out = rows.groupBy("__row").agg(F.first("__keep").alias("k"), F.first("n_words").alias("n_words"), F.first("base").alias("base"), F.sort_array(F.collect_list(found)).alias("found"))
    return out.select("k.*", "n_words", "base", "found")
