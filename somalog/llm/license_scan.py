"""License scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, punctuation and white space,
equivalent spellings), and its SHA-256 is looked up among the digests of known licences, brought
to the same form. Units that are looked up are a document's whole text and each of its lines,
which is where documents carry one-line notices. The known texts are a table (license_id, text),
such as from_folder reads, or the built-in list of a few rows, whose digests are broadcast.

Defined results: a null text is empty, and empty units match nothing; rows are looked up one by
one, so repeated rows repeat; notices of rows that share doc_id and text are counted once a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somalog.llm.common import cut
from somalog.llm.license_texts import KNOWN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that claims copyright, with what stands before it in comments. A line that only begins
#: with the word (copyright notice, holder, owner, law ...) is a licence's own, as are list items (c).
CLAIM = (
    "(^|\n)[ \t#*/;-]*("
    "copyright(?![ \t\r]*($|\n))(?![ \t]+(notice|holder|owner|law|licen[cs]e|permission|statement|interest|status|disclaimer|protection|infringe|infring|treat|treaty|right|act|claim|and|or|on|in|of|is|are|for|to|under)(s|es|ing|ement|ies)?\\b)"
    "|\\(c\\)(?=[ \t]*(copyright|©)|[^\n]*\\b(19|20)[0-9]{2}\\b|[^\n]*all rights reserved)"
    "|©|all rights reserved)[^\n]*"
)
#: The same for one line, for engines whose patterns can't look ahead: what claims, and what doesn't though it begins so.
_LEAD = "^[ \t#*/;-]*"
LINE_CLAIMS = (f"{_LEAD}(©|all rights reserved)", f"{_LEAD}\\(c\\)([ \t]*(copyright|©)|.*\\b(19|20)[0-9]{{2}}\\b|.*all rights reserved)")
LINE_COPYRIGHT = f"{_LEAD}copyright"
LINE_NO_CLAIM = (
    f"{_LEAD}copyright[ \t\r]*$",
    f"{_LEAD}copyright[ \t]+(notice|holder|owner|law|licen[cs]e|permission|statement|interest|status|disclaimer|protection|infringe|infring|treat|treaty|right|act|claim|and|or|on|in|of|is|are|for|to|under)(s|es|ing|ement|ies)?\\b",
)
PUNCTUATION = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"
#: Spellings that count as the same, the second one kept (fixed values).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("honour", "honor"),
    ("http www", "https www"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful ", "willful "),
)


def canonical(text: Column) -> Column:
    """The form in which texts are compared."""
    text = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    text = F.regexp_replace(text, CLAIM, "\n")
    text = F.regexp_replace(text, PUNCTUATION, " ")
    for other, kept in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(kept))
    return F.trim(text)


def beginning(text: Column) -> Column:
    """The first three characters of a text's first word, which its canonical form has as well:
    equivalent spellings agree in them."""
    return F.translate(F.substring(F.regexp_extract(text, "[A-Za-z0-9\\x{80}-\\x{10FFFF}]+", 0), 1, 3), UPPER, LOWER)


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, text): a folder's text files, each named by its licence."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return files.select(F.regexp_replace("name", r"\.(?:txt|text|md)\z", "").alias("license_id"), "text")


def known_digests(spark: SparkSession, known: DataFrame | Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license_id, beginning): one row for each canonical form that is not empty."""
    if not isinstance(known, DataFrame):
        rows = F.array(*(F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in known))
        known = spark.range(1, numPartitions=1).select(F.inline(rows))
    texts = known.select("license_id", "text").withColumn("form", canonical(F.col("text"))).where("form <> ''")
    return texts.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(beginning(F.col("form"))).alias("beginning"))


def scan(docs: DataFrame, known: DataFrame | Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(doc_id, text_sha256, license_id, n_notices, notices): the digest of the whole text's
    canonical form, the licence it is (or null), how many lines are notices, and of which
    licences (in order, joined by commas; or null)."""
    digests = known_digests(docs.sparkSession, known)
    digests = cut(digests) if isinstance(known, DataFrame) else F.broadcast(digests)
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.xxhash64(text).alias("key"), F.sha2(canonical(F.col("text")), 256).alias("text_sha256"))
    whole = whole.join(digests.select(F.col("digest").alias("text_sha256"), "license_id"), "text_sha256", "left")
    begin = [r.beginning for r in digests.select("beginning").distinct().collect()]  # three characters each
    lines = docs.select("doc_id", F.xxhash64(text).alias("key"), F.posexplode(F.split(text, "\n"))).where(beginning(F.col("col")).isin(begin))
    found = lines.select("doc_id", "key", "pos", F.sha2(canonical(F.col("col")), 256).alias("digest")).join(digests, "digest")  # no known form is empty
    notices = found.groupBy("doc_id", "key").agg(F.countDistinct("pos").alias("n"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    same = whole["doc_id"].eqNullSafe(notices["doc_id"]) & (whole["key"] == notices["key"])
    return whole.join(notices, same, "left").select(whole["doc_id"], "text_sha256", "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), "notices")


def oracle_sql(known: Sequence[tuple[str, str]] = KNOWN) -> str:
    """The same in SQL, over a table documents."""

    def form(x: str) -> str:
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        x = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
        claims = " OR ".join(f"regexp_matches(line, {quoted(p)})" for p in LINE_CLAIMS)
        no_claim = " OR ".join(f"regexp_matches(line, {quoted(p)})" for p in LINE_NO_CLAIM)
        claims += f" OR (regexp_matches(line, {quoted(LINE_COPYRIGHT)}) AND NOT ({no_claim}))"
        x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda line: CASE WHEN {claims} THEN '' ELSE line END), chr(10))"
        x = f"regexp_replace({x}, {quoted(PUNCTUATION)}, ' ', 'g')"
        for other, kept in SPELLINGS:
            x = f"replace({x}, '{other}', '{kept}')"
        return f"trim({x})"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known)
    return f"""
WITH known AS (
    SELECT sha256({form("t")}) AS digest, min(name) AS license_id FROM (VALUES {values}) v(name, t) GROUP BY 1),
lines AS (
    SELECT DISTINCT doc_id, text, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
found AS (
    SELECT doc_id, text, count(DISTINCT i) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
    FROM (SELECT doc_id, text, i, {form("line")} AS f FROM lines) l JOIN known ON sha256(f) = digest WHERE f <> ''
    GROUP BY doc_id, text)
SELECT d.doc_id, sha256({form("d.text")}) AS text_sha256, k.license_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notices, f.notices
FROM documents d
LEFT JOIN known k ON k.digest = sha256({form("d.text")})
LEFT JOIN found f ON f.doc_id IS NOT DISTINCT FROM d.doc_id AND f.text IS NOT DISTINCT FROM d.text
"""
