"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings no longer
count), and the digest of the entire form is hash-joined to the digests of known licences. Lines are looked up
the same way against known one-line notices, so that a document which carries a notice is found too. There is
no shuffle: the known digests are a fixed list of the module, far below any broadcast bound; a caller's own
list is broadcast only if its rows are counted and few.

Defined results: a null or empty text has the digest of the empty form and no licence; a null doc_id keeps its
row; repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .license_texts import NOTICES, TEXTS

#: Known texts beyond this many rows are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Lines that name the holder of the copyright; the line break before them stays.
COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|all rights reserved)[^\n]*"
#: ASCII other than letters, digits and line feed, and the usual typographic marks.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‘’“”–—«» ]+"
#: Equivalent spellings, applied in this order to a canonical form.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("honour", "honor"), ("fulfil ", "fulfill "), ("whilst", "while"), ("https", "http"), (" v 2 0", " version 2 0"), ("per cent", "percent"), ("gpl v", "gplv"),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form with line feeds kept; single spaces elsewhere, perhaps one beside a line feed."""
    c = ascii_lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT, "$1")
    c = F.regexp_replace(c, MARKS, " ")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def canonical(lines: Column) -> Column:
    return F.btrim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(form: Column) -> Column:
    return F.sha2(form, 256)


def text_digest(text: Column) -> Column:
    return digest(canonical(canonical_lines(text)))


def known_table(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), text_digest(F.lit(v)).alias("digest")) for k, v in texts.items()))
    return spark.range(1).select(F.inline(rows))


def license_scan(docs: DataFrame, known: DataFrame | None = None, notices: dict[str, str] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null: unknown), notice_ids (comma-joined, sorted), n_notices.

    known: license_id and text of the caller's own licences instead of the built-in ones.
    """
    if known is None:
        table_, small = known_table(docs.sparkSession, TEXTS), True
    else:
        table_ = known.select("license_id", text_digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
        small = table_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    by_digest = {v: k for k, v in notices.items()}
    folded = F.create_map(*(x for v, k in by_digest.items() for x in (text_digest(F.lit(v)), F.lit(k))))
    wanted = F.array(*(text_digest(F.lit(v)) for v in by_digest))
    # a notice's form is short: longer lines need no digest
    longest = max(len(v) for v in by_digest) * 2
    found = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("_lines"))
    short = F.filter(F.transform(F.split("_lines", "\n", -1), lambda x: F.btrim(x)), lambda x: (F.length(x) >= 4) & (F.length(x) <= longest))
    hits = F.array_intersect(F.transform(short, digest), wanted)
    found = found.select("doc_id", digest(canonical(F.col("_lines"))).alias("digest"), F.array_sort(F.transform(hits, lambda d: F.element_at(folded, d))).alias("_ids"))
    joined = found.join(F.broadcast(table_) if small else table_, "digest", "left")
    return joined.select("doc_id", "digest", "license_id", F.array_join("_ids", ",").alias("notice_ids"), F.size("_ids").cast("long").alias("n_notices"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _form_sql(c: str) -> str:
    s = f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    s = f"regexp_replace({s}, {_sql_string(COPYRIGHT)}, '\\1', 'g')"
    marks = MARKS.replace(r"‘’“”–—«» ", r"\x{2018}\x{2019}\x{201C}\x{201D}\x{2013}\x{2014}\x{00AB}\x{00BB}\x{00A0}")
    s = f"regexp_replace({s}, {_sql_string(marks)}, ' ', 'g')"
    for old, new in SPELLINGS:
        s = f"replace({s}, {_sql_string(old)}, {_sql_string(new)})"
    return s


def _values(texts: dict[str, str]) -> str:
    return ", ".join(f"({_sql_string(k)}, {_sql_string(v)})" for k, v in texts.items())


ORACLE = f"""
WITH whole AS (SELECT license_id, sha256(trim(regexp_replace({_form_sql('t')}, '[ \\n]+', ' ', 'g'), ' ')) AS digest FROM (VALUES {_values(TEXTS)}) v(license_id, t)),
notice AS (SELECT notice_id, sha256(trim(regexp_replace({_form_sql('t')}, '[ \\n]+', ' ', 'g'), ' ')) AS digest FROM (VALUES {_values(NOTICES)}) v(notice_id, t)),
forms AS (SELECT doc_id, {_form_sql('text')} AS form FROM documents),
lines AS (SELECT doc_id, sha256(trim(unnest(string_split(form, chr(10))), ' ')) AS digest FROM forms),
hits AS (SELECT doc_id, string_agg(notice_id, ',' ORDER BY notice_id) AS notice_ids, count(*) AS n FROM (SELECT DISTINCT doc_id, notice_id FROM lines JOIN notice USING (digest)) GROUP BY doc_id)
SELECT f.doc_id, f.digest, w.license_id, coalesce(h.notice_ids, '') AS notice_ids, coalesce(h.n, 0)::BIGINT AS n_notices
FROM (SELECT doc_id, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'), ' ')) AS digest FROM forms) f
LEFT JOIN whole w USING (digest) LEFT JOIN hits h USING (doc_id)
"""
