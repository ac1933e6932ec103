"""License scans: whole texts by the digest of their canonical form.

The canonical form lower-cases A-Z, drops copyright notices, maps equivalent
spellings to one, and makes every run of anything but letters and digits one
space.  Licence wording stays wherever its lines break.  Its SHA-256 is joined to the digests of known licence texts, which are
made by the same expressions.  Groups repeat possessively, as Java's regular
expressions go one call deeper with each repetition of any other group.  A
holder of over 200 characters on a line, one of over 150 within a clause, or an
address of over 80 is not taken for one, so such a copy of a licence has
another digest.  Everything is DataFrame functions; the known
texts are a fixed list, so their side is broadcast, as is a table of up to
BROADCAST_DIGESTS known texts that a caller passes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.license_texts import variants

#: The rule of the query's SQL (whole lines), kept as given there; the operator drops `NOTICE`.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"

_SIGN = r"(?:\(c\)|©|&copy;)"
_YEAR = r"(?:(?:19|20)\d\d(?!\d)|[<\[{]\s*(?:year|yyyy|years)\s*[>\]}]|yyyy\b|19yy\b)"
#: How a licence begins when it follows a notice on the same line.
_OPENING = (
    r"(?:permission\s+(?:is|to)\b|redistribution\s+and\s+use|redistributions?\s+of|this\s+(?:software|program|library|file|work|source|is)\b|licensed\s+under"
    r"|released\s+under|everyone\s+is\s+permitted|the\s+software\s+is|all\s+rights\s+reserved|copyright\W{1,4}(?:c\)|©|(?:19|20)\d\d)|\(c\)|©|anyone\s+is\s+free"
    r"|(?:the\s+)?(?:mit|isc|zlib|bsd|apache|gnu|mozilla|modified|simplified|new|[234]\s*-?\s*clause)\s+(?:bsd\s+)?(?:license|licence|zero|general|lesser|library|public|[0-9]\s*-?\s*clause))"
)
#: Notices that licence texts themselves contain, wherever their lines break.
_INNER = (
    rf"copyright\s+{_SIGN}\s+(?:(?:19|20)\d\d[,\s-]*+)++free\s+software\s+foundation,?\s+inc\.?(?:\s*<https?://(?:www\.)?fsf\.org/>)?"
    r"(?:[,\s]*(?:51\s+franklin|59\s+temple|675\s+mass)[^<;]{0,80}?\busa\b)?"
    rf"|copyright\s+(?:{_SIGN}\s+)?(?:{_YEAR}|year\b|19xx\b)[\s,]*[<\[{{]?\s*(?:name\s+of\s+(?:the\s+)?(?:author|copyright\s+owner)|your\s+name)\s*[>\]}}]?"
    rf"|copyright\s+{_SIGN}[\s_]*_[\s_]*"
)
#: A holder: up to an opening or the line's end, or if neither is near, up to the sentence's end, or nothing.
_HOLDER = rf"(?:[^\r\n]{{0,200}}?(?<![\p{{L}}\p{{N}}])(?={_OPENING})|[^\r\n]{{0,200}}(?=[\r\n]|\z)|[^\r\n.]{{0,200}}\.(?=\s)|)"
#: Words after "copyright" that make it licence wording.
_WORDING = r"(?:and|or|in|of|on|to|is|as|by\s+law|for|the\s+software|notices?|holders?|owners?|laws?|interests?|statements?|licen[sc]es?|rights?|treat(?:y|ies)|acts?|protection|permissions?|disclaimers?|infringement|status|terms?|ownership|information|date|claims?)\b"
#: A notice: "copyright" and a sign or year, a sign and year, © and a holder, or a paragraph "Copyright Some Holder"; and "all rights reserved".
NOTICE = (
    rf"(?<![\p{{L}}\p{{N}}])(?:{_INNER}"
    rf"|(?:copyright[\s:,]*{_SIGN}|(?:copyright[\s:,]+(?:by\s+)?|\(c\)[\s:,]*(?:copyright[\s:,]*)?){_YEAR}|©|&copy;){_HOLDER}"
    rf"|(?<=\A[^\p{{L}}\p{{N}}]{{0,20}}|\n[ \t\r]{{0,20}}\n[^\p{{L}}\p{{N}}\n]{{0,20}})copyright[ \t]+(?!{_WORDING}){_HOLDER}"
    r"|all\s+rights\s+reserved(?![\p{L}\p{N}]))"
)
#: A caller's digests are broadcast only if there are no more than these.
BROADCAST_DIGESTS = 100_000
#: What every notice contains: other texts are not searched.
_MARKS = ("copyright", "(c)", "©", "&copy;", "reserved")

#: Spellings that count as the same, as words of the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("https", "http"),
)

#: What differs between copies of one licence (holders' names, clause numbers, addresses), in words of
#: the canonical form, and a phrase of the texts it holds for.
TEMPLATES = (
    (" redistributions of source code must ", r" (?:[1-4]|[abcd]|i{1,3}|iv|o) (?=(?:redistributions (?:of|in) |neither the name|all advertising materials ))", " "),
    (" redistributions of source code must ", r" neither the names? of .{1,150}? nor the names? of (?:its |their |his |her |any |other )*+contributors ", " neither the name of the holder nor the names of its contributors "),
    (" redistributions of source code must ", r" this software is provided by .{1,150}? as is and any ", " this software is provided by the holder as is and any "),
    (" redistributions of source code must ", r" in no event shall .{1,150}? be liable for any direct ", " in no event shall the holder be liable for any direct "),
    (" redistributions of source code must ", r" includes software developed by .{1,150}? neither the name", " includes software developed by the holder neither the name"),
    (" free software foundation ", r" (?:51 franklin|59 temple|675 mass) .{1,60}? usa ", " "),
)


def canonical(text: Column) -> Column:
    """The canonical form; null and blank texts give an empty string."""
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = reduce(or_, [t.contains(m) for m in _MARKS])
    t = F.when(marked, F.regexp_replace(t, NOTICE, " ")).otherwise(t)
    # two spaces between words, so that a word that follows its like is replaced, too
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for one, other in SPELLINGS:
        t = F.replace(t, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other} "))
    t = F.regexp_replace(t, " +", " ")
    return F.trim(_templates(t))


def _templates(t: Column) -> Column:
    for phrases in dict.fromkeys(p for p, _, _ in TEMPLATES):
        u = t
        for p, one, other in TEMPLATES:
            if p == phrases:
                u = F.regexp_replace(u, one, other)
        t = F.when(t.contains(phrases), u).otherwise(t)
    return t


def license_digests(texts: DataFrame) -> DataFrame:
    """(license_id, digest) of a table of known texts (license_id, text)."""
    return texts.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the known texts and their variants."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in variants()]))
    return license_digests(spark.range(1).select(rows.alias("r")).select("r.license_id", "r.text"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, n_canonical, license_id) for every row of `docs` (doc_id, text).

    `license_id` is null unless the whole text is a known licence; where two
    known texts have one digest, the smallest id holds.  Empty canonical forms
    match nothing and have a null digest.  Repeated rows stay; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    small = known is None or known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    known = known_licenses(docs.sparkSession) if known is None else known
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    known = F.broadcast(known) if small else known
    form = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("form"))
    digest = F.when(F.length("form") > 0, F.sha2("form", 256)).alias("digest")
    return form.select("doc_id", digest, F.length("form").cast("long").alias("n_canonical")).join(
        known, "digest", "left"
    ).select("doc_id", "digest", "n_canonical", "license_id")
