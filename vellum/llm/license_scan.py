"""Licence scan by canonical digest; DataFrame functions only.

A text is a licence if its canonical form is that of a known one: lower case,
no copyright notices, no punctuation, one spelling of equivalent words. The hash
join compares whole texts; nothing is looked up by prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import let
from vellum.llm.license_texts import KNOWN
from vellum.session import has_at_most, union_all

#: Digests up to which the known table is broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000

# Spellings that licence matching guidelines treat as equal, as (pattern, word).
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("modelling", "modeling"), ("noncommercial", "non commercial"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("per cent", "percent"), ("owner s", "owners"), ("http", "https"),
]


_SIGN, _GAP = r"(?:\(c\)|©)", r"[^\p{L}\p{N}\n(©<\[{]{0,4}"
_TAB = r"[ \t\x0B\f\r]"
_YEARS = rf"(?:19|20)\d\d\b(?:{_TAB}*[-–,]{_TAB}*(?:(?:19|20)\d\d|\d\d|present|now)\b)*"
_BLANK = r"[<\[{][^\n<>\[\]{}]{1,60}[>\]}]"
# how a notice opens: "(c)" says so only beside "copyright" or a year, and inside a line only "copyright" with a year does
_OPENING = (
    rf"(?:^[^\p{{L}}\p{{N}}\n©]*(?:copyright\b{_GAP}(?:{_SIGN}{_GAP}(?:{_YEARS}|{_BLANK})?|{_YEARS}|{_BLANK}|by\b)"
    rf"|{_SIGN}{_GAP}(?:copyright\b{_GAP}(?:{_SIGN}{_GAP})?(?:{_YEARS}|{_BLANK}|by\b)?|{_YEARS})|©{_GAP}(?:{_BLANK}|by\b))"
    rf"|\bcopyright\b{_GAP}(?:{_SIGN}{_GAP})?{_YEARS})"
)
#: Code points of a holder at most; where neither a sentence, a line nor a grant says that it ends, only marker and years go.
HOLDER = 120
# The rule needs no looking around, so that any engine can apply it: (pattern, what is put before the groups kept, those groups).
#: The full stop of an abbreviation or initial ends no sentence, so it becomes a blank.
ABBREVIATION = r"(^|[^\p{L}\p{N}])((?:\p{L}\.)*(?:\p{L}|inc|ltd|corp|co|llc|jr|sr|dr|univ))\."
#: Words that open a grant, where a text flattened to one line goes on after the holder; the character MARK is put before them.
GRANT = rf"(\b(?:permission (?:is|to)\b|redistribution and use\b|licensed under\b|released under\b|all rights reserved\b|this (?:software|program|work|file|library|code)\b|copyright{_TAB}+(?:{_SIGN}|(?:19|20)\d\d)))"
MARK = "\x01"
NOTICE = (
    rf"{_OPENING}(?:[^\n]{{0,{HOLDER}}}?(?:\.(?:{_TAB}|$)|{MARK}|{_TAB}*$))?"
    rf"(?:\.?{_TAB}*{MARK}?all rights reserved\b\.?)?"
)
RESERVED = r"^\W*all rights reserved\W*$"


def canonical(text: Column) -> Column:
    """Case, copyright notices, punctuation, spellings and white space made equal; null stays null.

    Only the notice itself goes, not what follows it on its line; and lines
    that only say "all rights reserved". A text without any sign of either is
    not searched for them.
    """
    lines = "(?md)"  # a line ends at a line feed and nowhere else

    def without(said: Column) -> Column:
        kept = F.regexp_replace(said, ABBREVIATION, "$1$2 ")
        kept = F.regexp_replace(kept, GRANT, f"{MARK}$1")
        kept = F.regexp_replace(kept, lines + NOTICE, " ")
        return F.regexp_replace(kept, lines + RESERVED, " ")

    def plain(said: Column) -> Column:
        signs = said.contains("copyright") | said.contains("(c)") | said.contains("©") | said.contains("all rights reserved")
        return F.trim(F.regexp_replace(F.when(signs, without(said)).otherwise(said), r"[^\p{L}\p{N}]+", " "))

    return let(let(F.lower(text), plain), _one_spelling)


def _one_spelling(plain: Column) -> Column:
    """Equivalent words in one spelling; a text that holds none of them, found by one hash lookup per word, is done."""
    said = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for was, now in SPELLINGS:
        # blanks are doubled, so that neighbouring words do not share one
        said = F.replace(said, F.lit(f" {was.replace(' ', '  ')} "), F.lit(f" {now.replace(' ', '  ')} "))
    # of several words the longest has to be there
    told = sorted({max(was.split(), key=len) for was, _ in SPELLINGS})
    respelled = F.trim(F.replace(said, F.lit("  "), F.lit(" ")))
    return F.when(F.arrays_overlap(F.split(plain, " "), F.array(*[F.lit(w) for w in told])), respelled).otherwise(plain)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for null texts and texts without a letter or digit outside copyright notices."""
    return let(canonical(text), lambda form: F.when(form != "", F.sha2(form, 256)))


def known_digests(licenses: DataFrame, license_id: str = "license_id", text: str = "text") -> DataFrame:
    """(digest, license_id): the first id in order where two licences have one canonical form."""
    return (
        licenses.select(digest(F.col(text)).alias("digest"), F.col(license_id).alias("license_id")).filter(F.col("digest").isNotNull())
        .groupBy("digest").agg(F.min("license_id").alias("license_id"))
    )


def published(spark) -> DataFrame:
    """The built-in table of known licences."""
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def scan(texts: DataFrame, licenses: DataFrame, text: str = "text") -> DataFrame:
    """Add license_digest and license_id (null if unknown) to every row.

    The digest is computed where the text is read and the hash join is on it
    alone. The known table is broadcast behind a check of its size; beyond it
    both sides are shuffled by digest, and rows without a digest take no part
    in that. Null and letterless texts have no digest. Columns that carry an added name are
    replaced.
    """
    rows = texts.drop("license_digest", "license_id").withColumn("license_digest", digest(F.col(text)))
    known = known_digests(licenses).withColumnRenamed("digest", "__digest")
    if has_at_most(known, BROADCAST_DIGESTS):
        return rows.join(F.broadcast(known), F.col("license_digest") == F.col("__digest"), "left").drop("__digest")
    found = rows.filter("license_digest is not null").join(known, F.col("license_digest") == F.col("__digest"), "left").drop("__digest")
    return union_all(found, rows.filter("license_digest is null").withColumn("license_id", F.lit(None).cast("string")))


def scan_lines(texts: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, license_id) of every line that is a known licence as a whole."""
    lines = texts.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return scan(lines, licenses, "line").filter("license_id is not null").select("doc_id", "line_no", "license_id")
