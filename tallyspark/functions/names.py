"""Company and person names: normalising, keys, honorifics, slugs, names recovered from files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c

# Words that a company's name may have or lack, when names are compared loosely and when a title is matched with a roster.
LOOSE_WORDS = r"\b(?:plc|ltd|limited|holdings?|group|company|co|the|kenya)\b"
TITLE_WORDS = r"\b(?:plc|ltd|limited|holdings|group|kenya|company|the)\b"
# Honorifics and what they say about gender.
HONORIFIC_GENDER = {"mr": "Male", "mrs": "Female", "ms": "Female", "miss": "Female"}


def person_key(name) -> Column:
    """Lower case, punctuation as blanks, leading honorifics dropped."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(name), F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    return F.regexp_replace(s, r"^(?:(?:mr|mrs|ms|miss|dr|prof|hon)\s+)+", "")


def person_tokens(name) -> Column:
    """Distinct name words of two letters or more."""
    return F.array_distinct(F.filter(F.split(person_key(name), r"\s+"), lambda t: F.length(t) >= 2))


def full_key(name) -> Column:
    """Lower case, ``&`` as and, punctuation dropped, single blanks."""
    s = F.lower(F.replace(F.replace(F.coalesce(_c(name), F.lit("")), F.lit("&amp;"), F.lit("&")), F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N} ]+", " "), r"\s+", " "))


def company_key(name) -> Column:
    """The full key without the words a name may have or lack."""
    return F.trim(F.regexp_replace(F.regexp_replace(full_key(name), LOOSE_WORDS, " "), r"\s+", " "))


def title_key(name) -> Column:
    """A title's name as it is matched with a roster: without legal words, punctuation closed up."""
    s = F.regexp_replace(F.lower(F.replace(F.coalesce(_c(name), F.lit("")), F.lit("&amp;"), F.lit("&"))), TITLE_WORDS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N} ]", ""), r"\s+", " "))


def loose_company_key(name) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(company_key(name), r"[^\p{L}\p{N}]", "")


def honorific(name) -> Column:
    return F.lower(F.regexp_extract(F.trim(_c(name)), r"(?i)^(mr|mrs|ms|miss|dr|prof|eng|hon|amb|capt|sir|dame|cpa|fcpa)\b\.?", 1))


def gender_from_title(name) -> Column:
    """Male / Female only for Mr, Mrs, Ms and Miss; a doctor or professor says nothing."""
    table = F.create_map(*[F.lit(x) for p in HONORIFIC_GENDER.items() for x in p])
    return F.try_element_at(table, honorific(name))


def slug(name) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(name), F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def file_stem(path) -> Column:
    base = F.regexp_extract(F.coalesce(_c(path), F.lit("")), r"([^/\\?#]+)(?:[?#].*)?$", 1)
    return F.regexp_replace(base, r"\.[A-Za-z0-9]{1,5}$", "")


def name_from_file(path) -> Column:
    """Readable company name guess: stem without years, separators and report words."""
    s = F.regexp_replace(F.lower(file_stem(path)), r"[-_+.]|%20", " ")
    s = F.regexp_replace(s, r"\b(?:19|20)\d{2}\b|\b(?:annual|integrated|report|financial|statements|audited|results|fy|and|accounts)\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))
