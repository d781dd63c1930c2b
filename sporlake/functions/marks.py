"""Marks of companies in running text: roles, head counts, certificates, contacts; and ladders of labels by rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles and the words that name them, the first that fits counts (fixed values).
ROLES = {
    "CHAIR": ("styreleder", "styrets leder", "chair", "chairman", "chairperson"),
    "CEO": ("daglig leder", "administrerende direktør", "adm. dir", "managing director", "ceo", "chief executive"),
    "BOARD": ("styremedlem", "varamedlem", "board member"),
    "FOUNDER": ("grunnlegger", "medgrunnlegger", "founder", "co-founder"),
    "EXECUTIVE": ("cfo", "cto", "cmo", "finansdirektør", "driftsdirektør", "teknologidirektør"),
}
#: Standards and schemes a company may be certified by (fixed values).
CERTIFICATES = {"ISO 9001": r"iso\s*9001", "ISO 14001": r"iso\s*14001", "ISO 27001": r"iso\s*(iec\s*)?27001", "ISO 45001": r"iso\s*45001", "Miljøfyrtårn": r"milj(ø|oe)fyrt(å|aa)rn", "Svanemerket": r"svanemerke", "StartBANK": r"startbank", "Sentral godkjenning": r"sentral(t)? godkjen"}

#: Months in Norwegian and English.
MONTHS = {m: k for names in ("januar februar mars april mai juni juli august september oktober november desember", "january february march april may june july august september october november december") for k, m in enumerate(names.split(), 1)}


def ladder(rules: dict[str, Column], otherwise: str | None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise).cast("string")
    for name, rule in reversed(rules.items()):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def words_pattern(words: tuple[str, ...]) -> str:
    return r"(^|[^\p{L}\p{N}])(" + "|".join(w.replace(".", r"\.") for w in words) + r")($|[^\p{L}\p{N}])"


def role(text: Column) -> Column:
    """Kind of a role title: the first of ROLES that is named, else OTHER."""
    return ladder({name: F.lower(text).rlike(words_pattern(words)) for name, words in ROLES.items()}, "OTHER")


def head_counts(text: Column) -> Column:
    """Numbers of employees named in a text, in order: "12 ansatte", "1 200 employees"."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b(\d{1,3}(?:[ \x{A0}.]\d{3})+|\d{1,6}) (?:ansatte|medarbeidere|employees|people)\b"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[^\d]", "").cast("long"))


def certificates(text: Column) -> Column:
    """Names of certificates that a text has, in the order of CERTIFICATES."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in CERTIFICATES.items()]))


def phones(text: Column) -> Column:
    """Eight-digit numbers in a text, with or without country code, however grouped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:\+47|0047)[ \x{A0}]?\d(?:[ \x{A0}]?\d){7})(?:\D|$)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.substring(F.regexp_replace(x, r"\D", ""), -8, 8)))


def postal_towns(text: Column) -> Column:
    """Post codes with the town after them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r", (\d{4} [A-ZÆØÅ][a-zæøå]+)"), F.lit(1))


def day_pattern() -> str:
    return r"\b(\d{1,2})\.? (" + "|".join(sorted(MONTHS)) + r") (\d{4})\b"


def written_day(text: Column) -> Column:
    """The first day that a text writes out ("31. mars 2021"); null if it is none."""
    low = F.lower(text)
    part = lambda k: F.regexp_extract(low, day_pattern(), k)
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])[F.nullif(part(2), F.lit(""))]
    return F.try_make_timestamp(part(3).try_cast("int"), month, part(1).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
