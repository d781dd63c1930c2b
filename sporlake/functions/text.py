"""Names, tokens, phones, mail addresses and postal addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms, the longest first (fixed values).
FORMS = ("ASA", "ANS", "NUF", "ENK", "STI", "BRL", "AS", "DA", "SA")
_FROM, _TO = "åäáàâéèêëíìîïöóòôüúùûñç", "aaaaaeeeeiiiioooouuuunc"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\u00A0]+", " "))


def folded_name(c: Column) -> Column:
    """Lower case, common letters without accents, ø as o, æ as ae, & as og, punctuation as space."""
    t = F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM + "ø", _TO + "o")
    t = F.replace(F.replace(t, F.lit("æ"), F.lit("ae")), F.lit("&"), F.lit(" og "))
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def tokens(c: Column, least: int = 2) -> Column:
    """Distinct folded tokens of at least that many letters, without legal forms."""
    forms = [f.lower() for f in FORMS]
    return F.array_distinct(F.filter(F.split(folded_name(c), " "), lambda t: (F.length(t) >= least) & ~t.isin(*forms)))


def legal_form(c: Column) -> Column:
    """Legal form at the end of a name, with or without dots; null if there is none."""
    last = F.upper(F.regexp_replace(F.element_at(F.split(collapse(c), " "), -1), r"[./]", ""))
    return F.when(last.isin(*FORMS), last)


def without_legal_form(c: Column) -> Column:
    return F.when(legal_form(c).isNotNull(), F.regexp_replace(collapse(c), r" ?[^ ]+$", "")).otherwise(collapse(c))


def phone(c: Column) -> Column:
    """+47 and pairs of digits for eight-digit numbers; other international numbers without blanks; else null."""
    d = F.regexp_replace(c, r"[^\d+]", "")
    d = F.regexp_replace(F.regexp_replace(d, r"^0047", "+47"), r"^\+470(\d{8})$", "+47$1")
    n = F.when(d.rlike(r"^\+47\d{8}$"), F.substring(d, 4, 8)).when(d.rlike(r"^[2-9]\d{7}$"), d)
    return F.when(n.isNotNull(), F.concat(F.lit("+47 "), F.regexp_replace(n, r"(\d\d)(\d\d)(\d\d)(\d\d)", "$1 $2 $3 $4"))).when(d.rlike(r"^\+?\d{8,}$"), d)


def email(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), t)


def address(c: Column) -> Column:
    """Struct of street, postal_code (four digits) and city of one-line addresses."""
    t = collapse(c)
    r = r"^(.*?),? *\b(\d{4}) +([^\d]+)$"
    hit = t.rlike(r)
    return F.struct(
        F.when(hit, F.nullif(F.regexp_extract(t, r, 1), F.lit(""))).otherwise(F.nullif(t, F.lit(""))).alias("street"),
        F.when(hit, F.regexp_extract(t, r, 2)).alias("postal_code"),
        F.when(hit, F.trim(F.regexp_extract(t, r, 3))).alias("city"),
    )
