"""Canonical notations: two values are the same when their canonical texts are equal. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and signs that stand for "not known", in lower case.
NOT_KNOWN = ("", "-", "--", "–", "—", "?", ".", "null", "none", "nil", "nan", "n/a", "na", "n.a.", "#n/a", "unknown", "not known", "not available", "not stated", "undefined", "tbd", "ukjent", "ikke oppgitt", "ikke kjent", "ikke tilgjengelig", "uoppgitt", "mangler")

_BLANKS = r"[\s\p{Z}\u200B\u2060\uFEFF]+"


def squeeze(c: Column) -> Column:
    """Lower case, white space of any kind collapsed and trimmed, characters composed; null becomes ''."""
    v = F.coalesce(c, F.lit(""))
    # Only text beyond the Latin blocks can hold a combining mark or a compatibility letter.
    composed = F.when(v.rlike(r"[^\u0000-\u02FF]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), v, F.lit(False))).otherwise(v)
    return F.trim(F.regexp_replace(F.lower(composed), _BLANKS, " "))


def _number(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(s, r"^(nok|kr\.?) ?| ?(nok|kr\.?)$", ""), r"[ +]", "")
    t = (
        F.when(t.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d*)?$"), F.translate(t, ",.", "."))
        .when(t.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d*)?$"), F.translate(t, ",", ""))
        .when(t.rlike(r"^-?\d+,\d*$"), F.translate(t, ",", "."))
        .otherwise(t)
    )
    return F.when(t.contains("."), F.regexp_replace(t, r"(\.\d*?)0*$", "$1")).otherwise(t)


def canonical_value(c: Column) -> Column:
    """Canonical text of a claim value; '' for null and blank.

    Letter case, spacing, character composition and the writing of a number, amount, day, truth value or web
    address don't show. A day becomes yyyymmdd, so that an eight-digit amount needs no field name to stay equal
    to itself. The result is meant for comparison within one claim key only.
    """
    s = squeeze(c)
    return canonical_squeezed(s)


def canonical_squeezed(s: Column) -> Column:
    day = r"^(\d{4})-(\d\d)-(\d\d)([t ]00:00(:00([.,]0+)?)?( ?(z|utc|[+-]00:?00))?)?$"
    dmy = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    web = r"^(https?://\S+|www\.\S+|[^\s/@]+\.[a-z][^\s/@]+(/\S*)?)$"
    number = F.regexp_replace(_number(s), r"\.$", "")
    return (
        F.when(
            s.rlike(r"^(nok|kr|[+-]?\d)"),
            F.when(s.rlike(day), F.regexp_replace(s, day, "$1$2$3"))
            .when(s.rlike(dmy), F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\b(\d)\b", "0$1"), "/", "."), r"^(\d\d)\.(\d\d)\.(\d{4})$", "$3$2$1"))
            .when(s.rlike(r"^((nok|kr\.?) ?)?[+-]? ?\d[\d .,]*( ?(nok|kr\.?))?$"), number)
            .when(s.rlike(web), _web(s))
            .otherwise(s),
        )
        .when(s.isin("true", "yes", "ja", "sann"), F.lit("1"))
        .when(s.isin("false", "no", "nei", "usann"), F.lit("0"))
        .when(s.rlike(web), _web(s))
        .otherwise(s)
    )


def _web(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^(https?://)?(www\.)?", ""), r"(:80|:443)?/*$", "")


def instant(c: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 text with zone; null if it is none."""
    return F.unix_micros(F.expr("try_cast({} as timestamp)".format(_sql(c)))) if isinstance(c, str) else F.unix_micros(F.try_to_timestamp(c))


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def known(c: Column) -> Column:
    """True where a text is neither null nor blank nor a word for "not known"."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _BLANKS, " "))
    return ~s.isin(*NOT_KNOWN)


def flexible_day(c: Column) -> Column:
    """Date of an ISO, compact, dotted or ISO date-time text; null if it is none."""
    s = F.trim(c)
    iso = F.regexp_extract(s, r"^(\d{4}-\d\d-\d\d)([T ].*)?$", 1)
    compact = F.regexp_replace(F.regexp_extract(s, r"^(\d{8})([T ].*)?$", 1), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")
    dotted = F.regexp_replace(F.regexp_extract(F.regexp_replace(s, r"\b(\d)\b", "0$1"), r"^(\d\d[./]\d\d[./]\d{4})( .*)?$", 1), r"^(\d\d).(\d\d).(\d{4})$", "$3-$2-$1")
    text = F.when(iso != "", iso).when(compact != "", compact).when(dotted != "", dotted)
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else text.try_cast("date")
