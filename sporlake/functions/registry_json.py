"""Records of a company register as JSON bodies: entities, yearly accounts, roles and units, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the register's JSON (fixed values), as Spark schemas; what isn't declared isn't read.
ENTITY = """organisasjonsnummer string, navn string, organisasjonsform struct<kode: string>, antallAnsatte long, konkurs boolean, underAvvikling boolean, hjemmeside string,
 naeringskode1 struct<kode: string, beskrivelse: string>, forretningsadresse struct<kommune: string, kommunenummer: string>, postadresse struct<kommune: string, kommunenummer: string>, sisteInnsendteAarsregnskap string"""
ACCOUNTS = """array<struct<id: long, regnskapstype: string, regnskapsperiode: struct<fraDato: string, tilDato: string>, valuta: string,
 resultatregnskapResultat: struct<driftsresultat: struct<driftsinntekter: struct<sumDriftsinntekter: double>, driftsresultat: double>, ordinaertResultatFoerSkattekostnad: double, aarsresultat: double>,
 eiendeler: struct<sumEiendeler: double>, egenkapitalGjeld: struct<egenkapital: struct<sumEgenkapital: double>, gjeldOversikt: struct<sumGjeld: double>>>>"""
ROLES = """rollegrupper array<struct<type: struct<kode: string, beskrivelse: string>, sistEndret: string, roller: array<struct<type: struct<kode: string, beskrivelse: string>,
 person: struct<navn: struct<fornavn: string, mellomnavn: string, etternavn: string>>, enhet: struct<organisasjonsnummer: string, navn: string>, avregistrert: boolean>>>>"""
UNITS = "_embedded struct<underenheter: array<struct<organisasjonsnummer: string, navn: string, beliggenhetsadresse: struct<kommune: string>, postadresse: struct<kommune: string>, naeringskode1: struct<kode: string>, antallAnsatte: long>>>"


def entity(body: Column) -> Column:
    """Struct of a register entry; a body that is no JSON object gives nulls."""
    b = F.from_json(body, ENTITY)
    return F.struct(
        b["organisasjonsnummer"].alias("organisation_number"), b["navn"].alias("name"), b["organisasjonsform"]["kode"].alias("legal_form"), b["antallAnsatte"].alias("employees"), b["konkurs"].alias("bankrupt"), b["underAvvikling"].alias("liquidating"), b["hjemmeside"].alias("website"),
        b["naeringskode1"].alias("industry"), b["forretningsadresse"].alias("business_address"), b["postadresse"].alias("postal_address"), b["sisteInnsendteAarsregnskap"].alias("latest_submitted_accounts"),
    )


def _metrics(r: Column) -> list[Column]:
    result, debts = r["resultatregnskapResultat"], r["egenkapitalGjeld"]
    return [
        result["driftsresultat"]["driftsinntekter"]["sumDriftsinntekter"].alias("revenue"), result["driftsresultat"]["driftsresultat"].alias("operating_result"), result["ordinaertResultatFoerSkattekostnad"].alias("profit_before_tax"), result["aarsresultat"].alias("annual_result"),
        r["eiendeler"]["sumEiendeler"].alias("assets"), debts["egenkapital"]["sumEgenkapital"].alias("equity"), debts["gjeldOversikt"]["sumGjeld"].alias("debt"),
    ]


def account_records(body: Column, most: int = 3) -> Column:
    """Array of the first records of a body of yearly accounts; empty for any other body."""
    records = F.coalesce(F.from_json(body, ACCOUNTS), F.array().cast(ACCOUNTS))
    return F.transform(F.slice(records, 1, most), lambda r: F.struct(r["id"].alias("record_id"), r["regnskapstype"].alias("account_type"), r["regnskapsperiode"].alias("period"), r["valuta"].alias("currency"), *_metrics(r)))


def period(start: Column, end: Column) -> Column:
    """Struct of year (of the end, else of the start) and months (12 unless both days give 1 to 36)."""
    year = F.coalesce(F.nullif(F.regexp_extract(end, r"^(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(start, r"^(\d{4})", 1), F.lit(""))).cast("int")
    at = lambda c, i, n: F.substring(c, i, n).try_cast("int")
    months = (at(end, 1, 4) - at(start, 1, 4)) * 12 + at(end, 6, 2) - at(start, 6, 2) + 1
    return F.struct(year.alias("year"), F.when(months.between(1, 36), months).otherwise(12).alias("months"))


def statements(body: Column) -> Column:
    """All statements of a body, the newest year first, a company's own before its group's, then as delivered."""
    records = F.coalesce(F.from_json(body, ACCOUNTS), F.array().cast(ACCOUNTS))
    kind = lambda r: F.when(F.upper(F.coalesce(r["regnskapstype"], F.lit(""))).contains("KONSERN"), "KONSERN").otherwise("SELSKAP")

    def statement(r: Column, i: Column) -> Column:
        p = period(r["regnskapsperiode"]["fraDato"], r["regnskapsperiode"]["tilDato"])
        return F.struct((-F.coalesce(p["year"], F.lit(0))).alias("_year"), (kind(r) == "KONSERN").alias("_group"), i.alias("_at"), r["id"].alias("record_id"), kind(r).alias("account_type"), p["year"].alias("year"), p["months"].alias("months"), F.upper(F.coalesce(r["valuta"], F.lit("NOK"))).alias("currency"), *_metrics(r))

    return F.array_sort(F.transform(records, statement))


def account_years(body: Column, url: str) -> Column:
    """Struct of the distinct years of a body, rising, and the addresses of their documents, falling. url: with {year}."""
    years = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>")), lambda y: y.rlike(r"^\d+$"))))
    head, tail = url.split("{year}")
    return F.struct(years.alias("years"), F.transform(F.reverse(years), lambda y: F.struct(y.alias("year"), F.concat(F.lit(head), y, F.lit(tail)).alias("url"))).alias("documents"))


def roles(body: Column) -> Column:
    """Array of the roles of all groups: name of a person or else of an entity, codes, day of change, whether it has ended."""
    full = lambda n: F.nullif(F.concat_ws(" ", *[F.nullif(n[p], F.lit("")) for p in ("fornavn", "mellomnavn", "etternavn")]), F.lit(""))
    of = lambda g: F.transform(F.coalesce(g["roller"], F.array()), lambda r: F.struct(F.coalesce(full(r["person"]["navn"]), F.nullif(r["enhet"]["navn"], F.lit(""))).alias("name"), r["enhet"]["organisasjonsnummer"].alias("organisation_number"), r["type"]["kode"].alias("role_code"), r["type"]["beskrivelse"].alias("role"), g["type"]["kode"].alias("group_code"), g["type"]["beskrivelse"].alias("group"), g["sistEndret"].alias("last_changed"), F.coalesce(r["avregistrert"], F.lit(False)).alias("inactive")))
    return F.flatten(F.transform(F.from_json(body, ROLES)["rollegrupper"], of))


def units(body: Column) -> Column:
    """Array of the units of an entity; the postal address stands in for a missing one."""
    return F.transform(F.from_json(body, UNITS)["_embedded"]["underenheter"], lambda u: F.struct(u["organisasjonsnummer"].alias("organisation_number"), u["navn"].alias("name"), F.coalesce(u["beliggenhetsadresse"], u["postadresse"]).alias("address"), u["naeringskode1"].alias("industry"), u["antallAnsatte"].alias("employees")))
