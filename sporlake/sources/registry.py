"""Registry dumps: delimited text with alias columns, gzip or plain, to one typed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sporlake.functions.keys import org_digits

#: Source columns of each field, the first that is filled counts (fixed values; both cases of the first letter are tried).
ALIASES = {
    "organisation_number": ["organisasjonsnummer"],
    "name": ["navn"],
    "legal_form": ["organisasjonsform.kode"],
    "municipality": ["forretningsadresse.kommune"],
    "municipality_number": ["forretningsadresse.kommunenummer"],
    "industry_code": ["naeringskode1.kode", "næringskode1.kode"],
    "industry_label": ["naeringskode1.beskrivelse", "næringskode1.beskrivelse"],
    "website": ["hjemmeside"],
    "latest_submitted_accounts": ["sisteInnsendteAarsregnskap", "siste innsendte årsregnskap"],
    "registration_date": ["registreringsdatoenhetsregisteret", "registreringsdatoEnhetsregisteret", "registreringsdato i Enhetsregisteret"],
    "founding_date": ["stiftelsesdato"],
    "phone": ["telefon", "mobil"],
    "email": ["epostadresse"],
    "purpose": ["vedtektsfestetFormaal", "vedtektsfestet formål"],
    "activity": ["aktivitet"],
    "parent_organisation": ["overordnetEnhet", "overordnet enhet"],
    "secondary_industry_code": ["naeringskode2.kode", "næringskode2.kode"],
    "secondary_industry_label": ["naeringskode2.beskrivelse", "næringskode2.beskrivelse"],
}
_EMPTY_NOT_NULL = {"organisation_number", "name", "legal_form", "municipality", "municipality_number", "industry_code", "industry_label", "website", "latest_submitted_accounts"}
_NUMBERS = {"employees": ["antallAnsatte", "antall ansatte"], "capital_shares": ["kapital.antallAksjer", "kapital.antall aksjer"], "capital_amount": ["kapital.belop", "kapital.beløp"]}
_FLAGS = {"bankrupt": ["konkurs"], "liquidating": ["underAvvikling", "under avvikling"], "vat_registered": ["registrertIMvaRegisteret", "registrert i MVA-registeret"], "is_in_group": ["erIKonsern", "er i konsern"]}


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The commonest of ';', ',' and tab in the first line, read by Spark from wherever the dump is."""
    line = (spark.read.text(path).limit(1).head() or [""])[0]
    return max(";,\t", key=line.count)


def _cased(names: list[str]) -> list[str]:
    return [v for n in names for v in (n, n[:1].upper() + n[1:])]


def normalised(raw: DataFrame) -> DataFrame:
    """Canonical rows of a dump whose columns are text: unreadable numbers are null, addresses are null if empty."""
    have = set(raw.columns)

    def first(names: list[str]) -> Column:
        found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in _cased(names) if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def filled(name: str) -> Column:
        return F.coalesce(first(ALIASES[name]), F.lit("")) if name in _EMPTY_NOT_NULL else first(ALIASES[name])

    def address(prefix: str) -> Column:
        part = {k: first([f"{prefix}.{k}"]) for k in ("adresse", "postnummer", "poststed", "kommune")}
        land = F.coalesce(first([f"{prefix}.land", f"{prefix}.landkode"]), F.lit("Norge"))
        return F.when(F.coalesce(*part.values()).isNotNull(), F.struct(*[c.alias(k) for k, c in part.items()], land.alias("land")))

    flag = lambda n: F.lower(first(_FLAGS[n])) == "true"
    money = F.translate(first(_NUMBERS["capital_amount"]), ", ", ".").try_cast("double")
    capital = F.when(money.isNotNull(), F.struct(money.alias("amount"), F.coalesce(first(["kapital.valuta"]), F.lit("NOK")).alias("currency"), first(_NUMBERS["capital_shares"]).try_cast("long").alias("shares")))
    return raw.select(
        *[filled(n).alias(n) for n in ALIASES],
        first(_NUMBERS["employees"]).try_cast("long").alias("employees"),
        F.coalesce(flag("bankrupt"), F.lit(False)).alias("bankrupt"),
        F.coalesce(flag("liquidating"), F.lit(False)).alias("liquidating"),
        flag("vat_registered").alias("vat_registered"),
        flag("is_in_group").alias("is_in_group"),
        address("forretningsadresse").alias("business_address"),
        address("postadresse").alias("postal_address"),
        capital.alias("share_capital"),
    )


def read_registry(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Rows of nine-character keys. A gzip file can't be split, so what follows it is spread over the cluster."""
    raw = spark.read.csv(path, header=True, sep=sniff_delimiter(spark, path), quote='"', escape='"', encoding="UTF-8")
    first, *rest = raw.columns
    raw = raw.toDF(first.lstrip("\ufeff"), *rest)
    if path.endswith(".gz"):
        raw = raw.repartition(partitions or spark.sparkContext.defaultParallelism)
    return normalised(raw).where(F.length("organisation_number") == 9)


def lookup(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted keys in their order (column ord) with their registry rows; missing keys stay, with found false."""
    return wanted.join(registry.withColumn("found", F.lit(True)), "organisation_number", "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("ord")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """organisation_number, ord, evaluation_split, sample_slice of a list in JSON, JSON lines or text.

    Raises if a key hasn't nine digits or occurs twice.
    """
    none = F.lit(None).cast("string")
    if path.endswith((".json", ".jsonl", ".jsonl.gz")):
        d = spark.read.option("multiLine", path.endswith(".json")).json(path)
        if "organisation_numbers" in d.columns:
            d = d.select(F.explode("organisation_numbers").alias("organisation_number"))
        d = d.select("organisation_number", *[F.col(c) if c in d.columns else none.alias(c) for c in ("evaluation_split", "sample_slice")])
    else:
        d = spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("organisation_number"), none.alias("evaluation_split"), none.alias("sample_slice"))
    d = d.withColumn("ord", F.monotonically_increasing_id()).withColumn("organisation_number", org_digits(F.col("organisation_number").cast("string")))
    bad = d.agg(F.count_if(F.col("organisation_number").isNull()).alias("invalid"), (F.count("organisation_number") - F.countDistinct("organisation_number")).alias("repeated")).head()
    if bad["invalid"] or bad["repeated"]:
        raise ValueError(f"{bad['invalid']} keys without nine digits, {bad['repeated']} repeated keys")
    return d
