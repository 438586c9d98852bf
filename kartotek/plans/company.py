"""From the nested register dump to flat company tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartotek.functions.text import as_text, first_number, last_status, leading_year, squeezed_lower
from kartotek.operators.cleaning import fill_text, where_all_null, without
from kartotek.operators.indexing import row_index, string_index
from kartotek.operators.nested import explode_rows, optional_path, project_paths, split_by_type
from kartotek.sources.tables import read_store, write_store

# Document types, their payload fields, and the columns they become.
PAYLOADS = {
    "virksomhed": ("Vrvirksomhed", "virksomhed"),
    "deltager": ("Vrdeltagerperson", "deltager"),
    "produktionsenhed": ("VrproduktionsEnhed", "prodenhed"),
}

_INDUSTRY = "struct<branchekode:string,branchetekst:string>"
COMPANY_TYPE = (
    "struct<cvrNummer:bigint,brancheAnsvarskode:int,reklamebeskyttet:boolean,"
    "virksomhedsstatus:array<struct<status:string,periode:struct<gyldigFra:string,gyldigTil:string>>>,"
    "virksomhedMetadata:struct<antalPenheder:bigint,sammensatStatus:string,stiftelsesDato:string,virkningsDato:string,"
    "nyesteAarsbeskaeftigelse:struct<aar:bigint,intervalKodeAntalAarsvaerk:string,intervalKodeAntalAnsatte:string,"
    "intervalKodeAntalInklusivEjere:string,sidstOpdateret:string>,"
    "nyesteKvartalsbeskaeftigelse:struct<aar:bigint,kvartal:bigint,intervalKodeAntalAarsvaerk:string,"
    "intervalKodeAntalAnsatte:string,sidstOpdateret:string>,"
    "nyesteMaanedsbeskaeftigelse:struct<aar:bigint,maaned:bigint,intervalKodeAntalAarsvaerk:string,"
    "intervalKodeAntalAnsatte:string,sidstOpdateret:string>,"
    "nyesteBeliggenhedsadresse:struct<bynavn:string,etage:string,husnummerFra:bigint,husnummerTil:bigint,"
    "kommune:struct<kommuneKode:bigint,kommuneNavn:string>,landekode:string,postboks:string,postnummer:bigint,"
    "vejkode:bigint,vejnavn:string>,"
    f"nyesteBibranche1:{_INDUSTRY},nyesteBibranche2:{_INDUSTRY},nyesteBibranche3:{_INDUSTRY},"
    f"nyesteHovedbranche:{_INDUSTRY},"
    "nyesteKontaktoplysninger:array<string>,nyesteNavn:struct<navn:string>,"
    "nyesteStatus:struct<kreditoplysningkode:bigint,statuskode:bigint>,"
    "nyesteVirksomhedsform:struct<ansvarligDataleverandoer:string,kortBeskrivelse:string,langBeskrivelse:string,"
    "sidstOpdateret:string,virksomhedsformkode:bigint>>>"
)
ENVELOPE_SCHEMA = (
    "_id string, _index string, _score long, _type string, "
    f"_source struct<Vrvirksomhed:{COMPANY_TYPE},Vrdeltagerperson:struct<enhedsNummer:bigint>,"
    "VrproduktionsEnhed:struct<pNummer:bigint>>, fields struct<_size:bigint>"
)

# Path below the company's metadata, and the column it becomes.
METADATA_PATHS = [
    ("antalPenheder", "nPenheder"),
    ("nyesteAarsbeskaeftigelse.aar", "aarsbeskfaar"),
    ("nyesteAarsbeskaeftigelse.intervalKodeAntalAarsvaerk", "aarsbeskfaarsvrk"),
    ("nyesteAarsbeskaeftigelse.intervalKodeAntalAnsatte", "aarsbeskfansat"),
    ("nyesteAarsbeskaeftigelse.intervalKodeAntalInklusivEjere", "aarsbeskfinkejer"),
    ("nyesteAarsbeskaeftigelse.sidstOpdateret", "aarsbeskefopdat"),
    ("nyesteBeliggenhedsadresse.bynavn", "by"),
    ("nyesteBeliggenhedsadresse.etage", "etage"),
    ("nyesteBeliggenhedsadresse.husnummerFra", "husnummerfra"),
    ("nyesteBeliggenhedsadresse.husnummerTil", "husnummertil"),
    ("nyesteBeliggenhedsadresse.kommune.kommuneKode", "kommunekode"),
    ("nyesteBeliggenhedsadresse.kommune.kommuneNavn", "kommunenavn"),
    ("nyesteBeliggenhedsadresse.landekode", "landkode"),
    ("nyesteBeliggenhedsadresse.postboks", "postboks"),
    ("nyesteBeliggenhedsadresse.postnummer", "postnummer"),
    ("nyesteBeliggenhedsadresse.vejkode", "vejkode"),
    ("nyesteBeliggenhedsadresse.vejnavn", "vejnavn"),
    ("nyesteBibranche1.branchekode", "branchekode1"),
    ("nyesteBibranche1.branchetekst", "branchetekst1"),
    ("nyesteBibranche2.branchekode", "branchekode2"),
    ("nyesteBibranche2.branchetekst", "branchetekst2"),
    ("nyesteBibranche3.branchekode", "branchekode3"),
    ("nyesteBibranche3.branchetekst", "branchetekst3"),
    ("nyesteHovedbranche.branchekode", "hovedbranchekode"),
    ("nyesteHovedbranche.branchetekst", "hovedbranchetekst"),
    ("nyesteKontaktoplysninger", "kontakt"),
    ("nyesteKvartalsbeskaeftigelse.aar", "kvarbeskfaar"),
    ("nyesteKvartalsbeskaeftigelse.kvartal", "kvarbeskfkvart"),
    ("nyesteKvartalsbeskaeftigelse.intervalKodeAntalAarsvaerk", "kvarbeskfaarsvrk"),
    ("nyesteKvartalsbeskaeftigelse.intervalKodeAntalAnsatte", "kvarbeskfansat"),
    ("nyesteKvartalsbeskaeftigelse.sidstOpdateret", "kvarbeskfopdat"),
    ("nyesteMaanedsbeskaeftigelse.aar", "mndbeskfaar"),
    ("nyesteMaanedsbeskaeftigelse.maaned", "mndbeskfkvart"),
    ("nyesteMaanedsbeskaeftigelse.intervalKodeAntalAarsvaerk", "mndbeskfaarsvrk"),
    ("nyesteMaanedsbeskaeftigelse.intervalKodeAntalAnsatte", "mndbeskfansat"),
    ("nyesteMaanedsbeskaeftigelse.sidstOpdateret", "mndbeskfopdat"),
    ("nyesteNavn.navn", "navn"),
    ("nyesteStatus.kreditoplysningkode", "kreditoplysningkode"),
    ("nyesteStatus.statuskode", "statuskode"),
    ("nyesteVirksomhedsform.ansvarligDataleverandoer", "ansvarligDataleverandoer"),
    ("nyesteVirksomhedsform.kortBeskrivelse", "kortBeskrivelse"),
    ("nyesteVirksomhedsform.sidstOpdateret", "formOpdateret"),
    ("nyesteVirksomhedsform.virksomhedsformkode", "virksomhedsformkode"),
    ("sammensatStatus", "sammensatStatus"),
    ("stiftelsesDato", "stiftelsesDato"),
    ("virkningsDato", "virkningsDato"),
]

# Columns left out of the yearly table, and text columns filled there.
YEARLY_LEFT_OUT = (
    "kvarbeskfaar kvarbeskfkvart kvarbeskfaarsvrk kvarbeskfansat kvarbeskfopdat mndbeskfaar mndbeskfkvart "
    "mndbeskfaarsvrk mndbeskfansat mndbeskfopdat hovedbranchetekst formOpdateret kommunenavn branchetekst1 "
    "branchetekst2 branchetekst3 by navn kontakt vejnavn"
).split()
YEARLY_FILLED = "by landkode vejnavn navn ansvarligDataleverandoer kortBeskrivelse sammensatStatus".split()
YEARLY_INDEXED = {
    "kortBeskrivelse": "indexKortBeskrivelse",
    "ansvarligDataleverandoer": "indexKortDataleverandoer",
    "landkode": "indexLandkode",
}

# Column order of the feature table, after the row number.
FEATURE_COLUMNS = (
    "cvrnummer nPenheder antalAnsatte branchekode1 branchekode2 branchekode3 hovedbranchekode statuskode "
    "virksomhedsBeskrivelse brancheAnsvarskode sammensatStatus virksomhedsformkode stiftelsesDato stiftelsesAar "
    "virksomhedsstatus reklamebeskyttet"
).split()


def companies(envelope: DataFrame) -> DataFrame:
    """The company documents of the dump, as one struct column ``virksomhed``."""
    return split_by_type(envelope, {"virksomhed": PAYLOADS["virksomhed"]})["virksomhed"]


def company_metadata(company_docs: DataFrame, keep_without_contact: bool = False) -> DataFrame:
    """One flat row per company and contact detail.

    Companies without contact details are left out unless asked for. A path that
    an inferred schema lacks gives a null column.
    """
    paths = [("virksomhed.cvrNummer", "cvrNummer")]
    paths += [(f"virksomhed.virksomhedMetadata.{path}", alias) for path, alias in METADATA_PATHS]
    flat = project_paths(company_docs, paths, missing_as_null=True)
    order = flat.columns
    return explode_rows(flat, "kontakt", keep_empty=keep_without_contact).select(*order)


def yearly_companies(metadata: DataFrame) -> DataFrame:
    """Companies that report by year only, without the columns that say nothing then; text gaps filled."""
    yearly = where_all_null(metadata, ["kvarbeskfaar", "mndbeskfaar"])
    return fill_text(without(yearly, YEARLY_LEFT_OUT), YEARLY_FILLED)


def indexed_companies(yearly: DataFrame) -> DataFrame:
    """The yearly table with the frequency index of its three text columns."""
    return string_index(yearly, YEARLY_INDEXED)


def typed_companies(company_docs: DataFrame) -> DataFrame:
    """One typed row per company: codes as text, numbers and years as int, statuses normalised.

    A path that an inferred schema lacks counts as missing.
    """

    def company(path: str, kind: str = "string"):
        return optional_path(company_docs, f"virksomhed.{path}", kind)

    def meta(path: str, kind: str = "string"):
        return company(f"virksomhedMetadata.{path}", kind)

    columns = {
        "cvrnummer": company("cvrNummer", "long"),
        "nPenheder": meta("antalPenheder", "long"),
        "antalAnsatte": first_number(meta("nyesteAarsbeskaeftigelse.intervalKodeAntalAnsatte")),
        "branchekode1": as_text(meta("nyesteBibranche1.branchekode")),
        "branchekode2": as_text(meta("nyesteBibranche2.branchekode")),
        "branchekode3": as_text(meta("nyesteBibranche3.branchekode")),
        "hovedbranchekode": as_text(meta("nyesteHovedbranche.branchekode")),
        "statuskode": as_text(meta("nyesteStatus.statuskode")),
        "virksomhedsBeskrivelse": as_text(meta("nyesteVirksomhedsform.langBeskrivelse")),
        "brancheAnsvarskode": as_text(company("brancheAnsvarskode")),
        "sammensatStatus": squeezed_lower(meta("sammensatStatus")),
        "virksomhedsformkode": meta("nyesteVirksomhedsform.virksomhedsformkode", "long"),
        "stiftelsesDato": meta("stiftelsesDato"),
        "stiftelsesAar": leading_year(meta("stiftelsesDato")),
        "virksomhedsstatus": last_status(company("virksomhedsstatus", "array<struct<status:string>>")),
        "reklamebeskyttet": company("reklamebeskyttet", "boolean").cast("int"),
    }
    return company_docs.select(*[columns[name].alias(name) for name in FEATURE_COLUMNS])


def feature_table(company_docs: DataFrame) -> DataFrame:
    """The typed rows numbered by company number; a hash of the row orders those without one or with the same."""
    return row_index(typed_companies(company_docs), ["cvrnummer", F.xxhash64(*FEATURE_COLUMNS)], "Index")


def store_register(dump: DataFrame, path: str) -> None:
    """The dump's documents stored by type, in one pass, so that each type can be read on its own.

    Only the payload of a document's own type is not null in its row; types that are not known are left out.
    """
    known = dump.filter(F.col("_type").isin(*PAYLOADS))
    payloads = [F.col(f"_source.{field}").alias(name) for field, name in PAYLOADS.values()]
    write_store(known.select("_id", "_type", *payloads), path, partition_by=["_type"])


def stored_type(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The payloads of one type from :func:`store_register`; other types' files are not read."""
    name = PAYLOADS[kind][1]
    return read_store(spark, path).filter(F.col("_type") == kind).select("_id", name)
