"""Raw records of five sources in one schema."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

NONE = "array<string>"
FIELDS = ["doc_id", "source", "title", "abstract", "inventors", "organizations", "experts", "facilities", "cpc_codes", "keywords", "source_url", "retrieved_date"]


def text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def one(value: Column) -> Column:
    """The value in an array, if it is not empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.array(value)).otherwise(F.array().cast(NONE))


def full(values: Column) -> Column:
    """The values that are not empty; no array counts as empty."""
    return F.filter(F.coalesce(values.cast(NONE), F.array().cast(NONE)), lambda v: F.coalesce(v, F.lit("")) != "")


def record(df: DataFrame, source: str, key: Column, **columns: Column) -> DataFrame:
    lists = {"inventors", "organizations", "experts", "facilities", "cpc_codes", "keywords"}
    given = {"doc_id": F.concat(F.lit(f"{source}:"), key), "source": F.lit(source), **columns}
    day = text("_retrieved_date") if "_retrieved_date" in df.columns else F.lit("")
    given.setdefault("retrieved_date", day)
    given.setdefault("source_url", text("_source_url") if "_source_url" in df.columns else F.lit(""))
    return df.select(*(given.get(f, F.array().cast(NONE) if f in lists else F.lit("")).alias(f) for f in FIELDS))


def inverted_text(index: Column) -> Column:
    """The text of a map of words to places, by (place, word); null or empty: the empty text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def clinicaltrials(df: DataFrame) -> DataFrame:
    p = "protocolSection."
    return record(
        df, "clinicaltrials", text(p + "identificationModule.nctId"),
        title=F.coalesce(F.nullif(text(p + "identificationModule.briefTitle"), F.lit("")), text(p + "identificationModule.officialTitle")), abstract=text(p + "descriptionModule.briefSummary"),
        organizations=one(F.col(p + "sponsorCollaboratorsModule.leadSponsor.name")), facilities=full(F.col(p + "contactsLocationsModule.locations.facility")),
    )


def uspto(df: DataFrame) -> DataFrame:
    """inventors and assignees may be names, or objects as JSON text with a name under one of several keys."""

    def names(column: str, key: str) -> Column:
        def name(v: Column) -> Column:
            told = [F.get_json_object(v, f"$.{k}") for k in (key, "name")]
            both = strip(F.concat_ws(" ", F.get_json_object(v, "$.first"), F.get_json_object(v, "$.last")))
            return F.when(F.startswith(v, F.lit("{")), F.coalesce(*(F.nullif(t, F.lit("")) for t in told), both)).otherwise(v)

        return full(F.transform(F.coalesce(F.col(column), F.array().cast(NONE)), name))

    return record(df, "uspto", text("patent_id"), title=text("patent_title"), abstract=text("patent_abstract"), inventors=names("inventors", "inventor_name_last"), organizations=names("assignees", "assignee_organization"), cpc_codes=full(F.col("cpc_codes")), keywords=full(F.col("pharma_keywords")))


def openalex(df: DataFrame) -> DataFrame:
    people = full(F.col("authorships.author.display_name"))
    places = F.array_distinct(full(F.transform(F.flatten(F.col("authorships.institutions")), lambda x: x["display_name"])))
    return record(df, "openalex", F.element_at(F.split(text("id"), "/"), -1), title=text("title"), abstract=inverted_text(F.col("abstract_inverted_index")), experts=people, organizations=places, keywords=full(F.col("concepts.display_name")), source_url=text("id"))


def sbir(df: DataFrame) -> DataFrame:
    return record(df, "sbir", text("award_id"), title=text("award_title"), abstract=text("abstract"), organizations=one(F.col("firm")), experts=one(F.col("pi_name")))


def autm(df: DataFrame) -> DataFrame:
    return record(df, "autm", text("listing_id"), title=text("tech_title"), abstract=text("description"), organizations=one(F.col("university")), inventors=full(F.col("inventors")))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"clinicaltrials": clinicaltrials, "uspto": uspto, "openalex": openalex, "sbir": sbir, "autm": autm}


def embedding_text(title: Column, abstract: Column, keywords: Column, organizations: Column, cpc: Column) -> Column:
    """The non-empty parts by line: title, abstract, and labelled lists cut to 12, 6 and 8."""

    def listed(label: str, values: Column, most: int) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label + ": "), F.array_join(F.slice(values, 1, most), ", "))).otherwise(F.lit(""))

    return F.array_join(F.filter(F.array(strip(title), strip(abstract), listed("Keywords", keywords, 12), listed("Organizations", organizations, 6), listed("CPC", cpc, 8)), lambda x: x != ""), "\n")


def normalized(raw: dict[str, DataFrame], least: int = 20) -> DataFrame:
    """Documents of all given sources, in FIELDS and embedding_text; short abstracts are dropped.

    Of equal ids one record stays, the greatest by date and then by all its fields.
    """
    parts = [PARSERS[s](raw[s]) for s in PARSERS if s in raw]
    docs = reduce(DataFrame.unionByName, parts).filter(F.length(strip(F.col("abstract"))) >= least)
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("retrieved_date", *(f for f in FIELDS if f not in ("doc_id", "retrieved_date")))).alias("r")).select("doc_id", "r.*").select(FIELDS)
    return docs.withColumn("embedding_text", embedding_text(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("organizations"), F.col("cpc_codes")))


def dropped(raw: dict[str, DataFrame], least: int = 20) -> DataFrame:
    """(source, n, n_short): records by source, and those whose abstract is too short."""
    parts = [PARSERS[s](raw[s]).select("source", "abstract") for s in PARSERS if s in raw]
    short = F.length(strip(F.col("abstract"))) < least
    return reduce(DataFrame.unionByName, parts).groupBy("source").agg(F.count("*").alias("n"), F.count_if(short).alias("n_short"))
