"""Invented raw records of the five sources, by hashes of (seed, source, number, field)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import RAW

#: Fields of work with their terms, and names.
AREAS = [
    ("oncology", ["EGFR inhibitor", "CAR-T", "PD-L1 antibody", "kinase", "tumor"]),
    ("immunology", ["monoclonal antibody", "cytokine", "T-cell", "autoimmune"]),
    ("neurology", ["amyloid", "neurodegeneration", "BBB penetrant", "tau"]),
    ("metabolic", ["GLP-1 agonist", "insulin", "lipid", "glucose transporter"]),
    ("antiviral", ["protease inhibitor", "RNA polymerase", "capsid", "vaccine"]),
]
ORGANIZATIONS = ["Purdue University", "MIT", "Stanford", "Pfizer", "Merck", "Genentech", "Broad Institute", "UCSF", "Novartis", "Eli Lilly"]
PEOPLE = ["A. Rivera", "S. Chen", "M. Okafor", "L. Novak", "P. Sharma", "J. Müller", "K. Tanaka", "R. Ahmed", "E. Rossi", "D. Park"]
CODES = ["A61K39/00", "A61P35/00", "C07K16/28", "C12N15/113", "A61K31/00"]


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


class Draw:
    """Draws for the record ``id`` of a source."""

    def __init__(self, source: str, seed: int):
        self.source, self.seed = source, seed

    def number(self, field: str, below: int) -> Column:
        text = F.concat_ws("|", F.lit(str(self.seed)), F.lit(self.source), F.col("id").cast("string"), F.lit(field))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % below

    def one(self, field: str, values: list[str]) -> Column:
        return F.get(strings(values), self.number(field, len(values)).cast("int"))

    def two(self, field: str, values: list[str]) -> Column:
        """Two different ones."""
        first, step = self.number(field, len(values)), self.number(field + "+", len(values) - 1) + 1
        return F.array(F.get(strings(values), first.cast("int")), F.get(strings(values), ((first + step) % len(values)).cast("int")))

    def key(self, low: int, high: int) -> Column:
        """The greater part of a record's native id; records may share one, as they do in the sources."""
        return (self.number("key", high - low) + low).cast("string")


def drawn(spark: SparkSession, source: str, n: int, seed: int) -> tuple[DataFrame, Draw]:
    """n numbers with an area and two of its terms."""
    d = Draw(source, seed)
    area = d.number("area", len(AREAS)).cast("int")
    rows = spark.range(n).withColumn("area", F.get(strings([a for a, _ in AREAS]), area))
    terms = F.get(F.array(*(d.two("term", t) for _, t in AREAS)), area)
    return rows.withColumn("t", terms.getItem(0)).withColumn("u", terms.getItem(1)), d


def said(*parts: str) -> Column:
    """Text with {area}, {t} and {u} as parts of their own."""
    return F.concat(*(F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts))


def clinicaltrials(spark: SparkSession, n: int, seed: int) -> DataFrame:
    rows, d = drawn(spark, "clinicaltrials", n, seed)
    key = F.concat(F.lit("NCT"), d.key(10_000_000, 99_999_999))
    section = F.struct(
        F.struct(key.alias("nctId"), said("A study of ", "{t}", " in ", "{area}").alias("briefTitle"), said("A phase 2 trial of ", "{t}", " for ", "{area}").alias("officialTitle")).alias("identificationModule"),
        F.struct(said("The trial investigates ", "{t}", " and ", "{u}", " as a strategy in ", "{area}", ".").alias("briefSummary")).alias("descriptionModule"),
        F.struct(F.struct(d.one("org", ORGANIZATIONS).alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(F.array(F.struct(F.concat(d.one("place", ORGANIZATIONS), F.lit(" Medical Center")).alias("facility"))).alias("locations")).alias("contactsLocationsModule"),
    )
    return rows.select(section.alias("protocolSection"), F.concat(F.lit("https://clinicaltrials.gov/study/"), key).alias("_source_url"))


def uspto(spark: SparkSession, n: int, seed: int) -> DataFrame:
    rows, d = drawn(spark, "uspto", n, seed)
    key = F.concat(F.lit("US"), d.key(8_000_000, 11_999_999), F.lit("B2"))
    return rows.select(
        key.alias("patent_id"), said("Methods for ", "{t}", " in ", "{area}").alias("patent_title"),
        said("Methods of use of ", "{t}", " in ", "{area}", " are described, optionally with ", "{u}", ".").alias("patent_abstract"),
        d.two("who", PEOPLE).alias("inventors"), F.array(d.one("org", ORGANIZATIONS)).alias("assignees"), d.two("cpc", CODES).alias("cpc_codes"),
        F.array("t", "u").alias("pharma_keywords"), F.concat(F.lit("https://patents.google.com/patent/"), key).alias("_source_url"),
    )


def openalex(spark: SparkSession, n: int, seed: int) -> DataFrame:
    rows, d = drawn(spark, "openalex", n, seed)
    words = F.split(said("An approach to ", "{area}", " by ", "{t}", " is reported. The role of ", "{u}", " is described in detail."), " ")
    places = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, places(w))))
    authors = F.transform(d.two("who", PEOPLE), lambda p: F.struct(F.struct(p.alias("display_name")).alias("author"), F.array(F.struct(d.one("org", ORGANIZATIONS).alias("display_name"))).alias("institutions")))
    return rows.select(
        F.concat(F.lit("https://openalex.org/W"), d.key(1_000_000_000, 4_999_999_999)).alias("id"), said("{t}", " in ", "{area}", ": a study").alias("title"), index.alias("abstract_inverted_index"),
        authors.alias("authorships"), F.array(F.struct(F.initcap("area").alias("display_name"))).alias("concepts"),
    )


def sbir(spark: SparkSession, n: int, seed: int) -> DataFrame:
    rows, d = drawn(spark, "sbir", n, seed)
    key = F.concat(F.lit("SBIR-"), d.key(100_000, 999_999))
    return rows.select(
        key.alias("award_id"), said("Commercial use of ", "{t}", " for ", "{area}").alias("award_title"), said("The project develops ", "{t}", " for an unmet need in ", "{area}", ".").alias("abstract"),
        d.one("org", ORGANIZATIONS).alias("firm"), d.one("who", PEOPLE).alias("pi_name"), F.concat(F.lit("https://www.sbir.gov/awards/"), key).alias("_source_url"),
    )


def autm(spark: SparkSession, n: int, seed: int) -> DataFrame:
    rows, d = drawn(spark, "autm", n, seed)
    key = F.concat(F.lit("AUTM-"), d.key(10_000, 99_999))
    return rows.select(
        key.alias("listing_id"), said("A platform of ", "{t}", " for ", "{area}").alias("tech_title"), said("University work on ", "{t}", " is open for licensing in ", "{area}", ".").alias("description"),
        d.one("org", ORGANIZATIONS).alias("university"), F.array(d.one("who", PEOPLE)).alias("inventors"), F.concat(F.lit("https://example.org/tech/"), key).alias("_source_url"),
    )


GENERATORS = {"clinicaltrials": clinicaltrials, "uspto": uspto, "openalex": openalex, "sbir": sbir, "autm": autm}


def generated(spark: SparkSession, n: int, seed: int = 5, sources: list[str] | None = None) -> dict[str, DataFrame]:
    """n raw records of each source, with the columns of its schema."""
    out = {}
    for source in sources or list(GENERATORS):
        rows = GENERATORS[source](spark, n, seed)
        out[source] = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW[source]))
    return out
