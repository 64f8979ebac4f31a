"""Text functions as column expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without content for the support of claims.
STOPWORDS = (
    "the a an and or of for to in on with is are this that as by at from it its be can "
    "relevant supporting evidence source interest given using why matches match technology one sentence do not add"
).split()
#: Stems of legal and chemical wording, which no lay query has.
JARGON = (
    "derivativ", "substitut", "compositio", "heteroaryl", "bicyclic", "pyrazolo", "pyrimidin", "ionizable", "encapsulat", "endosomal",
    "method of", "disclosed", "comprising", "wherein", "embodiment",
)


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, of two characters at least."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def long_words(text: Column) -> Column:
    """Lower-case runs of four letters at least."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))


def urls(text: Column) -> Column:
    """Distinct addresses, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'https?://[^\s\])"]+'), F.lit(0)))


def content_terms(text: Column) -> Column:
    """Distinct words of three characters at least that are neither stop words nor in an address."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r'https?://[^\s\])"]+', " ")
    words = F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3)
    return F.array_except(words, F.array(*map(F.lit, STOPWORDS)))


def plain_title_words(title: Column) -> Column:
    """Lower-case words of a title, of four letters and hyphens at least, that are no jargon."""
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"[A-Za-z][A-Za-z\-]{3,}"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.rlike("(?i)" + "|".join(JARGON))), lambda w: F.lower(w))


def norm_query(query: Column) -> Column:
    """One space between words, and neither spaces nor quotation marks at the ends."""
    return strip(F.btrim(strip(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " ")), F.lit('"')))


def instructed(query: Column, task: str) -> Column:
    """A query as an instructed encoder sees it; documents go without the prefix."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def entity_key(name: Column) -> Column:
    """Lower-case words of letters, digits and underscores of any script, by one space."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " "), r"\s+", " "))


def surface_key(name: Column) -> Column:
    """Lower-case ASCII words by one space; other letters part words."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "), r"\s+", " "))


def hash_bucket(token: Column, buckets: int) -> Column:
    """The first four bytes of the token's SHA-256, modulo buckets."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)
