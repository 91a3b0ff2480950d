"""Scalar column functions: references, URIs, names, predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from metasift.functions import rules

JOB_REF = r"^urn:li:dataJob:\(urn:li:dataFlow:\(([^,]+),([^,]+),([^)]+)\),([^)]+)\)$"
FLOW_REF = r"^urn:li:dataFlow:\(([^,]+),([^,]+),([^)]+)\)$"
DATASET_REF = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\)$"
S3_PATH = r"s3[an]?://[^\s\"'>,]+"
ABFSS_PATH = r"abfss?://[^\s\"'>,]+"
GCS_PATH = r"gs://[^\s\"'>,]+"
JDBC_URL = r"jdbc:[a-z]+://[^\s\"'>,]+"
HTTP_URL = r"https?://[^\s\"'>,]+"


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture group or null (``regexp_extract`` gives '' for no match)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches, case-insensitive."""
    return F.regexp_extract_all(c, F.lit("(?i)" + pattern), F.lit(group))


def find_first(c: Column, pattern: str) -> Column:
    """First match or null, case-insensitive."""
    return F.regexp_substr(c, F.lit("(?i)" + pattern))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when the text holds any of the plain words; one pass as an alternation."""
    return c.rlike("|".join(re.escape(w) for w in words))


def leading(values: Column, n: int | None) -> Column:
    """The first n elements, or all."""
    return values if n is None else F.slice(values, 1, n)


def first_nonblank(*cols: Column) -> Column:
    """First argument with non-space content, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def parse_urn(c: Column) -> Column:
    """Reference to struct(platform, environment, flow_id, job_id, kind), or null."""

    def form(pattern: str, kind: str, has_job: bool) -> Column:
        return F.when(
            c.rlike(pattern),
            F.struct(
                F.regexp_extract(c, pattern, 1).alias("platform"),
                F.regexp_extract(c, pattern, 3).alias("environment"),
                F.regexp_extract(c, pattern, 2).alias("flow_id"),
                (F.regexp_extract(c, pattern, 4) if has_job else F.lit(None).cast("string")).alias("job_id"),
                F.lit(kind).alias("kind"),
            ),
        )

    return F.coalesce(
        form(JOB_REF, "dataJob", True), form(FLOW_REF, "dataFlow", False), form(DATASET_REF, "dataset", False)
    )


def format_urn(u: Column) -> Column:
    """Inverse of :func:`parse_urn`."""
    flow = F.concat(
        F.lit("urn:li:dataFlow:("), u["platform"], F.lit(","), u["flow_id"], F.lit(","), u["environment"], F.lit(")")
    )
    return (
        F.when(u["kind"] == "dataJob", F.concat(F.lit("urn:li:dataJob:("), flow, F.lit(","), u["job_id"], F.lit(")")))
        .when(
            u["kind"] == "dataset",
            F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), u["platform"], F.lit(","), u["flow_id"],
                     F.lit(","), u["environment"], F.lit(")")),
        )
        .when(u["kind"] == "dataFlow", flow)
    )


def parse_arn(c: Column) -> Column:
    """ARN to struct(service, region, account_id, resource_id), or null."""
    p = F.split(c, ":", -1)
    resource = F.array_join(F.slice(p, 6, F.greatest(F.size(p) - 5, F.lit(1))), ":")
    ok = (F.size(p) >= 6) & (p[0] == "arn") & (F.try_element_at(p, F.lit(3)) != "") & (resource != "")
    return F.when(
        ok,
        F.struct(
            F.try_element_at(p, F.lit(3)).alias("service"),
            F.try_element_at(p, F.lit(4)).alias("region"),
            F.try_element_at(p, F.lit(5)).alias("account_id"),
            resource.alias("resource_id"),
        ),
    )


def urn_node_type(c: Column) -> Column:
    """Entity kind by prefix, ``dataset`` by default."""
    return (
        F.when(c.startswith("urn:li:dataJob:"), "dataJob")
        .when(c.startswith("urn:li:dataFlow:"), "dataFlow")
        .otherwise("dataset")
    )


def urn_platform(c: Column) -> Column:
    """Platform of a reference or ``unknown``."""
    return F.coalesce(parse_urn(c)["platform"], F.lit("unknown"))


def asset_name(c: Column) -> Column:
    """Text after the last ``||``."""
    return F.trim(F.element_at(F.split(c, r"\|\|", -1), -1))


def asset_cloud(c: Column) -> Column:
    """Upper-cased text before the first ``||``."""
    return F.upper(F.trim(F.split(c, r"\|\|", -1)[0]))


def endpoint_label(c: Column) -> Column:
    """Last path segment + ' API', or the text itself."""
    path = F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)
    return F.when(path.rlike("[^/]"), F.concat(last, F.lit(" API"))).otherwise(c)


def storage_uri(c: Column) -> Column:
    """First storage URI's struct(scheme, container, account)."""
    s3 = find_first(c, S3_PATH)
    ab = find_first(c, ABFSS_PATH)
    gs = find_first(c, GCS_PATH)
    none = F.lit(None).cast("string")
    return (
        F.when(s3.isNotNull(), F.struct(F.lit("s3").alias("scheme"),
                                        capture(s3, r"(?i)s3[an]?://([^/]+)").alias("container"),
                                        none.alias("account")))
        .when(ab.isNotNull(), F.struct(F.lit("abfss").alias("scheme"),
                                       capture(ab, r"(?i)abfss?://([^@]+)@").alias("container"),
                                       capture(ab, r"(?i)abfss?://[^@]+@([^./]+)").alias("account")))
        .when(gs.isNotNull(), F.struct(F.lit("gs").alias("scheme"),
                                       capture(gs, r"(?i)gs://([^/]+)").alias("container"),
                                       none.alias("account")))
    )


def jdbc_parts(c: Column) -> Column:
    """First JDBC URL's struct(engine, host, database, url)."""
    url = find_first(c, JDBC_URL)
    return F.when(
        url.isNotNull(),
        F.struct(
            capture(url, r"(?i)jdbc:([a-z]+)://").alias("engine"),
            capture(url, r"(?i)jdbc:[a-z]+://([^:/]+)").alias("host"),
            capture(url, r"/([^?/]+)$").alias("database"),
            url.alias("url"),
        ),
    )


def lambda_of_integration(c: Column) -> Column:
    """Function name inside an integration URI, or UNKNOWN."""
    return F.coalesce(capture(c, r"^.*function:([^/]*)"), F.lit("UNKNOWN"))


# Dataset type to file type.
FILE_TYPES = {"delimitedtext": "DelimitedText", "json": "JSON", "parquet": "Parquet"}


def normalize_file_type(c: Column) -> Column:
    """Known file type or null."""
    out = F.lit(None).cast("string")
    for k, v in FILE_TYPES.items():
        out = F.when(F.lower(F.trim(c)) == k, F.lit(v)).otherwise(out)
    return out


def normalize_node_id(c: Column) -> Column:
    """Lower, trim, drop a trailing number."""
    return F.regexp_replace(F.trim(F.lower(c)), r"_?\d+$", "")


def lookup_key(c: Column) -> Column:
    """Comparison key of a node or report name (F16)."""
    last = F.trim(F.element_at(F.split(c, r"\|\|", -1), -1))
    return F.lower(F.trim(F.regexp_replace(last, r"[^a-zA-Z0-9]+", " ")))


def slug(c: Column) -> Column:
    """Identifier of a label."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("node"))


def try_int(c: Column) -> Column:
    """Integer or null; zero counts as absent."""
    return F.nullif(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def text_param(c: Column, kind: str = "scalar") -> Column:
    """Parameter text: null to '', booleans lower case, lists comma-joined."""
    if kind == "list":
        return F.coalesce(F.array_join(c, ","), F.lit(""))
    if kind == "json":
        return F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def fill_template(c: Column, **values: Column) -> Column:
    """Replace ``{name}`` by its value."""
    for name, v in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), v)
    return c


EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def valid_email(c: Column) -> Column:
    """F20"""
    return c.rlike(EMAIL)


def valid_cron_shape(c: Column) -> Column:
    """Five or six fields."""
    return F.size(F.split(F.trim(c), r"\s+")).isin(5, 6)


def equals_loose(a: Column, b: Column, a_type: Column, b_type: Column) -> Column:
    """Trimmed, case-insensitive for strings; by value for numbers; else exact.

    ``a`` and ``b`` are JSON texts of leaves, the types tell how to compare them.
    """
    numeric = (a_type == "number") & (b_type == "number")
    string = (a_type == "string") & (b_type == "string")

    def bare(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, '^"|"$', "")))

    return (
        F.when(string, bare(a) == bare(b))
        .when(numeric, a.try_cast("double") == b.try_cast("double"))
        .otherwise((a_type == b_type) & a.eqNullSafe(b))
    )


def looks_like_notification(c: Column) -> Column:
    """F23"""
    return F.coalesce(F.lower(c), F.lit("")).rlike(rules.NOTIFICATION_WORDS)


def platform_label(hint: Column, raw_text: Column) -> Column:
    """Display name of the platform from a hint or the raw text."""
    h, t = F.lower(F.coalesce(hint, F.lit(""))), F.lower(raw_text)
    return (
        F.when((h == "adf") | t.contains("datafactory"), "Azure Data Factory")
        .when((h == "fabric") | t.contains("fabric"), "Microsoft Fabric")
        .when((h == "glue") | t.contains("glue"), "AWS Glue")
        .otherwise(F.nullif(hint, F.lit("")))
    )


def title_case(c: Column) -> Column:
    """Raise the first letter of every word, leave the rest as it is."""
    words = F.split(c, " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def clean_resource_name(c: Column) -> Column:
    """Drop hash suffixes, separators to spaces, title case."""
    return title_case(F.regexp_replace(F.regexp_replace(c, "(?i)-[a-f0-9]{8,}$", ""), "[_-]", " "))


def display_name(c: Column, width: int | None = None) -> Column:
    """Resource id to struct(title, subtitle); a plain title longer than ``width``, if given, is cut."""
    work = F.element_at(F.split(c, r" \|\| "), -1)
    cut = clean_resource_name(work)
    low = F.lower(c)
    kind = F.coalesce(*[F.when(low.contains(w), F.lit(label)) for w, label in rules.RESOURCE_LABELS],
                      F.lit("Lambda Function"))
    return (
        F.when(work.startswith("s3://"),
               F.struct(F.split(work, "/")[2].alias("title"), F.lit("S3 Bucket").alias("subtitle")))
        .when(work.contains(":"),
              F.struct(clean_resource_name(F.element_at(F.split(F.element_at(F.split(work, ":"), -1), "/"), -1))
                       .alias("title"),
                       F.upper(F.coalesce(F.nullif(F.try_element_at(F.split(work, ":"), F.lit(3)), F.lit("")),
                                          F.lit("service"))).alias("subtitle")))
        .otherwise(F.struct((cut if width is None else F.when(F.length(cut) > width, F.concat(F.substring(cut, 1, width - 2), F.lit("..."))).otherwise(cut))
                            .alias("title"), kind.alias("subtitle")))
    )


def substrings(c: Column, lengths: Column) -> Column:
    """Distinct substrings of ``c`` that have one of the given lengths.

    Turns "contains" into an equi-join: the searched words' lengths are few, so a text of
    n characters gives at most n keys per length.
    """
    usable = F.filter(lengths, lambda n: (n > 0) & (n <= F.length(c)))
    return F.array_distinct(F.flatten(F.transform(
        usable, lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, n)))))


def platform_by_name(name: Column, hint: Column) -> Column:
    """Platform of a pipeline: the hint, else words in its name, group by group."""
    low = F.lower(name)
    by_word = F.coalesce(*[F.when(contains_any(low, words), F.lit(p)) for p, words in rules.PLATFORM_WORDS],
                         F.lit("unknown"))
    return F.coalesce(F.lower(F.nullif(hint, F.lit(""))), by_word)


def template_for(name: Column, platform: str) -> Column:
    """Template whose key holds the name or lies within it; the first is the default."""
    keys = rules.TEMPLATE_KEYS[platform]
    low = F.lower(name)
    return F.coalesce(*[F.when(F.lit(k).contains(low) | low.contains(k), F.lit(k)) for k in keys], F.lit(keys[0]))
