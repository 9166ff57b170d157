"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelog.llm.common import ascii_lower

#: hex digits of the hash prefix that the join compares; the whole digest decides
PREFIX_DIGITS = 8
#: rules may have so many different shapes (labels of the host, characters of the path)
MOST_SHAPES = 4096


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, below the path that starts with ``path``."""

    host: str
    path: str
    verdict: str


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A short list of rules as a table ``(host, path, verdict)``."""
    schema = "array<struct<host:string,path:string,verdict:string>>"
    if not rules:
        return spark.range(0).select(F.inline(F.array().cast(schema)))
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules])))


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    # a host holds no '/', and a path starts with one or is empty or starts right behind the host
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per (host, path) with its digest; of contradicting rules the smaller verdict (allow) holds."""
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    rows = rules.where("host IS NOT NULL AND host != '' AND verdict IS NOT NULL").select(host.alias("host"), path.alias("path"), "verdict")
    one = rows.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(
        F.concat("host", "path").alias("rule"), "verdict", digest.alias("digest"), F.left(digest, F.lit(PREFIX_DIGITS)).alias("prefix"),
        _labels(F.col("host")).alias("labels"), F.length("path").alias("path_length"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    The longest rule that fits decides; a url that no rule fits gets ``default`` and
    a null rule. A null url, or one without ``://``, has an empty host and path and
    fits no rule. Rules are ``(host, path, verdict)``; rows without a host or verdict
    are no rules, a null path is empty. Repeated pages stay; other columns are not
    read; without rules every url gets ``default``.

    Different (host, path) pairs are expanded into the expressions that some rule
    could equal: for every shape (labels of the host, characters of the path) that
    occurs among the rules, the host's suffix of so many labels and the path's prefix of
    so many characters. Nothing else could match, so nothing is cut off. The
    expressions meet the rules in an equi-join on PREFIX_DIGITS hex digits of
    their SHA-256; the whole digest confirms. The shapes, a few integers that grow with
    the variety of the rules and not with their number or the pages, go through the
    driver; more than MOST_SHAPES raise an error.
    """
    ready = _prepared(rules)
    shapes = sorted((r[0], r[1]) for r in ready.select("labels", "path_length").distinct().limit(MOST_SHAPES + 1).collect())
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"the rules have more than {MOST_SHAPES} shapes")
    parsed = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not shapes:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    def expression(labels: int, length: int) -> Column:
        fits = (_labels(F.col("host")) >= labels) & (F.length("path") >= length)
        return F.when(fits, _digest(F.substring_index("host", ".", -labels), F.substring("path", 1, length)))

    places = parsed.where("host != ''").select("host", "path").distinct()
    expanded = places.select("host", "path", F.explode(F.array(*[expression(*s) for s in shapes])).alias("found")).where("found IS NOT NULL")
    expanded = expanded.withColumn("found_prefix", F.left("found", F.lit(PREFIX_DIGITS)))
    fits = expanded.join(ready.select("rule", "verdict", "digest", "prefix"), F.col("found_prefix") == F.col("prefix")).where("found = digest")
    longest = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    judged = parsed.join(longest, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
