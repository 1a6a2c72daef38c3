"""Landed feed and API payloads as items (source_name, source_type, title, url, published_at, summary, bad, error).

A payload is landed as a file below a folder named source=<name>, so that Spark reads the source from the path, or, where
payloads are many and small, as a row of a table (see landed). Each is read whole, as one answer of one source, and parsed
by built-in functions. Bad payloads stop no other: one that can't be parsed becomes a row with bad = true and the parser's
message as error.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signalweave.functions.text import SPACE, or_text, parsed_time, stripped

ITEM = ("source_name", "source_type", "title", "url", "published_at", "summary", "bad", "error")
#: Entries of all kinds of feeds, without namespaces: RSS 2.0 has them in its channel, RSS 1.0 and 0.9 beside it, Atom calls them entries.
_ENTRY = "struct<title:string,link:array<struct<_VALUE:string,_href:string,_rel:string>>,description:string,summary:string,encoded:string,content:string,pubDate:string,published:string,updated:string,modified:string,issued:string,date:string>"
FEED = f"channel struct<item:array<{_ENTRY}>>, item array<{_ENTRY}>, entry array<{_ENTRY}>, _corrupt_record string"
RELEASES = "array<struct<name:string,tag_name:string,html_url:string,published_at:string,body:string>>"
REPOS = "struct<items:array<struct<full_name:string,html_url:string,created_at:string,description:string,stargazers_count:long>>>"
ADVISORIES = "array<struct<ghsa_id:string,cve_id:string,summary:string,description:string,html_url:string,url:string,published_at:string,severity:string>>"
ISSUES = "array<struct<title:string,html_url:string,created_at:string,body:string,pull_request:struct<url:string>>>"
#: Names of the one charset beside UTF-8 and UTF-16 that prologs give; every text of bytes can be read in it.
LATIN = ("ISO-8859-1", "LATIN1", "LATIN-1", "WINDOWS-1252")


@F.pandas_udf(StringType())
def _json_error(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        try:
            json.loads(text)
        except ValueError as e:
            return f"{type(e).__name__}: {e}"
        return "ValueError: the payload is not of the form that this source gives"

    return texts.map(one)


@F.pandas_udf(StringType())
def _xml_error(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        try:
            ElementTree.fromstring(text.encode())
        except (ElementTree.ParseError, ValueError) as e:
            return f"{type(e).__name__}: {e}"
        return "ValueError: the payload is no feed"

    return texts.map(one)


#: A folder of landed files, or a table of them.
Landed = str | DataFrame
#: Bytes of a row group of landed payloads. A reader holds the rows of one at most, however large the payloads are.
GROUP_BYTES = 8 << 20


def landed(rows: DataFrame, folder: str) -> DataFrame:
    """Payloads (source, path, content) as a written table below a folder, which readers take in place of a folder of files: its files are as few as its bytes ask for."""
    rows = rows.select(*[F.col(c).cast(t).alias(c) for c, t in (("source", "string"), ("path", "string"), ("content", "binary"))])
    rows.write.options(**{"compression": "zstd", "parquet.block.size": GROUP_BYTES}).mode("append").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def payloads(spark: SparkSession, path: Landed) -> DataFrame:
    """Rows (source, path, text): each payload's text as UTF-16 by its byte order mark, as Latin-1 where its prolog says so, else as UTF-8, with U+FFFD for what is none."""
    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path)
    files = files.select("path", "content", F.col("source").cast("string").alias("source"))
    latin = F.decode(F.substring("content", 1, 200), "ISO-8859-1")
    named = F.upper(F.regexp_extract(latin, r"""^[^<]*<\?xml[^>]*encoding=["']([A-Za-z0-9_-]+)["']""", 1))
    mark = F.hex(F.substring("content", 1, 2))
    wide = mark.isin("FFFE", "FEFF") & (F.length("content") % 2 == 0)
    text = F.when(wide, F.decode("content", "UTF-16")).when(named.isin(*LATIN), F.decode("content", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("source", "path", F.regexp_replace(text, "^\\x{FEFF}", "").alias("text"))


def _parsed(rows: DataFrame, found: Column, error: Callable[[Column], Column]) -> DataFrame:
    """Rows (source, r, error): one for each element of found, and one with a message where found is null. Only those are looked at for one."""
    rows = rows.select("source", "path", "text", found.alias("found"))
    good = rows.where("found IS NOT NULL").select("source", F.explode("found").alias("r"), F.lit(None).cast("string").alias("error"))
    bad = rows.where("found IS NULL").select("source", F.lit(None).cast(rows.schema["found"].dataType.elementType).alias("r"), error(F.coalesce("text", F.lit(""))).alias("error"))
    return good.unionByName(bad)


def _json(spark: SparkSession, path: Landed, schema: str) -> DataFrame:
    rows = payloads(spark, path)
    found = F.from_json("text", schema)
    return _parsed(rows, found["items"] if schema.startswith("struct") else found, _json_error)


def _feed(spark: SparkSession, path: Landed) -> DataFrame:
    """Entries of feeds of any kind, told by what a payload holds and not by where it lies."""
    x = F.from_xml("text", FEED, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    rows = payloads(spark, path).select("source", "path", "text", x.alias("x"))
    none = F.array().cast(f"array<{_ENTRY}>")
    all_ = F.concat(*[F.coalesce(F.col(c), none) for c in ("x.channel.item", "x.item", "x.entry")])
    fine = F.col("x").isNotNull() & F.col("x._corrupt_record").isNull() & F.rlike("text", F.lit(r"<(?:\w+:)?(?:rss|RDF|feed)[\s>]"))
    return _parsed(rows, F.when(fine, all_), _xml_error)


def _items(df: DataFrame, kind: str, sources: DataFrame | None, title: Column, url: Column, at: Column, summary: Column) -> DataFrame:
    """Items with the source's own address where one has none."""
    df = df.withColumn("source_name", F.col("source"))
    if sources is not None:
        df = df.join(sources.select(F.col("name").alias("s_name"), F.col("url").alias("s_url")), F.col("source_name") == F.col("s_name"), "left")
    else:
        df = df.withColumn("s_url", F.lit(None).cast("string"))
    link, bad = F.coalesce(F.nullif(stripped(url), F.lit("")), F.col("s_url")), F.col("error").isNotNull()
    good = lambda c: F.when(~bad, c)
    return df.select("source_name", F.lit(kind).alias("source_type"), good(title).alias("title"), good(link).alias("url"), good(at).alias("published_at"), good(summary).alias("summary"), bad.alias("bad"), "error")


def rfc822(c: Column) -> Column:
    """A feed's date without its weekday, which may be wrong; null where it is none. A numeric zone is applied."""
    text = F.regexp_replace(stripped(c), r"^[A-Za-z]{3},\s*", "")
    plain = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    zone = F.regexp_extract(text, r"([+-]\d{4})$", 1)
    minutes = F.when(zone == "", F.lit(0)).otherwise(F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")))
    return F.when(F.length(text) > 0, plain - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(minutes, F.lit(0))))


def _told(*fields: str) -> Column:
    """The first of the fields that holds a date of either form."""
    return F.coalesce(*[f(F.col(f"r.{c}")) for c in fields for f in (rfc822, parsed_time)])


def _link() -> Column:
    """The text of a link, else the address of the first that is an alternate one, else of the first."""
    links = F.col("r.link")
    plain = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    of = lambda found, field: F.nullif(stripped(F.get(found, F.lit(0))[field]), F.lit(""))
    return F.coalesce(of(F.filter(links, lambda x: F.length(F.trim(x["_VALUE"])) > 0), "_VALUE"), of(plain, "_href"), of(links, "_href"))


def _summary() -> Column:
    return F.coalesce("r.description", "r.summary", "r.encoded", "r.content")


def rss(spark: SparkSession, path: Landed, sources: DataFrame | None = None) -> DataFrame:
    """Entries of RSS 0.9, 1.0 and 2.0 and of Atom; one without a date of publication has the date of its last change."""
    return _items(_feed(spark, path), "rss", sources, or_text("r.title", "(untitled)"), _link(), _told("pubDate", "published", "issued", "updated", "modified", "date"), _summary())


def arxiv(spark: SparkSession, path: Landed, sources: DataFrame | None = None) -> DataFrame:
    """As rss(), with white space inside titles as single spaces."""
    title = F.regexp_replace(or_text("r.title", "(untitled)"), SPACE, " ")
    return _items(_feed(spark, path), "arxiv", sources, title, _link(), _told("published", "updated"), stripped(_summary()))


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def releases(spark: SparkSession, path: Landed, sources: DataFrame | None = None) -> DataFrame:
    title = F.coalesce(_filled("r.name"), _filled("r.tag_name"), F.lit("(unnamed release)"))
    return _items(_json(spark, path, RELEASES), "github_releases", sources, title, F.col("r.html_url"), parsed_time("r.published_at"), F.col("r.body"))


def repo_search(spark: SparkSession, path: Landed, prefix: str, kind: str = "github_new_repos", sources: DataFrame | None = None) -> DataFrame:
    title = F.concat(F.lit(f"{prefix}: "), F.coalesce(_filled("r.full_name"), F.lit("(unknown repo)")))
    return _items(_json(spark, path, REPOS), kind, sources, title, F.col("r.html_url"), parsed_time("r.created_at"), F.coalesce("r.description", F.lit("")))


def star_rises(spark: SparkSession, path: Landed, sources: DataFrame | None = None, snapshots: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Items for repositories with more stars than in their last snapshot (repo_full_name, stars, captured_at). One without a snapshot gives none: its first one is still to be taken."""
    df = _json(spark, path, REPOS).where("error IS NOT NULL OR (r.full_name IS NOT NULL AND r.full_name <> '')")
    known = spark.createDataFrame([], "repo string, before long") if snapshots is None else snapshots.groupBy(F.col("repo_full_name").alias("repo")).agg(F.max_by("stars", "captured_at").alias("before"))
    stars = F.coalesce("r.stargazers_count", F.lit(0))
    df = df.join(known, F.col("r.full_name") == F.col("repo"), "left").where(F.col("error").isNotNull() | (stars > F.col("before")))
    title = F.concat(F.col("r.full_name"), F.lit(" gained "), stars - F.col("before"), F.lit(" stars (now "), stars, F.lit(")"))
    return _items(df, "github_star_velocity", sources, title, F.col("r.html_url"), F.current_timestamp() if now is None else now, F.coalesce("r.description", F.lit("")))


def star_snapshots(spark: SparkSession, path: Landed, captured_at: Column) -> DataFrame:
    """Rows (repo_full_name, stars, captured_at) of a repository search, for the snapshot table."""
    df = _json(spark, path, REPOS)
    return df.where("r.full_name IS NOT NULL AND r.stargazers_count IS NOT NULL").select(F.col("r.full_name").alias("repo_full_name"), F.col("r.stargazers_count").alias("stars"), captured_at.alias("captured_at"))


def advisories(spark: SparkSession, path: Landed, sources: DataFrame | None = None) -> DataFrame:
    name = F.coalesce(_filled("r.ghsa_id"), _filled("r.cve_id"), F.lit("advisory"))
    said = F.coalesce(_filled("r.summary"), _filled("r.description"), F.lit("(no summary)"))
    title = F.substring(F.concat(F.lit("Advisory "), name, F.lit(": "), said), 1, 300)
    severity = F.when(F.length("r.severity") > 0, F.concat(F.lit("[severity: "), F.col("r.severity"), F.lit("] "))).otherwise("")
    return _items(_json(spark, path, ADVISORIES), "github_advisories", sources, title, F.coalesce(_filled("r.html_url"), F.col("r.url")), parsed_time("r.published_at"), F.concat(severity, F.coalesce(_filled("r.description"), said)))


def issues(spark: SparkSession, path: Landed, sources: DataFrame | None = None) -> DataFrame:
    title = F.concat(F.when(F.col("r.pull_request").isNotNull(), "[PR] ").otherwise("[issue] "), F.coalesce(_filled("r.title"), F.lit("(untitled issue)")))
    return _items(_json(spark, path, ISSUES), "github_changes", sources, title, F.col("r.html_url"), parsed_time("r.created_at"), F.substring(F.coalesce("r.body", F.lit("")), 1, 1000))


READERS: dict[str, Callable[..., DataFrame]] = {
    "rss": rss,
    "arxiv": arxiv,
    "github_releases": releases,
    "github_star_velocity": star_rises,
    "github_new_repos": lambda spark, path, sources=None: repo_search(spark, path, "New repo", "github_new_repos", sources),
    "github_advisories": advisories,
    "github_changes": issues,
}


def all_items(spark: SparkSession, folders: dict[str, Landed], sources: DataFrame, snapshots: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Items of the enabled sources: one reader for each source type that has a folder or a table, then a union. Rises of stars are told against snapshots, as of now."""
    live = sources.where("enabled").select(F.col("name").alias("live"))
    out: DataFrame | None = None
    for kind, path in folders.items():
        df = star_rises(spark, path, sources, snapshots, now) if kind == "github_star_velocity" else READERS[kind](spark, path, sources)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no folders")
    return out.join(live, F.col("source_name") == F.col("live"), "left_semi")
