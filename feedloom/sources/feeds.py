"""Feed sources (S1-S3) and the podcast / episode projections."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_pub_date
from feedloom.functions.strings import empty_to_null, trim_ws
from feedloom.schemas import ATOM_SCHEMA, JSON_FEED_SCHEMA, RSS_CHANNEL_SCHEMA, RSS_ITEM_DDL, RSS_SCHEMA
from feedloom.sources.mixed import mixed_episodes, mixed_errors, mixed_podcasts, parse_mixed
from feedloom.sources.splits import SPLIT_BYTES, item_texts

XML_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
INVALID_FEED = "invalid feed XML"
NO_CHANNEL = "feed has no channel"
INVALID_ITEM = "invalid feed item"


class FeedTables(NamedTuple):
    podcasts: DataFrame
    episodes: DataFrame
    errors: DataFrame


def _s(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _first_nonempty(a: Column, arr: Column) -> Column:
    """``a`` unless empty, else the first element of ``arr`` ('' if none)."""
    return F.coalesce(empty_to_null(a), F.get(arr, 0), F.lit(""))


def parse_feeds(feeds: DataFrame, xml_col: str = "xml", url_col: str = "feed_url",
                dialect: str = "rss", items: bool = True) -> DataFrame:
    """(feed_url, xml) -> (feed_url, doc struct). A malformed feed yields a
    row with a NULL body and the original text in ``_corrupt_record``; it
    never fails the job. ``items=False`` reads the channel only (the parser
    still checks the whole document but builds no item rows)."""
    if dialect == "rss":
        doc = F.from_xml(F.col(xml_col), RSS_SCHEMA if items else RSS_CHANNEL_SCHEMA, XML_OPTS)
    elif dialect == "atom":
        doc = F.from_xml(F.col(xml_col), ATOM_SCHEMA, XML_OPTS)
    elif dialect == "json":
        doc = F.from_json(F.col(xml_col), JSON_FEED_SCHEMA,
                          {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    else:
        raise ValueError(f"unknown feed dialect {dialect!r}")
    return feeds.select(F.col(url_col).alias("feed_url"), doc.alias("doc"),
                        F.lit(dialect).alias("dialect"))


def _ok(dialect: str) -> Column:
    if dialect == "rss":
        return F.col("doc.channel").isNotNull()
    # atom and json: a malformed document keeps its text in _corrupt_record
    return F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull()


def podcasts(parsed: DataFrame, dialect: str = "rss") -> DataFrame:
    """One row per well-formed feed."""
    p = parsed.where(_ok(dialect))
    if dialect == "rss":
        c = F.col("doc.channel")
        return p.select("feed_url", _s(c["title"]).alias("title"),
                        trim_ws(_s(c["description"])).alias("description"),
                        F.col("feed_url").alias("url"),
                        _first_nonempty(c["itunes:author"], c["dc:creator"]).alias("author"),
                        F.coalesce(c["category"], F.array().cast("array<string>")).alias("categories"))
    if dialect == "atom":
        d = F.col("doc")
        return p.select("feed_url", _s(d["title"]).alias("title"),
                        trim_ws(_s(d["subtitle"])).alias("description"),
                        F.col("feed_url").alias("url"), _s(d["author"]["name"]).alias("author"),
                        F.coalesce(F.transform(d["category"], lambda x: x["_term"]),
                                   F.array().cast("array<string>")).alias("categories"))
    d = F.col("doc")
    return p.select("feed_url", _s(d["title"]).alias("title"),
                    trim_ws(_s(d["description"])).alias("description"),
                    F.col("feed_url").alias("url"), _s(F.get(d["authors"], 0)["name"]).alias("author"),
                    F.array().cast("array<string>").alias("categories"))


def _rss_item_columns(it: Column) -> list[Column]:
    """P3-P9 of one RSS item; absent values are empty."""
    pub = _s(it["pubDate"])
    return [
        _s(it["guid"]["_VALUE"]).alias("id"),
        _s(it["title"]).alias("title"),
        _s(F.get(it["enclosure"], 0)["_url"]).alias("audio_url"),
        pub.alias("pub_date"),
        parse_pub_date(pub).alias("published_at"),
        trim_ws(_s(it["description"])).alias("description"),
        _first_nonempty(it["itunes:author"], it["dc:creator"]).alias("author"),
        _s(it["itunes:duration"]).alias("duration"),
        (_s(it["itunes:explicit"]) == "yes").alias("explicit"),
        F.coalesce(it["category"], F.array().cast("array<string>")).alias("categories"),
        F.lit("").alias("transcript"),
        F.coalesce(F.size(it["enclosure"]), F.lit(0)).alias("enclosures"),
    ]


def episodes(parsed: DataFrame, dialect: str = "rss", podcast_title: bool = False) -> DataFrame:
    """One row per item, in feed order (``position`` from 0). Absent values
    are '' like the reference's zero values; ``enclosures`` counts the
    enclosures for the lenient policy. ``podcast_title`` carries the feed's
    title along, so per-podcast reports need no second parse and join."""
    title = F.col("doc.channel.title") if dialect == "rss" else F.col("doc.title")
    parsed = parsed.withColumn("podcast_title", _s(title))
    if dialect == "rss":
        items = parsed.where(_ok(dialect)).select(
            "feed_url", "podcast_title", F.posexplode(F.col("doc.channel.item")).alias("position", "it"))
        cols = _rss_item_columns(F.col("it"))
    elif dialect == "atom":
        items = parsed.where(_ok(dialect)).select(
            "feed_url", "podcast_title", F.posexplode(F.col("doc.entry")).alias("position", "it"))
        it = F.col("it")
        encl = F.filter(it["link"], lambda l: l["_rel"] == "enclosure")
        pub = F.coalesce(empty_to_null(it["published"]), _s(it["updated"]))
        cols = [
            _s(it["id"]).alias("id"), _s(it["title"]).alias("title"),
            _s(F.get(encl, 0)["_href"]).alias("audio_url"),
            pub.alias("pub_date"), parse_pub_date(pub).alias("published_at"),
            trim_ws(_s(it["summary"])).alias("description"),
            _s(it["author"]["name"]).alias("author"),
            _s(it["itunes:duration"]).alias("duration"),
            (_s(it["itunes:explicit"]) == "yes").alias("explicit"),
            F.coalesce(F.transform(it["category"], lambda x: x["_term"]),
                       F.array().cast("array<string>")).alias("categories"),
            F.lit("").alias("transcript"),
            F.coalesce(F.size(encl), F.lit(0)).alias("enclosures"),
        ]
    else:
        items = parsed.where(_ok(dialect)).select(
            "feed_url", "podcast_title", F.posexplode(F.col("doc.items")).alias("position", "it"))
        it = F.col("it")
        pub = _s(it["date_published"])
        cols = [
            _s(it["id"]).alias("id"), _s(it["title"]).alias("title"),
            _s(F.get(it["attachments"], 0)["url"]).alias("audio_url"),
            pub.alias("pub_date"), parse_pub_date(pub).alias("published_at"),
            trim_ws(F.coalesce(empty_to_null(it["content_text"]), _s(it["summary"]))).alias("description"),
            _s(F.get(it["authors"], 0)["name"]).alias("author"),
            _s(F.get(it["attachments"], 0)["duration_in_seconds"].cast("string")).alias("duration"),
            F.lit(False).alias("explicit"),
            F.coalesce(it["tags"], F.array().cast("array<string>")).alias("categories"),
            F.lit("").alias("transcript"),
            F.coalesce(F.size(it["attachments"]), F.lit(0)).alias("enclosures"),
        ]
    extra = ["podcast_title"] if podcast_title else []
    return items.select("feed_url", *extra, "position", *cols)


def feed_errors(parsed: DataFrame, dialect: str = "rss") -> DataFrame:
    """Feeds that could not be parsed: (feed_url, error, bytes)."""
    corrupt = F.col("doc._corrupt_record")
    bad = parsed.where(~_ok(dialect) | F.col("doc").isNull())
    return bad.select("feed_url",
                      F.when(corrupt.isNotNull() | F.col("doc").isNull(), F.lit(INVALID_FEED))
                      .otherwise(F.lit(NO_CHANNEL)).alias("error"),
                      F.coalesce(F.octet_length(corrupt), F.lit(0)).cast("bigint").alias("bytes"))


def read_feeds(feeds: DataFrame, xml_col: str = "xml", url_col: str = "feed_url",
               dialect: str = "rss") -> FeedTables:
    """Parse a table of feeds into podcasts, episodes and errors.
    ``dialect="auto"`` finds the dialect of each row by its root element."""
    if dialect == "auto":
        parsed = parse_mixed(feeds, xml_col, url_col)
        return FeedTables(mixed_podcasts(parsed), mixed_episodes(parsed), mixed_errors(parsed))
    channel = parse_feeds(feeds, xml_col, url_col, dialect, items=False)
    parsed = parse_feeds(feeds, xml_col, url_col, dialect)
    return FeedTables(podcasts(channel, dialect), episodes(parsed, dialect),
                      feed_errors(channel, dialect))


def read_feed_files(spark: SparkSession, path: str, dialect: str = "rss",
                    glob: str | None = None, recursive: bool = False) -> FeedTables:
    """One feed per file; the file path is the feed URL."""
    r = spark.read.option("wholetext", "true")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.format("text").load(path).select(F.col("_metadata.file_path").alias("feed_url"),
                                             F.col("value").alias("xml"))
    return read_feeds(raw, dialect=dialect)


def read_feed_items(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES,
                    glob: str | None = None) -> DataFrame:
    """S2 for very large single feeds: one row per item with its position and
    all fields of an episode.

    Files are read in byte ranges by many tasks (``sources.splits``); an item
    tag inside CDATA or a comment is text, ``<item/>`` is an item without
    fields. An error stays where it is: a malformed channel costs no item, and
    a malformed or unfinished item is a row with ``error`` set and its fields
    empty."""
    texts = item_texts(spark, path, split_bytes, glob)
    item = F.from_xml("xml", RSS_ITEM_DDL + ", _corrupt_record string", XML_OPTS)
    parsed = texts.select("feed_url", "position", "finished", item.alias("it"))
    # An item without any field is parsed to null, and so is no error by itself.
    bad = ~F.col("finished") | F.col("it._corrupt_record").isNotNull()
    return (parsed.withColumn("error", F.when(bad, F.lit(INVALID_ITEM)))
            .withColumn("it", F.when(~bad, F.col("it")))
            .select("feed_url", "position", *_rss_item_columns(F.col("it")), "error"))
