"""Feeds of any dialect in one table (S3): every row is routed by its root
element, parsed once, and brought to one shape.

RSS (0.9x and 2.0), RSS 1.0 (RDF), Atom and JSON Feed each have a schema; the
branch of a row is chosen by a conditional expression, so no row is parsed by
more than one of them. What cannot be read is an error of its row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_pub_date
from feedloom.functions.strings import empty_to_null, trim_ws
from feedloom.schemas import ATOM_SCHEMA, JSON_FEED_SCHEMA, RDF_SCHEMA, RSS_SCHEMA

XML_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
INVALID_FEED = "invalid feed XML"
INVALID_JSON = "invalid feed JSON"
NO_CHANNEL = "feed has no channel"
UNKNOWN_FEED = "unknown feed type"

#: Local name of the root element: declarations, comments and a document type may stand before it.
_ROOT = (r"(?s)^\uFEFF?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>\s*)*"
         r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)")
ROOTS = {"rss": "rss", "RDF": "rdf", "feed": "atom"}

_ITEM = ("id", "title", "audio_url", "pub", "description", "author", "duration", "explicit", "categories", "enclosures")


def dialect_of(text: Column) -> Column:
    """rss, rdf, atom or json by how a text begins; null for anything else."""
    root = F.regexp_extract(text, _ROOT, 1)
    out = F.when(F.ltrim(F.substring(text, 1, 64)).rlike(r"^\uFEFF?\s*\{"), F.lit("json"))
    for name, dialect in ROOTS.items():
        out = out.when(root == name, F.lit(dialect))
    return out


def _s(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _first(*values: Column) -> Column:
    """The first value that is not empty."""
    return F.coalesce(*[empty_to_null(v) for v in values], F.lit(""))


def _list(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _shape(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _podcast(title: Column, description: Column, author: Column, categories: Column) -> Column:
    return _shape(title=_s(title), description=_s(description), author=author, categories=_list(categories))


def _item(**fields: Column) -> Column:
    return _shape(**{k: fields[k] for k in _ITEM})


def _rss(doc: Column) -> tuple[Column, Column]:
    c = doc["channel"]
    return (_podcast(c["title"], c["description"], _first(c["itunes:author"], F.get(c["dc:creator"], 0)), c["category"]),
            F.transform(c["item"], lambda it: _item(
                id=_s(it["guid"]["_VALUE"]), title=_s(it["title"]), audio_url=_s(F.get(it["enclosure"], 0)["_url"]),
                pub=_s(it["pubDate"]), description=_s(it["description"]),
                author=_first(it["itunes:author"], F.get(it["dc:creator"], 0)), duration=_s(it["itunes:duration"]),
                explicit=_s(it["itunes:explicit"]) == "yes", categories=_list(it["category"]),
                enclosures=F.coalesce(F.size(it["enclosure"]), F.lit(0)))))


def _rdf(doc: Column) -> tuple[Column, Column]:
    """An item's identity is its guid, else what it is about."""
    c = doc["channel"]
    return (_podcast(c["title"], c["description"], _first(c["itunes:author"], F.get(c["dc:creator"], 0)), c["dc:subject"]),
            F.transform(doc["item"], lambda it: _item(
                id=_first(it["guid"]["_VALUE"], it["_rdf:about"]), title=_s(it["title"]),
                audio_url=_first(F.get(it["enclosure"], 0)["_url"], F.get(it["enc:enclosure"], 0)["_rdf:resource"]),
                pub=_first(it["pubDate"], F.get(it["dc:date"], 0)), description=_s(it["description"]),
                author=_first(it["itunes:author"], F.get(it["dc:creator"], 0)), duration=_s(it["itunes:duration"]),
                explicit=_s(it["itunes:explicit"]) == "yes", categories=_list(it["dc:subject"]),
                enclosures=F.coalesce(F.size(it["enclosure"]), F.lit(0)) + F.coalesce(F.size(it["enc:enclosure"]), F.lit(0)))))


def _atom(doc: Column) -> tuple[Column, Column]:
    def item(it: Column) -> Column:
        audio = F.filter(it["link"], lambda x: x["_rel"] == "enclosure")
        return _item(id=_s(it["id"]), title=_s(it["title"]), audio_url=_s(F.get(audio, 0)["_href"]),
                     pub=_first(it["published"], it["updated"]), description=_s(it["summary"]),
                     author=_s(it["author"]["name"]), duration=_s(it["itunes:duration"]),
                     explicit=_s(it["itunes:explicit"]) == "yes",
                     categories=_list(F.transform(it["category"], lambda x: x["_term"])),
                     enclosures=F.coalesce(F.size(audio), F.lit(0)))
    return (_podcast(doc["title"], doc["subtitle"], _s(doc["author"]["name"]),
                     F.transform(doc["category"], lambda x: x["_term"])), F.transform(doc["entry"], item))


def _json(doc: Column) -> tuple[Column, Column]:
    return (_podcast(doc["title"], doc["description"], _s(F.get(doc["authors"], 0)["name"]), F.lit(None).cast("array<string>")),
            F.transform(doc["items"], lambda it: _item(
                id=_s(it["id"]), title=_s(it["title"]), audio_url=_s(F.get(it["attachments"], 0)["url"]),
                pub=_s(it["date_published"]), description=_first(it["content_text"], it["summary"]),
                author=_s(F.get(it["authors"], 0)["name"]),
                duration=_s(F.get(it["attachments"], 0)["duration_in_seconds"].cast("string")),
                explicit=F.lit(False), categories=_list(it["tags"]),
                enclosures=F.coalesce(F.size(it["attachments"]), F.lit(0)))))


_SHAPES = {"rss": (RSS_SCHEMA, _rss), "rdf": (RDF_SCHEMA, _rdf), "atom": (ATOM_SCHEMA, _atom), "json": (JSON_FEED_SCHEMA, _json)}


def parse_mixed(feeds: DataFrame, xml_col: str = "xml", url_col: str = "feed_url") -> DataFrame:
    """(feed_url, dialect, podcast, items, error, bytes): one row a feed, each
    parsed once. ``error`` is null exactly where ``podcast`` is not."""
    text = F.col("_text")
    rows = feeds.select(F.col(f"`{url_col}`").alias("feed_url"), F.col(f"`{xml_col}`").cast("string").alias("_text"))
    rows = rows.withColumn("dialect", dialect_of(text))
    podcast, items, error = None, None, F.when(F.col("dialect").isNull(), F.lit(UNKNOWN_FEED))
    for dialect, (schema, shape) in _SHAPES.items():
        mine = F.col("dialect") == dialect
        doc = F.from_json(text, schema, XML_OPTS) if dialect == "json" else F.from_xml(text, schema, XML_OPTS)
        rows = rows.withColumn(f"_{dialect}", F.when(mine, doc))
        got = F.col(f"_{dialect}")
        error = error.when(mine & (got.isNull() | got["_corrupt_record"].isNotNull()),
                           F.lit(INVALID_JSON if dialect == "json" else INVALID_FEED))
        if dialect in ("rss", "rdf"):
            error = error.when(mine & got["channel"].isNull(), F.lit(NO_CHANNEL))
        own, its = shape(got)
        podcast = own if podcast is None else F.when(mine, own).otherwise(podcast)
        items = its if items is None else F.when(mine, its).otherwise(items)
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    return rows.select("feed_url", "dialect", F.when(good, podcast).alias("podcast"), F.when(good, items).alias("items"),
                       "error", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))


def mixed_podcasts(parsed: DataFrame) -> DataFrame:
    return (parsed.where("error IS NULL")
            .select("feed_url", "dialect", F.col("podcast.title"), trim_ws("podcast.description").alias("description"),
                    F.col("feed_url").alias("url"), F.col("podcast.author"), F.col("podcast.categories")))


def mixed_episodes(parsed: DataFrame) -> DataFrame:
    it = parsed.where("error IS NULL").select("feed_url", "dialect", F.posexplode("items").alias("position", "it"))
    return it.select("feed_url", "dialect", "position", "it.id", "it.title", "it.audio_url", F.col("it.pub").alias("pub_date"),
                     parse_pub_date(F.col("it.pub")).alias("published_at"), trim_ws("it.description").alias("description"),
                     "it.author", "it.duration", "it.explicit", "it.categories", F.lit("").alias("transcript"), "it.enclosures")


def mixed_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select("feed_url", "dialect", "error", "bytes")


def feed_rows(parsed: DataFrame) -> DataFrame:
    """Podcasts, episodes and errors of one parse as rows of one table:
    (feed_url, dialect, kind, position, id, title, audio_url, description, error)."""
    def row(kind: str, **fields: Column) -> Column:
        return _shape(kind=F.lit(kind), **{k: fields.get(k, F.lit("")) for k in ("id", "title", "audio_url", "description")},
                      error=fields.get("error", F.lit(None).cast("string")))
    own = F.when(F.col("error").isNull(), F.array(row("podcast", title=F.col("podcast.title"), description=F.col("podcast.description")))) \
        .otherwise(F.array(row("error", error=F.col("error"))))
    its = F.transform(F.coalesce("items", F.array()), lambda it: row(
        "episode", id=it["id"], title=it["title"], audio_url=it["audio_url"], description=it["description"]))
    rows = parsed.select("feed_url", "dialect", F.posexplode(F.concat(own, its)).alias("_at", "r"))
    return rows.select("feed_url", "dialect", "r.kind", F.when(F.col("r.kind") == "episode", F.col("_at") - 1).cast("bigint").alias("position"),
                       "r.id", "r.title", "r.audio_url", trim_ws("r.description").alias("description"), "r.error")
