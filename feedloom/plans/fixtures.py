"""Feed, graph and log inputs derived from the driver tables.

Every derived input is a deterministic function of the given tables, so
the work grows with them, and the DuckDB oracle can recompute the expected
answer straight from the same rows. Groups are bounded by construction: a
feed holds the documents of one ``source`` within one block of
``FEED_BLOCK`` consecutive ``doc_id`` values, so a source holding a third
of all documents is spread over many bounded feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.strings import xml_escape

# Fixed values shared with the oracle SQL.
FEED_BLOCK = 100
FEED_HOST = "https://feeds.example.com/"
CDN_HOST = "https://cdn.example.com/"
FTP_HOST = "ftp://files.example.com/"
MIRROR_HOST = "https://mirror.example.com/"
BROKEN_SOURCES = ("src3", "src7")
ITUNES_NS = "http://www.itunes.com/dtds/podcast-1.0.dtd"
DC_NS = "http://purl.org/dc/elements/1.1/"
ATOM_NS = "http://www.w3.org/2005/Atom"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RSS1_NS = "http://purl.org/rss/1.0/"
ENC_NS = "http://purl.oclc.org/net/rss_2.0/enc#"
MIXED = ("rss", "atom", "json", "rdf")


def _str(x) -> Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


def doc_item_fields(docs: DataFrame) -> DataFrame:
    """Per-document episode fields (the oracle recomputes the same rules)."""
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    block = F.floor(F.col("doc_id") / FEED_BLOCK).cast("bigint")
    ts = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")      # zone-free wall clock
          + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"), (F.col("n_chars") % 60).cast("int")))
    pub = (F.when(F.col("doc_id") % 3 == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss +0000"))
           .when(F.col("doc_id") % 3 == 1, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
           .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    host = F.when(F.col("doc_id") % 17 == 5, F.lit(FTP_HOST)).otherwise(F.lit(CDN_HOST))
    return d.select(
        "doc_id", "text", "lang", "source", "n_chars",
        block.alias("block"),
        F.concat(F.lit(FEED_HOST), F.col("source"), F.lit("/"), _str(block), F.lit(".xml")).alias("feed_url"),
        ((block % 5 == 2) & F.col("source").isin(*BROKEN_SOURCES)).alias("broken"),
        F.when(F.col("n_chars") % 11 == 0, F.lit("")).otherwise(
            F.concat(F.upper("lang"), F.lit(" episode "), _str("doc_id"))).alias("title"),
        F.when(F.col("doc_id") % 7 == 3, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("ep-"), _str("doc_id"))).alias("guid"),
        (F.col("doc_id") % 2 == 0).alias("permalink_attr"),
        (F.col("n_chars") % 13 != 0).alias("has_enclosure"),
        F.concat(host, F.col("lang"), F.lit("/"), _str("doc_id"), F.lit(".mp3")).alias("audio_url"),
        (F.col("doc_id") % 5 == 1).alias("has_mirror"),
        F.concat(F.lit(MIRROR_HOST), _str("doc_id"), F.lit(".mp3")).alias("mirror_url"),
        ts.alias("ts"),
        pub.alias("pub"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        F.concat(_str(F.floor(F.col("n_chars") / 60)), F.lit(":"),
                 F.lpad(_str(F.col("n_chars") % 60), 2, "0")).alias("duration"),
        F.when(F.col("lang") == "de", F.lit("yes")).when(F.col("lang") == "es", F.lit("Yes"))
        .when(F.col("lang") == "fr", F.lit("no")).alias("explicit"),
        F.when(F.col("lang") == "en", F.concat(F.lit("Narrator "), F.col("source"))).alias("itunes_author"),
        F.concat(F.lit("Writer "), F.col("lang")).alias("creator"),
        F.concat(F.lit("n"), _str(F.floor(F.col("n_chars") / 1000))).alias("size_cat"),
    )


def _el(tag: str, value: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attrs}>"), value, F.lit(f"</{tag}>"))


def _rss_item(c=F.col) -> Column:
    guid = (F.when(c("guid").isNull(), F.lit(None))
            .when(c("permalink_attr"), _el("guid", c("guid"), ' isPermaLink="false"'))
            .otherwise(_el("guid", c("guid"))))
    encl = F.when(c("has_enclosure"), F.concat(
        F.lit('<enclosure url="'), c("audio_url"), F.lit('" type="audio/mpeg" length="'),
        _str("n_chars"), F.lit('"/>'),
        F.when(c("has_mirror"), F.concat(F.lit('<enclosure url="'), c("mirror_url"),
                                          F.lit('" type="audio/mpeg"/>'))).otherwise(F.lit(""))))
    parts = [
        F.when(c("title") != "", _el("title", c("title"))),
        _el("description", xml_escape(c("text"))),
        _el("pubDate", c("pub")),
        guid,
        _el("category", c("lang")), _el("category", c("size_cat")),
        encl,
        _el("itunes:duration", c("duration")),
        F.when(c("explicit").isNotNull(), _el("itunes:explicit", c("explicit"))),
        F.when(c("itunes_author").isNotNull(), _el("itunes:author", c("itunes_author"))),
        _el("dc:creator", c("creator")),
    ]
    return F.concat(F.lit("<item>"), F.concat_ws("", *parts), F.lit("</item>"))


def _atom_entry(c=F.col) -> Column:
    parts = [
        F.when(c("guid").isNotNull(), _el("id", c("guid"))),
        F.when(c("title") != "", _el("title", c("title"))),
        _el("summary", xml_escape(c("text"))),
        _el("published", c("iso")),
        F.concat(F.lit('<link rel="alternate" href="https://example.com/ep/'), _str("doc_id"), F.lit('"/>')),
        F.when(c("has_enclosure"), F.concat(F.lit('<link rel="enclosure" href="'), c("audio_url"),
                                            F.lit('" type="audio/mpeg" length="'), _str("n_chars"),
                                            F.lit('"/>'))),
        _el("itunes:duration", c("duration")),
    ]
    return F.concat(F.lit("<entry>"), F.concat_ws("", *parts), F.lit("</entry>"))


def _rdf_item(c=F.col) -> Column:
    """The guid, where there is one, is what the item is about."""
    parts = [
        F.when(c("title") != "", _el("title", c("title"))),
        F.concat(F.lit("<link>https://example.com/ep/"), _str("doc_id"), F.lit("</link>")),
        _el("description", xml_escape(c("text"))),
        _el("dc:date", c("iso")), _el("dc:creator", c("creator")), _el("dc:subject", c("lang")),
        F.when(c("has_enclosure"), F.concat(F.lit('<enc:enclosure rdf:resource="'), c("audio_url"),
                                            F.lit('" enc:type="audio/mpeg"/>'))),
    ]
    head = F.when(c("guid").isNull(), F.lit("<item>")).otherwise(F.concat(F.lit('<item rdf:about="'), c("guid"), F.lit('">')))
    return F.concat(head, F.concat_ws("", *parts), F.lit("</item>"))


def _json_item(c=F.col) -> Column:
    att = F.when(c("has_enclosure"), F.array(F.struct(
        c("audio_url").alias("url"), F.lit("audio/mpeg").alias("mime_type"),
        c("n_chars").alias("size_in_bytes"))))
    return F.struct(c("guid").alias("id"), F.when(c("title") != "", c("title")).alias("title"),
                    c("text").alias("content_text"), c("iso").alias("date_published"),
                    F.array(c("lang"), c("size_cat")).alias("tags"), att.alias("attachments"))


def feeds_from_documents(docs: DataFrame, dialect: str = "rss") -> DataFrame:
    """(feed_url, xml): one feed per (source, doc_id block), items in doc_id
    order, whole document texts as descriptions. Feeds flagged ``broken``
    carry a raw ampersand (XML) or a text prefix (JSON)."""
    f = doc_item_fields(docs)
    item = {"rss": _rss_item, "atom": _atom_entry, "json": _json_item, "rdf": _rdf_item}[dialect]()
    grouped = (f.select("source", "block", "feed_url", "broken", "doc_id", item.alias("item"))
               .groupBy("source", "block", "feed_url", "broken")
               .agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items")))
    src, blk = F.col("source"), _str("block")
    title = F.when(F.col("broken"), F.concat(F.lit("Feed "), src, F.lit(" & co #"), blk)).otherwise(
        F.concat(F.lit("Feed "), src, F.lit(" #"), blk))
    if dialect == "json":
        body = F.to_json(F.struct(
            F.lit("https://jsonfeed.org/version/1.1").alias("version"), title.alias("title"),
            F.concat(F.lit("Documents from "), src).alias("description"),
            F.transform("items", lambda x: x["item"]).alias("items")))
        body_c = F.col("body")
        junk = F.concat(F.lit("feed: "), body_c)
        return (grouped.select("feed_url", "broken", body.alias("body"))
                .select("feed_url", F.when(F.col("broken"), junk).otherwise(body_c).alias("xml")))
    items = F.array_join(F.transform("items", lambda x: x["item"]), "")
    ttl = F.when(F.col("broken"), title).otherwise(xml_escape(title))
    if dialect == "rss":
        owner = F.when(F.col("block") % 2 == 0, _el("itunes:author", F.concat(F.lit("Host of "), src))) \
            .otherwise(_el("dc:creator", F.concat(F.lit("Curator "), blk)))
        head = F.concat(
            F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:itunes="{ITUNES_NS}" '
                  f'xmlns:dc="{DC_NS}"><channel>'),
            _el("title", ttl), _el("description", F.concat(F.lit("Documents from "), src)),
            _el("category", src), _el("category", F.lit("documents")), owner)
        xml = F.concat(head, items, F.lit("</channel></rss>"))
    elif dialect == "rdf":
        head = F.concat(
            F.lit(f'<?xml version="1.0"?><!-- <rss> --><rdf:RDF xmlns="{RSS1_NS}" xmlns:rdf="{RDF_NS}" xmlns:dc="{DC_NS}" '
                  f'xmlns:enc="{ENC_NS}"><channel>'),
            _el("title", ttl), _el("description", F.concat(F.lit("Documents from "), src)),
            _el("dc:creator", F.concat(F.lit("Curator "), blk)), F.lit("</channel>"))
        xml = F.concat(head, items, F.lit("</rdf:RDF>"))
    else:
        head = F.concat(
            F.lit(f'<?xml version="1.0" encoding="UTF-8"?><feed xmlns="{ATOM_NS}" xmlns:itunes="{ITUNES_NS}">'),
            _el("title", ttl), _el("subtitle", F.concat(F.lit("Documents from "), src)),
            F.concat(F.lit("<author><name>Host of "), src, F.lit("</name></author>")))
        xml = F.concat(head, items, F.lit("</feed>"))
    return grouped.select("feed_url", xml.alias("xml"))


def mixed_feeds(docs: DataFrame) -> DataFrame:
    """Feeds of all dialects in one table: the block decides."""
    out = None
    for k, dialect in enumerate(MIXED):
        mine = F.floor(F.col("doc_id") / FEED_BLOCK) % len(MIXED) == k
        feeds = feeds_from_documents(docs.where(mine), dialect)
        out = feeds if out is None else out.unionByName(feeds)
    return out
