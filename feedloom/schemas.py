"""Schemas (DDL strings) shared by the sources, operators and sinks."""

from __future__ import annotations

# RSS 2.0 with the iTunes and Dublin Core prefixes kept as part of the field
# names (ignoring namespaces would let `itunes:title` overwrite `title`).
# A guid with attributes needs the struct form, otherwise the whole record
# turns NULL.
RSS_SCHEMA = """
channel struct<
  title string, description string, category array<string>,
  `itunes:author` string, `dc:creator` array<string>,
  item array<struct<
    title string, description string, pubDate string,
    guid struct<_VALUE string, _isPermaLink string>,
    category array<string>,
    enclosure array<struct<_url string, _type string, _length string>>,
    `itunes:duration` string, `itunes:explicit` string,
    `itunes:author` string, `dc:creator` array<string>>>>,
_corrupt_record string
"""

# The channel alone: items are skipped, not materialised.
RSS_CHANNEL_SCHEMA = """
channel struct<
  title string, description string, category array<string>,
  `itunes:author` string, `dc:creator` array<string>>,
_corrupt_record string
"""

# One RSS <item> on its own (the XML reader with rowTag=item).
RSS_ITEM_DDL = ("title string, description string, pubDate string, "
                "guid struct<_VALUE: string, _isPermaLink: string>, category array<string>, "
                "enclosure array<struct<_url: string, _type: string, _length: string>>, "
                "`itunes:duration` string, `itunes:explicit` string, `itunes:author` string, "
                "`dc:creator` array<string>")

# RSS 1.0 (RDF): the items stand beside the channel.
RDF_SCHEMA = """
channel struct<title string, description string, `itunes:author` string, `dc:creator` array<string>,
               `dc:subject` array<string>>,
item array<struct<
  title string, link string, description string, `_rdf:about` string, guid struct<_VALUE string, _isPermaLink string>,
  pubDate string, `dc:date` array<string>, `dc:creator` array<string>, `dc:subject` array<string>,
  enclosure array<struct<_url string, _type string, _length string>>,
  `enc:enclosure` array<struct<`_rdf:resource` string, `_enc:type` string, `_enc:length` string>>,
  `itunes:duration` string, `itunes:explicit` string, `itunes:author` string>>,
_corrupt_record string
"""

# Atom 1.0: enclosures are <link rel="enclosure" href=...>.
ATOM_SCHEMA = """
title string, subtitle string,
author struct<name string>,
category array<struct<_term string>>,
entry array<struct<
  id string, title string, summary string, published string, updated string,
  author struct<name string>,
  category array<struct<_term string>>,
  link array<struct<_rel string, _href string, _type string, _length string>>,
  `itunes:duration` string, `itunes:explicit` string>>,
_corrupt_record string
"""

# JSON Feed 1.1
JSON_FEED_SCHEMA = """_corrupt_record string,
title string, description string, authors array<struct<name string>>,
items array<struct<
  id string, title string, content_text string, summary string,
  date_published string, tags array<string>,
  authors array<struct<name string>>,
  attachments array<struct<url string, mime_type string, size_in_bytes bigint,
                           duration_in_seconds bigint>>>>
"""

PODCAST_COLUMNS = ["feed_url", "title", "description", "url", "author", "categories"]

EPISODE_COLUMNS = [
    "feed_url", "position", "id", "title", "audio_url", "pub_date", "published_at",
    "description", "author", "duration", "explicit", "categories", "transcript",
]

# Typed view of the default extraction scheme (guests + companies).
ENTRY_DDL = ("guests array<struct<name string, background string, ideology string>>, "
             "companies array<struct<name string, business_model string, customers string>>")

ARTIFACT_DDL = "key string, kind string, value string, size_bytes bigint, last_used timestamp"

NODE_DDL = "id string, label string, properties map<string,string>"
EDGE_DDL = "edge_id bigint, src string, dst string, label string"

CHAT_REPLY_DDL = "message struct<role string, content string>, done boolean"
GENERATE_REPLY_DDL = "response string, done boolean"

DOCUMENT_GRAPH_DDL = ("entities array<struct<id string, type string>>, "
                      "relationships array<struct<source string, target string, "
                      "relation string, context string>>")
