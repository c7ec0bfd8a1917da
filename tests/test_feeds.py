import json

import pytest

from feedloom.operators.validate import download_plan, limit_per_feed, validate_episodes, with_reject_reason
from feedloom.sources.feeds import read_feed_files, read_feeds

NS = ('xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" '
      'xmlns:dc="http://purl.org/dc/elements/1.1/"')


def rss(channel_inner: str) -> str:
    return f'<?xml version="1.0"?><rss version="2.0" {NS}><channel>{channel_inner}</channel></rss>'


MINIMAL = rss("<title>Show</title><description>About</description>"
              "<item><title>Ep 1</title><description>   padded text \n </description><guid>g1</guid>"
              '<enclosure url="https://a/1.mp3" type="audio/mpeg"/></item>')

FOUR = rss("<title>Four</title>"
           '<item><title>One</title><guid>1</guid><enclosure url="u1"/><itunes:duration>30:00</itunes:duration></item>'
           '<item><title>Two</title><guid>2</guid><enclosure url="u2"/></item>'
           '<item><title></title><guid>3</guid><enclosure url="u3"/></item>'
           "<item><title>Four</title><guid>4</guid></item>")

NO_GUID = rss('<title>N</title><item><title>Lost</title><enclosure url="https://a/x.mp3"/></item>')
EMPTY = rss("<title>Empty</title>")
AUTHORS = rss("<title>A</title><itunes:author>Host</itunes:author>"
              '<item><title>E</title><guid>e</guid><itunes:author>Guest</itunes:author>'
              '<itunes:explicit>yes</itunes:explicit><pubDate>Mon, 02 Jan 2006 15:04:05 +0000</pubDate>'
              '<enclosure url="https://a/e.mp3" length="123"/><itunes:duration>00:30:00</itunes:duration></item>'
              "<item><title>F</title><guid>f</guid><dc:creator>Writer</dc:creator>"
              "<itunes:explicit>Yes</itunes:explicit><category>c1</category><category>c2</category></item>")
DC_ONLY = rss("<title>D</title><dc:creator>First</dc:creator><dc:creator>Second</dc:creator>")
BARE = "<rss><channel><item><title>bare</title></item></channel></rss>"


def feeds(spark, *pairs):
    return spark.createDataFrame(list(pairs), "feed_url string, xml string")


def test_minimal_feed(spark):
    ft = read_feeds(feeds(spark, ("f1", MINIMAL)))
    p = ft.podcasts.first()
    assert (p.title, p.description, p.url) == ("Show", "About", "f1")
    e = ft.episodes.first()
    assert (e.id, e.title, e.audio_url, e.description, e.position) == ("g1", "Ep 1", "https://a/1.mp3", "padded text", 0)
    assert ft.errors.count() == 0


def test_lenient_keeps_title_and_enclosure(spark):
    ep = read_feeds(feeds(spark, ("f", FOUR))).episodes
    valid, rejected = validate_episodes(ep, "lenient")
    assert sorted(r.id for r in valid.collect()) == ["1", "2"]
    assert sorted(r.reject_reason for r in rejected.collect()) == ["missing enclosure", "missing title"]
    assert valid.where("id = '1'").first().duration == "30:00"


def test_guid_fallback_lenient_and_strict(spark):
    ep = read_feeds(feeds(spark, ("f", NO_GUID))).episodes
    v, _ = validate_episodes(ep, "lenient")
    assert v.first().id == "https://a/x.mp3"
    _, r = validate_episodes(ep, "strict")
    assert r.first().reject_reason == "missing episode ID"


def test_strict_reason_order(spark):
    ep = spark.createDataFrame([("f", 0, "", "", ""), ("f", 1, "i", "", ""), ("f", 2, "i", "T", ""),
                                ("f", 3, "i", "T", "u")], "feed_url string, position int, id string, title string, audio_url string")
    r = [x.reject_reason for x in with_reject_reason(ep).orderBy("position").collect()]
    assert r == ["missing episode ID", "missing episode title", "missing audio URL for episode: T", None]


def test_channel_without_items_and_invalid_feed(spark):
    ft = read_feeds(feeds(spark, ("empty", EMPTY), ("bad", "not xml at all"), ("ok", MINIMAL),
                          ("amp", rss("<title>A & B</title>"))))
    assert sorted(r.feed_url for r in ft.podcasts.collect()) == ["empty", "ok"]
    assert [r.feed_url for r in ft.episodes.collect()] == ["ok"]
    assert sorted((r.feed_url, r.error) for r in ft.errors.collect()) == [("amp", "invalid feed XML"),
                                                                         ("bad", "invalid feed XML")]


def test_authors_explicit_dates_categories(spark):
    ft = read_feeds(feeds(spark, ("a", AUTHORS), ("d", DC_ONLY)))
    pods = {r.feed_url: r.author for r in ft.podcasts.collect()}
    assert pods == {"a": "Host", "d": "First"}
    e = {r.id: r for r in ft.episodes.collect()}
    assert (e["e"].author, e["e"].explicit, e["e"].duration) == ("Guest", True, "00:30:00")
    assert (e["f"].author, e["f"].explicit, e["f"].categories) == ("Writer", False, ["c1", "c2"])
    assert str(e["e"].published_at) == "2006-01-02 15:04:05"


def test_bare_item_unmapped_fields_empty(spark):
    e = read_feeds(feeds(spark, ("b", BARE))).episodes.first()
    assert (e.title, e.id, e.audio_url, e.author, e.duration, e.explicit, e.categories) == \
        ("bare", "", "", "", "", False, [])


def test_atom_and_json_dialects(spark):
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><id>a1</id><title>A</title>'
            '<summary>S</summary><published>2006-01-02T15:04:05Z</published>'
            '<link rel="alternate" href="https://page"/><link rel="enclosure" href="https://a/a.mp3"/></entry></feed>')
    ae = read_feeds(feeds(spark, ("x", atom)), dialect="atom").episodes.first()
    assert (ae.id, ae.title, ae.audio_url, ae.description) == ("a1", "A", "https://a/a.mp3", "S")
    jf = json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": "J",
                     "items": [{"id": "j1", "title": "JT", "content_text": "C", "date_published": "2006-01-02T15:04:05Z",
                                "attachments": [{"url": "https://a/j.mp3", "mime_type": "audio/mpeg"}]}]})
    je = read_feeds(feeds(spark, ("y", jf), ("z", "nope")), dialect="json")
    r = je.episodes.first()
    assert (r.id, r.title, r.audio_url, r.description) == ("j1", "JT", "https://a/j.mp3", "C")
    assert [x.feed_url for x in je.errors.collect()] == ["z"]


def test_limit_per_feed(spark):
    ep = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "feed_url string, position int")
    assert limit_per_feed(ep, 0).count() == 7
    assert limit_per_feed(ep, -1).count() == 7
    got = sorted((r.feed_url, r.position) for r in limit_per_feed(ep, 3).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_download_plan(spark):
    ep = spark.createDataFrame([(str(i), u) for i, u in enumerate(
        ["http://a/x.mp3", "https://a/y.mp3", "", "ftp://a/z.mp3", "file:///z.mp3", "z.mp3", "/abs/z.mp3", "httpfoo"])],
        "id string, audio_url string")
    r = {x.id: x for x in download_plan(ep, "/out").collect()}
    assert r["0"].reason is None and r["0"].dest == "/out/0.mp3"
    assert r["1"].reason is None
    assert r["2"].reason == "url required"
    assert {r[k].reason for k in "3456"} == {"url must be http(s)"}
    assert r["7"].reason is None        # prefix test only, as in the reference
    both = download_plan(spark.createDataFrame([("x", "")], "id string, audio_url string"), "").first()
    assert both.reason == "url required"
    dest = download_plan(spark.createDataFrame([("x", "http://a")], "id string, audio_url string"), "").first()
    assert dest.reason == "dest required"


def test_feed_files(spark, tmp_dir):
    for i, x in enumerate([MINIMAL, FOUR]):
        with open(f"{tmp_dir}/f{i}.xml", "w") as fh:
            fh.write(x)
    ft = read_feed_files(spark, tmp_dir)
    assert ft.episodes.count() == 5
    assert all(r.feed_url.endswith(".xml") for r in ft.podcasts.collect())


def test_feed_items_keep_good_items_and_report_bad_ones(spark, tmp_path):
    from feedloom.sources.feeds import INVALID_ITEM, read_feed_items
    item = "<item><guid>{0}</guid><title>{1}</title></item>"
    (tmp_path / "a.xml").write_text("<rss><channel><title>A & B</title>" + item.format("g1", "x")
                                    + item.format("g2", "A & B") + item.format("g3", "y") + "</channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel><title>cut</title>" + item.format("g4", "z") + "<item><guid>g5")
    got = read_feed_items(spark, str(tmp_path))
    assert got.count() == 5
    rows = sorted((r.id, r.title, r.error) for r in got.collect())
    assert rows == [("", "", INVALID_ITEM), ("", "", INVALID_ITEM), ("g1", "x", None), ("g3", "y", None),
                    ("g4", "z", None)]


def awkward_feed(n, seed=3):
    """A well-formed feed full of item tags that are none."""
    import random
    r, parts = random.Random(seed), []
    for i in range(n):
        k = r.randrange(9)
        body = ["plain", "<![CDATA[<item>no</item>]]>", "<![CDATA[]]]]><![CDATA[>x]]>", "<!-- <item> -->b", "<?x <item>?>c",
                "ünïcode " * 30, "<![CDATA[" + "word " * 60 + "]]>", "a &lt;item&gt;", "<![CDATA[<!-- <?]]>"][k]
        tag = r.choice(["<item>", '<item a="&gt;>" b=\'/>\'>', "<item\n>", "<item >"])
        end = r.choice(["</item>", "</item >", "</item\n>"])
        if r.random() < .1:
            parts.append(r.choice(["<item/>", "<item />", '<item x=">"/>', "<item></item>", "<!-- <item> </item> -->"]))
        parts.append(f"{tag}<guid>g{i}</guid><title>t{i}</title><description>{body}</description>"
                     f"<itunes:duration>{i}:00</itunes:duration><dc:creator>c{k}</dc:creator>{end}")
    return (f'<?xml version="1.0"?><!-- <item> --><rss version="2.0" {NS}><channel><title>big</title>'
            + "<itemized>no</itemized>".join(parts) + "</channel></rss>")


@pytest.mark.parametrize("split_bytes", [97, 1000, 1 << 20])
def test_ranges_of_a_feed_file_give_the_items_of_the_whole_file(spark, tmp_path, split_bytes):
    from feedloom.sources.feeds import read_feed_items
    n = 60 if split_bytes < 100 else 400 if split_bytes < 2000 else 9000
    (tmp_path / "big.xml").write_text(awkward_feed(n))
    (tmp_path / "small.xml").write_text(awkward_feed(7, seed=9))
    (tmp_path / "none.xml").write_text(EMPTY)
    (tmp_path / "zero.xml").write_text("")
    whole = read_feed_files(spark, str(tmp_path)).episodes
    items = read_feed_items(spark, str(tmp_path), split_bytes=split_bytes)
    assert items.where("error is not null").count() == 0
    cols = [c for c in whole.columns if c != "categories"]
    want = sorted(map(tuple, whole.select(*cols).collect()), key=str)
    assert len(want) > n and sorted(map(tuple, items.select(*cols).collect()), key=str) == want


def test_no_item_is_lost_beside_odd_ones(spark, tmp_path):
    from feedloom.sources.feeds import INVALID_ITEM, read_feed_items
    (tmp_path / "a.xml").write_text("<rss><channel><item><guid>1</guid></item><item/><item><guid>3</guid></item ><item><guid>4</guid>"
                                    "<item><guid>5</guid></item><item><guid>6</guid></channel></rss>")
    got = sorted((r.position, r.id, r.error) for r in read_feed_items(spark, str(tmp_path), split_bytes=20).collect())
    assert got == [(0, "1", None), (1, "", None), (2, "3", None), (3, "", INVALID_ITEM), (4, "5", None), (5, "", INVALID_ITEM)]


def test_state_of_a_range_is_that_of_the_whole_scan():
    from feedloom.sources import splits
    data = awkward_feed(80).encode()
    whole = splits.scan(data, splits.TEXT)
    for size in (11, 64, 333):
        state, items = splits.TEXT, []
        cuts = [0] + [i for i in range(size, len(data)) if i % size == 0]
        starts = [0] + [data.find(b"<", c) for c in cuts[1:]]
        starts = sorted({s for s in starts if s >= 0}) + [len(data)]
        for a, b in zip(starts, starts[1:]):
            state, found = splits.scan(data[a:b], state)
            items += [a + i for i in found]
        assert (state, items) == whole


RDF = ('<?xml version="1.0"?><!-- <rss> --><rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:dc="d" xmlns:enc="e" '
       'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel rdf:about="x"><title>R</title>'
       '<description> about </description><dc:creator>C</dc:creator></channel>'
       '<item rdf:about="urn:1"><title>One</title><description>d1</description><dc:date>2006-01-02T15:04:05Z</dc:date>'
       '<dc:creator>W</dc:creator><enc:enclosure rdf:resource="https://a/1.mp3"/></item>'
       '<item><title>Two</title><guid>g2</guid><enclosure url="https://a/2.mp3"/></item></rdf:RDF>')
ATOM = ('\ufeff<?xml version="1.0"?>\n<!DOCTYPE feed>\n<a:feed xmlns:a="x"><title>T</title><entry><id>a1</id><title>A</title></entry></a:feed>')


def test_dialect_is_found_row_by_row(spark):
    ft = read_feeds(feeds(spark, ("rss", MINIMAL), ("rdf", RDF), ("atom", ATOM.replace("a:feed", "feed")),
                          ("json", ' \n {"title": "J", "items": [{"id": "j1", "title": "JT"}]}'), ("cut", MINIMAL[:-20]),
                          ("badjson", '{"title": '), ("html", "<html><body>no</body></html>"), ("text", "not a feed"),
                          ("empty", ""), ("null", None), ("nochannel", '<rss version="2.0"></rss>'),
                          ("late", "<!-- <feed> <rss> -->" + MINIMAL.split("?>", 1)[1])), dialect="auto")
    pods = {r.feed_url: (r.dialect, r.title, r.description) for r in ft.podcasts.collect()}
    assert pods == {"rss": ("rss", "Show", "About"), "rdf": ("rdf", "R", "about"), "atom": ("atom", "T", ""),
                    "json": ("json", "J", ""), "late": ("rss", "Show", "About")}
    eps = sorted((r.feed_url, r.position, r.id, r.title, r.audio_url, r.author) for r in ft.episodes.collect())
    assert eps == [("atom", 0, "a1", "A", "", ""), ("json", 0, "j1", "JT", "", ""), ("late", 0, "g1", "Ep 1", "https://a/1.mp3", ""),
                   ("rdf", 0, "urn:1", "One", "https://a/1.mp3", "W"), ("rdf", 1, "g2", "Two", "https://a/2.mp3", ""),
                   ("rss", 0, "g1", "Ep 1", "https://a/1.mp3", "")]
    errors = {r.feed_url: (r.dialect, r.error) for r in ft.errors.collect()}
    assert errors == {"cut": ("rss", "invalid feed XML"), "badjson": ("json", "invalid feed JSON"), "html": (None, "unknown feed type"),
                      "text": (None, "unknown feed type"), "empty": (None, "unknown feed type"), "null": (None, "unknown feed type"),
                      "nochannel": ("rss", "feed has no channel")}
    assert {r.feed_url: r.bytes for r in ft.errors.collect()}["text"] == 10


def test_mixed_rows_agree_with_the_dialect_readers(spark):
    rows = [("a", MINIMAL), ("b", FOUR), ("c", AUTHORS), ("d", EMPTY), ("e", DC_ONLY)]
    auto, plain = read_feeds(feeds(spark, *rows), dialect="auto"), read_feeds(feeds(spark, *rows))
    for x, y in ((auto.podcasts, plain.podcasts), (auto.episodes, plain.episodes)):
        cols = y.columns
        assert sorted(map(str, x.select(*cols).collect())) == sorted(map(str, y.collect()))
