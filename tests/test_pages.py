"""Page extraction, noise removal, lead images and feeds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from newsmart.functions import text as X
from newsmart.functions.html import drop_noise
from newsmart.operators import pages as P
from newsmart.sources import feeds, regions


def one(spark, html, fn):
    return spark.createDataFrame([(html,)], "h STRING").select(fn(F.col("h")).alias("o")).first()[0]


def test_scripts_go_before_tags(spark):
    html = '<body><script>var t="</p>";</script><p>Uno&nbsp;&amp;lt; dos</p><NAV>x</nav><!-- <p>no</p> --></body>'
    assert one(spark, html, lambda c: P.visible_text(P.strip_boilerplate(c))) == "Uno &lt; dos"


def test_entities(spark):
    assert one(spark, "&#241;&#x1F600;&eacute;&amp;amp;&bogus;", P.decode_entities) == "ñ😀é&amp;&bogus;"


def test_header_tag_is_not_head(spark):
    html = "<head><title>T</title></head><header>gone</header><headers>stay</headers>"
    assert one(spark, html, lambda c: P.visible_text(P.strip_boilerplate(c))) == "T stay"


def test_extract_ladder(spark):
    long = "palabra " * 20
    rows = [
        (1, f"<body>before<article><p>{long}</p></article>after</body>"),
        (2, "<body>before<article>short</article>after</body>"),
        (3, "<body>no article</body>"),
        (4, f"<body>x<article>{'a' * 100}</article></body>"),
        (5, f"<body>x<article>{'a' * 101}</article></body>"),
    ]
    got = {r.id: r.text for r in P.page_extract(spark.createDataFrame(rows, "id INT, html STRING")).collect()}
    assert got[1] == long.strip()
    assert got[2] == "before short after"
    assert got[3] == "no article"
    assert got[4] == "x " + "a" * 100
    assert got[5] == "a" * 101


def test_whole_text_is_kept(spark):
    html = "<article>" + "word " * 30_000 + "</article>"
    row = P.page_extract(spark.createDataFrame([(1, html)], "id INT, html STRING")).first()
    assert row.text.split().__len__() == 30_000


def test_noise():
    assert drop_noise('<p>a</p><div class="big share-bar"><div>x<br></div>y</div><p>b</p>') == "<p>a</p><p>b</p>"
    assert drop_noise('<div class="ad">kept</div>') == '<div class="ad">kept</div>'
    assert drop_noise('<div class="downloads">gone</div>') == ""
    assert drop_noise('<span class="social">kept</span><span id="Social">gone</span>') == '<span class="social">kept</span>'
    assert drop_noise('<img id="printme">t<p id="ads1"/>u') == "tu"
    assert drop_noise("a &amp; b &#233;") == "a &amp; b &#233;"
    assert drop_noise(None) is None


def test_images(spark):
    base = "https://site.example/a/b.html"
    og = '<meta property="og:image" content=" /x.jpg ">'
    tw = '<meta name="twitter:image" content="https://t.example/t.jpg">'
    link = '<link rel="nofollow image_src" href="//l.example/l.jpg">'
    img = '<img src="data:image/png;base64,x"><img src="pic.png">'
    cases = [
        (tw + og + link + img, base, "https://site.example/x.jpg"), (tw + link + img, base, "https://t.example/t.jpg"),
        (link + img, base, "https://l.example/l.jpg"), (img, base, "https://site.example/a/pic.png"),
        ('<img src="/Logo.png"><img src="/shared.png"><img src="ok.gif">', base, "https://site.example/a/ok.gif"),
        ('<meta property="og:image"><img src="a.png?x=1&amp;y=2">', base, "https://site.example/a/a.png?x=1&y=2"),
        ('<meta property="og:image" content="/icon.png"><meta property="og:image" content="/two.png"><img src="three.png"/>', base, "https://site.example/a/three.png"),
        ('<img src="rel.png">', "", ""), ('<img src="//h.example/y.png">', None, "https://h.example/y.png"), ("", base, ""), (None, base, ""),
        ('<img src="ftp://h.example/y.png"><img src="mailto:x">', base, ""),
    ]
    rows = spark.createDataFrame(cases, "html STRING, url STRING, want STRING")
    assert [r for r in P.with_lead_image(rows).collect() if r.image_url != r.want] == []


def test_addresses_resolve_as_browsers_do(spark):
    from urllib.parse import urljoin

    rnd = random.Random(3)
    piece = lambda: rnd.choice(["a", "b.png", "..", ".", "c d", "é", "x:y"])
    bases = ["https://h.example", "https://h.example/", "http://h.example/a/b/c.html", "https://h.example/a/b/?q=1#f", "https://h.example:8080/x/../y/z"]
    made = [(rnd.choice(["", "/", "./", "../", "//o.example/", "?"]) + "/".join(piece() for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "?p=/../x", "#g"]), rnd.choice(bases)) for _ in range(400)]
    made = [(a, b) for a, b in made if not a.startswith(("x:y", "?", "#")) and a]
    got = spark.createDataFrame(made, "a STRING, b STRING").select("a", "b", X.resolve_url(F.col("a"), F.col("b")).alias("u")).collect()
    assert [(r.a, r.b, r.u, urljoin(r.b, r.a)) for r in got if not r.a.startswith("//") and r.u != urljoin(r.b, r.a)] == []


def test_feed_file(spark, tmp_path):
    """Items of a landed feed: escaped markup in the description, missing fields, a date that is none, a repeated title."""
    items = [
        "<title>Harbour reopens &amp; ships sail</title><link>https://feed.example/7</link><pubDate>Tue, 05 Mar 2024 08:30:00 GMT</pubDate>"
        '<source url="https://coast.example">Coast Daily</source><description>&lt;div&gt;All &amp;amp; sundry &lt;img src="https://pics.example/quay.png"&gt;&lt;/div&gt;</description>',
        "<title>Without a day</title><link>https://feed.example/8</link><pubDate>one of these days</pubDate>",
        "<title>Harbour reopens &amp; ships sail</title><link>https://feed.example/9</link>",
    ]
    (tmp_path / "coast.xml").write_text("<rss><channel>" + "".join(f"<item>{i}</item>" for i in items) + "</channel></rss>", encoding="utf-8")
    read = feeds.read_feeds(spark, str(tmp_path))
    rows = read.orderBy("pos").collect()
    assert [(r.title, r.url[-1]) for r in rows] == [("Harbour reopens & ships sail", "7"), ("Without a day", "8"), ("Harbour reopens & ships sail", "9")]
    assert [r.date for r in rows[:2]] == ["2024-03-05 08:30:00", "one of these days"]
    assert [(r.source, r.source_url) for r in rows] == [("Coast Daily", "https://coast.example"), ("Desconocido", ""), ("Desconocido", "")]
    assert [(r.summary, r.feed_image_url) for r in rows] == [("All & sundry", "https://pics.example/quay.png"), ("", None), ("", None)]
    from newsmart.operators.dedup import dedup_title

    assert sorted(r.url[-1] for r in dedup_title(read, ["feed"], [F.col("pos")]).collect()) == ["7", "8"]


def test_region_and_config_files(spark, tmp_path):
    (tmp_path / "mx_states.geojson").write_text(
        '{"type":"FeatureCollection","features":[{"properties":{"state_name":"Jalisco"}},'
        '{"properties":{"state_name":""}},{"properties":{}},{"properties":{"state_name":"Nuevo León"}}]}', encoding="utf-8")
    rows = regions.read_regions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.country, r.state_name) for r in rows] == [("mx", "Jalisco"), ("mx", "Nuevo León")]
    config = regions.config_rows(spark.createDataFrame([(regions.default_config_json(),)], "config STRING"))
    assert {r.key: r.country_name for r in config.collect()} == {"mx": "Mexico", "usa": "United States"}
    mapped = regions.with_map(config, regions.read_regions(spark, str(tmp_path)))
    assert [r.key for r in mapped.collect()] == ["mx"]
    runs = spark.createDataFrame([("1", '{"country":"USA"}'), ("2", '{"country":"xx"}'), ("3", None)], "id STRING, filters STRING")
    assert {r.id: r.key for r in regions.resolve_country(runs, config).collect()} == {"1": "usa", "2": "mx", "3": "mx"}


def test_tag_names_end_and_the_first_opening_counts(spark):
    text = lambda html: one(spark, html, lambda c: P.visible_text(P.strip_boilerplate(c)))
    assert text("<nav-bar>x</nav-bar><p>MAIN BODY</p><nav>menu</nav>") == "x MAIN BODY"
    assert text("<script>var a='<!--'</script><p>kept</p><!-- gone -->") == "kept"
    assert text("<!-- <script> --><p>kept</p><script>x</script>") == "kept"
    assert text("<p>a < b and c > d</p>") == "a < b and c > d"


def test_references_are_decoded_once(spark):
    cases = {
        "a &#38;lt; b &amp;amp; &amp;": "a &lt; b &amp; &", "&agrave;&ccedil;&times; &#x10FFFF;&#1114111;": "àç× \U0010ffff\U0010ffff",
        "&#55296; &unknown; & &; AT&T": "� &unknown; & &; AT&T", "&lt;b&gt; &#00065;": "<b> A", "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select(P.decode_entities(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows), rows
