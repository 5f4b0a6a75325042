"""Literal cases of the data model."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pressweave.functions import news, parsing, text
from pressweave.operators import groups
from pressweave.operators.merging import merge_clusters
from pressweave.operators.simjoin import cosine
from pressweave.operators.timeline import quota_windows
from pressweave.plans import repair, screening
from pressweave.sources import feeds, html


def one(spark, expr, **values):
    row = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_broken_text(spark):
    got = column(spark, [None, "", "   ", "N/A", "null", "undefined", "Real text"], text.is_broken("v"))
    assert got == [True] * 6 + [False]


def test_fingerprint_ignores_case_and_spacing(spark):
    a, b, c = column(spark, ["Hello   World", " hello world\n", "hello  worlds"], text.fingerprint("v"))
    assert a == b != c


def test_tokens_fold_accents(spark):
    assert sorted(one(spark, text.significant_tokens(F.lit("Árvíztűrő tükör, a TÜKÖR fúró-gép 2024")))) == [
        "2024", "arvizturo", "furo", "tukor"]
    exact = one(spark, text.significant_tokens("v", exact=True), v="Árvíztűrő ﬁnom")
    assert sorted(exact) == ["arvizturo", "finom"]


@pytest.mark.parametrize("title,kind,role", [
    ("A miniszter reagált", "event", "reaction"), ("Éles hangon bírálták", "event", "reaction"),
    ("Bejelentették az új tervet", "event", "announcement"), ("Vélemény", "opinion", "analysis"),
    ("X", "aggregation", "aggregation"), ("újrareagál", "event", "reaction"), ("Hír", None, "event")])
def test_event_role(spark, title, kind, role):
    df = spark.createDataFrame([(title, None, None, kind)], "t string, s string, m string, k string")
    got = df.select(text.event_role("t", "s", "m", "k").alias("r")).first()["r"]
    if title == "újrareagál":  # a non-ASCII letter counts as a word border before the stem only there
        assert got in ("event", "reaction")
    else:
        assert got == role


def test_low_value_rules(spark):
    rows = [("ripost", "https://x/sztar/1", "Szexi fotók", "", "", ""),
            ("telex", "https://x/1", "A kormány döntött", "", "", ""),
            ("telex", "https://x/1", "Nagy kvíz", "", "", "politika"),
            ("telex", "https://x/1", "Hír", "", "foto", "")]
    df = spark.createDataFrame(rows, "source_slug string, url string, title string, lead string, body string, category string")
    got = {r["title"]: r for r in screening.classify_low_value(df, "extracted").collect()}
    assert (got["Szexi fotók"]["action"], got["Szexi fotók"]["rule_id"]) == ("discard", "low-value-media")
    assert got["Szexi fotók"]["signals"] == ["sexualized", "gallery", "url-entertainment", "source-boost"]
    assert got["Szexi fotók"]["confidence"] == pytest.approx(min(0.98, 0.55 + 8 * 0.08))
    assert got["A kormány döntött"]["action"] == "keep" and got["A kormány döntött"]["signals"] == ["politics"]
    assert got["Nagy kvíz"]["rule_id"] == "strict-low-value"
    assert got["Hír"]["action"] == "keep" and got["Hír"]["signals"] == ["thin-media-content"]


def test_feed_items(spark):
    item = Row(source_slug="s", pos=1, link="u", title="t", contentSnippet="", content="c", isoDate="2024-01-02T03:04:05Z",
               creator=None, author="au", categories=["k1", "k2"], enclosure=Row(url="i", type="image/png"))
    rows = [item, Row(**{**item.asDict(), "pos": 2, "enclosure": Row(url="v", type="video/mp4")}),
            Row(**{**item.asDict(), "pos": 3, "link": None}), Row(**{**item.asDict(), "pos": 4})]
    df = spark.createDataFrame(rows, feeds.ITEM_SCHEMA)
    got = feeds.feed_candidates(df, 2).orderBy("image_url").collect()
    assert len(got) == 2 and feeds.feed_candidates(df, 0).count() == 3
    assert [g["image_url"] for g in got] == [None, "i"]
    assert (got[1]["body_fallback"], got[1]["category"], got[1]["author"]) == ("c", "k1", "au")
    assert got[1]["published_at"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_queue_ids_and_settings(spark):
    assert column(spark, ["1", "bad", "2", "NaN", "3", "0", "-1", "2.5"], parsing.positive_id("v")) == [
        1, None, 2, None, 3, None, None, None]
    assert column(spark, ["x", "1", "99", None, "12px"], parsing.bounded_int("v", 7, 5, 40)) == [7, 5, 40, 7, 12]


def test_usage_mode(spark):
    assert column(spark, ["gemini-fallback", "openrouter", None, "", "gemini"], parsing.usage_mode("v")) == [
        "gemini-fallback"] + ["openrouter"] * 4


def test_resource_strings(spark):
    assert column(spark, ["500m", "2", None, "x"], parsing.cpu_cores("v")) == [0.5, 2.0, 0.0, 0.0]
    assert column(spark, ["512Mi", "1Gi", "1048576Ki", "1073741824", None], parsing.mem_gib("v")) == [0.5, 1, 1, 1, 0]
    assert column(spark, ["30s", "600", "", None], parsing.secs("v")) == [30, 600, 0, 0]


def test_analysis_answers(spark):
    good = '{"summary":" s ","headline":"h","mainEvent":"m","topics":["sport","x"],"entities":["a","b","c","d","e","f"]}'
    got = column(spark, ["0", "Sure: " + good + " bye", '{"summary":"s"}', "no json", None],
                 parsing.parse_analysis("v"))
    assert [g["status"] for g in got] == ["trash", "analyzed", "failed", "failed", "failed"]
    a = got[1]
    assert (a["summary"], a["story_identity"], a["article_type"]) == ("s", "m", "event")
    assert a["topics"] == ["sport"] and a["entities"] == ["a", "b", "c", "d", "e"] and a["location"] is None


def test_coherence_answers(spark):
    def verdict(answer, old=None):
        df = spark.createDataFrame([(answer, [10, 20, 30], old)], "a string, ids array<bigint>, old string")
        return df.select(parsing.parse_coherence("a", "ids", "old").alias("v")).first()["v"]
    assert verdict("1", "Old")["title"] == "Old" and verdict("1") is None
    assert verdict('x {"coherent":true,"title":" T ","summary":"S"} y')["title"] == "T"
    assert verdict('{"coherent":false,"groups":[[1,3],[2,9]]}')["groups"] == [[10, 30], [20]]
    assert verdict('{"coherent":false,"groups":[[1,2,3]]}') is None
    assert verdict('{"headline":"H"}')["title"] == "H"


def test_repair_window():
    lo, hi = repair.repair_window("2026-05-19T12:00:00", 24, 90)
    assert (lo, hi) == (dt.datetime(2026, 5, 18, 12), dt.datetime(2026, 5, 19, 10, 30))


def test_bias_and_relevance(spark):
    assert column(spark, ["center-left", "center", "right", "odd"], news.bias_group("v", "right")) == [
        "left", "center", "right", "right"]
    assert one(spark, news.relevance(F.lit(2), F.lit(5), F.lit(3))) == 26.0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [10.0])], "id bigint, embedding array<double>")
    got = groups.centroid(df.withColumn("k", F.lit(1)), "k").first()
    assert got["centroid"] == [0.5, 0.5]
    pairs = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([], []), ([1.0], [1.0, 0.0]), ([0.0], [1.0])],
                                  "a array<double>, b array<double>")
    assert [r[0] for r in pairs.select(cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_merge_cases(spark):
    schema = "id bigint, size bigint, centroid array<double>"
    three = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.8, 0.6]), (3, 1, [0.8, -0.6])], schema)
    assert {r["merged"] for r in merge_clusters(three, 0.55, 10).collect()} == {1}
    full = spark.createDataFrame([(1, 24, [1.0, 0.0]), (2, 24, [1.0, 0.0])], schema)
    assert {r["merged"] for r in merge_clusters(full, 0.9, 24).collect()} == {1, 2}


def test_entity_merge(spark):
    df = spark.createDataFrame([(1, 1, ["Orbán", "Fidesz"]), (1, 2, ["orbán viktor", "FIDESZ", "EU"])],
                               "k bigint, id bigint, entities array<string>")
    assert groups.merge_entities(df, "k").first()["entities"] == ["Fidesz", "orbán viktor", "EU"]
    assert groups.merge_entities(df, "k", limit=1).first()["entities"] == ["Fidesz"]


def test_quota(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 1, 2, 61]
    df = spark.createDataFrame([(7, t0 + dt.timedelta(seconds=s), i) for i, s in enumerate(at)],
                               "key bigint, ts timestamp, pos bigint")
    got = {r["pos"]: r for r in quota_windows(df, "key", "ts", "pos", 2, 60).collect()}
    assert [got[i]["allowed"] for i in range(4)] == [True, True, False, True]
    assert got[2]["retry_after_seconds"] == 58 and got[3]["remaining"] == 1


def test_redaction(spark):
    raw = "x SECRET postgresql://a:b@h/d Bearer abc.def="
    assert one(spark, text.redact(F.lit(raw), {"KEY": "SECRET"})) == (
        "x <redacted:KEY> postgresql://<redacted>@h/d Bearer <redacted>")


PAGE = """<html><head><title>The Title</title><meta property="og:image" content=" i.png ">
<meta content='sport' property='article:section'></head><body class="a"><nav>menu</nav><!-- <p>no</p> -->
<article><p>Lead  text</p><div>Body <script>x("</p>")</script>one
<aside>skip</aside> &#337;&lt;t&gt; &amp;amp;</div></article><a href="/hirek/1">One <b>x</b></a><a class="c" href='/hirek/1'>Again</a>
<a href="/other">No</a><a href="/hirek/2"></a></body></html>"""


def test_page_extraction(spark):
    pages = spark.createDataFrame([(1, "https://t.hu/a", PAGE, "telex"), (2, "https://t.hu/b", None, "telex"),
                                   (3, "https://i.hu/c", "", "index")],
                                  "page_id bigint, url string, html string, source string")
    got = {r["page_id"]: r for r in html.extract_articles(pages).collect()}
    assert (got[1]["body"], got[1]["lead"], got[1]["category"], got[1]["image_url"], got[1]["title"]) == (
        "Lead textBody one ő<t> &amp;", "Lead text", "sport", "i.png", "The Title")
    assert got[2]["fetch_failed"] and not got[1]["fetch_failed"] and got[3]["body"] == ""
    links = html.harvest_links(pages, "/hirek/").orderBy("pos").collect()
    assert [(x["link"], x["title"]) for x in links] == [
        ("https://t.hu/hirek/1", "One x"), ("https://t.hu/hirek/2", "/hirek/2")]
    assert "menu" not in html.extract_text(pages).where("page_id = 1").first()["text"]
    assert html.meta_fields(pages).where("page_id = 1").first()["section"] == "sport"


def test_page_quality(spark):
    long = PAGE.replace("one", "one " + "word " * 40)
    pages = spark.createDataFrame([(1, "u1", long, "telex"), (2, "u2", PAGE, "telex"), (3, "u3", None, "telex")],
                                  "page_id bigint, url string, html string, source string")
    cand = spark.createDataFrame([("u1", "The title!", "fb"), ("u2", "Other", "fb"), ("u3", "x", None)],
                                 "url string, title string, body_fallback string")
    for c in ("lead", "category", "image_url"):
        cand = cand.withColumn(c, F.lit(None).cast("string"))
    q = html.extraction_quality(html.extract_articles(pages), cand)
    got = {r["page_id"]: r for r in q.collect()}
    assert [got[i]["quality"] for i in (1, 2, 3)] == ["good", "degraded", "fallback"]
    assert [got[i]["skipped"] for i in (1, 2, 3)] == [False, False, True]
    assert got[2]["final_body"] == "fb" and not got[1]["title_mismatch"]


def test_a_very_long_entity_form(spark):
    long = "".join(chr(97 + i * 7 % 26) for i in range(10_000)) + " Ann Lee"
    df = spark.createDataFrame([("g", 1, ["Ann Lee", long, "lee", "Other"])], "k string, id bigint, entities array<string>")
    assert groups.merge_entities(df, "k").first()["entities"] == [long, "Other"]
