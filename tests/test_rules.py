"""Small cases with a known answer."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from mixframe.functions import clean, cues, dates, durations, episodes, lines, templates, text, track_text, urls
from mixframe.operators import catalogue, detect, entities, episodes as episode_jobs, fields, links, merge, ordered, titles as title_jobs, uploads as upload_jobs
from mixframe.plans.stream_queries import run
from mixframe.sources import html_rows, sinks, tracklists, uploads
from mixframe.streaming import jobs


def values(spark, cases, column, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, v {kind}")
    return [r.r for r in df.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def test_cues(spark):
    cases = {"00?": "0:0?", "07?": "1:1?", "0:??:??": "0??", "1:1?": "07?", "58:10": "058", "x": "x", "100": "1:40"}
    assert values(spark, list(cases), cues.toggled) == list(cases.values())


def test_fixed_cues_toggle_back(spark):
    fixed = ["000", "059", "061", "119", "240"]
    assert values(spark, fixed, lambda c: cues.toggled(cues.toggled(c))) == fixed


def test_keys_and_clean_text(spark):
    assert values(spark, ["HÖR", "hor ", "Ünïcode-1"], text.name_key) == ["hor", "hor", "unicode1"]
    raw = "a b c​d\r\ne  f "
    assert values(spark, [raw], text.clean_text) == ["a b cd\ne f"]
    assert values(spark, ["07?", "1:30", "??", None], text.js_int) == [7, 1, None, None]


def test_duplicate_brackets(spark):
    cases = {"Spirits (feat. M) [Drum Version] (Drum Version)": "Spirits (feat. M) (Drum Version)",
             "Spirits (feat. M) (Drum Version) [Drum Version]": "Spirits (feat. M) (Drum Version)",
             "Spirits [Drum Version] [Drum Version]": "Spirits (Drum Version)",
             "Silver Ball (Ø [Phase] Remix)": "Silver Ball (Ø [Phase] Remix)"}
    assert values(spark, list(cases), clean.without_duplicate_brackets) == list(cases.values())


def test_titles(spark):
    cases = {"Foo (2016 - Remaster)": "Foo", "Foo (Original Mix)": "Foo", "Foo - Bar Remix": "Foo (Bar Remix)",
             "Foo (Mixed)": "Foo", "(Foo)": "Foo", "Foo-24070": "Foo", "Foo (Radio Edit)": "Foo"}
    assert values(spark, list(cases), clean.clean_title) == list(cases.values())


def test_norms(spark):
    got = values(spark, ["B & A - Song [Label]", "Solo - Tune (Original Mix)"], track_text.norm_array)
    assert got[0] == ["b - song", "a & b - song", "a - song"]
    assert got[1][0].startswith("solo - tune")


def test_urls(spark):
    v = "afK00BvvtaM"
    forms = [f"https://www.youtube.com/watch?v={v}", f"https://youtu.be/{v}?si=x",
             f"https://www.youtube-nocookie.com/embed/{v}?start=0", f"https://www.youtube.com/shorts/{v}"]
    assert set(values(spark, forms, urls.canonical_url)) == {f"https://www.youtube.com/watch?v={v}"}
    cases = {"https://w.soundcloud.com/player/?url=https%3A//soundcloud.com/a/b&color=1": "https://soundcloud.com/a/b/",
             "https://hearthis.at/embed/123/x/": "https://hearthis.at/123/",
             "https://www.mixcloud.com/widget/iframe/?feed=%2Fa%2Fb%2F": "https://www.mixcloud.com/a/b/",
             "https://www.discogs.com/de/release/1-x?y=1": "https://www.discogs.com/release/1-x"}
    assert values(spark, list(cases), urls.canonical_url) == list(cases.values())
    assert values(spark, ["https://www.a.b/c/"], urls.player_key) == ["a.b/c"]
    assert values(spark, ["https://a.b/x.y.z/"], urls.undotted_slug) == ["https://a.b/xyz/"]


def test_durations(spark):
    cases = {"1:02:03": 3723, "3:18": 198, "PT0M7206S": 7206, "PT1H2M": 3720, "3600000": 3600, "90": 90, "x": None}
    assert values(spark, list(cases), durations.seconds_of) == list(cases.values())


@pytest.mark.parametrize("title, upload, want", [
    ("Act @ Club 13/03/2025", "2025-03-14", "2025-03-13"), ("Set 030426", "2026-04-05", "2026-04-03"),
    ("Live 5th March 2024", "2024-03-06", "2024-03-05"), ("Show | August 2026", "2026-08-30", "2026-08"),
    ("Best of 31.02.2020", "2020-03-01", None), ("20250607 mix", "2025-06-08", "2025-06-07")])
def test_dates(spark, title, upload, want):
    df = spark.createDataFrame([(title, datetime.date.fromisoformat(upload))], "t string, d date")
    got = df.select(dates.find_date("t", "d", F.lit(2026)).alias("r")).head().r
    assert (got.out if got else None) == want


def test_episodes(spark):
    cases = {"Podcast RA.971 - X": ("RA.971", "dotted"), "Show Vol. 12": ("12", "number"), "LIMB #9 – Yuka": ("9", "number"),
             "Mix HATE498": ("HATE498", "id"), "nothing here": None}
    got = values(spark, list(cases), episodes.find_episode)
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_lines(spark):
    assert values(spark, ["1. A - B", "A / B - C", "Rub-A-Dub", "www.x.de", "[00] A – B"], lines.separator) == ["-", "/", None, None, "-"]
    names = ["Guest Mix - Natasha", "First Hour - Ollie:", "Tracklist:", "1. A", "Prose ends here."]
    assert values(spark, names, lines.chapter_name) == ["Natasha", "Ollie", None, None, None]


def texts(spark, found):
    return {r.doc_id: r.text for r in detect.tracklist_texts(found).collect()}


def test_detection(spark):
    docs = {
        1: "Enjoy this one\nhttps://example.org/x\n\nTracklist:\n1. A - One\n2. B - Two\n\n3. C - Three\n4. D - Four\n\nThanks all",
        2: "Just prose, nothing - to see.\nAnd more of it.",
        3: "• A / One\n• B / Two\n• C / Three\n• D / Four",
        4: "A - One 00:01:00\nB - Two 00:05:00- CLASSIC\nC - Three 00:09:00\nD - Four 00:12:00",
        5: "Miret-Sabio Espejo\nSome-Other Night\nDeep-Blue Moon\nFar-Away Home",
        6: "First Hour - Ollie\n\n1. A - One\n2. B - Two\n3. C - Three\n4. D - Four\n\nGuest Mix: Ann\n\n1. E - Five\n2. F - Six\n3. G - Seven\n4. H - Eight",
        7: "1 A - One\n2 B - Two\n3 - C - Three\n4 D - Four\n5 E - Five",
        8: "01. Long Name,\nOther - Song\n02. B - Two\n03. C - Three\n04. D - Four",
        9: "A - One ?\nB - ?\nC - Three\nD - Four",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = texts(spark, detect.detect_tracklists(df))
    assert got == {
        1: "1. A - One\n2. B - Two\n3. C - Three\n4. D - Four",
        3: "A - One\nB - Two\nC - Three\nD - Four",
        4: "[00:01:00] A - One\n[00:05:00] '''CLASSIC:''' B - Two\n[00:09:00] C - Three\n[00:12:00] D - Four",
        5: "Miret - Sabio Espejo\nSome - Other Night\nDeep - Blue Moon\nFar - Away Home",
        6: ";Ollie\n1. A - One\n2. B - Two\n3. C - Three\n4. D - Four\n\n;Ann\n1. E - Five\n2. F - Six\n3. G - Seven\n4. H - Eight",
        7: "1 A - One\n2 B - Two\n3 C - Three\n4 D - Four\n5 E - Five",
        8: "01. Long Name, Other - Song\n02. B - Two\n03. C - Three\n04. D - Four",
        9: "A - One\nB - ?\nC - Three\nD - Four",
    }


def test_comments(spark):
    rows = [("u1", 0, "great set!"), ("u1", 1, "1. A - B 2. C - D 3. E - F 4. G - H 5. I - J 6. K - L"),
            ("u2", 0, "(00)A - B (02)C - D (10)E - F (20)G - H (30)I - J (1:10)K - L"), ("u3", 0, "1. A - B 2. C - D")]
    found = detect.detect_in_comments(spark.createDataFrame(rows, "player_url string, comment_no bigint, body string"))
    got = {r.u: r.n for r in found.groupBy(F.col("doc_id.player_url").alias("u")).agg(F.count("*").alias("n")).collect()}
    # (1:10) is one minute ten, so the cues of u2 run backwards there and only five are left
    assert got == {"u1": 6}


ORIGINAL = "[00] A - One\n[05] ?\n[10] C - Three\n...\n[20] E - Five"
CANDIDATE = "[0] A - One [Lab]\n[6] B - Two\n[10] C - Thre\n[15] D - Four\n[20] E - Five\n[25] F - Six"
MERGED = "[00] A - One [Lab]\n[06] B - Two\n[10] C - Three\n[15] D - Four\n...\n[20] E - Five\n[25] F - Six"


def parsed(spark, text_):
    df = spark.createDataFrame([(1, text_)], "tl_id bigint, text string")
    return tracklists.scan_tracklists(df).withColumnRenamed("tl_id", "pair_id").withColumn("dur", F.lit(None).cast("int"))


def test_merge(spark):
    out = merge.merge_tracklists(parsed(spark, ORIGINAL), parsed(spark, CANDIDATE)).withColumnRenamed("pair_id", "tl_id")
    assert tracklists.write_tracklists(out).head().text == MERGED


def test_merge_loses_no_original(spark):
    orig = parsed(spark, "\n".join(f"[{i:02d}] Act{i} - T{i}" for i in range(0, 60, 7)))
    cand = parsed(spark, "\n".join(f"[{i:02d}] New{i} - X{i}" for i in range(0, 60, 5)) + "\n[03] Act0 - T0")
    names = {r.text for r in merge.merge_tracklists(orig, cand).collect()}
    assert {r.text for r in orig.collect()} <= names


def test_diff(spark):
    a, b = parsed(spark, ORIGINAL), parsed(spark, "[00] a - one\n[05] ?\n[10] C - Three Remix\n[50] Zzz - Qqqqqq")
    got = {(r.side, r.pos): (r.status, r.changed_text) for r in merge.diff_tracklists(a, b).collect()}
    assert got[("b", 1)] == ("same", "") and got[("b", 2)] == ("same", "")
    assert got[("b", 3)] == ("changed", "remix")


# --- nothing is lost

def test_uploads_at_any_depth_and_in_mixed_lists(spark):
    item = '{"url": "https://a.example/%s", "duration": 5}'
    deep = item % "deep"
    for _ in range(40):
        deep = '{"x": [%s]}' % deep
    rows = [(1, deep), (2, '{"c": [%s, 7]}' % (item % "mixed")), (3, '[[1, {"y": %s}], "z"]' % (item % "list")), (4, '{"url": "https://a.example/text", "duration": "5"}'), (5, "no json")]
    got = uploads.scan_uploads(spark.createDataFrame(rows, "ingest_no long, json string"))
    assert {r.player_url.rsplit("/", 1)[1] for r in got.collect()} == {"deep", "mixed", "list"}


def test_norms_grow_with_the_names(spark):
    text_of = lambda n: " & ".join(f"Act{i:02d}" for i in range(n)) + " - Song"
    got = values(spark, [text_of(3), text_of(12), text_of(13), text_of(40)], track_text.norm_array)
    assert [len(g) for g in got] == [4, 13, 14, 41] and all(g[0] == "act00 - song" for g in got)


@pytest.mark.parametrize("block", [2, 100])
def test_scans_keep_rows_without_a_key(spark, block):
    df = spark.createDataFrame([(k, i, i % 3) for k in (None, 1) for i in range(7)], "k int, p int, v int")
    numbered = ordered.dense_pos(df, "k", ["p"], 7, block, "n")
    assert sorted((r.k or 0, r.p, r.n) for r in numbered.collect()) == [(k, i, i + 1) for k in (0, 1) for i in range(7)]
    scanned = ordered.scan(df, "k", "p", 7, block, s=ordered.sum_upto(F.col("v")), b=ordered.lag(F.col("v")))
    want = [(k, i, sum(j % 3 for j in range(i + 1)), (i - 1) % 3 if i else -1) for k in (0, 1) for i in range(7)]
    assert sorted((r.k or 0, r.p, r.s, -1 if r.b is None else r.b) for r in scanned.collect()) == want


def test_player_blocks_keep_options_and_take_every_address(spark):
    pages = spark.createDataFrame([(1, "x\n{{Player|video=audio\n |https://youtu.be/a|t=One\n}}\ny"), (2, "no block")], "page_id long, wikitext string")
    new = spark.createDataFrame([(1, "https://z.example/1"), (1, "https://b.example/2"), (2, "https://b.example/3?a=1")], "page_id long, url string")
    got = {r.page_id: r for r in catalogue.player_blocks(pages, new).collect()}
    assert got[1].wikitext == "x\n{{Player|mode=mirrors|video=audio\n |https://youtu.be/a|t1=One\n |https://b.example/2|t2=Complete\n |https://z.example/1|t3=Complete\n}}\ny"
    assert got[2].player == "{{Player\n |1=https://b.example/3?a=1\n}}" and got[2].wikitext == "no block"


def test_family_keeps_both_types_of_a_title(spark):
    found = spark.createDataFrame([("Circo Loco", "venue", 9), ("Circo Loco", "podcast", 3)], "title string, type string, mixes int")
    out = entities.entity_family(spark.createDataFrame([("Circo",)], "name string"), found, spark.createDataFrame([], "alias string, target string"))
    assert {(r.title, r.type, r.mixes) for r in out.collect()} == {("Circo Loco", "venue", 9), ("Circo Loco", "podcast", 3)}


def test_text_behind_the_last_cue_stays(spark):
    body = "[0:00] A [1:00] B [2:00] C [3:00] D [4:00] E [5:00] F see [1:30] again"
    out = detect.split_cued_comments(spark.createDataFrame([("u", 0, body)], "player_url string, comment_no bigint, body string"))
    raws = [r.raw for r in out.orderBy("line_no").collect()]
    assert len(raws) == 6 and raws[0].endswith("A") and "see" in raws[-1] and raws[-1].endswith("again")


def test_long_mixes_stay_one_text(spark):
    df = spark.range(70_000).selectExpr("1 AS tl_id", "CAST(id + 1 AS INT) AS pos", "'track' AS type", "CAST(NULL AS STRING) AS cue", "'t' AS text", "CAST(NULL AS STRING) AS label")
    assert [r.n for r in tracklists.write_tracklists(df).selectExpr("length(text) AS n").collect()] == [139_999]
    assert tracklists.write_tracklists(df, 10_000).count() == 8


def test_usage_is_unclear_where_an_address_has_a_second_form(spark):
    u = spark.createDataFrame([(1, "https://hearthis.at/12345/"), (2, "https://hearthis.at/dj/set/"), (3, "https://a.example/x"), (4, "https://a.example/y")], "upload_id int, player_url string")
    pages = spark.createDataFrame([("a.example/x", 7, 1)], "url_key string, page_id int, last_edit int")
    want = {1: "unclear", 2: "unclear", 3: "used", 4: "unused"}
    assert {r.upload_id: r.status for r in upload_jobs.player_usage(u, pages).collect()} == want
    parts = {r.url_key: r.part for r in upload_jobs.partition_usage(u, pages).collect()}
    assert parts == {"hearthis.at/12345": "unclear", "hearthis.at/dj/set": "unclear", "a.example/x": "used", "a.example/y": "unused"}


def test_addresses_keep_what_names_the_page(spark):
    cases = {"https://example.com/?p=1&utm_source=x": "https://example.com?p=1", "https://example.com/?p=2#top": "https://example.com?p=2",
             "https://www.youtube.com/playlist?list=PL123&si=9": "https://www.youtube.com/playlist?list=PL123",
             "https://m.soundcloud.com/a/sets/b?si=1": "https://soundcloud.com/a/sets/b", "HTTP://www.Example.com/A/?ref=q": "https://example.com/A"}
    assert values(spark, list(cases), urls.canonical_url) == list(cases.values())


def test_names_fold_by_decomposition(spark):
    assert values(spark, ["Timișoara", "Nguyễn", "ǍȚ"], text.name_key) == ["timisoara", "nguyen", "at"]


def test_more_episode_words(spark):
    cases = {"Whose These Cast 02": "02", "Radioshow 12": "12", "Mixtape 7": "7", "Folge 3": "3", "Label Recordings 44": "44"}
    got = values(spark, list(cases), episodes.find_episode)
    assert [g.text if g else None for g in got] == list(cases.values())


def test_crawled_cells_keep_class_and_block(spark):
    row = '<tr><td><p>x</p><ul><li>y</li></ul><span class="artist"><a href="q">Act{0}</a></span></td><td>T{0}</td></tr>'
    html = "<table>" + "".join(row.format(i) for i in range(9)) + "</table>"
    pages = spark.createDataFrame([(1, "https://h.example/p", html)], "page_id long, url string, html string")
    spec = spark.createDataFrame([("h.example", "table", "artist", "artist", None), ("*", "table", "title", None, 1)], "host string, kind string, role string, class_pattern string, cell int")
    out = html_rows.scan_html_rows(pages, spec).orderBy("pos").collect()
    assert [r.text for r in out] == [f"Act{i} - T{i}" for i in range(9)]


def test_pages_without_an_address_follow_the_rules_for_every_page(spark):
    html = "<table>" + "".join(f"<tr><td>Act{i}</td><td>T{i}</td></tr>" for i in range(9)) + "</table>"
    pages = spark.createDataFrame([(1, None, html), (2, "no address", html), (3, "https://h.example/p", html)], "page_id long, url string, html string")
    spec = spark.createDataFrame([("*", "table", "artist", None, 0), ("*", "table", "title", None, 1)], "host string, kind string, role string, class_pattern string, cell int")
    out = html_rows.scan_html_rows(pages, spec).collect()
    assert sorted((r.page_id, r.pos, r.text) for r in out) == [(p, i + 1, f"Act{i} - T{i}") for p in (1, 2, 3) for i in range(9)]


def test_video_titles_and_search_keys(spark):
    cases = {"Act - Song (Official Video) [HD]": "Act - Song", "PREMIERE: Act - Song [Label] [CAT001]": "Act - Song", "Act | Song_mix.mp4": "Act - Song mix",
             "[2019] Act - Song": "Act - Song", "Act - Song (2019)": "Act - Song", "Act -- Song 1080p": "Act - Song"}
    assert values(spark, list(cases), clean.video_title) == list(cases.values())
    row = fields.search_keys(spark.createDataFrame([("Act - Song (Mixed) [X]",)], "title string")).head()
    assert row.streaming == "Act - Song (X)" and row.search == "Act Song Mixed X"


def test_major_labels_are_a_table(spark):
    tracks = spark.createDataFrame([("A", "T", "Small, BIG Co"), ("A", "T", "Big Co"), ("A", "T", "Small")], "artist string, title string, label string")
    out = fields.track_fields(tracks, spark.createDataFrame([("big co",)], "label string"))
    assert sorted(r.label for r in out.collect()) == ["", "Small", "Small"]


def test_episode_keys_come_in_order(spark):
    keys = ["b", "10", "A", "9", "a", "100", "Special 2"]
    out = episode_jobs.order_episode_keys(spark.createDataFrame([(k,) for k in keys], "episode_key string"))
    assert [r.episode_key for r in out.collect()] == ["9", "10", "100", "A", "a", "b", "Special 2"]


def test_episode_map_is_written_newest_first(spark, tmp_path):
    rows = [("a", i, f"https://x.example/{i}", i % 2) for i in range(30)] + [("b", 1, "https://x.example/b", 5)]
    sinks.write_episode_map(spark.createDataFrame(rows, "source string, episode_no int, url string, duration_s int"), str(tmp_path / "map"))
    files = sorted((tmp_path / "map" / "source=a").glob("part-*"))
    numbers = [[int(json.loads(line)["entry"].split('"')[1]) for line in f.read_text().splitlines()] for f in files]
    assert sorted(n for f in numbers for n in f) == list(range(30)) and all(f == sorted(f, reverse=True) for f in numbers)


def test_wrapped_lines_are_read_from_the_top(spark):
    df = spark.createDataFrame([(1, "x y z,\n2. B,\n01. Long Name,\nb\nA - One,\nc"), (2, "a,\n\nb"), (3, "1. a,\n2. b\nend,")], "doc_id bigint, text string")
    out = detect.join_wrapped_lines(detect.classify_lines(detect.text_lines(df)))
    got = {}
    for r in out.orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.cleaned)
    assert got == {1: ["", "", "", "x y z, 2. B, 01. Long Name, b", "A - One,", "c"], 2: ["a,", "", "b"], 3: ["1. a,", "2. b", "end,"]}


def test_stream_latest_keeps_all_answers_of_the_newest_generation(spark, tmp_path):
    rows = [("k", "2024-01-01 01:00:00", 5, "b"), ("k", "2024-01-01 02:00:00", 5, "a"), ("k", "2024-01-01 03:00:00", 4, "z"),
            ("k", "2024-01-02 01:00:00", 3, "old"), ("k", "2024-01-03 01:00:00", 6, "new"), ("m", "2024-01-02 01:00:00", None, "only"),
            ("k", "2024-01-09 00:00:00", 9, "open")]
    feed = spark.createDataFrame(rows, "key string, ts string, generation long, value string").withColumn("ts", F.col("ts").cast("timestamp"))
    feed.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    out = run(jobs.stream_latest(stream, "1 hour", "1 day"))
    assert sorted((r.key, r.started.day, r.generation, r.value) for r in out.collect()) == [
        ("k", 1, 5, "a"), ("k", 1, 5, "b"), ("k", 3, 6, "new"), ("m", 2, None, "only")]


def test_links_however_they_are_written(spark):
    html = ("<a href=one>1</a><A title='x > y' HREF='two'>2</A><a\n  data-x=\"href='no'\" href = \"three\" >3</a><!-- <a href=no> --><script>'<a href=no>'</script>"
            "<iframe data-src=/four src='about:blank'></iframe><a href>none</a><a href=''>none</a><area href=no><source src=/five/><a href=/six" + " x='y'" * 5000 + ">6</a><a href='open>7")
    df = spark.createDataFrame([(1, "https://h.example/d/p", html), (2, None, None), (3, "https://h.example", "")], "page_id long, url string, html string")
    got = [(r.page_id, r.pos, r.raw) for r in links.scan_links(df).orderBy("page_id", "pos").collect()]
    assert [(p, r) for p, _, r in got] == [(1, "one"), (1, "two"), (1, "three"), (1, "/four"), (1, "about:blank"), (1, "/five/"), (1, "/six")]
    assert [p for _, p, _ in got] == list(range(7))


def _asked(spark, tmp_path, rows, ttl):
    feed = spark.createDataFrame(rows, "key string, ts timestamp, answer string")
    feed.coalesce(1).write.parquet(str(tmp_path / "asked"))
    return run(jobs.stream_ttl_lookup(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "asked")), "1 second", ttl))


def test_many_requests_of_one_key(spark, tmp_path):
    """Every timer opens its own second only: the cost grows with the requests."""
    start = datetime.datetime(2024, 1, 1)
    rows = [("k", start + datetime.timedelta(seconds=i), None if i % 7 else f"a{i}") for i in range(1_000)]
    began = time.time()
    got = _asked(spark, tmp_path, rows, (50, 20)).collect()
    assert time.time() - began < 90
    kinds, ends, answer = {}, -1, None
    for i, (_, at, found) in enumerate(rows):
        if i >= ends:
            kinds[at], answer, ends = ("ask", found), found, i + (20 if found is None else 50)
        else:
            kinds[at] = ("hit", answer)
    got = {r.ts: (r.kind, r.answer) for r in got}
    assert len(got) >= 990 and all(kinds[t] == v for t, v in got.items())


def test_columns_in_either_order(spark):
    def table(rows):
        return "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table>"
    plain = [(f"Act {i % 3}", f"Tune {i}") for i in range(9)]
    marked = [(f"Tune {i}" + (" (Deep Mix)" if i % 4 == 0 else ""), f"Act {i}") for i in range(9)]
    even = [(f"Act {i}", f"Tune {i}") for i in range(9)]
    pages = [(1, table(plain)), (2, table([(b, a) for a, b in plain])), (3, table(marked)), (4, table([(b, a) for a, b in marked]) + table(marked)), (5, table(even))]
    df = spark.createDataFrame([(p, None, h) for p, h in pages], "page_id long, url string, html string")
    spec = spark.createDataFrame([("*", "table", "left", None, 0), ("*", "table", "right", None, 1)], "host string, kind string, role string, class_pattern string, cell int")
    got = html_rows.scan_html_rows(df, spec).collect()
    assert len(got) == 54 and all(r.artist.startswith("Act") and r.title.startswith("Tune") for r in got)


def test_tight_dashes_in_comments(spark):
    tight = [f"Act{c}-Song {c * 2} Long" for c in "ABCDEFGH"]
    numbered = " ".join(f"{i}. {t}" for i, t in enumerate(tight, 1))
    cued = " ".join(f"({i * 5:02d}) {t}" for i, t in enumerate(tight))
    words = " ".join(f"{i}. well-known" for i in range(1, 9))  # nothing reads on behind the dash
    plain = " ".join(f"{i}. Act - A-Side of {i}" for i in range(1, 9))
    rows = [("u1", 0, numbered), ("u2", 0, cued), ("u3", 0, words), ("u4", 0, plain), ("u5", 0, None), ("u6", 0, "")]
    found = detect.detect_in_comments(spark.createDataFrame(rows, "player_url string, comment_no bigint, body string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.doc_id.player_url, r.line_no)):
        got.setdefault(r.doc_id.player_url, []).append(r.line)
    assert sorted(got) == ["u1", "u2", "u4"]
    assert len(got["u1"]) == 8 and got["u1"][0].endswith("ActA - Song AA Long") and got["u2"][7].endswith("ActH - Song HH Long")
    assert got["u4"][3].endswith("Act - A-Side of 4")


def test_player_templates():
    add = lambda text, *new: templates.with_players(text, list(new))[1]
    # what is not an address stays, nested braces and links included; foreign templates are not touched
    assert add("{{Playerbox|1=https://a.example}}", ("https://z.example", None)) == "{{Playerbox|1=https://a.example}}"
    nested = "A {{Other|{{x|y}}}} {{Player|video=audio|note={{small|a|b}}|mode=mirrors\n |1=https://a.example/?x=1\n |2=https://b.example|t2=Two\n |link=[[File:x|y]]\n}} B }} {{"
    assert add(nested) == ("A {{Other|{{x|y}}}} {{Player|mode=mirrors|video=audio|note={{small|a|b}}\n |1=https://a.example/?x=1|t1=Complete\n |2=https://b.example|t2=Two\n |link=[[File:x|y]]\n}} B }} {{")
    # an empty slot, one line, a part with a title
    assert add("{{Player\n |https://a.example\n |\n}}", ("https://b.example", None)) == "{{Player|mode=mirrors\n |https://a.example\n |https://b.example\n}}"
    assert add("{{Player|https://a.example}}", ("https://soundcloud.com/x", None)) == "{{Player|mode=mirrors\n |https://soundcloud.com/x\n |https://a.example\n}}"
    assert add("{{Player|mode=mirrors\n |https://a.example\n}}", ("https://soundcloud.com/2", "Part 2")) == (
        "{{Player|mode=multi\n |https://a.example|t1=Complete\n |https://soundcloud.com/2|t2=Part 2\n}}")
    assert add("{{Player\n |https://a.example\n}}", ("https://a.example", None)) == "{{Player\n |https://a.example\n}}"
    # never closed, empty
    assert add("{{Player|https://a.example", ("https://b.example", None)) == "{{Player|https://a.example" and add("", ("https://b.example", None)) == ""
    assert add("{{Note|{{Player}}|a|b}}", ("https://b.example", None)) == "{{Note|{{Player\n |https://b.example\n}}|a|b}}"


def test_titles_with_several_artists(spark):
    known = [("Night Show", "podcast", 9), ("Ann Act", "artist", 5), ("Bob Beat", "artist", 4), ("Cee Cee", "artist", 3), ("Dee Dub", "artist", 2), ("The Club", "venue", 8)]
    entities_ = spark.createDataFrame(known, "title string, type string, mixes long")
    lookup = entities.lookup_table(entities_, spark.createDataFrame([], "alias string, target string"))
    titles_ = {1: "Night Show 12 - ann act & DJ Bob Beat - 2024-05-01", 2: "Night Show 13 w/ Someone New, Cee Cee - 2024-05-02", 3: "Ann Act b2b Nobody Else @ The Club 2024-05-03",
               4: "Night Show - Ann Act - Bob Beat - Cee Cee - Dee Dub - 2024-05-04", 5: "Night Show 14 - Unknown & Stranger - 2024-05-05", 6: "Night Show 15 - Bob Beat (Live) - 2024-05-06", 7: None}
    df = spark.createDataFrame([(i, t, datetime.date(2024, 6, 1)) for i, t in titles_.items()], "upload_id long, title string, created_at date")
    got = {r.upload_id: (r.artist, r.entity) for r in title_jobs.suggest_titles(df, lookup).collect()}
    assert got[1] == ("Ann Act & Bob Beat", "Night Show") and got[2] == ("Someone New & Cee Cee", "Night Show")
    assert got[3] == ("Ann Act & Nobody Else", "The Club") and got[4] == ("Ann Act", "Night Show")
    assert got[5] == ("Unknown & Stranger", "Night Show") and got[6][1] == "Night Show" and got[6][0].startswith("Bob Beat") and got[7] == (None, None)


def test_crawled_cells_are_parsed_and_exchanged_once(spark):
    """No step behind the cells reads the pages again or brings the cells of a block together twice."""
    html = "<table>" + "".join(f"<tr><td>Act {i % 3}</td><td>Tune {i}</td></tr>" for i in range(9)) + "</table>"
    pages = spark.createDataFrame([(1, "https://a.example/1", html), (2, None, html)], "page_id long, url string, html string")
    spec = spark.createDataFrame([("*", "table", "left", None, 0), ("*", "table", "right", None, 1), ("b.example", "table", "label", "x", None)],
                                 "host string, kind string, role string, class_pattern string, cell int")
    out = html_rows.scan_html_rows(pages, spec)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange hashpartitioning(page_id") == 1
    assert sorted((r.page_id, r.pos, r.text) for r in out.collect()) == [(p, i + 1, f"Act {i % 3} - Tune {i}") for p in (1, 2) for i in range(9)]


def test_equal_names_do_not_meet_in_all_pairs(spark):
    """Forty rows of one title and forty of its alias are one answer each, that with most mixes."""
    rows = [("Act", "artist", i) for i in range(40)] + [("Hall (Club)", "venue", 3), ("Hall (Club)", "venue", 9), ("Act", None, 99)]
    every = spark.createDataFrame(rows, "title string, type string, mixes int")
    aliases = spark.createDataFrame([("Äct 2", "Act")] * 40, "alias string, target string")
    got = sorted((r.key, r.title, r.mixes, r.match_type) for r in entities.best_lookup(every, aliases).collect())
    assert got == [("act", "Act", 39, "exact"), ("act2", "Act", 39, "redirect"), ("hall", "Hall (Club)", 9, "qualified"), ("hallclub", "Hall (Club)", 9, "exact")]


def test_texts_and_comments_are_read_once(spark):
    """Each text and comment is made a single time, however many passes look at it."""
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    seen = F.udf(counted, "string").asNondeterministic()
    listed = "\n".join(f"{i}. Act {i} - Tune {i}" for i in range(1, 9))
    docs = spark.createDataFrame([(1, listed), (2, "prose\r\nonly\rhere"), (3, None)], "doc_id long, text string")
    notes = spark.createDataFrame([(2, 0, listed.replace("\n", " ")), (3, 0, "nice")], "player_url long, comment_no long, body string")
    found = detect.detect_tracklists(docs.withColumn("text", seen("text")), notes.withColumn("body", seen("body")))
    assert sorted((r.doc_id, r.source) for r in found.select("doc_id", "source").distinct().collect()) == [(1, "text"), (2, "comment")]
    assert read.value == 5
    assert detect.most_lines(docs) >= detect.text_lines(docs).agg(F.max("line_no")).head()[0] + 1


def test_cued_comments_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    bodies = [" ".join(f"({i:02d}) Act {i} - Tune {i}" for i in range(7)), "no cue", None]
    notes = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "player_url long, comment_no long, body string")
    got = detect.split_cued_comments(notes.withColumn("body", F.udf(counted, "string").asNondeterministic()("body"))).collect()
    assert sorted((r.comment_no, r.line_no, r.raw) for r in got) == [(0, i + 1, f"[{i:02d}] Act {i} - Tune {i}") for i in range(7)]
    assert read.value == 3
