"""Jobs over catalogue pages: titles, categories, siblings, duplicates, players."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import templates, vocab
from ..functions.text import col, name_key
from ..functions.urls import host
from . import ordered as O

CATEGORY = r"\[\[Category:([^\]|]+)(?:\|([^\]]*))?\]\]"
PLAYER = r"\{\{Player((?:\|(?!\d+=)[a-z]+=[^|\n{}]*)*)([^{}]*)\}\}"
RECENT = 10
NEWEST = 5
SHARE = 0.9
SIMILAR = 10
MAX_AGE_YEARS = 3
LENGTH_TOLERANCE = 0.3
NOTES_MIN_PATH = 10


def player_mode(options) -> Column:
    """The mode among the options of a player block, empty without one."""
    return F.regexp_extract(options, r"\|mode=([a-z]+)", 1)


def page_categories(pages: DataFrame) -> DataFrame:
    """One row per page and category; a key given in the category link outranks the page's own."""
    links = F.regexp_extract_all("wikitext", F.lit(CATEGORY), 0)
    out = pages.select("*", F.explode(links).alias("_link"))
    own = F.nullif(F.regexp_extract("_link", CATEGORY, 2), F.lit(""))
    return (out.withColumn("category", F.trim(F.regexp_extract("_link", CATEGORY, 1)))
            .withColumn("sortkey", F.coalesce(own, F.col("title"))).drop("_link"))


def recent_pages(categorised: DataFrame, n: int = RECENT) -> DataFrame:
    """Newest ``n`` pages per category by sort key.  WindowGroupLimit cuts each category to ``n``
    rows per task before the shuffle, so its size does not matter."""
    w = Window.partitionBy("category").orderBy(F.col("sortkey").desc(), F.col("page_id").desc())
    return categorised.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_sources(pages: DataFrame, n: int = RECENT, without: list[str] | tuple = ()) -> DataFrame:
    """The newest pages of each category with their source: ranked by keys alone, the text joined to the winners."""
    keys = page_categories(pages).select("category", "sortkey", "page_id").where(~F.col("category").isin(*without))
    return recent_pages(keys, n).join(pages, "page_id")


def recent_titles(categorised: DataFrame, n: int = RECENT) -> DataFrame:
    top = recent_pages(categorised, n).groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("_t"))
    return top.select("category", F.transform("_t", lambda t: t["title"]).alias("recent"))


def _stem(text: Column) -> Column:
    return F.lower(F.translate(text, "_", " "))


def page_signals(pages: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """What each page says about its series: ``signals ARRAY<STRUCT<signal, answer>>``."""
    w = F.col("wikitext")
    show = F.regexp_extract(w, r"\{\{(StandardShow[^}|]+)\}\}", 1)
    details = F.when(show != "", show).when(w.contains("{{NormalTableFormat}}"), "table").otherwise("none")
    file = F.regexp_extract(w, r"\[\[(?:File|Image):([^\]|]+)", 1)
    stem = F.regexp_replace(file, r"\.[A-Za-z0-9]+$", "")
    image = F.when(file == "", "none").when(_stem(stem) == _stem(F.col("title")), "same").otherwise("other")
    notes = F.trim(F.regexp_extract(w, r"==\s*Notes\s*==\s*\n([^=]*)", 1))
    has_notes = w.rlike(r"==\s*Notes\s*==")
    link = F.regexp_extract(notes, r"(https?://\S+)", 1)
    notes_host = F.when(link == "", "none").otherwise(host(link))
    mode = player_mode(F.regexp_extract(w, PLAYER, 1))
    player = (F.when(~w.rlike(r"\{\{Player"), "none").when(mode == "mirrors", "mirrors")
              .when(mode == "", "plain").otherwise("other"))
    live = F.col("title").contains("@")
    pairs = [("details", details), ("image", image), ("notes", F.when(has_notes, "yes").otherwise("none")),
             ("notes_host", notes_host), ("player", player)]
    base = F.array(*[F.struct(F.lit(s).alias("signal"), a.alias("answer")) for s, a in pairs])
    cats = F.transform(F.regexp_extract_all(w, F.lit(CATEGORY), 1), lambda c: F.struct(
        F.lit("style").alias("signal"), F.trim(c).alias("answer")))
    return pages.withColumn("signals", F.concat(base, cats)).withColumn("live", live)


def learn_conventions(pages: DataFrame, share: float = SHARE, n: int = RECENT, newest: int = NEWEST) -> DataFrame:
    """Verdict per category and signal: the answer 90 % of the newest pages give, or the newest
    five give as one.  'none' never wins; live recordings have no say on the image unless all are.
    """
    top = recent_sources(pages, n, vocab.BUCKETS)
    read = page_signals(top)
    by_page = read.select("category", "page_id", "rank", "live", F.explode(F.array_distinct("signals")).alias("s")).select(
        "category", "page_id", "rank", "live", "s.*")
    # the category itself and the year stand on every page: no style
    by_page = by_page.where((F.col("signal") != "style") | (
        (F.col("answer") != F.col("category")) & ~F.col("answer").rlike(r"^\d{4}$|^Tracklist:")))
    per_category = read.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(~F.col("live")).alias("n_studio"),
        F.count_if(F.col("rank") <= newest).alias("n_new"),
        F.count_if((F.col("rank") <= newest) & ~F.col("live")).alias("n_new_studio"),
        F.max("sortkey").alias("newest_key"))
    joined = by_page.join(per_category, "category")
    image = (F.col("signal") == "image") & (F.col("n_studio") > 0)
    votes = joined.where(~(image & F.col("live"))).groupBy("category", "signal", "answer").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= newest).alias("n5"),
        F.first(F.when(image, F.col("n_studio")).otherwise(F.col("n_pages"))).alias("of"),
        F.first(F.when(image, F.col("n_new_studio")).otherwise(F.col("n_new"))).alias("of5"),
        F.first("newest_key").alias("newest_key"))
    wins = (F.col("answer") != "none") & ((F.col("n") >= F.col("of") * share)
                                         | ((F.col("of5") >= newest) & (F.col("n5") == F.col("of5"))))
    return votes.where(wins).select("category", "signal", "answer", "n", "of", "newest_key")


def apply_conventions(mixes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts that hold for a mix: its series is alive, is a series, and fits the stated length.

    ``mixes(mix_id, category, mix_date, duration_s, numbered, types ARRAY)``.
    """
    out = mixes.join(verdicts, "category")
    alive = F.add_months(F.to_date(F.substring("newest_key", 1, 10)), 12 * MAX_AGE_YEARS) >= F.col("mix_date")
    place = F.col("numbered") & (F.size("types") > 0) & F.forall("types", lambda t: t.isin(*vocab.PLACE_TYPES))
    length = F.regexp_extract("answer", r"^StandardShow(\d+)(h|min)$", 1).try_cast("int")
    stated = F.when(F.col("answer").endswith("min"), length * 60).otherwise(length * 3600)
    off = F.coalesce(F.abs(F.col("duration_s") - stated) > stated * LENGTH_TOLERANCE, F.lit(False))
    return out.where(alive & ~place & ~((F.col("signal") == "details") & off))


def page_players(pages: DataFrame) -> DataFrame:
    """Lines of each page's first player block: ``(page_id, mode, line_no, url)``."""
    block = F.regexp_extract("wikitext", PLAYER, 0)
    lines = F.filter(F.transform(F.split(F.regexp_extract(block, PLAYER, 2), r"\n"), lambda l: F.regexp_replace(F.trim(l), r"^\|(?:\d+=)?", "")),
                     lambda l: l != "")
    return pages.where(block != "").select(
        "page_id", player_mode(F.regexp_extract(block, PLAYER, 1)).alias("mode"), F.posexplode(lines).alias("_i", "url")).select(
        "page_id", "mode", (F.col("_i") + 1).alias("line_no"), "url")


def learn_slot(pages: DataFrame, n: int = RECENT) -> DataFrame:
    """Line a host occupies in a series' mirror players, only if every mirror page agrees."""
    top = recent_sources(pages, n).select("category", "page_id", "wikitext")
    lines = page_players(top.select(F.struct("category", "page_id").alias("page_id"), "wikitext"))
    lines = lines.where(F.col("mode") == "mirrors").select("page_id.category", "page_id.page_id", "line_no", host("url").alias("host"))
    mirrors = lines.groupBy("category").agg(F.countDistinct("page_id").alias("n_pages"))
    slots = lines.groupBy("category", "host").agg(
        F.countDistinct("page_id").alias("n"), F.min("line_no").alias("slot"), F.max("line_no").alias("_hi"))
    return (slots.join(mirrors, "category").where((F.col("n") == F.col("n_pages")) & (F.col("slot") == F.col("_hi")))
            .select("category", "host", "slot", "n_pages"))


def series_id_prefix(categorised: DataFrame, n: int = RECENT) -> DataFrame:
    """Letters of the bracketed ids most used in a series' recent titles, if used at least twice."""
    top = recent_pages(categorised, n)
    entity = F.element_at(F.split("title", " - "), -1)
    bracket = F.regexp_extract(entity, r"^(.*?)\s*\(([^()]*)\)$", 2)
    name = F.regexp_extract(entity, r"^(.*?)\s*\(([^()]*)\)$", 1)
    letters = F.regexp_extract(F.trim(bracket), r"^([A-Za-z]{2,})[\s.#-]*\d{1,5}$", 1)
    hits = (top.where((letters != "") & (name_key(name) == name_key("category")))
            .select("category", "rank", letters.alias("letters")))
    counts = hits.groupBy("category", F.upper("letters").alias("_u")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("letters", "rank").alias("prefix"), F.min("rank").alias("_r"))
    best = counts.groupBy("category").agg(F.min_by(F.struct("prefix", "n"), F.struct(-F.col("n"), "_r")).alias("b"))
    return best.select("category", "b.prefix", "b.n").where(F.col("n") >= 2)


def audit_counters(entities: DataFrame, page_cats: DataFrame) -> DataFrame:
    """Stored member counts that differ from the true ones, either way."""
    true = page_cats.groupBy(F.col("category").alias("title")).agg(F.count(F.lit(1)).alias("counted"))
    out = entities.select("title", F.col("mixes").alias("stored")).join(true, "title", "left")
    out = out.withColumn("counted", F.coalesce("counted", F.lit(0)))
    return out.where(F.col("stored") != F.col("counted")).withColumn("drift", F.col("stored") - F.col("counted"))


def mirror_usage(uploads: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose source carries an upload's ``account/track``, HTML comments included.

    Every pair of neighbouring path parts is read off each page once; the rest is an equi-join.
    """
    tokens = F.regexp_extract_all(F.lower("wikitext"), F.lit(r"[^\s|<>\"\[\]{}?#]+/[^\s|<>\"\[\]{}?#]+"), 0)
    parts = pages.select("page_id", F.explode(tokens).alias("_t")).select("page_id", F.split("_t", "/+").alias("_p"))
    pairs = parts.where(F.size("_p") > 1).select("page_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_p") - 1),
        lambda i: F.concat(F.element_at("_p", i), F.lit("/"), F.element_at("_p", i + 1)))).alias("slug"))
    per_slug = pairs.distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))
    return uploads.where(F.col("slug").isNotNull()).join(per_slug, "slug")


def siblings_around(mixes: DataFrame, categorised: DataFrame, k: int = 3, window_days: int = 60) -> DataFrame:
    """The three pages of a mix's category nearest to its date.

    The nearest before and after are carried along one ordered pass per category, so a big
    category is never joined with itself.  ``mixes(mix_id, category, mix_date)``.
    """
    page = F.struct(F.col("day"), "page_id", "title")
    p = categorised.select("category", F.to_date(F.substring("sortkey", 1, 10)).alias("day"), "page_id", "title").where(F.col("day").isNotNull())
    size = O.largest_group(p, "category")
    p = O.dense_pos(p, "category", ["day", "page_id"], size, name="_i").withColumn("_back", F.array(page)).withColumn("_on", F.array(page))
    for step in range(1, k):
        p = O.scan(p, "category", "_i", size, _b=O.lag(F.col("_back")), _f=O.lead(F.col("_on")))
        more = lambda own, near: F.concat(F.array(page), F.slice(F.coalesce(F.col(near), F.array().cast(p.schema["_back"].dataType)), 1, step))  # noqa: E731, B023
        p = p.withColumn("_back", more("_back", "_b")).withColumn("_on", more("_on", "_f")).drop("_b", "_f")
    pages = p.select("category", "day", F.lit(0).alias("side"), F.col("page_id").alias("id"), "_back", "_on")
    none = F.lit(None).cast(p.schema["_back"].dataType)
    asks = mixes.select("category", F.col("mix_date").alias("day"), F.lit(1).alias("side"), F.col("mix_id").alias("id"),
                        none.alias("_back"), none.alias("_on"))
    both = O.dense_pos(pages.unionByName(asks), "category", ["day", "side", "id"], None, name="_i")
    both = O.scan(both, "category", "_i", None, _b=O.last_before(F.col("_back")), _f=O.first_after(F.col("_on")))
    empty = F.array().cast(p.schema["_back"].dataType)

    def tagged(c, after):
        return F.transform(F.coalesce(F.col(c), empty), lambda x: F.struct(
            F.abs(F.datediff(x["day"], F.col("day"))).alias("days"), F.lit(after).alias("after"),
            (x["page_id"] * (1 if after else -1)).alias("o"), x["page_id"].alias("page_id"), x["title"].alias("title")))

    near = F.filter(F.array_sort(F.concat(tagged("_b", 0), tagged("_f", 1))), lambda x: x["days"] <= window_days)
    return (both.where(F.col("side") == 1).select(F.col("id").alias("mix_id"), "category", F.posexplode(F.slice(near, 1, k)).alias("rank", "s"))
            .select("mix_id", "category", (F.col("rank") + 1).alias("rank"), "s.days", "s.page_id", "s.title"))


def split_artists(field) -> Column:
    names = F.transform(F.split(col(field), vocab.TITLE_JOINERS), lambda a: F.trim(F.regexp_replace(a, vocab.MARKERS, "")))
    return F.filter(names, lambda a: a != "")


def parse_page_titles(pages: DataFrame, title: str = "title") -> DataFrame:
    """``date - artist @ places - entity`` to year, artists, entity and entities."""
    bits = F.split(F.col(title), r"\s+[-–—]\s+")
    year = F.regexp_extract(title, r"^\s*(\d{4})", 1)
    field = F.coalesce(F.get(bits, F.lit(1)), F.lit(""))
    third = F.coalesce(F.get(bits, F.lit(2)), F.lit(""))
    group = F.coalesce(F.get(F.split(field, r"\s+@\s+"), F.lit(1)), F.lit(""))
    places = F.filter(F.transform(F.split(group, r"\s*,\s*|\s+[xX]\s+"), lambda p: F.trim(F.regexp_replace(p, vocab.MARKERS, ""))), lambda p: p != "")
    by_place = (third == "") & (group != "")
    entity = F.when(by_place, F.coalesce(F.get(places, F.lit(0)), F.lit(""))).otherwise(F.trim(F.regexp_replace(third, vocab.MARKERS, "")))
    entities = F.when(by_place, F.array_distinct(places)).when(entity != "", F.array(entity)).otherwise(F.array().cast("array<string>"))
    return (pages.withColumn("year", year).withColumn("artists", split_artists(F.split(field, r"\s+@\s+")[0]))
            .withColumn("entity", entity).withColumn("entities", entities))


def duplicate_candidates(mixes: DataFrame, pages: DataFrame, k: int = SIMILAR) -> DataFrame:
    """Pages that may already hold a mix: same title, or title naming an artist and the year.

    Similar pages are counted and their newest ``k`` titles kept per artist and year before the
    join: a mix meets one row per artist, however many pages that artist has.
    """
    exact = mixes.select("mix_id", "title").join(pages.select("title", "page_id"), "title").groupBy("mix_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("title").alias("titles")).withColumn("kind", F.lit("exact"))
    keyed = lambda df, i: parse_page_titles(df).select(i, "title", "year", F.explode(F.transform(
        "artists", lambda a: name_key(a))).alias("artist")).where((F.col("artist") != "") & (F.col("year") != ""))
    p = keyed(pages, "page_id").distinct()
    counts = p.groupBy("year", "artist").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("year", "artist").orderBy(F.col("title").desc(), "page_id")
    newest = (p.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("year", "artist")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda t: t["title"]), "; ").alias("titles")))
    similar = keyed(mixes, "mix_id").join(counts, ["year", "artist"]).join(newest, ["year", "artist"])
    similar = similar.select("mix_id", F.concat(F.lit("similar:"), "artist").alias("kind"), "n", "titles")
    return exact.select("mix_id", "kind", "n", "titles").unionByName(similar.distinct())


def category_plan(mixes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Categories of each page in filing order, flagged known or not.

    ``mixes(mix_id, title, styles ARRAY, tl_status)``; ``lookup`` as entities.lookup_table gives it.
    """
    parsed = parse_page_titles(mixes)
    promo = F.col("title").rlike(r"(?i)\(\s*Promo Mix\s*\)") | (F.col("entity") == "")
    wanted = F.concat(
        F.transform(F.array("year"), lambda c: F.struct(F.lit("year").alias("kind"), c.alias("category"))),
        F.transform("artists", lambda c: F.struct(F.lit("artist").alias("kind"), c.alias("category"))),
        F.when(promo, F.array(F.struct(F.lit("bucket").alias("kind"), F.lit(vocab.BUCKETS[0]).alias("category")))).otherwise(
            F.transform("entities", lambda c: F.struct(F.lit("entity").alias("kind"), c.alias("category")))),
        F.transform("styles", lambda c: F.struct(F.lit("style").alias("kind"), c.alias("category"))),
        F.array(F.struct(F.lit("status").alias("kind"), F.concat(F.lit("Tracklist: "), "tl_status").alias("category"))))
    rows = parsed.select("mix_id", F.posexplode(F.filter(wanted, lambda w: w["category"] != "")).alias("pos", "c")).select("mix_id", "pos", "c.*")
    order = F.struct(F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "redirect", 1).otherwise(2), -F.col("mixes"), F.col("title"))
    best = lookup.groupBy("key").agg(F.min_by(F.struct("title", "mixes"), order).alias("m"))
    ask = F.when(F.col("kind").isin("artist", "entity"), name_key("category"))
    out = rows.withColumn("key", ask).join(best, "key", "left")
    return out.select("mix_id", "pos", "kind", "category", F.col("m").isNotNull().alias("known"),
                      F.coalesce("m.title", "category").alias("canonical"), F.coalesce("m.mixes", F.lit(0)).alias("mixes"))


def notes_url(uploads: DataFrame, verdicts: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Link for a page's notes: in the description, then the buy link, on the host the series uses.

    ``uploads(upload_id, series, description, buy_url)``, ``verdicts(series, host)``.  A shortened
    link counts through ``redirects(short, target)``, judged by the same rule.
    """
    pattern = r"(?:https?://)?(?:www\.)?[A-Za-z0-9.-]+\.[a-z]{2,10}/\S*"
    links = lambda c, no: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0),
                                      lambda u, i: F.struct(F.lit(no).alias("source"), i.alias("at"), u.alias("url")))
    rows = uploads.select("upload_id", "series", F.inline(F.concat(links("description", 0), links("buy_url", 1))))
    rows = rows.join(verdicts.select("series", F.col("host").alias("want")), "series")
    if redirects is not None:
        bare = F.regexp_replace("url", r"^https?://", "")
        short = redirects.select(F.regexp_replace("short", r"^https?://", "").alias("_s"), "target")
        rows = rows.withColumn("_s", bare).join(short, "_s", "left").withColumn("via", F.col("target").isNotNull())
        rows = rows.withColumn("url", F.coalesce("target", "url"))
    else:
        rows = rows.withColumn("via", F.lit(False))
    full = F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url"))
    rows = rows.withColumn("url", full)
    path = F.regexp_extract("url", r"^https?://[^/]+/?(.*)$", 1)
    ok = rows.where((host("url") == F.col("want")) & (F.length(path) >= NOTES_MIN_PATH))
    return ok.groupBy("upload_id").agg(F.min_by("url", F.struct("via", "source", "at")).alias("url"))


def learned_styles(verdicts: DataFrame, styles: DataFrame, limit: int = 2) -> DataFrame:
    """Winning categories that are styles are written, two at most; the others are hints."""
    won = verdicts.where(F.col("signal") == "style")
    names = styles.select(F.col("style").alias("answer")).distinct()
    written = O.dense_pos(won.join(names, "answer", "left_semi"), "category", [F.col("n").desc(), "answer"], None, name="rank")
    hints = won.join(names, "answer", "left_anti").withColumn("rank", F.lit(0))
    use = F.when((F.col("rank") > 0) & (F.col("rank") <= limit), "written").otherwise("hint")
    return written.unionByName(hints.select(*written.columns)).withColumn("use", use).select("category", "answer", "n", "use")


def player_order(url) -> Column:
    out = None
    for i, (_, sites) in enumerate(vocab.PLAYER_ORDER):
        hit = F.lower(col(url)).rlike("|".join(s.replace(".", r"\.") for s in sites))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(len(vocab.PLAYER_ORDER))


def order_players(urls: DataFrame, key: str = "mix_id") -> DataFrame:
    """Fixed platform priority, unknown hosts last, otherwise as they came."""
    ranked = urls.withColumn("_o", player_order("url"))
    return O.dense_pos(ranked, key, ["_o", "pos", "url"], None, name="rank").drop("_o")


def _player_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [templates.with_players(text or "", [(n["url"], n["title"]) for n in new])
                for text, new in zip(batch.column("wikitext").to_pylist(), batch.column("_new").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())],
                                         ["page_id", "player", "wikitext"])


def player_blocks(pages: DataFrame, new_urls: DataFrame) -> DataFrame:
    """Add addresses ``(page_id, url[, title])`` to each page's player block and write the block back.

    An address without a title is a mirror: all come in platform order.  One with a title is a further part of the
    recording: it comes last, and the block is a ``multi`` one.  As soon as one address has a title, those without
    are "Complete".  An empty address gives way.  Options, other parameters and everything outside of the block stay
    as they are; a page without a block keeps its source, and ``player`` is what would be put in.
    """
    title = F.col("title") if "title" in new_urls.columns else F.lit(None).cast("string")
    # by address, those with a title behind the others
    entry = F.struct(title.isNotNull().alias("part"), F.col("url").alias("url"), title.alias("title"))
    added = new_urls.where("url IS NOT NULL").groupBy("page_id").agg(F.array_sort(F.collect_set(entry)).alias("_new"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.join(added, "page_id").select("page_id", "wikitext", "_new").mapInArrow(_player_batches, f"page_id {kind}, player string, wikitext string")


def clone_pages(pages: DataFrame, new_titles: DataFrame) -> DataFrame:
    """A page as the start of a new one: player, tracklist, details and note emptied, year, artist
    and image taken from the new title."""
    old = parse_page_titles(pages).select("page_id", "title", "wikitext", F.col("year").alias("_oy"), F.col("artists").alias("_oa"))
    new = parse_page_titles(new_titles, "new_title").select("page_id", "new_title", F.col("year").alias("_ny"), F.col("artists").alias("_na"))
    out = old.join(new, "page_id")
    cat = lambda c: F.concat(F.lit("[[Category:"), c, F.lit("]]"))
    w = F.regexp_replace("wikitext", r"(\{\{Player[^\n]*\n)(?:[^{}]*\n)?\}\}", "$1 |\n}}")
    w = F.regexp_replace(w, r"(==\s*Tracklist\s*==\n)(?s:.*?)(?=\n\[\[Category:|\z)", "$1")
    w = F.regexp_replace(w, r"(==\s*Notes\s*==\n)[^\n]*https?://[^\n]*", "$1")
    w = F.regexp_replace(w, r"(?m)^\| .+$", "| ")
    w = F.replace(w, F.concat(F.lit("[[File:"), "title"), F.concat(F.lit("[[File:"), "new_title"))
    w = F.replace(w, cat(F.col("_oy")), cat(F.col("_ny")))
    w = F.replace(w, F.array_join(F.transform("_oa", cat), "\n"), F.array_join(F.transform("_na", cat), "\n"))
    return out.select("page_id", F.col("new_title").alias("title"), w.alias("wikitext"))


