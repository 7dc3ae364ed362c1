"""Resolve names against a typed entity catalogue.

``entities(title, type, mixes)`` (type NULL: a page that is no entity), ``aliases(alias, target)``,
``names(mix_id, pos, name)``.  Joins carry no broadcast hint: the catalogue may be of any size and
Spark broadcasts it when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import col, name_key, squeeze
from . import ordered as O

FAMILY_SIZE = 10
ASK_LIMIT = 10
QUALIFIER = r"\s*\(([^()]*)\)\s*$"


def name_keys(df: DataFrame, column: str = "name") -> DataFrame:
    return df.withColumn("key", name_key(column))


def base_name(title) -> Column:
    return F.regexp_replace(col(title), QUALIFIER, "")


def lookup_table(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """What a name key can hit: titles, qualified titles, and aliases one hop away."""
    typed = entities.where(F.col("type").isNotNull())
    fields = ["title", "type", "mixes"]
    exact = typed.select(name_key("title").alias("key"), *fields, F.col("title").alias("matched_title"),
                         F.lit("exact").alias("match_type"))
    qualified = typed.where(F.col("title").rlike(QUALIFIER)).select(
        name_key(base_name("title")).alias("key"), *fields, F.col("title").alias("matched_title"),
        F.lit("qualified").alias("match_type"))
    redirect = (aliases.join(typed, F.col("target") == F.col("title"))
                .select(name_key("alias").alias("key"), *fields, F.col("alias").alias("matched_title"),
                        F.lit("redirect").alias("match_type")))
    return exact.unionByName(qualified).unionByName(redirect).where(F.col("key") != "")


def best_lookup(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The rows of ``lookup_table`` among which the best answer of a key is found: of the entities of one title that with
    most mixes, and each alias once.  A title or alias that stands in many rows would else meet its likes in all pairs."""
    top = F.min_by(F.struct("type", "mixes"), F.struct(-F.col("mixes"), F.col("type"))).alias("t")
    typed = entities.where(F.col("type").isNotNull()).groupBy("title").agg(top).select("title", "t.*")
    return lookup_table(typed, aliases.select("alias", "target").distinct())


def lookup_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """All matches of each name, never collapsed."""
    out = name_keys(names).join(lookup_table(entities, aliases), "key")
    return out.withColumn("exact_case", F.col("name") == F.col("title")).drop("key")


def lookup_via_disambiguation(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """An alias of a page without type answers with the qualified entities of that page's name."""
    typed = entities.where(F.col("type").isNotNull()).select(F.col("title").alias("_t"))
    # an untyped target: no typed entity carries its title
    hop = aliases.join(typed, F.col("target") == F.col("_t"), "left_anti")
    hop = hop.select(name_key("alias").alias("key"), name_key("target").alias("base"), "alias")
    qualified = entities.where(F.col("type").isNotNull() & F.col("title").rlike(QUALIFIER)).select(
        name_key(base_name("title")).alias("base"), "title", "type", "mixes")
    return (name_keys(names).join(hop, "key").join(qualified, "base")
            .withColumn("match_type", F.lit("qualified")).withColumnRenamed("alias", "matched_title")
            .drop("key", "base"))


def entity_family(names: DataFrame, entities: DataFrame, aliases: DataFrame, size: int = FAMILY_SIZE) -> DataFrame:
    """Entities whose title or alias starts with the name, word by word; the ten with most mixes.

    The ten are picked per prefix before any name is joined, so a common first word costs its ten
    rows and not its whole family.
    """
    typed = entities.where(F.col("type").isNotNull())
    spelled = typed.select(F.col("title").alias("matched_title"), "title", "type", "mixes", F.lit(0).alias("_r")).unionByName(
        aliases.join(typed, F.col("target") == F.col("title"))
        .select(F.col("alias").alias("matched_title"), "title", "type", "mixes", F.lit(1).alias("_r")))
    words = F.split(F.trim("matched_title"), r"\s+")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.struct(
        name_key(F.array_join(F.slice(words, 1, i), " ")).alias("key"), (i == F.size(words)).alias("whole")))
    rows = spelled.select("*", F.inline(prefixes)).where(F.col("key") != "")
    kind = (F.when(F.col("whole") & (F.col("_r") == 0), "exact").when(F.col("whole"), "redirect").otherwise("prefix"))
    rows = rows.withColumn("match_type", kind)
    order = F.when(kind == "exact", 0).when(kind == "redirect", 1).otherwise(2)
    one = rows.groupBy("key", "title", "type").agg(F.min_by(
        F.struct("mixes", "matched_title", "match_type"), F.struct(order, "matched_title")).alias("r"),
        F.min(order).alias("_o")).select("key", "title", "type", "_o", "r.*")
    # top-k: WindowGroupLimit keeps ten rows per prefix and task before the shuffle
    from pyspark.sql import Window
    w = Window.partitionBy("key").orderBy("_o", F.col("mixes").desc(), "title", "type")
    top = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).drop("_o")
    return name_keys(names).join(top, "key").drop("key")


def filter_lookup_names(names: DataFrame, stop_names: DataFrame | None = None,
                        places: DataFrame | None = None) -> DataFrame:
    """Names worth asking: not empty, not too long, no counting or series word, no replaced name.

    ``stop_names(name)`` are names replaced by something else; ``places(name)`` are countries and
    cities, dropped where ``behind_at`` is set.
    """
    cleaned = squeeze(F.translate(F.regexp_replace("name", vocab.MARKERS, ""), "#", " "))
    out = names.withColumn("name", cleaned).withColumn("key", name_key("name"))
    out = out.where((F.col("key") != "") & (F.length("name") <= vocab.LONGEST_NAME)
                    & ~F.col("name").rlike(vocab.COUNTING_NAME) & ~F.col("name").rlike(vocab.SERIES_WORD))
    if stop_names is not None:
        out = out.join(stop_names.select(name_key("name").alias("key")).distinct(), "key", "left_anti")
    if places is not None:
        place = places.select(name_key("name").alias("key"), F.lit(True).alias("behind_at")).distinct()
        out = out.join(place, ["key", "behind_at"], "left_anti")
    return out.drop("key")


def distinct_ci(names: DataFrame, longest: int | None = None) -> DataFrame:
    """First spelling of each name per mix, in first-seen order."""
    first = (names.groupBy("mix_id", F.lower(F.trim("name")).alias("_k"))
             .agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("_at")))
    return O.dense_pos(first, "mix_id", ["_at", "_k"], longest).select("mix_id", "pos", "name")


def cap_candidates(names: DataFrame, n: int = ASK_LIMIT, longest: int | None = None) -> DataFrame:
    """Rank by source priority; the first ``n`` are asked, the rest reported as skipped."""
    out = O.dense_pos(names, "mix_id", ["priority", "pos", "name"], longest, name="ask_no")
    return out.withColumn("asked", F.col("ask_no") <= n)


def rank_matches(matches: DataFrame, prefer: list[str], key: str = "name") -> DataFrame:
    """Preferred types first, then exact, redirect, qualified, prefix, then by mixes."""
    order = [F.when(F.col("type").isin(*prefer), 0).otherwise(1),
             F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "redirect", 1)
             .when(F.col("match_type") == "qualified", 2).otherwise(3),
             F.col("mixes").desc(), F.col("title"), F.col("matched_title")]
    return O.dense_pos(matches, key, order, None, name="rank")


def canonical_names(names: DataFrame, matches: DataFrame, prefer: list[str]) -> DataFrame:
    """The catalogue's spelling where it is the same name; an alias keeps its own spelling unless
    the target differs from it by one substituted character."""
    order = F.struct(
        F.when(F.col("type").isin(*prefer), 0).otherwise(1).alias("a"),
        F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "redirect", 1)
        .when(F.col("match_type") == "qualified", 2).otherwise(3).alias("b"),
        (-F.col("mixes")).alias("c"), F.col("title").alias("d"))
    best = matches.groupBy("name").agg(F.min_by(F.struct("title", "matched_title"), order).alias("m"))
    asked, title, matched = name_key("name"), name_key("m.title"), name_key("m.matched_title")
    one_off = (F.length(title) == F.length(asked)) & (F.levenshtein(title, asked) == 1)
    value = (F.when(title == asked, F.col("m.title"))
             .when((matched == asked) & one_off, F.col("m.title"))
             .when(matched == asked, F.col("m.matched_title")).otherwise(F.col("name")))
    return (names.join(best, "name", "left")
            .withColumn("canonical", F.coalesce(value, "name")).drop("m"))


def match_confidence(matches: DataFrame) -> DataFrame:
    """100 minus what speaks against a match, kept between 10 and 95."""
    sizes = matches.select("name", "title", "match_type").groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    asked = name_key("name")
    spelling = (F.when(F.col("match_type") == "prefix", 30).when(asked == name_key("title"), 0)
                .when(asked == name_key("matched_title"), 10)
                .when(asked == name_key(base_name("title")), 5).otherwise(25))
    drop = (spelling + F.when(F.col("mixes") == 0, 10).otherwise(0)
            + F.when((F.col("mixes") < 3) & ~F.trim("name").contains(" "), 20).otherwise(0)
            + F.when(F.col("_n") > 1, 10).otherwise(0)
            + F.when(F.col("overruled"), 30).otherwise(0))
    percent = F.greatest(F.lit(10), F.least(F.lit(95), 100 - drop))
    return (matches.join(sizes, "name").withColumn("confidence", percent)
            .withColumn("band", confidence_band(F.col("confidence"))).drop("_n"))


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").otherwise("low")


def drop_known_labels(titles: DataFrame, labels: DataFrame, credits: DataFrame) -> DataFrame:
    """Brackets of a title that name nothing but labels go; a leading bracket stays.

    ``titles(doc_id, title)``, ``labels(name)``, ``credits(doc_id, name)`` (that mix's own credits).
    """
    pattern = r"[\[(]([^\[\]()]*)[\])]"
    found = titles.select("doc_id", F.posexplode(F.regexp_extract_all("title", F.lit(pattern), 0)).alias("no", "bracket"),
                          F.regexp_extract("title", rf"^\s*({pattern})", 1).alias("_lead"))
    found = found.where((F.col("no") > 0) | (F.col("_lead") != F.col("bracket"))).drop("_lead")
    inner = F.regexp_extract("bracket", pattern, 1)
    parts = found.select("doc_id", "no", "bracket", F.explode(F.split(inner, r"\s*[,/&]\s*")).alias("part"))
    parts = parts.withColumn("key", name_key("part"))
    known = labels.select(name_key("name").alias("key")).distinct().withColumn("_l", F.lit(True))
    own = credits.select("doc_id", name_key("name").alias("key")).distinct().withColumn("_c", F.lit(True))
    flagged = parts.join(known, "key", "left").join(own, ["doc_id", "key"], "left")
    is_label = F.col("_l").isNotNull() | F.col("_c").isNotNull() | F.col("part").rlike(vocab.LABEL_WORDS)
    gone = (flagged.where(F.col("key") != "").groupBy("doc_id", "no", "bracket").agg(F.bool_and(is_label).alias("all"))
            .where("all").groupBy("doc_id").agg(F.collect_set("bracket").alias("_gone")))
    cut = F.aggregate(F.coalesce("_gone", F.array().cast("array<string>")), F.col("title"),
                      lambda t, b: F.replace(t, b, F.lit("")))
    return titles.join(gone, "doc_id", "left").withColumn("title", squeeze(cut)).drop("_gone")


def resolve_handles(lines: DataFrame, handles: DataFrame) -> DataFrame:
    """``@handle`` becomes the display name; what is unknown stays.  ``replaced`` lists the swaps."""
    pattern = r"@([A-Za-z0-9_-]+)"
    asked = lines.select("doc_id", "line_no", F.explode(F.array_distinct(
        F.regexp_extract_all("raw", F.lit(pattern), 1))).alias("handle"))
    named = asked.withColumn("key", F.lower("handle")).join(
        handles.select(F.lower("handle").alias("key"), F.col("name").alias("_name")), "key")
    # longest handle first: '@ab' must not be cut out of '@abc'
    swaps = (named.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct(
        F.length("handle").alias("n"), "handle", "_name")), asc=False).alias("_swaps")))
    out = lines.join(swaps, ["doc_id", "line_no"], "left")
    none = F.array().cast("array<struct<n:int,handle:string,_name:string>>")
    text = F.aggregate(F.coalesce("_swaps", none), F.col("raw"), lambda t, s: F.regexp_replace(
        t, F.concat(F.lit("@"), s["handle"], F.lit("(?![A-Za-z0-9_-])")), s["_name"]))
    return (out.withColumn("replaced", F.array_join(F.array_sort(F.transform(F.coalesce("_swaps", none), lambda s: F.concat(
        F.lit("@"), s["handle"], F.lit("="), s["_name"]))), ";")).withColumn("raw", text).drop("_swaps"))


def map_styles(tags: DataFrame, rename: DataFrame, longest: int | None = None) -> DataFrame:
    """House styles of each mix: one tag may map to two, unknown tags pass, first seen first."""
    out = tags.join(rename.select("tag", "style_no", "style"), "tag", "left")
    out = out.select("mix_id", "pos", F.coalesce("style_no", F.lit(0)).alias("style_no"),
                     F.coalesce("style", "tag").alias("style"))
    first = out.groupBy("mix_id", "style").agg(F.min(F.struct("pos", "style_no")).alias("_at"))
    return O.dense_pos(first, "mix_id", ["_at"], longest).select("mix_id", "pos", "style")


def pick_qualified_place(places: DataFrame, matches: DataFrame) -> DataFrame:
    """Of ``Name (X)`` entities the one whose X is a word of the place group; none else.

    ``places(mix_id, name, words ARRAY)``.
    """
    words = places.select("mix_id", "name", F.posexplode("words").alias("word_no", "word")).withColumn("q", name_key("word"))
    options = matches.where(F.col("type").isin(*vocab.PLACE_TYPES) & F.col("title").rlike(QUALIFIER)).select(
        "name", "title", name_key(F.regexp_extract("title", QUALIFIER, 1)).alias("q")).distinct()
    return (words.where(F.col("q") != "").join(options, ["name", "q"])
            .groupBy("mix_id", "name").agg(F.min_by("title", F.struct("word_no", "title")).alias("title")))


def venue_base(places: DataFrame, entities: DataFrame) -> DataFrame:
    """``Elsewhere Loft`` files under ``Elsewhere`` when only the shorter name is a venue or event.

    Bases tried in order: the words before the last one, the act behind a fraction, the act before
    'For'.
    """
    known = entities.where(F.col("type").isNotNull()).select(name_key("title").alias("key")).distinct()
    bases = F.array(
        F.struct(F.lit(0).alias("o"), F.regexp_extract("name", r"^(.+)\s+\S+$", 1).alias("base")),
        F.struct(F.lit(1).alias("o"), F.regexp_extract("name", r"^\d/\d\s+(.+)$", 1).alias("base")),
        F.struct(F.lit(2).alias("o"), F.regexp_extract("name", r"(?i)^(.+?)\s+for\s+.+$", 1).alias("base")))
    unknown = name_keys(places).join(known, "key", "left_anti").drop("key")
    tried = unknown.select("mix_id", "name", F.inline(bases)).where(F.col("base") != "").withColumn("key", name_key("base"))
    place = entities.where(F.col("type").isin(*vocab.PLACE_TYPES)).select(name_key("title").alias("key"), "title")
    hit = tried.join(place, "key").groupBy("mix_id", "name").agg(F.min_by("title", F.struct("o", "title")).alias("base"))
    return places.join(hit, ["mix_id", "name"], "left").withColumn("place", F.coalesce("base", "name")).drop("base")


def labels_in_tracklists(lines: DataFrame) -> DataFrame:
    """Distinct label credits per mix: the part of the last bracket before its catalogue number."""
    bracket = F.regexp_extract("text", r"\[([^\[\]]+)\]\s*$", 1)
    label = F.trim(F.regexp_replace(bracket, r"\s+-\s+[^-]*\d[^-]*$", ""))
    out = lines.select("mix_id", "pos", label.alias("label")).where(F.col("label") != "")
    return (out.withColumn("key", name_key("label")).where(F.col("key") != "")
            .groupBy("mix_id", "key").agg(F.min_by("label", "pos").alias("label"), F.count(F.lit(1)).alias("n")))


def title_confidence(parses: DataFrame) -> DataFrame:
    """100 minus the points of all reasons of a parse, kept between 10 and 95."""
    left = F.aggregate("reasons", F.lit(100), lambda acc, r: acc - r["points"])
    return parses.withColumn("confidence", F.greatest(F.lit(10), F.least(F.lit(95), left)))
