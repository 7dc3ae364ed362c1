"""From upload titles to page titles: chunks, names to ask, roles, the assembled title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, vocab
from ..functions.dates import SEPARATORS
from ..functions.text import name_key, squeeze
from ..session import stage
from .entities import confidence_band
from .uploads import date_candidates, episodes_from_titles, title_without_date

# More parts with artists than this are no line-up but a misreading.
MOST_GROUPS = 3
EPISODE_TAIL = r"(?i)(?:^|\s+)(?:(?:vol|volume|episode|ep|part|pt|no|nr)\.?\s*)?#?\s?\d{1,5}$"
CHUNK_SPLIT = rf"\s+[{SEPARATORS}]+\s+|\s+@\s+|\s*[\[\]()]\s*|\s+w/\s*|\s*\|\s*"


def title_chunks(uploads: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``(upload_id, chunk_no, chunk, name, behind_at, behind_with)``: the parts of each cleaned title, its date
    and its place-only parts taken out; ``name`` is the part without its number."""
    base = uploads if "date_text" in uploads.columns else date_candidates(
        uploads.withColumn("title", clean.upload_title("title")))
    text = title_without_date()
    rows = base.select("upload_id", text.alias("_t"), F.posexplode(F.split(text, CHUNK_SPLIT)).alias("chunk_no", "chunk"))
    rows = rows.withColumn("chunk", F.trim(F.regexp_replace("chunk", rf"^[\s{SEPARATORS},]+|[\s{SEPARATORS},]+$", "")))
    rows = rows.where(F.col("chunk") != "")
    at, guests = F.instr("_t", " @ "), F.instr("_t", " w/")
    rows = rows.withColumn("behind_at", (at > 0) & (F.instr("_t", F.col("chunk")) > at))
    rows = rows.withColumn("behind_with", (guests > 0) & (F.instr("_t", F.col("chunk")) > guests)).drop("_t")
    if places is not None:
        known = places.select(name_key("name").alias("_k")).distinct()
        rows = rows.withColumn("_k", name_key("chunk")).join(known, "_k", "left_anti").drop("_k")
    return rows.withColumn("name", F.trim(F.regexp_replace("chunk", EPISODE_TAIL, "")))


def member_names(chunks: DataFrame, best: DataFrame) -> DataFrame:
    """``(upload_id, chunk_no, members, n_members, n_known)``: parts the catalogue does not know as a whole, as lists of artists.

    ``chunks`` are parts without an answer.  A part is taken apart at its joiners, and each name is asked as it is and
    reduced (without "DJ" in front or a bracket behind); known names get the catalogue's spelling.
    """
    split = chunks.select("upload_id", "chunk_no", F.posexplode(F.split("name", vocab.TITLE_JOINERS)).alias("_i", "_name")).where(F.trim("_name") != "")
    reduced = F.trim(F.regexp_replace(F.regexp_replace("_name", r"(?i)^(?:dj|mc)\s+(?=\S)", ""), r"\s*[\[(][^\])]*[\])]\s*$", ""))
    asked = split.withColumn("_keys", F.array_distinct(F.array(name_key("_name"), name_key(reduced))))
    asked = asked.select("*", F.posexplode("_keys").alias("_try", "key")).join(best, "key", "left")
    known = F.when(F.col("m.type") == "artist", F.struct("_try", F.col("m.title").alias("title")))
    answers = asked.groupBy("upload_id", "chunk_no", "_i", "_name").agg(F.min(known).alias("_a"))
    listed = answers.groupBy("upload_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_a.title", F.trim("_name")).alias("n")))).alias("_members"), F.count("_a").cast("int").alias("n_known"))
    names = F.transform("_members", lambda x: x["n"])
    return listed.select("upload_id", "chunk_no", names.alias("members"), F.size(names).alias("n_members"), "n_known")


def joined_names(names) -> Column:
    """A, B & C."""
    n = F.size(names)
    return F.when(n < 2, F.get(names, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" & "), F.element_at(names, -1)))


def suggest_titles(uploads: DataFrame, lookup: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Suggested page title per upload with its parts and confidence.

    The roles come from the catalogue: a part known as series, venue or event is the entity, a
    part known as artist the artist; with one artist-less part left over, that is the artist.  Parts without an
    answer are asked a second time, name by name: one that holds a known artist is a list of artists, and so is what
    stands behind ``w/``.  Up to ``MOST_GROUPS`` parts with artists are named together, of more only the first.
    ``lookup`` as entities.lookup_table gives it.  A title without date or artist gets none.
    """
    base = date_candidates(uploads.withColumn("title", clean.upload_title("title")))
    # read three times below: the parts, the names asked again and the result
    base = stage(episodes_from_titles(base, F.lit(True)), "dated-titles")
    chunks = title_chunks(base, places)
    order = F.struct(F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "redirect", 1).otherwise(2), -F.col("mixes"), F.col("title"))
    best = lookup.groupBy("key").agg(F.min_by(F.struct("title", "type", "mixes", "match_type"), order).alias("m"))
    best = stage(best, "best-names")
    named = chunks.withColumn("key", name_key("name")).join(best, "key", "left")
    kind = F.col("m.type")
    role = (F.when(kind.isin(*vocab.SERIES_TYPES), "series").when(kind.isin(*vocab.PLACE_TYPES), "place")
            .when((kind == "artist") | (F.coalesce("n_known", F.lit(0)) > 0) | (kind.isNull() & F.col("behind_with")), "artist")
            .when(F.col("behind_at"), "place").otherwise("free"))
    named = named.where(F.col("name") != "")
    named = named.join(member_names(named.where(F.col("m").isNull()), best), ["upload_id", "chunk_no"], "left")
    named = named.withColumn("role", role).withColumn("spelled", F.coalesce("m.title", "name"))
    names = F.when(F.col("role") == "artist", F.when(F.col("m").isNotNull(), F.array("m.title")).otherwise(F.col("members")))
    named = named.withColumn("_names", F.coalesce(names, F.array().cast("array<string>")))
    pick = lambda r, c="spelled": F.min_by(c, F.when(F.col("role") == r, F.col("chunk_no")))
    per = named.groupBy("upload_id").agg(
        pick("series").alias("_series"), pick("place").alias("_place"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "artist", F.struct("chunk_no", "_names")))).alias("_groups"),
        pick("free", "name").alias("_free"), F.count_if(F.col("role") == "free").alias("n_free"),
        F.count_if(F.col("m").isNotNull()).alias("n_known"))
    # a title of which nothing but its number is left has no parts, and gets no suggestion
    groups = F.transform("_groups", lambda g: g["_names"])
    per = per.withColumn("_artist", joined_names(F.array_distinct(F.flatten(F.when(F.size(groups) <= MOST_GROUPS, groups).otherwise(F.slice(groups, 1, 1))))))
    out = base.join(per.drop("_groups"), "upload_id", "left")
    artist = F.coalesce("_artist", "_free")
    entity = F.coalesce("_series", "_place", F.when(F.col("_artist").isNotNull(), F.col("_free")))
    out = out.withColumn("artist", artist).withColumn("entity", entity)
    at_place = F.col("_series").isNull() & F.col("_place").isNotNull()
    promo = F.col("entity").isNull()
    number = (F.when(F.col("episode").isNull() | at_place, F.lit(""))
              .when(F.col("entity").isNull() & (F.col("episode_kind") == "number"), F.lit(""))
              .when(F.col("episode_kind") == "number", F.concat(F.lit(" "), "episode"))
              .otherwise(F.concat(F.lit(" ("), "episode", F.lit(")"))))
    joiner = F.when(at_place, F.lit(" @ ")).otherwise(F.lit(" - "))
    date = F.coalesce("date_out", F.col("created_at").cast("string"))
    text = F.concat(date, F.lit(" - "), F.col("artist"), F.coalesce(F.concat(joiner, F.col("entity")), F.lit("")), number,
                    F.when(promo, F.lit(vocab.PROMO_MARK)).otherwise(""))
    reason = lambda when, points, why: F.when(when, F.struct(F.lit(points).alias("points"), F.lit(why).alias("reason")))
    reasons = F.filter(F.array(
        reason(F.col("date_out").isNull(), 20, "no date in the title"),
        reason(F.col("date_readings") > 1, 10, "the date can be read two ways"),
        reason(F.col("_artist").isNull(), 25, "the artist is not known"),
        reason(F.col("entity").isNull(), 15, "no series, place or event"),
        reason(F.col("n_free") > 2, 15, "more than two parts without a role")), lambda r: r.isNotNull())
    points = F.aggregate(reasons, F.lit(100), lambda acc, r: acc - r["points"])
    confidence = F.greatest(F.lit(10), F.least(F.lit(95), points))
    suggested = F.when(F.col("artist").isNotNull(), squeeze(text))
    return out.select("upload_id", suggested.alias("suggested"), "artist", "entity", "episode", reasons.alias("reasons"),
                      confidence.alias("confidence"), confidence_band(confidence).alias("band"))
