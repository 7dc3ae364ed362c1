"""URL expressions: hosts, keys, canonical forms, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

# Hosts a submission is accepted from, playlists that are private to a viewer.
SUBMIT_HOSTS = ["hearthis.at", "mixcloud.com", "soundcloud.com", "youtube.com", "youtu.be"]
PRIVATE_PLAYLIST = r"^RD|^(?:WL|LL|LM)$"
VIDEO_ID = r"(?:youtube(?:-nocookie)?\.com/(?:[^/\n\s]+/\S+/|(?:v|e(?:mbed)?)/|\S*?[?&]v=)|youtu\.be/)([a-zA-Z0-9_-]{11})"
# Parameters that tell where a visit came from and not what is visited.
TRACKING = r"^(?:utm_[a-z_]+|si|fbclid|gclid|igshid|mc_[ce]id|ref)(?:=|$)"
# Nested addresses are looked into this deep.
NESTING = 3


def host(url) -> Column:
    """Host without www., lower case."""
    return F.regexp_replace(F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), r"^www\.", "")


def without_query(url) -> Column:
    return F.split(col(url), r"\?")[0]


def player_key(url) -> Column:
    """Scheme, www. and one trailing slash off: how player addresses are compared."""
    out = F.regexp_replace(F.trim(col(url)), r"^(https?://)(.+)$", "$2")
    out = F.regexp_replace(out, r"^www\.", "")
    return F.regexp_replace(out, r"^(.+)/$", "$1")


def query_value(url, name: str) -> Column:
    return F.try_url_decode(F.nullif(F.regexp_extract(col(url), rf"[?&]{name}=([^&#]+)", 1), F.lit("")))


def unwrapped(url) -> Column:
    """The address behind a redirector or an embed's ``url`` parameter, else the address itself."""
    out = col(url)
    for _ in range(NESTING):
        out = let(out, lambda o: let(query_value(o, "url"), lambda i: F.when(i.rlike("^https?://"), i).otherwise(o)))
    return out


def _own_video_id(u: Column) -> Column:
    by_path = F.regexp_extract(
        u, r"^https?://(?:[^/?#]*\.)?(?:youtube(?:-nocookie)?\.com|youtu\.be)/(?:(?:shorts|live|embed|v|e)/)?([a-zA-Z0-9_-]{11})/?(?:[?#]|$)", 1)
    return F.coalesce(F.nullif(F.regexp_extract(u, VIDEO_ID, 1), F.lit("")), F.nullif(by_path, F.lit("")))


def video_id(url, depth: int = NESTING) -> Column:
    """The 11-character video id of any form of the address, nested ones included."""
    def look(u):
        if depth <= 1:
            return _own_video_id(u)
        inner = F.coalesce(*[query_value(u, p) for p in ("continue", "next", "url", "q")])
        # only an address that nests another one is looked into
        return F.coalesce(_own_video_id(u), F.when(u.rlike("[?&](?:continue|next|url|q)="), video_id(inner, depth - 1)))

    return let(col(url), look)


def playlist_url(url) -> Column:
    """Canonical address of a set or playlist page, NULL for any other page."""
    u, h = col(url), host(url)
    seg = lambda i: F.regexp_extract(u, r"^[a-z]+://[^/]+/([^/?#]+)/([^/?#]+)/([^/?#]+)", i)
    first = F.regexp_extract(u, r"^[a-z]+://[^/]+/([^/?#]+)", 1)
    listed = query_value(u, "list")
    return (F.when(h.rlike(r"(^|\.)soundcloud\.com$") & (seg(2) == "sets"),
                   F.concat(F.lit("https://soundcloud.com/"), seg(1), F.lit("/sets/"), seg(3)))
            .when(h.rlike(r"(^|\.)mixcloud\.com$") & (seg(2) == "playlists"),
                  F.concat(F.lit("https://www.mixcloud.com/"), seg(1), F.lit("/playlists/"), seg(3), F.lit("/")))
            .when(h.rlike(r"(^|\.)youtube\.com$") & first.isin("playlist", "watch") & listed.isNotNull()
                  & ~listed.rlike(PRIVATE_PLAYLIST), F.concat(F.lit("https://www.youtube.com/playlist?list="), listed)))


def canonical_url(url) -> Column:
    """One address per page: embeds to pages, redirectors unwrapped, playlists reduced, tracking off, slash settled."""
    return let(unwrapped(url), lambda u: let(
        F.struct(u.alias("u"), host(u).alias("h"), video_id(u).alias("video"), playlist_url(u).alias("listed")), _canonical))


def _canonical(s: Column) -> Column:
    u, h, video = s["u"], s["h"], s["video"]
    feed = query_value(u, "feed")
    bare = F.regexp_replace(u, r"[?#].*$", "")
    plain = F.regexp_replace(bare, "/+$", "")
    # what is left of any other address: its parameters without those that only track the visit
    asked = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    return (F.when(video.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), video))
            .when(s["listed"].isNotNull(), s["listed"])
            .when(h == "hearthis.at", F.regexp_replace(bare, r"^https?://(?:www\.)?hearthis\.at/embed/(\d+)/.*$", "https://hearthis.at/$1/"))
            .when(h.rlike(r"(^|\.)mixcloud\.com$") & u.contains("feed="),
                  F.regexp_replace(feed, "^/", "https://www.mixcloud.com/"))
            .when(h.rlike(r"(^|\.)soundcloud\.com$"), F.concat(F.regexp_replace(plain, r"^https?://(?:www\.|m\.)?", "https://"), F.lit("/")))
            .when(h.rlike(r"(^|\.)discogs\.com$"), F.regexp_replace(bare, r"^(https?://[^/]*discogs\.com)/[a-z]{2}(?=/)", "$1"))
            .otherwise(F.concat(F.lit("https://"), h, F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(.*)$", 1), query)))


def undotted_slug(url) -> Column:
    """Dots taken out of the last path part, one slash behind it."""
    cut = F.regexp_replace(col(url), "/$", "")
    slug = F.regexp_extract(cut, r"([^/]*)$", 1)
    return F.concat(F.regexp_replace(cut, r"[^/]*$", ""), F.replace(slug, F.lit("."), F.lit("")), F.lit("/"))


def is_numeric_form(url) -> Column:
    return col(url).contains("hearthis.at") & F.get(F.split(col(url), "/"), F.lit(3)).rlike(r"^\d+$")


def slug(url) -> Column:
    """account/track of an address: what a page's source is searched for."""
    return F.nullif(F.lower(F.regexp_extract(col(url), r"^[a-z]+://[^/]+/([^/?#]+/[^/?#]+)", 1)), F.lit(""))
