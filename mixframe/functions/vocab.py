"""Small curated word lists.  Long lists (labels, styles, cities) come in as tables."""

# Words that make a name a label's.
LABEL_WORDS = r"(?i)\b(?:records?|recordings?|recs?|label|music group)\b"

# A word that only counts: asks for no category.
COUNTING_NAME = r"(?i)^(?:(?:part|pt|vol|volume|episode|ep|chapter|no|nr|number|set|tape)\.?\s*)?#?\s*(?:\d{1,5}|one|two|three|four|five|six|seven|eight|nine|ten)?$"
# A generic series word alone, numbered or not, names nothing.
SERIES_WORD = r"(?i)^(?:podcast|radio|radio show|show|mix|mixtape|series|session|sessions|guest mix|live|set|episode)[\s.#:-]*\d{0,5}$"
LONGEST_NAME = 80

# Platform priority of players: (site, part of the address).
PLAYER_ORDER = [("Apple Podcasts", ["podcasts.apple.com"]), ("SoundCloud", ["soundcloud.com"]),
                ("hearthis.at", ["hearthis.at"]), ("YouTube", ["youtube.com", "youtu.be"]),
                ("Mixcloud", ["mixcloud.com"])]

# Categories that are buckets, not series.
BUCKETS = ["Promo Mix"]

# Page titles that say it is a recording made for promotion.
PROMO_MARK = " (Promo Mix)"
MARKERS = r"(?i)\s*\(\s*(?:Promo Mix|Live\s*P\.?\s*A\.?)\s*\)\s*$"
# Joiners between artists of a finished title; all but the comma need blanks around them.
TITLE_JOINERS = r"(?i)\s*,\s*|\s+(?:&|b2b|vs\.?|x|feat\.?|ft\.?)\s+"
SERIES_TYPES = ["podcast", "show", "radio", "internetradio"]
PLACE_TYPES = ["venue", "event"]
