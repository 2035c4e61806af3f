"""Text expressions: distances, years, actions of a question, error messages, number lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a question one about the river or about fields, and the words of each action, in the order
# in which they are tried; "river" actions need the river too.
RIVER = "river|nakat|naktia|nadi|corridor|riparian|riverbank|river bank|encroach|floodplain|stream|ramganga"
FIELDS = "field|farm|crop|plot|khet"
RIVER_ACTIONS = [
    ("river_course", "course|path|route|origin|source|confluence|length|how long|trace|drain|flows|where does|map the"),
    ("river_alerts", "construction|alert|clearing|cleared|new build|kiln|mining|dumping|recent|this year"),
    ("river_vegetation", "vegetation|riparian|green|tree|canopy"),
]
HISTORY = "over the years|timeline|history|trend|decade|every year|year by year|footprint|since 19"
FLOOD = "flood|inundat|waterlog|overflow|submerg|water expansion|water spread"
OTHER_ACTIONS = [
    ("water", "water|moisture|irrigat|dry|drought|rain|thirst"),
    ("scout", "scout|queue|priorit|visit|inspect|where should|which fields|hotspot"),
    ("fusion", "radar|sar|fusion|sentinel-1|optical|agree"),
    ("change", "change|anomal|unusual|trend|health|ndvi|declin|stress|greener"),
    ("field", "field|scan|crop|farm"),
]
# Fixed patterns: a distance with its unit; a year.
DISTANCE = r"(\d+(?:\.\d+)?)\s*(km|kilomet(?:er|re)s?|m|met(?:er|re)s?)\b"
YEAR = r"\b(19[89]\d|20[0-4]\d)\b"


def tidy(text: Column) -> Column:
    """Lower case, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def distances(text: Column) -> Column:
    """All distances in a text, in metres."""
    number = F.regexp_extract_all(text, F.lit(DISTANCE), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(DISTANCE), F.lit(2))
    return F.zip_with(number, unit, lambda n, u: n.cast("double") * F.when(u.startswith("k"), 1000.0).otherwise(1.0))


def years(text: Column, latest: int) -> Column:
    """The years from 1984 to ``latest`` that a text names, once each, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(1984, latest))))


def action(text: Column, latest: int) -> Column:
    """What a question asks for: rules tried in order, the first that holds wins."""
    q = tidy(text)
    has = lambda words: F.regexp_like(q, F.lit(words))
    river = has(RIVER)
    out = F.when(has("qila|kila|quila"), "qila").when(river & has(FIELDS), "river_fields").when(has(FLOOD), "river_flood")
    for name, words in RIVER_ACTIONS:
        out = out.when(river & has(words), name)
    out = out.when(river & (F.size(distances(q)) >= 2), "river_ladder")
    out = out.when(river & (has(HISTORY) | (F.size(years(q, latest)) >= 3)), "river_timeline").when(river, "river_change")
    for name, words in OTHER_ACTIONS:
        out = out.when(has(words), name)
    return out.otherwise("help")


def corridor(text: Column, default: float, least: float = 10.0, most: float = 2000.0) -> Column:
    """The first distance that a text names, or the default, within bounds, in whole metres."""
    first = F.coalesce(F.try_element_at(distances(text), F.lit(1)), F.lit(default))
    return F.least(F.greatest(first, F.lit(least)), F.lit(most)).cast("int")


def year_pair(found: Column, default: int, latest: int, first: int = 1990) -> Column:
    """Start and end of a comparison from the years found, and notes on what was moved, as a struct.

    One year before ``latest`` is the start; without one the default is. Both are moved into ``first`` to ``latest``,
    and the start before the end.
    """
    n = F.size(found)
    a = F.when((n >= 2) | ((n == 1) & (F.try_element_at(found, F.lit(1)) < latest)), F.try_element_at(found, F.lit(1))).otherwise(default)
    b = F.when(n >= 2, F.try_element_at(found, F.lit(-1))).otherwise(latest)
    end, start = F.least(b, F.lit(latest)), F.greatest(a, F.lit(first))
    moved = lambda x, to: F.concat(x.cast("string"), F.lit(f" moved to {to}"))
    notes = F.concat_ws(
        "; ",
        F.when(b > latest, moved(b, latest)),
        F.when(a < first, moved(a, first)),
        F.when(start >= end, F.concat(F.lit("start moved to "), (end - 1).cast("string"))),
    )
    return F.struct(F.when(start >= end, end - 1).otherwise(start).alias("year_a"), end.alias("year_b"), notes.alias("notes"))


# Where messages name a status, which status ranks before which, the kinds of statuses, and the wordings
# of other kinds in the order in which they are tried.
STATUS = (
    r"HTTP response code: (\d{3})",
    r"HTTP response code on \S+: (\d{3})",
    r"HTTP error code(?: for \S+ range \S+)?: (\d{3})",
    r"response_code=(\d+)",
    r"(?m)^(\d{3}): ",
)
STATUS_RANK = (403, 409, 404, 429, 503, 500, 502, 504)
STATUS_KIND = {403: "forbidden", 409: "forbidden", 404: "not_found", 429: "throttled", 503: "throttled", 500: "server", 502: "server", 504: "server", 206: "truncated", 0: "network"}
MESSAGE_KINDS = (
    ("stalled", "Operation too slow"),
    ("timeout", "timed out|Timeout was reached"),
    ("network", "[Cc]ould not resolve|Couldn.t resolve|Connection reset|Connection refused|SSL|Recv failure|Send failure|Failed to connect|connect\\(\\)"),
    ("truncated", r"got \d+ bytes, expected \d+|Read error|partial file"),
    ("decode", "[Dd]ecod|decompress|ZIPDecode|LZW|corrupt"),
)


def read_status(message: Column) -> Column:
    """Of all statuses that a message names, the one that ranks first, else the least error, else 0, else 206."""
    found = F.flatten(F.array(*[F.regexp_extract_all(message, F.lit(p), F.lit(1)) for p in STATUS])).cast("array<int>")
    ranked = F.filter(F.array(*map(F.lit, STATUS_RANK)), lambda c: F.array_contains(found, c))
    bare = F.when(F.array_contains(found, 0), 0).when(F.array_contains(found, 206), 206)
    return F.coalesce(F.try_element_at(ranked, F.lit(1)), F.array_min(F.filter(found, lambda c: c >= 400)), bare)


def read_kind(message: Column, status: Column, expiry: Column, now: Column, of_reading: Column) -> Column:
    """A failed read's kind; ``of_reading``: whether the failure came from reading at all."""
    kind = F.when((expiry <= now) & (status.isNull() | (status == 403)), "expired")
    for code, name in STATUS_KIND.items():
        if code >= 400:
            kind = kind.when(status == code, name)
    kind = kind.when(status >= 500, "server").when(status >= 400, "io")
    for name, words in MESSAGE_KINDS:
        kind = kind.when(F.regexp_like(message, F.lit(words)), name)
    return kind.when(status == 0, "network").when(status == 206, "truncated").when(of_reading, "io").otherwise("error")


def clean_message(text: Column, limit: int = 200) -> Column:
    """An error message without signed addresses: a URL becomes its file name, tokens go, blanks are single."""
    t = F.regexp_replace(text, r"(?:/vsicurl/)?https?://(?:[^\s,'\"()?/]*/)*([^\s,'\"()?/]*)(?:\?[^\s,'\"()]*)?", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\S+, band (\d+): ", "band $1: "), r"\?[^\s,'\")]+", "")
    t = F.regexp_replace(t, r"\b(?:sig|se|st|sp|sv|sr|skoid|sktid|skt|ske|sks|skv)=[^&\s,]*&?", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\S*%(?:3D|2F|2B)\S*", ""), r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def numbers(text: Column) -> Column:
    """A list of numbers parted by commas, semicolons or blanks; null where something is no number."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[,;\s]+", " ")), " ")
    made = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when(~F.exists(made, lambda x: x.isNull()), made)
