"""Scalar expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"
U64_MAX = "18446744073709551615"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def strip_0x(x: Column) -> Column:
    return F.regexp_replace(x, "^0[xX]", "")


def hex_bytes(x: Column, width: int | None = None) -> Column:
    """Bytes of hex text with an optional 0x; null unless an even number of digits, and width bytes if given."""
    body = strip_0x(x)
    digits = f"{{{2 * width}}}" if width else "*"
    ok = body.rlike(f"^[0-9a-fA-F]{digits}\\z") & (F.length(body) % 2 == 0)
    return F.when(ok, F.unhex(F.when(ok, body)))


def hex_u64(x: Column) -> Column:
    """Unsigned 64-bit number of hex text as decimal(20,0); null for bad digits, none, or more than 64 bits."""
    body = F.regexp_replace(strip_0x(x), "^0+(?=.)", "")
    return F.when(body.rlike("^[0-9a-fA-F]{1,16}\\z"), F.conv(body, 16, 10).cast(U64))


def first_market_id(text: Column) -> Column:
    """Number after the first "market_id:" at the start or after an ASCII space or comma; null for none or above
    64 bits.  Later occurrences aren't tried."""
    digits = F.regexp_extract(text, "(?:^|[ \\t\\n\\f\\r,])market_id:[ \\t\\n\\f\\r]*([0-9]*)", 1)
    number = F.when(digits.rlike("^0*[0-9]{1,20}\\z"), F.regexp_replace(digits, "^0+(?=.)", "").try_cast("decimal(38,0)"))
    return F.when(number <= F.lit(U64_MAX).cast("decimal(38,0)"), number.cast(U64))


# The prices of the outcomes, as 32-byte words.
PRICE_OUTCOMES = {
    "0000000000000000000000000000000000000000000000000de0b6b3a7640000": "TOKEN0",  # 1e18
    "0000000000000000000000000000000000000000000000000000000000000000": "TOKEN1",  # 0
    "00000000000000000000000000000000000000000000000006f05b59d3b20000": "TIE",  # 5e17
}


def price_outcome(kind: Column, price: Column) -> Column:
    """Outcome of a proposal's price (32 bytes); disputes and other prices are UNSPECIFIED."""
    out = F.lit("UNSPECIFIED")
    for word, name in PRICE_OUTCOMES.items():
        out = F.when(price == F.unhex(F.lit(word)), F.lit(name)).otherwise(out)
    return F.when(kind == "propose", out).otherwise(F.lit("UNSPECIFIED"))


def missing_id(market_id: Column) -> Column:
    """0 counts as missing."""
    return F.coalesce(market_id, F.lit(0)) == 0


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes"), F.lit(False))


def safe_int(x: Column) -> Column:
    return F.when(F.trim(x).rlike("^[+-]?[0-9]+\\z"), F.trim(x).try_cast("bigint"))


def normal_name(x: Column) -> Column:
    """Lower-case letters and digits only, for containment tests of names."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


# Slugs of games and their short names.
GAME_ALIASES = {
    "league-of-legends": "lol",
    "lol": "lol",
    "cs-go": "cs2",
    "csgo": "cs2",
    "cs-2": "cs2",
    "cs2": "cs2",
    "counter-strike": "cs2",
    "dota-2": "dota2",
    "dota2": "dota2",
    "valorant": "valorant",
}


def game(slug: Column) -> Column:
    """Short name of a game's slug; other slugs stay, trimmed and in lower case."""
    clean = F.lower(F.trim(F.coalesce(slug, F.lit(""))))
    pairs = [F.lit(x) for kv in GAME_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), clean), clean)


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("long")
    whole = lambda x: F.floor(x).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%ds", whole(s / 60), s % 60))
        .otherwise(F.format_string("%dh%dm", whole(s / 3600), whole(s % 3600 / 60)))
    )


def node_url(host: Column, remote: Column, port: Column, path: Column, tls: Column, default_port: int = 8012, default_path: str = "/events") -> Column:
    """Address of a node: its advertised host or where it was seen from, IPv6 in brackets, defaults for 0 and empty."""
    name = F.when(F.coalesce(host, F.lit("")) == "", remote).otherwise(host)
    name = F.when(name.contains(":") & ~name.startswith("["), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    port = F.when(F.coalesce(port, F.lit(0)) == 0, F.lit(default_port)).otherwise(port)
    path = F.when(F.coalesce(path, F.lit("")) == "", F.lit(default_path)).otherwise(path)
    return F.concat(F.when(tls, F.lit("wss://")).otherwise(F.lit("ws://")), name, F.lit(":"), port.cast("string"), path)


def redact(url: Column) -> Column:
    """The text before the first token parameter."""
    return F.substring_index(url, "?token=", 1)


def half_open_bin(x: Column, edges: list[float], names: list[str]) -> Column:
    """names[i] for edges[i-1] <= x < edges[i]; null stays null."""
    out = F.lit(names[-1])
    for e, n in reversed(list(zip(edges, names))):
        out = F.when(x < e, F.lit(n)).otherwise(out)
    return F.when(x.isNotNull(), out)


# Edges and names of tip (gwei) and lead (ms) buckets.
TIP_EDGES, TIP_NAMES = [50, 200, 1000, 5000], ["<50", "50-200", "200-1k", "1k-5k", ">=5k"]
LEAD_EDGES, LEAD_NAMES = [0, 500, 1000, 1500, 2000], ["behind", "0-0.5s", "0.5-1s", "1-1.5s", "1.5-2s", ">=2s"]


def lenient_list(x: Column) -> Column:
    """A JSON array of strings; blank or null is an empty list, other text null."""
    blank = F.coalesce(F.trim(x), F.lit("")) == ""
    return F.when(blank, F.expr("cast(array() as array<string>)")).when(F.trim(x).startswith("["), F.from_json(x, "array<string>"))


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def lower_bound_trust(agree: Column, disagree: Column, z: float = 1.645) -> Column:
    """Lower bound of the rate of agreement, with one made-up vote either way."""
    n = (agree + disagree).cast("double")
    p = (agree + 1) / (n + 2)
    return p - z * F.sqrt(p * (1 - p) / (n + 3))


def day_number(us: Column) -> Column:
    return F.floor(us / 86_400_000_000).cast("long")
