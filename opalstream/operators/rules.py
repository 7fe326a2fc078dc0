"""Market classification: a rule table compiled to CASE expressions.

A text rule on the question comes first, then the first listed tag that is present, then whether there are tags.
The bet type is looked for only in the category's own group: by tag; else, where the group has rules on the
market type and there is one, by the first substring (or the fallback); else by the question (or the fallback);
without either it is unspecified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules, in the order in which they are tried.
TEXT_CATEGORY = (
    r"""(\b(says?|said|mentions?|posts?|tweets?)\b[^?]*["“‘])|(\b(says?|said|mentions?)\b[^?]*\b(\d+\s*(\+|or more)|times)\b)""",
    r"\bindex says\b",
    "MENTIONS",
)
TAG_CATEGORIES = [(100343, "MENTIONS"), (64, "ESPORTS"), (1, "SPORTS"), (84, "WEATHER"), (2, "POLITICS"), (21, "CRYPTO"), (596, "CULTURE")]
#: Categories, fallback, rules by tag, by substring of the market type, by pattern in the question.
GROUPS = [
    (
        ("SPORTS", "ESPORTS"),
        "SPORTS_PROP",
        [],
        [
            ("child_moneyline", "GAME_WINNER"),
            ("moneyline", "MONEYLINE"),
            ("handicap", "SPREAD"),
            ("spread", "SPREAD"),
            ("total", "OVER_UNDER"),
            ("corners", "OVER_UNDER"),
            ("completed_match", "SPORTS_PROP"),
            ("to_score", "SPORTS_PROP"),
            ("exact_score", "SPORTS_PROP"),
            ("to_advance", "SPORTS_PROP"),
            ("result", "MONEYLINE"),
            ("winner", "MONEYLINE"),
        ],
        [
            (r"\bSpread:|\bHandicap\b", "SPREAD"),
            (r"\bO/U\b|Over/Under", "OVER_UNDER"),
            (r"\b(Game|Map|Set|Leg)\s*\d+\s*Winner\b", "GAME_WINNER"),
            (r"^[^:]+\svs\.?\s[^:]+$", "MONEYLINE"),
            (r"^Will\s.+\swin\s(the\s)?.+\?$", "OUTRIGHT"),
        ],
    ),
    (
        ("WEATHER",),
        "WEATHER_OTHER",
        [
            (104596, "TEMP_HIGH"),
            (104597, "TEMP_LOW"),
            (103041, "PRECIPITATION"),
            (103545, "PRECIPITATION"),
            (103235, "PRECIPITATION"),
            (106182, "PRECIPITATION"),
            (1313, "PRECIPITATION"),
            (102023, "STORM"),
            (85, "STORM"),
            (102186, "STORM"),
        ],
        [],
        [
            ("highest temperature", "TEMP_HIGH"),
            ("lowest temperature", "TEMP_LOW"),
            (r"\bsnow\b|precipitation|rainfall", "PRECIPITATION"),
            ("hurricane|tropical storm", "STORM"),
        ],
    ),
    (
        ("CRYPTO",),
        "CRYPTO_PROP",
        [(102134, "PRICE_TARGET"), (102516, "PRICE_THRESHOLD"), (102127, "UP_DOWN")],
        [],
        [
            (r"\breach(es|ed)?\s*\$|\bdip(s|ped)?\s*to\s*\$", "PRICE_TARGET"),
            (r"price of .+ be (above|below|over|under)\s*\$", "PRICE_THRESHOLD"),
            (r"\bUp or Down\b", "UP_DOWN"),
        ],
    ),
    (
        ("POLITICS",),
        "POLITICS_PROP",
        [(144, "ELECTION_WINNER"), (100196, "FED_RATE_DECISION"), (159, "FED_RATE_DECISION"), (972, "TWEET_COUNT")],
        [],
        [
            (r"^Will\s.+\swin\s(the\s)?.+(election|nomination|primary)\b", "ELECTION_WINNER"),
            (r"\bFed\b.*\binterest rates?\b", "FED_RATE_DECISION"),
            (r"\bpost\s+[<\d].*\b(tweets|posts)\b", "TWEET_COUNT"),
        ],
    ),
    (
        ("CULTURE",),
        "CULTURE_PROP",
        [],
        [],
        [
            (r"^Will\s.+\sbe\sthe\s.+\?$", "AWARD_WINNER"),
            (r"\bbetween\s*[\d,.]+\S*\s+and\s+[\d,.]+|\b(less than|more than)\s*[\d,.]+\s*(million|m|k)?\s*(views|gross)\b", "MEDIA_METRIC_RANGE"),
        ],
    ),
    (
        ("MENTIONS",),
        "MENTION_PROP",
        [],
        [],
        [
            (r"\btimes\b|\b\d+\s*(\+|or more|or fewer|or less)", "MENTION_COUNT"),
            (r"\b(says?|said|posts?|tweets?|mentions?)\b|\bbe in the (headlines|manifesto)\b", "MENTION_TERM"),
        ],
    ),
]


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern, regardless of case, occurs; Unicode classes, and $ only at the very end.  Null text: no."""
    body = pattern.replace("$", r"\z") if pattern.endswith("$") else pattern
    return F.coalesce(text.rlike(f"(?iuUd){body}"), F.lit(False))


def _first(rules: list[tuple[Column, str]], otherwise) -> Column:
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for test, value in reversed(rules):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def _has(tags: Column, tag: int) -> Column:
    return F.coalesce(F.array_contains(tags, F.lit(tag)), F.lit(False))


def category(tags: Column, question: Column) -> Column:
    pattern, unless, name = TEXT_CATEGORY
    none = F.coalesce(F.size(tags), F.lit(0)) <= 0
    return _first([(matches(question, pattern) & ~matches(question, unless), name), *[(_has(tags, t), c) for t, c in TAG_CATEGORIES], (none, "UNSPECIFIED")], "OTHER")


def bet_type(kind: Column, tags: Column, market_type: Column, question: Column) -> Column:
    out = F.lit("UNSPECIFIED")
    for names, fallback, by_tag, by_type, by_text in GROUPS:
        group = F.when(question.isNotNull(), _first([(matches(question, p), b) for p, b in by_text], fallback)).otherwise(F.lit("UNSPECIFIED"))
        if by_type:
            group = F.when(market_type.isNotNull(), _first([(F.lower(market_type).contains(p), b) for p, b in by_type], fallback)).otherwise(group)
        out = F.when(kind.isin(*names), _first([(_has(tags, t), b) for t, b in by_tag], group)).otherwise(out)
    return out


def oracle(rows: str, keep: str) -> str:
    """DuckDB SQL that classifies a subquery's tags (list), market_type and question."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    hit = lambda p: f"coalesce(regexp_matches(question, {q(p)}, 'i'), false)"
    has = lambda t: f"coalesce(list_contains(tags, {t}), false)"
    pattern, unless, name = TEXT_CATEGORY
    cat = f"case when {hit(pattern)} and not {hit(unless)} then '{name}' " + " ".join(f"when {has(t)} then '{c}'" for t, c in TAG_CATEGORIES) + " when coalesce(len(tags), 0) = 0 then 'UNSPECIFIED' else 'OTHER' end"
    case = lambda rules, other: "case " + " ".join(f"when {t} then '{v}'" for t, v in rules) + f" else {other} end" if rules else other
    bets = []
    for names, fallback, by_tag, by_type, by_text in GROUPS:
        group = f"case when question is not null then {case([(hit(p), b) for p, b in by_text], q(fallback))} else 'UNSPECIFIED' end"
        if by_type:
            typed = case([(f"contains(lower(market_type), '{p}')", b) for p, b in by_type], q(fallback))
            group = f"case when market_type is not null then {typed} else {group} end"
        bets.append(f"when category in ({', '.join(map(q, names))}) then {case([(has(t), b) for t, b in by_tag], group)}")
    return f"select {keep}, category, case {' '.join(bets)} else 'UNSPECIFIED' end as bet_type from (select *, {cat} as category from ({rows}))"
