"""URL filter: site rules first, then a weighted vocabulary searched with an Aho-Corasick automaton.

A term counts where it stands between characters other than ASCII letters and digits. One strict term, or soft terms
whose weights reach the limit (two distinct ones at the default weight), block a url; repeats of a term count once.

Edge cases. A null url, or one without ``://``, has an empty host and path and fits no rule; its text (if any) is still
searched, so a null is allowed. An empty table gives an empty result. Rows are judged one by one: repeated rows give
repeated results, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.shared import LETTERS

# Site rules (host and path prefix, verdict).
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Vocabulary with weights; a weight of LIMIT is a strict term.
LIMIT = 2
VOCABULARY = {
    "adult": 2, "camgirls": 2, "casino": 2, "escort": 2, "hentai": 2, "porn": 2, "pornhub": 2, "spam": 2, "viagra": 2, "xxx": 2,
    "ads": 1, "bet": 1, "bets": 1, "bonus": 1, "cheap": 1, "clickbait": 1, "crack": 1, "farm": 1, "free": 1, "jackpot": 1,
    "keygen": 1, "loan": 1, "lottery": 1, "nude": 1, "payday": 1, "pills": 1, "poker": 1, "sex": 1, "slots": 1, "torrent": 1,
    "track": 1, "tracker": 1, "warez": 1, "win": 1,
}


@lru_cache
def _automaton(vocabulary: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for number, (term, weight) in enumerate(vocabulary):
        found.add_word(term, (number, len(term), weight))
    found.make_automaton()
    return found


_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _hits(vocabulary: tuple[tuple[str, int], ...], limit: int):
    @F.pandas_udf("strict_hits int, soft_hits int, soft_weight int")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(vocabulary)
        for batch in urls:
            out = []
            for url in batch:
                terms = {}
                for end, (number, length, weight) in automaton.iter(url):
                    before = url[end - length] if end >= length else "/"
                    after = url[end + 1] if end + 1 < len(url) else "/"
                    if before not in _ALNUM and after not in _ALNUM:
                        terms[number] = weight
                soft = [w for w in terms.values() if w < limit]
                out.append((len(terms) - len(soft), len(soft), sum(soft)))
            yield pd.DataFrame(out, columns=["strict_hits", "soft_hits", "soft_weight"])

    return hits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path up to ``?`` or ``#``; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, *LETTERS), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url",
    rules: Sequence[tuple[str, str]] = SITE_RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict (``allow`` or ``block``) and the vocabulary hits of each row.

    A rule ``host/path`` fits its host, the host's subdomains and every path that starts with its own; the longest wins.
    """
    host, path = host_and_path(F.col(url))
    rule = verdict = None
    for text, decision in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        site, _, start = text.partition("/")
        fits = ((F.col("host") == site) | F.endswith("host", F.lit(f".{site}"))) & F.startswith("path", F.lit(f"/{start}"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    by_terms = F.when((F.col("strict_hits") > 0) | (F.col("soft_weight") >= limit), "block").otherwise("allow")
    found = _hits(tuple(sorted(vocabulary.items())), limit)(F.translate(F.coalesce(F.col(url), F.lit("")), *LETTERS))
    return (
        pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), found.alias("found"))
        .select("page_id", "host", "path", "found.strict_hits", "found.soft_hits", "found.soft_weight")
        .select(
            "page_id", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"),
            (by_terms if verdict is None else verdict.otherwise(by_terms)).alias("verdict"), "strict_hits", "soft_hits", "soft_weight",
        )
    )


def judge_urls_sql() -> str:
    """The same rows over table pages, with one regular expression per term."""
    rules = sorted(SITE_RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = [
        (text, verdict, f"(host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '/{start}')")
        for text, verdict in rules
        for site, _, start in [text.partition("/")]
    ]
    count = lambda terms: " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER) * {w}" for t, w in terms)
    strict = [(t, 1) for t, w in VOCABULARY.items() if w >= LIMIT]
    soft = [(t, w) for t, w in VOCABULARY.items() if w < LIMIT]
    return f"""
        WITH cut AS (SELECT page_id, coalesce(translate(url, '{LETTERS[0]}', '{LETTERS[1]}'), '') AS low,
                            CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
        parts AS (SELECT page_id, low, translate(raw, '{LETTERS[0]}', '{LETTERS[1]}') AS host,
                         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
        hits AS (SELECT page_id, host, path, {count(strict)} AS strict_hits, {count([(t, 1) for t, _ in soft])} AS soft_hits, {count(soft)} AS soft_weight FROM parts)
        SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{t}'" for t, _, c in fits)} END AS rule,
               CASE {' '.join(f"WHEN {c} THEN '{v}'" for _, v, c in fits)}
                    WHEN strict_hits > 0 OR soft_weight >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
               strict_hits, soft_hits, soft_weight
        FROM hits"""
