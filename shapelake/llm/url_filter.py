"""URL filter: host and path rules first, then a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of which one is enough, and terms of which several distinct ones are needed.
STRICT_TERMS = ("casino-win", "cheap-pills", "spam-farm", "adult-x", "free-bets", "porn", "xxx", "viagra", "escort", "jackpot")
SOFT_TERMS = ("ads", "track", "casino", "bets", "pills", "cheap", "free", "win", "adult", "spam", "farm", "click", "deal", "promo", "loan")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest rule ``(host, path, verdict)`` that fits, as text, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return rule, verdict


def _scan(strict: tuple[str, ...], soft: tuple[str, ...]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        terms = list(dict.fromkeys([*strict, *soft]))
        for k, term in enumerate(terms):
            automaton.add_word(term, (k, len(term), term in strict))
        if terms:
            automaton.make_automaton()

        def hits(url: str | None) -> tuple[int, int]:
            if not url or not terms:
                return 0, 0
            text, hard, easy = url.lower(), 0, set()
            for end, (k, length, is_strict) in automaton.iter(text):
                start = end + 1 - length
                if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                    continue
                if is_strict:
                    hard += 1
                else:
                    easy.add(k)
            return hard, len(easy)

        for urls in batches:
            yield pd.DataFrame([hits(u) for u in urls], columns=["strict_hits", "soft_terms"])

    return F.pandas_udf(run, "strict_hits long, soft_terms long")


def filter_urls(
    pages: DataFrame,
    *,
    rules: list[tuple[str, str, str]],
    strict: tuple[str, ...] = STRICT_TERMS,
    soft: tuple[str, ...] = SOFT_TERMS,
    min_soft: int = 2,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict on every URL; one row in, one row out, no shuffle.

    ``rules`` are (host, path, verdict): a rule fits its host and all subdomains
    if the path starts with the rule's; the longest (host plus path) wins and its
    verdict stands. Otherwise an Aho-Corasick automaton finds all vocabulary
    terms of the whole lower-cased URL in one scan. A hit counts if no letter or
    digit touches it. One strict hit, or ``min_soft`` distinct soft terms, block.

    Returns page_id, host, path, rule, verdict, strict_hits, soft_terms.

    Null URLs and those without ``://`` have empty host and path; a null URL has
    no hits and is allowed. Repeated rows are each judged. Of rules of one
    length, the last in text order wins. Other columns are ignored.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("hits", _scan(tuple(strict), tuple(soft))("url"))
    judged = judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "hits")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("hits.strict_hits") > 0) | (F.col("hits.soft_terms") >= min_soft), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "hits.strict_hits", "hits.soft_terms")
