"""Licence scan: ordered signature rules behind a keyword prefilter, all in Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import AFTER, BASE, BEFORE, Rule, rules

#: What separates words once A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _table(signatures: list[Rule]) -> Column:
    """The signatures by keyword, as one constant map."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    by_word: dict[str, list[Rule]] = {}
    for r in signatures:
        by_word.setdefault(r.keyword, []).append(r)
    row = lambda r: f"named_struct('rule', {r.number}, 'label', {quoted(r.label)}, 'before', {quoted(r.before)}, 'after', {quoted(r.after)}, 'priority', {r.priority})"
    return F.expr("map(" + ", ".join(f"{quoted(w)}, array({', '.join(map(row, rs))})" for w, rs in sorted(by_word.items())) + ")")


def any_of(words: set[str]) -> str:
    """Pattern of a blank and one of the words, by first letters, so that few are tried."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words):
        by_letter.setdefault(w[0], []).append(w[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ") "


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _found(words: Column, anchors: Column, table: Column) -> Column:
    """For each anchor with detections, in order of place: an array of
    (start, end, rule, label, priority), ``end`` being the place behind the last word."""

    def at_anchor(a: Column) -> Column:
        place = a["place"]
        window = F.struct(
            F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(place - BEFORE, F.lit(0)) + 1, F.least(place, F.lit(BEFORE))), " "), F.when(place > 0, " ").otherwise("")).alias("left"),
            F.concat(F.array_join(F.slice(words, place + 1, AFTER), " "), F.lit(" ")).alias("right"),
        )

        def tried(w: Column) -> Column:
            def match(r: Column) -> Column:
                after = F.call_function("regexp_extract", w["right"], F.concat(F.lit("^(?:"), r["after"], F.lit(") ")), F.lit(0))
                before = F.when((after == "") | (r["before"] == ""), F.lit("")).otherwise(F.call_function("regexp_extract", w["left"], F.concat(r["before"], F.lit("$")), F.lit(0)))
                return _let(
                    F.struct(after.alias("after"), before.alias("before")),
                    lambda m: F.when(
                        (m["after"] != "") & ((r["before"] == "") | (m["before"] != "")),
                        F.struct((place - F.greatest(_blanks(m["before"]) - 1, F.lit(0))).alias("start"), (place + _blanks(m["after"])).alias("end"), r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority")),
                    ),
                )

            return F.filter(F.transform(table[a["word"]], match), lambda d: d.isNotNull())

        return _let(window, tried)

    return F.filter(F.transform(anchors, lambda a: F.struct(a["place"].alias("place"), at_anchor(a).alias("found"))), lambda s: F.size(s["found"]) > 0)


def _outranks(b: Column, a: Column) -> Column:
    """b holds a's words and has the higher priority, or, of one priority, more words, or comes first in order."""
    longer = (b["end"] - b["start"]) > (a["end"] - a["start"])
    same = (b["end"] == a["end"]) & (b["start"] == a["start"])
    return (b["start"] <= a["start"]) & (b["end"] >= a["end"]) & ((b["priority"] > a["priority"]) | ((b["priority"] == a["priority"]) & (longer | (same & (b["rule"] < a["rule"])))))


def _kept(by_anchor: Column) -> Column:
    """Detections that no other outranks. All that can hold one begin near it, and
    anchors are different words, so a bounded stretch of anchors is looked at."""
    reach = BEFORE + AFTER

    def around(s: Column, k: Column) -> Column:
        near = F.flatten(F.transform(F.slice(by_anchor, F.greatest(k - reach, F.lit(0)) + 1, 2 * reach + 1), lambda x: x["found"]))
        return _let(near, lambda n: F.filter(s["found"], lambda a: ~F.exists(n, lambda b: _outranks(b, a))))

    return F.flatten(F.transform(by_anchor, around))


def _places(words: Column, anchors: Column, phrase: list[str], label: str, at: int) -> Column:
    """Starts of a phrase, from the places of its word number ``at``."""

    def here(a: Column) -> Column:
        same = a["word"] == phrase[at]
        for k, word in enumerate(phrase):
            place = a["place"] + (k - at)
            same &= F.coalesce(F.when(place >= 0, F.get(words, place)), F.lit("")) == word
        return same

    return F.transform(F.filter(anchors, here), lambda a: F.struct((a["place"] - at).alias("start"), F.lit(label).alias("label")))


def scan(docs: DataFrame, *, signatures: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What licences each document names: doc_id, n_words, base (label and start of
    every place of a base phrase) and detections (start, end, rule, label, priority).

    A-Z are lowered; words are runs of letters, digits and everything beyond ASCII,
    counted from 0. Each signature is a pattern around its keyword, over at most
    ``BEFORE`` words before it and ``AFTER`` from it on. A text without any keyword is done after one search. In the
    others, every place of a keyword is tried with the signatures of that word.
    Of overlapping detections, one that lies within another of higher priority goes;
    of one priority, the shorter; of equal words, the later rule. Detections that
    overlap without containment both stay.

    One row in, one row out: no shuffle, no Python. Null or empty texts, and those
    without words, have no words and no detections; repeated rows and null ids are
    scanned as they are; an empty table gives no rows; other columns are ignored.
    ``signatures`` replace the ones of :func:`license_rules.rules`.
    """
    signatures = rules() if signatures is None else signatures
    base = [(p.split(), label, at) for p, label, at in BASE]
    keywords = {r.keyword for r in signatures} | {w[at] for w, _, at in base}
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP, " ")), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("plain"))
    none = F.lit(None).cast("array<string>")
    words = F.when(F.col("plain").rlike(any_of(keywords)), F.split(F.trim("plain"), " ")).otherwise(none)
    n_words = F.when(F.length("plain") == 2, 0).otherwise(_blanks(F.col("plain")) - 1).cast("long")
    table = _table(signatures) if signatures else F.expr("CAST(map() AS map<string, array<struct<rule: int, label: string, before: string, after: string, priority: int>>>)")

    def look(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(sorted(keywords)), F.struct(i.alias("place"), x.alias("word")))), lambda a: a.isNotNull())

        def based(anchors: Column) -> Column:
            places = F.concat(*(_places(w, anchors, *b) for b in base))
            return F.struct(places.alias("base"), _let(_found(w, anchors, table), _kept).alias("detections"))

        return _let(hits, based)

    found = rows.select("doc_id", n_words.alias("n_words"), _let(words, look).alias("f"))
    return found.select("doc_id", "n_words", F.coalesce("f.base", F.array().cast("array<struct<start: int, label: string>>")).alias("base"), F.coalesce("f.detections", F.array().cast("array<struct<start: int, end: int, rule: int, label: string, priority: int>>")).alias("detections"))


def summary(scanned: DataFrame) -> DataFrame:
    """A row of :func:`scan` as labels, counts and a score: the highest priority of
    its detections over 100; 0.1 if base phrases are all there is; else 0."""
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    of = lambda column: F.transform(column, lambda d: d["label"])
    best = F.array_max(F.transform("detections", lambda d: d["priority"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(of("base")).alias("base_labels"),
        labels(of("base"), of("detections")).alias("labels"),
        F.coalesce(best / F.lit(100.0), F.when(F.size("base") > 0, 0.1), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
