"""License scans by ordered signature rules, in DataFrame operations only.

Rules are regular expressions over the words of a text (A-Z lower-cased, joined by single spaces),
made by combining the license names below with the ways in which texts refer to a license. A rule
is tried only on texts that hold its keyword and the beginning of one of its names, and texts without
any keyword are only counted. Of the
places found, one that lies inside another of the same or a higher priority is suppressed; of two at
the same place, the higher priority and then the earlier rule stays. Three base phrases are always
reported.

Defined results: a null text counts as empty; an empty text has no words and no labels; whole texts
are read, however long; repeated rows get equal results; an empty table gives an empty result.
Other columns are neither read nor disturbed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.shared import pinned

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label; names as lower-case words (| between alternatives); short identifiers.
LICENSES = (
    ("mit", "mit|expat|x11", "mit|x11"),
    ("apache", "apache|apache software", "apache 2 0|apache 1 1|apache 1 0"),
    ("gpl", "general public|gnu general public|gnu gpl|gpl", "gpl 2 0|gpl 3 0|gpl 2 0 only|gpl 2 0 or later|gpl 3 0 only|gpl 3 0 or later"),
    ("lgpl", "lesser general public|library general public|gnu lesser general public|gnu lgpl|lgpl", "lgpl 2 1|lgpl 3 0|lgpl 2 0"),
    ("agpl", "affero general public|gnu affero general public|gnu agpl|agpl", "agpl 3 0|agpl 3 0 only|agpl 3 0 or later"),
    ("gfdl", "free documentation|gnu free documentation|gfdl", "gfdl 1 3|gfdl 1 2"),
    ("bsd", "bsd|new bsd|simplified bsd|modified bsd|revised bsd|berkeley software distribution", "bsd 2 clause|bsd 3 clause|bsd 4 clause|0bsd"),
    ("mpl", "mozilla public|mpl", "mpl 2 0|mpl 1 1"),
    ("epl", "eclipse public|epl", "epl 1 0|epl 2 0"),
    ("edl", "eclipse distribution", "edl 1 0"),
    ("cpl", "common public", "cpl 1 0"),
    ("ibmpl", "ibm public", "ipl 1 0"),
    ("cddl", "common development and distribution|cddl", "cddl 1 0|cddl 1 1"),
    ("eupl", "european union public|eupl", "eupl 1 1|eupl 1 2"),
    ("cecill", "cecill", "cecill 2 1|cecill b|cecill c"),
    ("isc", "isc|internet systems consortium", "isc"),
    ("zlib", "zlib|zlib libpng|libpng", "zlib|libpng 2 0"),
    ("bsl", "boost software|boost", "bsl 1 0"),
    ("busl", "business source|busl", "busl 1 1"),
    ("sspl", "server side public|sspl", "sspl 1 0"),
    ("elastic", "elastic", "elastic 2 0"),
    ("artistic", "artistic|perl artistic|clarified artistic", "artistic 1 0|artistic 2 0"),
    ("python", "python software foundation|psf|python", "psf 2 0|python 2 0"),
    ("php", "php", "php 3 01|php 3 0"),
    ("ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl|ssleay", "openssl"),
    ("curl", "curl", "curl"),
    ("vim", "vim", "vim"),
    ("wtfpl", "do what the fuck you want to public|wtfpl", "wtfpl"),
    ("unlicense", "unlicense|the unlicense", "unlicense"),
    ("ofl", "sil open font|open font|ofl", "ofl 1 1|ofl 1 0"),
    ("odbl", "open database|odbl", "odbl 1 0"),
    ("odc-by", "open data commons attribution", "odc by 1 0"),
    ("pddl", "public domain dedication and|open data commons public domain dedication and", "pddl 1 0"),
    ("osl", "open software", "osl 3 0"),
    ("afl", "academic free", "afl 3 0"),
    ("apsl", "apple public source", "apsl 2 0"),
    ("ms-pl", "microsoft public|ms pl", "ms pl"),
    ("ms-rl", "microsoft reciprocal|ms rl", "ms rl"),
    ("ncsa", "university of illinois ncsa open source|illinois ncsa|ncsa", "ncsa"),
    ("upl", "universal permissive", "upl 1 0"),
    ("mulan", "mulan permissive software|mulan", "mulanpsl 2 0"),
    ("w3c", "w3c software|w3c", "w3c"),
    ("zpl", "zope public|zpl", "zpl 2 1"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("lppl", "latex project public|lppl", "lppl 1 3c"),
    ("qpl", "q public|qt public", "qpl 1 0"),
    ("npl", "netscape public", "npl 1 1"),
    ("spl", "sun public", "spl 1 0"),
    ("ecl", "educational community", "ecl 2 0"),
    ("cc0", "cc0|creative commons zero|cc0 1 0 universal", "cc0 1 0"),
    ("cc-by", "cc by|creative commons attribution", "cc by 4 0|cc by 3 0|cc by 2 0"),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", "cc by sa 4 0|cc by sa 3 0"),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", "cc by nc 4 0|cc by nc 3 0"),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s?", "cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc by nc sa 4 0|cc by nc sa 3 0"),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd 4 0"),
    ("public-domain", "public domain", "public domain"),
    ("proprietary", "proprietary|commercial|end user", "proprietary"),
)

_VERSION = r"(?: (?:version|v) ?[0-9][0-9a-z]*(?: [0-9]+)*| v?[0-9](?: [0-9])*)?(?: or (?:any )?later(?: version)?)?"
_WORD = "licen[sc]e"
# Ways to refer to a license: priority, keyword, pattern with {names} or {ids}.
FORMS = (
    (4, "spdx", r"spdx {word} identifier {ids}"),
    (3, "licens", r"(?:dual |re)?licensed (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?{names}(?: {word})?{version}"),
    (3, "under", r"(?:released|distributed|available|published|provided|covered|redistributed|made available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?{names}(?: {word})?{version}"),
    (2, "licen", r"(?:gnu )?{names} {word}{version}"),
    (1, "licen", r"{word} (?:is |s )?(?:under )?(?:the )?{names}{version}"),
)
CONFIDENCE = {4: 0.99, 3: 0.95, 2: 0.85, 1: 0.6}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# On the raw text, so any separators may stand between the words of a keyword.
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEYWORDS = f"(?i)licen|spdx|(?:released|distributed|available|published|provided|covered){_APART}under"


def _any(names: str) -> str:
    """An alternation that tries longer names first."""
    return "(?:" + "|".join(sorted(names.split("|"), key=lambda x: (-len(x), x))) + ")"


def _literal(names: str) -> list[str]:
    """The fixed beginnings of a list of names; a text without any of them holds none of the names."""
    return sorted({re.split(r" ?\?|\(", name)[0].rstrip() for name in names.split("|")})


def rule_rows() -> list[tuple[int, bool, int, str, str, str, list[str]]]:
    """``(order, base, priority, label, keyword, pattern, beginnings)`` of every rule."""
    rows = [(0, True, 2, label, phrase.split()[-1], phrase, [phrase]) for phrase, label in BASE]
    for priority, keyword, form in FORMS:
        for label, names, ids in LICENSES:
            pattern = form.format(names=_any(names), ids=_any(ids), version=_VERSION, word=_WORD)
            rows.append((0, False, priority, label, keyword, pattern, _literal(ids if "{ids}" in form else names)))
    return [(k, *row[1:]) for k, row in enumerate(rows)]


def _rule_array() -> Column:
    """All rules as one literal array of structs."""
    made = [
        F.struct(
            F.lit(k).alias("rule"), F.lit(base).alias("base"), F.lit(priority).alias("priority"),
            F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"),
            F.array(*[F.lit(x) for x in beginnings]).alias("beginnings"),
        )
        for k, base, priority, label, keyword, pattern, beginnings in rule_rows()
    ]
    return F.array(*made)


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def places(gated: DataFrame) -> DataFrame:
    """``key, rule..label, first, last``: where each rule's words stand in ``gated(key, canon)``."""
    canon = F.col("canon")
    hopeful = F.filter(
        _rule_array(),
        lambda r: F.contains(canon, r["keyword"]) & F.exists(r["beginnings"], lambda x: F.contains(canon, x)),
    )
    tried = gated.select("key", "canon", F.explode(hopeful).alias("r"))
    found = tried.select(
        "key", "r", "canon", F.expr("regexp_extract_all(canon, r.pattern, 0)").alias("hits")
    ).where(F.size("hits") > 0)
    # the text between two hits, and so the number of words before each
    gaps = found.select("key", "r", "hits", F.expr("split(canon, r.pattern)").alias("gaps"))
    each = gaps.select(
        "key", "r", F.posexplode(F.arrays_zip("hits", F.slice("gaps", 1, F.size("hits")).alias("gaps"))).alias("at", "pair")
    )
    before = Window.partitionBy("key", "r.rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    words = _spaces(F.col("pair.hits"))
    counted = each.select(
        "key", "r", "at", words.alias("inside"), (F.sum(_spaces(F.col("pair.gaps")) + words).over(before) - words - 1).alias("first")
    )
    return counted.select(
        "key", "r.rule", "r.base", "r.priority", "r.label", F.col("first").cast("long").alias("first"),
        (F.col("first") + F.col("inside")).cast("long").alias("last"),
    )


def surviving(found: DataFrame) -> DataFrame:
    """``found`` less the places that lie inside another of the same or a higher priority."""
    earlier = (
        Window.partitionBy("key")
        .orderBy("first", F.desc("last"), F.desc("priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.lit(None).cast("long")
    for level in sorted(CONFIDENCE):
        reach = F.max(F.when(F.col("priority") >= level, F.col("last"))).over(earlier)
        covered = F.when(F.col("priority") == level, reach).otherwise(covered)
    marked = found.withColumn("covered", covered)
    return marked.where(F.col("covered").isNull() | (F.col("covered") < F.col("last"))).drop("covered")


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), lambda w: w != "")
    canon = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    counted = docs.select(
        "doc_id",
        # equal rows share a key and so their result
        F.struct(F.xxhash64("doc_id", text), F.xxhash64(text, "doc_id", F.lit(1))).alias("key"),
        F.regexp_count(text, F.lit(_ANY_CASE_WORD)).cast("long").alias("n_words"),
        F.when(text.rlike(_KEYWORDS), canon).alias("canon"),
    )
    rows = pinned(counted, "licenses")
    gated = rows.where("canon is not null").groupBy("key").agg(F.first("canon").alias("canon"))
    found = pinned(places(gated), "places")
    base = (
        found.where("base")
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"),
            F.sort_array(F.collect_set("label")).alias("base_held"),
        )
    )
    confidence = F.lit(0.0)
    for level, value in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == level, value).otherwise(confidence)
    method = (
        surviving(found).groupBy("key").agg(F.collect_set("label").alias("held"), F.max(confidence).alias("score"))
    )
    told = method.join(base, "key", "left").select(
        F.col("key").alias("k"), "n_base", "first_word", "last_word", "base_held", "held", "score"
    )
    none = F.array().cast("array<string>")
    return rows.select("key", "doc_id", "n_words").join(told, F.col("key") == F.col("k"), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base_held", none), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(F.coalesce("base_held", none), F.coalesce("held", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
